"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

#: Words of a text: runs without space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: What ``mix`` adds, in place of columns of these names.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``rank``, from 0, in order of ``key`` (nulls last), without one task that sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).asc_nulls_last()
    placed = scratch.table(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    at, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        offsets += [F.lit(row["p"]), F.lit(at)]
        at += row["count"]
    first = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return placed.withColumn("rank", (first + F.col("_at") - F.shiftleft(part, 33)).cast("long")).drop("_at")


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """Add ``target`` to sources (weight, cap): shares of ``total`` by weight, clamped at cap.

    What is over a cap goes to the sources below theirs, by weight, until none is above. In
    a round all sources over their cap at the level so far are clamped, and the level rises;
    the driver sees four sums a round. If all caps together are too small, each is met.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("held"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free"), F.sum(F.when(over, 1).otherwise(0)).alias("n")
        ).first()
        if not row["free"]:
            return sources.withColumn("target", F.col("cap").cast("double"))
        if row["n"] == clamped:
            return sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)))
        level, clamped = (total - row["held"]) / row["free"], row["n"]


def _cut(parts: DataFrame, part: str) -> DataFrame:
    """The part (source, ``part``, words) of each source in which its words come over ``rest``, with ``start`` words before it."""
    before = F.col("start") + F.sum("words").over(W.partitionBy("of").orderBy(part)) - F.col("words")
    found = parts.withColumn("start", before).filter("start <= rest and start + words > rest")
    return found.select("source", "of", part, "rest", "start")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, epochs: int = 2, seed: int = 7, size: str | None = None) -> DataFrame:
    """Mix docs (doc_id, source and text, or a column named by ``size``) to target weights.

    Sources, in order of code points with null last, weigh ``weights`` in turn and share
    ``percent`` % of all words; a target stops at ``epochs`` times its source's size. All
    documents of a source are taken floor(target / size) times. The rest of the target is
    filled once more in the order of a seeded hash of doc_id; the document that meets the
    end is taken in part. Adds mix_size, mix_source_size, mix_target, mix_taken (words)
    and mix_copies (whole documents; one taken in part counts if half of it is).

    A null text or one without words has size 0. A null source is a source. Rows that
    repeat an id, or have none, are documents of their own. Hash order needs no task that
    sees a whole source: word sums of 256 hash buckets, then of the 256 within one of them,
    find the bucket that the end falls into, and only its documents are put in order. A text
    of any length is counted whole; columns named like those that are added are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ADDED]
    sized = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else word_count(F.col("text"))
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    # The caller's columns travel as one, so that their names meet no others.
    own = F.struct(*(F.col(f"`{c}`") for c in keep))
    rows = docs.select(own.alias("own"), F.col("source").cast("string").alias("source"), F.col("doc_id").alias("doc_id"), sized.alias("size"), order.alias("place"), tie.alias("tie"))
    rows = rows.withColumn("bucket", F.conv(F.substring("place", 1, 4), 16, 10).cast("int"))
    buckets = scratch.table(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sums = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    sums = ranked(sums, "source", scratch).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    sums = scratch.table(sums.withColumn("cap", F.col("source_size") * epochs))
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    aims = water_fill(sums, total * percent / 100)
    known = F.col("source_size") > 0
    aims = aims.withColumn("whole", F.when(known, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = aims.withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    aims = aims.select(F.col("source").alias("of"), "source_size", "target", "whole", "rest")
    wide = buckets.groupBy("source", F.shiftright("bucket", 8).alias("part")).agg(F.sum("words").alias("words"))
    start = aims.select("of", "rest", F.lit(0).cast("long").alias("start"))
    cut = _cut(wide.join(start, F.col("source").eqNullSafe(F.col("of"))), "part")
    inner = buckets.withColumn("wide", F.shiftright("bucket", 8)).join(cut.drop("source"), F.col("source").eqNullSafe(F.col("of")) & (F.col("wide") == F.col("part")))
    cuts = _cut(inner.drop("part"), "bucket").select(F.col("of").alias("cut_of"), F.col("bucket").alias("cut"), F.col("start").alias("before"))
    aims = scratch.table(aims.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"))
    joined = rows.join(aims, F.col("source").eqNullSafe(F.col("of")))
    # Without a cut the rest is the whole source (all words) or nothing.
    below = F.coalesce(F.col("bucket") < F.col("cut"), (F.col("rest") >= F.col("source_size")) & known)
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    plain = joined.filter(~at_cut).withColumn("extra", F.when(below, F.col("size")).otherwise(0))
    line = W.partitionBy("source").orderBy("place", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    edge = joined.filter(at_cut).withColumn("held", F.coalesce(F.sum("size").over(line), F.lit(0)) + F.col("before"))
    edge = edge.withColumn("extra", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("held")))).drop("held")
    out = plain.unionByName(edge)
    again = F.when((F.col("extra") * 2 >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    values = (F.col("size"), F.col("source_size"), F.col("target"), F.col("whole") * F.col("size") + F.col("extra"), (F.col("whole") + again).cast("long"))
    return out.select(*(F.col("own")[c].alias(c) for c in keep), *(v.alias(n) for n, v in zip(ADDED, values)))
