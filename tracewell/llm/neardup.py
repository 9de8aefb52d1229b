"""Near-duplicate groups by b-bit MinHash, confirmed on the full shingle sets.

Steps, none of which brings a whole group into one task or forms all its pairs:

1. One pass over the texts gives each document its shingle count, a digest of its set,
   band keys made of full minima, and a signature of the low bits of the minima.
2. Documents with equal sets are one class; only its smallest id goes on.
3. A band bucket with several members has a pivot, and each member is compared with the
   pivots of its buckets (a star), which gives links and, for each, where the sets differ.
4. Where a pivot's group still holds several components, its members meet in blocks of
   bounded size, one row for each pair of blocks, as those differences. A block gives the
   components that links join, not the links, so rows grow with the members.

Before a comparison the packed signatures give a similarity estimate, corrected for
chance collisions of low bits; only clear misses (``slack`` standard deviations below
the threshold) are dropped by it. Links are confirmed on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.storage import Scratch
from tracewell.llm.textops import Words, grams, lists, mix, slices

BITS = 4
ROWS = 5
BANDS = 32
#: Bits of the filter for texts that are compared; it has 8 MB, however many they are.
MARKS = 26
FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig array<long>"


def shingle_sets(col: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a shorter text is one shingle, an empty one none."""
    words = Words(col, lower=lower)
    h, bounds = words.hashes(), words.bounds
    g = grams(h, k)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(grams(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def _minima(s: np.ndarray, keys: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, in blocks of bounded size."""
    low = np.full(len(keys), 0xFFFFFFFF, dtype=np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (((x[i : i + 2048] ^ keys)) * factors).min(axis=1), out=low)
    return low


def _featurize(k: int, lower: bool, seed: int):
    rng = np.random.default_rng(seed)
    n = BANDS * ROWS
    keys = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32)
    factors = rng.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    spread = rng.integers(0, 1 << 63, (1, 1, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k, lower)
            some = np.array([len(s) > 0 for s in sets])
            low = np.array([_minima(s, keys[:, 0][:, None], factors) for s in sets if len(s)], dtype=np.uint32).reshape(-1, n)
            bands = mix((low.reshape(-1, BANDS, ROWS).astype(np.uint64) * spread).sum(axis=2, dtype=np.uint64) ^ band)
            bits = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(-1, n * BITS // 64, 64 // BITS)
            sig = (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    lists(bands.view(np.int64).ravel(), some * BANDS, pa.int64()),
                    lists(sig.view(np.int64).ravel(), some * sig.shape[1], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
            )

    return run


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal BITS-bit fields counted by bit counts, less the chance collisions."""
    words = BANDS * ROWS * BITS // 64
    ones = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS)))
    unequal = F.lit(0)
    for i in range(words):
        x = a.getItem(i).bitwiseXOR(b.getItem(i))
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal = unequal + F.bit_count(x.bitwiseAND(ones))
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(BANDS * ROWS))) - chance) / (1 - chance)


def least_estimate(threshold: float, slack: float = 5.0) -> float:
    """The estimate below which a pair is dropped."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - slack * math.sqrt(p * (1 - p) / (BANDS * ROWS)) / (1 - chance)


def _spots(ids: np.ndarray) -> np.ndarray:
    """A bit's place from 1 for each id."""
    return ((mix(ids.view(np.uint64)) >> np.uint64(64 - MARKS)) + np.uint64(1)).view(np.int64)


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2^MARKS bits in which those of the ids (doc_id) are set, so of a fixed size at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_spots(batch.column("doc_id").to_numpy(zero_copy_only=False)))], names=["spot"])

    rows = ids.mapInArrow(run, "spot long").groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    size = len(rows.sparkSession.range(1).select(F.bitmap_construct_agg(F.lit(0))).first()[0])
    out = np.zeros(max(1, (1 << MARKS) // 8 // size) * size, dtype=np.uint8)
    for r in rows.toLocalIterator():
        at = (r["bucket"] - 1) * size
        out[at : at + size] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _sets(k: int, lower: bool, marks: np.ndarray):
    """Shingle sets of the texts whose ids are marked, some others among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            spot = _spots(batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)) - 1
            batch = batch.filter(pa.array((marks[spot >> 3] >> (spot & 7) & 1).astype(bool)))
            sets = shingle_sets(batch.column("text"), k, lower)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "d1", "shingles"],
            )

    return run


def _against_pivot(percent: int):
    """Whether each set is similar enough to its pivot's, and what only one of the two holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, only = np.zeros(batch.num_rows, dtype=bool), []
            for i, (x, y) in enumerate(zip(batch.column("shingles"), batch.column("pivot_shingles"))):
                a, b = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([a, b])
                both.sort()
                once = np.ones(len(both), dtype=bool)
                same = both[1:] == both[:-1]
                once[1:] &= ~same
                once[:-1] &= ~same
                linked[i] = (100 + percent) * int(once.sum()) <= (100 - percent) * len(both)
                only.append(both[once].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "d1", "pivot", "p1")), pa.array(linked), pa.array(only, pa.binary())],
                names=["doc_id", "d1", "pivot", "p1", "linked", "only"],
            )

    return run


class _Block:
    """Members of a pivot's group, as arrays."""

    def __init__(self, members: pa.StructArray):
        self.component, self.n = (members.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("component", "n"))
        self.sig = members.field("sig").flatten().to_numpy().view(np.uint64).reshape(len(self.n), -1)
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in members.field("only")]
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.row, self.held = np.repeat(np.arange(len(sets)), self.size), np.concatenate([np.zeros(0, np.uint64), *sets])


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``estimate`` of all rows of one array of packed signatures with all of another."""
    ones = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    unequal = np.zeros((len(a), len(b)), dtype=np.int32)
    for i in range(a.shape[1]):
        x = a[:, i, None] ^ b[None, :, i]
        for shift in (2, 1):
            x |= x >> np.uint64(shift)
        unequal += np.bitwise_count(x & ones)
    chance = 2.0**-BITS
    return ((1 - unequal / (BANDS * ROWS)) - chance) / (1 - chance)


def _in_common(a: _Block, b: _Block, tile: int = 4096) -> np.ndarray:
    """How many entries each row of one block shares with each of another, by products of incidence matrices."""
    _, number, times = np.unique(np.concatenate([a.held, b.held]), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.where(shared, np.cumsum(shared) - 1, -1)[number]
    out = np.zeros((len(a.n), len(b.n)), dtype=np.int64)
    left, right = place[: len(a.held)], place[len(a.held) :]
    for at in range(0, int(shared.sum()), tile):
        x, y = (np.zeros((len(own.n), tile), dtype=np.float32) for own in (a, b))
        for m, own, where in ((x, a, left), (y, b, right)):
            here = np.flatnonzero((where >= at) & (where < at + tile))
            m[own.row[here], where[here] - at] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between labels: each label that isn't the least one it reaches, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        near = low.copy()
        np.minimum.at(near, x, low[y])
        np.minimum.at(near, y, low[x])
        near = near[near]
        if (near == low).all():
            break
        low = near
    more = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[more], nodes[low[more]]


def _across(percent: int, least: float):
    """Components that links join, from pairs of blocks (or one, with itself) of a pivot's group.

    A set is known by what it holds beyond its pivot's or lacks of it, and two sets differ
    exactly where these do. So the size of the symmetric difference is that of the two less
    what they have in common twice, and links are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks in batch.column("blocks"):
                both = [_Block(x.values) for x in blocks.values]
                a, b = both[0], both[-1]
                close = (a.component[:, None] != b.component[None, :]) & (_estimates(a.sig, b.sig) >= least)
                if not close.any():
                    continue
                apart = a.size[:, None] + b.size[None, :] - 2 * _in_common(a, b)
                x, y = np.nonzero(close & ((100 + percent) * apart <= (100 - percent) * (a.n[:, None] + b.n[None, :])))
                out.append(_joined(a.component[x], b.component[y]))
            ends = [np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    return run


def _block_pairs(members: DataFrame, scratch: Scratch, rows: int, size: int) -> DataFrame:
    """(blocks) of groups (pivot, p1) that hold several components: each pair of blocks with one outside the largest component.

    A block has about ``rows`` members and ``size`` bytes at most (or one member); which one a
    member is in depends on a hash, so no task orders or holds a group. Members of a
    group's largest component meet the others, not each other.
    """
    group = ["pivot", "p1"]
    weight = F.sum(F.length("only") + 120).alias("bytes")
    sized = scratch.table(members.groupBy(*group, "component").agg(F.count("*").alias("rows"), weight))
    plan = sized.groupBy(*group).agg(F.max(F.struct("rows", "component", "bytes")).alias("top"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("components"))
    need = lambda n, b: F.greatest(F.ceil(n / rows), F.ceil(b / size)).cast("int")
    plan = plan.filter("components > 1").select(*group, F.col("top.component").alias("largest"), need(F.col("top.rows"), F.col("top.bytes")).alias("inner_blocks"), need(F.col("rows") - F.col("top.rows"), F.col("bytes") - F.col("top.bytes")).alias("outer_blocks"))
    plan = scratch.table(plan)
    scratch.drop(sized)
    outer = F.col("component") != F.col("largest")
    spot = F.xxhash64("doc_id", "d1")
    at = F.when(outer, F.pmod(spot, "outer_blocks")).otherwise(F.col("outer_blocks") + F.pmod(spot, "inner_blocks")).cast("int")
    placed = members.join(plan, group).withColumn("at", at)
    placed = placed.repartition(*group, "at")  # by all three, or a hot pivot's blocks would stay together
    blocks = placed.groupBy(*group, "at", "outer_blocks", "inner_blocks").agg(F.collect_list(F.struct("component", "n", "sig", "only")).alias("members"))
    blocks = scratch.table(blocks)
    partners = F.sequence(F.lit(0), F.when(F.col("at") < F.col("outer_blocks"), F.col("outer_blocks") + F.col("inner_blocks") - 1).otherwise(F.col("outer_blocks") - 1))
    pairs = blocks.withColumn("partner", F.explode(partners))
    # A lone member has no partner in its own block.
    pairs = pairs.filter((F.col("at") != F.col("partner")) | (F.size("members") > 1))
    met = pairs.groupBy(*group, F.least("at", "partner").alias("low"), F.greatest("at", "partner").alias("high")).agg(F.collect_list("members").alias("blocks"))
    return met.select("blocks")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True, seed: int = 20240601, block_rows: int = 1024, block_bytes: int = 1 << 20) -> DataFrame:
    """Component of near-duplicates of each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * |A n B| >= ``percent`` * |A u B| for their sets of
    ``shingle``-word shingles. Returns doc_id, n_shingles, class_id (smallest id with an
    equal set), component_id (smallest id reachable) and kept (doc_id = component_id).

    A null or wordless text has an empty set and is linked with nothing; a text of fewer
    words is one shingle. Rows that repeat a doc_id are one document with several texts:
    each row stays and they share their component. A null doc_id can't be linked: it has
    a null component and is kept. An empty table gives an empty result. A text is read whole,
    in one row: its words and hashes take about 40 times its size while it is read.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.table(base.mapInArrow(_featurize(shingle, lower, seed), FEATURES))
    alive = feats.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(alive.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id")))
    members = scratch.table(feats.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0"), F.col("d1")).alias("d1"), "d2").join(classes, ["d1", "d2"], "left").drop("d1", "d2"))
    reps = alive.join(classes.withColumn("doc_id", F.col("class_id")), ["d1", "d2", "doc_id"])
    reps = scratch.table(reps.groupBy("doc_id", "d1", "d2").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    # A bucket's pivot is the member that is in the fullest buckets: the one nearest to what its group has in common.
    # Aggregates are read back before they are joined: dealt anew, a hot key's partition can be split.
    spread = reps.select("doc_id", "d1", F.explode("bands").alias("key"))
    buckets = scratch.table(spread.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"))
    cand = scratch.table(spread.join(buckets, "key"))
    fame = scratch.table(cand.groupBy("doc_id", "d1").agg(F.sum("held").alias("fame")))
    best = F.max(F.struct("fame", (-F.col("doc_id")).alias("id"), "d1")).alias("best")
    pivots = scratch.table(cand.join(fame, ["doc_id", "d1"]).groupBy("key").agg(best).select("key", (-F.col("best.id")).alias("pivot"), F.col("best.d1").alias("p1")))
    pairs = scratch.table(cand.join(pivots, "key").filter("doc_id <> pivot or d1 <> p1").select("doc_id", "d1", "pivot", "p1").distinct())
    scratch.drop(buckets, cand, fame, pivots)
    ids = pairs.select("doc_id").union(pairs.select("pivot")).distinct()
    # The texts to compare are found where they are, by a bitmap of their ids; what else it lets pass is joined with nothing.
    sets = base.mapInArrow(_sets(shingle, lower, _marks(ids)), "doc_id long, d1 long, shingles binary")
    twice = feats.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    sets = scratch.table(sets if twice.isEmpty() else sets.dropDuplicates(["doc_id", "d1"]))
    least = least_estimate(percent / 100)
    sigs = scratch.table(reps.join(ids, "doc_id", "left_semi").select("doc_id", "d1", "n", "sig"))
    as_pivot = lambda df: df.select(*(F.col(c).alias({"doc_id": "pivot", "d1": "p1"}.get(c, "pivot_" + c)) for c in df.columns))
    # Each document against its pivots. A clear miss still says how it differs, where others are in the group.
    crowd = pairs.groupBy("pivot", "p1").agg((F.count("*") > 1).alias("crowded"))
    pairs = scratch.table(pairs.join(sigs, ["doc_id", "d1"]).join(as_pivot(sigs), ["pivot", "p1"]).withColumn("near", estimate(F.col("sig"), F.col("pivot_sig")) >= least).join(scratch.table(crowd), ["pivot", "p1"]).filter("near or crowded").select("doc_id", "d1", "pivot", "p1"))
    met = pairs.join(sets, ["doc_id", "d1"]).join(as_pivot(sets), ["pivot", "p1"])
    star = scratch.table(met.mapInArrow(_against_pivot(percent), "doc_id long, d1 long, pivot long, p1 long, linked boolean, only binary"))
    first = members.filter("class_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("z")).filter("b < z")
    repeated = members.join(first, "doc_id").select(F.col("class_id").alias("a"), "b").filter("a <> b")
    links = scratch.table(star.filter("linked").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).unionByName(repeated).distinct())
    comp = components(links, scratch)
    # What is still apart in a pivot's group meets in blocks.
    heads = star.select("pivot", "p1").distinct().select(F.col("pivot").alias("doc_id"), F.col("p1").alias("d1"), "pivot", "p1", F.lit(b"").alias("only"))
    grouped = star.drop("linked").unionByName(heads).join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = grouped.groupBy("pivot", "p1").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("pivot", "p1")
    apart = scratch.table(grouped.join(scratch.table(mixed), ["pivot", "p1"]).join(sigs, ["doc_id", "d1"]))
    joined = scratch.table(_block_pairs(apart, scratch, block_rows, block_bytes).mapInArrow(_across(percent, least), "a long, b long").distinct())
    top = components(joined, scratch).withColumnRenamed("component", "top")
    moved = comp.join(top.withColumnRenamed("doc_id", "component"), "component", "left").select("doc_id", F.coalesce("top", "component").alias("component"))
    comp = moved.unionByName(top.join(comp, "doc_id", "left_anti").withColumnRenamed("top", "component"))
    comp = scratch.table(comp)
    scratch.keep(members, comp)
    comp = comp.withColumnRenamed("doc_id", "class_id")
    out = members.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))).join(comp, "class_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "class_id"))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
