"""Summaries of request streams: distinct counts, top keys, percentiles, counters and their deltas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.hashing import fmix32, key_hash, leading_zeros, mix64
from tracewell.functions.sketches import BloomFilter, CountMin, SpaceSaving, alpha
from tracewell.operators.order import with_rank
from tracewell.operators.replay import hit_rate

COUNTERS = ("hits", "misses", "load_successes", "load_failures", "load_nanos", "evictions", "rejections", "expirations")


def hll_registers(df: DataFrame, key: str, p: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, register, rank): each register's largest rank. Registers of parts merge by maximum; a null is no key."""
    if not 4 <= p <= 16:
        raise ValueError(f"p must be 4 to 16, got {p}")
    h = df.select(*by, F.col(key).cast("long").alias("_k")).filter("_k is not null").select(*by, mix64(F.col("_k")).alias("h"))
    rank = F.least(F.lit(65 - p), leading_zeros(F.shiftleft("h", p)) + 1)
    return h.groupBy(*by, F.shiftrightunsigned("h", 64 - p).alias("register")).agg(F.max(rank).cast("int").alias("rank"))


def hll_estimate(registers: DataFrame, p: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, estimate): the raw estimate, or linear counting of empty registers if that is small."""
    m = 1 << p
    sums = registers.groupBy(*by).agg(F.count("*").alias("filled"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    zeros = F.lit(m) - F.col("filled")
    raw = F.lit(alpha(m) * m * m) / (F.col("s") + zeros)
    linear = m * F.log(m / zeros)
    best = F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)
    return sums.select(*by, F.floor(best + 0.5).cast("long").alias("estimate"))


def top_keys(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, count) of the k most frequent keys, exactly; ties by key."""
    return df.groupBy(F.col(key).alias("key")).count().orderBy(F.desc("count"), "key").limit(k)


def space_saving(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, count) by Space-Saving with k counters: true <= count <= true + N / k.

    Each task folds its rows into k counters; the driver merges k rows a task.
    """

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = SpaceSaving(k)
        for frame in frames:
            s.add_all(frame["key"].tolist())
        yield pd.DataFrame(s.top(), columns=["key", "count"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key")).filter("key is not null").mapInPandas(part, f"key {kind}, count long").withColumn("part", F.spark_partition_id())
    parts: dict[int, SpaceSaving] = {}
    for r in rows.collect():
        parts.setdefault(r["part"], SpaceSaving(k)).count[r["key"]] = r["count"]
    total = SpaceSaving(k)
    for _, s in sorted(parts.items()):
        total = total.merge(s)
    return df.sparkSession.createDataFrame(total.top(), f"key {kind}, count long")


def count_min(trace: DataFrame, expected: int, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, key, estimate) of the ageing 4-bit sketch after a trace (pos, key), for each key in it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, sketch = frame.sort_values("pos"), CountMin(expected)
        for key in frame["key"].tolist():
            sketch.add(key)
        out = frame[[*by, "key"]].drop_duplicates()
        return out.assign(estimate=[sketch.estimate(key) for key in out["key"].tolist()])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in trace.select(*by, "key").schema)
    return trace.select(*by, "pos", "key").groupBy(*by).applyInPandas(run, f"{types}estimate int")


def seen_before(trace: DataFrame, expected: int, hashes: int = 4) -> DataFrame:
    """(pos, key, seen): whether a Bloom filter had each key before, in the trace's order; a null key was never seen.

    A key was seen if all its bits were set before, and a bit is set by the first request of
    any key that has it. So minima by bit and maxima by key replace the fold over the trace.
    """
    size = BloomFilter(expected, hashes).size
    a, b = F.col("_a"), F.col("_b")
    firsts = trace.filter("key is not null").groupBy("key").agg(F.min("pos").alias("_first")).withColumn("_a", key_hash(F.col("key"), trace.schema["key"].dataType)).withColumn("_b", fmix32(a))
    bits = firsts.select("key", "_first", F.explode(F.array(*((a + i * b).bitwiseAND(size - 1) for i in range(hashes)))).alias("_bit"))
    set_at = bits.groupBy("_bit").agg(F.min("_first").alias("_set"))
    whole = bits.join(set_at, "_bit").groupBy("key").agg(F.max("_set").alias("_whole"))
    return trace.select("pos", "key").join(whole, "key", "left").select("pos", "key", F.coalesce(F.col("pos") > F.col("_whole"), F.lit(False)).alias("seen"))


def last_percentiles(samples: DataFrame, value: str, order: str, n: int = 2048, fractions: Sequence[float] = (0.5, 0.9, 0.99, 0.999), by: Sequence[str] = (), whole: bool = True) -> DataFrame:
    """(``by``, p50, p90, ...) of the last n samples: element min(n - 1, floor(f * n)) in order; 0 without samples.

    ``whole`` drops what is behind the point. Only n rows of each group are ever sorted together.
    """
    if by:  # first in 64 parts of each group, so that a large group is never sorted in one task
        parts = samples.withColumn("_s", F.pmod(F.xxhash64(order), F.lit(64)))
        latest = lambda df, *keys: df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_r") <= n)
        newest = latest(latest(parts, *by, "_s"), *by)
    else:
        newest = samples.orderBy(F.desc(order)).limit(n)
    held = newest.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("v"))
    size = F.size("v")

    def at(f: float) -> Column:
        x = F.get("v", F.least(size - 1, F.floor(F.lit(f) * size)).cast("int"))
        x = F.floor(x).cast("double") if whole else x.cast("double")
        return F.when(size == 0, 0.0).otherwise(x)

    return held.select(*by, *(at(f).alias("p" + f"{100 * f:g}".replace(".", "")) for f in fractions))


def merge_counters(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of the counters over shards, with request count, hit rate and miss rate."""
    out = stats.groupBy(*by).agg(*(F.sum(c).alias(c) for c in COUNTERS if c in stats.columns))
    n = F.col("hits") + F.col("misses")
    return out.withColumns({"requests": n, "hit_rate": hit_rate(F.col("hits"), n)}).withColumn("miss_rate", 1 - F.col("hit_rate"))


def counter_deltas(ticks: DataFrame, order: str, counters: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Growth of each counter since the tick before, never negative (a reset counts as no growth)."""
    if by:
        w = W.partitionBy(*by).orderBy(order)
        return ticks.withColumns({f"{c}_delta": F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)) for c in counters})
    ranked = with_rank(ticks, [F.col(order)], "_at")  # one series: each tick meets the one before by its rank, not in one task
    before = ranked.select((F.col("_at") + 1).alias("_at"), *(F.col(c).alias(f"_{c}") for c in counters))
    out = ranked.join(before, "_at", "left")
    return out.select(*ticks.columns, *(F.greatest(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(0)).alias(f"{c}_delta") for c in counters))


def per_second(delta: Column, seconds: Column) -> Column:
    return delta / F.greatest(F.lit(0.001), seconds)


def fill_percent(size: Column, capacity: Column) -> Column:
    return F.when(capacity == 0, 0.0).otherwise(size * 100.0 / capacity)


def write_reduction(staged: Column, flushed: Column) -> Column:
    """1 - flushed / staged; 0 if nothing was staged."""
    return F.when(staged == 0, 0.0).otherwise(1 - flushed / staged)


def run_summary(samples: DataFrame, millis: str, seconds: float) -> DataFrame:
    """(requests, throughput, avg_millis, p50, p99) of a load run; ranks go over range partitions."""
    held = samples.agg(F.count("*").alias("requests"), F.avg(millis).alias("avg_millis"))
    ranked = with_rank(samples.select(F.col(millis).cast("double").alias("m")), [F.col("m")])
    size = F.lit(samples.count())
    at = lambda f: F.max(F.when(F.col("rank") == F.least(size - 1, F.floor(size * f)), F.col("m")))
    tail = ranked.agg(F.coalesce(at(0.5), F.lit(0.0)).alias("p50"), F.coalesce(at(0.99), F.lit(0.0)).alias("p99")).first()
    return held.select("requests", (F.col("requests") / seconds).alias("throughput"), F.coalesce("avg_millis", F.lit(0.0)).alias("avg_millis"), *(F.lit(float(tail[c])).alias(c) for c in ("p50", "p99")))


def variant_report(requests: DataFrame) -> DataFrame:
    """(variant, requests, avg_millis, hit_rate) of requests (variant, millis, hit); the variant off has no cache, so 0."""
    out = requests.groupBy("variant").agg(F.count("*").alias("requests"), F.avg("millis").alias("avg_millis"), F.sum(F.col("hit").cast("int")).alias("hits"))
    rate = F.when(F.col("variant") == "off", 0.0).otherwise(hit_rate(F.col("hits"), F.col("requests")))
    return out.select("variant", "requests", "avg_millis", rate.alias("hit_rate"))


def heat_bucket(rank: Column, total: Column, buckets: int) -> Column:
    return F.least(F.lit(buckets - 1), F.floor(rank / total * buckets)).cast("int")


def latest_frames(frames: DataFrame, order: str, n: int = 300) -> DataFrame:
    """The last n frames."""
    return frames.orderBy(F.desc(order)).limit(n)
