"""What a cache in front of a table does with writes, and what load tests do to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.keyed import CacheConfig, merge, run_operations


def write_through(base: DataFrame, cached: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table and the cache after updates: each updated row is read again and stored; unknown keys change nothing."""
    after = merge(base, updates, key, columns)
    fresh = after.join(updates.select(key).distinct(), key, "left_semi")
    kept = cached.join(updates.select(key), key, "left_anti")
    return after, kept.unionByName(fresh.select(cached.columns))


def write_around(base: DataFrame, cached: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table after updates, and the cache without the updated keys."""
    return merge(base, updates, key, columns), cached.join(updates.select(key), key, "left_anti")


def write_back(cached: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The cache patched at once; the joined columns of a row stay. The table follows when the buffer is flushed."""
    return merge(cached, updates, key, columns)


# Chaos: operations (pos, now, op, key, value, ttl) for ``run_operations``.


def _operations(rows: DataFrame, op: str, value: str | None = "v") -> DataFrame:
    return rows.select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("now"), F.lit(op).alias("op"), "key", F.lit(value).cast("string").alias("value"), F.lit(None).cast("long").alias("ttl"))


def stampede(spark: SparkSession, key: int, requests: int) -> DataFrame:
    """Many requests for one key that nobody has."""
    return _operations(spark.range(requests).withColumn("key", F.lit(key).cast("long")), "load")


def scan_keys(spark: SparkSession, start: int, n: int) -> DataFrame:
    """Each of n keys once, which washes a cache out."""
    return _operations(spark.range(n).withColumn("key", F.col("id") + start), "load")


def expire_all(spark: SparkSession, pos: int = 0) -> DataFrame:
    return _operations(spark.range(pos, pos + 1).withColumn("key", F.lit(None).cast("long")), "clear", None)


def penetrate(spark: SparkSession, start: int, n: int) -> DataFrame:
    """Requests for keys that the table doesn't have either: nothing can be stored."""
    return _operations(spark.range(n).withColumn("key", F.lit(start) + F.col("id")), "load", None)


def loads(requests: DataFrame, single_flight: bool = True) -> DataFrame:
    """(loads) that concurrent requests (key) for missing keys cause: one for each key, or one for each request."""
    return requests.select("key").distinct().agg(F.count("*").alias("loads")) if single_flight else requests.agg(F.count("*").alias("loads"))


def chaos_report(before: DataFrame, chaos: DataFrame, config: CacheConfig) -> DataFrame:
    """(hits, misses, hit_rate) that the operations ``chaos`` add after ``before`` on one cache."""
    shift = before.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0] + 1
    late = chaos.withColumn("pos", F.col("pos") + shift)
    out = run_operations(before.unionByName(late), config).filter((F.col("pos") >= shift) & F.col("op").isin("get", "load"))
    hits, n = F.count("answer"), F.count("*")
    return out.agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n == 0, 1.0).otherwise(hits / n).alias("hit_rate"))
