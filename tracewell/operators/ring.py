"""Routing by a consistent-hash ring: owners, replicas, balance, and what moves when nodes change."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.hashing import hash64, hash64_array
from tracewell.operators.order import asof

#: Fixed value: points of each node on the ring.
VIRTUAL_NODES = 500


class Ring:
    """Points of the nodes in signed order; its size is nodes times points, so it goes to executors whole."""

    def __init__(self, nodes: Sequence[str], virtual: int = VIRTUAL_NODES):
        self.nodes, self.virtual = sorted(set(nodes)), virtual
        names = [f"{n}#{v}" for n in self.nodes for v in range(virtual)]
        points = hash64_array(names).view(np.int64)
        order = np.argsort(points, kind="stable")
        self.points, self.owner = points[order], np.repeat(np.arange(len(self.nodes)), virtual)[order]

    def add(self, node: str) -> Ring:
        return Ring([*self.nodes, node], self.virtual)

    def remove(self, node: str) -> Ring:
        return Ring([n for n in self.nodes if n != node], self.virtual)

    def at(self, h: np.ndarray) -> np.ndarray:
        """The first point at or after each hash, the smallest after the last."""
        return np.searchsorted(self.points, h) % len(self.points)

    def owner_of(self, key: Column) -> Column:
        """The node of a STRING key; null for a null key or without nodes."""
        if not self.nodes:
            return F.lit(None).cast("string")
        names = np.array(self.nodes, dtype=object)

        @F.arrow_udf(T.StringType())
        def find(k: pa.Array) -> pa.Array:
            return pa.array(names[self.owner[self.at(hash64_array(k.to_pylist()).view(np.int64))]], pa.string(), mask=k.is_null().to_numpy(zero_copy_only=False))

        return find(key)

    def successors(self, count: int) -> np.ndarray:
        """For each point the next ``count`` different owners clockwise, its own first."""
        n, want = len(self.points), min(count, len(self.nodes))
        out = np.empty((n, want), dtype=np.int64)
        for i in range(n):
            found, j = [], i
            while len(found) < want:
                o = self.owner[j % n]
                if o not in found:
                    found.append(o)
                j += 1
            out[i] = found
        return out

    def replicas_of(self, key: Column, count: int) -> Column:
        """The nodes that hold a key, the primary first; null for a null key."""
        if not self.nodes:
            return F.array().cast("array<string>")
        names, table = np.array(self.nodes, dtype=object), self.successors(count)

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def find(k: pa.Array) -> pa.Array:
            held = names[table[self.at(hash64_array(k.to_pylist()).view(np.int64))]].tolist()
            return pa.array([h if ok else None for h, ok in zip(held, k.is_valid().to_pylist())], pa.list_(pa.string()))

        return find(key)


def ring_points(nodes: DataFrame, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(hash, owner) of nodes (id), as a table."""
    rows = nodes.select(F.col("id").alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
    return rows.select(hash64(F.concat_ws("#", "owner", F.col("v").cast("string"))).alias("hash"), "owner").orderBy("hash")


def ring_join(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """Add owner to keys (hash) by an as-of join with a ring table (hash, owner): the next point, else the smallest.

    For rings that fit a task ``Ring`` is faster; this one has no limit.
    """
    first = ring.agg(F.min_by("owner", "hash")).first()[0]
    return asof(keys, ring, "hash", "owner", forward=True).withColumn("owner", F.coalesce("owner", F.lit(first)))


def fairness(placed: DataFrame, node: str = "owner") -> DataFrame:
    """(nodes, mean, spread_percent): population standard deviation of keys per node in % of their mean."""
    counts = placed.groupBy(node).count()
    return counts.agg(F.count("*").alias("nodes"), F.avg("count").alias("mean"), (F.stddev_pop("count") / F.avg("count") * 100).alias("spread_percent"))


def moved(keys: DataFrame, key: str, before: Ring, after: Ring) -> DataFrame:
    """(moved_share) of keys whose owner differs."""
    pair = keys.select(before.owner_of(F.col(key)).alias("a"), after.owner_of(F.col(key)).alias("b"))
    return pair.agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("moved_share"))


def moved_by_modulo(keys: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """(moved_share) if owners were hash modulo number of nodes."""
    h = keys.select(hash64(F.col(key)).alias("h"))
    return h.agg(F.avg((F.pmod("h", F.lit(before)) != F.pmod("h", F.lit(after))).cast("double")).alias("moved_share"))


def read_with_fallback(keys: DataFrame, stored: DataFrame, health: DataFrame) -> DataFrame:
    """Answer of keys (key, replicas) from stored (node, key, value): that of the first healthy replica.

    A reachable replica without the key answers with a miss (null); later ones are not asked.
    """
    asked = keys.select("key", F.posexplode("replicas").alias("rank", "node")).join(health.filter("healthy").select("node"), "node")
    first = asked.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("f")).select("key", F.col("f.node").alias("node"))
    out = keys.select("key").join(first, "key", "left").join(stored, ["node", "key"], "left")
    return out.select("key", F.col("node").alias("answered_by"), "value")


def write_status(acks: DataFrame) -> DataFrame:
    """(key, status): 204 if any replica of acks (key, ok) took the write, else 503."""
    return acks.groupBy("key").agg(F.when(F.max(F.col("ok").cast("int")) == 1, 204).otherwise(503).alias("status"))


def health_changes(pings: DataFrame, failures: int = 3) -> DataFrame:
    """(node, seq, healthy) where a node's state changes, of pings (node, seq, ok).

    ``failures`` misses in a row make it unhealthy, one answer makes it healthy again; nodes start healthy.
    """
    w = W.partitionBy("node").orderBy("seq")
    rows = pings.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    misses = F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("node", "run").orderBy("seq"))
    rows = rows.withColumn("healthy", F.col("ok") | (misses < failures))
    return rows.withColumn("_was", F.coalesce(F.lag("healthy").over(w), F.lit(True))).filter("healthy <> _was").select("node", "seq", "healthy")
