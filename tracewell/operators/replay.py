"""Traces through caches: one ordered fold for each group of policy, capacity and shard."""

from __future__ import annotations

import pickle
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.hashing import next_power_of_two, shard_of
from tracewell.functions.policies import OPTIMUM, POLICIES, Policy, policy_named, reuse_distances, simulate
from tracewell.operators.order import dealt_by_range

NEVER = (1 << 31) - 1
#: Keys of caches in a batch of ``snapshots``, and of one cache more at most.
SHOWN_AT_ONCE = 1 << 18


def hit_rate(hits: Column, requests: Column) -> Column:
    """Share of hits; 1 without requests."""
    return F.when(requests == 0, F.lit(1.0)).otherwise(hits / requests)


def next_use(trace: DataFrame) -> DataFrame:
    """Add next_use: where each request's key is asked for again, or the largest int."""
    return trace.withColumn("next_use", F.coalesce(F.lead("pos").over(W.partitionBy("key").orderBy("pos")), F.lit(NEVER).cast("long")))


def replay(trace: DataFrame, capacities: Sequence[int], policies: Sequence[str] = (*POLICIES, OPTIMUM), by: Sequence[str] = (), tasks: int = 0) -> DataFrame:
    """(``by``, capacity, policy, hits, misses, hit_rate) of a trace (pos, key).

    A trace is one ordered fold, so its positions and keys must fit a task; ``by`` names columns
    whose groups are traces of their own. A trace is shuffled once for each of ``tasks`` parts of
    the settings, not for each setting: at most as many as the session has cores to run a few traces.
    """
    for c in capacities:
        if c < 1:
            raise ValueError(f"capacity must be at least 1, got {c}")
    settings = [(p, c) for c in capacities for p in policies]
    cores = trace.sparkSession.sparkContext.defaultParallelism
    tasks = tasks or (1 if by else max(1, min(cores, len(settings))))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["pos"].to_numpy(), kind="stable")
        keys = frame["key"].to_numpy()[order].tolist()
        rows = [(*key[:-1], p, c, *simulate(keys, int(c), p)) for p, c in settings[int(key[-1]) :: tasks]]
        return pd.DataFrame(rows, columns=[*by, "policy", "capacity", "hits", "misses"])

    rows = trace.select(*by, "pos", "key", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_part"))
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in trace.select(*by).schema)
    out = rows.groupBy(*by, "_part").applyInPandas(run, f"{types}policy string, capacity int, hits long, misses long")
    return out.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("hits") + F.col("misses")))


def distances(trace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, pos, key, distance): distinct keys since the last request of the key, null for the first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        d = reuse_distances(frame["key"].tolist())
        return frame.assign(distance=pd.array([None if x < 0 else x for x in d], dtype="Int64"))

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in trace.select(*by, "pos", "key").schema)
    return trace.select(*by, "pos", "key").groupBy(*by).applyInPandas(run, f"{types}distance long")


def lru_hits(trace: DataFrame, capacities: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(``by``, capacity, hits, misses) of LRU at all capacities from one pass of reuse distances; one trace goes by ranges."""
    if not by:
        return lru_hits_in_parts(trace, capacities)
    known = distances(trace, by)
    rows = known.groupBy(*by, "distance").count()  # a histogram is enough, and is smaller
    sums = rows.groupBy(*by).agg(*(F.sum(F.when(F.col("distance") < c, F.col("count")).otherwise(0)).alias(f"_{c}") for c in capacities), F.sum("count").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("capacity"), F.col(f"_{c}").alias("hits")) for c in capacities)))
    return sums.select(*by, "n", each.alias("e")).select(*by, "e.*", (F.col("n") - F.col("e.hits")).alias("misses"))


def hot_swap_replay(trace: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, policy, capacity, hits, misses) of a trace (pos, key, segment) whose cache is swapped for an empty one at each segment.

    ``segments`` (segment, policy, capacity) says what each is swapped for; a segment without
    a row is an error. Segments are traces of their own, so they run side by side.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["pos"].to_numpy(), kind="stable")
        policy, capacity = frame["policy"].iloc[0], frame["capacity"].iloc[0]
        if policy is None or pd.isna(capacity):
            raise ValueError(f"no settings for segment {key[0]}")
        hits, misses = simulate(frame["key"].to_numpy()[order].tolist(), int(capacity), policy)
        return pd.DataFrame([(key[0], policy, int(capacity), hits, misses)], columns=["segment", "policy", "capacity", "hits", "misses"])

    kind = trace.schema["segment"].dataType.simpleString()
    rows = trace.select("segment", "pos", "key").join(segments.select("segment", "policy", "capacity"), "segment", "left")
    return rows.groupBy("segment").applyInPandas(run, f"segment {kind}, policy string, capacity int, hits long, misses long")


def shard_capacity(shard: Column, capacity: int, shards: int) -> Column:
    """Capacity of a shard: an even split, the first shards one more."""
    return (F.lit(capacity // shards) + (shard < capacity % shards).cast("int")).cast("int")


def sharded_replay(trace: DataFrame, capacity: int, shards: Sequence[int], policy: str = "LRU") -> DataFrame:
    """(shards, capacity, hits, misses, hit_rate) if keys go to shards by hash, each with its part of the capacity."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["pos"].to_numpy(), kind="stable")
        hits, misses = simulate(frame["key"].to_numpy()[order].tolist(), max(1, int(frame["own"].iloc[0])), policy)
        return pd.DataFrame([(int(key[0]), hits, misses)], columns=["shards", "hits", "misses"])

    parts = []
    for n in shards:
        n = next_power_of_two(n)
        shard = shard_of(F.col("key"), n)
        parts.append(trace.select("pos", "key", F.lit(n).alias("shards"), shard.alias("shard")).withColumn("own", shard_capacity(F.col("shard"), capacity, n)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    out = rows.groupBy("shards", "shard").applyInPandas(run, "shards int, hits long, misses long").groupBy("shards").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    return out.select("shards", F.lit(capacity).alias("capacity"), "hits", "misses", hit_rate(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"))


def snapshots(trace: DataFrame, capacity: int, policy: str = "ARC") -> DataFrame:
    """One row for each request: (pos, key, hit, state, facts), where state has the policy's parts, newest keys first.

    ``facts`` are its numbers: ARC's target, and for W-TinyLFU the estimated frequency of the key.

    A cache depends on all requests before, so one task carries it through the trace in order of
    pos and key, and keeps it as it is before each range; ranges then give their rows side by side.
    Both take rows as they come, so a task holds a batch and the cache, however long the trace is.
    """
    if capacity < 1:
        raise ValueError(f"capacity must be at least 1, got {capacity}")
    empty = pickle.dumps((policy_named(policy, capacity), set()))
    dealt = dealt_by_range(trace.select(F.col("pos").cast("long").alias("pos"), "key"), [F.col("pos").asc()])
    kind = dealt.schema["key"].dataType

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = pickle.loads(empty), None
        for batch in batches:
            for p, key in zip(batch.column("_p").to_pylist(), batch.column("key").to_pylist()):
                if p != part:
                    part = p
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pickle.dumps(cache)], pa.binary())], ["_p", "_cache"])
                _request(*cache, capacity, key)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = None
        for batch in batches:
            rows = _Rows()
            for start, pos, key in zip(batch.column("_cache").to_pylist(), batch.column("pos").to_pylist(), batch.column("key").to_pylist()):
                if start is not None:
                    cache = pickle.loads(start)
                    continue
                rows.add(pos, key, _request(*cache, capacity, key), cache[0])
                if len(rows.members) >= SHOWN_AT_ONCE:
                    yield rows.batch(batch.schema.field("key").type)
                    rows = _Rows()
            if rows.pos:
                yield rows.batch(batch.schema.field("key").type)

    caches = dealt.repartition(1).sortWithinPartitions("_p", "pos", "key").mapInArrow(carry, "_p int, _cache binary")
    rows = dealt.withColumn("_cache", F.lit(None).cast("binary")).unionByName(caches.select(F.lit(None).cast("long").alias("pos"), F.lit(None).cast(kind).alias("key"), "_p", "_cache"))
    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionById(n, F.col("_p")).sortWithinPartitions("_p", F.col("_cache").isNull(), "pos", "key")
    kind = kind.simpleString()
    return ranges.mapInArrow(show, f"pos long, key {kind}, hit boolean, state map<string,array<{kind}>>, facts map<string,double>")


def _request(policy: Policy, resident: set, capacity: int, key: Hashable) -> bool:
    """Whether a request hits; the policy and the resident keys are as after it."""
    if key in resident:
        policy.on_access(key)
        return True
    policy.on_miss(key)
    policy.before_insert(key)
    while len(resident) >= capacity:
        out = policy.victim()
        policy.on_evict(out)
        resident.remove(out)
        policy.on_remove(out)
    resident.add(key)
    policy.on_insert(key)
    return False


class _Rows:
    """Rows of ``snapshots`` as flat columns."""

    def __init__(self):
        self.pos, self.keys, self.hits = [], [], []
        self.names, self.name_ends, self.members, self.member_ends = [], [0], [], [0]
        self.facts, self.fact_ends, self.values = [], [0], []

    def add(self, pos: int, key: Hashable, hit: bool, policy: Policy) -> None:
        self.pos.append(pos)
        self.keys.append(key)
        self.hits.append(hit)
        for name, part in _parts(policy).items():
            self.names.append(name)
            self.members.extend(reversed(part))
            self.member_ends.append(len(self.members))
        self.name_ends.append(len(self.names))
        if hasattr(policy, "p") or hasattr(policy, "counts"):
            self.facts.append("target" if hasattr(policy, "p") else "frequency")
            self.values.append(float(policy.p if hasattr(policy, "p") else policy.counts.estimate(key)))
        self.fact_ends.append(len(self.facts))

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        ends = lambda x: pa.array(x, pa.int32())
        members = pa.ListArray.from_arrays(ends(self.member_ends), pa.array(self.members, kind))
        state = pa.MapArray.from_arrays(ends(self.name_ends), pa.array(self.names, pa.string()), members)
        facts = pa.MapArray.from_arrays(ends(self.fact_ends), pa.array(self.facts, pa.string()), pa.array(self.values, pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(self.pos, pa.int64()), pa.array(self.keys, kind), pa.array(self.hits, pa.bool_()), state, facts], ["pos", "key", "hit", "state", "facts"])


def _parts(policy: object) -> dict[str, dict]:
    names = {"order": "order", "recent": "t1", "frequent": "t2", "window": "window", "probation": "probation", "protected": "protected", "inbox": "in", "main": "main"}
    found = {label: v for attr, label in names.items() if isinstance(v := getattr(policy, attr, None), dict)}
    if hasattr(policy, "ghosts") and isinstance(policy.ghosts, dict):
        found |= {"b1": policy.ghosts[1].keys, "b2": policy.ghosts[2].keys}
    if hasattr(getattr(policy, "main", None), "probation"):
        found |= {"probation": policy.main.probation, "protected": policy.main.protected}
    return found


def lru_hits_in_parts(trace: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """(capacity, hits, misses) of LRU on one trace (pos, key) of any length, by ranges of it side by side.

    What LRU of capacity c knows at some request are the c keys used last before it. So each
    range starts from the ``max(capacities)`` keys last used before it, which the ranges' own
    last keys give: the driver merges so many keys of each range, in order.
    """
    most = max(capacities)
    dealt = dealt_by_range(trace.select("pos", "key"), [F.col("pos").asc()])
    ends = dealt.groupBy("_p", "key").agg(F.max("pos").alias("pos"))
    newest = F.row_number().over(W.partitionBy("_p").orderBy(F.desc("pos")))
    ends = ends.withColumn("r", newest).filter(F.col("r") <= most).orderBy("_p", "pos").collect()  # capacity rows for each range
    of_part: dict[int, list] = {}
    for r in ends:
        of_part.setdefault(r["_p"], []).append(r["key"])
    state: dict = {}  # keys in order of their last use
    warm = []
    for part, keys in sorted(of_part.items()):
        warm += [(part, i - len(state), k) for i, k in enumerate(state)]
        for k in keys:
            state.pop(k, None)
            state[k] = None
        for k in list(state)[: max(0, len(state) - most)]:
            del state[k]
    kind = trace.schema["key"].dataType.simpleString()
    before = trace.sparkSession.createDataFrame(warm, f"_p int, pos long, key {kind}").withColumn("_warm", F.lit(True))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_warm", "pos"], ascending=[False, True])
        d = np.array(reuse_distances(frame["key"].tolist()))[~frame["_warm"].to_numpy()]
        d = np.where((d < 0) | (d >= most), -1, d)
        values, counts = np.unique(d, return_counts=True)
        return pd.DataFrame({"distance": values, "n": counts})

    rows = dealt.select("_p", "pos", "key", F.lit(False).alias("_warm")).unionByName(before)
    known = rows.groupBy("_p").applyInPandas(run, "distance long, n long").groupBy("distance").agg(F.sum("n").alias("n"))
    held = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(F.when((F.col("distance") >= 0) & (F.col("distance") < c), F.col("n"))), F.lit(0)).alias(f"_{c}") for c in capacities))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("capacity"), F.col(f"_{c}").alias("hits")) for c in capacities)))
    return held.select("n", each.alias("e")).select("e.*", (F.col("n") - F.col("e.hits")).alias("misses"))
