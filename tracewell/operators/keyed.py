"""Keyed state with time to live, weights and removal events: operations in, answers and removals out."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.hashing import next_power_of_two, shard_of
from tracewell.functions.policies import policy_named
from tracewell.operators.order import asof, with_rank

CAUSES = ("EXPLICIT", "REPLACED", "SIZE", "EXPIRED")


def was_automatic(cause):  # noqa: ANN001, ANN201
    """Whether nobody asked for the removal."""
    return cause.isin("SIZE", "EXPIRED")


@dataclass(frozen=True)
class CacheConfig:
    """All knobs of a cache; times are nanoseconds."""

    capacity: int = 1000
    policy: str = "LRU"
    weigher: Callable[[Hashable, Any], int] | None = None
    after_write: int = 0
    after_access: int = 0
    jitter: float = 0.0
    shards: int = 1
    seed: int = 0

    def __post_init__(self) -> None:
        if self.capacity < 1:
            raise ValueError(f"capacity must be at least 1, got {self.capacity}")
        policy_named(self.policy, self.capacity)  # raises for an unknown one
        if self.after_write < 0 or self.after_access < 0:
            raise ValueError("times to live can't be negative")
        if not 0 <= self.jitter < 1:
            raise ValueError(f"jitter must be in [0, 1), got {self.jitter}")
        if self.shards < 1 or self.shards != next_power_of_two(self.shards):
            raise ValueError(f"shards must be a power of two, got {self.shards}")


@dataclass
class Entry:
    value: Any
    weight: int
    hard: int | None = None
    due: int | None = None


@dataclass
class Cache:
    """One shard. Entries that are due go before any victim is chosen; an entry is due at its deadline."""

    config: CacheConfig
    capacity: int
    entries: dict[Hashable, Entry] = field(default_factory=dict)
    weight: int = 0
    removed: list[tuple[Hashable, Any, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("hits", "misses", "evictions", "rejections", "expirations"), 0))

    def __post_init__(self) -> None:
        from tracewell.functions.random import SplitMix

        self.policy = policy_named(self.config.policy, self.capacity)
        self.dues: list[tuple[int, int, Hashable]] = []
        self.tick, self.rng = 0, SplitMix(self.config.seed)

    def _remove(self, key: Hashable, cause: str) -> None:
        entry = self.entries.pop(key)
        self.weight -= entry.weight
        self.policy.on_remove(key)
        self.removed.append((key, entry.value, cause))

    def _schedule(self, key: Hashable, entry: Entry, now: int) -> None:
        idle = now + self.config.after_access if self.config.after_access else None
        known = [d for d in (entry.hard, idle) if d is not None]
        entry.due = min(known) if known else None
        if entry.due is not None:
            self.tick += 1
            heapq.heappush(self.dues, (entry.due, self.tick, key))

    def expire(self, now: int) -> None:
        """Remove all that is due."""
        while self.dues and self.dues[0][0] <= now:
            due, _, key = heapq.heappop(self.dues)
            entry = self.entries.get(key)
            if entry and entry.due == due:
                self.counts["expirations"] += 1
                self._remove(key, "EXPIRED")

    def contains(self, key: Hashable, now: int) -> bool:
        """Present and not due; nothing changes."""
        entry = self.entries.get(key)
        return entry is not None and (entry.due is None or now < entry.due)

    def get(self, key: Hashable, now: int) -> Any:
        entry = self.entries.get(key)
        if entry is not None and entry.due is not None and now >= entry.due:
            self.counts["expirations"] += 1
            self._remove(key, "EXPIRED")
            entry = None
        if entry is None:
            self.counts["misses"] += 1
            self.policy.on_miss(key)
            return None
        self.counts["hits"] += 1
        self.policy.on_access(key)
        if self.config.after_access:
            self._schedule(key, entry, now)
        return entry.value

    def put(self, key: Hashable, value: Any, now: int, ttl: int | None = None) -> None:
        if key is None or value is None:
            raise ValueError("keys and values can't be null")
        if ttl is not None and ttl <= 0:
            raise ValueError("a time to live must be positive")
        self.expire(now)
        w = self.config.weigher(key, value) if self.config.weigher else 1
        if w < 1:
            raise ValueError(f"a weight must be at least 1, got {w}")
        span = ttl if ttl is not None else self.config.after_write
        if span and ttl is None and self.config.jitter:
            span = max(1, int(span * (1 + self.config.jitter * (2 * self.rng.real() - 1))))
        entry = Entry(value, w, now + span if span else None)
        old = self.entries.get(key)
        if old is not None and w <= old.weight:  # updated in place: its history stays
            self.removed.append((key, old.value, "REPLACED"))
            self.weight += w - old.weight
            self.entries[key] = entry
            self.policy.on_access(key)
            self._schedule(key, entry, now)
            return
        if old is not None:
            self._remove(key, "REPLACED")
        if w > self.capacity:
            self.counts["rejections"] += 1
            return
        self.policy.before_insert(key)
        while self.weight + w > self.capacity:
            out = self.policy.victim()
            if out is None or not self.policy.admit(key, out):
                self.counts["rejections"] += 1
                return
            self.counts["evictions"] += 1
            self.policy.on_evict(out)
            self._remove(out, "SIZE")
        self.entries[key] = entry
        self.weight += w
        self.policy.on_insert(key)
        self._schedule(key, entry, now)

    def invalidate(self, key: Hashable) -> None:
        if key in self.entries:
            self._remove(key, "EXPLICIT")

    def clear(self) -> None:
        for key in list(self.entries):
            self._remove(key, "EXPLICIT")


def cache_counts(events: DataFrame) -> DataFrame:
    """(shard, hits, misses, evictions, rejections, expirations, size, weight) from the stats rows of ``run_operations``."""
    names = ("hits", "misses", "evictions", "rejections", "expirations", "size", "weight")
    facts = F.from_json("answer", ", ".join(f"{n} long" for n in names))
    return events.filter("op = 'stats'").select("shard", facts.alias("f")).select("shard", "f.*")


EVENT = "shard int, pos long, op string, key long, answer string, cause string"


def run_operations(operations: DataFrame, config: CacheConfig, counts: bool = False) -> DataFrame:
    """Answers and removals of operations (pos, now, op, key, value, ttl) on a cache.

    ``op`` is get, load (a get that stores ``value`` on a miss), put, invalidate, clear,
    clean (remove what is due) or contains. A clear or clean goes to all shards. Rows: the
    operation with its answer (cause null), and a row with op removal for each entry that it
    removed, with its value and cause. Each shard is one ordered fold; its capacity is an even
    part of the whole. With ``counts``, a last row of each shard with op stats has its counters
    as JSON: hits, misses, evictions, rejections, expirations, size and weight at the end.
    """
    n = config.shards
    own = [config.capacity // n + (i < config.capacity % n) for i in range(n)]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard, rows = int(key[0]), []
        cache = Cache(config, max(1, own[shard]))
        for r in frame.sort_values("pos").itertuples(index=False):
            k, now, value = None if pd.isna(r.key) else int(r.key), int(r.now), r.value
            ttl = None if pd.isna(r.ttl) else int(r.ttl)
            answer = None
            if r.op in ("get", "load"):
                answer = cache.get(k, now)
                if answer is None and r.op == "load" and value is not None:
                    cache.put(k, value, now, ttl)
            elif r.op == "put":
                cache.put(k, value, now, ttl)
            elif r.op == "invalidate":
                cache.invalidate(k)
            elif r.op == "clear":
                cache.clear()
            elif r.op == "clean":
                cache.expire(now)
            elif r.op == "contains":
                answer = str(cache.contains(k, now)).lower()
            else:
                raise ValueError(f"no operation {r.op}")
            rows.append((shard, r.pos, r.op, k, answer, None))
            rows += [(shard, r.pos, "removal", a, v, c) for a, v, c in cache.removed]
            cache.removed = []
        if counts:
            facts = {**cache.counts, "size": len(cache.entries), "weight": cache.weight}
            rows.append((shard, int(frame["pos"].max()) + 1, "stats", None, json.dumps(facts), None))
        return pd.DataFrame(rows, columns=["shard", "pos", "op", "key", "answer", "cause"]).astype({"key": "Int64"})

    to = F.when(F.col("op").isin("clear", "clean"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(shard_of(F.col("key"), n)))
    return operations.withColumn("shard", F.explode(to)).groupBy("shard").applyInPandas(run, EVENT)


def idle_expiry(requests: DataFrame, ttl: int) -> DataFrame:
    """Add hit to requests (key, pos, now): an unbounded cache whose entries expire ``ttl`` after their last use.

    A request at exactly the deadline misses, unlike in a session window.
    """
    gap = F.col("now") - F.lag("now").over(W.partitionBy("key").orderBy("now", "pos"))
    return requests.withColumn("hit", F.coalesce(gap < ttl, F.lit(False)))


def write_expiry(requests: DataFrame, ttl: int) -> DataFrame:
    """Add hit to requests (key, pos, now): entries expire ``ttl`` after they were loaded, whatever their use."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["now", "pos"])
        hits, due = [], None
        for now in frame["now"]:
            hits.append(due is not None and now < due)
            if not hits[-1]:
                due = now + ttl
        return frame.assign(hit=hits)

    names = ["key", "pos", "now"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select(names).schema)
    return requests.select(names).groupBy("key").applyInPandas(run, f"{schema}, hit boolean")


def alive(state: DataFrame, now: int) -> DataFrame:
    """Rows of state (expires_at) that are not due at ``now``."""
    return state.filter(F.col("expires_at").isNull() | (F.lit(now) < F.col("expires_at")))


def load_through(requests: DataFrame, cached: DataFrame, source: DataFrame, key: str = "key") -> DataFrame:
    """Each request's value: cached, else loaded once for each missing key; keys that no source has are left out.

    All three have ``key``; cached and source have value. Adds ``loaded``.
    """
    have = requests.join(cached.select(key, F.col("value").alias("_held")), key, "left")
    missing = have.filter("_held is null").select(key).distinct()
    got = source.join(missing, key, "left_semi").select(key, F.col("value").alias("_got"))
    out = have.join(got, key, "left").withColumn("value", F.coalesce("_held", "_got")).withColumn("loaded", F.col("_held").isNull())
    return out.filter("value is not null").drop("_held", "_got")


def invalidate_by_tag(entries: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Entries without the keys that the index (tag, key) has under ``tag``, stale ones too."""
    return entries.join(tags.filter(F.col("tag") == tag).select("key"), "key", "left_anti")


def keys_of_tag(entries: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return entries.join(tags.filter(F.col("tag") == tag).select("key"), "key", "left_semi")


def coalesce_writes(writes: DataFrame) -> DataFrame:
    """The last write (by seq) of each batch and key, as a write-behind buffer flushes them."""
    last = F.max_by(F.struct(*[c for c in writes.columns if c not in ("batch", "key")]), "seq")
    return writes.groupBy("batch", "key").agg(last.alias("w")).select("batch", "key", "w.*")


def merge(base: DataFrame, updates: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Base rows with the non-null ``columns`` of their update; updates of unknown keys change nothing.

    Of several updates of a key each column takes the last non-null value by ``order``. Without
    an order, updates of a key that contradict each other raise. A null key updates nothing.
    """

    def value(c: str) -> Column:
        if order:
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
        return F.when(F.min(c) != F.max(c), F.raise_error(F.lit(f"updates of a key differ in {c}; name their order"))).otherwise(F.max(c))

    new = updates.groupBy(key).agg(*(value(c).alias(f"_{c}") for c in columns))
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(base.columns)


def double_delete(updates: DataFrame, delay: int) -> DataFrame:
    """Two invalidations of each update (key, now): at once and ``delay`` later."""
    return updates.select("key", F.explode(F.array("now", F.col("now") + delay)).alias("now")).withColumn("op", F.lit("invalidate"))


def hot_swap(trace: DataFrame, changes: DataFrame) -> DataFrame:
    """Add ``segment`` to a trace (pos, key): the number of configuration changes (pos) before; each segment starts empty."""
    numbered = with_rank(changes.select("pos"), [F.col("pos")], "segment").withColumn("segment", F.col("segment") + 1)
    return asof(trace, numbered, "pos", "segment").withColumn("segment", F.coalesce("segment", F.lit(0)))
