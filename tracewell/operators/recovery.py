"""From logs and snapshots to the current state, with set operations instead of a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recover(records: DataFrame, now: int, snapshot: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(key, value) after replaying records (seq, op, ts_millis, key, value, ttl_millis) over a snapshot (key, value).

    A put stores its value, or removes the key if it has expired at ``now``; invalidate
    removes a key, clear removes all, the snapshot's too. Only what follows the last clear
    counts, and of each key only its last record; both are minima or maxima that aggregate
    before the shuffle. ``by`` names a column of records, and of the snapshot, that tells logs apart.
    """
    own = [by] if by else []
    last_clear = records.filter("op = 'clear'").groupBy(*own).agg(F.max("seq").alias("cleared"))
    if by:
        rows = records.filter("op <> 'clear'").join(last_clear, by, "left").filter("cleared is null or seq > cleared")
    else:
        cleared = last_clear.first()[0]
        rows = records.filter(F.lit(cleared).isNull() | (F.col("seq") > F.lit(cleared))).filter("op <> 'clear'") if cleared is not None else records.filter("op <> 'clear'")
    last = rows.groupBy(*own, "key").agg(F.max_by(F.struct("op", "value", "ts_millis", "ttl_millis"), "seq").alias("r")).select(*own, "key", "r.*")
    expired = F.coalesce((F.col("ttl_millis") >= 0) & (F.col("ts_millis") + F.col("ttl_millis") <= now), F.lit(False))
    last = last.withColumn("live", (F.col("op") == "put") & ~expired)
    out = last.filter("live").select(*own, "key", "value")
    if snapshot is None:
        return out
    base = snapshot.join(last.select(*own, "key"), [*own, "key"], "left_anti")
    if by:
        base = base.join(last_clear.select(by), by, "left_anti")
    elif cleared is not None:
        base = base.limit(0)
    return out.unionByName(base.select(*own, "key", "value"))


def compact(records: DataFrame, now: int, snapshot: DataFrame | None = None) -> DataFrame:
    """The snapshot that replaces a log and the snapshot before it. As snapshots have no time to live, what is live now stays."""
    return recover(records, now, snapshot)


class DurableStore:
    """An appendable table of records and snapshots in a folder: put, invalidate, clear, get, size, compact.

    Each call appends a Parquet file, so its order is the sequence number that it carries. A
    store that is opened on a folder goes on where the last one stopped: with the newest
    snapshot that was written whole, the log that follows it, and the next sequence number.
    Times to live are kept in the log as they were given, so they run on while it is closed.
    """

    SCHEMA = "seq long, op string, ts_millis long, key string, value string, ttl_millis long"

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 0):
        self.spark, self.path, self.every = spark, path, compact_every
        self._snapshot: DataFrame | None = None
        self.generation = self._newest()
        if self.generation:
            self._snapshot = spark.read.schema("key string, value string").parquet(f"{path}/snapshot={self.generation}")
        if self._exists(f"log={self.generation}"):
            held = self.records().agg(F.max("seq").alias("seq"), F.count("*").alias("n")).first()
            self.seq, self.since = held["seq"] or 0, held["n"]
        else:
            self.seq, self.since = 0, 0
            self._append([])

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _newest(self) -> int:
        """The number of the newest snapshot that is complete, or 0."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        found = [int(n[9:]) for n in names if n.startswith("snapshot=") and self._exists(f"{n}/_SUCCESS")]
        return max(found, default=0)

    def _log(self) -> str:
        return f"{self.path}/log={self.generation}"

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self._log())
        self.since += len(rows)
        if self.every and self.since >= self.every:
            self.compact(rows[-1][2])

    def _next(self) -> int:
        self.seq += 1
        return self.seq

    def put(self, key: str, value: str, ts: int, ttl: int | None = None) -> None:
        self._append([(self._next(), "put", ts, key, value, -1 if ttl is None else ttl)])

    def invalidate(self, key: str, ts: int) -> None:
        self._append([(self._next(), "invalidate", ts, key, None, None)])

    def clear(self, ts: int) -> None:
        self._append([(self._next(), "clear", ts, None, None, None)])

    def records(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self._log())

    def state(self, now: int) -> DataFrame:
        return recover(self.records(), now, self._snapshot)

    def get(self, key: str, now: int) -> str | None:
        row = self.state(now).filter(F.col("key") == key).first()
        return row["value"] if row else None

    def size(self, now: int) -> int:
        return self.state(now).count()

    def compact(self, now: int) -> None:
        """Write the live state as a snapshot and start an empty log."""
        target = f"{self.path}/snapshot={self.generation + 1}"
        self.state(now).write.mode("overwrite").parquet(target)
        self._snapshot = self.spark.read.schema("key string, value string").parquet(target)
        self.generation, self.since = self.generation + 1, 0
        self._append([])
