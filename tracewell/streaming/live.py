"""Streams of requests: tumbling ticks, keyed state with time to live, coalesced writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_requests(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """A file stream of requests; each Parquet file that arrives in ``folder`` is read once."""
    return spark.readStream.schema(schema).parquet(folder)


def ticks(requests: DataFrame, width: str = "100 milliseconds", late: str = "1 minute") -> DataFrame:
    """(tick, requests, keys, top value) for each tumbling window; rows later than ``late`` are dropped by the watermark of a stream."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    out = rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("requests"), F.approx_count_distinct("user_id").alias("keys"), F.max("value").alias("top_value"))
    return out.select(F.col("window.start").alias("tick"), "requests", "keys", "top_value")


def idle_state(requests: DataFrame, ttl_millis: int) -> DataFrame:
    """(user_id, event_id, hit): an entry for each key that expires ``ttl_millis`` after its last use, across batches.

    State is one time for each key, in the state store; a request at the deadline misses.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class LastUse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "millis long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
            frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            last = self.last.get()[0] if self.last.exists() else None
            hits = []
            for now in (frame["ts"].astype("int64") // (1_000_000 if frame["ts"].dtype == "datetime64[ns]" else 1_000)).tolist():
                hits.append(last is not None and now - last < ttl_millis)
                last = now
            self.last.update((last,))
            yield pd.DataFrame({"user_id": [key[0]] * len(frame), "event_id": frame["event_id"], "hit": hits})

        def close(self) -> None:
            pass

    return requests.select("user_id", "event_id", "ts").groupBy("user_id").transformWithStateInPandas(LastUse(), "user_id long, event_id long, hit boolean", outputMode="Append", timeMode="None")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there now to a Parquet folder, exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def write_behind(updates: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Flush the last update (by seq) of each key, batch by batch; a batch that is retried has the same number."""

    def last(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != "key"]
        flush(batch.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("w")).select("key", "w.*"), number)

    return updates.writeStream.foreachBatch(last).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
