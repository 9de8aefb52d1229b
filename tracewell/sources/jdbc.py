"""Tables behind JDBC: point reads with the filter pushed down, batched inserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A table; with ``key`` and ``bounds`` read in ranges of the key, in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def find(spark: SparkSession, url: str, table: str, key: str, value: int) -> DataFrame:
    """The rows with a key; the database filters."""
    return read_table(spark, url, table).filter(F.col(key) == value)


def insert(rows: DataFrame, url: str, table: str, batch: int = 1000, mode: str = "append", columns: Sequence[str] | None = None) -> None:
    """Insert in batches, one transaction for each partition."""
    (rows.select(*columns) if columns else rows).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).option("isolationLevel", "READ_COMMITTED").mode(mode).save()
