"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes intermediate results as Parquet, which cuts their lineage.

    The tables go under ``spark.checkpoint.dir`` of the session. Only where that is unset
    and the master is this machine is a folder of it taken; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.gettempdir() + "/tracewell-scratch"
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[tuple[DataFrame, str]] = []  # a table and its path, so that neither outlives the other

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later step reads; a DataFrame that isn't one is an error."""
        for df in dfs:
            at = next((i for i, (own, _) in enumerate(self._tables) if own is df), None)
            if at is None:
                raise ValueError("not a table of this scratch folder")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._tables.pop(at)[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *dfs: DataFrame) -> None:
        """Delete all tables but these, which the result still reads."""
        self.drop(*(own for own, _ in list(self._tables) if not any(own is df for df in dfs)))
