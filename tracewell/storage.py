"""A folder for files that a query writes and reads back: under spark.checkpoint.dir where that is set."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir() + "/tracewell-work"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
