"""Request traces in text, results in CSV, node lists in TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.order import with_rank

RESULTS = T.StructType([
    T.StructField("workload", T.StringType()), T.StructField("workload_params", T.StringType()), T.StructField("key_space", T.IntegerType()), T.StructField("capacity", T.IntegerType()),
    T.StructField("seed", T.LongType()), T.StructField("policy", T.StringType()), T.StructField("hits", T.LongType()), T.StructField("misses", T.LongType()), T.StructField("hit_rate", T.DoubleType()),
])


def significant(line: Column) -> Column:
    """Neither blank nor a comment."""
    return (F.trim(line) != "") & ~F.trim(line).startswith("#")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): trimmed significant lines in the order of files and of lines in them.

    Splits are counted first; a line's place is its split's start plus its number there. The
    driver sees one row for each split.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").filter(significant(F.col("value")))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("file_path", "file_block_start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    starts, before = [], 0
    for r in sorted(splits.collect(), key=lambda r: (r["file_path"], r["file_block_start"])):
        starts.append((r["file_path"], r["file_block_start"], before - r["first"]))
        before += r["n"]
    shifts = spark.createDataFrame(starts, "file_path string, file_block_start long, shift long")
    return lines.join(F.broadcast(shifts), ["file_path", "file_block_start"]).select((F.col("at") + F.col("shift")).alias("pos"), F.trim("value").alias("line"))


def integer_keys(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key) of a trace with an integer on each line; anything else raises."""
    return read_lines(spark, path).select("pos", F.col("line").cast("int").alias("key"))


def dense_ids(trace: DataFrame, key: str = "key") -> DataFrame:
    """(pos, id): keys numbered from 0 in the order of their first request."""
    first = trace.groupBy(key).agg(F.min("pos").alias("first_pos"))
    ids = with_rank(first, [F.col("first_pos")], "id").select(key, "id")
    return trace.join(ids, key).select("pos", "id")


def string_keys(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of a trace with a name on each line."""
    return dense_ids(read_lines(spark, path).withColumnRenamed("line", "key"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RESULTS) -> DataFrame:
    """CSV with a header; quotes are doubled inside quotes, and a quoted cell may hold commas and line ends."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)


def write_results(results: DataFrame, path: str) -> None:
    """The result table as CSV, hit rates with six decimals, parameters quoted."""
    out = results.withColumn("hit_rate", F.format_string("%.6f", "hit_rate"))
    out.select(RESULTS.fieldNames()).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def parse_nodes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, host, port, healthy) of a tab-separated node list; blank lines and rows without four fields are left out."""
    part = F.split(F.col(column), "\t")
    rows = lines.filter((F.trim(column) != "") & (F.size(part) == 4))
    return rows.select(part[0].alias("id"), part[1].alias("host"), part[2].cast("int").alias("port"), (F.lower(part[3]) == "true").alias("healthy"))
