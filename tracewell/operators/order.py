"""Global order without a single task: ranks and as-of joins over range partitions.

Rows are dealt by ranges of the order; what a partition needs from those before it is one
number or one value, which the driver passes on. It sees a row for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.storage import work_dir


def _by_partition(values: dict[int, object], kind: str) -> Column:
    """A literal for each partition number, null for others."""
    if not values:
        return F.lit(None).cast(kind)
    pairs = [x for p, v in values.items() for x in (F.lit(p), F.lit(v).cast(kind))]
    return F.create_map(*pairs)[F.col("_p")]


def dealt_by_range(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in range partitions with their number ``_p``, written once: ranges are drawn from a sample that differs from run to run."""
    spark = df.sparkSession
    path = work_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(df.withColumn("_p", F.lit(0)).schema).parquet(path)


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the place of each row, from 0, in an order that should have no ties."""
    dealt = dealt_by_range(df, order)
    before, at = {}, 0
    for p, n in sorted(map(tuple, dealt.groupBy("_p").count().collect())):
        before[p], at = at, at + n
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return dealt.withColumn(name, (_by_partition(before, "long") + own - 1).cast("long")).drop("_p")


def asof(left: DataFrame, right: DataFrame, key: str, value: str, forward: bool = False) -> DataFrame:
    """Left rows with ``value`` of the right row with the largest key that is not larger, or null.

    ``forward`` takes the smallest key that is not smaller. Both sides have ``key``; right keys are distinct.
    """
    kind = right.schema[value].dataType
    mine = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_k"), F.lit(None).cast(kind).alias("_v"))
    marks = right.select(F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(value).alias("_v"))
    direction = F.col("_k").desc() if forward else F.col("_k").asc()
    dealt = dealt_by_range(mine.unionByName(marks), [direction])
    latest = dealt.filter("_v is not null").groupBy("_p").agg(F.min_by("_v", "_k").alias("v") if forward else F.max_by("_v", "_k").alias("v"))
    ends = dict(map(tuple, latest.collect()))
    carried, last = {}, None
    for p in range(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))):
        if last is not None:
            carried[p] = last
        last = ends.get(p, last)
    own = F.last("_v", ignorenulls=True).over(W.partitionBy("_p").orderBy(direction, F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    out = dealt.withColumn("_own", own).filter("_row is not null").withColumn("_found", F.coalesce("_own", _by_partition(carried, kind.simpleString())))
    return out.select("_row.*", F.col("_found").alias(value))
