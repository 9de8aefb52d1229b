"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch


def components(links: DataFrame, scratch: Scratch, most: int = 100) -> DataFrame:
    """(doc_id, component) for each end of the links (a, b); component is the smallest id reachable.

    Every round each node takes the least label of itself, its neighbours and its label's
    label; labels are minima, so partial aggregation keeps a hub's links out of one task.
    Stars, as pivots make them, end after two or three rounds.
    """
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    table = scratch.table(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    for _ in range(most):
        label = table.select("doc_id", "component")
        seen = both.join(label.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("component").alias("near"))
        step = label.join(seen, "doc_id").select("doc_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = label.select(F.col("doc_id").alias("component"), F.col("component").alias("above"))
        old, table = table, scratch.table(step.join(up, "component", "left").select("doc_id", "old", F.least("component", "above").alias("component")))
        scratch.drop(old)
        if table.filter("component <> old").isEmpty():
            break
    else:
        raise RuntimeError("labels did not settle")
    scratch.drop(both)
    return table.select("doc_id", "component")
