"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.work import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the undirected edges (a, b); the root is the least vertex reachable.

    Each round every vertex takes the least label among its neighbours' and its
    own, then the label of that label, so paths shorten by doubling.  Labels
    only fall: rounds end when their sum stays.  Each round is written, and
    only the sum reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = written(both, "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root"))
    labels = written(labels, "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        offers = both.join(labels.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "root")
        least = offers.union(labels.select("v", "root")).groupBy("v").agg(F.min("root").alias("root"))
        step = labels.select(F.col("v").alias("root"), F.col("root").alias("next"))
        labels = written(least.join(step, "root").select("v", F.col("next").alias("root")), "labels")
