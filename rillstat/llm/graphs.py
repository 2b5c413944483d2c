"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstat.sinks.tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; ``root`` is the least node reachable.

    Each round takes the least label among the neighbours, then the label of that
    label, so labels travel twice as far each time. Rounds are written to the
    shared folder, which cuts the lineage and outlives an executor. All steps are
    joins and minima, so a node with very many links is combined before the
    shuffle or split by adaptive execution.
    """
    there = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = there.union(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).filter("node <> other")
    both = stored(both.distinct(), "links")
    labels = both.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("least"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "least").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        after = lower.join(jump, "via").select("node", F.least("via", "beyond").alias("root"), "before")
        after = stored(after, "labels")
        labels = after.select("node", "root")
        if after.filter("root <> before").isEmpty():
            return labels
