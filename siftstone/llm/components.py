"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the smallest node that it is linked with, over any number of links.

    Each round every node takes the smallest label among its neighbours and then its label's label, so that chains halve; the
    rounds end when no label changes. All of it are joins and aggregates; each round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    total = _total(labels)
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        # a label is a node of the same component, so its own label is as good or better
        own = labels.join(offered, "node").select("node", F.least("component", "offer").alias("component"))
        further = own.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = stored(own.join(further, "component", "left").select("node", F.least("component", "next").alias("component")), "labels")
        before, total = total, _total(labels)
        if total == before:
            return labels


def _total(labels):
    """Falls whenever a label changes."""
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
