"""Connected components of a graph of links, by label propagation with pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b: bigint).

    Each round gives a node the least label among its own and its neighbours', then the label of its
    label. Labels are reduced on the map side and every joined side is a written table, so a node
    with very many links is split by adaptive execution. Rounds end when nothing changes.
    """
    both = scratch.table(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("a"), "component"), "a").select(F.col("b").alias("node"), "component", F.lit(None).cast("bigint").alias("before"))
        own = labels.select("node", "component", F.col("component").alias("before"))
        least = scratch.table(own.unionByName(told).groupBy("node").agg(F.min("component").alias("component"), F.max("before").alias("before")), "least")
        root = least.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = least.join(root, "component", "left").select("node", F.least(F.col("component"), F.coalesce("root", "component")).alias("component"), "before")
        jumped = scratch.table(jumped, "jumped")
        changed = jumped.where("component <> before").limit(1).count()
        scratch.drop(labels, least)
        labels = jumped
        if not changed:
            scratch.drop(both)
            return labels.select("node", "component")
