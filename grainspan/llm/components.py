"""Connected components by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its smallest reachable node) for every node of ``edges`` (a, b).

    Each round takes the smallest label among neighbours, then the label of that label, so the number of
    rounds grows with the logarithm of a component's width. A round's labels are written to the shared folder,
    the ones before are removed; no rows come to the driver but a count.
    """
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        lower = scratch.save(lower)
        up = lower.select(F.col("node").alias("mid"), F.col("component").alias("top"))
        new = scratch.save(
            lower.join(up, lower.component == up.mid, "left").select("node", "was", F.coalesce(F.least("component", "top"), "component").alias("component"))
        )
        changed = not new.filter("component <> was").isEmpty()
        scratch.drop(lower)
        scratch.drop(labels)
        labels = new.select("node", "component")
        labels.scratch_path = new.scratch_path
        if not changed:
            scratch.drop(both)
            return labels
