"""Connected components of a graph kept in tables, by hooking and pointer jumping.

Every round is a fixed number of joins and grouped minima over edge and label
tables; the number of rounds grows with the logarithm of the longest path.
Nothing is gathered: a hub's edges are only ever reduced by a minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """id, component (the smallest id reachable), for the ids that have an edge.

    ``edges`` has the columns a and b, any order, repeats and loops allowed, no nulls.
    """
    both = edges.select("a", "b").where("a <> b")
    both = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), f"{tag}-labels-0")
    step = 0
    while True:
        step += 1
        # The least label among the neighbours, offered to the node and to the root it hangs on.
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        offers = labels.join(seen, labels["id"] == seen["a"]).select("id", "component", F.least("component", "near").alias("best"))
        hooks = offers.groupBy("component").agg(F.min("best").alias("best")).select(F.col("component").alias("id"), F.col("best").alias("hook"))
        hung = offers.select("id", "best").join(hooks, "id", "left").select("id", F.least("best", F.coalesce("hook", "best")).alias("parent"))
        hung = scratch.save(hung, f"{tag}-hung-{step}")
        up = hung.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        jumped = hung.join(up, "parent", "left").select("id", F.coalesce("grand", "parent").alias("component"))
        new = scratch.save(jumped, f"{tag}-labels-{step}")
        changed = new.join(labels.select("id", F.col("component").alias("was")), "id").where("component <> was").limit(1).count()
        scratch.drop(f"{tag}-hung-{step}")
        scratch.drop(f"{tag}-labels-{step - 1}")
        labels = new
        if not changed:
            return labels
