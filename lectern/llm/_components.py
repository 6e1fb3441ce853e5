"""Connected components of a graph of long ids, on Spark from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._spark import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every end of `edges` (a, b); component is the smallest reachable id.

    Each round takes the least label of a node and its neighbours, then jumps to
    that label's own label, so long chains shorten by more than half a round. The
    labels of every round are written, so a lost executor costs one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.keep(both, "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels0")
    turn = 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        target = labels.select(F.col("id").alias("to"), F.col("component").alias("far"))
        jumped = least.join(target, "to", "left").select("id", "old", F.least("to", F.coalesce("far", "to")).alias("component"))
        new = scratch.keep(jumped, f"labels{turn + 1}")
        changed = new.filter("old <> component").limit(1).count()
        labels = new.select("id", "component")
        scratch.forget(f"labels{turn}")
        turn += 1
        if not changed:
            scratch.forget("edges")
            return labels
