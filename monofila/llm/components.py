"""Connected components of links between documents, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from monofila.llm.common import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Each round every node takes the smallest label among its own and its neighbours', then
    the label of its label, so long chains shorten by half. Rounds are written, not kept.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = scratch(both.repartition("a"), "links")
    labels = scratch(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("next"))
        moved = lower.join(jump, "new").select("node", "old", F.least("new", "next").alias("component"))
        changes = Observation()
        labels = scratch(moved.observe(changes, F.count(F.when(F.col("component") != F.col("old"), 1)).alias("n")), "labels").select("node", "component")
        if not changes.get["n"]:
            return labels
