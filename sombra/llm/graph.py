"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (a, b) reaches.

    Smallest-neighbour labels with pointer jumping; each round is written to
    shared storage, and the loop ends when a round changes no label.  A node of
    any degree is one label row joined to its edges, pre-aggregated per task."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy("a").agg(F.min("root").alias("m")))
        step = (labels.join(near, labels["node"] == near["a"])
                .select("node", F.least("root", "m").alias("to"), F.col("root").alias("old")))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("far"))
        new = materialise(step.join(jump, "to", "left")
                          .select("node", F.coalesce("far", "to").alias("root"), "old"), "labels")
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
