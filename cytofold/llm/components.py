"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.common import join_split, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the smallest node that can be reached.

    Each round takes the least label among neighbours (pre-aggregated before the
    shuffle), then jumps to the label's own label, which halves the distance left;
    the tables stay distributed throughout. Nodes with many links, and labels that
    many nodes have, are broadcast to those they meet.
    """
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"), F.count("*").alias("n"))
    labels = materialise(labels.select("node", F.least("node", "near").alias("comp"), "n"), "labels")
    while True:
        near = join_split(edges, labels.withColumnRenamed("node", "b"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = materialise(labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("low"), F.col("n").alias("links")), "lower")
        above = lower.groupBy("low").agg(F.count("*").alias("n")).join(labels.select(F.col("node").alias("low"), F.col("comp").alias("jump")), "low")
        moved = join_split(lower, materialise(above, "above"), ["low"]).select("node", F.least("low", "jump").alias("comp"), "was", F.col("links").alias("n"))
        moved = materialise(moved, "labels")
        if moved.where("comp <> was").isEmpty():
            return moved.select("node", "comp")
        labels = moved.select("node", "comp", "n")
