"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node reachable.

    Each round hooks every node to the smallest of its neighbourhood, follows
    that pointer twice, and replaces the graph by its image, without loops and
    repeats. Images of a component shrink to its smallest node in a number of
    rounds that grows with the logarithm of its diameter. Every round's tables are
    written to the shared folder, so lineage stays one round deep and a lost
    executor costs tasks, not rounds. Sums and minima are combined before they are
    shuffled, so a node with very many edges is no hot spot.
    """
    graph = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = stored(graph.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not graph.isEmpty():
        both = graph.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("near")))
        low = stored(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to")), "hooks")
        step = low.alias("x").join(low.alias("y"), F.col("x.to") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.to").alias("to"))
        step = stored(step, "jumps")
        label = stored(label.join(step.withColumnsRenamed({"node": "component"}), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        one, two = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        image = graph.join(one, "a").join(two, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        graph = stored(image.where("a <> b").distinct(), "edges")
    return label
