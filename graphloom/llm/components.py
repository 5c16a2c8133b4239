"""Connected components of an edge table, by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, settled


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node reachable.

    Each round gives every edge the labels of its ends (edges have few ends in common, so these joins
    are even), hooks the larger label of a differing pair under the smallest one seen, and follows the
    hooks to their ends. Labels at least halve per round. A label may come to hold most of the nodes:
    its rows are joined by join_skewed. Rounds end when no edge has differing labels. Edges with a null
    end and loops count for nothing; no edges give no rows.
    """
    edges = settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    # The first round needs no joins: each node is its own label.
    pairs = edges.select(F.col("a").alias("low"), F.col("b").alias("high"))
    while True:
        hooks = settled(pairs.groupBy(F.col("high").alias("label")).agg(F.min("low").alias("up")))
        if hooks.isEmpty():
            return labels.select("node", F.col("label").alias("root"))
        hooks = _flat(hooks)
        counted = labels.groupBy("label").agg(F.count("*").alias("n"))
        total = labels.count()
        moved = join_skewed(labels, counted.join(hooks, "label", "left"), "label", "n", total)
        labels = settled(moved.select("node", F.coalesce("up", "label").alias("label")))
        ends = edges.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
        pairs = ends.where("la <> lb").select(F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high")).distinct()


def _flat(hooks: DataFrame) -> DataFrame:
    """Hooks that all lead to labels without a hook: up becomes up of up until nothing changes."""
    while True:
        n = hooks.groupBy(F.col("up")).agg(F.count("*").alias("n"))
        next_up = settled(n.join(hooks.select(F.col("label").alias("up"), F.col("up").alias("top")), "up", "left"))
        if next_up.where("top is not null").isEmpty():
            return hooks
        moved = join_skewed(hooks, next_up, "up", "n", hooks.count())
        hooks = settled(moved.select("label", F.coalesce("top", "up").alias("up")))
