"""Dependency graphs as edge tables: closure, levels and affected nodes, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import fresh_dir, settled


def closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(src, dst) of every pair with a path of one edge or more, each once; cycles are fine.

    Only new paths are joined, each round with all known ones, so paths double in length: a path of n edges
    takes log2(n) rounds and each pair is made from the round's new pairs alone.
    """
    edge = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    paths = fresh = settled(edge)
    for _ in range(most_rounds):
        onward = paths.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
        before = paths.select("src", F.col("dst").alias("via"))
        longer = fresh.join(onward, "dst").select("src", F.col("end").alias("dst"))
        longer = longer.unionByName(before.join(fresh.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst"))
        fresh = settled(longer.distinct().join(paths, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return paths
        paths = settled(paths.unionByName(fresh))
    raise ValueError(f"paths of over 2**{most_rounds} edges")


def levels(edges: DataFrame, most_levels: int = 10_000) -> DataFrame:
    """(node, level) of an acyclic graph: 0 for nodes that need none, else one more than the highest they need.

    Nodes on a cycle, or that need one on it, have no level and give no row. Each round settles a level:
    nodes whose needs have all been met; what is left of the needs gets smaller with each. Levels are written
    in the shared folder, one part each. ValueError if nodes without unmet needs are left after most_levels.
    """
    spark = edges.sparkSession
    at = fresh_dir(spark, "levels")
    needs = settled(edges.select(F.col("src").alias("node"), F.col("dst").alias("need")).distinct())
    left = settled(needs.select(F.explode(F.array("node", "need")).alias("node")).distinct())
    for level in range(most_levels + 1):
        ready = settled(left.join(needs, "node", "left_anti"))
        if ready.isEmpty():
            break
        if level == most_levels:
            raise ValueError(f"over {most_levels} levels")
        ready.withColumn("level", F.lit(level)).write.mode("append").parquet(at)
        left = settled(left.join(ready, "node", "left_anti"))
        needs = settled(needs.join(ready.withColumnRenamed("node", "need"), "need", "left_anti").select("node", "need"))
    return spark.read.schema(f"node {dict(edges.dtypes)['src']}, level int").parquet(at) if level else left.limit(0).withColumn("level", F.lit(0))


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node) of everything that needs a changed node, directly or not, and the changed nodes."""
    paths = closure(edges)
    needing = paths.join(changed.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return needing.unionByName(changed.select("node")).distinct()


def commit_order(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, level, id) in the order in which a graph's nodes are committed: by level, then by id (an extension)."""
    return levels(edges).join(ids, "node").select("node", "level", "id").orderBy("level", "id")


def successors(lineage: DataFrame) -> DataFrame:
    """(origin, status, n_candidates) of entities that were changed: what they have become (an extension).

    lineage: source, target; one row per modified, merged or split entity, target null for a deleted one. An origin
    with one successor that lives on is unique, with several ambiguous (none is picked), with none missing.
    """
    changes = lineage.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    ended = changes.select(F.col("src").alias("dst")).distinct()
    alive = closure(changes).join(ended, "dst", "left_anti").groupBy(F.col("src").alias("origin")).agg(F.count("*").alias("n"))
    found = changes.select(F.col("src").alias("origin")).distinct().join(alive, "origin", "left").withColumn("n_candidates", F.coalesce("n", F.lit(0)))
    return found.select("origin", F.when(F.col("n_candidates") == 0, "missing").when(F.col("n_candidates") == 1, "unique").otherwise("ambiguous").alias("status"), "n_candidates")
