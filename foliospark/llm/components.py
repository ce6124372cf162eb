"""Connected components by hooking, pointer jumping and edge contraction, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import scratch, stored


def _flatten(parents: DataFrame) -> DataFrame:
    """Follow parents to their roots; each pass halves every path."""
    while True:
        up = parents.select(F.col("node").alias("mid"), F.col("parent").alias("top"))
        moved = stored(
            parents.join(up, F.col("parent") == F.col("mid"), "left").select(
                "node",
                F.coalesce("top", "parent").alias("parent"),
                (F.coalesce("top", "parent") != F.col("parent")).alias("changed"),
            ),
            "parents",
        )
        parents = moved.select("node", "parent")
        if moved.filter("changed").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b).

    Nodes are longs; null ends are not edges, loops and repeats do no harm, no edges give no rows.
    Each round a node hooks onto its smallest neighbour, paths are flattened and the edges are
    rewritten onto the roots, so that only edges between different roots go on. All
    aggregates combine in the map tasks and every join reads written tables, so a node with very
    many edges is neither gathered nor pinned to one task.
    """
    with scratch(edges.sparkSession) as block:
        edges = stored(edges.selectExpr("cast(a as bigint) as a", "cast(b as bigint) as b").filter("a <> b").distinct(), "edges")
        labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
        while not edges.isEmpty():
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hooked = stored(
                both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("parent")),
                "hooked",
            )
            roots = _flatten(hooked)
            labels = stored(
                labels.join(roots.withColumnRenamed("node", "root"), F.col("component") == F.col("root"), "left").select(
                    "node", F.coalesce("parent", "component").alias("component")
                ),
                "labels",
            )
            left = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
            right = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
            half = stored(edges.join(left, "a").select("ra", "b"), "half-edges")
            edges = stored(
                half.join(right, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
                "edges",
            )
        return block.keep(labels)
