"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relgraph.llm import native


def _toward_smallest(edges: DataFrame, larger: bool) -> DataFrame:
    """Large or small star: hang neighbours on the smallest of a node and its neighbours.

    The minimum is an aggregate with partial sums, and nodes with very many edges meet it in
    a join that adaptive execution may split; no node's edges are gathered in one place.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = ordered.unionByName(ordered.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else ordered
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(least, "a")
    hung = met.where(F.col("b") > F.col("a")) if larger else met
    moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable), one row per node that has an edge.

    edges: two columns of longs, in any order and number; loops are ignored. Lineage is cut in
    the checkpoint folder after each round; only a row count and a sum reach the driver.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    now, before = native.staged(now), None
    while True:
        seen = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if seen == before or not seen[0]:
            break
        before = seen
        now = native.staged(_toward_smallest(_toward_smallest(now, True), False))
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
