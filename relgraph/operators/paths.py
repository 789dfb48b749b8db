"""Paths between nodes: neighbourhood of a member, member-to-member paths, subgraphs.

A path uses each edge at most once and may visit a node again. Paths are listed
shortest first; equal lengths in the order of their edge texts, so a limit always
keeps the same ones. Group relations are not stored as edges (see
`relgraph.operators.groups`); their edges are made only for the nodes a path has
reached, each in both stored directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.operators.groups import edges_from
from relgraph.operators.search import first_match
from relgraph.session import cut
from relgraph.skew import salted_join

END_LABELS = ["Member", "Party", "Region", "School"]
BROADCAST_PATHS = 10_000
"""A frontier of paths is broadcast only when it was counted to hold at most this many."""


def path_key() -> Column:
    return F.array_join(
        F.transform("path_edges", lambda e: F.concat_ws("|", e["src"], e["type"], e["dst"])), ";"
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    """``(tip, next, edge)``: every edge from both of its ends, in one pass."""
    edge = F.struct("src", "type", "dst")
    there = F.struct(F.col("src").alias("tip"), F.col("dst").alias("next"))
    back = F.struct(F.col("dst").alias("tip"), F.col("src").alias("next"))
    ends = F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))
    return edges.select(edge.alias("edge"), F.explode(ends).alias("e")).select(
        "e.tip", "e.next", "edge"
    )


def _start(ids: DataFrame) -> DataFrame:
    return ids.select(
        F.col("node_id").alias("start"),
        F.col("node_id").alias("tip"),
        F.array("node_id").alias("path_nodes"),
        F.array().cast("array<struct<src:string,type:string,dst:string>>").alias("path_edges"),
    )


def _grow(frontier: DataFrame, edges: DataFrame, sets: DataFrame | None, small: bool) -> DataFrame:
    """All paths that are one unused edge longer."""
    steps = _both_ways(edges)
    if sets is not None:
        reached = frontier.select(F.col("tip").alias("id"))
        groups = edges_from(sets, F.broadcast(reached) if small else reached)
        one = F.struct("src", F.col("etype").alias("type"), "dst")
        other = F.struct(F.col("dst").alias("src"), F.col("etype").alias("type"), F.col("src").alias("dst"))
        steps = steps.unionByName(
            groups.select(
                F.col("src").alias("tip"),
                F.col("dst").alias("next"),
                F.explode(F.array(one, other)).alias("edge"),
            )
        )
    if small:
        met = steps.join(F.broadcast(frontier), "tip")
    else:
        # a node with very many edges is spread over tasks
        met = salted_join(frontier, steps, ["tip"], ["next"])
    return (
        met
        .where(~F.array_contains("path_edges", F.col("edge")))
        .select(
            "start",
            F.col("next").alias("tip"),
            F.concat("path_nodes", F.array("next")).alias("path_nodes"),
            F.concat("path_edges", F.array("edge")).alias("path_edges"),
        )
    )


def _end_ok(nodes: DataFrame, labels: list[str]) -> DataFrame:
    wanted = F.array(*map(F.lit, labels))
    return nodes.where(F.arrays_overlap("labels", wanted)).select(F.col("node_id").alias("tip"))


def neighbourhood(
    nodes: DataFrame,
    edges: DataFrame,
    start: DataFrame,
    depth: int = 2,
    limit: int | None = None,
    sets: DataFrame | None = None,
    labels: list[str] = END_LABELS,
) -> DataFrame:
    """``(depth, path_key, path_nodes, path_edges)``: all paths from ``start(node_id)``, or the ``limit`` first.

    With a limit the walk stops at the first length that fills the limit. While all end labels
    count, a next step is only taken from fewer than ``limit`` paths, so the
    frontier stays that small whatever the degree of the nodes behind it.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be between 1 and 5")
    ends = _end_ok(nodes, labels)
    wanted = F.array(*map(F.lit, labels))
    others_exist = not nodes.where(~F.arrays_overlap("labels", wanted)).isEmpty()
    frontier = cut(_start(start))
    found, kept = None, 0
    for step in range(1, depth + 1):
        small = frontier.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
        grown = _grow(frontier, edges, sets, small)
        if others_exist and step < depth:
            # inner nodes may carry any label, so all paths go on
            grown = cut(grown)
        hits = (
            grown.join(ends, "tip", "left_semi")
            .withColumn("depth", F.lit(step))
            .withColumn("path_key", path_key())
        )
        hits = cut(hits if limit is None else hits.orderBy("path_key").limit(limit - kept))
        found = hits if found is None else found.unionByName(hits)
        if limit is not None:
            kept += hits.count()
            if kept >= limit:
                break
        frontier = grown if others_exist else hits.select("start", "tip", "path_nodes", "path_edges")
    return found.select("depth", "path_key", "path_nodes", "path_edges").orderBy("depth", "path_key")


def named_neighbourhood(
    members: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    query: str,
    depth: int = 2,
    limit: int | None = None,
    sets: DataFrame | None = None,
) -> DataFrame:
    """Search, then `neighbourhood` of the first match; no match gives no path."""
    start = first_match(members, query).select(F.concat(F.lit("Member:"), "id").alias("node_id"))
    return neighbourhood(nodes, edges, start, depth, limit, sets)


def member_paths(
    nodes: DataFrame, edges: DataFrame, limit: int | None = None, sets: DataFrame | None = None
) -> DataFrame:
    """All paths of length 1 or 2 between any two members, or the first ``limit``.

    Paths are ordered by length, start and edge texts. A member that can start such
    a path starts at least one, so the ``limit`` smallest starts cover the result
    and only their paths are made.
    """
    spark = nodes.sparkSession
    members = nodes.where(F.array_contains("labels", "Member")).select("node_id")
    if limit is None:
        return _all_member_paths(members, edges, sets)
    is_member = members.withColumnRenamed("node_id", "next")
    steps = _both_ways(edges).select("tip", "next")
    to_member = steps.join(is_member, "next", "left_semi")
    linked = None
    if sets is not None:
        linked = _linked_ids(sets)

    def with_linked(ids: DataFrame) -> DataFrame:
        return ids if linked is None else ids.unionByName(linked)

    def first_starts(ids: DataFrame) -> list[str]:
        rows = ids.join(members, "node_id", "left_semi").distinct().orderBy("node_id").limit(limit)
        return [r[0] for r in rows.collect()]

    def listed(starts: list[str], length: int, room: int) -> tuple[DataFrame | None, int]:
        """Paths of the smallest starts first: a few starts with many paths may fill the room."""
        found, kept, taken = None, 0, 0
        while taken < len(starts) and kept < room:
            batch = starts[taken : taken + max(1, 3 * taken)]
            taken += len(batch)
            paths = _start(spark.createDataFrame([(s,) for s in batch], "node_id string"))
            for _ in range(length):
                small = paths.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
                paths = _grow(paths, edges, sets, small)
                if length > 1:
                    paths = cut(paths, "paths")
            hits = cut(
                paths.join(members.withColumnRenamed("node_id", "tip"), "tip", "left_semi")
                .withColumn("depth", F.lit(length))
                .withColumn("path_key", path_key())
                .orderBy("start", "path_key")
                .limit(room - kept),
                "paths",
            )
            kept += hits.count()
            found = hits if found is None else found.unionByName(hits)
        return found, kept

    direct = with_linked(to_member.select(F.col("tip").alias("node_id")))
    found, kept = listed(first_starts(direct), 1, limit)
    if kept < limit:
        # a middle node with two edges to members joins each of them to a member
        middles = with_edge_count(to_member).where(F.col("n") >= 2).select(F.col("tip").alias("next"))
        through = steps.join(middles, "next", "left_semi").select(F.col("tip").alias("node_id"))
        if linked is not None:
            beside = steps.join(linked.withColumnRenamed("node_id", "next"), "next", "left_semi")
            through = through.unionByName(beside.select(F.col("tip").alias("node_id")))
        longer, _ = listed(first_starts(with_linked(through)), 2, limit - kept)
        found = longer if found is None else found if longer is None else found.unionByName(longer)
    if found is None:
        found = _start(members.limit(0)).withColumns({"depth": F.lit(0), "path_key": F.lit("")})
    return found.select("start", "depth", "path_key", "path_nodes", "path_edges").orderBy(
        "depth", "start", "path_key"
    )


def _all_member_paths(members: DataFrame, edges: DataFrame, sets: DataFrame | None) -> DataFrame:
    ends = members.withColumnRenamed("node_id", "tip")
    paths, found = _start(members), None
    for length in (1, 2):
        paths = cut(_grow(paths, edges, sets, False), "paths")
        hits = paths.join(ends, "tip", "left_semi").withColumns({"depth": F.lit(length), "path_key": path_key()})
        found = hits if found is None else found.unionByName(hits)
    return found.select("start", "depth", "path_key", "path_nodes", "path_edges").orderBy("depth", "start", "path_key")


def with_edge_count(steps: DataFrame) -> DataFrame:
    return steps.groupBy("tip").agg(F.count("*").alias("n"))


def _linked_ids(sets: DataFrame) -> DataFrame:
    """Ids with at least one group relation."""
    held = sets.select("etype", F.col("id").alias("by"), F.explode("build").alias("key"))
    span = held.groupBy("etype", "key").agg(F.min("by").alias("lo"), F.max("by").alias("hi"))
    asked = sets.select("etype", "id", F.explode("probe").alias("key"))
    return (
        asked.join(span, ["etype", "key"])
        .where((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id")))
        .select(F.col("id").alias("node_id"))
        .distinct()
    )


def subgraph_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct nodes on the paths."""
    ids = paths.select(F.explode("path_nodes").alias("node_id")).distinct()
    return nodes.join(ids, "node_id", "left_semi")


def subgraph_edges(
    paths: DataFrame, edges: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Edges of the paths with their properties, once per path they lie on, or once when ``dedupe``."""
    listed = paths.select(F.explode("path_edges").alias("e")).select("e.src", "e.dst", "e.type")
    if dedupe:
        listed = listed.distinct()
    # edges made from groups have no stored row and no properties
    return listed.join(edges.select("src", "dst", "type", "props"), ["src", "dst", "type"], "left")


def subgraph_json(sub_nodes: DataFrame, sub_edges: DataFrame) -> DataFrame:
    """One row ``json`` with node and relationship lists.

    Meant for the result of a limited path search, which bounds both lists.
    """
    node = F.struct(F.col("node_id").alias("id"), "labels", F.col("props").alias("properties"))
    edge = F.struct(
        F.col("src").alias("start"), F.col("dst").alias("end"), "type", F.col("props").alias("properties")
    )
    parts = sub_nodes.select(F.lit("n").alias("kind"), F.to_json(node).alias("j")).unionByName(
        sub_edges.select(F.lit("e").alias("kind"), F.to_json(edge).alias("j"))
    )

    def listed(kind: str) -> Column:
        mine = F.collect_list(F.when(F.col("kind") == kind, F.col("j")))
        return F.array_join(F.array_sort(mine), ",")

    return parts.agg(
        F.concat(
            F.lit('{"nodes":['), listed("n"), F.lit('],"relationships":['), listed("e"), F.lit("]}")
        ).alias("json")
    )
