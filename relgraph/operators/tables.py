"""Node and edge tables: keyed upserts, distinct edges, counts, key checks.

nodes: ``node_id, labels array, key, props map``; edges: ``src, dst, type, props map``.
A node id is its label and key, an edge is known by ``(src, type, dst)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.functions.roster import or_blank
from relgraph.functions.scores import polarity_edge
from relgraph.operators.mentions import pair_rows

# What the statistics report lists.
NODE_LABELS = ["Member", "Party", "Region", "School"]
EDGE_TYPES = [
    "BELONGS_TO",
    "REPRESENTS",
    "SAME_PARTY",
    "SAME_REGION",
    "SAME_TERM",
    "GRADUATED_FROM",
    "SAME_SCHOOL",
]


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(label + ":"), key)


def region_id(kind: str, name: Column) -> Column:
    """Districts and sidos of one name stay two nodes."""
    return F.concat(F.lit(f"Region:{kind}:"), name)


def nodes(df: DataFrame, labels: list[str], ident: Column, key: Column, props: dict[str, Column]) -> DataFrame:
    """Rows of the node table; null properties are left out of the map."""
    return df.select(
        ident.alias("node_id"),
        F.array(*map(F.lit, labels)).alias("labels"),
        key.alias("key"),
        props_map(props).alias("props"),
    )


def props_map(props: dict[str, Column]) -> Column:
    if not props:
        return F.create_map().cast("map<string,string>")
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in props.items()]
    set_ones = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    return F.map_from_entries(set_ones)


def edges(df: DataFrame, src: Column, dst: Column, etype: Column | str, props: dict[str, Column] | None = None) -> DataFrame:
    kind = F.lit(etype) if isinstance(etype, str) else etype
    return df.select(
        src.alias("src"), dst.alias("dst"), kind.alias("type"), props_map(props or {}).alias("props")
    )


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed upsert: the row with the highest order replaces the whole earlier row.

    The maximum is combined per task before the shuffle, so a key with very many
    versions sends one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "row.*")


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`latest_rows` over a stored table and a batch; the batch comes later."""
    kind = updates.schema[order].dataType
    old = existing.withColumn("_age", F.lit(0)).withColumn(order, F.lit(None).cast(kind))
    new = updates.withColumn("_age", F.lit(1))
    return latest_rows(old.unionByName(new), keys, ["_age", order]).drop("_age", order)


def distinct_edges(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["src", "dst", "type"])


def with_endpoints(candidates: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Keep edge candidates whose both ends exist as nodes."""
    return candidates.join(
        sources.select(F.col("node_id").alias("src")), "src", "left_semi"
    ).join(targets.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def label_counts(node_table: DataFrame, labels: list[str] = NODE_LABELS) -> DataFrame:
    counts = node_table.select(F.explode("labels").alias("name")).groupBy("name").agg(
        F.count("*").alias("n")
    )
    return _listed(counts, labels)


def edge_counts(edge_table: DataFrame, related: DataFrame | None = None, types: list[str] = EDGE_TYPES) -> DataFrame:
    """Counts of the listed edge types.

    ``related(etype, id, n)`` supplies the group relations, which are counted
    without being listed.
    """
    counts = edge_table.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))
    if related is not None:
        groups = related.groupBy(F.col("etype").alias("name")).agg(F.sum("n").alias("n"))
        counts = counts.unionByName(groups).groupBy("name").agg(F.sum("n").alias("n"))
    return _listed(counts, types)


def _listed(counts: DataFrame, names: list[str]) -> DataFrame:
    listed = counts.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return listed.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def statistics(node_table: DataFrame, edge_table: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """``(kind, name, n)`` for all listed labels and edge types."""
    return (
        label_counts(node_table)
        .select(F.lit("node").alias("kind"), "name", "n")
        .unionByName(
            edge_counts(edge_table, related).select(F.lit("edge").alias("kind"), "name", "n")
        )
    )


def sentiment_edges(scored: DataFrame, existing: DataFrame | None = None, mode: str = "literal") -> DataFrame:
    """Accumulated polarity edges ``(name1, name2, type, count, via_article, seq)``.

    ``scored`` holds ``url, politicians (sorted), sentiment_label, ordinal``.
    ``literal`` counts every processing of an article, ``idempotent`` each URL once
    per pair and type. ``via_article`` is the article with the highest ordinal.
    """
    typed = scored.withColumn("type", polarity_edge(F.col("sentiment_label"))).where(
        F.col("type").isNotNull() & (F.size("politicians") >= 2)
    )
    # one row per name set, type and article before pairs are made
    folded = typed.groupBy("politicians", "type", "url").agg(
        F.count("*").alias("n"), F.max("ordinal").alias("ordinal")
    )
    paired = pair_rows(folded, "politicians", ["type", "url", "n", "ordinal"])
    if mode == "idempotent":
        paired = (
            paired.groupBy("name1", "name2", "type", "url")
            .agg(F.max("ordinal").alias("ordinal"))
            .withColumn("n", F.lit(1).cast("long"))
        )
    elif mode != "literal":
        raise ValueError(f"unknown mode {mode!r}")
    delta = paired.select(
        "name1", "name2", "type", F.col("n").alias("count"), F.col("url").alias("via_article"),
        F.col("ordinal").alias("seq"),
    )
    if existing is not None:
        delta = delta.unionByName(existing.select(*delta.columns))
    return merge_counts(delta)


def merge_counts(deltas: DataFrame) -> DataFrame:
    """Sum counts per edge and keep the latest article."""
    return deltas.groupBy("name1", "name2", "type").agg(
        F.sum("count").alias("count"),
        F.max_by("via_article", F.struct("seq", "via_article")).alias("via_article"),
        F.max("seq").alias("seq"),
    )


def filled(columns: list[str]) -> list[Column]:
    """Named text columns with absent values as ``''``."""
    return [or_blank(F.col(c)).alias(c) for c in columns]
