"""From collected articles to the stored table and the mention graph."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relgraph.functions import scores
from relgraph.functions.roster import run_date
from relgraph.operators import mentions, scoring, tables
from relgraph.operators.articles import dedupe_then_cap, usable_articles
from relgraph.operators.pages import article_text
from relgraph.plans.roster_graph import Graph
from relgraph.session import cut
from relgraph.sources.writers import folder_exists, save_articles


def collected(articles: DataFrame, cap: int, now: Column, sections: list[str] = ()) -> DataFrame:
    """Usable articles, one per URL, at most ``cap`` per section, the listed sections first."""
    return dedupe_then_cap(usable_articles(articles, now), cap, sections)


def with_body(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``content`` from fetched pages; an article without page has an empty one.

    Pages of other articles are dropped before any text is taken from them.
    """
    urls = articles.select("url").distinct()
    wanted = pages.select("url", "html").join(urls, "url", "left_semi")
    # a page fetched more than once gives the text that sorts last
    bodies = wanted.select("url", article_text(F.col("html")).alias("content")).groupBy("url").agg(F.max("content").alias("content"))
    return articles.join(bodies, "url", "left").withColumn("content", F.coalesce("content", F.lit("")))


def scored_articles(
    articles: DataFrame,
    names: DataFrame,
    now: Column,
    key: str = "url",
    load: Callable[[], scoring.Scorer] | None = None,
    positive: list[str] = scores.DEFAULT_POSITIVE,
    negative: list[str] = scores.DEFAULT_NEGATIVE,
    max_chars: int | None = None,
) -> DataFrame:
    """Articles with names, sentiment and run date."""
    named = mentions.match_names(articles, names, key, text="content")
    scored = scoring.score_articles(named, load, positive, negative, max_chars)
    return scored.withColumn("base_date", run_date(now))


def run(
    listed: DataFrame,
    pages: DataFrame,
    names: DataFrame,
    cap: int,
    now: datetime,
    table_path: str,
    graph_path: str,
    sections: list[str] = (),
    **scoring_options,
) -> DataFrame:
    """One news run: collect, read bodies, find names, score, store the table and the graph.

    ``listed(pos, url, section, title, press, date)`` are the articles in list
    order, ``pages(url, html)`` the fetched pages. The scored articles are written
    once and feed both stores.
    """
    stamp = F.to_timestamp(F.lit(now.strftime("%Y-%m-%d %H:%M:%S")))
    articles = cut(collected(listed, cap, stamp, sections), "collected")
    articles = with_body(articles, pages)
    scored = cut(scored_articles(articles, names, stamp, **scoring_options), "scored")
    scored = scored.withColumn("ordinal", F.col("pos"))
    save_articles(scored.sparkSession, scored, table_path, now, "ordinal")
    graph = mention_graph(scored)
    merge_graph(scored.sparkSession, graph, graph_path)
    return scored


GRAPH_BUCKETS = 256


def merge_graph(spark: SparkSession, new: Graph, path: str, buckets: int = GRAPH_BUCKETS) -> None:
    """Add a run's graph to the stored one.

    Nodes merge by id and take the newer properties, edges by their ends and type; counts
    add up, and the other properties are the newer ones. Nodes lie in folders by a hash of
    their id, edges by type and a hash of their source. A run reads and replaces only the
    folders that it has rows for, so adding a few articles costs the same however much is
    stored. ``buckets`` has to be the same for all runs on one path.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    nodes = cut(new.nodes.withColumn("bucket", at("node_id")), "new-nodes")
    edges = cut(new.edges.withColumn("bucket", at("src")), "new-edges")
    if folder_exists(spark, f"{path}/nodes"):
        # at most `buckets` numbers, and that for each type of edge
        mine = [r[0] for r in nodes.select("bucket").distinct().collect()]
        spots = [tuple(r) for r in edges.select("type", "bucket").distinct().collect()]
        old_nodes = spark.read.parquet(f"{path}/nodes").where(F.col("bucket").isin(mine)).select(*nodes.columns)
        stored = spark.read.parquet(f"{path}/edges")
        touched = F.lit(False)
        for kind in sorted({t for t, _ in spots}):
            touched |= (F.col("type") == kind) & F.col("bucket").isin([b for t, b in spots if t == kind])
        both = merged(Graph(old_nodes, stored.where(touched).select(*edges.columns)), Graph(nodes, edges))
        # staged first: the files that are read are the ones that are replaced
        nodes = cut(both.nodes.withColumn("bucket", at("node_id")), "merged-nodes")
        edges = cut(both.edges.withColumn("bucket", at("src")), "merged-edges")

    def put(rows: DataFrame, place: str, by: list[str]) -> None:
        writer = rows.repartition(*by).write.option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").partitionBy(*by).parquet(f"{path}/{place}")

    put(nodes, "nodes", ["bucket"])
    put(edges, "edges", ["type", "bucket"])


def merged(old: Graph, new: Graph) -> Graph:
    """Two graphs as one, see `merge_graph`."""

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumn("_age", F.lit(0)).unionByName(b.withColumn("_age", F.lit(1)))

    nodes = tables.latest_rows(both(old.nodes, new.nodes), ["node_id"], ["_age"]).drop("_age")
    keyed = both(old.edges, new.edges).groupBy("src", "dst", "type").agg(
        F.max_by("props", "_age").alias("props"), F.sum(F.col("props")["count"].cast("long")).alias("n")
    )
    rest = F.map_filter("props", lambda k, v: k != "count")
    counted = F.when(F.col("n").isNull(), F.col("props")).otherwise(
        F.map_concat(rest, F.create_map(F.lit("count"), F.col("n").cast("string")))
    )
    return Graph(nodes, keyed.withColumn("props", counted).select("src", "dst", "type", "props"))


def mention_graph(scored: DataFrame, mode: str = "literal") -> Graph:
    """Article and Politician nodes, mentions, pairs and counted polarity edges.

    Only articles with two or more names enter. ``scored`` needs an ``ordinal``.
    """
    entered = scored.where(F.size("politicians") >= 2)
    article_cols = ["title", "press", "date", "sentiment_label", "sentiment_score", "base_date"]
    latest = tables.latest_rows(entered.select("url", *article_cols, "ordinal"), ["url"], ["ordinal"])
    about = mentions.mention_edges(entered)
    together = mentions.together_edges(entered)
    feeling = tables.sentiment_edges(entered, mode=mode)

    def person(c: str) -> Column:
        return tables.node_id("Politician", F.col(c))

    nodes = tables.nodes(
        latest, ["Article"], tables.node_id("Article", F.col("url")), F.col("url"),
        {c: F.col(c) for c in ["url", *article_cols]},
    ).unionByName(
        tables.nodes(
            about.select("name").distinct(), ["Politician"], person("name"), F.col("name"),
            {"name": F.col("name")},
        )
    )
    edges = (
        tables.edges(about, tables.node_id("Article", F.col("url")), person("name"), "PUBLISHED_ABOUT")
        .unionByName(tables.edges(together, person("name1"), person("name2"), "MENTIONED_TOGETHER"))
        .unionByName(
            tables.edges(
                feeling, person("name1"), person("name2"), F.col("type"),
                {"count": F.col("count"), "via_article": F.col("via_article")},
            )
        )
    )
    return Graph(nodes, edges)
