"""Documents as articles: names, sections, sentiment, storage, and model comparison.

Mapping: url = md5 of the text (so copies share it), section = source, pos = doc_id,
title = first line, content = text.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from relgraph.functions import roster, scores
from relgraph.operators import articles, mentions, scoring, tables
from relgraph.plans import news
from relgraph.session import cut, scratch_path
from relgraph.skew import spread
from relgraph.sources import writers
from relgraph.streaming import runs
from workload.base import page_text_sql, query, sql_list, table

NAMES = ["That", "This", "From", "With", "Eriner", "Anon", "Tion", "Nicht", "Eren", "License"]
GOOD = ["erst", "elle", "with", "License", "Eriner"]
BAD = ["nicht", "dans", "This", "entre", "heit"]
CAP = 30
NOW = datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc)
NOW_TEXT = "2024-01-15 12:00:00"


def _count_sql(words, text="content"):
    return " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words)


STARS = f"greatest(1, least(5, 3 + ({_count_sql(GOOD)}) - ({_count_sql(BAD)})))"
BASE = f"""
names(name) AS (SELECT unnest([{sql_list(NAMES)}])),
art AS (
  SELECT doc_id AS pos, md5(text) AS url, source AS section, text AS content,
         list_sort([n FOR n IN [{sql_list(NAMES)}] IF contains(text, n)]) AS politicians
  FROM documents),
scored AS (
  SELECT *,
    CASE WHEN len(politicians) >= 2 AND content <> '' THEN
      CASE WHEN {STARS} = 1 THEN '1 star' ELSE CAST({STARS} AS VARCHAR) || ' stars' END
      ELSE '' END AS sentiment_label,
    CASE WHEN len(politicians) >= 2 AND content <> '' THEN
      round((abs(({_count_sql(GOOD)}) - ({_count_sql(BAD)})) + 1)::DOUBLE
        / (({_count_sql(GOOD)}) + ({_count_sql(BAD)}) + 1), 6)
      ELSE 0.0 END AS sentiment_score
  FROM art),
mentioned AS (SELECT pos, url, sentiment_label, unnest(politicians) AS name, politicians FROM scored
              WHERE len(politicians) >= 2),
pairs AS (
  SELECT a.pos, a.url, a.sentiment_label, a.name AS name1, b.name AS name2
  FROM mentioned a JOIN mentioned b ON a.pos = b.pos AND a.name < b.name),
feel AS (
  SELECT *, CASE WHEN sentiment_label IN ('5 stars', '4 stars') THEN 'POSITIVE_SENTIMENT'
                 WHEN sentiment_label IN ('1 star', '2 stars') THEN 'NEGATIVE_SENTIMENT' END AS type
  FROM pairs)
"""


def article_table(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("pos"),
        F.md5("text").alias("url"),
        F.col("source").alias("section"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("press"),
        F.col("lang").alias("date"),
        F.col("text").alias("content"),
    )


def section_table(spark, sf_dir) -> DataFrame:
    return article_table(spark, sf_dir).select("pos", "url", "section")


def names_table(spark) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def scored_table(spark, sf_dir) -> DataFrame:
    """Articles with names and sentiment; the name list and word lists are parameters."""
    now = F.to_timestamp(F.lit(NOW_TEXT))
    scored = news.scored_articles(
        article_table(spark, sf_dir), names_table(spark), now, "pos", positive=GOOD, negative=BAD
    )
    return scored.withColumn("ordinal", F.col("pos"))


# --- names --------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT name1, name2, count(*) AS n_docs FROM pairs GROUP BY ALL")
def comention_pairs(spark, sf_dir):
    docs = mentions.match_names(table(spark, sf_dir, "documents"), names_table(spark), "doc_id")
    return mentions.co_mentions(docs).orderBy(F.desc("n_docs"), "name1", "name2")


@query(
    f"""WITH {BASE} SELECT DISTINCT url, name FROM mentioned"""
)
def article_politician_edges(spark, sf_dir):
    art = mentions.match_names(article_table(spark, sf_dir), names_table(spark), "pos", text="content")
    return mentions.mention_edges(art.where(F.size("politicians") >= 2))


WORD_COUNTS = """
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{4,7}')) AS name FROM benchmark)
SELECT name, count(*) AS n_docs FROM words JOIN documents ON contains(text, name) GROUP BY name
"""


def _word_counts(spark, sf_dir, match) -> DataFrame:
    """Documents per capitalised benchmark word; the dictionary grows with the table."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,7}"), F.lit(0))).alias("name")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match(docs, mentions.name_dictionary(words), "doc_id")
    return found.select(F.explode("politicians").alias("name")).groupBy("name").agg(
        F.count("*").alias("n_docs")
    )


@query(WORD_COUNTS)
def name_matches_large_dictionary(spark, sf_dir):
    return _word_counts(spark, sf_dir, mentions.match_names)


@query(WORD_COUNTS)
def name_matches_by_join(spark, sf_dir):
    """The path for a dictionary of any size."""
    return _word_counts(spark, sf_dir, mentions.match_names_by_grams)


@query(
    "WITH d AS (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment <> '') SELECT name FROM d"
)
def name_dictionary(spark, sf_dir):
    return mentions.name_dictionary(table(spark, sf_dir, "customer"), "c_mktsegment")


# --- sections ------------------------------------------------------------------------

# sections are ordered by name, null last
RANKED = """ranked AS (
  SELECT pos, url, section, dense_rank() OVER (ORDER BY section IS NULL, section) - 1 AS section_rank FROM art)"""
ROW = "section, pos, url"


@query(
    f"""WITH {BASE}, {RANKED} SELECT url, section, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY section_rank, pos) AS r FROM ranked) WHERE r = 1"""
)
def first_seen_articles(spark, sf_dir):
    ranked = articles.with_section_rank(section_table(spark, sf_dir))
    return articles.first_seen(ranked).select("url", "section", "pos")


@query(
    f"""WITH RECURSIVE {BASE}, {RANKED},
    own AS MATERIALIZED (SELECT section, section_rank, url, min(pos) AS pos FROM ranked GROUP BY ALL),
    step(r, kept, chosen) AS (
      SELECT -1::BIGINT, []::VARCHAR[], []::STRUCT(section VARCHAR, pos BIGINT, url VARCHAR)[]
      UNION ALL
      SELECT s.r + 1, list_concat(s.kept, n.urls), n.chosen FROM step s, LATERAL (
        SELECT coalesce(list(url), []) AS urls, coalesce(list({{section: section, pos: pos, url: url}}), []) AS chosen FROM (
          SELECT * FROM own WHERE section_rank = s.r + 1 AND NOT list_contains(s.kept, url) ORDER BY pos, url LIMIT {CAP})) n
      WHERE s.r < (SELECT max(section_rank) FROM own))
    SELECT c.section, c.pos, c.url FROM step, unnest(chosen) AS u(c)"""
)
def section_dedupe_cap(spark, sf_dir):
    """The ordered choice, one step per section."""
    return articles.dedupe_then_cap(section_table(spark, sf_dir), CAP).select("section", "pos", "url")


CAPPED = f"""own AS (SELECT section, section_rank, url, min(pos) AS pos FROM ranked GROUP BY ALL),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_rank ORDER BY pos) AS r FROM own)
           WHERE r <= {CAP}),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY section_rank, pos) AS f FROM capped)
         WHERE f = 1)"""


@query(f"WITH {BASE}, {RANKED}, {CAPPED} SELECT {ROW} FROM kept")
def section_cap_dedupe(spark, sf_dir):
    return articles.cap_then_dedupe(section_table(spark, sf_dir), CAP).select("section", "pos", "url")


@query(
    f"""WITH {BASE}, {RANKED}, {CAPPED}, listed(section) AS (SELECT section FROM kept UNION SELECT 'src99')
    SELECT l.section, count(k.url) AS n, CAST(count(k.url) < {CAP} AS INT) AS short
    FROM listed l LEFT JOIN kept k ON l.section IS NOT DISTINCT FROM k.section GROUP BY l.section"""
)
def section_shortfall(spark, sf_dir):
    kept = articles.cap_then_dedupe(section_table(spark, sf_dir), CAP)
    counts = articles.section_counts(kept, CAP, ["src99"])
    return counts.withColumn("short", F.col("short").cast("int"))


@query(
    f"""WITH {BASE} SELECT pos, url FROM art WHERE section <> 'src0'
        AND url NOT IN (SELECT url FROM art WHERE section = 'src0')"""
)
def unseen_articles(spark, sf_dir):
    art = section_table(spark, sf_dir)
    seen = art.where(F.col("section") == "src0")
    return articles.unseen(art.where(F.col("section") != "src0"), seen).select("pos", "url")


@query(
    """SELECT doc_id AS pos, md5(text) AS url, CASE WHEN lang = 'en' THEN '' ELSE source END AS press,
         CASE WHEN lang = 'de' THEN '2024-01-15' ELSE lang END AS date
       FROM documents WHERE lang <> 'fr' AND text <> ''"""
)
def usable_articles(spark, sf_dir):
    # absent parts: titles of French, the press of English, the date of German documents
    raw = article_table(spark, sf_dir).select(
        "pos",
        F.when(F.col("content") != "", F.col("url")).otherwise("").alias("url"),
        F.when(F.col("date") != "fr", F.col("title")).alias("title"),
        F.when(F.col("date") != "en", F.col("press")).alias("press"),
        F.when(F.col("date") != "de", F.col("date")).alias("date"),
    )
    return articles.usable_articles(raw, F.to_timestamp(F.lit(NOW_TEXT))).select("pos", "url", "press", "date")


# --- sentiment -----------------------------------------------------------------------


@query(
    f"""WITH {BASE} SELECT pos, array_to_string(politicians, ',') AS politicians, sentiment_label, sentiment_score
        FROM scored"""
)
def sentiment_scores(spark, sf_dir):
    return scored_table(spark, sf_dir).select(
        "pos",
        roster.joined(F.col("politicians")).alias("politicians"),
        "sentiment_label",
        F.round("sentiment_score", 6).alias("sentiment_score"),
    )


@query(f"WITH {BASE} SELECT pos, sentiment_label, sentiment_score FROM scored")
def plugged_in_scorer(spark, sf_dir):
    good, bad = GOOD, BAD

    def load():
        def model(texts):
            out = []
            for t in texts:
                p, n = sum(w in t for w in good), sum(w in t for w in bad)
                stars = max(1, min(5, 3 + p - n))
                out.append(("1 star" if stars == 1 else f"{stars} stars", (abs(p - n) + 1) / (p + n + 1)))
            return out

        return model

    named = mentions.match_names(article_table(spark, sf_dir), names_table(spark), "pos", text="content")
    return scoring.score_articles(named, load).select(
        "pos", "sentiment_label", F.round("sentiment_score", 6).alias("sentiment_score")
    )


@query("SELECT conv_id, turn, replace(text, 'that', 'this') AS mapped FROM conversations")
def mapped_text(spark, sf_dir):
    def load():
        def swap(texts):
            return [t.replace("that", "this") for t in texts]

        return swap

    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", scoring.mapped_text(F.col("text"), load).alias("mapped")
    )


@query(
    """SELECT doc_id, i AS window_no, md5(text[512 * i + 1:512 * i + 512]) AS window_md5
       FROM documents, unnest(range(0, greatest(1, (length(text) + 511) // 512))) AS u(i)"""
)
def model_input_windows(spark, sf_dir):
    """Every window of 512 characters that a model with that input limit is given, so whole texts."""
    windows = F.posexplode(roster.windows(F.col("text"), 512)).alias("window_no", "part")
    return table(spark, sf_dir, "documents").select("doc_id", windows).select("doc_id", "window_no", F.md5("part").alias("window_md5"))


@query("SELECT doc_id, md5(text[1:512]) AS window_md5 FROM documents")
def model_input_window(spark, sf_dir):
    # the first window, the model input of the inventory; `model_input_windows` has all of a text
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(roster.first_chars(F.col("text"), 512)).alias("window_md5")
    )


EDGE_COLUMNS = ["name1", "name2", "type", "count", "via_article", "seq"]
LITERAL = """SELECT name1, name2, type, count(*) AS count, arg_max(url, pos) AS via_article, max(pos) AS seq
             FROM feel WHERE type IS NOT NULL GROUP BY name1, name2, type"""


@query(f"WITH {BASE} {LITERAL}")
def sentiment_edges(spark, sf_dir):
    return tables.sentiment_edges(scored_table(spark, sf_dir))


@query(
    f"""WITH {BASE}, once AS (SELECT name1, name2, type, url, max(pos) AS pos FROM feel WHERE type IS NOT NULL GROUP BY ALL)
    SELECT name1, name2, type, count(*) AS count, arg_max(url, pos) AS via_article, max(pos) AS seq
    FROM once GROUP BY name1, name2, type"""
)
def sentiment_edges_idempotent(spark, sf_dir):
    return tables.sentiment_edges(scored_table(spark, sf_dir), mode="idempotent")


@query(f"WITH {BASE} {LITERAL}")
def sentiment_edges_accumulated(spark, sf_dir):
    """Two runs, one per half of the languages, add up to the whole."""
    scored = scored_table(spark, sf_dir)
    first = tables.sentiment_edges(scored.where(F.col("date").isin("en", "de")))
    return tables.sentiment_edges(scored.where(~F.col("date").isin("en", "de")), first)


@query(f"WITH {BASE} SELECT DISTINCT name1, name2 FROM pairs")
def together_edges(spark, sf_dir):
    return mentions.together_edges(scored_table(spark, sf_dir))


@query(
    f"""WITH {BASE}
    SELECT 'node' AS kind, 'Article' AS name, count(DISTINCT url) AS n FROM mentioned
    UNION ALL SELECT 'node', 'Politician', count(DISTINCT name) FROM mentioned
    UNION ALL SELECT 'edge', 'PUBLISHED_ABOUT', count(*) FROM (SELECT DISTINCT url, name FROM mentioned)
    UNION ALL SELECT 'edge', 'MENTIONED_TOGETHER', count(*) FROM (SELECT DISTINCT name1, name2 FROM pairs)
    UNION ALL SELECT 'edge', type, count(*) FROM (SELECT DISTINCT name1, name2, type FROM feel WHERE type IS NOT NULL)
      GROUP BY type"""
)
def mention_graph(spark, sf_dir):
    # all parts of the graph read the scored rows, which are worked out once
    graph = news.mention_graph(cut(scored_table(spark, sf_dir).drop("content"), "scored"))
    nodes = graph.nodes.groupBy(F.col("labels")[0].alias("name")).agg(F.count("*").alias("n"))
    edges = graph.edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))
    return nodes.select(F.lit("node").alias("kind"), "name", "n").unionByName(
        edges.select(F.lit("edge").alias("kind"), "name", "n")
    )


@query(
    f"""WITH {BASE}, newest AS (SELECT url, max(pos) AS pos FROM scored WHERE len(politicians) >= 2 GROUP BY url)
    SELECT 'Article:' || n.url AS node_id, s.sentiment_label, s.section AS press
    FROM newest n JOIN scored s ON s.pos = n.pos"""
)
def article_nodes(spark, sf_dir):
    nodes = news.mention_graph(scored_table(spark, sf_dir)).nodes
    return nodes.where(F.array_contains("labels", "Article")).select(
        "node_id", F.col("props")["sentiment_label"].alias("sentiment_label"), F.col("props")["press"].alias("press")
    )


@query(
    f"""WITH {BASE}, each AS (
      SELECT name1, name2, type, pos % 2 AS run, count(*) AS n, arg_max(url, pos) AS via FROM feel WHERE type IS NOT NULL GROUP BY ALL)
    SELECT 'Politician:' || name1 AS src, 'Politician:' || name2 AS dst, type, sum(n)::BIGINT AS count, arg_max(via, run) AS via_article
    FROM each GROUP BY name1, name2, type"""
)
def merged_graph_edges(spark, sf_dir):
    """Counted edges and their properties after two runs, one for each half of the articles."""
    scored = cut(scored_table(spark, sf_dir).drop("content"), "scored")
    path = scratch_path(spark, "merged-graph")
    for half in (0, 1):
        news.merge_graph(spark, news.mention_graph(scored.where(F.col("pos") % 2 == half)), path)
    counted = spark.read.parquet(f"{path}/edges").where(F.col("props")["count"].isNotNull())
    props = (F.col("props")["count"].cast("long").alias("count"), F.col("props")["via_article"].alias("via_article"))
    return counted.select("src", "dst", "type", *props)


@query(f"WITH {BASE} {LITERAL}")
def stream_edge_counts(spark, sf_dir):
    """The stream over the documents, six files in six micro-batches, ends in the same edges as the batch."""
    source = table(spark, sf_dir, "documents")
    files = scratch_path(spark, "document-files")
    source.repartition(6).write.parquet(files)
    docs = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(files)
    named = docs.select(
        F.col("doc_id").alias("ordinal"),
        F.md5("text").alias("url"),
        F.col("text").alias("content"),
        mentions.names_contained(F.col("text"), NAMES).alias("politicians"),
    )
    scored = scoring.score_articles(named, positive=GOOD, negative=BAD)
    out = scratch_path(spark, "edge-counts")
    runs.start_edge_counts(scored, out, scratch_path(spark, "edge-counts-progress"), fold=2).awaitTermination()
    return runs.edge_counts(spark, out)


@query(
    f"""WITH bodies AS ({page_text_sql()}),
    art AS (SELECT p.page_id, p.url, regexp_extract(p.url, '^https?://[^/]+/([a-z]+)/', 1) AS section, b.text AS content,
              list_sort([n FOR n IN [{sql_list(NAMES)}] IF contains(b.text, n)]) AS politicians
            FROM pages p JOIN bodies b ON b.page_id = p.page_id),
    taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY page_id) AS r FROM art) WHERE r <= {CAP})
    SELECT row_number() OVER (ORDER BY page_id) AS id, url, section AS press, array_to_string(politicians, ',') AS politicians,
      CASE WHEN len(politicians) < 2 OR content = '' THEN '' WHEN {STARS} = 1 THEN '1 star'
        ELSE CAST({STARS} AS VARCHAR) || ' stars' END AS sentiment_label FROM taken"""
)
def news_run(spark, sf_dir):
    """The whole run on the given pages: list per section, body text, names, sentiment, both stores."""
    fetched = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    section = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    listed = fetched.select(
        F.col("page_id").alias("pos"),
        "url",
        section.alias("section"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        section.alias("press"),
        F.lit(None).cast("string").alias("date"),
    )
    out = scratch_path(spark, "news")
    news.run(
        listed, fetched, names_table(spark), CAP, NOW, f"{out}/table", f"{out}/graph",
        positive=GOOD, negative=BAD,
    )
    return writers.read_articles(spark, f"{out}/table").select("id", "url", "press", "politicians", "sentiment_label")


# --- stored table --------------------------------------------------------------------

STORED = f"""
SELECT d.doc_id - f.lo + 1 AS id, md5(text) AS url, array_to_string(a.politicians, ',') AS politicians,
       a.sentiment_label, strftime(TIMESTAMP '2024-01-15 10:00:00', '%Y%m%d') AS base_date
FROM documents d JOIN scored a ON a.pos = d.doc_id, (SELECT min(doc_id) AS lo FROM documents) f
UNION ALL
SELECT 2 * f.n + row_number() OVER (ORDER BY d.doc_id), md5(text), array_to_string(a.politicians, ','),
       a.sentiment_label, '20240115'
FROM documents d JOIN scored a ON a.pos = d.doc_id, (SELECT count(*) AS n FROM documents) f
WHERE lang = 'en'
"""


@query(f"WITH {BASE} {STORED}")
def stored_articles(spark, sf_dir):
    """Three runs at 10:00, 11:30 and 12:00: the last one replaces the second."""
    # three sinks read the scored rows, which are worked out once
    scored = cut(scored_table(spark, sf_dir), "scored")
    path = scratch_path(spark, "articles")
    writers.save_articles(spark, scored, path, NOW.replace(hour=10), "ordinal")
    writers.save_articles(spark, scored, path, NOW.replace(hour=11, minute=30), "ordinal")
    writers.save_articles(spark, scored.where(F.col("date") == "en"), path, NOW, "ordinal")
    return writers.read_articles(spark, path).select("id", "url", "politicians", "sentiment_label", "base_date")


@query(
    f"""WITH {BASE} SELECT row_number() OVER (ORDER BY pos) AS id, url, politicians FROM (
      SELECT pos, url, array_to_string(politicians, ',') AS politicians FROM scored)"""
)
def stream_article_replace(spark, sf_dir):
    source = table(spark, sf_dir, "documents")
    # as a pattern the name fits a table that is one file and one that is a folder of files
    docs = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parque[t]")
    named = docs.select(
        F.col("doc_id").alias("ordinal"),
        F.md5("text").alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("press"),
        F.col("lang").alias("date"),
        F.col("text").alias("content"),
        mentions.names_contained(F.col("text"), NAMES).alias("politicians"),
    )
    scored = scoring.score_articles(named, positive=GOOD, negative=BAD)
    out = scratch_path(spark, "stream-articles")
    started = runs.start_article_replace(
        scored, out, scratch_path(spark, "stream-articles-progress"), "ordinal", lambda n: NOW
    )
    started.awaitTermination()
    return writers.read_articles(spark, out).select("id", "url", "politicians")


@query(
    f"""WITH batch AS (SELECT doc_id, md5(text) AS title FROM documents),
    last AS (SELECT max(event_id) AS m FROM events)
    SELECT event_id AS id, event_type AS title, strftime(ts, '%Y%m%d') AS base_date
    FROM events WHERE ts < TIMESTAMP '{NOW_TEXT}' - INTERVAL 1 HOUR
    UNION ALL
    SELECT m + row_number() OVER (ORDER BY doc_id), title, '20240115' FROM batch, last"""
)
def replace_last_hour(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("title"),
        F.col("ts").alias("inserted_at"),
        F.date_format("ts", "yyyyMMdd").alias("base_date"),
    )
    batch = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("title"))
    now = F.to_timestamp(F.lit(NOW_TEXT))
    return articles.replace_last_hour(events, batch, now, "doc_id").select("id", "title", "base_date")


# --- model comparison over the embeddings ---------------------------------------------

LABELS = ["negative", "neutral", "positive"]
MODELS = ["m1", "m2", "m3", "plain"]


def logit(k):
    return F.slice("embedding", 3 * k + 1, 3).cast("array<double>")


def verdict_table(spark, sf_dir) -> DataFrame:
    statements = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), "label").alias("source"),
        F.concat(F.lit("t"), "vec_id").alias("target"),
        F.col("vec_id").cast("string").alias("text"),
        "embedding",
    )
    return scoring.score_statements(
        statements, {"m1": logit(0), "m2": logit(1), "m3": logit(2), "plain": None}, LABELS
    )


def _verdict_sql() -> str:
    each = []
    for k in range(3):
        a, b, c = (f"embedding[{3 * k + i}]::DOUBLE" for i in (1, 2, 3))
        top = f"greatest({a}, {b}, {c})"
        each.append(
            f"""SELECT {k} AS model_pos, 'm{k + 1}' AS model, vec_id, label AS lab,
            CASE WHEN {a} = {top} THEN 'negative' WHEN {b} = {top} THEN 'neutral' ELSE 'positive' END AS sentiment_label,
            1.0 / (exp({a} - {top}) + exp({b} - {top}) + exp({c} - {top})) AS confidence FROM embeddings"""
        )
    each.append("SELECT 3, 'plain', vec_id, label, 'neutral', 1.0 FROM embeddings")
    return f"verdicts AS ({' UNION ALL '.join(each)})"


VERDICTS = _verdict_sql()


@query(
    f"""WITH {VERDICTS} SELECT 's' || lab AS source, 't' || vec_id AS target, model, sentiment_label,
      round(confidence, 6) AS confidence,
      CASE sentiment_label WHEN 'positive' THEN CAST(trunc(50 + 50 * confidence) AS INT)
        WHEN 'negative' THEN CAST(trunc(-50 * confidence) AS INT) ELSE 0 END AS score
    FROM verdicts"""
)
def score_statements(spark, sf_dir):
    return verdict_table(spark, sf_dir).select(
        "source",
        "target",
        "model",
        "sentiment_label",
        F.round("sentiment_confidence", 6).alias("confidence"),
        "score",
    )


DISTRIBUTION = """dist AS (
  SELECT m.model_pos, m.model, l.label, count(v.vec_id) AS n
  FROM (SELECT DISTINCT model_pos, model FROM verdicts) m
  CROSS JOIN (SELECT unnest(['positive', 'negative', 'neutral']) AS label) l
  LEFT JOIN verdicts v ON v.model = m.model AND v.sentiment_label = l.label GROUP BY ALL)"""


@query(f"WITH {VERDICTS}, {DISTRIBUTION} SELECT * FROM dist")
def label_distribution(spark, sf_dir):
    return scoring.label_distribution(verdict_table(spark, sf_dir))


@query(
    f"""WITH {VERDICTS}, {DISTRIBUTION}, sums AS (
      SELECT model_pos, model, sum(n) FILTER (label <> 'neutral')::BIGINT AS polar,
        sum(n) FILTER (label = 'positive')::BIGINT AS positive, sum(n) FILTER (label = 'negative')::BIGINT AS negative,
        sum(n) FILTER (label = 'neutral')::BIGINT AS neutral FROM dist GROUP BY ALL)
    SELECT * FROM sums ORDER BY CASE WHEN polar > 0 THEN polar ELSE -1 END DESC, model_pos LIMIT 1"""
)
def best_model(spark, sf_dir):
    return scoring.best_model(scoring.label_distribution(verdict_table(spark, sf_dir)))


def _cell_sql(model):
    text = "CASE WHEN lab = 0 THEN '번역실패' ELSE printf('%s (%.2f)', sentiment_label, confidence) END"
    if model == "plain":
        text = "'모델실패'"
    return f"max(CASE WHEN model = '{model}' THEN {text} END) AS {model}"


@query(
    f"""WITH {VERDICTS} SELECT vec_id AS sample, {', '.join(_cell_sql(m) for m in MODELS)}
    FROM verdicts GROUP BY vec_id"""
)
def comparison_matrix(spark, sf_dir):
    """Models side by side per sample; label 0 stands for a failed translation."""
    rows = verdict_table(spark, sf_dir).select(
        "model",
        F.col("desc").cast("long").alias("sample"),
        F.when(F.col("source") == "s0", "").otherwise(F.col("desc")).alias("translated"),
        "sentiment_label",
        "sentiment_confidence",
    )
    cell = scoring.verdict_cell(
        F.col("translated"), F.col("sentiment_label"), F.col("sentiment_confidence"), F.col("model") != "plain"
    )
    return scoring.sample_by_model(rows.select("model", "sample", cell.alias("cell")), MODELS)


@query(
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS place
                  FROM embeddings)
       SELECT label, place, round(avg(v), 5) AS mean FROM x GROUP BY label, place"""
)
def mean_pool(spark, sf_dir):
    means = scoring.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("mean").alias("place", "mean")).withColumn(
        "mean", F.round("mean", 5)
    )


@query(
    f"""WITH p AS (SELECT doc_id, regexp_extract(text, '{roster.PHONE_PATTERN}') AS phone,
      regexp_extract(text, '{roster.EMAIL_PATTERN}') AS email FROM documents) SELECT * FROM p"""
)
def contact_extract(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", roster.phone_in(F.col("text")).alias("phone"), roster.email_in(F.col("text")).alias("email")
    )


KEYWORDS = ["License", "Nicht", "This", "elle"]


@query(
    f"""SELECT doc_id, coalesce([k FOR k IN [{sql_list(KEYWORDS)}] IF contains(text, k)][1], '') AS keyword
        FROM documents"""
)
def priority_keyword(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(roster.first_keyword(F.col("text"), KEYWORDS), F.lit("")).alias("keyword")
    )


@query(
    """SELECT lang AS label, CASE WHEN quality = 1 THEN '4 stars' ELSE '1 star' END AS stars,
        CASE WHEN quality = 1 THEN 'POSITIVE_SENTIMENT' ELSE 'NEGATIVE_SENTIMENT' END AS type, count(*) AS n
       FROM labels JOIN documents USING (doc_id) GROUP BY ALL"""
)
def polarity_edges_from_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    stars = F.when(F.col("quality") == 1, "4 stars").otherwise("1 star")
    return rows.groupBy(
        F.col("lang").alias("label"), stars.alias("stars"), scores.polarity_edge(stars).alias("type")
    ).agg(F.count("*").alias("n"))
