"""Inputs that the registered queries never hold: bad files, repeated keys, several runs."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from relgraph.functions import web
from relgraph.operators import mentions, pages, paths, relations, scoring, tables
from relgraph.plans import news
from relgraph.sources import readers, writers


def test_everyone_keeps_their_own_attributes(spark):
    rows = [(f"p{i}", f"u{i}", "b", "x", f"p{(i + 1) % 20}", None, h) for i, h in enumerate(range(-10, 10))]
    persons = spark.createDataFrame(rows, "name string, wiki_url string, birth_place string, party string, spouse string, family string, ordinal long")
    found = relations.person_nodes(persons, relations.family_edges(persons)).collect()
    assert {r["name"]: r["wiki_url"] for r in found} == {f"p{i}": f"u{i}" for i in range(20)}


def test_a_malformed_roster_file_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"의원명": "가"}]), encoding="utf-8")
    assert readers.roster_arrays(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.json").write_text('[{"의원명": "나"', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.roster_arrays(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("url", ["/img/홍 길동.png", "a b.png", "x[1].png", "%E.png"])
def test_endings_of_odd_urls(spark, url):
    assert spark.range(1).select(web.file_ending(F.lit(url))).first()[0] == ".png"


def test_names_per_text_whatever_the_key(spark):
    docs = spark.createDataFrame([("k", "Anna and Bob"), ("k", "Anna and Bob"), (None, "Bob"), ("k", "none"), (None, None)], "url string, text string")
    names = spark.createDataFrame([("Anna",), ("Bob",)], "name string")
    found = mentions.match_names_by_grams(docs, names, "url").collect()
    assert sorted((r["text"] or "", r["politicians"]) for r in found) == [
        ("", []), ("Anna and Bob", ["Anna", "Bob"]), ("Anna and Bob", ["Anna", "Bob"]), ("Bob", ["Bob"]), ("none", []),
    ]


def test_a_model_with_too_few_answers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    out = df.select("t", scoring.model_column(F.col("t"), lambda: lambda texts: [("x", 1.0)] if texts == ["a"] else []).alias("s"))
    assert {r["t"]: tuple(r["s"]) for r in out.collect()} == {"a": ("x", 1.0), "b": ("", 0.0)}


def test_upsert_in_the_order_of_a_struct(spark):
    old = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2, ("f", 1)), ("a", 3, ("g", 0)), ("b", 4, ("f", 2))], "id string, v int, ordinal struct<file:string,place:int>")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"], "ordinal").collect())) == [("a", 3), ("b", 4)]


def article(spark, urls, names=("가", "나")):
    rows = [(i, u, u, "p", "d", list(names), "5 stars", 0.9, "c", "20260101") for i, u in enumerate(urls)]
    return spark.createDataFrame(
        rows, "ordinal long, url string, title string, press string, date string, politicians array<string>, sentiment_label string, "
        "sentiment_score double, content string, base_date string"
    )


def test_ids_never_come_back(spark, tmp_path):
    path = str(tmp_path / "t")
    for hour, minute, n in ((10, 0, 3), (12, 0, 3), (12, 30, 0), (14, 0, 3)):
        writers.save_articles(spark, article(spark, [f"{hour}-{i}" for i in range(n)]), path, datetime(2026, 1, 1, hour, minute), "ordinal")
    rows = readers_sorted(spark, path)
    assert [i for i, u in rows if u.startswith("14")] == [7, 8, 9]


def readers_sorted(spark, path):
    return sorted((r["id"], r["url"]) for r in writers.read_articles(spark, path).collect())


def test_news_graphs_add_up(spark, tmp_path):
    path = str(tmp_path / "g")
    for urls in (["u1"], ["u2"]):
        news.merge_graph(spark, news.mention_graph(article(spark, urls)), path)
    nodes, edges = (spark.read.parquet(f"{path}/{t}").collect() for t in ("nodes", "edges"))
    assert sorted(r["node_id"] for r in nodes) == ["Article:u1", "Article:u2", "Politician:가", "Politician:나"]
    assert sum(r["type"] == "PUBLISHED_ABOUT" for r in edges) == 4
    assert [r["props"]["count"] for r in edges if "count" in r["props"]] == ["2"]


def test_a_run_of_one_article_touches_only_its_folders(spark, tmp_path):
    path = tmp_path / "g"
    many = spark.range(400).select(
        F.col("id").alias("ordinal"), F.concat(F.lit("u"), "id").alias("url"), F.lit("t").alias("title"), F.lit("p").alias("press"),
        F.lit("d").alias("date"), F.array(F.concat(F.lit("a"), F.col("id") % 90), F.concat(F.lit("b"), F.col("id") % 70)).alias("politicians"),
        F.lit("5 stars").alias("sentiment_label"), F.lit(0.5).alias("sentiment_score"), F.lit("c").alias("content"), F.lit("20260101").alias("base_date"),
    )
    news.merge_graph(spark, news.mention_graph(many), str(path), buckets=64)
    files = lambda: {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    before = files()
    rows = {t: spark.read.parquet(f"{path}/{t}").count() for t in ("nodes", "edges")}
    news.merge_graph(spark, news.mention_graph(article(spark, ["new"])), str(path), buckets=64)
    after = files()
    changed = {f.parent for f in before.keys() ^ after.keys()} | {f.parent for f in before.keys() & after.keys() if before[f] != after[f]}
    # three nodes, two mentions, one pair, one counted edge
    assert 0 < len(changed) <= 7 and len({f.parent for f in before}) > 100
    assert spark.read.parquet(f"{path}/nodes").count() == rows["nodes"] + 3
    assert spark.read.parquet(f"{path}/edges").count() == rows["edges"] + 4


def test_a_run_appears_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.save_articles(spark, article(spark, ["old"]), path, datetime(2026, 1, 1, 10), "ordinal")
    writers.save_articles(spark, article(spark, ["mid"]), path, datetime(2026, 1, 1, 12), "ordinal")
    reader = writers.read_articles(spark, path)
    # a run that is written but not yet on the list isn't there
    reader.write.mode("overwrite").parquet(f"{path}/base_date=20260101/run=1767272400")
    assert [u for _, u in readers_sorted(spark, path)] == ["old", "mid"]
    writers.save_articles(spark, article(spark, ["new"]), path, datetime(2026, 1, 1, 12, 30), "ordinal")
    assert [u for _, u in readers_sorted(spark, path)] == ["old", "new"]
    # who began to read before the run can finish
    assert sorted(r["url"] for r in reader.collect()) == ["mid", "old"]


def test_all_pairs_of_a_text_with_very_many_names(spark):
    wide = spark.range(1).select(F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.format_string("n%05d", i))).alias("names"))
    rows = mentions.pair_rows(wide, "names", [])
    found = rows.agg(F.count("*"), F.min("name1"), F.max("name2"), F.countDistinct("name1")).first()
    assert tuple(found) == (3000 * 2999 // 2, "n00001", "n03000", 2999)
    for n in (0, 1, 2, 3, mentions.TILE, mentions.TILE + 1, 2 * mentions.TILE + 5):
        names = [f"n{i:05d}" for i in range(n)]
        df = spark.createDataFrame([(7, names)], "k int, names array<string>")
        got = {(r["k"], r["name1"], r["name2"]) for r in mentions.pair_rows(df, "names", ["k"]).collect()}
        assert got == {(7, a, b) for i, a in enumerate(names) for b in names[i + 1 :]}


def test_a_page_fetched_twice_is_one_article(spark):
    one = spark.createDataFrame([("u", 1)], "url string, pos int")
    fetched = spark.createDataFrame([("u", "<p>a</p>"), ("u", "<p>b</p>")], "url string, html string")
    assert [(r["url"], r["content"]) for r in news.with_body(one, fetched).collect()] == [("u", "b")]


def test_a_page_that_cannot_be_parsed(spark):
    df = spark.createDataFrame([(1, "<p>fine</p>"), (2, "<p>x</p><![foo[ bar ]]>")], "page_id int, html string")
    rows = pages.with_text(pages.html_elements(df, {"p", pages.DOCUMENT})).collect()
    assert {r["page_id"] for r in rows} == {1, 2}
    assert [r["tag"] for r in rows if r["page_id"] == 1 and r["text"] == "fine" and r["tag"] == "p"] == ["p"]


def test_all_paths_without_a_limit(spark):
    leaves = 150
    nodes = spark.createDataFrame([(f"Member:{i}", ["Member"]) for i in range(leaves)] + [("Party:p", ["Party"])], "node_id string, labels array<string>")
    edges = spark.createDataFrame([(f"Member:{i}", "Party:p", "BELONGS_TO") for i in range(leaves)], "src string, dst string, type string")
    start = spark.createDataFrame([("Party:p",)], "node_id string")
    assert paths.neighbourhood(nodes, edges, start, 1).count() == leaves
    assert paths.neighbourhood(nodes, edges, start, 1, 100).count() == 100
    assert paths.member_paths(nodes, edges).count() == leaves * (leaves - 1)


@pytest.mark.parametrize("parts", [32_768, 64])
def test_people_with_few_and_very_many_keys(spark, monkeypatch, parts):
    import random

    from relgraph.operators import groups

    monkeypatch.setattr(groups, "BITS", parts)
    rng = random.Random(1)
    held = {f"m{i}": {f"k{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 6, 7, 12, 13, 40]))} for i in range(150)}
    # many people with the same keys, few and many
    held |= {f"e{i}": {"k1", "k2"} for i in range(37)} | {f"w{i}": {f"k{j}" for j in range(0, 40, 2)} for i in range(21)}
    pairs = spark.createDataFrame([(m, k) for m, ks in held.items() for k in ks], "id string, key string")
    got = {r["id"]: r["n"] for r in groups.related_counts(groups.key_sets(pairs, "SAME", "id", "key")).collect()}
    assert got == {m: sum(1 for o, other in held.items() if o != m and ks & other) for m, ks in held.items()}


def test_a_large_dictionary_gives_the_names_contained(spark):
    import random

    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(12_000)})
    texts = ["".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "k int, text string")
    want = sorted((t or "", sorted(n for n in names if n in (t or ""))) for t in texts)
    table = spark.createDataFrame([(n,) for n in names], "name string")
    for match in (mentions.match_names, mentions.match_names_by_grams):
        assert sorted((r["text"] or "", r["politicians"]) for r in match(docs, table, "k").collect()) == want
