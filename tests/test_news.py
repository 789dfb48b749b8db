"""Mentions, dedupe and caps, scoring, replace-last-hour, mention graph, streams."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from relgraph import skew
from relgraph.functions import roster, scores
from relgraph.operators import articles, mentions, scoring, tables
from relgraph.plans import news
from relgraph.sources import writers
from relgraph.streaming import runs

NOON = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)


def test_overlapping_names(spark):
    docs = spark.createDataFrame([(1, "김민석 의원과 이재명"), (2, "x"), (3, "")], "id long, text string")
    names = spark.createDataFrame([("김민",), ("김민석",), ("이재명",), ("y",)], "name string")
    for match in (mentions.match_names, mentions.match_names_by_grams):
        got = {r.id: r.politicians for r in match(docs, names, "id").collect()}
        assert got == {1: ["김민", "김민석", "이재명"], 2: [], 3: []}


def test_gram_match_equals_array_match(spark, monkeypatch):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab\nc😀") for _ in range(rng.randrange(60)))) for i in range(80)]
    known = sorted({"".join(rng.choice("ab\nc😀") for _ in range(rng.randrange(1, 5))) for _ in range(40)})
    docs = spark.createDataFrame(texts, "id long, text string")
    names = spark.createDataFrame([(n,) for n in known], "name string")
    want = {i: sorted(n for n in known if n in t) for i, t in texts}
    for match in (mentions.match_names, mentions.match_names_by_grams):
        assert {r.id: sorted(r.politicians) for r in match(docs, names, "id").collect()} == want
    monkeypatch.setattr(mentions, "DICTIONARY_BYTES", 8)
    assert {r.id: sorted(r.politicians) for r in mentions.match_names(docs, names, "id").collect()} == want


def test_pairs_and_co_mentions(spark):
    docs = spark.createDataFrame(
        [(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["b", "c"]), (4, ["a"]), (5, [])],
        "id long, politicians array<string>",
    )
    got = {(r.name1, r.name2): r.n_docs for r in mentions.co_mentions(docs).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 3}


def section_rows(spark):
    rows = [("A", u, i) for i, u in enumerate(["u1", "u1", "u2", "u3"])]
    rows += [("B", u, 10 + i) for i, u in enumerate(["u3", "u2", "u4", "u5"])]
    return spark.createDataFrame(rows, "section string, url string, pos long")


def kept(df):
    return [(r.section, r.url) for r in df.orderBy("section_rank", "pos").collect()]


def test_dedupe_and_cap_orders(spark):
    df = section_rows(spark)
    assert kept(articles.dedupe_then_cap(df, 2, ["A", "B"])) == [("A", "u1"), ("A", "u2"), ("B", "u3"), ("B", "u4")]
    late = articles.cap_then_dedupe(df, 2, ["A", "B"])
    assert kept(late) == [("A", "u1"), ("A", "u2"), ("B", "u3")]
    counts = {r.section: (r.n, r.short) for r in articles.section_counts(late, 2, ["A", "B", "C"]).collect()}
    assert counts == {"A": (2, False), "B": (1, True), "C": (0, True)}
    first = articles.first_seen(articles.with_section_rank(df, ["A", "B"]))
    assert {(r.url, r.pos) for r in first.collect()} == {("u1", 0), ("u2", 2), ("u3", 3), ("u4", 12), ("u5", 13)}
    assert {r.url for r in articles.unseen(df, df.where("url = 'u1'")).collect()} == {"u2", "u3", "u4", "u5"}


def plain_choice(rows, sections, cap):
    seen, want = set(), []
    for s in sections:
        n = 0
        for section, url, _ in rows:
            if section == s and url not in seen and n < cap:
                seen.add(url)
                want.append((s, url))
                n += 1
    return want


def test_dedupe_then_cap_equals_the_plain_loop(spark):
    rng = random.Random(4)
    sections = list("EDCBA")
    rows = [(rng.choice([*sections, "Z", "Y", None]), f"u{rng.randrange(60)}", p) for p in range(500)]
    df = spark.createDataFrame(rows, "section string, url string, pos long")
    for cap in (1, 3, 8, 100):
        # listed ones first, then the others by name, then null
        assert kept(articles.dedupe_then_cap(df, cap, sections)) == plain_choice(rows, [*sections, "Y", "Z", None], cap)
    assert kept(articles.dedupe_then_cap(df, 3)) == plain_choice(rows, [*"ABCDEYZ", None], 3)
    # another section changes no row of those before it
    more = spark.createDataFrame([*rows, ("ZZ", "u1", 900), ("ZZ", "new", 901)], df.schema)
    assert kept(articles.dedupe_then_cap(more, 3)) == plain_choice([*rows, ("ZZ", "u1", 900), ("ZZ", "new", 901)], [*"ABCDEYZ", "ZZ", None], 3)


def test_a_thousand_sections_of_unequal_size(spark):
    rng = random.Random(5)
    names = [f"s{i:04d}" for i in range(1000)]
    rows = [(names[int(rng.random() ** 3 * 1000)], f"u{int(rng.random() ** 2 * 3000)}", p) for p in range(12_000)]
    # each section's first URL is the second of the one before, so choices hang on each other
    rows = [(names[i], f"c{i + k}", -10 + k) for i in range(40) for k in (0, 1)] + rows
    rows.sort(key=lambda r: r[2])
    df = spark.createDataFrame(rows, "section string, url string, pos long")
    assert kept(articles.dedupe_then_cap(df, 4)) == plain_choice(rows, names, 4)


def test_windows_of_a_text(spark):
    rows = spark.createDataFrame([("a" * 7 + "\n😀bc",), ("",), (None,), ("abc",)], "t string")
    assert [r[0] for r in rows.select(roster.windows(F.col("t"), 3)).collect()] == [["aaa", "aaa", "a\n😀", "bc"], [""], [None], ["abc"]]


def test_serial_ids_and_first_n(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    for range_rows in (100, 3000):
        rows = skew.serial_ids(df, "k", start=100, range_rows=range_rows).collect()
        assert {(r.k, r.id) for r in rows} == {(k, 101 + k) for k in range(5000)}
    one = skew.serial_ids(df.where("k = 3"), "k").collect()
    assert [(r.k, r.id) for r in one] == [(3, 1)]
    assert skew.serial_ids(df.where("k < 0"), "k").count() == 0
    top = skew.first_n_per_group(df.withColumn("g", F.col("k") % 2), ["g"], [F.col("k").desc()], 3, ["k"])
    assert {(r.g, r.k, r["rank"]) for r in top.collect()} == {
        (0, 4998, 1), (0, 4996, 2), (0, 4994, 3), (1, 4999, 1), (1, 4997, 2), (1, 4995, 3),
    }


def test_lookup_join_with_hot_key(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    unique = big.groupBy("k").agg(F.count("*").alias("rows")).withColumn("v", F.col("k") * 2)
    joined = skew.lookup_join(big, unique, "k", "rows")
    assert joined.count() == 1000 and joined.where("v != 2 * k").count() == 0


def test_salted_join_spreads_a_hot_key(spark):
    many = spark.range(900).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    few = spark.createDataFrame([(0, "a"), (0, "b"), (700, "c"), (5000, "d")], "k long, v string")
    joined = skew.salted_join(few, many, ["k"], ["id"])
    assert sorted(joined.columns) == ["id", "k", "v"]
    want = few.join(many, "k").select("k", "v", "id")
    assert sorted(joined.select("k", "v", "id").collect()) == sorted(want.collect())
    assert joined.count() == 1201


def test_small_inputs_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert skew.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    large = spark.range(0, 1 << 40, 1, 3)
    assert skew.spread(large).rdd.getNumPartitions() == 3


def scored(spark):
    rows = [
        (1, "u1", ["a", "b"], "5 stars", 0.9), (2, "u2", ["a", "b", "c"], "1 star", 0.8),
        (3, "u1", ["a", "b"], "5 stars", 0.9), (4, "u3", ["a", "b"], "3 stars", 0.5), (5, "u4", ["a"], "", 0.0),
    ]
    df = spark.createDataFrame(
        rows, "ordinal long, url string, politicians array<string>, sentiment_label string, sentiment_score double"
    )
    return df.select("*", *[F.lit(c).alias(c) for c in ("title", "press", "date", "base_date", "content")])


def test_sentiment_edges(spark):
    df = scored(spark)

    def table(edges):
        return {(r.name1, r.name2, r.type[:3]): (r["count"], r.via_article) for r in edges.collect()}

    literal = tables.sentiment_edges(df)
    assert table(literal) == {
        ("a", "b", "POS"): (2, "u1"), ("a", "b", "NEG"): (1, "u2"), ("a", "c", "NEG"): (1, "u2"), ("b", "c", "NEG"): (1, "u2"),
    }
    assert table(tables.sentiment_edges(df, mode="idempotent"))["a", "b", "POS"] == (1, "u1")
    again = tables.sentiment_edges(df.withColumn("ordinal", F.col("ordinal") + 10), literal)
    assert table(again)["a", "b", "POS"] == (4, "u1")


def test_mention_graph(spark):
    one = scored(spark).where("ordinal = 1")
    graph = news.mention_graph(one)
    labels = [r.labels[0] for r in graph.nodes.collect()]
    assert sorted(labels) == ["Article", "Politician", "Politician"]
    edges = graph.edges.collect()
    assert sorted(r.type for r in edges) == ["MENTIONED_TOGETHER", "POSITIVE_SENTIMENT", "PUBLISHED_ABOUT", "PUBLISHED_ABOUT"]
    feeling = next(r for r in edges if r.type == "POSITIVE_SENTIMENT")
    assert feeling.props == {"count": "1", "via_article": "u1"}
    assert news.mention_graph(scored(spark).where("ordinal = 5")).nodes.count() == 0
    assert news.mention_graph(scored(spark).where("ordinal = 4")).edges.count() == 3


def test_only_gated_texts_reach_the_model(spark):
    def loader():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError
            return [("5 stars", float(len(t))) for t in texts]

        return model

    rows = [(1, ["a", "b"], "xyz"), (2, ["a"], "boom"), (3, ["a", "b"], "boom"), (4, ["a", "b"], ""), (5, ["a", "b"], "y" * 600)]
    df = spark.createDataFrame(rows, "id long, politicians array<string>, content string")
    got = {r.id: (r.sentiment_label, r.sentiment_score) for r in scoring.score_articles(df, loader).collect()}
    assert got == {1: ("5 stars", 3.0), 2: ("", 0.0), 3: ("", 0.0), 4: ("", 0.0), 5: ("5 stars", 600.0)}
    short = scoring.score_articles(df, loader, max_chars=512).where("id = 5").first()
    assert short.sentiment_score == 512.0
    word = scoring.score_articles(df, positive=["xyz"], negative=["q"]).where("id = 1").first()
    assert (word.sentiment_label, word.sentiment_score) == ("4 stars", 1.0)

    def shout():
        def run(texts):
            if "bad" in texts:
                raise ValueError
            return [t.upper() for t in texts]

        return run

    texts = spark.createDataFrame([("a",), ("bad",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in texts.select(scoring.mapped_text(F.col("t"), shout)).collect()] == ["A", "", ""]


def test_model_comparison(spark):
    rows = [("s", "t", "one", [3.0, 1.0, 0.0]), ("s", "t", "two", [0.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "source string, target string, text string, v array<double>")
    labels = ["negative", "neutral", "positive"]
    out = scoring.score_statements(df, {"m1": None, "m2": F.col("v")}, labels).cache()
    assert {(r.model, r.desc): r.score for r in out.collect()} == {
        ("m1", "one"): 0, ("m1", "two"): 0, ("m2", "one"): -42, ("m2", "two"): 0,
    }
    dist = scoring.label_distribution(out)
    assert {(r.model, r.label): r.n for r in dist.collect()} == {
        ("m1", "neutral"): 2, ("m1", "positive"): 0, ("m1", "negative"): 0,
        ("m2", "neutral"): 1, ("m2", "positive"): 0, ("m2", "negative"): 1,
    }
    assert scoring.best_model(dist).first().model == "m2"
    cells = spark.createDataFrame(
        [("m", 1, "ok", "5 stars", 0.5, True), ("m", 2, "", "x", 0.1, True), ("n", 1, "ok", None, None, False)],
        "model string, sample int, en string, label string, score double, ok boolean",
    ).withColumn("cell", scoring.verdict_cell(F.col("en"), F.col("label"), F.col("score"), F.col("ok")))
    wide = {r["모델명"]: (r["샘플1"], r["샘플2"]) for r in scoring.model_by_sample(cells, [1, 2]).collect()}
    assert wide == {"m": ("5 stars (0.50)", scores.TRANSLATION_FAILED), "n": (scores.MODEL_FAILED, None)}
    vectors = spark.createDataFrame([("g", [1.0, 2.0]), ("g", [3.0, 6.0])], "g string, v array<double>")
    assert scoring.mean_vectors(vectors, ["g"], "v").first()["mean"] == [2.0, 4.0]


def test_replace_last_hour_rows(spark):
    old = spark.createDataFrame(
        [(1, "a", "2024-05-01 10:30:00"), (2, "b", "2024-05-01 11:00:00"), (3, "c", "2024-05-01 11:30:00")],
        "id long, title string, inserted_at string",
    ).withColumn("inserted_at", F.to_timestamp("inserted_at")).withColumn("base_date", F.lit("20240501"))
    new = spark.createDataFrame([("x", 5), ("y", 6)], "title string, pos long")
    now = F.to_timestamp(F.lit("2024-05-01 12:00:00"))
    got = {(r.id, r.title) for r in articles.replace_last_hour(old, new, now, "pos").collect()}
    assert got == {(1, "a"), (4, "x"), (5, "y")}
    assert [r.id for r in articles.replace_last_hour(old, new.limit(0), now, "pos").collect()] == [1]


def test_usable_articles(spark):
    df = spark.createDataFrame(
        [("t", "u", None, None), (None, "u", "p", "d"), ("t", "", "p", "d"), ("", "v", "p", "d")],
        "title string, url string, press string, date string",
    )
    rows = articles.usable_articles(df, F.to_timestamp(F.lit("2024-05-01 12:00:00"))).collect()
    assert [tuple(r) for r in rows] == [("t", "u", "", "2024-05-01"), ("", "v", "p", "d")]


def test_saved_runs(spark, tmp_path):
    path, df = str(tmp_path / "t"), scored(spark)

    def at(hour, minute):
        return datetime(2024, 5, 1, hour, minute, tzinfo=timezone.utc)

    def stored():
        return sorted((r.id, r.url, r.run) for r in writers.read_articles(spark, path).collect())

    writers.save_articles(spark, df, path, at(10, 0), "ordinal")
    first = stored()
    assert [r[0] for r in first] == [1, 2, 3, 4, 5]
    writers.save_articles(spark, df, path, at(11, 30), "ordinal")
    writers.save_articles(spark, df.limit(2), path, at(12, 0), "ordinal")
    rows = stored()
    # the 11:30 run is gone, ids go on behind it; articles with fewer than two names are stored too
    assert rows[:5] == first and [r[0] for r in rows[5:]] == [11, 12]
    writers.save_articles(spark, df.limit(2), path, at(12, 0), "ordinal")
    assert len(stored()) == 7
    writers.save_articles(spark, df.limit(0), path, at(12, 30), "ordinal")
    assert stored() == first
    row = writers.read_articles(spark, path).where("id = 2").first()
    assert (row.politicians, row.base_date) == ("a,b,c", "20240501")


def test_edge_counts_of_many_batches_are_folded(spark, tmp_path):
    src, out = str(tmp_path / "many"), str(tmp_path / "counts")
    rng = random.Random(8)
    rows = [(i, f"u{i}", sorted(rng.sample("가나다라", rng.randint(2, 4))), rng.choice(["5 stars", "1 star", "3 stars"])) for i in range(70)]
    shape = "ordinal long, url string, politicians array<string>, sentiment_label string"
    want = sorted(map(str, tables.sentiment_edges(spark.createDataFrame(rows, shape)).select("name1", "name2", "type", "count", "via_article", "seq").collect()))
    for i in range(7):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], shape).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(src)
    runs.start_edge_counts(read(), out, str(tmp_path / "progress"), fold=2).awaitTermination()
    counts = lambda: sorted(map(str, runs.edge_counts(spark, out).select("name1", "name2", "type", "count", "via_article", "seq").collect()))
    assert counts() == want
    base, after = runs.stored_counts(spark, out)
    assert base is not None and base >= 3 and len(after) <= 3
    assert len(list((tmp_path / "counts").glob("b*=*"))) <= 8
    # the whole stream comes again, from its first batch on
    runs.start_edge_counts(read(), out, str(tmp_path / "again"), fold=2).awaitTermination()
    assert counts() == want


def test_stream_counts_equal_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = scored(spark)
    for i in range(1, 6):
        df.where(F.col("ordinal") == i).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(src)
    query = runs.start_edge_counts(stream, out, str(tmp_path / "ck"))
    query.awaitTermination(120)
    want = sorted(map(str, tables.sentiment_edges(df).collect()))
    assert sorted(map(str, runs.edge_counts(spark, out).collect())) == want
    # a batch that runs again replaces its own counts
    tables.sentiment_edges(spark.read.parquet(src).where("ordinal < 0")).write.mode("append").parquet(f"{out}/batch=0")
    assert sorted(map(str, runs.edge_counts(spark, out).collect())) == want


def test_stream_replace(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = scored(spark).coalesce(1)
    df.write.parquet(src)
    df.write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def clock(n):
        return datetime(2024, 5, 1, 9, 10 * n, tzinfo=timezone.utc)

    runs.start_article_replace(stream, out, str(tmp_path / "ck"), "ordinal", clock).awaitTermination(120)
    rows = writers.read_articles(spark, out).collect()
    assert len(rows) == 5 and {r.inserted_at.minute for r in rows} == {10}


def test_stream_reads_a_table_of_one_file_and_of_many(spark, tmp_path):
    from workload import QUERIES

    of_file = "/root/testdata/sf0.001"
    spark.read.parquet(f"{of_file}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, got = (sorted(tuple(r) for r in QUERIES["stream_article_replace"](spark, d).collect()) for d in (of_file, str(tmp_path)))
    assert got == want and len(want) == 200


def test_names_of_more_texts_than_one_slice(spark):
    n = 5 * mentions.SLICE + 7
    texts = [(i, None if i % 11 == 0 else f"x{i} {'김민석' if i % 3 == 0 else ''} a{i % 5}") for i in range(n)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(2)
    names = ["김민석", "김민", "a3", "x1"]
    got = {r.id: r.n for r in docs.select("id", mentions.names_contained(F.col("text"), names).alias("n")).collect()}
    assert got == {i: sorted(x for x in names if x in (t or "")) for i, t in texts}
    assert {tuple(r.n) for r in docs.select(mentions.names_contained(F.col("text"), []).alias("n")).collect()} == {()}
