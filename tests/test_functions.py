"""Field parsers on hand-derived results."""

from urllib.parse import urljoin

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from relgraph.functions import roster, scores, web


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_id_from_link(spark):
    links = ["https://host/members/22nd/KIMGIHYEON", "https://host/m/", "https://host/m/A?tab=1"]
    assert column(spark, links, roster.id_from_link) == ["KIMGIHYEON", "", "A?tab=1"]


def test_region(spark):
    texts = ["서울 영등포구을", "비례대표", "세종", "서울 ", None, "", "경기 성남시 분당구갑"]
    pairs = zip(column(spark, texts, roster.sido_of), column(spark, texts, roster.district_of))
    assert list(pairs) == [
        ("서울", "영등포구을"),
        (None, "비례대표"),
        (None, "세종"),
        ("서울", ""),
        (None, None),
        (None, None),
        ("경기", "성남시 분당구갑"),
    ]


def test_election(spark):
    texts = ["5선(제17대, 제18대, 제19대, 제21대, 제22대)", "초선(제22대)", None, ""]
    assert column(spark, texts, roster.election_count) == [5, 0, 0, 0]
    assert column(spark, texts, roster.terms) == [[17, 18, 19, 21, 22], [22], [], []]


def test_school(spark):
    lines = ["서울대학교 법학과 졸업", "서울대학교대학원 졸업", "대학원 졸업", "국회의원"]
    assert column(spark, lines, roster.school_of) == ["서울대학교", "서울대학교대학", None, None]


def test_contacts_and_names(spark):
    texts = ["전화 02-784-1234 a.b@na.go.kr", "010-1-2", "국회의원 김기현"]
    assert column(spark, texts, roster.phone_in) == ["02-784-1234", "", ""]
    assert column(spark, texts, roster.email_in) == ["a.b@na.go.kr", "", ""]
    assert column(spark, texts, roster.plain_name)[2] == "김기현"
    assert column(spark, ["정의당 더불어민주당", "없음"], roster.party_in) == ["더불어민주당", None]
    assert column(spark, ["a, b,, c ", "", None], roster.items) == [["a", "b", "c"], [], []]
    assert column(spark, ["가" * 600], lambda c: F.char_length(roster.first_chars(c, 512))) == [512]


def test_card_number(spark):
    df = spark.range(1).select(roster.card_number(F.lit(2), F.lit(0)))
    assert df.first()[0] == "31"


def test_scores(spark):
    rows = [("positive", 0.999), ("negative", 0.999), ("positive", 0.0), ("neutral", 0.7)]
    df = spark.createDataFrame(rows, "label string, c double")
    got = [r[0] for r in df.select(scores.signed_score(F.col("label"), F.col("c"))).collect()]
    assert got == [99, -49, 50, 0]
    labels = ["5 stars", "4 stars", "3 stars", "2 stars", "1 star", ""]
    assert column(spark, labels, scores.polarity_edge) == [
        "POSITIVE_SENTIMENT", "POSITIVE_SENTIMENT", None, "NEGATIVE_SENTIMENT", "NEGATIVE_SENTIMENT", None,
    ]
    tie = [[1.0, 3.0, 3.0]]
    assert column(spark, tie, lambda c: scores.top_label(c, ["a", "b", "c"]), "array<double>") == ["b"]
    assert sum(column(spark, tie, scores.softmax, "array<double>")[0]) == pytest.approx(1)
    cell = spark.range(1).select(scores.result_cell(F.lit("5 stars"), F.lit(0.876)))
    assert cell.first()[0] == "5 stars (0.88)"
    words = ["최고 훌륭", "최악", "최고 최악", "최고 훌륭 만족"]
    assert column(
        spark, words, lambda c: scores.lexicon_label(c, scores.DEFAULT_POSITIVE, scores.DEFAULT_NEGATIVE)
    ) == ["5 stars", "2 stars", "3 stars", "5 stars"]


def test_media_names(spark):
    rows = [("김 기현*", "https://h/a/b.png?x=1"), ("A B", "https://h/a/b"), ("C", "")]
    df = spark.createDataFrame(rows, "n string, u string")
    plain = [r[0] for r in df.select(web.media_filename(F.col("n"), F.col("u"))).collect()]
    strict = [r[0] for r in df.select(web.media_filename(F.col("n"), F.col("u"), True)).collect()]
    assert plain == ["김_기현*.png", "A_B.jpg", ""]
    assert strict == ["김_기현.png", "A_B.jpg", ""]


def test_styles_and_calls(spark):
    styles = [
        "background-image:\n url('/img/a b.jpg')",
        "background: url(a.png); b: url(b.png)",
        "color: red",
    ]
    assert column(spark, styles, web.css_image) == ["/img/a b.jpg", "a.png", ""]
    assert column(spark, ["/i/ICO-x.png", "/i/face.png", "/logo.gif"], web.is_picture_path) == [
        False, True, False,
    ]
    calls = ["memberDetail('AB1')", "other()", None]
    assert column(spark, calls, lambda c: web.link_from_onclick(c, "https://h/m/")) == ["https://h/m/AB1", "", ""]
    assert column(spark, ["aXaXa", "aaaa", ""], lambda c: web.occurrences(c, "aX")) == [2, 0, 0]
    assert column(spark, ["ababa"], lambda c: web.occurrences(c, "aba")) == [1]


PIECE = st.text("ab.-_", min_size=0, max_size=4)
REFS = st.one_of(
    st.lists(PIECE, max_size=5).map("/".join),
    st.lists(PIECE, max_size=5).map(lambda p: "/" + "/".join(p)),
    st.lists(st.sampled_from(["..", ".", "x", "y.png"]), max_size=6).map("/".join),
    st.sampled_from(["//cdn.host/x", "https://other/z?q=1#f", "?a=1", "#top", "", "mailto:a@b", "g;x?y#z"]),
)
BASES = ["https://h.example/a/b/c?q=1#f", "http://h.example", "http://h.example/", "https://h/a/b/../d/"]


def test_absolute_url_matches_the_standard_library(spark):
    pairs = []

    @settings(max_examples=300, database=None)
    @given(st.sampled_from(BASES), REFS)
    def collect(base, ref):
        pairs.append((base, ref))

    collect()
    # a path that starts with an empty step reads as a host; both readings are of no use here
    pairs = [(b, r) for b, r in set(pairs) if not r.startswith("//") or r.startswith("//cdn")]
    df = spark.createDataFrame(pairs, "base string, ref string")
    rows = df.select("base", "ref", web.absolute_url(F.col("base"), F.col("ref")).alias("url")).collect()
    expected = {(b, r): urljoin(b, r) if r else "" for b, r in pairs}
    wrong = [(r.base, r.ref, r.url, expected[r.base, r.ref]) for r in rows if r.url != expected[r.base, r.ref]]
    assert not wrong, wrong[:5]
