"""Hard negatives, periodic runs and toxicity against brute force, an exact search or held-out rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from llm.fixtures import EDGES, docs_of, edge_docs, prose
from pyspark.sql import Row, functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from relgraph.llm import hard_negatives, native, periodic_runs, toxicity

SF = "/root/testdata/sf0.01"

# --- hard negatives --------------------------------------------------------------------------

VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())])


def mined(rows):
    """Plain loops over all pairs."""
    usable = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()), tuple(v)))
    found = []
    for a in (r for r in usable if r[0] % 100 == 0):
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in usable if b != a and len(b[2]) == len(a[2])]
        for minus, positive, _ in sorted(s for s in scored if s[2] == a[1])[:5]:
            p = -minus
            window = sorted(s for s in scored if s[2] != a[1] and 80 * p <= -100 * s[0] <= 100 * p)[:5]
            found += [(a[0], positive, k + 1, i, p, -s) for k, (s, i, _) in enumerate(window)]
    return sorted(found)


def vectors(rng, n, dims=6, labels=3):
    rows = []
    centres = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(8)]
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in c], rng.randrange(labels)))
    return rows


def found_in(spark, rows, **options):
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, label=x) for i, v, x in rows], VECTORS)
    for name in ("tree", "tile", "dims", "score", "rank", "slot", "anchor_id"):
        df = df.withColumn(name, F.lit("x"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **options).collect())


def test_hard_negatives_equal_plain_loops(spark):
    rng = random.Random(3)
    rows = vectors(rng, 1500)
    # a third of the rows share one vector, and so tie; some rows are repeated in full, some share an id only
    rows += [(2000 + i, rows[0][1], rng.randrange(3)) for i in range(700)]
    rows += rows[100:110] + [(300, rows[5][1], 1), (400, rows[0][1], 2)]
    rows += [(5000, None, 1), (5100, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (5200, [float("nan")] * 6, 1), (5300, [float("inf")] * 6, 1)]
    rows += [(5400, rows[0][1], None), (None, rows[0][1], 1), (5500, [0.5, 0.25], 1), (5501, [0.5, 0.5], 1), (5502, [0.5, 0.5], 2)]
    rows += [(5600, [], 1), (5601, [], 1), (5602, [], 2)]
    want = mined(rows)
    assert found_in(spark, rows) == want and len(want) > 50
    assert found_in(spark, rows, tree_rows=150) == want


def test_hard_negatives_of_little_or_nothing(spark):
    assert found_in(spark, []) == []
    assert found_in(spark, [(0, [1.0, 1.0], 1)]) == []
    # 0 is divisible by 7, so its label becomes 2
    assert found_in(spark, [(0, [1.0], 1), (1, [0.5], 2), (2, [0.45], 3), (3, [0.1], 3)]) == [(0, 1, 1, 2, 32768, 29440)]
    # a positive below zero has no window
    assert found_in(spark, [(0, [1.0], 1), (1, [-0.5], 2), (2, [-0.5], 3)]) == []


def test_hard_negatives_of_large_components_are_exact(spark):
    rng = random.Random(4)
    # products beyond 2**53, where doubles are rounded, of vectors that differ little
    centre = [rng.uniform(1e6, 2e6) for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.uniform(-2, 2))) for x in centre], rng.randrange(3)) for i in range(400)]
    want = mined(rows)
    assert min(r[4] for r in want) > 2**53
    assert found_in(spark, rows) == want and found_in(spark, rows, tree_rows=70) == want
    # a component of any finite size takes part
    huge = [(0, [1.0, 0.0], 1), (1, [0.5, 1e18], 2), (2, [0.45, -1e30], 3), (3, [0.1, 1e30], 3)]
    assert found_in(spark, huge) == [(0, 1, 1, 2, 32768, 29440)]


def test_boxes_hold_the_products_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(40, 1, 8)) + 0.02 * rng.normal(size=(40, 50, 8)))).reshape(-1, 8)
    packed = hard_negatives._pack(_table(x)).to_pylist()[0]
    tree = hard_negatives.Tree(packed)
    q = x[:64]
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    upper, lower = plus @ tree.high.T + minus @ tree.low.T, plus @ tree.low.T + minus @ tree.high.T
    for leaf in range(tree.leaves):
        s = q @ tree.x[tree.rows(leaf)].T
        assert (s.max(1) <= upper[:, leaf]).all() and (s.min(1) >= lower[:, leaf]).all()
    visited = []
    plain = hard_negatives.Tree.rows
    hard_negatives.Tree.rows = lambda self, leaf: visited.append(leaf) or plain(self, leaf)
    try:
        wanted = hard_negatives.Wanted(np.zeros(1, int), np.full(1, -np.inf), np.full(1, np.inf), True)
        hard_negatives.best_first(tree, q[:1], np.array([0]), np.array([1]), wanted)
    finally:
        hard_negatives.Tree.rows = plain
    assert 0 < len(visited) < tree.leaves / 3


def _table(x):
    import pyarrow as pa

    n = len(x)
    return pa.table({"tree": [0] * n, "dims": pa.array([x.shape[1]] * n, pa.int32()), "vec_id": list(range(n)), "label": [1] * n, "embedding": (x / 256).tolist()})


# --- periodic runs ---------------------------------------------------------------------------


def runs_of(words):
    """All runs by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                part = words[start : start + length]
                if not any(all(part[t] == part[t + p] for t in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    words = [words[i] for i in periodic_runs.planted(doc_id, len(words))]
    runs = runs_of(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if best[2] else None,
        digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def periodic(rng):
    words = [f"w{rng.randrange(rng.choice([2, 3, 500]))}" for _ in range(rng.choice([0, 3, 20, 90, 250]))]
    for _ in range(rng.randint(0, 3)):
        p = rng.choice([1, 2, 3, 5, 8, 13, 21])
        pattern = [f"w{rng.randrange(9)}" for _ in range(p)]
        at = rng.randint(0, len(words))
        part = [pattern[i % p] for i in range(p * rng.randint(3, 9) + rng.randint(0, p))]
        # periods of periods
        words[at:at] = (part + ["x"]) * 5 if rng.random() < 0.2 and len(part) < 40 else part
    return rng.choice([" ", "\n", "  \t"]).join(words[:700])


def test_periodic_runs_equal_plain_loops(spark):
    rng = random.Random(5)
    texts = [periodic(rng) for _ in range(250)] + [t for t in EDGES if len(t or "") < 5000]
    rows = periodic_runs.periodic_runs(docs_of(spark, texts)).collect()
    want = [expected(i, t) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in rows) == want
    assert sum(w[1] for w in want) > 200


def test_planted_ends():
    import zlib

    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(ids) > 150
    for i in ids[:40]:
        g, n = zlib.crc32(str(i).encode()) // 10, 57
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert periodic_runs.planted(i, n).tolist() == [k if k < a else a + (k - a) % p for k in range(n)]
    assert periodic_runs.planted(None, 3).tolist() == [0, 1, 2]


def test_runs_over_long_texts(spark):
    words = [f"w{i % 7000}" for i in range(40_000)]
    far = " ".join(["begin", *words, "end"])
    same = "a " * 100_000
    mixed = " ".join(["x y z"] * 5000 + [str(i) for i in range(3000)] + ["q"] * 9)
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(docs_of(spark, [far, same, mixed], ids=[1, 3, 5])).collect()}
    assert all(periodic_runs.planted(i, 9).tolist() == list(range(9)) for i in (1, 3, 5))
    assert [(r.n_runs, r.start, r.length, r.period) for r in (rows[1], rows[3], rows[5])] == [(1, 1, 40_000, 7000), (1, 0, 100_000, 1), (2, 0, 15_000, 3)]


def test_fragments_stitch_across_rows(spark):
    parts = [(1, 2, 0, 10), (1, 2, 10, 14), (1, 2, 13, 20), (1, 2, 21, 40), (1, 3, 5, 9), (2, 2, 0, 6), (2, 9, 0, 6)]
    found = spark.createDataFrame(parts, "row long, period long, first long, last long").repartition(3)
    assert sorted(tuple(r) for r in periodic_runs.stitched(found).collect()) == [(1, 2, 0, 22), (1, 2, 21, 21), (2, 2, 0, 8)]


def test_runs_of_edges_and_nothing(spark):
    docs = edge_docs(spark)
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted([*range(len(EDGES)), 5])
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automaton_equals_plain_distances():
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    terms = {draw(rng.randint(3, 10)): rng.random() for _ in range(30)}
    lexicon = toxicity.Lexicon(terms)
    hits = 0
    for _ in range(3000):
        word = draw(rng.randint(1, 11)) if rng.random() < 0.5 else "".join(c for c in rng.choice(list(terms)) if rng.random() < 0.9)
        near = [(distance(word, t), -terms[t], t) for t in terms if distance(word, t) <= toxicity.edits_of(t)]
        want = min(near) if near else None
        got = lexicon.match(word)
        assert (got and (got[1], lexicon.names[got[0]])) == (want and (want[0], want[2]))
        hits += want is not None
    assert hits > 300


def test_beginnings_and_exceptions():
    lexicon = toxicity.Lexicon({"abom*": 2.0, "moron": 3.0}, ["oron"])
    assert lexicon.match("abominable") == (0, 0) and lexicon.match("abxminable") is None
    assert lexicon.match("moran") == (1, 1) and lexicon.match("oron") is None and lexicon.match("moron") == (1, 0)
    assert lexicon.match("") is None and toxicity.Lexicon({}).match("word") is None


def test_quotation_weighs_less_than_abuse():
    import pyarrow as pa

    measure = toxicity.Measure(toxicity.Lexicon({"idiot": 5.0, "trash": 5.0}))
    pad = " and so the day went on as it would" * 3
    texts = [f"well you idiot{pad}", f"well an idiot{pad}", f'well an "idiot and more"{pad}', f"they said idiot{pad}", f"well an idoit idlot{pad}", f"well a cat{pad}", "", None]
    exact, fuzzy = (measure(pa.array(texts))[:, i] for i in (0, 2))
    assert exact[0] > exact[1] > exact[2] > 0 and exact[1] > exact[3] > 0
    assert fuzzy[4] > 0 and exact[4] == 0 and exact[5] == exact[6] == exact[7] == 0
    assert measure(pa.array(texts))[2][7] == 1


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (native.table(spark, SF, t) for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("toxic is not null").toPandas()
    held = found[found.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.8 and held[held.toxic == 0].predicted.mean() <= 0.02
    assert found.score.between(0, 1).all()


def test_misspelled_terms_are_caught(spark):
    rng = random.Random(4)
    bad = ["trash", "worthless", "disgusting", "pathetic"]

    def text(words):
        w = prose(rng, 60).split(" ")
        for k in words:
            w.insert(rng.randrange(len(w)), k)
        return " ".join(w)

    texts = [text(rng.choices(bad, k=4)) if i % 4 == 0 else text([]) for i in range(400)]
    texts += [text(["worthles", "disgustign", "patetic"]) for _ in range(20)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs_of(spark, texts), labels).collect()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].predicted == (i % 4 == 0) for i in range(400))
    # no misspelling was learned from, yet each scores above every clean text
    assert min(by[i].score for i in range(400, 420)) > max(by[i].score for i in range(400) if i % 4)


@pytest.mark.parametrize("kind", ["none", "one"])
def test_toxicity_without_labels_and_on_edges(spark, kind):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(3, 1), (None, 0), (4, None)] if kind == "one" else [], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    marked = spark.createDataFrame([(i, i % 2) for i in range(len(EDGES))] * 2, "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs, marked).collect()) == docs.count()
