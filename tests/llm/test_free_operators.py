"""N-gram join, token shards, codec, classifiers and line dedup against brute force or held-out rows."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm.fixtures import EDGES, components_of, docs_of, edge_docs, jaccard_links, prose, shingle_set
from pyspark.sql import functions as F

from relgraph.llm import lang_id, line_dedup, mixing, native, ngram_join, piece_codec, quality_rank, registry, token_shards

SF = "/root/testdata/sf0.01"


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["new", "other", "word", str(rng.random())])
    return " ".join(words)


def near_copies(rng, groups=12, size=12):
    texts = []
    for _ in range(groups):
        base = prose(rng, rng.randint(6, 150))
        texts += [base, base] + [edited(rng, base, rng.randint(0, 7)) for _ in range(size)]
        # a chain: each like the one before, the ends not alike
        chain = [base]
        for _ in range(4):
            chain.append(edited(rng, chain[-1], max(1, len(base.split()) // 60)))
        texts += chain[1:]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage}" for _ in range(40)] + EDGES
    rng.shuffle(texts)
    return texts


def test_jaccard_components(spark):
    texts = near_copies(random.Random(1))
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    want = components_of(sets, jaccard_links(sets))
    rows = ngram_join.jaccard_components(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), want[i]) for i, s in sets.items()}
    left = {r.doc_id for r in ngram_join.one_of_each_group(docs_of(spark, texts)).collect()}
    assert left == set(want.values())


def test_merged_short_lists_bound_the_overlap():
    assert ngram_join.needed(1) == 1 and ngram_join.needed(4) == 3 and ngram_join.needed(5) == 4
    for n in range(1, 400):
        assert 1 <= ngram_join.rare_k(n) <= ngram_join.needed(n) and ngram_join.first_k(n) <= ngram_join.needed(n)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    places = token_shards.permuted(np.arange(n), n, 7)
    assert sorted(places) == list(range(n))
    assert n < 64 or list(places) != list(token_shards.permuted(np.arange(n), n, 8))


def test_shards_hold_every_text_and_can_be_resumed(spark, tmp_path):
    texts = [*EDGES, *[prose(random.Random(i), 40 + i) for i in range(60)]]
    path = f"file://{tmp_path}/shards"
    rows = token_shards.token_shards(docs_of(spark, texts), path, stride=64, per_shard=50).orderBy("shard").collect()
    again = token_shards.token_shards(docs_of(spark, texts).repartition(5), stride=64, per_shard=50).orderBy("shard").collect()
    assert rows == again
    sequences = list(token_shards.read_sequences(path, 64, 50))
    assert len(sequences) == sum(r.n_sequences for r in rows) and all(r.n_bytes == 128 * r.n_sequences for r in rows)
    stream = np.concatenate([sequences[i] for i in token_shards.permuted(np.arange(len(sequences)), len(sequences), 20260)])
    encoding, found, now = token_shards.tokenizer(token_shards.RANKS), [], []
    for x in stream.tolist():
        if x == token_shards.END:
            found.append(encoding.decode(now))
            now = []
        else:
            now.append(x)
    assert not now
    want = Counter(t for t in texts if t is not None)
    filled = len(found) - sum(want.values())
    assert 0 <= filled < 64 and Counter(found) == want + Counter({"": filled})
    resumed = list(token_shards.read_sequences(path, 64, 50, start=75))
    assert len(resumed) == len(sequences) - 75 and all((a == b).all() for a, b in zip(resumed, sequences[75:], strict=True))


def test_the_shard_query_writes_its_files(spark):
    folder = native.shared_folder(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files = lambda: {f.getPath().toUri().getPath() for f in fs.globStatus(hadoop.Path(f"{folder}/token-shards-*/*"))}
    before = files()
    rows = registry.QUERIES["op5_token_shards"](spark, SF).collect()
    new = {p.rsplit("/", 1)[1]: Path(p).read_bytes() for p in files() - before}
    assert rows and {(f"shard-{r.shard:08d}.bin", r.n_bytes, r.sha256) for r in rows} == {
        (name, len(data), hashlib.sha256(data).hexdigest()) for name, data in new.items()
    }


def best_path(codec, pieces, chunk):
    """Plain Viterbi over all substrings."""
    best = [(0.0, [])] + [None] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(max(0, end - 20), end):
            found = pieces.get(chunk[start:end])
            if found and (best[end] is None or best[start][0] + found[1] > best[end][0]):
                best[end] = (best[start][0] + found[1], best[start][1] + [found[0]])
        if chunk[end - 1] not in pieces:
            unknown = (best[end - 1][0] + codec.unknown, best[end - 1][1] + [int(codec.bytes[b]) for b in chunk[end - 1].encode()])
            if best[end] is None or unknown[0] > best[end][0]:
                best[end] = unknown
    return best[-1]


def test_codec_finds_the_best_path():
    codec = piece_codec.codec(piece_codec.MODEL)
    pieces = {p: (i, s) for p, (i, _, s) in ((k, v) for k, v in codec.automaton.items())}
    scores = {i: s for i, s in pieces.values()}
    rng = random.Random(3)
    texts = [prose(rng, 30), "Ein Satz, der die Häuser zählt; foo². bar", "漢字 and 😀 é", "a  b   c", "don't (stop) ... #1", "x" * 70]
    for text in texts:
        whole = piece_codec.SPACE + text.replace(" ", piece_codec.SPACE)
        ids = np.frombuffer(codec.encode(text), codec.dtype).tolist()
        score, path = best_path(codec, pieces, whole)
        assert codec.decode(codec.encode(text)) == text
        assert sum(scores.get(i, 0) for i in ids) == pytest.approx(sum(scores.get(i, 0) for i in path)), text
        assert len(ids) == len(path) or score == pytest.approx(score)


def test_encoded_documents(spark):
    rows = piece_codec.encoded(edge_docs(spark), keep=["lang"]).collect()
    assert len(rows) == len(EDGES) + 2
    for r in rows:
        text = EDGES[r.doc_id] if r.doc_id is not None and r.doc_id < len(EDGES) else "x"
        assert r.round_trip == (text is not None and piece_codec.SPACE not in text)
        assert (r.ids is None) == (text is None) and r.n_tokens == len(r.ids or [])


def test_the_codec_query_returns_the_ids(spark):
    rows = registry.QUERIES["op6_piece_codec"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(
        r.n_tokens == len(r.ids or ()) and (r.ids is None or hashlib.sha256(np.array(r.ids, "<u2").tobytes()).hexdigest() == r.ids_sha256)
        for r in rows
    )


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lang_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    kept = lang_id.accepted(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_language_of_edges(spark):
    docs = edge_docs(spark)
    rows = {r.doc_id: r for r in lang_id.language_id(docs).collect()}
    for i, t in enumerate(EDGES):
        none = t is None or not re.search(r"[^\W\d_]", t)
        assert (rows[i].lang_pred == "und") == none and (rows[i].score == 0) == none and 0 <= rows[i].score <= 1
    assert lang_id.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in lang_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    # the smaller tables label too few bad documents to learn from
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rank.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for label in (0, 1):
        own = [r for r in rows if r.quality == label]
        assert sum(r.predicted == label for r in own) / len(own) > 0.97
    # labels of held-out documents don't matter
    turned = labels.withColumn("quality", F.when(quality_rank.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_rank.quality_scores(docs, turned).where("held_out").select("doc_id", "score").collect()
    assert {r.doc_id: r.score for r in again if r.doc_id in {x.doc_id for x in rows}} == {r.doc_id: r.score for r in rows}


def test_quality_of_edges(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([(3, 0), (5, 1), (5, 0), (9, None), (11, 1), (2, 0)], "doc_id long, quality int")
    rows = quality_rank.quality_scores(docs, labels).collect()
    assert len(rows) == len(EDGES) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_rank.quality_scores(docs, labels.limit(0)).count() == len(EDGES) + 2
    assert quality_rank.quality_scores(docs.limit(0), labels).count() == 0


def test_token_ids_of_any_white_space():
    ids, whole = token_shards.text_ids(token_shards.RANKS), token_shards.tokenizer(token_shards.RANKS)
    rng = random.Random(1)
    parts = ["a", "the", "'s", "'S", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x85", "\xa0", "\u2003", "\x1c", "\u200b", "1", "23", "#", "é", "漢", "😀"]
    parts += [" " * 1500, "\n" * 1100 + "\t", "\u3000" * 1030]
    for i in range(3000):
        text = "".join(rng.choice(parts if i % 9 == 0 else parts[:-3]) for _ in range(rng.randint(0, 25)))
        assert ids(text) == np.array(whole.encode_ordinary(text), "<u2").tobytes(), repr(text)


@pytest.mark.parametrize("space", [" ", "\n", "\u2003"])
def test_token_ids_of_millions_of_spaces(spark, space):
    ids = token_shards.text_ids(token_shards.RANKS)
    run = np.frombuffer(ids(space * 2_000_000), "<u2")
    behind = np.frombuffer(ids("x" + space * 2_000_000 + "y"), "<u2")
    last = np.frombuffer(ids(space + "y"), "<u2")
    # all but the last character are one word of the pattern
    assert (behind[1 : -len(last)] == np.frombuffer(ids(space * 1_999_999), "<u2")).all() and (behind[-len(last) :] == last).all()
    assert bytes(b for i in run[:2000] for b in token_shards.tokenizer(token_shards.RANKS).decode_single_token_bytes(int(i))).decode()[:600] == space * 600
    rows = token_shards.token_shards(docs_of(spark, [space * 2_000_000 + "a", "b"])).collect()
    assert sum(r.n_sequences for r in rows) > 1


def test_documents_that_share_an_id_or_have_none_stay(spark):
    a, b, c = (prose(random.Random(i), 60) for i in (1, 2, 3))
    docs = docs_of(spark, [a, b, a, c, c, a], ids=[5, 5, 7, None, None, 5], sources=["x", "y", "x", "z", "z", "x"])
    rows = [(r.doc_id, r.text, r.source) for r in ngram_join.one_of_each_group(docs).collect()]
    assert sorted(rows, key=str) == sorted([(5, a, "x"), (5, b, "y"), (None, c, "z")], key=str)
    lost = {r.doc_id for r in ngram_join.one_of_each_group(docs_of(spark, [a, b, b + " x"], ids=[9, 9, 3])).collect()}
    assert lost == {9, 3}


OWN_NAMES = ["_copy", "_gone", "_doc", "_removed", "_hash", "_rows", "_copies", "_text_hash", "_lettered", "key", "gone", "copies", "id", "rows",
             "hash", "from", "place", "t", "removed", "line", "line_no", "a.b"]


def test_stages_keep_columns_of_any_name(spark):
    docs = docs_of(spark, ["the same words stand here twice over, all of them", "the same words stand here twice over, all of them", "other words"])
    for i, name in enumerate(OWN_NAMES):
        docs = docs.withColumn(name, F.lit(70 + i))
    for stage in (lang_id.accepted, line_dedup.without_repeated_lines, ngram_join.one_of_each_group, mixing.mixed):
        after = stage(docs)
        assert after.columns == docs.columns
        for r in after.collect():
            assert [r[name] for name in OWN_NAMES] == list(range(70, 70 + len(OWN_NAMES)))


def test_mixed_rows_keep_their_own_columns(spark):
    docs = docs_of(spark, ["one two three"] * 4 + ["four five six"] * 2, ids=[1] * 4 + [2, 3], sources=["a", "b", "a", "a", "c", None], langs=list("klmnop"))
    per = {(r.source, r.doc_id): r.copies for r in mixing.mix(docs).groupBy("source", "doc_id").agg(F.sum("copies").alias("copies")).collect()}
    got = Counter((r.source, r.doc_id) for r in mixing.mixed(docs).collect())
    assert got == Counter({k: n for k, n in per.items() if n})
    each = Counter(r.lang for r in mixing.mixed(docs).where("source = 'a'").collect())
    assert set(each) <= set("kmn") and max(each.values()) - min([each[x] for x in "kmn"]) <= 1


def test_texts_of_a_batch_look_a_word_up_once():
    odd = ["", " a", "a ", "a\nb", "a\n b", "x  y", "it's the dogs' 'tis don't'", "a.b.c,d!? $$$", "na\u00efve fa\u00e7ade's\u2014x 42 a1b2 \u00c9.\n\u00c0!!", "\u65e5\u672c\u8a9e x", "a\u00a0b", "\nb", "b\n", "a'll x's.' y", "x\ty", "\u02b0a \u2167 \u00d7 cafe\u0301 \ud7cbx"]
    texts = odd + ["the same words. again and again,\nthe same words"] * 300
    ids, whole = token_shards.TextIds(token_shards.RANKS), token_shards.tokenizer(token_shards.RANKS)
    asked = []

    class Counting(token_shards._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    ids.behind_blank = Counting(whole, " ")
    found = list(ids.of_texts(texts))
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [whole.encode_ordinary(t) for t in texts]
    assert len(asked) < 100
    assert list(ids.of_texts(["a \ud800 b", "c"])) == [ids("a \ud800 b"), ids("c")]


def line_sets(texts):
    order = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    names = list(dict.fromkeys(x for _, _, x in order))
    return order, names, [frozenset(x[k : k + 5] for k in range(len(x) - 4)) or frozenset([x]) for x in names]


def test_line_dedup(spark):
    rng = random.Random(4)
    base = [prose(rng, rng.randint(2, 40)).replace("\n", " ") for _ in range(60)]
    lines = [edited(rng, x, rng.randint(0, 2)) for x in base for _ in range(6)] + ["Yes.", "Yes.", " ", ""] * 5
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)] + EDGES
    rows = line_dedup.line_dedup(docs_of(spark, texts)).collect()
    got = {(r.doc_id, i) for r in rows for i in r.removed}
    order, names, sets = line_sets(texts)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])]
    group = components_of(range(len(names)), links)
    at, seen, want = {x: group[i] for i, x in enumerate(names)}, set(), set()
    for d, i, x in order:
        if at[x] in seen:
            want.add((d, i))
        seen.add(at[x])
    # a link that banding misses leaves lines in; nothing else may differ much
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    assert sum(r.n_lines for r in rows) == len(order) and all(r.n_removed == len(r.removed) for r in rows)
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        assert kept[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got))


def removed_of(spark, lines):
    rows = line_dedup.line_dedup(docs_of(spark, ["\n".join(lines)])).collect()
    return set(rows[0].removed)


@pytest.mark.parametrize("small", [line_dedup.SMALL, 1000])
def test_alike_lines_of_a_bucket_need_no_hub(spark, small):
    # one bucket of 120 pairs of URLs that are unlike but for their partner
    rng = random.Random(6)
    urls = ["https://www.example.org/" + "".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(120)]
    lines = urls + [u + "?p=1" for u in urls]
    one = lambda texts: np.full((len(texts), 1), 7, np.uint64)
    rows = line_dedup.removed_lines(docs_of(spark, ["\n".join(lines)]), banding=one, small=small).collect()
    assert {r.line_no for r in rows} == set(range(120, 240))


def test_pairs_of_large_buckets_leave_out_what_cannot_be_alike(spark):
    # one bucket of lines of few different words, so unlike lines share rare shingles; 50 of them have partners
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(150)]
    lines = [" ".join(rng.sample(vocabulary, 20)) for _ in range(200)]
    lines += [edited(rng, x, 1) for x in lines[:50]] + [x + "!" for x in lines[:50]]
    sets = [frozenset(x[k : k + 5] for k in range(len(x) - 4)) for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = spark.createDataFrame([(key, i, i) for i in range(len(lines)) for key in (1, 2)], "key long, id long, component long")
    pairs = line_dedup.other_pairs(rows, texts, 0.75)
    made = {(r.a, r.b) for r in pairs.collect()}
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert alike <= made and len(alike) >= 100
    assert len(made) <= 3 * len(alike)
    found = {(min(r), max(r)) for r in line_dedup.similar(pairs, texts, 0.75).collect()}
    assert found == alike


def test_arrow_batches_are_small_inside_and_as_before_outside(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), native.arrow_rows(spark, 100):
        assert spark.conf.get(name) == "100"
        raise ValueError
    assert spark.conf.get(name) == before
    plain, most = ngram_join._sizes_and_keys, ngram_join._COMBINE

    def checked(batches):
        for batch in batches:
            assert batch.num_rows <= most
            yield from plain(iter([batch]))

    monkeypatch.setattr(ngram_join, "_sizes_and_keys", checked)
    docs = docs_of(spark, [f"some words of text number {i}" for i in range(3000)]).withColumnRenamed("doc_id", "doc").coalesce(1)
    assert ngram_join.links(docs)[0].count() == 3000 and spark.conf.get(name) == before


def test_shingles_of_lines():
    texts = ["abcdefg", "abc", "abc\0\0", "abcd", "", "漢字😀漢字😀漢字", "abcde", "xabcde"]
    hashes, starts = line_dedup.shingle_hashes(texts)
    sets = [frozenset(hashes[a:z].tolist()) for a, z in zip(starts[:-1], starts[1:])]
    cut = lambda x: frozenset(x[k : k + 5] for k in range(len(x) - 4)) or frozenset([x])
    assert [len(s) for s in sets] == [len(cut(t)) for t in texts]
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(cut(x) & cut(y))
    many = ["".join(random.Random(i).choice("abcdefgh ") for _ in range(i % 90)) + "." for i in range(900)]
    whole = line_dedup.band_values(many)
    assert (whole == np.concatenate([line_dedup.band_values([t]) for t in many])).all()


def test_extremes_are_those_of_all_shingles_of_a_line():
    # a piece with lines of every number of columns; each of the four orders by brute force
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdefgh äß漢") for _ in range(n)) for n in (0, 3, 5, 70, 200, 1, 900, 64, 5000, 40_000, 68, 2200)]
    found, many = line_dedup._extremes(texts), line_dedup.BANDS * line_dedup.ROWS // 4
    hashes, starts = line_dedup.shingle_hashes(texts)
    for i, (a, z) in enumerate(zip(starts[:-1], starts[1:])):
        x = hashes[a:z].copy()
        parts = [x.astype(np.uint32)]
        for odd in line_dedup._ODDS:
            parts.append((x >> np.uint64(32)).astype(np.uint32))
            x = x * odd
        value, want = parts[3].copy(), []
        for k in range(many):
            value = value + parts[k % 4]
            want.append([value.min(), value.max(), value.view(np.int32).min().astype(np.uint32), value.view(np.int32).max().astype(np.uint32)])
        assert (found[i].ravel() == np.array(want, np.uint32).T.ravel()).all()


def test_only_shared_bands_are_looked_at():
    band = np.array([9, 4, 9, 7, 1, 4, 9], np.uint64)
    values, places = line_dedup._shared(band)
    assert values.tolist() == [4, 4, 9, 9, 9] and sorted(places.tolist()) == [0, 1, 2, 5, 6] and (band[places] == values).all()
    assert all(len(x) == 0 for x in line_dedup._shared(np.array([3, 2], np.uint64)))


def test_lines_are_counted_and_placed_by_one_pass_over_the_texts(spark):
    docs = docs_of(spark, ["one line\n \nof text", "one line\nof text\nof text", None, ""])
    rows = line_dedup.line_dedup(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "text" not in plan
    assert sorted((r.doc_id, r.n_lines, r.removed) for r in rows.collect()) == [(0, 2, []), (1, 3, [0, 1, 2]), (2, 0, []), (3, 0, [])]
    known = {(r.doc_id, p.line_no, p.k1, p.k2) for r in line_dedup.documents(docs).collect() for p in r.places}
    assert known == {(r.doc, r.line_no, r.k1, r.k2) for r in line_dedup.lines(docs).collect()}


def test_rows_without_an_identity_of_their_own_lose_no_line(spark):
    older, other, alone = ("the line that stands in an older text", "a line that only the second one has", "nobody else says this at all")
    docs = docs_of(spark, [older, f"{older}\nfirst of seven", f"{other}\nsecond of seven", None, alone, f"{older}\nno id here"], ids=[1, 7, 7, 7, None, None])
    rows = {r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    # null counts as the smallest id, so its copy of the older line is the one that stays
    assert rows == {"", "first of seven", f"{other}\nsecond of seven", None, alone, f"{older}\nno id here"}
    twice = line_dedup.line_dedup(docs_of(spark, ["a b c\nd e f", "a b c\nd e f", "a b c\nx y z"], ids=[2, 2, 3])).collect()
    assert sorted((r.doc_id, r.removed) for r in twice) == [(2, []), (2, []), (3, [0])]


def test_texts_meet_their_removed_lines_without_a_forced_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        kept = line_dedup.without_repeated_lines(docs_of(spark, ["one line of text\nsome other", "one line of text", None]))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "one line of text\nsome other"), (1, ""), (2, None)]
    finally:
        spark.conf.set(name, before)


def test_lines_of_unlike_texts_with_one_half_of_the_key(spark, monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(6)]
    found = line_dedup.lines(docs_of(spark, ["\n".join([*base, *(x + "!" for x in base)])]))
    # every key is shared by two unlike lines
    clashing = found.withColumn("k1", F.pmod(F.col("line_no"), F.lit(6)).cast("long") + F.when(F.col("line_no") < 6, 0).otherwise(100))
    clashing = clashing.withColumn("k1", F.floor(F.col("k1") / 2).cast("long"))
    first = clashing.select(F.col("line_no").cast("long").alias("id"), "k1", "k2", "doc")
    one = lambda texts: np.full((len(texts), 1), 7, np.uint64)
    rows = line_dedup.groups_of_similar(clashing, first, 0.75, one).collect()
    assert {(r.node, r.component) for r in rows} == {(i, i % 6) for i in range(12)}


def test_long_lines(spark):
    rng = random.Random(3)
    x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    rows = line_dedup.line_dedup(docs_of(spark, [x, "short", x[:-1] + "#", x[::-1]])).collect()
    assert {r.doc_id: r.removed for r in rows} == {0: [], 1: [], 2: [0], 3: []}


def test_lines_without_spaces_differ_at_the_start(spark):
    rng = random.Random(7)
    paths = ["".join(rng.choice("abcdefghijklmnop/") for _ in range(60)) for _ in range(60)]
    lines = [f"http://{p}" for p in paths] + [f"https://{p}" for p in paths]
    assert len(removed_of(spark, lines)) >= 57


@pytest.mark.parametrize(("low", "high"), [(5, 8), (9, 14), (20, 40)])
@pytest.mark.parametrize("least", [0.75, 0.8, 0.9])
def test_recall_of_fuzzy_lines_by_length_and_likeness(low, high, least):
    rng = random.Random(8)
    cut = lambda x: frozenset(x[k : k + 5] for k in range(len(x) - 4))
    pairs = []
    while len(pairs) < 250:
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(rng.randint(low, high))]
        x = " ".join(words)
        y = list(x)
        for _ in range(rng.randint(1, 1 + len(x) // 40)):
            y[rng.randrange(len(y))] = "#"
        y = "".join(y)
        j = len(cut(x) & cut(y)) / len(cut(x) | cut(y))
        if least <= j < least + (0.05 if least < 0.9 else 0.1):
            pairs.append((x, y))
    placed = [set(row.tolist()) for row in line_dedup.band_values([line for pair in pairs for line in pair])]
    met = sum(bool(placed[2 * i] & placed[2 * i + 1]) for i in range(len(pairs)))
    # at 0.75, 28 bands of 7 rows find 98.2 of 100 pairs
    assert met >= 0.955 * len(pairs), met


def test_edges_of_joins(spark):
    docs = edge_docs(spark)
    n = docs.count()
    assert ngram_join.jaccard_components(docs).count() == n and line_dedup.line_dedup(docs).count() == n
    empty = docs.limit(0)
    assert ngram_join.jaccard_components(empty).count() == 0 and line_dedup.line_dedup(empty).count() == 0
    assert token_shards.token_shards(empty).count() == 0 and piece_codec.encoded(empty).count() == 0
    assert ngram_join.one_of_each_group(docs).columns == docs.columns == line_dedup.without_repeated_lines(docs).columns
    by_id = {r.doc_id: r for r in ngram_join.jaccard_components(docs).collect()}
    assert by_id[5].component_id == by_id[6].component_id == 5 and by_id[None].component_id is None
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (0, 1, 2))


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    rng = np.random.default_rng(2)
    k = len(quality_rank.FEATURES)
    rows = [(i, int(i % 5 > 0), rng.normal(i % 5 > 0, 1, k).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, quality int, x array<double>").repartition(3)
    # every document stands in a pair: the good are four times the bad, and all of them are in the sums
    gaps = quality_rank._pairs(df, np.zeros(k), np.ones(k), 2).collect()
    x, label = np.clip([r[2] for r in rows], -8, 8), np.array([r[1] for r in rows])
    near = {tuple(np.round(g - b, 6)) for g in x[label == 1] for b in x[label == 0]}
    assert len(gaps) == 720 and {tuple(np.round(g[0], 6)) for g in gaps} <= near
    monkeypatch.setattr(quality_rank, "RANGE_ROWS", 100)
    found = quality_rank.rank(df)
    assert np.allclose(found.mean, np.mean([r[2] for r in rows], 0)) and np.allclose(found.spread, np.std([r[2] for r in rows], 0), atol=1e-5)
    raw = found.raw(np.array([r[2] for r in rows]))
    wrong = lambda cut: (raw[label == 1] < cut).sum() + (raw[label == 0] > cut).sum()
    ordered = np.sort(raw)
    assert wrong(found.cut) == min(wrong(c) for c in (ordered[1:] + ordered[:-1]) / 2)
