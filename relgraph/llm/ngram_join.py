"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

With a similarity of t, documents A and B with n_A and n_B shingles can link only if they
share at least T = ceil(t * max(n_A, n_B)) of them. If every document's shingles stand in one
common order, and the first n - T + K of each are its short lists, two linked documents share
at least min(K_A, K_B) short lists. So a candidate must occur that often when a document's
short lists are merged; its long lists are then only probed for the candidates.

Steps, each exact:

1.  Documents with equal sets are one class from here on.
2.  In the order of the shingles' hashes, a document that shares too few of its short lists
    with anybody has no partner and leaves. This is most of a corpus.
3.  The others' lists are ordered rarest first, so passages that many documents share come
    last and are probed, never merged.
4.  Each document is first probed against one list head, the document with the fewest
    shingles of its own. Groups of near copies become components by that.
5.  Documents of different components are searched in full.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.llm import native
from relgraph.llm.components import components
from relgraph.llm.shingle_sets import set_key, shingle_sets

NUM, DEN = 3, 4
"""Similarity threshold as a fraction."""

BROADCAST_ROWS = 1_000_000
"""Up to so many ids (16 MB) are sent to the executors; more are joined by a shuffle."""

_COMBINE = 1024
"""Documents whose postings are combined before the shuffle."""

_CHUNK = 512
"""Entries in one part of an inverted list."""


def needed(n: int) -> int:
    """T: common shingles that a partner must have at least."""
    return -(-NUM * n // DEN)


def first_k(n: int) -> int:
    """K of the hash order: 15 %, so that a shared passage alone keeps few documents."""
    return max(1, 15 * n // 100)


def rare_k(n: int) -> int:
    """K of the order by rarity."""
    return max(1, min(needed(n), 2 + n // 50))


def _hash_order_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document a row of counts, and its short lists in hash order as postings.

    Rows: ``h`` and ``doc`` (w = 0) a posting; ``h`` (w = -1) a list that two documents of this
    batch are on; ``doc``, ``w`` > 0 lists of the document that are known to be shared. So a
    list that very many documents are on sends one row per batch.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, _COMBINE):
            batch = whole.slice(at, _COMBINE)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            seen: dict[tuple, int] = {}
            parts, owners = [], []
            for row, shingles in shingle_sets(batch.column(1)):
                key = set_key(shingles)
                n = len(shingles)
                if n > 1 and seen.setdefault(key, row) == row:
                    parts.append(shingles[: n - needed(n) + first_k(n)])
                    owners.append(np.full(len(parts[-1]), ids[row]))
            if not parts:
                continue
            lists, docs = np.concatenate(parts).view(np.int64), np.concatenate(owners)
            _, at_list, inverse, counts = np.unique(lists, return_index=True, return_inverse=True, return_counts=True)
            common = counts[inverse] > 1
            credited, credit = np.unique(docs[common], return_counts=True)
            marks = lists[at_list][counts > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([lists[~common], marks, credited])),
                    pa.array(np.concatenate([docs[~common], np.zeros(len(marks), np.int64), credited])),
                    pa.array(
                        np.concatenate(
                            [np.zeros((~common).sum(), np.int32), np.full(len(marks), -1, np.int32), credit.astype(np.int32)]
                        )
                    ),
                ],
                names=["h", "doc", "w"],
            )


def _sizes_and_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(len(s), *set_key(s)) for _, s in shingle_sets(batch.column(1))]
        n, one, two = np.array(found, np.int64).reshape(-1, 3).T
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(one), pa.array(two)], names=["doc", "n", "key1", "key2"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [s.view(np.int64) for _, s in shingle_sets(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["c", "shingles"])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists of each batch: a shingle and the documents that have it."""
    for whole in batches:
        for at in range(0, whole.num_rows, _COMBINE):
            batch = whole.slice(at, _COMBINE)
            sets = batch.column(1)
            lists = sets.flatten().to_numpy(zero_copy_only=False)
            owners = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(sets).to_numpy(zero_copy_only=False))
            order = np.argsort(lists, kind="stable")
            lists, owners = lists[order], owners[order]
            begin = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else np.zeros(0, np.int64)
            docs = pa.ListArray.from_arrays(pa.array(np.append(begin, len(lists)), pa.int32()), pa.array(owners))
            yield pa.RecordBatch.from_arrays([pa.array(lists[begin]), docs], names=["h", "docs"])


def _merge_short_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates that occur often enough on a document's short lists, by a heap merge.

    Of the two documents, the one whose short lists end first in the common order shares with
    the other only these and some of its own long lists. So the occurrences and the longer of the
    two rests together bound the overlap, which must reach NUM / (NUM + DEN) of both sizes.
    """
    for batch in batches:
        a, b = [], []
        for c, n, rest, lists in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            last, count = None, 0
            merged = heapq.merge(*(sorted((e["c"], e["n"], e["long"]) for e in one) for one in lists))
            for entry in [*merged, None]:
                if entry == last:
                    count += 1
                    continue
                if last is not None:
                    size, long = last[1:]
                    reached = (NUM + DEN) * (count + max(rest, long)) >= NUM * (n + size)
                    if reached and count >= min(rare_k(n), rare_k(size)):
                        a.append(c)
                        b.append(last[0])
                last, count = entry, 1
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among candidate pairs: the smaller set is looked up in the larger, sorted one."""
    for batch in batches:
        linked = []
        left, right = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            x, y = (np.asarray(col[i].values).view(np.uint64) for col in (left, right))
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            if DEN * common >= NUM * (len(x) + len(y) - common):
                linked.append(i)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(linked, pa.int64())), batch.column(1).take(pa.array(linked, pa.int64()))],
            names=["a", "b"],
        )


def _checked(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a staged table, whose sets are similar enough.

    Only sets that some pair needs are moved.
    """
    rows = pairs.count()
    left = sets.select(F.col("c").alias("a"), F.col("shingles").alias("left")).join(_checked(pairs, rows), "a")
    wanted = pairs.select("b").distinct()
    right = sets.select(F.col("c").alias("b"), F.col("shingles").alias("right")).join(_checked(wanted, rows), "b", "left_semi")
    return left.join(right, "b").select("a", "b", "left", "right").mapInArrow(_probe, "a long, b long")


def _t(n: Column) -> Column:
    return F.ceil(F.lit(NUM) * n / DEN)


def _first_k(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(15 * n / 100))


def _rare_k(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(_t(n), 2 + F.floor(n / 50)))


def with_possible_partner(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Documents that share enough short lists in hash order to have a partner (step 2).

    A partner has at least T shingles, so the smallest K that a pair can be held to is K(T).
    """
    rows = docs.mapInArrow(_hash_order_postings, "h long, doc long, w int").where("h is not null").repartition("h")
    on_list = Window.partitionBy("h")
    shared = (
        (F.min(F.expr("if(w = 0, doc, null)")).over(on_list) != F.max(F.expr("if(w = 0, doc, null)")).over(on_list))
        | (F.min("w").over(on_list) < 0)
    )
    credit = rows.withColumn("shared", shared).where("w > 0 or (w = 0 and shared)").select("doc", F.greatest("w", F.lit(1)).alias("w"))
    total = credit.groupBy("doc").agg(F.sum("w").alias("shared"))
    met = total.join(sizes.select("doc", "n").distinct(), "doc")
    return met.where(F.col("shared") >= _first_k(_t(F.col("n")))).select("doc").distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Size and class of every document, and edges that connect all linked classes.

    docs: doc, text. First result: doc, n, rep (the smallest doc with the same set; the
    document itself if it has no word). Second: pairs of reps (a, b), each of them a link,
    with a path for every link there is.
    """
    with native.arrow_rows(docs.sparkSession, _COMBINE):
        return _links_of_all(docs)


def _links_of_all(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sizes = native.staged(docs.mapInArrow(_sizes_and_keys, "doc long, n long, key1 long, key2 long"))
    keys = ["n", "key1", "key2"]
    reps = sizes.where("n > 0").groupBy(*keys).agg(F.min("doc").alias("rep"))
    classes = sizes.where("n > 0").join(reps, keys).select("doc", "n", "rep")
    classes = native.staged(classes.unionByName(sizes.where("n = 0").select("doc", "n", F.col("doc").alias("rep"))))

    possible = with_possible_partner(docs, sizes)
    chosen = native.staged(possible.join(classes, "doc").select(F.col("rep").alias("doc")).distinct())
    texts = docs.join(_checked(chosen, chosen.count()), "doc").select("doc", "text")
    sets = native.staged(texts.mapInArrow(_sets, "c long, shingles array<long>").dropDuplicates(["c"]))

    batches = sets.mapInArrow(_inverted, "h long, docs array<long>")
    df = F.sum(F.size("docs")).over(Window.partitionBy("h"))
    ranked = (
        batches.withColumn("df", df)
        .where("df > 1")
        .select("h", "df", F.explode("docs").alias("c"))
        .groupBy("c")
        .agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("lists"))
        .join(sets.select("c", F.size("shingles").cast("long").alias("n")), "c")
        .withColumn("own", F.col("n") - F.size("lists"))
        # own shingles are on no other list and stand first
        .withColumn("short", F.col("n") - _t(F.col("n")) + _rare_k(F.col("n")) - F.col("own"))
        .where(F.col("short") >= _rare_k(_t(F.col("n"))))
        # own shingles are in no overlap, so they bound the size of a partner
        .withColumn("most", F.floor((NUM + DEN) * (F.col("n") - F.col("own")) / NUM) - F.col("n"))
        .where(DEN * F.col("most") >= NUM * F.col("n"))
        .withColumn("long", F.greatest(F.lit(0), F.size("lists") - F.col("short")))
    )
    short = native.staged(
        ranked.select("c", "n", "most", "long", (F.col("own") / F.col("n")).alias("odd"),
                      F.explode(F.slice("lists", F.lit(1), F.col("short").cast("int"))).alias("x"))
        .select("c", "n", "most", "long", "odd", F.col("x.h").alias("h"))
    )

    heads = short.groupBy("h").agg(F.min(F.struct("odd", "c")).alias("head"))
    votes = short.join(heads, "h").where(F.col("c") != F.col("head.c")).groupBy("c", F.col("head.c").alias("b")).count()
    best = votes.groupBy("c").agg(F.max(F.struct("count", -F.col("b"))).alias("best"))
    star = best.select(F.col("c").alias("a"), (-F.col("best.col2")).alias("b"))
    first = native.staged(_links(native.staged(star), sets))

    grouped = native.staged(components(first))
    labelled = short.join(grouped.withColumnRenamed("node", "c"), "c", "left").withColumn(
        "component", F.coalesce("component", "c")
    )
    mixed = labelled.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    open_lists = native.staged(labelled.join(mixed.select("h"), "h").select("h", "c", "n", "most", "long", "component"))
    # inverted lists in parts of about _CHUNK entries
    parts = open_lists.groupBy("h").agg(F.ceil(F.count("*") / _CHUNK).alias("parts"))
    inverted = (
        open_lists.join(parts, "h")
        .groupBy("h", F.pmod(F.xxhash64("c"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("c", "n", "most", "long", "component")).alias("entries"))
    )
    others = F.filter(
        "entries",
        lambda e: (e["component"] != F.col("component"))
        & (e["c"] < F.col("c"))
        & (DEN * e["n"] >= NUM * F.col("n"))
        & (e["n"] <= F.col("most"))
        & (NUM * F.col("n") <= DEN * e["n"])
        & (F.col("n") <= e["most"]),
    )
    queries = (
        open_lists.join(inverted, "h")
        .select("c", "n", "long", F.transform(others, lambda e: F.struct(e["c"], e["n"], e["long"])).alias("others"))
        .where(F.size("others") > 0)
        .groupBy("c", "n", "long")
        .agg(F.collect_list("others").alias("lists"))
    )
    candidates = queries.select("c", "n", "long", "lists").mapInArrow(_merge_short_lists, "a long, b long").distinct()
    second = _links(native.staged(candidates), sets)
    return classes, native.staged(first.unionByName(second))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    docs: doc_id, text; other columns are not read. Documents link at a Jaccard similarity of
    0.75 or more between their sets of five-word shingles. Null, empty and wordless texts have
    the empty set and link with nothing; fewer than five words are one shingle. Repeated rows
    get a row each; rows of one id with unlike texts are one document, whose set is that of one
    of the texts. Rows with a null doc_id take no part and get a null component. An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    classes, edges = links(rows.where("doc is not null"))
    found = components(edges).select(F.col("node").alias("rep"), "component")
    known = classes.join(found, "rep", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    unnamed = rows.where("doc is null").mapInArrow(_sizes_and_keys, "doc long, n long, key1 long, key2 long")
    return known.unionByName(
        unnamed.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that link, over others or not, with a smaller document.

    A document is a row's id and text (a 64-bit hash of both): rows that share an id but not
    the text, and rows without an id, are documents of their own and stay unless their own text
    links. Of a group the row of the smallest id stays (null is the smallest; then the
    smallest hash); of rows that are equal in id and text one stays. Texts without a word
    link with nothing. All columns are kept, whatever their names; an empty table gives none.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    slim = native.staged(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct().join(ids, "key"))
    least = slim.groupBy("component").agg(F.min(F.struct("id", "key")).alias("least"))
    marked = slim.join(least, "component").groupBy("key").agg(
        F.max(F.col("key") != F.col("least.key")).alias("gone"), F.count("*").alias("copies")
    )
    marked = native.staged(marked.where("gone or copies > 1"))
    known = _checked(marked, marked.count())
    met = keyed.join(known, "key", "left").where("gone is null or not gone")
    single, several = met.where("copies is null"), met.where("copies is not null")
    if not marked.where("not gone").isEmpty():
        single = single.unionByName(several.dropDuplicates(["key"]))
    return single.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
