"""Quality classifier: Bradley-Terry ranking learned from pairs of a good and a bad document."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.llm.shingle_sets import _DOWN, _UP, _VALUE, pieces, scramble, word_spans
from relgraph.session import cut
from relgraph.skew import RANGE_ROWS

THRESHOLD = 0.3
"""Score from which a document counts as good."""

BUCKET = 4096
"""Labelled documents among which pairs are made, about."""

BROADCAST_IDS = 1_000_000

_STEPS = 15
_RIDGE = 1e-3

#: Byte classes whose shares are features.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "bang": b"!?",
    "mark": b".,;:",
    "quote": b"\"'()[]{}=+_/\\@~^`-",
    "space": b" \t\r\v\f",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate(_CLASSES.values(), 1):
    _CLASS[list(_bytes)] = _i
_N_CLASSES = len(_CLASSES) + 1

FEATURES = [*_CLASSES, "no_text", "log_words", "few_words", "word_bytes", "distinct", "echo", "top_word", "line_words", "dup_lines"]


class _Spans:
    """64-bit hashes of spans of some bytes, from sums that are made once."""

    def __init__(self, data: np.ndarray):
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _UP.upto(len(data)), out=self.upto[1:])
        self.down = _DOWN.upto(len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return scramble((self.upto[ends] - self.upto[starts]) * self.down[starts])


def _distinct_share(keys: np.ndarray) -> tuple[float, float]:
    """Distinct keys and the most frequent one's, as shares of all."""
    _, counts = np.unique(keys, return_counts=True)
    return len(counts) / len(keys), counts.max() / len(keys)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text; null counts as empty."""
    found = np.zeros((len(texts), len(FEATURES)))
    for first, data, offsets in pieces(texts):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        of_text = np.repeat(np.arange(n), sizes)
        counts = np.bincount(of_text * _N_CLASSES + _CLASS[data], minlength=n * _N_CLASSES).reshape(n, -1)
        rows = found[first : first + n]
        rows[:, : _N_CLASSES - 1] = counts[:, 1:] / np.maximum(sizes, 1)[:, None]
        starts, ends = word_spans(data, offsets)
        keys = _Spans(data)
        words = keys(starts, ends)
        breaks = np.flatnonzero(data == 10)
        at, line_at = np.searchsorted(starts, offsets), np.searchsorted(breaks, offsets)
        for i in range(n):
            a, b = at[i], at[i + 1]
            here = rows[i, _N_CLASSES - 1 :]
            here[0] = a == b
            here[1] = np.log1p(b - a)
            here[2] = 1 / (1 + b - a)
            if a == b:
                continue
            here[3] = (ends[a:b] - starts[a:b]).mean()
            share, top = _distinct_share(words[a:b])
            # longer texts repeat more words; the square root keeps the share comparable
            here[4] = share * np.sqrt(min(b - a, 400) / 400)
            here[5] = (words[a + 1 : b] == words[a : b - 1]).mean() if b - a > 1 else 0
            here[6] = top if b - a > 9 else 0
            inner = breaks[line_at[i] : line_at[i + 1]]
            heads, tails = np.append(offsets[i], inner + 1), np.append(inner, offsets[i + 1])
            filled = tails > heads
            here[7] = np.log1p((b - a) / len(heads))
            here[8] = 1 - _distinct_share(keys(heads[filled], tails[filled]))[0]
    return found


@dataclass
class Ranking:
    """Weights of the standardised features; raw score ``cut`` is scored THRESHOLD."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        z = np.clip((raw - self.cut) * self.scale, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights


def _matrix(rows: pa.Array, width: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what ``part`` (``size`` numbers) makes of them; of each task only its sum reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    parts = [r[0] for r in rows.mapInArrow(run, "total array<double>").collect()]
    return np.array([math.fsum(column) for column in zip(*parts)]) if parts else np.zeros(size)


def _pairs(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, buckets: int) -> DataFrame:
    """Standardised good minus bad features of pairs in which every document stands.

    Rows are dealt to buckets by the hash of their id; in a bucket the documents of the label
    with fewer are repeated in turn.
    """

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("quality", "ascending")])
        z = np.clip((_matrix(table.column("x").combine_chunks(), len(mean)) - mean) / spread, -8, 8)
        label = table.column("quality").to_numpy()
        good, bad = z[label == 1], z[label == 0]
        n = max(len(good), len(bad)) if len(good) and len(bad) else 0
        gap = np.resize(np.arange(len(good)), n), np.resize(np.arange(len(bad)), n)
        return pa.table({"gap": pa.array(list(good[gap[0]] - bad[gap[1]]), pa.list_(pa.float64()))})

    bucket = F.pmod(F.xxhash64("id", F.lit("pairs")), F.lit(buckets))
    return rows.groupBy(bucket.alias("bucket")).applyInArrow(pair, "gap array<double>")


def rank(rows: DataFrame) -> Ranking | None:
    """Fit P(i before j) = sigmoid(w . (x_i - x_j)) to pairs of a good i and a bad j, by Newton's method.

    rows: id, quality, x (features). All of them count, in the means, in the pairs and in the
    threshold, which is a quantile of their scores, see `_cut`. None without rows.
    """
    k = len(FEATURES)
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    n = sum(counts.values())
    if not n:
        return None
    mean = _sums(rows.select("x"), k, lambda x: x.sum(0), k) / n
    spread = np.sqrt(_sums(rows.select("x"), k, lambda x: ((x - mean) ** 2).sum(0), k) / n) + 1e-6
    weights = np.zeros(k)
    if len(counts) == 2:
        buckets = max(1, min(-(-n // BUCKET), min(counts.values()) // 64))
        gaps = cut(_pairs(rows, mean, spread, buckets), "pairs")

        def fit(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def part(gap: np.ndarray) -> np.ndarray:
                ahead = gap @ w
                lost = 1 / (1 + np.exp(np.clip(ahead, -30, 30)))
                bend = (gap * (lost * (1 - lost))[:, None]).T @ gap
                return np.concatenate([[len(gap), np.logaddexp(0, -ahead).sum()], -(gap * lost[:, None]).sum(0), bend.ravel()])

            found = _sums(gaps, k, part, 2 + k + k * k)
            pairs = max(found[0], 1)
            slope, bend = found[2 : 2 + k] / pairs, found[2 + k :].reshape(k, k) / pairs
            return found[1] / pairs + _RIDGE / 2 * w @ w, slope + _RIDGE * w, bend + _RIDGE * np.eye(k)

        loss, slope, bend = fit(weights)
        move = -np.linalg.solve(bend, slope)
        for _ in range(_STEPS):
            tried = fit(weights + move)
            if tried[0] > loss:
                move = move / 2
                continue
            gained, weights = loss - tried[0], weights + move
            loss, slope, bend = tried
            move = -np.linalg.solve(bend, slope)
            if gained < 1e-6:
                break
    # what the order of adding changes is cut off
    ranking = Ranking(np.round(mean, 9), np.round(spread, 9), np.round(weights, 6), 0.0, 1.0)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking.raw(_matrix(batch.column(1), k))), batch.column(0)], names=["raw", "quality"])

    scores = cut(rows.select("quality", "x").mapInArrow(raw, "raw double, quality int"), "scores")
    ranking.cut = _cut(scores, n, n - counts.get(1, 0))
    ranking.scale = float(1 / (scores.agg(F.stddev_pop("raw")).first()[0] + 1e-6)) * 2
    return ranking


def _cut(scores: DataFrame, n: int, n_bad: int) -> float:
    """The quantile of the scores that parts the labels best.

    Best has the fewest documents on the wrong side; of equal quantiles, the one nearest the
    share of bad documents. The cut lies half-way to the next score. Scores are cut into ranges
    by their value; a range is numbered on its own, and the driver sees a row for each.
    """
    values = scores.groupBy("raw").agg(F.count("*").alias("n"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    ranged = cut(values.repartitionByRange(max(1, -(-n // RANGE_ROWS)), "raw").withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("range").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("raw").alias("first"))
    every = Window.orderBy("range")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        "range", F.lead("first").over(every).alias("after"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bad")],
    )
    inside = Window.partitionBy("range").orderBy("raw")
    upto = [(F.col(f"{c}_before") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in ("n", "bad")]
    after = F.coalesce(F.lead("raw").over(inside), F.col("after")).alias("next")
    places = ranged.join(F.broadcast(shifts), "range").select("raw", after, *upto)
    wrong = F.lit(n_bad) - F.col("bad_upto") + F.col("n_upto") - F.col("bad_upto")
    rated = places.where(F.col("next").isNotNull()).select(
        F.struct(wrong.alias("wrong"), F.abs(F.col("n_upto") - n_bad).alias("off"), "n_upto", "raw", "next").alias("place")
    )
    best = rated.agg(F.min("place").alias("place")).first()["place"]
    return float(scores.first()["raw"]) if best is None else (best["raw"] + best["next"]) / 2


def held_out() -> Column:
    """True for the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> Ranking | None:
    """A ranking from all labelled documents that are not held out; None without any.

    labels: doc_id, quality. Up to BROADCAST_IDS labels are sent to the texts; more meet the
    texts' features by a shuffle, never the texts.
    """
    usable = (
        labels.where(~held_out()).where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    )
    usable = cut(usable, "labels")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(list(features(batch.column(0))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[1:]], names=["x", *batch.schema.names[1:]])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    if usable.count() <= BROADCAST_IDS:
        texts = docs.select("text", "doc_id").join(F.broadcast(usable), "doc_id").select("text", "doc_id", "quality")
        rows = texts.mapInArrow(measured, f"x array<double>, doc_id {id_type}, quality int")
    else:
        rows = docs.select("text", "doc_id").mapInArrow(measured, f"x array<double>, doc_id {id_type}").join(usable, "doc_id")
    return rank(cut(rows.select(F.col("doc_id").alias("id"), "quality", "x"), "features"))


def scored(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """doc_id and score of every whole text; THRESHOLD for all if nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = ranking.score(features(batch.column(1))) if ranking else np.full(batch.num_rows, THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of ``docs``.

    docs: doc_id, text; labels: doc_id, quality; other columns are not read. Null and empty
    texts are scored by the same features, all of them zero but for the lack of words. A null
    doc_id is held out; several labels of one document count as the best of them; repeated
    rows each get a row; an empty table gives none.
    """
    found = scored(docs, learn(docs, labels))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
