"""Language ID by a byte convolutional network, trained and applied with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relgraph.llm.shingle_sets import pieces

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
UNDETERMINED = "und"

SAMPLE_PER_LANGUAGE = 600
"""Training documents per language: the bound of the labelled sample."""

TEXTS = 1024
"""Rows of an Arrow batch that are judged, and sent back, at a time."""

_WINDOWS_PER_DOCUMENT = 3
_EPOCHS = 12


@dataclass
class Network:
    """Filters as one table of 256 bytes for each place of each width, and a softmax layer."""

    tables: dict[tuple[int, int], np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    languages: list[str]


def _maps(net: Network, x: np.ndarray) -> list[np.ndarray]:
    """Filter responses at every place of every window, for each width."""
    found = []
    for width in WIDTHS:
        places = x.shape[1] - width + 1
        y = net.tables[width, 0][x[:, :places]]
        for j in range(1, width):
            y = y + net.tables[width, j][x[:, j : j + places]]
        found.append(y)
    return found


def _pooled(net: Network, maxima: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages from the pooled responses."""
    scores = np.maximum(maxima + net.bias, 0) @ net.out + net.out_bias
    scores = scores - scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def train(x: np.ndarray, label: np.ndarray, languages: list[str], seed: int = 11) -> Network:
    """Adam on the cross entropy; the pooled place of each filter carries its gradient."""
    rng = np.random.default_rng(seed)
    n_out, features = len(languages), FILTERS * len(WIDTHS)
    tables = {(w, j): rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for w in WIDTHS for j in range(w)}
    net = Network(
        tables,
        np.zeros(features, np.float32),
        rng.normal(0, 0.3, (features, n_out)).astype(np.float32),
        np.zeros(n_out, np.float32),
        languages,
    )
    moments: dict = {}
    turn = 0

    def update(name, value: np.ndarray, gradient: np.ndarray) -> None:
        one, two = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        one += 0.1 * (gradient - one)
        two += 0.01 * (gradient * gradient - two)
        value -= 0.02 * (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.99**turn)) + 1e-6)

    for _ in range(_EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            turn += 1
            rows = order[at : at + 64]
            batch, truth = x[rows], label[rows]
            maps = _maps(net, batch)
            places = [y.argmax(1) for y in maps]
            maxima = np.concatenate([y.max(1) for y in maps], axis=1)
            hidden = np.maximum(maxima + net.bias, 0)
            error = np.exp(_pooled(net, maxima))
            error[np.arange(len(rows)), truth] -= 1
            error /= len(rows)
            back = (error @ net.out.T) * (hidden > 0)
            for i, width in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(width):
                    gradient = np.zeros((256, FILTERS), np.float32)
                    byte = np.take_along_axis(batch, places[i] + j, 1)
                    np.add.at(gradient, (byte, np.arange(FILTERS)), part)
                    update((width, j), net.tables[width, j], gradient)
            update("bias", net.bias, back.sum(0))
            update("out", net.out, hidden.T @ error)
            update("out_bias", net.out_bias, error.sum(0))
    return net


class Applied:
    """The network with its neighbouring places joined into tables of byte pairs."""

    def __init__(self, net: Network):
        pair = lambda w, j: (net.tables[w, j][:, None, :] + net.tables[w, j + 1][None]).reshape(-1, FILTERS)
        self.net, self.two, self.three = net, pair(2, 0), pair(3, 0)
        self.four, self.end = (pair(4, 0), pair(4, 2)), net.tables[3, 2]

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for rows of WINDOW bytes."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        maxima = np.concatenate(
            [
                self.two[pairs].max(1),
                (self.three[pairs[:, :-1]] + self.end[windows[:, 2:]]).max(1),
                (self.four[0][pairs[:, :-2]] + self.four[1][pairs[:, 2:]]).max(1),
            ],
            axis=1,
        )
        return np.exp(_pooled(self.net, maxima))


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: bytes (the last of a text filled with 0), row, true length."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - start)
    place = np.arange(WINDOW)
    at = np.minimum(start[:, None] + place, max(len(data) - 1, 0))
    windows = np.where(place < length[:, None], data[at] if len(data) else 0, 0).astype(np.uint8)
    return windows, row, length


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each text, at random places of the whole text; one is cut short."""
    for batch in batches:
        lang, data = [], []
        for name, text, seed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            rng = np.random.default_rng(seed & 0xFFFFFFFF)
            for i in range(_WINDOWS_PER_DOCUMENT):
                start = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
                size = WINDOW if i else int(rng.integers(8, 80))
                lang.append(name)
                data.append(raw[start : start + size].ljust(WINDOW, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(data, pa.binary())], names=["lang", "window"])


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """A network from labelled texts (lang, text, key), of every language there is; None if there are none.

    Of each language about ``per_language`` documents are used, by the hash of their key; only
    their windows reach the driver, at most 3 * 256 bytes a document. The counts of the languages
    are broadcast, which is less than the network itself, with a row of weights for each.
    """
    usable = labelled.where("lang is not null and text is not null and text != ''")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.shiftrightunsigned(F.xxhash64("key", F.lit("sample")), 11) / F.lit(float(1 << 53))
    chosen = usable.join(F.broadcast(counts), "lang").where(share * F.col("n") < per_language)
    windows = chosen.select("lang", "text", F.xxhash64("key").alias("seed")).mapInArrow(
        _training_windows, "lang string, window binary"
    )
    rows = sorted((r["lang"], bytes(r["window"])) for r in windows.collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    label = np.array([languages.index(r[0]) for r in rows])
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, label, languages)


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _verdicts(applied: Applied | None, texts: pa.Array, lettered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a batch."""
    names = np.full(len(texts), UNDETERMINED, object)
    scores = np.zeros(len(texts))
    keep = lettered.to_numpy(zero_copy_only=False).astype(bool)
    if applied is None:
        return names, scores
    languages = np.array(applied.net.languages, object)
    for first, data, offsets in pieces(texts):
        windows, row, length = windows_of(data, offsets)
        n = len(offsets) - 1
        total = np.zeros((n, len(languages)))
        for at in range(0, len(windows), 512):
            part = slice(at, at + 512)
            np.add.at(total, row[part], applied(windows[part]) * length[part, None])
        best = total.argmax(1)
        here = keep[first : first + n]
        names[first : first + n][here] = languages[best[here]]
        score = total[np.arange(n), best] / np.maximum(total.sum(1), 1e-9)
        scores[first : first + n][here] = np.minimum(1.0, score[here])
    return names, scores


def accepted(docs: DataFrame, least: float = 0.35, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of at least ``least``.

    Null, empty and letterless texts go; every other row is judged by itself, so repeated rows
    stay or go together and ties need no rule. All columns are kept as they are, whatever their
    names; texts aren't shuffled; an empty table, or one with nothing to learn from, gives none.
    """
    net = learn(docs.where(~held_out()).select("lang", "text", F.col("doc_id").alias("key")), per_language)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    at = docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = Applied(net) if net else None
        for batch in (whole.slice(k, TEXTS) for whole in batches for k in range(0, whole.num_rows, TEXTS)):
            names, scores = _verdicts(applied, batch.column(0).field(at), batch.column(1))
            good = (names != UNDETERMINED) & (scores >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], names=["row"])

    rows = docs.select(row.alias("row"), _lettered().alias("lettered"))
    kept = rows.mapInArrow(chosen, rows.select("row").schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    A text's probabilities are the mean of its windows', weighted by their bytes. Null texts
    and texts without a letter are ``und`` with score 0, and so is all if nothing was learned.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = Applied(net) if net else None
        for batch in batches:
            names, scores = _verdicts(applied, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _lettered().alias("lettered"))
    return rows.mapInArrow(scored, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def language_id(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row for each row of ``docs``.

    docs: doc_id, text, lang; other columns are not read. Learns from rows with a language
    whose crc32(doc_id) mod 3 is not 1; a null doc_id is held out. Null, empty and letterless
    texts are ``und`` with score 0; repeated rows each get a row; an empty table gives none.
    """
    labelled = docs.where(~held_out()).select("lang", "text", F.col("doc_id").alias("key"))
    found = predicted(docs, learn(labelled, per_language))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
