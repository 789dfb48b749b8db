"""Periodic run detection: tiles per octave of periods, boundary Z-functions, fragments stitched by document and period.

A run is a stretch of words with smallest period q that no neighbour extends and that holds
at least four periods (and LEAST words). For the octave of periods q in [2**k, 2**(k+1)) a
document is laid out in tiles around boundaries 2**(k+1) words apart that reach 2**(k+2)
words to both sides, so neighbours overlap. The places i with word[i] == word[i + q] of a run
are at least 3q consecutive ones, so they hold a boundary, and the tiles of all boundaries
that they hold cover them without a gap. A tile is solved by itself: the Z-function of the
words after the boundary says how far the words repeat q places on, that of the words before
it, read backwards, how far they did so earlier. What a tile sees is a fragment of such
places; fragments meet by document and period and are stitched where they touch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relgraph.llm.shingle_sets import _ODD, _SPACE, pieces, scramble, word_spans
from relgraph.session import cut

PERIODS = 4
"""Periods that a run holds at least."""

LEAST = 6
"""Words that a run has at least."""

_GRAM = 8

_SOLVED = "row long, doc_id long, text string, collapsed_sha256 string, fragments array<struct<period:long,first:long,last:long>>"
_RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of ``n`` places: a tenth of the documents get a periodic end.

    With h the CRC-32 of the decimal id and g = h // 10, documents with h % 10 == 0 repeat the
    p words from a = g % n on, p = 1 + (n - a) // (3 + g % 8). A null id gets none.
    """
    places = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    places[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return places


def z_values(s: list[int]) -> list[int]:
    """For every place of ``s`` how many values from there on equal those at its start."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of twice as many words from those of ``width`` words; incomplete ones equal no other."""
    twice = scramble(~np.arange(len(hashes), dtype=np.uint64))
    whole = max(len(hashes) - width, 0)
    twice[:whole] = scramble(hashes[:whole] * _ODD + hashes[width:])
    return twice


def _boundaries(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (b, q), size <= q < 2 * size, of a tile boundary and a distance at which its gram occurs again."""
    step = 2 * size
    rows = -(-len(grams) // step)
    padded = np.zeros(rows * step, np.uint64)
    padded[: len(grams)] = grams
    tiles = padded.reshape(rows, step)
    row, at = np.nonzero(tiles[:, size:] == tiles[:, :1])
    b, q = row * step, size + at
    inside = b + q < len(grams)
    return b[inside], q[inside]


class _Covers:
    """Stretches known to have some smaller period."""

    def __init__(self):
        self.starts, self.ends = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, fragments: list[tuple[int, int, int]]) -> None:
        """fragments: period, first and last place; those of one period that touch are joined."""
        spans, now = [], None
        for q, first, last in sorted(fragments):
            if now and now[0] == q and first <= now[2]:
                now[2] = max(now[2], last)
            else:
                now = [q, first, last]
                spans.append(now)
        starts = np.append(self.starts, [s for _, s, _ in spans]).astype(np.int64)
        ends = np.append(self.ends, [e + q for q, _, e in spans]).astype(np.int64)
        order = np.argsort(starts, kind="stable")
        self.starts, self.ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends

    def hold(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, low, "right") - 1
        known = at >= 0
        known[known] = self.ends[at[known]] >= high[known]
        return known


def _solve_tile(keys: np.ndarray, low: int, high: int, b: int, size: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
    """Fragments (period, first, last + 1) of the places around boundary ``b`` of a document's words [low, high).

    Left out are those that end on both sides within the tile and are too short for a run.
    """
    reach = 4 * size
    ahead = z_values(keys[b : min(high, b + reach + 2 * size)].tolist())
    left, top = max(low, b - reach), min(high, b + 2 * size)
    before = keys[left:b][::-1].tolist()
    back = z_values([*before, -1, *keys[left:top][::-1].tolist()])
    for q in periods:
        if b + q >= high:
            continue
        on, ago = min(ahead[q], reach), min(back[len(before) + 1 + top - b - q], reach)
        if on == reach or ago == reach or on + ago >= (PERIODS - 1) * q:
            yield q, b - ago, b + on


def fragments(keys: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Fragments (period, first, last + 1) of all documents whose words lie end to end in ``keys``.

    keys: one integer a word, equal only for equal words of one document; bounds: the
    documents' borders. A tile is solved where the gram at its boundary, as long as every run
    of the octave has left there, occurs again at a distance of the octave. It isn't where a
    smaller period holds in all of the tile (twice the greatest period, or the whole rest of
    the document, on both sides): by Fine and Wilf a run there with a larger period would have
    the smaller one too.
    """
    found: list[tuple[int, int, int]] = []
    covers = _Covers()
    longest = int(np.diff(bounds).max()) if len(bounds) > 1 else 0
    grams, width, size = scramble(keys.astype(np.uint64)), 1, 1
    while PERIODS * size <= longest:
        if width < min(size, _GRAM):
            grams, width = _grams(grams, width), 2 * width
        b, q = _boundaries(grams, size)
        of = np.searchsorted(bounds, b, "right") - 1
        low, high = bounds[of], bounds[of + 1]
        new = ~covers.hold(np.maximum(low, b - 4 * size), np.minimum(high, b + 4 * size))
        b, q, low, high = b[new], q[new], low[new], high[new]
        here: list[tuple[int, int, int]] = []
        tiles = np.flatnonzero(np.diff(b, prepend=-1))
        for i, j in zip(tiles, [*tiles[1:], len(b)]):
            here.extend(_solve_tile(keys, int(low[i]), int(high[i]), int(b[i]), size, q[i:j].tolist()))
        covers.add(here)
        found.extend(here)
        size *= 2
    return found


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The words between the given places, without what parts them."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    packed = np.ascontiguousarray(data[~_SPACE[data]])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words and no others."""
    return packed_words(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _placed(text: str | None, doc_id: int | None) -> list[bytes]:
    """The words of a text after planting; bytes.split parts at the same six characters."""
    words = (text or "").encode().split()
    places = planted(doc_id, len(words))
    return words if doc_id is None else [words[i] for i in places.tolist()]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("collapsed_sha256", pa.string()),
        ("fragments", pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))),
    ])
    for batch in batches:
        ids, texts = batch.column(1).to_pylist(), batch.column(2)
        for first, data, offsets in pieces(texts):
            n = len(offsets) - 1
            starts, ends = word_spans(data, offsets)
            keys = _word_keys(data, starts, ends)
            bounds = np.searchsorted(starts, offsets)
            for i in range(n):
                a, z = int(bounds[i]), int(bounds[i + 1])
                keys[a:z] = keys[a:z][planted(ids[first + i], z - a)] + (i << 40)
            of: dict[int, list[tuple[int, int, int]]] = {}
            for q, left, right in fragments(keys, bounds):
                i = int(np.searchsorted(bounds, left, "right")) - 1
                of.setdefault(i, []).append((q, left - int(bounds[i]), right - int(bounds[i])))
            rows = []
            for i in range(n):
                text, doc_id = texts[first + i].as_py(), ids[first + i]
                row = {"row": batch.column(0)[first + i].as_py(), "doc_id": doc_id, "text": None, "collapsed_sha256": None}
                if i in of:
                    row |= {"text": text, "fragments": [dict(zip(("period", "first", "last"), f)) for f in of[i]]}
                else:
                    row |= {"collapsed_sha256": _digest(_placed(text, doc_id)), "fragments": []}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)


def stitched(found: DataFrame) -> DataFrame:
    """row, period, start and length (words) of the stretches that touching fragments make up.

    found: row, period, first, last (exclusive). Only stretches long enough for a run are kept.
    """
    earlier = Window.partitionBy("row", "period").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "period").orderBy("first", "last")
    parted = found.withColumn("_new", F.when(F.col("first") <= F.max("last").over(earlier), 0).otherwise(1))
    numbered = parted.withColumn("_part", F.sum("_new").over(upto))
    spans = numbered.groupBy("row", "period", "_part").agg(F.min("first").alias("start"), F.max("last").alias("last"))
    length = F.col("last") - F.col("start") + F.col("period")
    return spans.select("row", "period", "start", length.alias("length")).where(
        F.col("length") >= F.greatest(F.lit(LEAST), PERIODS * F.col("period"))
    )


def smallest_periods(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) that lie in no run of a smaller period, by start, then period.

    A stretch of four periods inside one of a smaller period has that smaller period as well.
    """
    kept: list[tuple[int, int, int]] = []
    covers = _Covers()
    for q, same in groupby(sorted(runs, key=lambda r: r[2]), key=lambda r: r[2]):
        these = list(same)
        low = np.array([s for s, _, _ in these])
        inside = covers.hold(low, low + np.array([n for _, n, _ in these]))
        kept.extend(r for r, known in zip(these, inside) if not known)
        covers.add([(q, s, s + n - q) for s, n, _ in these])
    return sorted(kept, key=lambda r: (r[0], r[2]))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _RESULT.split(", ")]
    kinds = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
    schema = pa.schema([(name, kinds.get(name, pa.int64())) for name in names])
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            runs = smallest_periods([(r["start"], r["length"], r["period"]) for r in row["runs"] or []])
            collapsed = row["collapsed_sha256"]
            if collapsed is None:
                words = _placed(row["text"], row["doc_id"])
                drop = np.zeros(len(words) + 1, np.int64)
                for s, n, q in runs:
                    drop[s + q] += 1
                    drop[s + n] -= 1
                gone = np.cumsum(drop)[:-1] > 0
                collapsed = _digest([words[i] for i in np.flatnonzero(~gone).tolist()])
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
            s, n, q = best
            milli = 1000 * n // q if q else None
            rows.append((row["doc_id"], len(runs), s, n, q, milli, hashlib.sha256(listed.encode()).hexdigest(), collapsed))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of ``docs``.

    docs: doc_id, text; other columns are not read. Null and empty texts have no words and no
    runs: four nulls and the digests of nothing. Rows are solved one by one, so repeated rows
    and ids each get a row; a null doc_id gets no planted end. Of equal exponents the run of
    the smallest start counts, then that of the smallest period. An empty table gives no rows.

    The tiles of a text are solved by the task that reads it, which holds some 60 bytes for
    each of its words; only fragments, and the texts that have any, are staged and shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    solved = cut(rows.mapInArrow(_solved, _SOLVED), "tiles")
    found = solved.select("row", F.inline("fragments"))
    runs = stitched(found).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    some = solved.where(F.size("fragments") > 0).drop("fragments").join(runs, "row", "left")
    none = solved.where(F.size("fragments") == 0).drop("fragments").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    return some.unionByName(none).select("doc_id", "text", "collapsed_sha256", "runs").mapInArrow(_finished, _RESULT)
