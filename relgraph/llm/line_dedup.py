"""Line dedup: fuzzy lines by MinHash over character shingles, one line of each component stays.

Made with built-in functions only, this operator did not meet its limits: the minima of all
hash functions have to be shuffled with every line, so only few rows a band could be paid
for, and with three rows lines that have little in common shared bands by the million. Signatures
are made in numpy here, beside the line, and only bands move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relgraph.llm import native
from relgraph.llm.components import components
from relgraph.llm.shingle_sets import _ODD, scramble
from relgraph.session import cut

CHARS = 5
"""Characters of the shingles, of the signature and of the exact test."""

BANDS, ROWS = 28, 7
SIMILARITY = 0.75
SMALL = 32
"""Lines of a bucket that are all tested pair by pair at once; in larger buckets lines meet the bucket's
smallest first, then those of other components (exactly, see `other_pairs`)."""

ARROW_ROWS = 2000
"""Lines, pairs or groups of postings in one Arrow batch."""

BROADCAST_ROWS = 1_000_000
"""Up to so many line keys (40 MB) are sent to the executors; more are joined by a shuffle."""

_FIRST = -(1 << 63)
_POSTINGS = 1 << 19
_LONGS = 8
_BAND_BYTES, _KEY_BYTES = 5, 6
_PIECE = 1 << 18
_SHINGLES = 1 << 16
"""Shingles whose hash functions are worked out together, so that they stay in a core's cache."""
_HEIGHT, _TOGETHER = 64, 32
_ODDS = np.random.default_rng(11).integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)


def _text_key() -> Column:
    return F.xxhash64(F.lit(3), "text")


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def lines(docs: DataFrame) -> DataFrame:
    """doc, t, line_no, line and its key (k1, k2) of every line with a word.

    A document is its id (null counts as the smallest) and the hash t of its text, so rows that
    share an id, or have none, are told apart. The key is 128 bits of hash; equal keys mean equal lines.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    split = docs.select(
        doc.alias("doc"), _text_key().alias("t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")
    )
    return split.where(_has_word(F.col("line"))).select(
        "doc", "t", "line_no", "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")
    )


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, doc, t and places (line_no, k1, k2 of every line with a word) of every row, as `lines` has them."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))

    def place(line: Column, no: Column) -> Column:
        key = F.struct(no.alias("line_no"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"))
        return F.when(_has_word(line), key)

    each = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), place)
    return docs.select("doc_id", doc.alias("doc"), _text_key().alias("t"), F.filter(each, lambda x: x.isNotNull()).alias("places"))


# --- signatures --------------------------------------------------------------------------------


def _scramble_in(x: np.ndarray, spare: np.ndarray) -> None:
    """`scramble` in place; spare: an array as large, for what stands between."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=spare)
        x ^= spare
        if factor > 1:
            x *= np.uint64(factor)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of CHARS characters of the lines one behind another, where each line's begin, and how many it has.

    Runs that begin in the last characters of a line reach into the next and belong to none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    filled = "".join(t if len(t) >= CHARS else t + "\0" * (CHARS - len(t)) for t in texts)
    codes = np.frombuffer(filled.encode("utf-32-le", "surrogatepass"), np.uint32)
    long = np.maximum(sizes, CHARS)
    at = np.cumsum(long) - long
    n = max(len(codes) - CHARS + 1, 0)
    hashes = np.empty(n, np.uint64)
    for a in range(0, n, _SHINGLES // 2):
        x = hashes[a : a + _SHINGLES // 2]
        m, wide = len(x), codes[a : a + len(x) + CHARS - 1].astype(np.uint64)
        np.left_shift(wide[:m], np.uint64(42), out=x)
        spare = wide[1 : m + 1] << np.uint64(21)
        x |= spare
        x |= wide[2 : m + 2]
        _scramble_in(x, spare)
        np.left_shift(wide[3 : m + 3], np.uint64(21), out=spare)
        spare |= wide[4 : m + 4]
        spare *= _ODD
        x += spare
        _scramble_in(x, spare)
    short = np.flatnonzero(sizes < CHARS)
    hashes[at[short]] = scramble(hashes[at[short]] + sizes[short].astype(np.uint64) + np.uint64(1))
    return hashes, at, long - CHARS + 1


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of CHARS characters of the lines, and where each line's begin.

    A shorter line is its only shingle. The mixing is a bijection of three and of two
    characters each, so no pattern in a text makes unlike shingles equal.
    """
    hashes, at, counts = _hashed(texts)
    inside = np.ones(len(hashes) + CHARS - 1, bool)
    for k in range(1, CHARS):
        inside[at[1:] - k] = False
    return hashes[inside[: len(hashes)]], np.concatenate([[0], np.cumsum(counts)])


def _columns(counts: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, Callable]:
    """Lines folded into columns of a height: of each column its line and the place in it, and what brings columns back together.

    Lines of few columns come first, the longest before the others: all first columns, then all second ones,
    so what lies behind one another is taken together. The columns of a longer line stand in a row.
    """
    columns = -(-counts // height)
    order = np.argsort(-columns, kind="stable")
    order = np.concatenate([order[columns[order] <= _TOGETHER], order[columns[order] > _TOGETHER]])
    many = columns[order]
    few = int((many <= _TOGETHER).sum())
    levels = [int(x) for x in np.searchsorted(-many[:few], -np.arange(many[0] if few else 0), "left")]
    firsts = np.cumsum(many[few:]) - many[few:]
    line = np.concatenate([order[:x] for x in levels] + [np.repeat(order[few:], many[few:])])
    inner = np.repeat(np.arange(len(levels)), levels), np.arange(many[few:].sum()) - np.repeat(firsts, many[few:])

    def together(values: np.ndarray, of: np.ufunc) -> np.ndarray:
        found = np.empty((len(values), len(order)), values.dtype)
        at = 0
        for k, x in enumerate(levels):
            if k:
                of(found[:, :x], values[:, at : at + x], out=found[:, :x])
            else:
                found[:, :x] = values[:, :x]
            at += x
        if few < len(order):
            found[:, few:] = of.reduceat(values[:, at:], firsts, axis=1)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return found.T[back]

    return line, np.concatenate(inner), together


def _extremes(texts: list[str]) -> np.ndarray:
    """BANDS rows of ROWS values for each line, each the first of its shingles in an order of its own.

    A hash function of the shingles is a ring, which is cut at zero and at the half; the first and the
    last value behind either cut are four such orders. The functions are sums of four hashes of
    a shingle, each the one before and one of the four. The last column of a line repeats its last shingle, which
    changes nothing.
    """
    hashes, at, counts = _hashed(texts)
    height = int(np.clip(counts.mean(), 8, _HEIGHT))
    line, inner, together = _columns(counts, height)
    top, end = at[line] + inner * height, (at + counts - 1)[line]
    many, width = BANDS * ROWS // 4, _SHINGLES // height
    ends = [(np.minimum, np.uint32), (np.maximum, np.uint32), (np.minimum, np.int32), (np.maximum, np.int32)]
    found = [np.empty((many, len(top)), kind) for _, kind in ends]
    for c in range(0, len(top), width):
        place = top[c : c + width] + np.arange(height)[:, None]
        np.minimum(place, end[c : c + width], out=place)
        x = hashes[place]
        parts = [x.astype(np.uint32)]
        for odd in _ODDS:
            parts.append((x >> np.uint64(32)).astype(np.uint32))
            x *= odd
        value = parts[3].copy()
        views = [value.view(kind) for _, kind in ends]
        for k in range(many):
            value += parts[k % 4]
            for (of, _), view, to in zip(ends, views, found):
                of.reduce(view, axis=0, out=to[k, c : c + width])
    return np.concatenate([together(v, of).view(np.uint32) for v, (of, _) in zip(found, ends)], axis=1).reshape(len(texts), BANDS, ROWS)


def band_values(texts: list[str]) -> np.ndarray:
    """BANDS values for each line: the minima of ROWS hash functions each, over all of its shingles, mixed to 64 bits."""
    # once such a block was freed, the C library keeps freed memory for the next piece instead of handing it back
    np.empty(4 * _PIECE, np.uint64)
    bands = np.empty((len(texts), BANDS), np.uint64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _PIECE):
            size += len(texts[last])
            last += 1
        rows = _extremes(texts[first:last]).astype(np.uint64)
        mixed = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (last - first, BANDS))
        for r in range(0, ROWS, 2):
            two = rows[:, :, r] if r + 1 == ROWS else rows[:, :, r] << np.uint64(32) | rows[:, :, r + 1]
            mixed = scramble(mixed * _ODD + two)
        bands[first:last] = mixed
        first = last
    return bands


def _packed(keys: np.ndarray, bands: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """For each group of bands its postings: 5 bytes of the band and 6 of the line's key each."""
    flat, key = bands.ravel(), np.repeat(keys, bands.shape[1])
    group = ((flat >> np.uint64(32)) % np.uint64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int64)  # two bytes are sorted by counting
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=groups))
    for g, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        if z > a:
            here = order[a:z]
            yield g, _low_bytes(flat[here], _BAND_BYTES) + _low_bytes(key[here], _KEY_BYTES)


def _low_bytes(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_low_bytes(data: list[bytes], n: int) -> np.ndarray:
    wide = np.zeros((sum(map(len, data)) // n, 8), np.uint8)
    wide[:, :n] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, n)
    return wide.view("<u8").ravel()


def _postings(groups: int, banding: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, str] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(held, np.int64, len(held))
            rows = list(_packed(keys, banding(list(held.values())), groups))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["g", "blob"])

        for batch in batches:
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key not in held:
                    held[key] = line
                    size += len(line)
                if size > 16 * _PIECE:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _shared(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that stand more than once, ascending, and their places."""
    if len(band) < 1 << (64 - 8 * _BAND_BYTES):
        bits = np.uint64(64 - 8 * _BAND_BYTES)
        both = band << bits | np.arange(len(band), dtype=np.uint64)
        both.sort()
        band, at = both >> bits, (both & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    else:
        at = np.argsort(band)
        band = band[at]
    same = np.zeros(len(band) + 1, bool)
    same[1:-1] = band[1:] == band[:-1]
    kept = same[1:] | same[:-1]
    return band[kept], at[kept]


def _met(small: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """Pairs (a, b) of a group's buckets; of larger buckets pairs with the smallest key, and members (a, band)."""
        blobs = [b.as_py() for b in table.column("blob")]
        ends = [len(b) // (_BAND_BYTES + _KEY_BYTES) * _BAND_BYTES for b in blobs]
        band = _from_low_bytes([b[:e] for b, e in zip(blobs, ends)], _BAND_BYTES)
        packed = np.frombuffer(b"".join(b[e:] for b, e in zip(blobs, ends)), np.uint8).reshape(-1, _KEY_BYTES)
        band, at = _shared(band)
        key = _from_low_bytes([packed[at].tobytes()], _KEY_BYTES).astype(np.int64)
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
        band, key = band[new], key[new]
        starts = np.flatnonzero(np.append(len(band) > 0, band[1:] != band[:-1]))
        sizes = np.diff(np.append(starts, len(band)))
        one, two, of = [], [], []
        for n in np.unique(sizes[(sizes > 1) & (sizes <= small)]).tolist():
            rows = key[starts[sizes == n][:, None] + np.arange(n)]
            x, y = np.triu_indices(n, 1)
            one.append(rows[:, x].ravel())
            two.append(rows[:, y].ravel())
        large = np.repeat(sizes > small, sizes)
        least = np.repeat(key[starts], sizes)
        star = large & (least != key)
        one.append(least[star])
        two.append(key[star])
        of.append(key[large])
        pairs = (np.concatenate(one), np.concatenate(two))
        members = np.concatenate(of)
        group = np.uint64(table.column("g")[0].as_py())
        bucket = scramble(band[large] ^ scramble(np.full(len(members), group + np.uint64(1), np.uint64)))
        return pa.table({
            "a": pa.array(np.concatenate([pairs[0], members]), pa.int64()),
            "b": pa.concat_arrays([pa.array(pairs[1], pa.int64()), pa.nulls(len(members), pa.int64())]),
            "band": pa.concat_arrays([pa.nulls(len(pairs[0]), pa.int64()), pa.array(bucket.view(np.int64), pa.int64())]),
        })

    return run


def buckets(found: DataFrame, groups: int, banding: Callable = band_values, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of short keys to test first, and key, k of the lines of larger buckets.

    Lines stay where they are; each task sends what it has for a group of bands as one row, 11
    bytes for each line and band. A group has some half a million postings. k: 6 bytes of k1;
    unlike lines that share them are told apart when pairs meet their texts.
    """
    rows = found.select("k1", "line").mapInArrow(_postings(groups, banding), "g int, blob binary")
    met = cut(rows.groupBy("g").applyInArrow(_met(small), "a long, b long, band long"), "buckets")
    pairs = met.where("band is null").select("a", "b").distinct()
    return pairs, met.where("band is not null").select(F.col("band").alias("key"), F.col("a").alias("k"))


# --- pairs -------------------------------------------------------------------------------------


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each line, ascending, and where each line's begin."""
    hashes, starts = shingle_hashes(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
        hashes[a:z].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def _alike(similarity: float) -> Callable:
    def checked(pairs: list[tuple[int, str, str]]) -> list[int]:
        number: dict[str, int] = {}
        for _, left, right in pairs:
            number.setdefault(left, len(number))
            number.setdefault(right, len(number))
        hashes, at = shingle_sets(list(number))
        kept = []
        for i, left, right in pairs:
            a, b = number[left], number[right]
            n, m = int(at[a + 1] - at[a]), int(at[b + 1] - at[b])
            # common >= similarity * union, and the smaller set holds all that is common
            if min(n, m) >= similarity * max(n, m):
                both = np.concatenate([hashes[at[a] : at[a + 1]], hashes[at[b] : at[b + 1]]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common >= similarity * (n + m - common):
                    kept.append(i)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, held, size = [], [], 0
            for i, (left, right) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                held.append((i, left, right))
                size += len(left) + len(right)
                if size > _PIECE:
                    kept += checked(held)
                    held, size = [], 0
            rows = pa.array(kept + (checked(held) if held else []), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in (0, 1)], names=["a", "b"])

    return run


def similar(pairs: DataFrame, texts: DataFrame, similarity: float, by: str = "id") -> DataFrame:
    """The pairs of ids (a, b) whose exact similarity is high enough; texts: id, line and ``by``, by which pairs name lines."""
    sides = pairs.join(texts.select(F.col(by).alias("a"), F.col("id").alias("x"), F.col("line").alias("left")), "a").join(
        texts.select(F.col(by).alias("b"), F.col("id").alias("y"), F.col("line").alias("right")), "b"
    )
    return sides.where("x != y").select("x", "y", "left", "right").mapInArrow(_alike(similarity), "a long, b long")


def mixed_keys(rows: DataFrame) -> DataFrame:
    """key and most (the component of most of its lines, any of them at a tie) of the keys with lines of several components.

    rows: key, id, component.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", "n").alias("most"), F.count("*").alias("parts"))
    return largest.where("parts > 1").select("key", "most")


def cross_pairs(rows: DataFrame, mixed: DataFrame, possible: Column) -> DataFrame:
    """All pairs (a, b) of lines that share a key but no component and that are ``possible``, once each.

    One line of such a pair is not of the key's largest component, so only those lines meet
    the key's others: lines of one large group are not paired with each other. ``possible``
    names the columns of one line as they are and of the other with x_ before; it is part of the join,
    so other pairs are no rows.
    """
    rest = rows.join(mixed, "key").where("component != most").drop("most")
    rest = rest.select("key", *[F.col(c).alias(f"x_{c}") for c in rows.columns if c != "key"])
    pairs = rest.join(rows, "key").where((F.col("component") != F.col("x_component")) & possible)
    return pairs.select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct()


def may_be_alike(similarity: float) -> Column:
    """False only for pairs whose similarity is too low, by what is known without their sets.

    n: size of the set; at: the place of the shared shingle in the common order; bits0 ..: 512
    bits, each the parity of the shingles that fall on it. Two sets differ in at least as many
    shingles as their bits do, and alike ones in a share of (1 - similarity) / (1 + similarity)
    of both sizes at most. Of the first shingle that two sets share, no more than those behind it
    are shared as well, and alike sets share similarity / (1 + similarity) of both sizes.
    """
    both, apart = F.col("n") + F.col("x_n"), sum(F.bit_count(F.col(f"bits{k}").bitwiseXOR(F.col(f"x_bits{k}"))) for k in range(_LONGS))
    behind = F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at"))
    return (
        (F.least("n", "x_n") >= similarity * F.greatest("n", "x_n") - 1e-6)
        & (behind >= similarity / (1 + similarity) * both - 1e-6)
        & (apart <= (1 - similarity) / (1 + similarity) * both + 1e-6)
    )


def other_pairs(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines of larger buckets that may be alike and that are in different components.

    Taken are the lines of buckets with several components. Two of them are a pair if they
    share one of their rarest shingles: of n shingles, all but ceil(similarity * n) - 1, in an order
    that is the same for all lines, and if sizes, places and parities allow it (`may_be_alike`).
    Lines that are alike enough always do, so none is lost. rows: key, id, component.
    """
    open_rows = cut(rows.join(mixed_keys(rows).select("key"), "key").select("id", "component").distinct(), "open")
    sets = open_rows.join(texts.select("id", "line"), "id")
    known = cut(sets.select("id", "line").mapInArrow(_known_sets, "id long, s long, bits array<long>"), "sets")
    each, known = known.select("id", "s"), known.where("bits is not null")
    rarity = each.groupBy("s").agg(F.count("*").alias("df"))
    ordered = each.join(rarity, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("all"))
    ordered = ordered.withColumn("n", F.size("all"))
    needed = F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int")
    prefix = ordered.select("id", "n", F.posexplode(F.slice("all", F.lit(1), F.col("n") - needed + 1)).alias("at", "x")).where("x.df > 1")
    known = open_rows.join(known.select("id", *[F.col("bits")[k].alias(f"bits{k}") for k in range(_LONGS)]), "id")
    refined = cut(known.join(prefix, "id").select(F.col("x.s").alias("key"), "id", "component", "n", "at", *[f"bits{k}" for k in range(_LONGS)]), "refined")
    return cross_pairs(refined, mixed_keys(refined), may_be_alike(similarity))


def _known_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each line; its first row has the parities that `may_be_alike` asks for."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            hashes, starts = shingle_sets(batch.column(1).to_pylist())
            bit, word = np.uint64(1) << (hashes & np.uint64(63)), hashes >> np.uint64(6) & np.uint64(_LONGS - 1)
            bits = [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), starts[:-1]) for k in range(_LONGS)]
            first = np.zeros(len(hashes), bool)
            first[starts[:-1]] = True
            ends = np.concatenate([[0], np.cumsum(first) * _LONGS]).astype(np.int32)
            parities = pa.ListArray.from_arrays(ends, pa.array(np.column_stack(bits).view(np.int64).ravel()), mask=pa.array(~first))
            ids = pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(starts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes.view(np.int64)), parities], names=["id", "s", "bits"])


def _checked(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def groups_of_similar(found: DataFrame, first: DataFrame, similarity: float, banding: Callable = band_values, small: int = SMALL) -> DataFrame:
    """node (a line's id) and component of the lines that are like another.

    first: id, k1, k2 and doc (the line's first document) of every distinct line. Every
    pair that shares a bucket is tested, or its lines are in one component already.
    """
    with native.arrow_rows(found.sparkSession, ARROW_ROWS):
        return _groups_of_similar(found, first, similarity, banding, small)


def _groups_of_similar(found: DataFrame, first: DataFrame, similarity: float, banding: Callable, small: int) -> DataFrame:
    spark = found.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-first.count() * BANDS // _POSTINGS))
    pairs, members = buckets(found, groups, banding, small)
    pairs = cut(pairs, "pairs")
    # the text of each line in some pair, from the first document that has it
    keys = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    short = F.col("k1").bitwiseAND(F.lit((1 << 8 * _KEY_BYTES) - 1))
    wanted = cut(first.withColumn("k", short).join(keys, "k", "left_semi"), "wanted")
    n = wanted.count()
    texts = found.select("doc", "k1", "k2", "line").join(_checked(wanted, n), ["doc", "k1", "k2"]).select("id", "k", "line")
    texts = cut(texts.dropDuplicates(["id"]), "texts")
    same = texts.groupBy("k").count().where("count > 1").select(F.col("k").alias("a"), F.col("k").alias("b"))
    grouped = cut(components(similar(pairs.unionByName(same), texts, similarity, "k")), "grouped")
    rows = members.join(_checked(wanted.select("k", "id"), n), "k").select("key", "id")
    rows = rows.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    rows = cut(rows, "members")
    if mixed_keys(rows).isEmpty():
        return grouped
    late = similar(other_pairs(rows, texts, similarity), texts, similarity)
    return components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, banding: Callable = band_values, small: int = SMALL, known: DataFrame | None = None) -> DataFrame:
    """doc, t and line_no of every line that is a copy, exact or fuzzy, of a line that stays.

    Of each component the line of the smallest document (by id, then by t) stays, and there the first.
    known: `documents` of docs, where they are written already.
    """
    known = cut(documents(docs).drop("doc_id"), "documents") if known is None else known
    places = known.select("doc", "t", F.inline("places"))
    first = places.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    first = cut(first.withColumn("id", F.monotonically_increasing_id()), "lines")
    grouped = cut(groups_of_similar(lines(docs), first.drop("n"), similarity, banding, small), "groups")
    members = first.join(grouped.withColumnRenamed("node", "id"), "id", "left")
    shared = members.where("component is not null or n > 1")
    groups = cut(shared.select("k1", "k2", F.coalesce("component", "id").alias("component")), "shared")
    at = places.join(_checked(groups, groups.count()), ["k1", "k2"])
    at = cut(at.select("component", F.struct("doc", "t", "line_no").alias("place")), "at")
    homes = at.groupBy("component").agg(F.min("place").alias("home"))
    return at.join(homes, "component").where("place != home").select("place.*")


def _of_documents(docs: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    gone = removed_lines(docs, similarity, known=known)
    return gone.groupBy("doc", "t").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (ascending line numbers from 0) of every row of ``docs``.

    docs: doc_id, text; other columns are not read. Lines are what \\n separates; lines without
    a word are neither counted nor removed. Null and empty texts have no lines. A document is a
    row's id and text: rows that share an id but not the text, and rows without an id, are
    documents of their own, while rows that are equal in both are one document and get the
    same result. Equal lines are one line, so ties need no rule. An empty table gives no rows.
    A line is held whole, at some 60 bytes for each of its characters while it is hashed.
    """
    known = cut(documents(docs), "documents")
    counted = known.select("doc_id", "doc", "t", F.size("places").cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(_of_documents(docs, similarity, known), ["doc", "t"], "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the repeated lines taken out of their texts; null stays null.

    Documents, lines, nulls, ties and empty tables are as in `line_dedup`; every row and all
    its columns stay, whatever their names. What goes is as many rows as there are documents with
    repeated lines, so texts meet it by their key in a shuffle, unless it is below Spark's own bound.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    keyed = docs.select(row, doc.alias("doc"), _text_key().alias("t"))
    gone = cut(_of_documents(docs, similarity), "removed")
    rest = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    changed = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(rest)
    return keyed.join(gone, ["doc", "t"], "left").select(
        *[changed.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
