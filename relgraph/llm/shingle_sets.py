"""Sets of hashed word shingles from batches of UTF-8 bytes, with numpy.

Words are runs of bytes other than ASCII white space; only A-Z are lower-cased. A word's
hash is a sum of random values for its bytes times powers of an odd number, modulo 2**64,
and a shingle's hash a sum over its words' scrambled hashes, scrambled again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
_BYTES = 1 << 20
_SEED = np.random.default_rng(7)
_VALUE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_PLACE = _SEED.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, _BYTES + 1), self.base)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known[:n]


_UP, _DOWN = _Powers(_ODD), _Powers(_INVERSE)


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about a megabyte: first row, bytes, and the texts' offsets."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    filled = texts.fill_null("")
    filled = filled.combine_chunks() if isinstance(filled, pa.ChunkedArray) else filled
    _, offset_buffer, data_buffer = filled.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    row = 0
    while row < len(filled):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses a text's border."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    starts = inside[1:-1] > inside[:-2]
    ends = inside[1:-1] > inside[2:]
    border = offsets[(offsets > 0) & (offsets < len(data))]
    starts[border] = inside[border + 1] > 0
    ends[border - 1] = inside[border] > 0
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ascending distinct shingle hashes of every text; fewer words make one shingle."""
    for first, data, offsets in pieces(texts):
        starts, ends = word_spans(data, offsets)
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _UP.upto(len(data)), out=upto[1:])
        hashes = scramble((upto[ends] - upto[starts]) * _DOWN.upto(len(data) + 1)[starts])
        many = len(hashes) - size + 1
        shingles = np.zeros(max(many, 0), np.uint64)
        for k in range(size):
            shingles += hashes[k : k + len(shingles)] * _PLACE[k]
        shingles = scramble(shingles)
        at = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= size:
                yield first + i, np.unique(shingles[a : b - size + 1])
            elif b > a:
                short = (hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
                yield first + i, scramble(np.array([short + np.uint64(b - a)], np.uint64))
            else:
                yield first + i, np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values that equal sets share."""
    one = scramble(shingles + np.uint64(0x51)).sum(dtype=np.uint64)
    two = scramble(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))
