"""SentencePiece encoding and decoding: Aho-Corasick automaton and single-pass Viterbi."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

SPACE = "▁"
"""What a space is inside pieces."""

_UNKNOWN_PENALTY = 10.0
_NEVER = float("-inf")
_CACHED_CHUNKS = 400_000


def _cuts(pieces: list[str]) -> str:
    """Pattern of the chunks that no piece reaches across.

    A run of SPACE is cut from what is before it, and a line break from all, if no piece
    holds such a place. So are Latin letters and digits from ASCII signs, but for the signs
    that some piece has next to one.
    """
    pairs = {(x, y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
    if any(y == SPACE != x for x, y in pairs) or any("\n" in pair for pair in pairs):
        return r"(?s).+"
    latin = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    is_latin = re.compile(f"[{latin}]").match
    signs = set("!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~'")
    signs -= {x for x, y in pairs if is_latin(y)} | {y for x, y in pairs if is_latin(x)}
    some = re.escape("".join(sorted(signs)))
    apart = rf"{SPACE}*[{latin}]+(?=[{some}{SPACE}\n]|$)|[{some}]+(?=[{latin}{SPACE}\n]|$)|" if signs else ""
    return rf"{apart}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"


class Codec:
    """Segmentation of the highest total score into the pieces of a model file.

    The text gets a space in front, spaces become SPACE, nothing else is normalised. The
    automaton visits each character once; at each position it lists, by its output links, the
    pieces that end there, and each relaxes the best score of its end. A character that is no
    piece scores less than any piece and becomes its UTF-8 bytes' pieces.

    The text is first cut at places that no piece, so no path, reaches across; the chunks' ids
    are remembered, up to a fixed number of chunks.
    """

    def __init__(self, model: str = MODEL):
        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        size = loaded.get_piece_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if size <= 1 << 16 else "I"
        self.automaton = ahocorasick.Automaton()
        self.bytes = np.zeros(256, self.dtype)
        self.texts: list[bytes] = []
        numbers, plain, scores = [], [], []
        for i in range(size):
            piece = loaded.id_to_piece(i)
            if loaded.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif loaded.is_unknown(i) or loaded.is_control(i) or loaded.is_unused(i):
                self.texts.append(b"")
            else:
                numbers.append(i)
                plain.append(piece)
                scores.append(loaded.get_score(i))
                self.texts.append(piece.replace(SPACE, " ").encode())
                self.automaton.add_word(piece, (i, len(piece), loaded.get_score(i)))
        self.automaton.make_automaton()
        self.longer = ahocorasick.Automaton()
        for i, piece, score in zip(numbers, plain, scores, strict=True):
            if len(piece) > 1:
                self.longer.add_word(piece, (i, len(piece), score))
        self.longer.make_automaton()
        ones = [score for piece, score in zip(plain, scores, strict=True) if len(piece) == 1]
        self.floor = max(ones, default=_NEVER) if max(scores) <= 0 else float("inf")
        self.characters = frozenset(p for p in plain if len(p) == 1)
        self.unknown = min(scores) - _UNKNOWN_PENALTY
        self.chunks = re.compile(_cuts(plain)).findall
        self.known: dict[str, bytes] = {}

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk, by Viterbi over the automaton's matches; of equal paths, the one
        whose last pieces are longer.

        No score is above 0, so a path that scores more than every piece of one character is
        the best without any of these; they are searched as well only if there is none.
        """
        n = len(chunk)
        best = [0.0] + [_NEVER] * n
        start_of, piece_of = [0] * (n + 1), [-1] * (n + 1)
        for last, (piece, length, score) in self.longer.iter(chunk):
            start = last + 1 - length
            total = best[start] + score
            if total >= best[last + 1] and (total > best[last + 1] or start < start_of[last + 1]):
                best[last + 1], start_of[last + 1], piece_of[last + 1] = total, start, piece
        if best[n] <= self.floor:
            self._search_all(chunk, best, start_of, piece_of)
        path = []
        while n:
            if piece_of[n] >= 0:
                path.append(piece_of[n])
            else:
                path.extend(reversed(self.bytes[list(chunk[n - 1].encode("utf-8", "replace"))].tolist()))
            n = start_of[n]
        path.reverse()
        return path

    def _search_all(self, chunk: str, best: list, start_of: list, piece_of: list) -> None:
        """The same search with pieces of one character, and with characters that are no piece."""
        n = len(chunk)
        best[1:], start_of[:], piece_of[:] = [_NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        known = self.characters.issuperset(chunk)
        here = 0
        for last, (piece, length, score) in self.automaton.iter(chunk):
            if not known and here < last:
                here = self._unknown(chunk, best, start_of, piece_of, here, last)
            end = last + 1
            start = end - length
            total = best[start] + score
            if total >= best[end] and (total > best[end] or start < start_of[end]):
                best[end], start_of[end], piece_of[end] = total, start, piece
        if not known:
            self._unknown(chunk, best, start_of, piece_of, here, n)

    def _unknown(self, chunk: str, best: list, start_of: list, piece_of: list, here: int, upto: int) -> int:
        """Relax the ends ``here + 1 .. upto`` by characters that are no piece."""
        for i in range(here, upto):
            if chunk[i] not in self.characters and best[i] + self.unknown > best[i + 1]:
                best[i + 1], start_of[i + 1], piece_of[i + 1] = best[i] + self.unknown, i, -1
        return upto

    def _new(self, chunk: str) -> bytes:
        ids = array(self.code, self.segment(chunk)).tobytes()
        if len(self.known) >= _CACHED_CHUNKS:
            self.known.clear()
        if len(chunk) <= 64:
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text; none for an empty one."""
        if not text:
            return b""
        known = self.known.get
        chunks = self.chunks(SPACE + text.replace(" ", SPACE))
        return b"".join([known(c) or self._new(c) for c in chunks])

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        text = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(2)
def codec(model: str) -> Codec:
    """The codec of a model file, one for each Python worker."""
    return Codec(model)


def encoded(docs: DataFrame, model: str = MODEL, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, unless left out), their digest, decoded digest and round_trip of every whole text.

    docs: doc_id, text; ``keep`` names further columns to carry along, others are not read. A
    null text has null ids, no tokens and is no round trip; an empty one has no ids and is one. A text
    that holds SPACE itself decodes to a space there, and is no round trip. Repeated rows
    each get a row; an empty table gives none. Only the model file must be readable by the
    executors.
    """
    keep = keep or []
    rows = docs.select("doc_id", "text", *keep)
    kept = rows.select("doc_id", *keep).schema
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_tokens long"] + ["ids array<int>"] * with_ids
    schema = ", ".join([*fields, "ids_sha256 string", "decoded_sha256 string", "round_trip boolean"])
    names = [*kept.names, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256", "round_trip"]
    types = [pa.int64(), *[pa.list_(pa.int32())] * with_ids, pa.string(), pa.string(), pa.bool_()]

    def coded(own: Codec, text: str | None) -> tuple:
        if text is None:
            return (0, *[None] * with_ids, None, None, False)
        ids = own.encode(text)
        back = own.decode(ids)
        listed = [np.frombuffer(ids, own.dtype).astype(np.int32)] if with_ids else []
        digest = hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()
        return (len(ids) // own.dtype.itemsize, *listed, hashlib.sha256(ids).hexdigest(), digest, back == text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = zip(*(coded(own, text) for text in batch.column(1).to_pylist()), strict=True)
                columns = [pa.array(c, t) for c, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], names=names)

    return rows.mapInArrow(run, schema)
