"""Token-id shards in training order: a keyed permutation gives every sequence its slot."""

from __future__ import annotations

import base64
import hashlib
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from relgraph.llm import native
from relgraph.llm.shingle_sets import scramble

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed by the vocabulary file: its pattern of words, and its first free id as end of text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256

#: Fixed by the pattern: what its white space is, as a character class.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

STRIDE = 1024
"""Tokens of a sequence; every sequence has as many."""

PER_SHARD = 2048
"""Sequences of a shard; the last has what is left."""

TEXTS = 4096
"""Texts of an Arrow batch that are held as strings at a time."""

DOCS_PER_BUCKET = 4000
BROADCAST_ROWS = 1_000_000
_ROUNDS = 6


@lru_cache(2)
def tokenizer(ranks: str) -> tiktoken.Encoding:
    """The tokenizer of a ranks file, one for each Python worker."""
    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


class _Words(dict):
    """Ids of words, as two bytes each, behind a fixed beginning; the first KNOWN short ones are remembered.

    A word of letters is one word of the pattern, and ASCII punctuation behind it another; so
    such a word is looked up without its punctuation, and merged without the pattern.
    """

    KNOWN, LONGEST = 800_000, 48
    LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch

    def __init__(self, encoding: tiktoken.Encoding, before: str):
        super().__init__()
        self.encode, self.merge, self.before = encoding._core_bpe.encode_ordinary, encoding._core_bpe.encode_single_piece, before
        self.ends: dict[str, bytes] = {"": b""}

    def _end(self, marks: str) -> bytes:
        ids = array("H", self.encode(marks)).tobytes()
        if len(marks) <= 8 and len(self.ends) < self.KNOWN // 100:
            self.ends[marks] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(string.punctuation)
        if not self.LETTERS(letters):
            ids = array("H", self.encode(self.before + word)).tobytes()
        elif len(letters) < len(word):
            marks = word[len(letters) :]
            return self[letters] + (self.ends.get(marks) or self._end(marks))
        else:
            ids = array("H", self.merge((self.before + word).encode())).tobytes()
        if len(self) < self.KNOWN and len(word) <= self.LONGEST:
            self[word] = ids
        return ids


class TextIds:
    """Ids of whole texts, two bytes each.

    No word of the pattern runs from other characters into white space. So where single blanks
    and line breaks are the only white space, a text is its words, those behind a blank
    together with it, and most have been seen before. A long run of white space is a word of
    its own but for its last character; the pattern, which can't take runs of a million
    characters, is not shown it.
    """

    TOGETHER = 1 << 23
    LONG_RUN = re.compile(f"[{SPACES}]{{1024,}}")
    UNEVEN = ["  ", "\n\n", " \n", "\n "] + [c for c in map(chr, range(0x3001)) if c not in " \n" and re.match(f"[{SPACES}]", c)]

    def __init__(self, ranks: str):
        self.encoding = tokenizer(ranks)
        self.first, self.behind_blank = _Words(self.encoding, ""), _Words(self.encoding, " ")
        self.line_break = array("H", self.encoding.encode_ordinary("\n")).tobytes()

    def _parts(self, text: str) -> bytes:
        found, at = [], 0
        for run in self.LONG_RUN.finditer(text):
            found.append(self.encoding.encode_ordinary(text[at : run.start()]))
            # the last character belongs to what follows, unless nothing does
            at = run.end() - (run.end() < len(text))
            found.append(self.encoding._encode_single_piece(text[run.start() : at]))
        found.append(self.encoding.encode_ordinary(text[at:]))
        return b"".join([array("H", ids).tobytes() for ids in found])

    def _even(self, text: str) -> bool:
        return not (not text or text[-1] in " \n" or text[0] in " \n" or any(c in text for c in self.UNEVEN))

    def _unit(self, unit: str) -> bytes:
        """Ids of what stands between two blanks; a text's first unit has a line break in front."""
        if "\n" not in unit:
            return self.behind_blank[unit]
        blank, *lines = unit.split("\n")
        starts = self.line_break.join([self.first[x] for x in lines])
        return self.behind_blank[blank] + self.line_break + starts if blank else starts

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order. Texts are taken some TOGETHER characters at a time, and a unit's ids looked up once for them."""
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= self.TOGETHER):
                size += len(texts[high])
                high += 1
            yield from self._together(texts[low:high])
            low = high

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        even = [self._even(t) for t in texts]
        joined = " ".join([f"\n{t}" for t, e in zip(texts, even) if e])
        try:
            units = pc.split_pattern(pa.array([joined], pa.large_string()), " ").values
        except UnicodeEncodeError:  # lone surrogates, which the tokenizer replaces
            yield from map(self, texts)
            return
        coded = units.dictionary_encode()
        known = self.behind_blank
        ids = pa.array([known[u] if "\n" not in u else self._unit(u) for u in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.large_binary())
        _, offsets, data = ids.take(coded.indices).buffers()
        at, run, unit = np.frombuffer(offsets, np.int64), memoryview(data or b""), 0
        for text, e in zip(texts, even):
            if e:
                after = unit + text.count(" ") + 1
                yield run[at[unit] : at[after]].tobytes()
                unit = after
            else:
                yield self._parts(text)

    def __call__(self, text: str) -> bytes:
        if not self._even(text):
            return self._parts(text)
        try:
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                lines.append(self.first[words[0]] + b"".join(map(self.behind_blank.__getitem__, words[1:])))
            return self.line_break.join(lines)
        except UnicodeEncodeError:  # lone surrogates, which the tokenizer replaces
            return self._parts(text)


@lru_cache(2)
def text_ids(ranks: str) -> TextIds:
    """One for each Python worker, so later tasks know the words of earlier ones."""
    return TextIds(ranks)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of the indexes in a keyed permutation of 0 .. n - 1.

    A Feistel network permutes the numbers of the smallest even width of bits that holds n; a
    place of n or more is permuted again until it is below (cycle walking). The width is less
    than two bits too many, so that takes fewer than four turns on average.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = scramble(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (scramble(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    place = once(index.astype(np.uint64))
    while (outside := place >= np.uint64(n)).any():
        place[outside] = once(place[outside])
    return place.astype(np.int64)


def packed(ids: bytes) -> bytes:
    """Ids of two bytes, all low bytes before all high ones, which pack better apart."""
    return zstandard.compress(np.frombuffer(ids, np.uint8).reshape(-1, 2).T.tobytes(), 3)


def unpacked(data: bytes) -> bytes:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, -1).T.tobytes()


def _rows(docs: DataFrame) -> DataFrame:
    """doc, tie and text of every text that isn't null."""
    return docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tie"), "text"
    )


def counted(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """bucket, doc, tie, n, copies and before of every text that isn't null; rows alike in id and text count as one.

    Documents are dealt to buckets by a hash of their id and text; within one they stand in
    order of these. ``n`` counts a document's tokens, ``before`` those that stand before its
    first copy in its bucket. The ids themselves aren't kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                n = [len(ids) // 2 + 1 for ids in ids_of.of_texts(batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64())], names=["doc", "tie", "n"])

    buckets = -(-docs.count() // DOCS_PER_BUCKET) or 1
    sizes = _rows(docs).mapInArrow(run, "doc long, tie long, n long")
    same = sizes.groupBy("doc", "tie").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    placed = same.select(F.pmod(F.xxhash64("doc", "tie"), F.lit(buckets)).alias("bucket"), "doc", "tie", "n", "copies")
    upto = Window.partitionBy("bucket").orderBy("doc", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("copies")).over(upto), F.lit(0)))


def _pieces(n: int, key: int, stride: int, ranks: str):
    """Tokenise documents, cut them where sequences end, and give each piece its sequence's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = text_ids(ranks), array("H", [END]).tobytes()
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(low, TEXTS)
                sequence, start, data = [], [], []
                for offset, ids in zip(batch.column(0).to_pylist(), ids_of.of_texts(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    at = 0
                    while at < len(ids):
                        first = offset + at // 2
                        size = 2 * (stride - first % stride)
                        sequence.append(first // stride)
                        start.append(first % stride)
                        data.append(packed(ids[at : at + size]))
                        at += size
                slot = permuted(np.array(sequence, np.int64), n, key)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(start, pa.int32()), pa.array(data, pa.binary())], names=["slot", "start", "packed"])

    return run


def _placed(docs: DataFrame, sizes: DataFrame, bases: DataFrame, buckets: int) -> DataFrame:
    """offset and text of every row; rows alike in id and text stand one after the other."""
    near = F.broadcast(bases) if buckets <= BROADCAST_ROWS else bases
    at = sizes.join(near, "bucket").select("doc", "tie", "n", "copies", (F.col("base") + F.col("before")).alias("offset"))
    total = sizes.agg(F.count("*").alias("all"), F.count_if(F.col("copies") > 1).alias("repeated")).first()
    small = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    rows, keys = _rows(docs), ["doc", "tie"]
    single = rows.join(small(at.where("copies = 1").select(*keys, "offset"), total["all"] - total["repeated"]), keys)
    found = single.select("offset", "text")
    if total["repeated"]:
        many = small(at.where("copies > 1"), total["repeated"])
        once = rows.join(F.broadcast(many.select(*keys)) if total["repeated"] <= BROADCAST_ROWS else many.select(*keys), keys, "left_semi")
        each = once.dropDuplicates(keys).join(many, keys).select("offset", "n", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        found = found.unionByName(each.select((F.col("offset") + F.col("copy") * F.col("n")).alias("offset"), "text"))
    return found


def _write(path: str, shard: int, data: bytes) -> tuple[int, str]:
    """Write one shard whole, under another name first, so a lost task leaves no half file; size and SHA-256 of the file."""
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base)
    name = f"{base}/shard-{shard:08d}.bin"
    part = f"{name}.{hashlib.sha256(data).hexdigest()[:8]}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, name)
    with fs.open_input_stream(name) as written:
        found = written.read()
    return len(found), hashlib.sha256(found).hexdigest()


def _shards(n: int, stride: int, per_shard: int, path: str | None):
    """Join sorted pieces to shards, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, data: np.ndarray) -> pa.RecordBatch:
            raw = data.tobytes()
            size, digest = _write(path, shard, raw) if path else (len(raw), hashlib.sha256(raw).hexdigest())
            values = [shard, shard * per_shard, size // (2 * stride), 2 * stride, size, digest]
            names = ["shard", "first_slot", "n_sequences", "stride_bytes", "n_bytes", "sha256"]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

        now, data = None, None
        for batch in batches:
            for slot, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = slot // per_shard
                if shard != now:
                    if now is not None:
                        yield done(now, data)
                    now = shard
                    data = np.full(stride * min(per_shard, n - shard * per_shard), END, "<u2")
                ids = np.frombuffer(unpacked(piece), "<u2")
                at = (slot - shard * per_shard) * stride + start
                data[at : at + len(ids)] = ids
        if now is not None:
            yield done(now, data)

    return run


def token_shards(
    docs: DataFrame,
    path: str | None = None,
    key: int = 20260,
    stride: int = STRIDE,
    per_shard: int = PER_SHARD,
    ranks: str = RANKS,
) -> DataFrame:
    """Shards of all documents' token ids in training order, one row each; files if ``path`` is given.

    Texts are tokenised whole, each followed by END, strung together and cut into sequences of
    ``stride`` ids; the last one is filled up with END. Sequence i gets slot permuted(i), and
    shard s holds the slots from s * per_shard, two little-endian bytes an id, so slot j lies
    at byte 2 * stride * (j - first_slot) of its file: a reader that stopped goes on at any slot. Rows: shard,
    first_slot, n_sequences, stride_bytes, n_bytes, sha256 of the shard's file, or of its bytes without
    ``path``. Texts are tokenised twice, for their counts and for their ids, so only one copy of the ids is
    kept beside the files. docs: doc_id, text; other columns are not read. Null texts give nothing, empty ones an END; null ids come first;
    repeated rows are strung together twice; an empty table gives no rows. ``path`` must be on
    storage that all executors share; a repeated task writes the same file again.
    """
    sizes = native.staged(counted(docs, ranks))
    sums = native.staged(sizes.groupBy("bucket").agg(F.sum(F.col("n") * F.col("copies")).alias("n")))
    # one row per DOCS_PER_BUCKET documents
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    known = sums.agg(F.sum("n").alias("tokens"), F.count("*").alias("buckets")).first()
    sequences = -(-(known["tokens"] or 0) // stride)
    placed = _placed(docs, sizes, bases, known["buckets"])
    pieces = placed.mapInArrow(_pieces(sequences, key, stride, ranks), "slot long, start int, packed binary")
    sorted_pieces = pieces.withColumn("shard", F.floor(F.col("slot") / per_shard)).repartition("shard").sortWithinPartitions("slot", "start")
    schema = "shard long, first_slot long, n_sequences long, stride_bytes long, n_bytes long, sha256 string"
    return sorted_pieces.select("slot", "start", "packed").mapInArrow(_shards(sequences, stride, per_shard, path), schema)


def read_sequences(path: str, stride: int = STRIDE, per_shard: int = PER_SHARD, start: int = 0) -> Iterator[np.ndarray]:
    """The sequences from slot ``start`` on, in order, read from the files one after the other."""
    fs, base = pafs.FileSystem.from_uri(path)
    shard = start // per_shard
    while fs.get_file_info(name := f"{base}/shard-{shard:08d}.bin").type == pafs.FileType.File:
        with fs.open_input_stream(name) as data:
            data.read(2 * stride * max(0, start - shard * per_shard))
            while len(one := data.read(2 * stride)) == 2 * stride:
                yield np.frombuffer(one, "<u2")
        shard += 1
