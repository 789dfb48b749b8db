"""Small tables for the operators' tests, and brute force that several tests use."""

from __future__ import annotations

import random
import re
from itertools import combinations

from pyspark.sql import Row
from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns that operators use as names of their own.
CLASHING = ["n", "h", "w", "c", "k1", "band", "row", "size", "words", "range", "copy", "slot", "component", "target",
            "doc", "n_tokens", "ids", "score", "fp", "bucket", "tie"]

DOCS = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType())]
)


def docs_of(spark, texts, langs=None, sources=None, ids=None):
    rows = [
        Row(
            doc_id=ids[i] if ids else i,
            text=t,
            lang=langs[i] if langs else "en",
            source=sources[i] if sources else f"s{i % 3}",
            n_chars=None if t is None else len(t),
        )
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def prose(rng: random.Random, n: int, known=60) -> str:
    names = [f"{a}{b}" for a in ("ta", "re", "lo", "shi", "em") for b in ("n", "der", "tion", "st", "a", "ing", "ou", "ble")]
    words = [rng.choice(names[:known]) + rng.choice(names) if rng.random() < 0.8 else "the" for _ in range(n)]
    return re.sub(r"((?:\S+ ){11}\S+) ", r"\1\n", " ".join(words))


EDGES = [
    None, "", " \t\n", "one", "two words here", "Same text for both of these rows, the and of it is here now.",
    "Same text for both of these rows, the and of it is here now.", "\n\n\nline\nline\n", "ß ſ K é 漢字 😀   end", "▁x ▁",
    "a " * 5000, prose(random.Random(1), 30_000), "\x0b\x0c\r odd\x00zero \x85", "token=abcdefgh12345678", "1234 5678 !!",
]


def edge_docs(spark):
    """Nulls, empty and very long texts, ties, a repeated row, a null id, null source and language."""
    df = docs_of(
        spark,
        [*EDGES, EDGES[5], "a row without an id or a source and the rest of it"],
        langs=[None, "en"] * ((len(EDGES) + 1) // 2) + [None] * 2,
        sources=[None if i % 4 == 0 else "s" for i in range(len(EDGES) + 2)],
        ids=[*range(len(EDGES)), 5, None],
    )
    for name in CLASHING:
        df = df.withColumn(name, df.n_chars)
    return df


def shingle_set(text: str | None) -> frozenset:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(lowered)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_links(sets: dict) -> list:
    found = []
    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            found.append((a, b))
    return found
