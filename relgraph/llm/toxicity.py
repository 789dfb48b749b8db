"""Toxicity: a learned lexicon met by a Levenshtein automaton, hits scored by the window around them.

Terms are whole words and word beginnings that the labelled documents show to be toxic. They
form a trie; a state of the automaton is the set of the trie's nodes that the letters read so
far can stand at, with the edits used, so one pass over a word meets all terms within their
edits at once. States are made when they are first needed.

A hit counts less inside quotation marks or after a word of reporting ("called", "said"), and
more near a word of address ("you"), so a quoted insult weighs less than abuse.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relgraph.llm.periodic_runs import packed_words
from relgraph.llm.shingle_sets import pieces, word_spans

THRESHOLD = 0.7
"""Score from which a document counts as toxic."""

SAMPLE_PER_LABEL = 6000
"""Labelled documents of each label that are learned from, at most about so many."""

TERMS = 400
"""Terms of the lexicon, at most."""

CANDIDATES = 50_000
"""Words and beginnings of the toxic sample, most frequent first, that are counted in the clean one."""

EXCEPTIONS = 20_000
"""Ordinary words near a term that are remembered as such, at most."""

LEAST_DOCUMENTS = 3
STEMS = range(3, 9)
WINDOW = 8
QUOTE_WORDS = 40
QUOTED, ADDRESSED = 0.25, 1.5
FUZZY = 0.7

#: Words before a hit that report speech, and words near one that address somebody.
REPORTING = frozenset(
    "said says say called calls call wrote writes word words term quote quoted cited sagte sagt nannte nennt schrieb wort begriff zitat "
    "dit appelé appelle écrit mot terme citation dijo dice llamó llama escribió palabra término cita".split()
)
ADDRESSING = frozenset("you your yours youre du dich dir dein deine ihr euch tu toi ton ta vous votre tú ti tus usted ustedes".split())
_OPENING, _CLOSING = "\"“„«‹", "\"”“»›"

_STATES = 100_000


def normal(word: str) -> str:
    """The letters of a word in lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def edits_of(term: str) -> int:
    """Edits that a whole word may be away from the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class _Node:
    children: dict[str, int] = field(default_factory=dict)
    whole: tuple[int, int] | None = None
    stem: int | None = None
    edits: int = 0
    """Most edits of a term below."""


class Lexicon:
    """Terms with weights, and their automaton. A term ending in ``*`` is a beginning and met exactly."""

    def __init__(self, terms: dict[str, float], exceptions: Iterable[str] = ()):
        self.terms, self.exceptions = terms, frozenset(exceptions)
        self.names, self.weights = list(terms), list(terms.values())
        self.nodes = [_Node()]
        for i, term in enumerate(self.names):
            self._add(i, term)
        self._clear()

    def _add(self, i: int, term: str) -> None:
        letters = term.rstrip("*")
        edits = 0 if term.endswith("*") else edits_of(letters)
        at = 0
        for c in letters:
            self.nodes[at].edits = max(self.nodes[at].edits, edits)
            if c not in self.nodes[at].children:
                self.nodes[at].children[c] = len(self.nodes)
                self.nodes.append(_Node())
            at = self.nodes[at].children[c]
        node = self.nodes[at]
        node.edits = max(node.edits, edits)
        if term.endswith("*"):
            node.stem = i
        else:
            node.whole = (i, edits)

    def _clear(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.stems: list[int | None] = []
        self.ends: list[tuple[int, int] | None] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, used: dict[int, int]) -> dict[int, int]:
        """With the nodes that leaving out letters of a term leads to."""
        todo = list(used)
        while todo:
            at = todo.pop()
            for child in self.nodes[at].children.values():
                n = used[at] + 1
                if n <= self.nodes[child].edits and n < used.get(child, n + 1):
                    used[child] = n
                    todo.append(child)
        return used

    def _state(self, used: dict[int, int]) -> int:
        key = frozenset(used.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            exact = [self.nodes[n].stem for n, u in key if u == 0 and self.nodes[n].stem is not None]
            self.stems.append(exact[0] if exact else None)
            ends = [(u, -self.weights[self.nodes[n].whole[0]], self.nodes[n].whole[0]) for n, u in key if self.nodes[n].whole and u <= self.nodes[n].whole[1]]
            self.ends.append(min(ends)[::2] if ends else None)
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        used: dict[int, int] = {}

        def reach(node: int, n: int) -> None:
            if n <= self.nodes[node].edits and n < used.get(node, n + 1):
                used[node] = n

        for at, n in self.sets[state]:
            reach(at, n + 1)
            for letter, child in self.nodes[at].children.items():
                reach(child, n if letter == c else n + 1)
        self.steps[state][c] = found = self._state(self._closed(used))
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term (its number) and its distance; of equals the heaviest. Exceptions match exactly only."""
        if len(self.sets) > _STATES:
            self._clear()
        state, stem = self.start, None
        for c in word:
            after = self.steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if self.stems[state] is not None:
                stem = self.stems[state]
            if not self.sets[state]:
                break
        end = self.ends[state]
        if end and (end[0] == 0 or stem is None and word not in self.exceptions):
            return end[1], end[0]
        return None if stem is None else (stem, 0)


def _quoted(hits: np.ndarray, events: list[tuple[int, int]]) -> np.ndarray:
    """Which hits lie between an opening mark and a closing one, QUOTE_WORDS away at most.

    events: places (two for each word: before and after its letters) and 1 for opening marks, 0 for closing ones.
    """
    inside = np.zeros(len(hits), bool)
    if not events:
        return inside
    at, kind = np.array(events).T
    for i, place in enumerate((2 * hits).tolist()):
        last = int(np.searchsorted(at, place, "right")) - 1
        if last < 0 or last + 1 >= len(at):
            continue
        inside[i] = kind[last] == 1 and kind[last + 1] == 0 and at[last + 1] - at[last] <= 2 * QUOTE_WORDS
    return inside


FEATURES = ["exact", "exact_share", "fuzzy", "fuzzy_share", "dense", "terms", "few_words", "quoted_share"]


def hit_scores(weights: np.ndarray, quoted: np.ndarray, reported: np.ndarray, addressed: np.ndarray) -> np.ndarray:
    """Each hit's weight in its window."""
    return weights * np.where(quoted | reported, QUOTED, 1.0) * np.where(addressed, ADDRESSED, 1.0)


class Measure:
    """Features of texts by a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def _word(self, raw: bytes) -> tuple[int, int, int, int, int]:
        """Term (or -1), distance, cue (1 reports, 2 addresses), and whether a quotation opens before or closes after."""
        word = raw.decode("utf-8", "replace")
        letters = normal(word)
        hit = self.lexicon.match(letters) if len(letters) > 2 else None
        cue = 1 if letters in REPORTING else 2 if letters in ADDRESSING else 0
        opens = word[0] in _OPENING
        closes = not word[-1].isalpha() and any(c in _CLOSING for c in word[max(1, len(letters)) :])
        return (*(hit or (-1, 0)), cue, opens, closes)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros((len(texts), len(FEATURES)))
        weights = np.array([*self.lexicon.weights, 0.0])
        for first, data, offsets in pieces(texts):
            starts, ends = word_spans(data, offsets)
            coded = packed_words(data, starts, ends).dictionary_encode()
            kinds = np.array([self._word(w) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 5)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words = kinds[codes]
            bounds = np.searchsorted(starts, offsets)
            hits = np.flatnonzero(words[:, 0] >= 0) if len(words) else np.zeros(0, np.int64)
            of = np.searchsorted(bounds, hits, "right") - 1
            found[first : first + len(bounds) - 1, 6] = 1 / (1 + np.diff(bounds))
            for i in np.unique(of).tolist():
                a, z = int(bounds[i]), int(bounds[i + 1])
                found[first + i] = self._features(words[a:z], hits[of == i] - a, weights, found[first + i, 6])
        return found

    def _features(self, words: np.ndarray, hits: np.ndarray, weights: np.ndarray, few: float) -> list[float]:
        n = len(words)
        terms, distance = words[hits, 0], words[hits, 1]
        marked = np.flatnonzero(words[:, 3] | words[:, 4])
        events = [(2 * w + side, 1 - side) for w in marked.tolist() for side in (0, 1) if words[w, 3 + side]]
        quoted = _quoted(hits, events)
        report, address = (np.append(0, np.cumsum(words[:, 2] == cue)) for cue in (1, 2))
        low, high = np.maximum(hits - WINDOW, 0), np.minimum(hits + WINDOW + 1, n)
        reported = report[hits] > report[low]
        scores = hit_scores(weights[terms] * FUZZY**distance, quoted, reported, address[high] > address[low])
        exact, fuzzy = scores[distance == 0].sum(), scores[distance > 0].sum()
        upto = np.append(0, np.cumsum(scores))
        near = np.searchsorted(hits, hits + 4 * WINDOW, "right")
        dense = (upto[near] - upto[:-1]).max()
        share = 100 / (n + 20)
        return [np.log1p(exact), min(exact * share, 50), np.log1p(fuzzy), min(fuzzy * share, 50), np.log1p(dense), np.log1p(len(np.unique(terms))), few, quoted.mean()]


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) * self.scale, -30, 30) - np.log(THRESHOLD / (1 - THRESHOLD))))


def fit(lexicon: Lexicon, x: np.ndarray, label: np.ndarray) -> Model:
    """Logistic regression on the features; the cut with fewest errors is scored THRESHOLD."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    w, bias = np.zeros(z.shape[1]), 0.0
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    for step in range(600):
        p = 1 / (1 + np.exp(-np.clip(z @ w + bias, -30, 30)))
        lost = (p - label) * weight
        rate = 1.0 / (1 + step / 200)
        w -= rate * ((z * lost[:, None]).mean(0) + 1e-3 * w)
        bias -= rate * lost.mean()
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    raw, toxic = raw[order], label[order]
    missed = np.append(0, np.cumsum(toxic == 1))
    blamed = (toxic == 0).sum() - np.append(0, np.cumsum(toxic == 0))
    wrong = (missed + blamed).astype(float)
    wrong[1:-1][raw[1:] == raw[:-1]] = np.inf
    # the middle of the best cuts keeps away from both sides
    best = np.flatnonzero(wrong == wrong.min())
    at = int(best[len(best) // 2])
    ends = np.concatenate([[raw[0] - 1], raw, [raw[-1] + 1]])
    return Model(lexicon, mean, spread, w, float((ends[at] + ends[at + 1]) / 2), float(4 / (raw.std() + 1e-6)))


def held_out() -> Column:
    """True for the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _terms(text: str | None) -> Counter:
    """How often (4 at most) a text has each word and word beginning."""
    found: Counter = Counter()
    for word, n in Counter((text or "").split()).items():
        letters = normal(word)
        if len(letters) > 2:
            found[letters] += n
            for k in STEMS:
                if k <= len(letters):
                    found[letters[:k] + "*"] += n
    return Counter({t: min(n, 4) for t, n in found.items()})


def _counted(texts: DataFrame, wanted: dict[str, int] | None) -> DataFrame:
    """term, documents and hits in ``texts``: of all terms, or of the wanted ones. Combined per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, hits = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for term, n in _terms(text).items():
                    if wanted is None or term in wanted:
                        documents[term] += 1
                        hits[term] += n
        terms = list(documents)
        columns = [pa.array(terms, pa.string()), pa.array([documents[t] for t in terms], pa.int64()), pa.array([hits[t] for t in terms], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "documents", "hits"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term string, documents long, hits long")
    return rows.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("hits").alias("hits"))


def chosen_terms(toxic: dict[str, tuple[int, int]], clean: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms and weights: those whose hits tell most, none of which begins another.

    toxic, clean: documents and hits of each term; n_toxic, n_clean: documents of each label.
    A term's weight is the logarithm of how much oftener a toxic document has it; what it
    tells is that times its hits. Of terms that tell the same the longest is taken, a whole
    word before a beginning.
    """
    ranked = []
    for term, (documents, hits) in toxic.items():
        rate, other = (hits + 0.0) / n_toxic, (clean.get(term, (0, 0))[1] + 0.5) / n_clean
        weight = float(np.log(rate / other))
        if documents >= LEAST_DOCUMENTS and weight > 1.5 and hits * weight > 12:
            ranked.append((round(hits * weight, 6), len(term.rstrip("*")), not term.endswith("*"), term, weight))
    taken: dict[str, float] = {}
    begun: set[str] = set()
    for _, _, _, term, weight in sorted(ranked, reverse=True):
        letters = term.rstrip("*")
        if len(taken) == TERMS:
            break
        if any(letters[:k] in taken or letters[:k] + "*" in taken for k in range(3, len(letters) + 1)) or letters in begun:
            continue
        taken[term] = min(weight, 6.0)
        begun.update(letters[:k] for k in range(3, len(letters) + 1))
    return taken


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Lexicon and weights from labelled documents that are not held out; None without both labels.

    labels: doc_id, toxic. Of each label about ``per_label`` documents are used, chosen by the
    hash of their id; the chosen ids (about twice as many) are broadcast. Terms are counted
    on the executors; the driver gets CANDIDATES of them and the documents' features.
    """
    usable = labels.where(~held_out()).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxic")), 11) / F.lit(float(1 << 53))
    share = F.when(F.col("toxic") == 1, F.lit(per_label / counts[1])).otherwise(F.lit(per_label / counts[0]))
    sample = docs.select("doc_id", "text").join(F.broadcast(usable.where(draw < share)), "doc_id")
    toxic_texts, clean_texts = sample.where("toxic = 1"), sample.where("toxic = 0")
    frequent = _counted(toxic_texts, None).where(F.col("documents") >= LEAST_DOCUMENTS).orderBy(F.desc("hits"), "term").limit(CANDIDATES)
    toxic = {r["term"]: (r["documents"], r["hits"]) for r in frequent.collect()}
    clean = {r["term"]: (r["documents"], r["hits"]) for r in _counted(clean_texts, dict.fromkeys(toxic, 1)).collect()}
    used = {k: min(n, per_label) for k, n in counts.items()}
    terms = chosen_terms(toxic, clean, used[1], used[0])
    lexicon = Lexicon(terms, _ordinary(sample, Lexicon(terms), used))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(lexicon)
        for batch in batches:
            rows = pa.array(list(measure(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), rows], names=["toxic", "x"])

    rows = sorted((r["toxic"], tuple(r["x"])) for r in sample.select("toxic", "text").mapInArrow(measured, "toxic int, x array<double>").collect())
    if len({t for t, _ in rows}) < 2:
        return None
    return fit(lexicon, np.array([x for _, x in rows]), np.array([t for t, _ in rows]))


def _ordinary(sample: DataFrame, lexicon: Lexicon, used: dict[int, int]) -> list[str]:
    """Words within the edits of a term that clean documents have nearly as often as toxic ones."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in {normal(w) for w in set((text or "").split())}:
                    hit = lexicon.match(word) if len(word) > 2 else None
                    if hit and hit[1]:
                        seen[word][toxic] += 1
        rows = [(w, c, t) for w, (c, t) in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["word", "clean", "toxic"])

    found = sample.select("toxic", F.col("text").cast("string").alias("text")).mapInArrow(near, "word string, clean long, toxic long")
    summed = found.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    common = summed.where(F.col("clean") / used[0] * 3 > F.col("toxic") / used[1]).orderBy(F.desc("clean"), "word").limit(EXCEPTIONS)
    return [r["word"] for r in common.collect()]


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of ``docs``.

    docs: doc_id, text; labels: doc_id, toxic; other columns are not read. Null and empty
    texts have no hits and get the lowest scores; a null doc_id is held out; several labels of
    one document count as the largest; repeated rows each get a row; an empty table gives
    none. Without labels of both kinds everything scores 0. A text is read whole, a megabyte
    of texts at a time or one longer text, at some 100 bytes for each of its words.
    """
    model = learn(docs, labels, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model.lexicon) if model else None
        for batch in batches:
            score = model.score(measure(batch.column(1))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
