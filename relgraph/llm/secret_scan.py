"""Secret scans: known patterns, and a battery of randomness tests with false-discovery control.

Two hypotheses are tested with one battery (letter frequencies, runs, neighbouring letters):
that a word is random over its inferred alphabet, and that it is text as the corpus writes it.
The text hypothesis is measured on all words of the corpus: how often each letter follows
each other. A word is a secret if being text is a discovery against, and being random isn't rejected.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from relgraph.llm import native

#: Patterns that the base kinds are fixed by. For ``access`` and ``hex`` the least length is
#: part of the pattern: runs end where the class ends, so the same runs are found.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 8

#: Words that are tested for randomness: runs of the encodings' characters, also after a "=".
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, narrowest first: name, pattern, alphabet in the order of its values.
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _UPPER.lower()),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", _DIGITS + _UPPER.lower()),
    ("base36_upper", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("base62", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _UPPER.lower()),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _UPPER.lower() + _DIGITS + "-_"),
    ("mixed", "", _UPPER + _UPPER.lower() + _DIGITS + "+/-_"),
)

_BINS = 300


#: What a corpus too small to measure is taken to be like: shares of the kinds of letters, as
#: many pairs as are mixed into every corpus.
PRIOR = ((0.01, 10), (0.05, 26), (0.93, 26), (0.01, 4))
PRIOR_PAIRS = 2000

_LETTERS = ENCODINGS[-1][2]
_PAIR = r"(?=([A-Za-z0-9+/_-]{2}))"


@dataclass(frozen=True)
class TextModel:
    """How surprising letters and pairs of letters are in the words of a corpus, in bits.

    ``letter`` and ``pair`` (by first, then second letter) hold the surprises, ``*_mean`` and
    ``*_spread`` what they are on average and how they vary; ``turn`` is the share of pairs whose
    letters are of two kinds (digit, upper, lower, sign).
    """

    letter: list[float]
    pair: list[float]
    letter_mean: float
    letter_spread: float
    pair_mean: float
    pair_spread: float
    turn: float


def _kind(c: str) -> int:
    return 0 if c in _DIGITS else 1 if c in _UPPER else 2 if c.isalpha() else 3


def text_model(docs: DataFrame) -> TextModel:
    """The model of all words of all texts that are too short to be tested; docs: text.

    At most one row for each pair of letters reaches the driver.
    """
    words = F.regexp_replace(F.coalesce("text", F.lit("")), CANDIDATE, " ")
    pairs = docs.select(F.explode(F.regexp_extract_all(words, F.lit(_PAIR), F.lit(1))).alias("p"))
    counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count("*").alias("n")).collect()}
    prior = {c: PRIOR[_kind(c)][0] / PRIOR[_kind(c)][1] for c in _LETTERS}
    joint = {(a, b): counts.get(a + b, 0) + PRIOR_PAIRS * prior[a] * prior[b] for a in _LETTERS for b in _LETTERS}
    total = sum(joint.values())
    first = {a: sum(joint[a, b] for b in _LETTERS) for a in _LETTERS}
    letter = [-math.log2(first[a] / total) for a in _LETTERS]
    pair = [-math.log2(joint[a, b] / first[a]) for a in _LETTERS for b in _LETTERS]

    def moments(surprise: list[float], weight: list[float]) -> tuple[float, float]:
        mean = sum(x * w for x, w in zip(surprise, weight)) / total
        return mean, math.sqrt(sum((x - mean) ** 2 * w for x, w in zip(surprise, weight)) / total + 1e-9)

    turned = sum(n for (a, b), n in joint.items() if _kind(a) != _kind(b)) / total
    return TextModel(
        letter, pair, *moments(letter, [first[a] for a in _LETTERS]), *moments(pair, [joint[a, b] for a in _LETTERS for b in _LETTERS]), turned
    )


def _table(values: list[float]) -> Column:
    """An array of constants; from one text, which is folded to a constant once."""
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")


def _tail(z: Column) -> Column:
    """1 - Phi(z), by a rational approximation with an error below 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = series * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def spans(text: Column, pattern: str, value: Callable[[Column], Column]) -> Column:
    """start, end (code points) and ``value`` of all matches, leftmost and not overlapping.

    Matches and the gaps between them alternate, so their lengths add up to the places.
    """

    def of(x: Column) -> Column:
        matches, gaps = x["matches"], x["gaps"]
        kind = "array<struct<start:bigint,end:bigint,value:string>>"
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("found"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.char_length(gaps[i])
            end = start + F.char_length(matches[i])
            found = F.struct(start.alias("start"), end.alias("end"), value(matches[i]).alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), first, step, lambda acc: acc["found"])

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), native.let(parts, of)).otherwise(none)


def battery(word: Column, model: TextModel) -> Column:
    """Tests of one word: stratum (of its length), text_bin and random_p.

    The encoding is the narrowest whose alphabet holds the word. Against the hypothesis that
    it is random over that alphabet stand a chi-squared test of uniform counts, a runs test of
    low and high values, and the serial correlation of neighbours; ``random_p`` is their
    p-value with Bonferroni's correction. Against the hypothesis that it is text stand the same three
    things as ``model`` has measured them: how rare its letters are, how often it turns
    from one kind of letter to another, and how rarely its letters follow each other.
    ``text_bin`` is their p-value, corrected likewise, in tenths of a decade.
    """
    bare = F.rtrim(F.regexp_replace(word, "=+$", ""))
    alphabet = F.lit(ENCODINGS[-1][2])
    for _, pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(bare.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tests(x: Column) -> Column:
        chars, size = x["chars"], F.char_length(x["alphabet"])
        n = F.size(chars).cast("double")
        squares = F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, c: acc + F.pow(n - F.size(F.array_remove(chars, c)), F.lit(2.0)),
        )
        chi = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (1 - 1 / n))

        def of_values(y: Column) -> Column:
            values, mean = y["v"], y["mean"]
            start = F.struct(
                F.lit(None).cast("double").alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("high"),
                F.lit(0.0).alias("cross"), F.lit(0.0).alias("var"),
            )

            def step(acc: Column, v: Column) -> Column:
                turned = acc["last"].isNotNull() & ((2 * v >= size) != (2 * acc["last"] >= size))
                return F.struct(
                    v.alias("last"),
                    (acc["runs"] + turned.cast("double")).alias("runs"),
                    (acc["high"] + (2 * v >= size).cast("double")).alias("high"),
                    (acc["cross"] + F.coalesce((acc["last"] - mean) * (v - mean), F.lit(0.0))).alias("cross"),
                    (acc["var"] + (v - mean) * (v - mean)).alias("var"),
                )

            def done(acc: Column) -> Column:
                both = 2 * acc["high"] * (n - acc["high"])
                spread = both * (both - n) / (n * n * (n - 1))
                # all low or all high: one run, as far from random as can be
                runs = F.when(spread > 0, (acc["runs"] - 1 - both / n) / F.sqrt(spread)).otherwise(F.lit(9.0))
                serial = F.when(acc["var"] > 0, (acc["cross"] / acc["var"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
                return F.least(2 * _tail(F.abs(runs)), 2 * _tail(F.abs(serial)))

            return F.aggregate(values, start, step, done)

        indexed = F.transform(chars, lambda c: F.call_function("instr", x["alphabet"], c).cast("double") - 1)
        paired = native.let(indexed, lambda v: native.let(
            F.struct(v.alias("v"), (F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n).alias("mean")), of_values))
        random_p = F.least(F.lit(1.0), 3 * F.least(_tail(chi), paired))
        letters, pairs = _table(model.letter), _table(model.pair)
        kinds = F.lit("".join(str(_kind(c)) for c in _LETTERS))
        coded = F.transform(chars, lambda c: F.call_function("instr", F.lit(_LETTERS), c) - 1)
        none = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("rare"), F.lit(0.0).alias("unlikely"), F.lit(0.0).alias("turns"))

        def see(acc: Column, v: Column) -> Column:
            begun = acc["last"] >= 0
            kind = lambda at: F.call_function("substring", kinds, at + 1, F.lit(1))
            return F.struct(
                v.alias("last"),
                (acc["rare"] + F.get(letters, v)).alias("rare"),
                (acc["unlikely"] + F.when(begun, F.get(pairs, acc["last"] * len(_LETTERS) + v)).otherwise(0.0)).alias("unlikely"),
                (acc["turns"] + (begun & (kind(v) != kind(acc["last"]))).cast("double")).alias("turns"),
            )

        def as_text(acc: Column) -> Column:
            rare = (acc["rare"] - n * model.letter_mean) / (F.sqrt(n) * model.letter_spread)
            unlikely = (acc["unlikely"] - (n - 1) * model.pair_mean) / (F.sqrt(n - 1) * model.pair_spread)
            spread = F.sqrt((n - 1) * model.turn * (1 - model.turn) + 0.25)
            turns = (acc["turns"] - 0.5 - (n - 1) * model.turn) / spread
            return F.least(F.lit(1.0), 3 * _tail(F.greatest(rare, unlikely, turns)))

        text_p = F.greatest(F.aggregate(coded, none, see, as_text), F.lit(10.0 ** (-_BINS / 10)))
        return F.struct(
            F.floor(2 * F.log2(n)).cast("int").alias("stratum"),
            F.floor(-10 * F.log10(text_p) + 1e-9).cast("int").alias("text_bin"),
            random_p.alias("random_p"),
        )

    return native.let(F.struct(F.split(bare, "").alias("chars"), alphabet.alias("alphabet")), tests)


def thresholds(tested: DataFrame, rate: float) -> DataFrame:
    """stratum and the least text_bin at which Benjamini and Hochberg's rule is met.

    tested: stratum, text_bin, one row per test. The rule holds in each stratum of length by
    itself: long words can be told from text at small p-values, short ones cannot, and must
    not profit from them. Only counts per stratum and bin are ordered.
    """
    counts = tested.groupBy("stratum", "text_bin").agg(F.count("*").alias("n"))
    beyond = Window.partitionBy("stratum").orderBy(F.col("text_bin").desc())
    whole = Window.partitionBy("stratum")
    ranked = counts.select(
        "stratum", "text_bin", F.sum("n").over(beyond).alias("rank"), F.sum("n").over(whole).alias("m")
    )
    p = F.pow(F.lit(10.0), -F.col("text_bin") / 10)
    met = ranked.where(p * F.col("m") <= F.lit(rate) * F.col("rank"))
    return met.groupBy("stratum").agg(F.min("text_bin").alias("least"))


def scanned(docs: DataFrame, model: TextModel) -> DataFrame:
    """doc_id, base spans and tested words of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = lambda found, k: F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    )
    assigned = F.filter(
        spans(text, ASSIGN, lambda m: F.regexp_extract(m, ASSIGN, 1)),
        lambda s: F.char_length(s["value"]) >= ASSIGN_LEAST,
    )
    itself = lambda m: m
    tested = F.transform(
        spans(text, CANDIDATE, itself),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["value"], model).alias("test")),
    )
    base = F.concat(kind(assigned, 0), kind(spans(text, ACCESS, itself), 1), kind(spans(text, HEX, itself), 2))
    return docs.select("doc_id", F.sort_array(base).alias("base"), tested.alias("tested"))


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    )


def secret_scan(docs: DataFrame, alpha: float = 0.001, rate: float = 0.01) -> DataFrame:
    """Secrets in every whole text: counts of the base kinds, and all spans.

    A tested word is a further secret ("random") if its text_bin is a discovery, against its being
    text, at the false discovery rate ``rate`` within its stratum of length, randomness is not rejected at
    ``alpha``, and no base span overlaps it. docs: doc_id, text; other columns are not read.
    A null text counts as empty and has no spans; repeated rows each get a row; an empty
    table gives no rows.
    """
    rows = native.staged(scanned(docs, text_model(docs)))
    tests = rows.select(F.explode("tested.test").alias("t")).select("t.stratum", "t.text_bin")
    # some 40 strata at most: twice the logarithm of a text's length
    least = {r["stratum"]: r["least"] for r in thresholds(tests, rate).collect()}

    def discovered(test: Column) -> Column:
        met = F.lit(False)
        for stratum, text_bin in sorted(least.items()):
            met = met | ((test["stratum"] == stratum) & (test["text_bin"] >= text_bin))
        return met

    free = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    new = F.filter(
        "tested",
        lambda w: (w["test"]["random_p"] >= alpha) & discovered(w["test"]) & free(w),
    )
    random = F.transform(new, lambda w: F.struct(w["start"].alias("start"), F.lit(3).alias("kind"), w["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat(F.col("base"), random))).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
        F.size("tested").cast("long").alias("n_tested"),
    )
