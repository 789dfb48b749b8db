"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from relgraph.llm import native

WINDOW = 5

#: Common function words of the languages the rules are meant for.
STOP_WORDS = (
    "the and of to in that was for is on with it as be by are this from have not at or an a he she they we you "
    "which were been has had but his her its their one all would there will so if "
    "der die das und ist von mit den dem des ein eine einen einer eines für auf nicht sich im zu aus bei als auch "
    "es an werden wird sie er wir ich hat oder wie um am sind noch nach so zum zur über "
    "le la les et un une des est que qui pour dans en sur avec du de au aux par pas ne se ce cette il elle on ou "
    "plus sont son sa ses mais comme nous vous "
    "el los las de y una por con para se no es lo su como del al más pero sus ha me sin sobre este ya entre "
    "cuando todo esta ser son dos también fue"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; an open end is None."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("shouts_per_word", high=0.2),
    Rule("stop_word_ratio", low=0.005),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)

#: Ratios over nothing are null, and pass no rule.
METRICS: dict[str, Callable[[], Column]] = {
    "mean_word_chars": lambda: F.try_divide("word_chars", "n_words"),
    "symbols_per_word": lambda: F.try_divide("n_symbols", "n_words"),
    "shouts_per_word": lambda: F.try_divide("n_shouts", "n_words"),
    "stop_word_ratio": lambda: F.try_divide("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: F.try_divide("n_dup_lines", "n_lines"),
    "bullet_line_ratio": lambda: F.try_divide("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": lambda: F.try_divide("n_ellipsis_lines", "n_lines"),
}


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One boolean of the whole table; a ratio over nothing passes no rule."""
    passed = F.lit(True)
    for rule in rules:
        value = METRICS[rule.metric]()
        if rule.low is not None:
            passed = passed & (value >= F.lit(rule.low))
        if rule.high is not None:
            passed = passed & (value <= F.lit(rule.high))
    return F.coalesce(passed, F.lit(False))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text.

    The windows' hashes are compared first: if all differ, so do the windows, and the
    answer is 0. Otherwise the windows themselves are sorted and neighbours compared.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))
    keyed = F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))
    )

    def of_repeated(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        same = lambda x, k: ((k > 0) & (x["w"] == F.get(sorted_windows, k - 1)["w"])) | (
            (k < n - 1) & (x["w"] == F.get(sorted_windows, k + 1)["w"])
        )
        at = F.sort_array(F.transform(F.filter(sorted_windows, same), lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(
            i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")
        )
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    all_differ = native.let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return (
        F.when(F.size(words) <= WINDOW, F.lit(0))
        .when(all_differ, F.lit(0))
        .otherwise(native.let(F.sort_array(keyed), of_repeated))
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text that the rules are made of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        native.words(F.col("text")).alias("words"),
    )
    words, lines = F.col("words"), F.col("lines")
    counted = lambda test: F.size(F.filter(lines, test)).cast("long")
    return split.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        "n_shouts",
        F.size(lines).cast("long").alias("n_lines"),
        counted(lambda line: line.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
        counted(lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every document, one row for each row of ``docs``.

    docs: doc_id, text; other columns are not read, whatever their names. A null or empty
    text has no words and fails; ties and repeated rows are each judged alone; an empty
    table gives no rows. Nothing is shuffled.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = ["n_stop_words", "n_shouts", "n_lines", "n_bullet_lines", "n_ellipsis_lines"]
    return measured(docs).select(
        *base, failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"), *rest
    )
