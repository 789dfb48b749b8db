"""Text scoring with a pluggable model, and comparison of models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from relgraph.functions import scores
from relgraph.operators.articles import gated

Scorer = Callable[[list[str]], list[tuple[str, float]]]
Mapper = Callable[[list[str]], list[str]]


def model_column(text: Column, load: Callable[[], Scorer]) -> Column:
    """``struct(label, score)`` of each non-null text.

    ``load`` runs once per Python worker batch stream. Null texts never reach the
    model, which is how rows are kept away from it: a Python function inside a
    ``when`` would run for every row. A text the model fails on gets ``('', 0.0)``.
    """

    @F.pandas_udf("label string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = pd.DataFrame({"label": "", "score": 0.0}, index=batch.index)
            todo = batch[batch.notna()]
            if len(todo):
                out.loc[todo.index, ["label", "score"]] = _safe(model, list(todo))
            yield out

    return run(text)


def _safe(model: Scorer, texts: list[str]) -> list[tuple[str, float]]:
    try:
        found = model(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} labels for {len(texts)} texts")
        return found
    except Exception:
        if len(texts) == 1:
            return [("", 0.0)]
        return [_safe(model, [t])[0] for t in texts]


def mapped_text(text: Column, load: Callable[[], Mapper]) -> Column:
    """Text through a pluggable mapper such as a translator; failures give ``''``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mapper = load()

        def one(t: str) -> str:
            try:
                return mapper([t])[0]
            except Exception:
                return ""

        for batch in batches:
            try:
                yield pd.Series(mapper(list(batch.fillna(""))), index=batch.index)
            except Exception:
                yield batch.fillna("").map(one)

    return run(text)


def score_articles(
    articles: DataFrame,
    load: Callable[[], Scorer] | None = None,
    positive: list[str] = scores.DEFAULT_POSITIVE,
    negative: list[str] = scores.DEFAULT_NEGATIVE,
    max_chars: int | None = None,
) -> DataFrame:
    """Add ``sentiment_label`` and ``sentiment_score``; ungated rows get ``('', 0.0)``.

    Without ``load`` the word lists decide, inside the JVM. Whole texts are scored
    unless ``max_chars`` states the window of a size-limited model.
    """
    text = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    gate = gated(F.col("politicians"), F.col("content"))
    if load is not None:
        scored = articles.withColumn("_s", model_column(F.when(gate, text), load))
        return scored.select(
            *articles.columns,
            F.col("_s.label").alias("sentiment_label"),
            F.col("_s.score").alias("sentiment_score"),
        )
    return articles.select(
        "*",
        F.when(gate, scores.lexicon_label(text, positive, negative))
        .otherwise("")
        .alias("sentiment_label"),
        F.when(gate, scores.lexicon_score(text, positive, negative))
        .otherwise(0.0)
        .alias("sentiment_score"),
    )


def score_statements(statements: DataFrame, logits: dict[str, Column | None], labels: list[str]) -> DataFrame:
    """Each statement scored by each model, as 감정 relation rows.

    ``logits`` maps a model name to its logit array column; None stands for a model
    without classifier, which answers neutral with confidence 1.
    """
    verdicts = []
    for place, (name, column) in enumerate(logits.items()):
        if column is None:
            label, confidence = F.lit("neutral"), F.lit(1.0)
        else:
            label, confidence = scores.top_label(column, labels), scores.top_confidence(column)
        verdicts.append(
            F.struct(
                F.lit(place).alias("model_pos"),
                F.lit(name).alias("model"),
                label.alias("sentiment_label"),
                confidence.alias("sentiment_confidence"),
            )
        )
    base = ["source", "target", F.col("text").alias("desc")]
    rows = statements.select(*base, F.explode(F.array(*verdicts)).alias("v"))
    return rows.select(
        "source",
        "target",
        F.lit("감정").alias("type"),
        "desc",
        scores.signed_score(F.col("v.sentiment_label"), F.col("v.sentiment_confidence")).alias("score"),
        "v.*",
    )


def label_distribution(scored: DataFrame, base: list[str] = scores.BASE_LABELS) -> DataFrame:
    """``(model_pos, model, label, n)``: base labels also when unseen, plus any other label."""
    counts = scored.groupBy("model_pos", "model", F.col("sentiment_label").alias("label")).agg(
        F.count("*").alias("n")
    )
    zeros = counts.select("model_pos", "model").distinct().select(
        "*", F.explode(F.array(*map(F.lit, base))).alias("label"), F.lit(0).cast("long").alias("n")
    )
    return counts.unionByName(zeros).groupBy("model_pos", "model", "label").agg(F.sum("n").alias("n"))


def best_model(distribution: DataFrame) -> DataFrame:
    """The model with most positive and negative verdicts; an all-neutral one ranks last."""
    is_polar = F.col("label").isin("positive", "negative")
    totals = distribution.groupBy("model_pos", "model").agg(
        F.sum(F.when(is_polar, F.col("n")).otherwise(0)).alias("polar"),
        F.sum(F.when(F.col("label") == "positive", F.col("n")).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("label") == "negative", F.col("n")).otherwise(0)).alias("negative"),
        F.sum(F.when(F.col("label") == "neutral", F.col("n")).otherwise(0)).alias("neutral"),
    )
    rank = F.when(F.col("polar") > 0, F.col("polar")).otherwise(-1)
    return totals.orderBy(rank.desc(), "model_pos").limit(1)


def verdict_cell(translated: Column, label: Column, score: Column, model_ok: Column) -> Column:
    """Cell of the comparison table, with the two failure texts."""
    return (
        F.when(~model_ok, F.lit(scores.MODEL_FAILED))
        .when(~F.coalesce(translated != "", F.lit(False)), F.lit(scores.TRANSLATION_FAILED))
        .otherwise(scores.result_cell(label, score))
    )


def model_by_sample(cells: DataFrame, samples: list[int]) -> DataFrame:
    """One row per model, one column per listed sample: ``모델명, 샘플1, 샘플2, …``."""
    wide = cells.groupBy(F.col("model").alias("모델명")).pivot("sample", samples).agg(F.first("cell"))
    return wide.select("모델명", *[F.col(str(s)).alias(f"샘플{s}") for s in samples])


def sample_by_model(cells: DataFrame, models: list[str]) -> DataFrame:
    """The same table turned: the unbounded side stays in rows."""
    return cells.groupBy("sample").pivot("model", models).agg(F.first("cell"))


def mean_vectors(vectors: DataFrame, group: list[str], column: str) -> DataFrame:
    """Elementwise mean per group; each position is averaged on its own."""
    means = (
        vectors.select(*group, F.posexplode(column).alias("place", "x"))
        .groupBy(*group, "place")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )
    return means.groupBy(*group).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda s: s["mean"]
        ).alias("mean")
    )
