"""Labels, confidences and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label texts and edge types that decide the results.
POSITIVE_EDGE = "POSITIVE_SENTIMENT"
NEGATIVE_EDGE = "NEGATIVE_SENTIMENT"
TRANSLATION_FAILED = "번역실패"
MODEL_FAILED = "모델실패"
BASE_LABELS = ["positive", "negative", "neutral"]

DEFAULT_POSITIVE = ["훌륭", "최고", "멋지", "존경", "만족", "감사", "성공", "good", "great", "excellent"]
DEFAULT_NEGATIVE = ["최악", "실망", "별로", "싫다", "실패", "분노", "짜증", "bad", "poor", "worst"]


def polarity_edge(label: Column) -> Column:
    """Edge type of a star label; three stars and no label give null."""
    return F.when(
        F.contains(label, F.lit("5 stars")) | F.contains(label, F.lit("4 stars")), F.lit(POSITIVE_EDGE)
    ).when(
        F.contains(label, F.lit("1 star")) | F.contains(label, F.lit("2 stars")), F.lit(NEGATIVE_EDGE)
    )


def signed_score(label: Column, confidence: Column) -> Column:
    """50..100 for positive, -50..0 for negative, else 0; truncates toward zero."""
    return (
        F.when(label == "positive", (50 + 50 * confidence).cast("int"))
        .when(label == "negative", (-50 * confidence).cast("int"))
        .otherwise(F.lit(0))
    )


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def top_label(logits: Column, labels: list[str]) -> Column:
    """Label of the largest logit; the first one wins a tie."""
    place = F.array_position(logits, F.array_max(logits)).cast("int")
    return F.element_at(F.array(*map(F.lit, labels)), place)


def top_confidence(logits: Column) -> Column:
    return F.array_max(softmax(logits))


def result_cell(label: Column, score: Column) -> Column:
    """``label (0.87)``; an exact half rounds up."""
    return F.format_string("%s (%.2f)", label, score)


def count_words(text: Column, words: list[str]) -> Column:
    """How many of the given words occur in the text."""
    hits = [F.contains(text, F.lit(w)).cast("int") for w in words]
    total = F.lit(0)
    for hit in hits:
        total = total + hit
    return total


def lexicon_label(text: Column, positive: list[str], negative: list[str]) -> Column:
    """``'1 star'`` .. ``'5 stars'`` from the balance of positive and negative words."""
    stars = F.greatest(
        F.lit(1),
        F.least(F.lit(5), F.lit(3) + count_words(text, positive) - count_words(text, negative)),
    )
    return F.concat(stars.cast("string"), F.when(stars == 1, F.lit(" star")).otherwise(F.lit(" stars")))


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    p, n = count_words(text, positive), count_words(text, negative)
    return (F.abs(p - n) + 1).cast("double") / (p + n + 1)
