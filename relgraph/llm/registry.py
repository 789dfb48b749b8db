"""The operators' queries over whole tables, and the SQL that must agree with them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from relgraph.llm import (
    fingerprints,
    hard_negatives,
    lang_id,
    line_dedup,
    mixing,
    native,
    ngram_join,
    periodic_runs,
    piece_codec,
    quality_rank,
    quality_rules,
    secret_scan,
    token_shards,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(native.table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(native.table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(native.table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(native.table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{native.shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    return token_shards.token_shards(native.table(spark, sf_dir, "documents"), path)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(native.table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(native.table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op7_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (native.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality_rank.quality_scores(docs, labels)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(native.table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(native.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(native.table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(native.table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (native.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.toxicity(docs, labels)


QUERIES |= {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_ngram_join,
        op3_secret_scan,
        op4_fingerprints,
        op5_token_shards,
        op6_piece_codec,
        op7_quality_rank,
        op8_mix,
        op9_language_id,
        op10_line_dedup,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_toxicity,
    )
}

ORACLES["op1_quality_rules"] = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM split, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
places AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN twice USING (doc_id, g), unnest(range(0, 5)) AS v(k)),
repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM places GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(ws, lambda w: lower(rtrim(w, '.,;:!?')) IN ({", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)}))) AS n_stop_words,
    length(t) - length(replace(t, '!', '')) AS n_shouts,
    len(ls) AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM split LEFT JOIN repeated USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed
  AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1 AND n_shouts / n_words <= 0.2
  AND n_stop_words / n_words >= 0.005 AND n_dup_lines / n_lines <= 0.5 AND n_bullet_lines / n_lines <= 0.9
  AND n_ellipsis_lines / n_lines <= 0.3 AS kept
FROM failed"""

ORACLES["op2_ngram_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM split, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS u(i)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id"""

ORACLES["op11_hard_negatives"] = """
WITH rows_ AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(256 * x::DOUBLE) >= 2.0 ** 62)) = 0),
scaled AS MATERIALIZED (
  SELECT vec_id, label, len(embedding) AS dims, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
    row_number() OVER () AS r FROM rows_),
scores AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CASE WHEN a.dims = 0 THEN 0 ELSE list_dot_product(a.v, b.v) END::BIGINT AS score
  FROM scaled a JOIN scaled b ON a.vec_id % 100 = 0 AND a.dims = b.dims AND a.r <> b.r),
positives AS (
  SELECT a, anchor_id, id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS p FROM scores WHERE same
  QUALIFY p <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id,
    row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.score DESC, n.id) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
  QUALIFY rank <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives"""
