"""Registry: one query per operator and the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from freshet.llm import conversation_repair, filter_audit, jaccard_join, language_id, mixing, neighbours, oracles, packing, secret_scan, sharding, simhash, spotsigs, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_best_fit_packing": lambda spark, d: packing.best_fit(_table(spark, d, "documents")),
    "op2_language_id": lambda spark, d: language_id.held_out_language(_table(spark, d, "documents")),
    "op3_simhash_pivots": lambda spark, d: simhash.near_copies(_table(spark, d, "documents")),
    "op4_posting_lists": lambda spark, d: neighbours.search(_table(spark, d, "embeddings")),
    "op5_toxicity": lambda spark, d: toxicity.held_out_toxicity(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op6_token_files": _op6,
    "op7_spotsigs": lambda spark, d: spotsigs.fingerprint_edits(_table(spark, d, "documents")),
    "op8_label_propagation_shards": lambda spark, d: sharding.assign(_table(spark, d, "documents")),
    "op9_source_mix": lambda spark, d: mixing.mix_sizes(_table(spark, d, "documents")),
    "op10_secret_scan": lambda spark, d: secret_scan.digest(_table(spark, d, "documents")),
    "op11_filter_audit": lambda spark, d: filter_audit.audit(_table(spark, d, "documents"), _table(spark, d, "labels")),
    "op12_conversation_repair": lambda spark, d: conversation_repair.repaired(_table(spark, d, "conversations")),
    "op13_jaccard_join": lambda spark, d: jaccard_join.classes(_table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op12_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op13_jaccard_join": oracles.JACCARD_JOIN,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op9_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), turned AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sums
), weighted AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM turned
), ranked AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS ratio, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight FROM weighted
), before AS (
  SELECT *, coalesce(sum(source_size) OVER w, 0)::BIGINT AS size_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
  FROM ranked WINDOW w AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stops AS (
  SELECT *, source_size * 2 * (all_weight - weight_before) < (all_size * 1.5::DOUBLE - size_before * 2) * weight AS stop FROM before
), shares AS (
  SELECT *, coalesce(sum(CASE WHEN stop THEN source_size END) OVER (), 0)::BIGINT AS stopped_size, coalesce(sum(CASE WHEN stop THEN weight END) OVER (), 0)::BIGINT AS stopped_weight FROM stops
), aims AS (
  SELECT source, source_size, CASE WHEN stop THEN (source_size * 2)::DOUBLE
    ELSE weight * ((all_size * 1.5::DOUBLE - stopped_size * 2) / nullif(all_weight - stopped_weight, 0)) END AS target FROM shares
), rated AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CASE WHEN a.source_size = 0 THEN 0 ELSE a.target / a.source_size END AS rate,
    ('0x' || substr(md5('9:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
