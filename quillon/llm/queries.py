"""The registered queries of this subpackage: thin digests of the operators' results, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, context_tree, language_id, learned_partitions, mixing, quality_model, quality_rules, records, sharding, simhash
from quillon.llm.common import id_residue, table

def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(quality_rules.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    return quality_rules.score(docs, rules)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).drop("copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", F.coalesce(id_residue(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(id_residue(F.col("doc_id"), 5) == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.new_folder(spark)
    return records.read(records.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")), folder)


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules, op2_mixing, op3_simhash, op4_context_tree, op5_learned_partitions,
            op6_language_id, op7_bpe, op8_quality_model, op9_records, op10_kd_shards,
        )
    }


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS of_text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source COLLATE "BINARY" ASC NULLS LAST) - 1 AS rank FROM per
), weighted AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked
), levels AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY 3.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest_weight,
    row_number() OVER (ORDER BY 3.0 * source_size / weight, rank) AS row
  FROM weighted
), leveled AS (SELECT *, (total - 3.0::DOUBLE * capped) / rest_weight AS level FROM levels
), chosen AS (SELECT level FROM leveled WHERE level * weight <= 3.0::DOUBLE * source_size ORDER BY row LIMIT 1
), targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM chosen) * weight) AS target FROM weighted
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.of_text), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL}
