"""The queries of this subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, language, lines, mixing, packing, quality, simhash, suffix, topk, urls
from .common import fold_is, table

#: The vocabulary that op4 and the pipeline pack with.
TOKENIZER = "byte_bpe_50k.json"


def _held(divisor: int, remainder: int):
    """Whether a row is held out; rows without an id are."""
    return F.coalesce(fold_is("doc_id", divisor, remainder), F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _held(5, 0))
    model = language.train_language_model(docs.where("not held_out"))
    return language.identify_languages(docs, model, spans=False, keep=["doc_id", "held_out"])


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(TOKENIZER))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _held(4, 2))
    labels = table(spark, sf_dir, "labels").where(~_held(4, 2))
    return quality.score_quality(docs, quality.train_quality_model(docs, labels), keep=["doc_id", "held_out"])


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.kept_digest(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_nearest_neighbours, op3_simhash_near_dedup, op4_best_fit_packing, op5_quality_classifier, op6_bit_sliced_top_k, op7_source_mixing, op8_suffix_dedup, op9_line_dedup, op10_url_filter)
}

SQL: dict[str, str] = {
    "op6_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_url_filter": urls.filter_urls_sql(),
}
