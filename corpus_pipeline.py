"""The training-data pipeline: five stages over ``documents``, each on all that the one before it kept.

Each stage but the last returns the columns of ``documents``. ``run`` writes what a stage returns
to the shared checkpoint folder and hands the next one the reread table.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession, functions as F

from vdjspark.llm import language, lines, mixing, packing, simhash
from vdjspark.llm.common import Scratch, fold_is, free_of, table
from vdjspark.llm.queries import TOKENIZER

LEAST_SCORE = 0.5  # of the language label


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too), and those whose label is in doubt. Rows with a null id aren't learned from."""
    model = language.train_language_model(docs.where(~fold_is("doc_id", 5, 0)))
    judged = language.identify_languages(docs, model, spans=False)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat, exactly or nearly, from all but one document; documents stay, even empty ones. Repeated rows keep the same lines."""
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that a similarity of five-word shingles of 0.8 links; rows that repeat are one, a null id sorts first."""
    free_of(docs, "_key", "_row")
    row = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row")))
    kept = simhash.similar_duplicates(row, key="_key").where("_key = component_id").select(F.col("_key.row").alias("_row")).distinct()
    return row.withColumn("_row", F.col("_key.row")).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: over the files that are written, and within each. Null sources are a source, and repeated rows have places of their own."""
    return mixing.mix(docs).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, which follow the order that the documents were written in, that of the mixture."""
    return packing.pack(docs, tokenizer_file(TOKENIZER))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: SQL can't express tokenization, fingerprints or Viterbi labels; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        last, docs = docs, scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
