"""Sequence files: FASTA and FASTQ, plain or gzip, by any file system that Spark reads."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F


def _numbered(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """n, value of a text's records in the order of the files' names and places; numbers come from the counts of the splits, of which a small table is broadcast."""
    lines = spark.read.text(path, lineSep=separator).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy("file", "block").collect()
    before = accumulate((r["n"] for r in splits), initial=0)
    first = spark.createDataFrame([(r["file"], r["block"], n - r["low"]) for r, n in zip(splits, before)], "file string, block long, shift long")
    return lines.join(F.broadcast(first), ["file", "block"]).select((F.col("id") + F.col("shift")).alias("n"), "value")


def read_fasta(spark: SparkSession, path: str, default_quality: int = 60, most: int = 0) -> DataFrame:
    """record_no, id, seq (upper case), qual: the default quality, and 0 for N; the first ``most`` records, 0 for all."""
    rows = _numbered(spark, path, "\n>").where(F.length(F.trim("value")) > 0)
    rows = rows.where(F.col("n") < most) if most else rows
    text = F.regexp_replace("value", "^>", "")
    seq = F.upper(F.regexp_replace(F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1), r"\s", ""))
    out = rows.select(F.col("n").alias("record_no"), F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1)).alias("id"), seq.alias("seq"))
    return out.withColumn("qual", F.when(F.length("seq") > 0, F.transform(F.split("seq", ""), lambda b: F.when(b == "N", 0).otherwise(default_quality))).otherwise(F.array().cast("array<int>")))


def read_fastq(spark: SparkSession, path: str, phred: int = 33, most: int = 0) -> DataFrame:
    """record_no, id, seq, qual of a file of four-line records, the first ``most`` ones, 0 for all; N has quality 0."""
    rows = _numbered(spark, path, "\n")
    rows = (rows.where(F.col("n") < 4 * most) if most else rows).select(F.expr("n div 4").alias("record_no"), (F.col("n") % 4).alias("k"), F.rtrim("value").alias("value"))
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    out = rows.groupBy("record_no").agg(of(0).alias("id"), of(1).alias("seq"), of(3).alias("q")).where("seq is not null and q is not null")
    qual = F.when(F.length("seq") > 0, F.zip_with(F.split("seq", ""), F.split("q", ""), lambda b, q: F.when(b == "N", 0).otherwise(F.ascii(q) - phred))).otherwise(F.array().cast("array<int>"))
    return out.select("record_no", F.regexp_replace("id", "^@", "").alias("id"), F.upper("seq").alias("seq"), qual.alias("qual"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Germline segments: seg_idx, locus, seg_type, seg_id, allele, motif_pos, seq. D segments are skipped, other types an error."""
    part = lambda k: F.coalesce(F.get(F.split("id", "\\|"), k), F.lit(""))
    rows = read_fasta(spark, path).select("record_no", part(0).alias("locus"), part(1).alias("seg_type"), part(2).alias("seg_id"), part(3).alias("allele"), F.coalesce(F.regexp_extract(part(4), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("motif_pos"), "seq")
    known = F.when(F.col("seg_type").isin("V", "J", "D"), F.col("seg_type")).otherwise(F.raise_error(F.concat(F.lit("unknown segment type: "), F.col("seg_type"))))
    return rows.withColumn("seg_type", known).where("seg_type <> 'D'").withColumn("seg_idx", F.col("record_no").cast("int")).select("seg_idx", "locus", "seg_type", "seg_id", "allele", "motif_pos", "seq")


def reference_from_gapped(gapped: DataFrame, locus: str, position: int) -> DataFrame:
    """Reference records of aligned V regions (id, seq with dots): the motif lies at ``position`` of the alignment, from 1.

    Regions that are shorter are skipped; a name is gene*allele, in the second field of the id.
    """
    name = F.split(F.get(F.split("id", "\\|"), 1), "\\*")
    rows = gapped.where(F.length("seq") >= position)
    motif = F.lit(position - 1) - F.length(F.regexp_replace(F.substring("seq", 1, position), "[^.]", ""))
    gene = F.regexp_extract(F.get(name, 0), r"^[A-Z]{3}[VDJ](.*)$", 1)
    return rows.select(F.lit(locus).alias("locus"), F.lit("V").alias("seg_type"), gene.alias("seg_id"), F.lpad(F.coalesce(F.get(name, 1), F.lit("1")), 2, "0").alias("allele"), motif.alias("motif_pos"), F.regexp_replace("seq", "\\.", "").alias("seq"))
