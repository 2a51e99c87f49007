"""Counts of reads by barcode and reject reason, over a folder that sequencers add FASTQ files to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import reads as R
from ..options import Options


def stream_reads(spark: SparkSession, folder: str, phred: int = 33) -> DataFrame:
    """id, seq, qual of the four-line records of each file; a file is one row of the stream, so files are of a size that fits a task."""
    lines = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(lines.alias("l"))
    record = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("l") / 4).cast("int"), F.lit(1)) - 1), lambda i: F.struct(F.get("l", i * 4).alias("id"), F.get("l", i * 4 + 1).alias("seq"), F.get("l", i * 4 + 3).alias("q")))
    rows = files.select(F.inline(record)).where("seq is not null and q is not null")
    qual = F.when(F.length("seq") > 0, F.zip_with(F.split("seq", ""), F.split("q", ""), lambda b, q: F.when(b == "N", 0).otherwise(F.ascii(q) - phred))).otherwise(F.array().cast("array<int>"))
    return rows.select(F.regexp_replace("id", "^@", "").alias("id"), F.upper("seq").alias("seq"), qual.alias("qual"))


def barcode_counts(reads: DataFrame, options: Options) -> DataFrame:
    """bc_seq, reject, n_reads: running counts, for output mode ``update`` or ``complete``. The state has a row for each barcode and reason."""
    return R.prepare(reads, options).groupBy("bc_seq", "reject").agg(F.count("*").alias("n_reads"))
