"""Cutting lineage by files in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F

FEW = 32_768  # rows


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir; to a temporary one where that is unset and driver and executors are one machine."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def handed_out(df: DataFrame) -> DataFrame:
    """A checkpoint's rows, marked to be sent to all tasks if they are few: so the many rows that meet them stay where they are."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
