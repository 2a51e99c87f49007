"""Blocks of vectors: the frame that the two vector searches share.

Data rows fall by hash into blocks of bounded size, query rows into groups of bounded size; each
task gets one block and one group, and returns a few rows for each query. Groups are large, so that
a block is indexed once or a few times; only while blocks are fewer than the cores there are more groups. Blocks are merged by a
ranking over what they returned. No side is broadcast, and no task holds more than a block and a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

BLOCK, GROUP = 16_384, 32_768


def finite(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array of doubles) of rows with an id and a vector of finite components, not empty."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~bad)


def search(data: DataFrame, queries: DataFrame, near: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], score: str, k: int, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of all blocks, ties to the smaller vec_id.

    near(ids, vectors, query ids, query vectors) gives query_id, vec_id, score for one block, its
    rows sorted by id; vectors are compared with those of their own length only.
    """
    sizes = data.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    blocks, groups = (max(1, math.ceil(n / most)) for n, most in zip(sizes, (block, group)))
    groups = max(groups, min(math.ceil(data.sparkSession.sparkContext.defaultParallelism / blocks), math.ceil(sizes[1] / 64), 64))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b")).select("*", every(groups).alias("g"))
    right = queries.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g")).select("*", every(blocks).alias("b"))

    def work(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(x) and len(q):
            x, q = x.sort_values("vec_id", kind="stable"), q.sort_values("vec_id", kind="stable")
            by, asked = x["v"].map(len), q["v"].map(len)
            for n in sorted(set(by) & set(asked)):
                a, b = x[by == n], q[asked == n]
                out.append(near(a["vec_id"].to_numpy(), np.stack(a["v"].to_list()), b["vec_id"].to_numpy(), np.stack(b["v"].to_list())))
        none = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64 if score == "long" else float)}
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(none)

    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(work, f"query_id long, vec_id long, score {score}")
    order = F.nanvl("score", F.lit(float("-inf"))) if score == "double" else F.col("score")
    best = Window.partitionBy("query_id").orderBy(order.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
