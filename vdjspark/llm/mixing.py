"""Operator 7, mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. Its blocks flow at a rate of its weight over the weights of all
sources that have blocks left; so a source that ends speeds the others up, and nothing is rounded.
That flow gives each block a window: it is released in the slot in which its share of the flow
begins, and due at the end of the one in which it is complete. Each slot goes to the released block
with the earliest deadline. As the rates always add up to one, every block has a slot in its window,
and so at any slot each source is less than one block off its target, also where sources end.

The driver places the blocks, ``PLAN`` at most: inputs of more than ``PLAN * BLOCK`` documents get
larger blocks. Documents are numbered within buckets of a hash that hold all sources, so that a
large source makes no large task.

Defined results: null sources are a source of their own. Weights that are missing, null or not
positive are those of one part in ``period`` parts of the others. Ties of deadlines go to the
earlier release, then to the source that sorts first (null first). Documents are in a random order
within their source, the same on each run; repeated rows have places of their own. An empty table
gives none. Columns named as those added, or as those used meanwhile, raise a ValueError.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import free_of

PERIOD = 1024  # a weight that is missing is one part of it
BLOCK = 16  # documents in a block
BUCKET = 1024  # documents numbered together, about
RUN = 4096  # buckets whose counts are added up together
PLAN = 1 << 20  # most blocks that the driver places


class Flow:
    """The flow of all sources' blocks at the rates of their weights, in exact numbers.

    At level v source i has had min(blocks[i], weights[i] * v) blocks; a slot goes by for each block of the flow.
    """

    def __init__(self, blocks: list[int], weights: list[float]):
        exact = [Fraction(w) for w in weights]
        scale = math.lcm(*(w.denominator for w in exact))
        self.weights = [int(w * scale) for w in exact]
        ends = sorted((Fraction(n, w), n, w) for n, w in zip(blocks, self.weights))
        self.ends = [(n, w) for _, n, w in ends]  # a source ends at the level n / w
        self.near = [float(e) for e, _, _ in ends]
        self.done, self.rate = [0], [sum(self.weights)]  # blocks of ended sources and weights of the others, after each end
        for _, n, w in ends:
            self.done.append(self.done[-1] + n)
            self.rate.append(self.rate[-1] - w)

    def _at(self, k: int, w: int) -> int:
        """How many sources end below the level k / w, or at it."""
        p = bisect_right(self.near, k / w)
        while p and self.ends[p - 1][0] * w > k * self.ends[p - 1][1]:
            p -= 1
        while p < len(self.ends) and self.ends[p][0] * w <= k * self.ends[p][1]:
            p += 1
        return p

    def window(self, source: int, k: int) -> tuple[int, int]:
        """First slot of block k of a source, and the slot that it has to be over by."""
        w = self.weights[source]
        p, q = self._at(k, w), self._at(k + 1, w)
        return self.done[p] + self.rate[p] * k // w, self.done[q] - (-self.rate[q] * (k + 1) // w)


def schedule(blocks: list[int], weights: list[float]) -> list[list[tuple[int, int, int]]]:
    """(slot, release, deadline) of each block of each source, by the earliest deadline among those released."""
    flow = Flow(blocks, weights) if blocks else None
    out: list[list[tuple[int, int, int]]] = [[] for _ in blocks]
    coming = [(*flow.window(i, 0), i) for i, n in enumerate(blocks) if n]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []
    for t in range(sum(blocks)):
        while coming and coming[0][0] <= t:
            r, d, i = heapq.heappop(coming)
            heapq.heappush(ready, (d, r, i))
        d, r, i = heapq.heappop(ready)
        out[i].append((t, r, d))
        if len(out[i]) < blocks[i]:
            heapq.heappush(coming, (*flow.window(i, len(out[i])), i))
    return out


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD, bucket: int = BUCKET, plan: int = PLAN) -> DataFrame:
    """Add ``block``, ``release``, ``deadline``, ``slot`` and ``place`` (in the block) to the rows.

    Sorted by slot and place, the rows are the mixture. Without ``weights`` a source's weight is the
    square root of its rows.
    """
    free_of(df, "block", "release", "deadline", "slot", "place", "_source", "_bucket", "_n", "_before", "_smaller", "_name", "_window")
    spark = df.sparkSession
    name = F.col(source).cast("string")
    sizes = df.groupBy(name.alias("source")).agg(F.count("*").alias("n"))
    named = sorted(((r["source"], r["n"]) for r in sizes.collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    counts = [n for _, n in named]
    rows = sum(counts)
    block = max(block, math.ceil(rows / max(1, plan - len(counts))))
    given = [math.sqrt(n) if weights is None else weights.get(s) for s, n in named]
    valid = [w for w in given if w is not None and 0 < w < math.inf]
    given = [float(w) if w is not None and 0 < w < math.inf else (sum(valid) or 1) / period for w in given]
    placed = schedule([-(-n // block) for n in counts], given)

    names = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(named)], "_name string, _source int")
    numbered = df.join(F.broadcast(names), name.eqNullSafe(F.col("_name"))).drop("_name")
    order = F.xxhash64(F.lit(17), key)
    numbered = numbered.withColumn("_bucket", F.pmod(order, F.lit(max(1, math.ceil(rows / bucket)))))
    # documents of the source in the buckets before, in two steps, and of the sources before in the bucket
    held = numbered.groupBy("_source", "_bucket").agg(F.count("*").alias("_n")).withColumn("_run", F.expr(f"_bucket div {RUN}"))
    runs = held.groupBy("_source", "_run").agg(F.sum("_n").alias("_r")).withColumn("_r", F.sum("_r").over(Window.partitionBy("_source").orderBy("_run")) - F.col("_r"))
    within_run, in_bucket = Window.partitionBy("_source", "_run").orderBy("_bucket"), Window.partitionBy("_bucket").orderBy("_source")
    ahead = held.join(runs, ["_source", "_run"]).withColumn("_before", F.col("_r") + F.sum("_n").over(within_run) - F.col("_n"))
    ahead = ahead.withColumn("_smaller", F.sum("_n").over(in_bucket) - F.col("_n"))
    # a row for each bucket, as rows are dealt by bucket already: joined by source too, they would be dealt again
    ahead = ahead.groupBy("_bucket").agg(F.map_from_entries(F.collect_list(F.struct("_source", F.col("_before") - F.col("_smaller")))).alias("_before"))
    ties = [c for c, t in df.dtypes if c != key and not t.startswith(("map", "variant"))]
    within = Window.partitionBy("_bucket").orderBy("_source", order, key, F.xxhash64(*ties) if ties else F.lit(0))
    numbered = numbered.withColumn("_n", F.row_number().over(within)).join(ahead, "_bucket")
    numbered = numbered.withColumn("_n", F.col("_before")[F.col("_source")] + F.col("_n") - 1)
    numbered = numbered.withColumn("block", F.expr(f"_n div {int(block)}")).withColumn("place", (F.col("_n") % block).cast("int"))

    flat = np.array([x for s in placed for x in s], np.int64).reshape(-1, 3)
    first = np.cumsum([0] + [len(s) for s in placed])
    table = spark.createDataFrame([(i, flat[first[i] : first[i + 1]].ravel().tolist()) for i in range(len(placed))], "_source int, _window array<long>")
    at = lambda j: F.element_at("_window", (F.col("block") * 3 + j + 1).cast("int"))
    return numbered.join(F.broadcast(table), "_source").select(*df.columns, "block", at(1).alias("release"), at(2).alias("deadline"), at(0).alias("slot"), "place")
