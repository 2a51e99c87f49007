"""Connected components of links between documents, fingerprints or lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

FEW = 1 << 18  # most edges that one task joins by itself, in place of rounds


def _round(edges: DataFrame) -> DataFrame:
    """A large star and a small star: each node's neighbours move to the smallest of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.where("u > v").unionByName(low.withColumnRenamed("m", "v")).distinct()


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all edges (u, v) at once: roots move to the least root across an edge until none does."""
    edges = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
    nodes, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *edges], 1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component of each node of ``edges`` (u, v long); the component is its smallest node.

    Up to ``FEW`` edges are joined in one task. More take alternating large-star and small-star rounds,
    each written to the shared folder, until nothing changes or few edges are left; the number of rounds
    grows with the logarithm of the nodes. Loops, nulls and repeated
    edges don't matter; nodes without an edge to another aren't returned.
    """
    now = scratch.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state or not seen[0]:
            break
        if seen[0] <= FEW:
            return scratch.put(now.select("u", "v").coalesce(1).mapInArrow(_few, "node long, component long"))
        state, last = seen, now
        now = scratch.put(_round(last))
        scratch.drop(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component, as above, of the links that ``nodes`` came from and more ``links`` (u, v long)."""
    named = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    edges = links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("u_of", "u").alias("u"), F.coalesce("v_of", "v").alias("v"))
    more = scratch.put(connected_components(edges, scratch))
    moved = nodes.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return scratch.put(moved.unionByName(more.join(nodes, "node", "left_anti")))
