"""Operator 6, exact top-k search on a bit-sliced index.

Components are quantised to integers floor(scale * x), and each block of rows keeps them as bit
slices: one bitmap over the rows for each attribute and binary place. A query's integer weights
add the slices with bitmap arithmetic (shifted carry additions), which gives the slices of all
scores at once. Rows are then selected from the most significant slice downward: those surely
among the best, and those that tie so far; the boundary is resolved exactly by id.

Vectors with a component of ``WIDE`` or more in size, once quantised, are scored in whole numbers of
any length instead, as are all scores of queries with one.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do null ids. A repeated id is one query (its largest vector, in array order), and all its rows
are candidates of others. Fewer candidates than ``k``: all of them. Ties go to the smaller id. Scores
beyond 64 bits count as the nearest number of 64 bits. An empty table gives no row; other
columns take no part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .vectors import GROUP, finite, search

SCALE, WIDE = 256, 1 << 26
BLOCK = 65_536


class BitSlices:
    """Two's complement bit slices of integer attributes over rows."""

    def __init__(self, x: np.ndarray):
        self.n, self.dims = x.shape
        self.words = -(-self.n // 64)
        self.width = int(max(abs(int(x.min())), abs(int(x.max())))).bit_length() + 1
        padded = np.zeros((self.words * 64, self.dims), np.int64)
        padded[: self.n] = x
        places = np.arange(self.width, dtype=np.int64)
        self.slices = np.empty((self.dims, self.width, self.words), np.uint64)
        for j in range(self.dims):
            bits = (padded[:, j, None] >> places & 1).astype(np.uint8)
            self.slices[j] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
        self.valid = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Slices, the lowest first and the sign last, of the weighted sum of the attributes."""
        places = self.width + int(np.abs(weights).sum()).bit_length() + 1
        total = np.zeros((places, self.words), np.uint64)
        carry, a, b = (np.zeros(self.words, np.uint64) for _ in range(3))
        for j, w in enumerate(weights.tolist()):
            negative, w, shift = w < 0, abs(w), 0
            while w:  # signed digits: runs of ones cost one addition and one subtraction
                if w & 1:
                    digit = 2 - (w & 3)
                    w -= digit
                    self._add(total, self.slices[j], shift, (digit < 0) != negative, carry, a, b)
                w, shift = w >> 1, shift + 1
        return total

    def _add(self, total: np.ndarray, x: np.ndarray, shift: int, minus: bool, carry: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """total += or -= x << shift, by full adders; a difference adds the complement and one."""
        carry.fill(0xFFFFFFFFFFFFFFFF if minus else 0)
        top = len(x) - 1
        for i in range(shift, len(total)):
            y, t = x[min(i - shift, top)], total[i]
            if minus:
                y = np.bitwise_not(y, out=b)
            np.bitwise_xor(t, y, out=a)
            np.bitwise_and(t, y, out=b)
            np.bitwise_xor(a, carry, out=t)
            carry &= a
            carry |= b

    def top(self, total: np.ndarray, k: int, among: np.ndarray) -> np.ndarray:
        """Rows of the ``k`` largest sums among those of a bitmap; of ties the first rows."""
        sure, ties, missing = np.zeros(self.words, np.uint64), among.copy(), k
        for i in range(len(total) - 1, -1, -1):
            high = ties & (~total[i] if i == len(total) - 1 else total[i])  # the sign counts the other way
            n = int(np.bitwise_count(high).sum())
            if n > missing:
                ties = high
            else:
                sure |= high
                missing -= n
                ties &= ~high
                if not missing:
                    break
        rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        return np.concatenate([rows(sure), rows(ties)[:missing]])

    def value(self, total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bits = (total[:, rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        weights = np.int64(1) << np.arange(len(total), dtype=np.int64)
        weights[-1] = -weights[-1]
        return weights @ bits


def exact(v: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, of whatever size."""
    return [int(x) * scale if abs(x) >= 2.0**52 else math.floor(int(scale) * x) for x in v.tolist()]


def top_in_block(k: int, scale: int):
    least, most = -(1 << 63), (1 << 63) - 1

    def near(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            wide, wide_q = (np.abs(v * scale).max(1) >= WIDE for v in (x, q))
        narrow, out = np.flatnonzero(~wide), [[], [], []]
        index = BitSlices(np.floor(x[narrow] * scale).astype(np.int64)) if len(narrow) and not wide_q.all() else None
        by_hand = {int(r): exact(x[r], scale) for r in (range(len(ids)) if wide_q.any() else np.flatnonzero(wide))}
        for i, query_id in enumerate(query_ids):
            rows, scores = [], []
            if not wide_q[i] and index is not None:
                total, among = index.scores(np.floor(q[i] * scale).astype(np.int64)), index.valid.copy()
                for row in range(*np.searchsorted(ids[narrow], [query_id, query_id + 1])):
                    among[row // 64] &= ~np.uint64(1 << row % 64)
                found = index.top(total, k, among)
                rows, scores = narrow[found].tolist(), index.value(total, found).tolist()
            if by_hand and (wide_q[i] or wide.any()):
                weights = exact(q[i], scale)
                for r in by_hand if wide_q[i] else np.flatnonzero(wide).tolist():
                    if ids[r] != query_id:
                        rows.append(r)
                        scores.append(min(max(sum(a * b for a, b in zip(by_hand[r], weights)), least), most))
            best = sorted(range(len(rows)), key=lambda j: (-scores[j], ids[rows[j]]))[:k]
            for column, v in zip(out, ([query_id] * len(best), [ids[rows[j]] for j in best], [scores[j] for j in best])):
                column.extend(v)
        return pd.DataFrame({c: np.array(v, np.int64) for c, v in zip(("query_id", "vec_id", "score"), out)})

    return near


def top_scores(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = SCALE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each query row."""
    asked = finite(df.where(is_query), key, vector).groupBy("vec_id").agg(F.max("v").alias("v"))
    return search(finite(df, key, vector), asked, top_in_block(k, scale), "long", k, block, group)
