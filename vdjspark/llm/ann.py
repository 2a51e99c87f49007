"""Operator 2, approximate nearest neighbours by collision counting.

Each block of vectors is projected on single random lines, and the projections on each line are
sorted and cut into pages of as many rows. A query opens a window around its own projection on every
line and widens all windows together, step by step (virtual rehashing: a wider bucket needs no new
table). A vector that falls in the windows of enough lines is a candidate; widening stops when the
candidates are enough, and candidates are verified by their exact inner product.

A window is a run of pages, and its rows are a bitmap: the difference of those of all pages before
its end and before its begin. Bitmaps of all lines are added place by place by carry-save adders, 64
rows a word. So lines are cheap, and many of them part near rows from others sharply: few are
verified. The first width of a query is found by bisection over a sample of the rows.

Largest inner products become smallest distances by a further coordinate that brings all vectors
of a block to one length, and all queries to that length too.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do null ids. A repeated id is one query (its largest vector, in array order), and all
its rows are candidates of others. Fewer candidates than ``k``: all of them. Components may be of
any finite size: projections are those of vectors scaled by the largest of them. A score that isn't
a number, as infinite parts of it cancel, sorts last. Ties go to the smaller id. An empty table gives
no row; other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .vectors import BLOCK, GROUP, finite, search

LINES, NEEDED, SHARE = 256, 0.6, 0.08
FIRST, STEP = 0.6, 1.03  # half a window's first width, against the vectors' length, and its growth
PAGES = 64  # of a line
TOGETHER, SAMPLED = 64, 8  # queries whose counters are in memory at once; one word in so many is in the sample


def added(bitmaps: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Binary places, the lowest first, of the number of bitmaps that have each bit."""
    places: list[list[np.ndarray]] = []

    def add(j: int, b: np.ndarray) -> None:
        while True:
            if j == len(places):
                places.append([])
            places[j].append(b)
            if len(places[j]) < 3:
                return
            x, y, z = places[j]
            b, one = x & y, x ^ y
            b |= one & z
            one ^= z
            places[j], j = [one], j + 1

    for b in bitmaps:
        add(0, b)
    j = 0
    while j < len(places):
        if len(places[j]) == 2:
            x, y = places[j]
            places[j] = [x ^ y]
            add(j + 1, x & y)
        j += 1
    return [x for x, in places]


def at_least(places: list[np.ndarray], least: int) -> np.ndarray:
    """Bitmap of where a number is ``least`` or more; places: its binary places, the lowest first."""
    out = np.full_like(places[0], ~np.uint64(0))
    for j, x in enumerate(places):
        if least >> j & 1:
            out &= x
        else:
            out |= x
    return out


class Pages:
    """Sorted projections of a block's vectors on random lines, in pages, and bitmaps of the rows of all pages before each."""

    def __init__(self, x: np.ndarray, lines: int, pages: int, seed: int):
        self.n, pages = len(x), min(pages, len(x))
        x = x / np.abs(x).max()
        norm = np.einsum("ij,ij->i", x, x)
        self.length = np.sqrt(norm.max())
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, lines))
        px = (x @ self.a[:-1] + np.sqrt(np.maximum(0, norm.max() - norm))[:, None] * self.a[-1]).T
        order = np.argsort(px, axis=1, kind="stable")
        opens = np.arange(pages + 1) * self.n // pages
        self.first, self.last = (np.take_along_axis(px, order[:, at], 1) for at in (opens[:-1], opens[1:] - 1))
        page, ends = np.repeat(np.arange(pages), np.diff(opens)), np.arange(pages + 1)[:, None]
        before = np.zeros((lines, pages + 1, -(-self.n // 64) * 8), np.uint8)
        of = np.empty(self.n, np.min_scalar_type(pages))
        for k in range(lines):
            of[order[k]] = page
            before[k, :, : -(-self.n // 8)] = np.packbits(of < ends.astype(of.dtype), axis=1, bitorder="little")
        self.before = before.view(np.uint64)

    def project(self, q: np.ndarray) -> np.ndarray:
        """Queries' projections by line, all of one length."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return ((q * (self.length / np.sqrt(np.einsum("ij,ij->i", q, q)))[:, None]) @ self.a[:-1]).T

    def passing(self, at: np.ndarray, w: np.ndarray, threshold: int, every: int = 1) -> np.ndarray:
        """For each query (at: projections, w: half the width) a bitmap of the rows in at least ``threshold`` of its windows; of one word in ``every``."""

        def windows() -> Iterator[np.ndarray]:
            for k, before in enumerate(self.before):
                begin, end = np.searchsorted(self.last[k], at[k] - w, "left"), np.searchsorted(self.first[k], at[k] + w, "right")
                before = before[:, ::every]
                rows = before.take(end, axis=0)
                rows ^= before.take(begin, axis=0)
                yield rows

        return at_least(added(windows()), threshold)


def collide(x: np.ndarray, q: np.ndarray, least: int, lines: int = LINES, needed: float = NEEDED, step: float = STEP, seed: int = 11, pages: int = PAGES):
    """For each query the rows that pass the collision threshold when at least ``least`` do."""
    index, threshold = Pages(x, lines, pages, seed), max(1, round(needed * lines))
    all_rows = np.packbits(np.arange(index.before.shape[2] * 64) < index.n, bitorder="little").view(np.uint64)
    every = SAMPLED if index.n >= 64 * SAMPLED * SAMPLED else 1
    enough = least * int(np.bitwise_count(all_rows[::every]).sum()) / index.n
    for start in range(0, len(q), TOGETHER * every):
        at = index.project(q[start : start + TOGETHER * every])
        width = lambda e: FIRST * index.length * step ** e.astype(float)
        farthest = max(np.abs(index.first).max(), np.abs(index.last).max()) + np.abs(at).max()
        low = np.zeros(at.shape[1], np.int64)
        high = low + max(0, math.ceil(math.log(farthest / (FIRST * index.length), step)) + 1)  # all rows are in all windows
        while (low < high).any():
            middle = (low + high) // 2
            few = np.bitwise_count(index.passing(at, width(middle), threshold, every)).sum(1) < enough
            low, high = np.where(few & (low < high), middle + 1, low), np.where(few, high, middle)
        for begin in range(0, at.shape[1], TOGETHER):
            part = at[:, begin : begin + TOGETHER]
            e, found, open_ = low[begin : begin + TOGETHER], {}, np.arange(part.shape[1])
            while len(open_):
                rows = index.passing(part[:, open_], width(e[open_]), threshold)
                done = np.bitwise_count(rows).sum(1) >= least
                found |= zip(open_[done].tolist(), rows[done])
                open_ = open_[~done]
                e[open_] += 1
            yield from (np.flatnonzero(np.unpackbits(found[i].view(np.uint8), bitorder="little")) for i in range(part.shape[1]))


def nearest_in_block(k: int, share: float = SHARE):
    def near(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        out: list[list[np.ndarray]] = [[], [], []]
        least = min(len(x), 8 * k + 1 + int(share * len(x)))
        for i, rows in enumerate(collide(x, q, least)):
            rows = rows[ids[rows] != query_ids[i]]
            with np.errstate(over="ignore", invalid="ignore"):
                score = x[rows] @ q[i]
            best = np.lexsort((ids[rows], -score))[:k]
            for column, v in zip(out, (np.full(len(best), query_ids[i]), ids[rows][best], score[best])):
                column.append(v)
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), out)})

    return near


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, share: float = SHARE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row, by inner product."""
    rows = finite(df, key, vector).where(F.exists("v", lambda x: x != 0))
    asked = finite(df.where(is_query), key, vector).where(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.max("v").alias("v"))
    return search(rows, asked, nearest_in_block(k, share), "double", k, block, group)
