"""Operator 8, removal of repeated substrings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id. Strings are ranked as in prefix doubling: a rank of 2n bytes comes from the pair of ranks at
offsets 0 and n, and ranks that are unique to a document leave early. Ranks are fingerprints, so
they are the same in all tasks; what is compared has 96 bits (a and b below).

Three things keep the pairs few and lose no match:

* First round, at sampled positions. Each string of ``length`` bytes picks one position in it, that
  of the smallest rank of 20 bytes, from its content alone; strings that follow each other and
  pick the same make a run. Spark sorts the runs by the rank they picked, and runs whose rank
  occurs in one document only are out: none of their strings can be in another.
* Second round, runs as a whole: the pair of ranks of the run's first and last string ranks the
  run's text. A run that a smaller document holds too is removed as it is.
* Third round, single strings of the runs left: pairs of ranks at offsets 0 and length / 2 rank the
  strings. In each of these rounds a task first settles what repeats within it, so that a passage
  with very many copies sends one row from each task.

The first and third round are each shuffled in ``WAVES`` parts, one after the other, by the lowest
bits of the ranks that meet, so that only a part of the pairs is on disk at once.

Defined results: a null text is as an empty one. Rows with a null id lose nothing and remove nothing.
Rows with the same id never remove bytes of each other; repeated rows give the same result each.
Texts shorter than ``length`` bytes stay whole. Remaining bytes may not be valid UTF-8 text. Ids are
whole numbers; others raise a ValueError, as does a key named as a result. An empty table gives no
row; other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import Scratch, slices

LENGTH = 50
SAMPLE = 20  # bytes whose rank picks the position
CHUNK = 2 << 20  # bytes whose ranks are in memory at once
TILE = 1 << 14  # strings that are ranked at once
LONGEST = 32  # strings in a run
WAVES = 2  # parts of the pairs of a round that are shuffled one after the other, a power of two
BYTES = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)  # ranks of single bytes


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the pair of ranks."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Ranks:
    """Ranks of all substrings of a chunk, by doubling; each length is worked out once."""

    def __init__(self, data: np.ndarray):
        self.known = {1: BYTES[data]}

    def __getitem__(self, n: int) -> np.ndarray:
        if n not in self.known:
            half = 1 << ((n - 1).bit_length() - 1)
            a, b = self[half], self[n - half]
            size = max(0, min(len(a), len(b) - half))
            self.known[n] = _pair(a[:size] + np.uint64(n), b[half : half + size])
        return self.known[n]


def _ranked(blob: bytes, length: int, sample: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all strings of ``length`` bytes, and the smallest rank of ``sample`` bytes in each (none if zero).

    They are worked out for ``TILE`` strings at a time, whose ranks stay in the processor's cache.
    """
    data = np.frombuffer(blob, np.uint8)
    n = max(0, len(data) - length + 1)
    whole, low = np.empty(n, np.uint64), np.empty(n if sample else 0, np.uint64)
    for i in range(0, n, TILE):
        ranks = Ranks(data[i : i + TILE + length - 1])
        part = slice(i, i + len(ranks[length]))
        whole[part] = ranks[length]
        if sample:
            least, covered, most = ranks[sample], 1, length - sample + 1
            while covered < most:  # minimum over a window, by doubling too
                step = min(covered, most - covered)
                least = np.minimum(least[:-step], least[step:])
                covered += step
            low[part] = least
    return whole, low


def _runs(blobs: list[bytes], length: int, sample: int):
    """Document, first string, strings, rank picked, rank of the text, of each run of a chunk."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    ends = np.cumsum(sizes)
    whole, low = _ranked(b"".join(blobs), length, sample)
    if not len(whole):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    new = np.ones(len(whole), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    begins = ends - sizes
    new[begins[begins < len(whole)]] = True
    first = np.flatnonzero(new)
    parts = -(-np.diff(np.append(first, len(whole))) // LONGEST)
    first = np.repeat(first, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    doc = np.searchsorted(ends, first, "right")
    inside = first + length <= ends[doc]
    first, doc = first[inside], doc[inside]
    n = np.minimum(np.append(first[1:], len(whole)), ends[doc] - length + 1) - first
    text = _pair(_pair(whole[first], whole[first + n - 1]), n.astype(np.uint64))
    return doc, first - begins[doc], n, low[first], text


def _settle(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows have their key (a, b) in a row with a smaller id."""
    order = np.lexsort((ids, b, a))
    x, y, i = a[order], b[order], ids[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    low = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(ids), bool)
    out[order] = low < i
    return out


def _spans(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring or overlapping (start, n) of the same key as one; sorted by key, start."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], (start + n)[order]
    if not len(key):
        return key, start, n
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > end[:-1])])
    at = np.flatnonzero(new)
    return key[at], start[at], np.maximum.reduceat(end, at) - start[at]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows, gathered until their bytes (column 0) fill a chunk."""
    parts, size = [], 0
    for b in batches:
        ends, i = np.cumsum(pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while i < b.num_rows:
            before = ends[i - 1] if i else 0
            j = min(b.num_rows, int(np.searchsorted(ends, before + CHUNK - size)) + 1)
            parts.append(b.slice(i, j - i))
            size, i = size + ends[j - 1] - before, j
            if size >= CHUNK:
                yield pa.Table.from_batches(parts)
                parts, size = [], 0
    if parts:
        yield pa.Table.from_batches(parts)


def _listed(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, start and n of each place in lists of structs (start, n); a null has none."""
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    chunks, rows = column.chunks if isinstance(column, pa.ChunkedArray) else [column], 0
    for c in chunks:
        size = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
        flat = c.flatten()
        out[0].append(np.repeat(np.arange(rows, rows + len(c)), size))
        for k, name in ((1, "start"), (2, "n")):
            out[k].append(flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64))
        rows += len(c)
    return tuple(np.concatenate(x) for x in out)


def _of_wave(a: np.ndarray, wave: int, waves: int) -> pa.Array:
    """Which rows a wave has, by their rank."""
    return pa.array((a & np.uint64(waves - 1)) == wave)


def _round_one(docs: DataFrame, length: int, sample: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """doc_id, tag, start, n of runs; settled: repeated from a smaller id of the same task; a, b: ranks of the others. Those of one wave."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            ids, tags = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            doc, start, n, a, b = _runs(rows.column(0).to_pylist(), length, sample)
            done = _settle(ids[doc], a, b)
            d, s, m = _spans(doc[done], start[done], n[done])
            left = ~done
            key = np.concatenate([d, doc[left]])
            fake = _pair(ids[d].astype(np.uint64), s.astype(np.uint64))  # spreads settled rows
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids[key]), pa.array(tags[key]), pa.array(np.concatenate([s, start[left]]).astype(np.int32)), pa.array(np.concatenate([m, n[left]]).astype(np.int32)), pa.array(np.arange(len(key)) < len(d)), pa.array(np.concatenate([fake, a[left]]).view(np.int64)), pa.array(np.concatenate([fake, b[left]]).astype(np.uint32).view(np.int32))],
                ["doc_id", "tag", "start", "n", "settled", "a", "b"],
            )
            yield batch.filter(_of_wave(np.concatenate([fake, a[left]]), wave, waves))

    return docs.select("bytes", "doc_id", "tag").mapInArrow(work, "doc_id long, tag int, start int, n int, settled boolean, a long, b int")


def _round_three(joined: DataFrame, length: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """doc_id, tag, start, n, settled, a, b as above, for single strings of the runs in ``runs``."""
    half = length // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            ids, tags, blobs = rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(0).to_pylist()
            sizes = np.array([len(x) for x in blobs], np.int64)
            offset = np.cumsum(sizes) - sizes
            of, first, n = _listed(rows.column(3))
            ranks, _ = _ranked(b"".join(blobs), half)
            doc = np.repeat(of, n)
            start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(doc))
            at = offset[doc] + start
            a, b = ranks[at], ranks[at + length - half]
            done = _settle(ids[doc], a, b)
            d, s, m = _spans(doc[done], start[done], np.ones(done.sum(), np.int64))
            left = ~done
            key = np.concatenate([d, doc[left]])
            fake = _pair(ids[d].astype(np.uint64), s.astype(np.uint64))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids[key]), pa.array(tags[key]), pa.array(np.concatenate([s, start[left]]).astype(np.int32)), pa.array(np.concatenate([m, np.ones(left.sum(), np.int64)]).astype(np.int32)), pa.array(np.arange(len(key)) < len(d)), pa.array(np.concatenate([fake, a[left]]).view(np.int64)), pa.array(np.concatenate([fake, b[left]]).astype(np.uint32).view(np.int32))],
                ["doc_id", "tag", "start", "n", "settled", "a", "b"],
            )
            yield batch.filter(_of_wave(np.concatenate([fake, a[left]]), wave, waves))

    return joined.mapInArrow(work, "doc_id long, tag int, start int, n int, settled boolean, a long, b int")


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias(name))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, sample: int = SAMPLE) -> DataFrame:
    """doc_id, tag, start, n: strings, n from each start, that also start in a document with a smaller id.

    docs: bytes, doc_id, tag, without nulls; tag tells rows of one id apart.
    """
    group, run = Window.partitionBy("a", "settled"), Window.partitionBy("a", "settled", "b")
    ones, threes = [], []
    for wave in range(WAVES):
        one = _round_one(docs, length, sample, wave, WAVES)
        one = one.select("*", F.min("doc_id").over(group).alias("low"), F.max("doc_id").over(group).alias("high"), F.min("b").over(group).alias("b0"), F.max("b").over(group).alias("b1"))
        one = one.where("settled or low < high").select("*", F.min("doc_id").over(run).alias("low_run"))
        # a run that opens its text is looked at string by string, if other texts share its rank
        ones.append(scratch.put(one.where("settled or low_run < doc_id or b0 < b1").select("doc_id", "tag", "start", "n", F.expr("settled or low_run < doc_id").alias("gone"))))
    one = reduce(DataFrame.unionByName, ones)
    left = _gathered(one.where("not gone"), "runs")
    joined = docs.join(left, ["doc_id", "tag"]).select("bytes", "doc_id", "tag", "runs")
    for wave in range(WAVES):
        three = _round_three(joined, length, wave, WAVES).select("*", F.min("doc_id").over(run).alias("low"))
        threes.append(scratch.put(three.where("settled or low < doc_id").select("doc_id", "tag", "start", "n")))
    return reduce(DataFrame.unionByName, [one.where("gone").select("doc_id", "tag", "start", "n"), *threes])


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, sample: int = SAMPLE) -> DataFrame:
    """key, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs) of each row."""
    if not isinstance(df.schema[key].dataType, T.IntegralType) or key.lower() in ("kept", "n_bytes", "n_removed", "n_spans"):
        raise ValueError(f"{key} has to be a column of whole numbers, not named as a result")
    if not 2 <= sample < length:
        raise ValueError("sample must lie between 2 and length")
    scratch = Scratch(df.sparkSession)
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = df.select(F.col(key).cast("long").alias("doc_id"), bytes_.alias("bytes")).withColumn("tag", F.hash("bytes"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.withColumn("tag", F.lit(0))  # ids tell all rows apart
    named = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("bytes") >= length))
    gone = _gathered(repeated_spans(named, scratch, length, sample), "gone")
    joined = docs.join(gone, ["doc_id", "tag"], "left").select("bytes", "gone", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], []]
            of, start, n = _listed(b.column(1))
            of, start, n = _spans(of, start, n + length - 1)
            cuts = np.searchsorted(of, np.arange(b.num_rows + 1)).tolist()
            start, end = start.tolist(), (start + n).tolist()
            for blob, i, j in zip(b.column(0).to_pylist(), cuts, cuts[1:]):
                at, rest = 0, []
                for k in range(i, j):
                    rest.append(blob[at : start[k]])
                    at = end[k]
                kept = b"".join([*rest, blob[at:]])
                for column, x in zip(out, (kept, len(blob), len(blob) - len(kept), j - i)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])], [key, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(work, T.StructType([T.StructField(key, T.LongType()), T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]))


def kept_digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result with the SHA-256 of the remaining bytes in place of the bytes."""
    return df.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
