"""Rows that meet on keys: packed in blobs for the shuffle, sorted in numpy where they arrive.

Of a large set only as many pairs as it has rows come first. What they leave is kept as the set's
rows; ``rest`` makes all other pairs of these that links found meanwhile haven't joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KNOWN = 1024  # rows of a large set whose pairs are all looked at when the set is met
BLOCK = 1 << 20  # pairs of hashes that are compared at once
Own = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Read = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def dealt(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; where keys meet it stands in place of their upper halves."""
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def packed(found: list[tuple[np.ndarray, ...]], shards: int, names: list[str], nulls: list[pa.DataType]) -> pa.RecordBatch:
    """Rows of keys, what has them (64 bits) and, if given, its hash of 32 bits, in a blob for each shard, which the keys' upper halves choose."""
    keys, *rest = (np.concatenate(x) for x in zip(*found))
    shard = dealt(keys, shards)
    order = np.argsort(shard, kind="stable")
    shard, parts = shard[order], [(keys[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), *(x[order] for x in rest)]
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    blobs = [b"".join(x[i:j].tobytes() for x in parts) for i, j in zip(at, np.append(at[1:], len(shard)))]
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(at), t) for t in nulls), pa.array(shard[at].astype(np.int32)), pa.array(blobs, pa.binary())], names)


def unpacked(batches: Iterator[pa.RecordBatch], hashes: bool) -> list[np.ndarray]:
    """Keys, what has them and, if they were given, its hashes, of all blobs of the batches (shard, blob)."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]]
    for b in batches:
        for shard, blob in zip(b.column(0).to_pylist(), b.column(1)):
            data = np.frombuffer(blob.as_buffer(), np.uint8)
            n = len(data) // (16 if hashes else 12)
            out[0].append(data[: 4 * n].view("<u4").astype(np.uint64) | np.uint64(shard << 32))
            out[1].append(np.frombuffer(data[4 * n : 12 * n].tobytes(), "<u8"))
            out[2].append(np.frombuffer(data[12 * n :].tobytes(), "<u4"))
    return [np.concatenate(x) for x in out]


def _middle(low: np.ndarray) -> int:
    """The place of the hash that is nearest to what most hashes have in each bit."""
    bits = np.unpackbits(np.ascontiguousarray(low, low.dtype.newbyteorder("<")).view(np.uint8).reshape(len(low), -1), axis=1)
    return int((bits != (2 * bits.sum(0, dtype=np.int64) > len(low))).sum(1).argmin())


def _large(low: np.ndarray, near: int, middle: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of a large set: each is near a first one, of which there are as many as it takes; with ``middle``,
    the first one is in the middle of those left, and all are also paired with those next in two orders of the hash."""
    out, todo = [], np.arange(len(low))
    while len(todo) > 1:
        first = todo[_middle(low[todo]) if middle else 0]
        close = np.bitwise_count(low ^ low[first]) <= near
        close[first] = False
        at = np.flatnonzero(close)
        out.append((np.full(len(at), first), at))
        todo = todo[~close[todo] & (todo != first)]
    half = low.dtype.type(4 * low.dtype.itemsize)
    for order in ((np.argsort(low, kind="stable"), np.argsort(low << half | low >> half, kind="stable")) if middle else ()):
        a, b = order[:-1], order[1:]
        close = np.bitwise_count(low[a] ^ low[b]) <= near
        out.append((a[close], b[close]))
    return tuple(np.concatenate([x[k] for x in out]) for k in (0, 1))


def _missed(low: np.ndarray, near: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places that have a near pair which isn't among the pairs a, b; all places of a set of more than ``KNOWN``."""
    n = len(low)
    if n > KNOWN:
        return np.arange(n)
    x, y = np.nonzero(np.triu(np.bitwise_count(low[:, None] ^ low) <= near, 1))
    own = keep(x, y)
    x, y = x[own], y[own]
    new = ~np.isin(x * n + y, np.minimum(a, b) * n + np.maximum(a, b))
    return np.unique(np.concatenate([x[new], y[new]]))


def met_on(keys: np.ndarray, one: np.ndarray, low: np.ndarray, most: int, near: int, middle: bool, own: Own | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Pairs (by ``one``, as signed, the smaller first) of rows that meet on a key and whose hashes are near, and what is left of large sets.

    All pairs of up to ``most`` rows; more are paired as in ``_large``, so that pairs grow with the
    rows, and the rows that have other near pairs are returned as key, ``one`` and hashes.
    ``own(keys, a, b)``, if given, tells at which of the keys that two rows meet on they are paired.
    """
    none = np.zeros((0, 2), np.int64)
    if not len(keys):
        return none, []
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    order = order[np.append(False, same) | np.append(same, False)]  # most keys have one row, which meets none
    if not len(order):
        return none, []
    keys, low, one = keys[order], low[order], one[order]
    order = np.lexsort((one, keys))
    keys, low, one = keys[order], low[order], one[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (one[1:] != one[:-1]))
    keys, low, one = keys[new], low[new], one[new]
    opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(opens, len(keys)))
    paired = own or (lambda keys, a, b: np.ones(len(keys), bool))
    u, v, sets = [], [], []
    small = np.repeat(size <= most, size)
    for k in range(1, min(most, len(keys))):
        at = np.flatnonzero((keys[k:] == keys[:-k]) & small[k:])
        at = at[np.bitwise_count(low[at] ^ low[at + k]) <= near]
        at = at[paired(keys[at], one[at], one[at + k])]
        u.append(one[at])
        v.append(one[at + k])
    for k in np.flatnonzero(size > most).tolist():
        part = slice(opens[k], opens[k] + size[k])
        rows, hashes = one[part], low[part]
        keep = lambda x, y: paired(np.full(len(x), keys[part.start]), rows[x], rows[y])  # noqa: B023, E731
        a, b = _large(hashes, near, middle)
        here = keep(a, b)
        a, b = a[here], b[here]
        u.append(rows[a])
        v.append(rows[b])
        left = _missed(hashes, near, keep, a, b)
        if len(left):
            sets.append((int(keys[part.start]), rows[left], hashes[left]))
    if not u:
        return none, sets
    ends = [np.concatenate(x).view(np.int64) for x in (u, v)]
    return np.unique(np.stack([np.minimum(*ends), np.maximum(*ends)], 1), axis=0), sets


def meetings(blobs: DataFrame, shards: int, most: int, near: int, hashes: bool, middle: bool, own: Own | None = None, read: Read | None = None) -> DataFrame:
    """u, v: pairs of rows that meet, of blobs (shard, keys). A pair may come from several shards.

    Rows with ``ones`` and ``lows`` instead, and the key as ``u``, are what is left of large sets.
    ``read``, if given, makes keys, what has them and its hashes of a shard's blobs, in parts that share no key.
    """
    names = ["u", "v", "ones", "lows"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, one, low in read(batches) if read else [unpacked(batches, hashes)]:
            pairs, sets = met_on(keys, one, low if hashes else one, most, near, middle, own)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
            for key, ones, lows in sets:
                blob = [pa.array([x.astype("<u8").tobytes()], pa.binary()) for x in (ones, lows)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([key], np.uint64).view(np.int64)), pa.nulls(1, pa.int64()), *blob], names)

    # a shard is a partition; by its hash several would meet in one, and a task would hold all of them
    return blobs.repartitionById(shards, "shard").mapInArrow(work, "u long, v long, ones binary, lows binary")


def pairs_of(met: DataFrame) -> DataFrame:
    return met.where("ones is null").select("u", "v")


def sets_of(met: DataFrame) -> DataFrame:
    return met.where("ones is not null").select(F.col("u").alias("key"), "ones", "lows")


def members(sets: DataFrame) -> DataFrame:
    """key, one, low (as signed) of the rows of sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, ones, lows in zip(*(c.to_pylist() for c in b.columns)):
                one, low = np.frombuffer(ones, "<i8"), np.frombuffer(lows, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), key)), pa.array(one), pa.array(low)], ["key", "one", "low"])

    return sets.mapInArrow(work, "key long, one long, low long")


def apart(label: np.ndarray, low: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs (places) of different labels and their distances, each once.

    Rows of the commonest label are compared with others only, so that a set that links have joined but for a few rows takes few steps.
    """
    _, of, n = np.unique(label, return_inverse=True, return_counts=True)
    order = np.argsort(np.where(of == n.argmax(), -1, of), kind="stable")
    label, low = label[order], low[order]
    step = max(1, BLOCK // len(low))
    for i in range(n.max(), len(low), step):
        some = slice(i, i + step)
        bits = np.bitwise_count(low[some, None] ^ low)
        x, y = np.nonzero((bits <= near) & (label[some, None] != label) & (np.arange(len(low)) < np.arange(i, min(i + step, len(low)))[:, None]))
        yield order[x + i], order[y], bits[x, y]


def rest(sets: DataFrame, labels: DataFrame, near: int, own: Own | None = None, nearest: bool = False) -> DataFrame:
    """u, v: all near pairs of the sets' rows whose labels (one, label; else a row's own) differ; with ``nearest`` one for each row, its nearest, so that they grow with the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, rows = b.column(0)[i].as_py(), b.column(1)[i].values
                label, one, low = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("label", "one", "low"))
                one = one.view(np.uint64)
                for x, y, bits in apart(label, low.view(np.uint64), near):
                    if own:
                        here = own(np.full(len(x), key, np.int64).view(np.uint64), one[x], one[y])
                        x, y, bits = x[here], y[here], bits[here]
                    if nearest:
                        order = np.lexsort((one[y], bits, x))
                        first = order[np.append(True, x[order][1:] != x[order][:-1])[: len(order)]]
                        x, y = x[first], y[first]
                    ends = one[x].view(np.int64), one[y].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], ["u", "v"])

    row = F.struct(F.coalesce("label", "one").alias("label"), "one", "low")
    rows = members(sets).join(labels, "one", "left").groupBy("key").agg(F.collect_list(row).alias("rows"), F.min(row["label"]).alias("low"), F.max(row["label"]).alias("high"))
    return rows.where("low < high").select("key", "rows").mapInArrow(work, "u long, v long").where("u <> v").distinct()
