"""Correction of molecular barcodes: rare reads join a similar, more abundant one.

Reads are keyed by ``bc_seq`` and ``seq``, pairs by ``fw_seq`` too; both mates of a pair have to be
similar. A read that joins another gives its count and loses its barcode.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import sequences as S
from .checkpoints import checkpoint
from .fuzzy import pieces

SLICE = 32  # reads of a barcode that others meet first
WORD, BITS = 5, 512


def _key(unique: DataFrame) -> list[str]:
    return [c for c in ("bc_seq", "fw_seq", "seq") if c in unique.columns]


def _to(key: list[str]) -> list[str]:
    return [c.replace("_seq", "") + "_to" for c in key]


def _blocks(bc: Column, errors: int) -> Column:
    """Keys of a barcode; two within ``errors`` mismatches share one. For one error: each base left out in turn."""
    if errors != 1:
        return pieces(bc, errors)
    left_out = lambda i: F.struct(i.alias("k"), F.concat(F.substr(bc, F.lit(1), i), F.substr(bc, i + 2)).alias("piece"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(bc), F.lit(1)) - 1), left_out)


def near_barcodes(unique: DataFrame, errors: int) -> DataFrame:
    """bc_seq, bc_to: different barcodes, and each with itself, of one length and at most ``errors`` mismatches."""
    keyed = unique.select("bc_seq").distinct().select("bc_seq", F.length("bc_seq").alias("_n"), F.inline(_blocks(F.col("bc_seq"), errors)))
    pairs = keyed.join(keyed.withColumnRenamed("bc_seq", "bc_to"), ["_n", "k", "piece"])
    return pairs.where(S.hamming_at_most(F.col("bc_seq"), F.col("bc_to"), errors)).select("bc_seq", "bc_to").distinct()


def _reach(n: int) -> Column:
    """Number of the slice that a rank (from 0) lies in: the first slice holds ``n``, each next one twice as many."""
    return F.floor(F.log2(F.col("_rank") / n + 1)).cast("int")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _words(seqs: pd.Series) -> pd.Series:
    """Bitmap of a sequence's substrings of ``WORD`` letters, by a hash of ``BITS`` values; its last number is the length."""
    letters = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(seqs.str.len().to_numpy(np.int64))
    n = len(letters) - WORD + 1
    found = np.zeros((len(seqs), BITS), bool)
    if n > 0:
        letters = letters >> 1 & 3  # parts A, C, G and T
        code = sum(letters[i : i + n] << 2 * (WORD - 1 - i) for i in range(WORD)) % BITS
        row = np.searchsorted(ends, np.arange(n), "right")
        inside = np.arange(n) + WORD <= ends[row]
        found[row[inside], code[inside]] = True
    return pd.Series(list(np.column_stack([np.packbits(found, axis=1).view(np.int64), np.diff(ends, prepend=0)])))


def _near(a: str, b: str, rate: float) -> Column:
    """Whether two sequences have an edit rate of at most ``rate``. An edit spoils no more than ``WORD`` words, so of near ones few words of the one are missing in the other: that is asked first."""
    n = BITS // 64
    sizes = [F.get(f"_{x}", F.lit(n)) for x in (a, b)]
    most = F.floor(F.greatest(*sizes) * rate).cast("int")
    missing = [F.bit_count(F.get(f"_{a}", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"_{b}", F.lit(i))))) for i in range(n)]
    return (F.abs(sizes[0] - sizes[1]) <= most) & (sum(missing[1:], missing[0]) <= WORD * most) & (F.call_function("levenshtein", F.col(a), F.col(b), most) >= 0)


def merge_pairs(unique: DataFrame, errors: int = 1, ratio: float = 0.2, rate: float = 0.05) -> DataFrame:
    """The key of a read and that of the read it joins: bc_to, seq_to, and fw_to of pairs.

    That is the most abundant one, ties by barcode and sequence, of those with at most ``errors``
    mismatches in the barcode, an edit rate of the sequences of at most ``rate``, and a ratio of
    the reads' counts of at most ``ratio``. All counts are those before any merge.

    Reads meet the most abundant ones of each near barcode first, in slices; only those that a later
    slice could give a better one meet that too. So reads of a barcode don't meet pairwise where abundant ones are near.
    """
    key = _key(unique)
    to, words, words_to = _to(key), [f"_{c}" for c in key[1:]], [f"_{t}" for t in _to(key)[1:]]
    unique = checkpoint(unique.select(*key, "n_reads", *[_words(c).alias(w) for c, w in zip(key[1:], words)]))
    ranked = Window.partitionBy("bc_seq").orderBy(F.desc("n_reads"), *key[1:])
    # each count is 1 at least, which bars those from being joined that are too rare
    abundant = unique.where(F.col("n_reads") * ratio >= 1).withColumn("_rank", F.row_number().over(ranked) - 1)
    abundant = checkpoint(abundant.select(*[F.col(c).alias(t) for c, t in zip(key + words, to + words_to)], F.col("n_reads").alias("n_to"), _reach(SLICE).alias("_slice")))
    tops = abundant.groupBy("bc_to", "_slice").agg(F.max("n_to").alias("_top"))
    waiting = unique.join(near_barcodes(unique, errors), "bc_seq")
    here, there = F.struct(*key), F.struct(*[F.col(t).alias(c) for c, t in zip(key, to)])
    first = F.min(F.struct((-F.col("n_to")).alias("_less"), *to)).alias("_best")
    best, k = None, 0
    while True:
        # those for which the slice holds reads abundant enough, and more abundant ones than what they have
        waiting = waiting.join(tops.where(F.col("_slice") == k).select("bc_to", "_top"), "bc_to").where(F.col("n_reads") <= ratio * F.col("_top")).drop("_top")
        if best is not None:
            waiting = waiting.join(best.select(*key, F.col("_best._less").alias("_less")), key, "left")
            waiting = waiting.join(tops.where(F.col("_slice") == k).select("bc_to", "_top"), "bc_to").where(F.col("_less").isNull() | (F.col("_top") >= -F.col("_less"))).drop("_top", "_less")
        waiting = checkpoint(waiting)
        if waiting.isEmpty():
            break
        near = waiting.join(abundant.where(F.col("_slice") == k).drop("_slice"), "bc_to")
        near = near.where((F.col("n_reads") <= ratio * F.col("n_to")) & (here != there))
        if ratio >= 1:
            near = near.where((F.col("n_reads") < F.col("n_to")) | (here > there))
        for c, t in zip(key[1:], to[1:]):
            near = near.where(_near(c, t, rate))
        found = near.groupBy(*key, "n_reads").agg(first)
        if best is not None:
            found = found.unionByName(best).groupBy(*key, "n_reads").agg(F.min("_best").alias("_best"))
        best, k = checkpoint(found), k + 1
    if best is None:
        return waiting.select(*key, "n_reads", *[F.lit("").alias(t) for t in to], F.col("n_reads").alias("n_to"))
    return best.select(*key, "n_reads", *[F.col(f"_best.{t}").alias(t) for t in to], (-F.col("_best._less")).alias("n_to"))


def assigned(unique: DataFrame, errors: int = 1, ratio: float = 0.2, rate: float = 0.05) -> DataFrame:
    """Each read with its count, and the surviving read that it ends in (bc_to, seq_to, and fw_to of pairs), over chains of merges.

    Pointers double until none moves, so there are as many joins as the logarithm of the longest
    chain. Each round's pointers are checkpointed.
    """
    key, unique = _key(unique), checkpoint(unique)
    to = _to(key)
    parents = merge_pairs(unique, errors, ratio, rate).select(*key, *to)
    all_ = unique.join(parents, key, "left").select(*key, "n_reads", *[F.coalesce(t, c).alias(t) for c, t in zip(key, to)])
    now = checkpoint(all_)
    while True:
        up = now.select(*[F.col(c).alias(t) for c, t in zip(key, to)], *[F.col(t).alias(f"_{t}") for t in to])
        next_ = checkpoint(now.join(up, to).select(*key, "n_reads", *[F.col(f"_{t}").alias(t) for t in to], F.expr(" or ".join(f"{t} <> _{t}" for t in to)).alias("_moved")))
        now = next_.drop("_moved")
        if next_.where("_moved").isEmpty():
            return now


def survivors(assigned: DataFrame) -> DataFrame:
    """Surviving reads with the counts of all that joined them."""
    key = _key(assigned)
    return assigned.groupBy(*[F.col(t).alias(c) for c, t in zip(key, _to(key))]).agg(F.sum("n_reads").alias("n_reads"))


def corrected(unique: DataFrame, errors: int = 1, ratio: float = 0.2, rate: float = 0.05) -> DataFrame:
    return survivors(assigned(unique, errors, ratio, rate))


def surviving_ids(ids: DataFrame, assigned: DataFrame) -> DataFrame:
    """Read ids (with the key of each) under the key of the surviving read."""
    key = _key(ids)
    return ids.join(assigned, key).select(*[F.col(t).alias(c) for c, t in zip(key, _to(key))], "id").distinct()
