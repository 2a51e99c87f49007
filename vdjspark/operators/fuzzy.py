"""Fuzzy joins by pigeonhole blocks: lossless, and equi-joins to the planner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sequences as S


def pieces(seq: Column, errors: int) -> Column:
    """``errors`` + 1 pieces (number, text) of a sequence; within that many mismatches one is the same in both."""
    n = errors + 1
    cut = lambda k: F.floor(F.length(seq) * k / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(errors)), lambda k: F.struct(k.alias("k"), F.substr(seq, cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")))


def hamming_pairs(df: DataFrame, seq: str, errors: int, left: list[str], right: list[str] | None = None, same: list[str] | None = None) -> DataFrame:
    """Pairs (columns suffixed _1, _2) of rows whose ``seq`` has the same length and at most ``errors`` mismatches, once each.

    ``same``: columns that have to be equal. Rows pair in both orders, and not with themselves.
    """
    columns, same = list(dict.fromkeys([*left, *(right or left), seq])), same or []
    keyed = df.select(*columns, *[c for c in same if c not in columns]).distinct().withColumn("_len", F.length(seq)).withColumn("_p", F.explode(pieces(F.col(seq), errors)))
    keyed = keyed.select(*columns, *[c for c in same if c not in columns], "_len", "_p.k", "_p.piece")
    on = ["_len", "k", "piece", *same]
    side = lambda n: keyed.select(*[F.col(c) for c in on], *[F.col(c).alias(f"{c}_{n}") for c in columns if c not in same])
    a, b = F.col(f"{seq}_1"), F.col(f"{seq}_2")
    pairs = side(1).join(side(2), on).where((a != b) & S.hamming_at_most(a, b, errors))
    # a pair counts at the first piece that it shares, so it needs no distinct
    first = F.array_position(F.zip_with(pieces(a, errors), pieces(b, errors), lambda x, y: x["piece"] == y["piece"]), F.lit(True)) - 1
    return pairs.where(F.col("k") == first).drop("_len", "k", "piece")


def kmers(seq: Column, q: int) -> Column:
    """(pos, kmer) of all substrings of ``q`` bases; null for shorter sequences."""
    return F.when(F.length(seq) >= q, F.transform(F.sequence(F.lit(0), F.greatest(F.length(seq) - q, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.substr(seq, i + 1, F.lit(q)).alias("kmer"))))
