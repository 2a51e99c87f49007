"""Clonotypes: grouping, alleles, amino acids, quality, ambiguity, and reports.

A clonotype is (v_ids, cdr3, j_ids) with count, contributing barcodes and mean CDR3 qualities.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import sequences as S

KEY = ["v_ids", "cdr3", "j_ids"]


def group_clonotypes(analysed: DataFrame) -> DataFrame:
    """analysed: v_ids, j_ids, cdr3_nt, n_reads, bcs of accepted reads."""
    keyed = analysed.where("reject is null").select("v_ids", F.col("cdr3_nt").alias("cdr3"), "j_ids", "n_reads", "bcs")
    return _merge(keyed.withColumnRenamed("n_reads", "count"))


def _merge(df: DataFrame) -> DataFrame:
    """One row a key: summed counts, all barcodes, and mean qualities weighted by the counts."""
    out = df.groupBy(*KEY).agg(F.sum("count").alias("count"))
    if "bcs" in df.columns:
        codes = df.select(*KEY, F.explode("bcs").alias("bc")).distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("bc")).alias("bcs"))
        out = out.join(codes, KEY, "left").withColumn("bcs", F.coalesce("bcs", F.array().cast("array<string>")))
    if "avg_qvals" in df.columns:
        by = df.select(*KEY, "count", F.posexplode("avg_qvals").alias("pos", "q")).groupBy(*KEY, "pos").agg((F.sum(F.col("q") * F.col("count")) / F.sum("count")).alias("m"))
        means = by.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("avg_qvals"))
        out = out.join(means, KEY, "left")
    return out


def clone_qualities(analysed: DataFrame, qualities: DataFrame) -> DataFrame:
    """Clonotype key, qual (mean over the CDR3): weighted means at each position, of qualities cut to whole numbers."""
    cut = analysed.where("reject is null").join(qualities, [c for c in ("fw_seq", "seq") if c in qualities.columns]).select("v_ids", F.col("cdr3_nt").alias("cdr3"), "j_ids", "n_reads", F.posexplode(F.slice("avg_qual", F.col("cdr_begin") + 1, F.col("cdr_end") - F.col("cdr_begin"))).alias("pos", "q"))
    whole = F.floor(F.col("q") + 1e-9)  # a mean that is whole but for rounding stays
    by = cut.groupBy(*KEY, "pos").agg((F.sum(whole * F.col("n_reads")) / F.sum("n_reads")).alias("m"))
    return by.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("avg_qvals"))


def drop_low_quality(clones: DataFrame, least: float) -> DataFrame:
    """Clonotypes whose mean quality is at least ``least``; 0 turns it off."""
    return clones if least <= 0 else clones.where(S.mean(F.col("avg_qvals")) >= least - 1e-9)


def drop_alleles(clones: DataFrame, first: DataFrame) -> DataFrame:
    """Segments become the first allele of theirs, and equal clonotypes merge."""
    out = clones
    for c in ("v_ids", "j_ids"):
        rest = [x for x in KEY if x != c]
        mapped = out.select(*KEY).distinct().select(*KEY, F.explode(c).alias("seg_idx")).join(first, "seg_idx").groupBy(*KEY).agg(F.array_sort(F.collect_set("first_idx")).alias("_new"))
        out = out.join(mapped, KEY).select(*rest, F.col("_new").alias(c), *[x for x in out.columns if x not in KEY])
    return _merge(out)


def translated(clones: DataFrame) -> DataFrame:
    return _merge(clones.withColumn("cdr3", S.translate(F.col("cdr3"))).select(*KEY, "count", *["bcs"] * ("bcs" in clones.columns)))


def rendered(clones: DataFrame, segments: DataFrame, merge_alleles: bool = True) -> DataFrame:
    """fingerprint (V names, CDR3, J names, joined by colons), count, n_barcodes; summed by the rendered key."""
    names = clones
    for c in ("v_ids", "j_ids"):
        ids = names.select(c).distinct().select(c, F.posexplode(c).alias("pos", "seg_idx")).join(segments.select("seg_idx", "seg_type", "seg_id", "allele"), "seg_idx")
        lists = ids.groupBy(c).agg(S.gene_list(F.array_sort(F.collect_list(F.struct("pos", "seg_type", "seg_id", "allele"))), merge_alleles).alias(f"{c}_name"))
        names = names.join(lists, c)
    named = names.withColumn("fingerprint", F.concat_ws(":", "v_ids_name", "cdr3", "j_ids_name"))
    counts = named.groupBy("fingerprint").agg(F.sum("count").alias("count"))
    if "bcs" not in clones.columns:
        return counts
    codes = named.select("fingerprint", F.explode("bcs").alias("bc")).distinct().groupBy("fingerprint").agg(F.count("*").alias("n_barcodes"))
    return counts.join(codes, "fingerprint", "left").withColumn("n_barcodes", F.coalesce("n_barcodes", F.lit(0).cast("long")))


def top_clonotypes(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("count"), "fingerprint").limit(n)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """fingerprint, freq_a, freq_b: shares of the total in two samples, 0 where a clonotype is missing."""
    share = lambda df, name: df.join(F.broadcast(df.agg(F.sum("count").alias("_t"))), how="cross").select("fingerprint", (F.col("count") / F.col("_t")).alias(name))  # noqa: E731  one row
    return share(a, "freq_a").join(share(b, "freq_b"), "fingerprint", "full").select("fingerprint", F.coalesce("freq_a", F.lit(0.0)).alias("freq_a"), F.coalesce("freq_b", F.lit(0.0)).alias("freq_b"))


def ambiguity_pairs(clones: DataFrame) -> DataFrame:
    """Clonotypes of one CDR3 whose segments hold those of another (suffix _of)."""
    of = clones.select("cdr3", F.col("v_ids").alias("v_of"), F.col("j_ids").alias("j_of"), F.col("count").alias("count_of"))
    inside = S.contains_all(F.col("v_ids"), F.col("v_of")) & S.contains_all(F.col("j_ids"), F.col("j_of"))
    return clones.select(*KEY, "count").join(of, "cdr3").where(inside & ((F.col("v_ids") != F.col("v_of")) | (F.col("j_ids") != F.col("j_of"))))


def shares(n: int, weights: list[int]) -> list[int]:
    """Whole parts of ``n`` in proportion, rounded down; what is left goes to the first ones."""
    total = sum(weights)
    out = [n * w // total for w in weights]
    for i in range(n - sum(out)):
        out[i] += 1
    return out


def redistribution(pairs: DataFrame, key: list[str], n: str, weight: str, order: list) -> DataFrame:
    """Adds ``given``: each row's part of ``n`` of its key, in proportion to ``weight``; the rest goes to the first in ``order``."""
    all_ = Window.partitionBy(*key)
    floor = F.expr(f"({n} * {weight}) div sum({weight}) over (partition by {', '.join(key)})")
    out = pairs.withColumn("given", floor)
    rest = F.col(n) - F.sum("given").over(all_)
    return out.withColumn("_rest", rest).withColumn("_k", F.row_number().over(all_.orderBy(*order))).withColumn("given", F.col("given") + F.when(F.col("_k") <= F.col("_rest"), 1).otherwise(0)).drop("_rest", "_k")


TAKEN = "array<struct<v_ids:array<int>,cdr3:string,j_ids:array<int>>>"


def with_barcodes(folded: DataFrame, clones: DataFrame) -> DataFrame:
    """Replaces ``taken``, the clonotypes that went into each, itself too, by the barcodes of all of them, if ``clones`` have any."""
    if "bcs" not in clones.columns:
        return folded.drop("taken")
    source = clones.select(F.struct(*KEY).alias("_from"), F.explode("bcs").alias("bc"))
    codes = folded.select(*KEY, F.explode("taken").alias("_from")).join(source, "_from").select(*KEY, "bc").distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("bc")).alias("bcs"))
    return folded.drop("taken").join(codes, KEY, "left").withColumn("bcs", F.coalesce("bcs", F.array().cast("array<string>")))


def resolve_ambiguity(clones: DataFrame) -> DataFrame:
    """Within a CDR3, a clonotype whose V and J segments hold those of others is shared out among them, largest sets first.

    Shares follow the counts at that moment; the barcodes go to all that get a share. CDR3s with a
    single clonotype don't leave the JVM.
    """
    carried = ["bcs"] * ("bcs" in clones.columns)
    size = clones.groupBy("cdr3").agg(F.count("*").alias("_n"))
    marked = clones.select(*KEY, "count", *carried).join(size, "cdr3")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        live = {(tuple(v), tuple(j)): int(c) for v, j, c in zip(pdf["v_ids"], pdf["j_ids"], pdf["count"])}
        taken, cdr3 = {k: {k} for k in live}, pdf["cdr3"].iloc[0]
        for k in sorted(live, key=lambda k: (-len(k[0]) - len(k[1]), k)):
            inner = [x for x in sorted(live) if x != k and set(x[0]) <= set(k[0]) and set(x[1]) <= set(k[1])]
            if inner:
                for x, n in zip(inner, shares(live[k], [live[x] for x in inner])):
                    live[x] += n
                    taken[x] |= taken[k]
                del live[k]
        whole = [[{"v_ids": list(v), "cdr3": cdr3, "j_ids": list(j)} for v, j in sorted(taken[k])] for k in live]
        return pd.DataFrame({"v_ids": [list(k[0]) for k in live], "cdr3": cdr3, "j_ids": [list(k[1]) for k in live], "count": list(live.values()), "taken": whole})

    several = marked.where("_n > 1").select(*KEY, "count").groupBy("cdr3").applyInPandas(fold, f"v_ids array<int>, cdr3 string, j_ids array<int>, count long, taken {TAKEN}")
    return marked.where("_n = 1").select(*KEY, "count", *carried).unionByName(with_barcodes(several, clones))
