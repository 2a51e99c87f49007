"""Clustering of clonotypes: rare ones with few mismatches go to more abundant ones.

A pair qualifies if its counts differ with a ratio of at most ``ratio``, V sets and J sets meet,
and the CDR3s have the same length and few mismatches; with the quality rule, mismatches at
low-quality positions of the rarer one are free, up to a number.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import sequences as S
from ..options import Options
from .checkpoints import checkpoint
from .clonotypes import KEY, TAKEN, shares, with_barcodes
from .fuzzy import pieces


def candidate_pairs(clones: DataFrame, errors: int, ratio: float) -> DataFrame:
    """Rare (v_ids, cdr3, j_ids, count) and abundant (suffix _to) clonotypes of each pair, with n_err."""
    keyed = clones.select(*KEY, "count", F.length("cdr3").alias("_n"), F.explode(pieces(F.col("cdr3"), errors)).alias("p")).select("*", "p.k", "p.piece").drop("p")
    to = keyed.select("_n", "k", "piece", *[F.col(c).alias(f"{c}_to") for c in (*KEY, "count")])
    near = keyed.join(to, ["_n", "k", "piece"]).where((F.col("count") <= ratio * F.col("count_to")) & (F.col("count") < F.col("count_to")) & F.arrays_overlap("v_ids", "v_ids_to") & F.arrays_overlap("j_ids", "j_ids_to"))
    near = near.select(*KEY, "count", *[f"{c}_to" for c in (*KEY, "count")]).distinct()
    return near.withColumn("n_err", S.mismatches(F.col("cdr3"), F.col("cdr3_to"))).where((F.col("n_err") <= errors) & ((F.col("n_err") > 0) | (F.col("v_ids") != F.col("v_ids_to")) | (F.col("j_ids") != F.col("j_ids_to"))))


def accepted_pairs(pairs: DataFrame, opts: Options) -> DataFrame:
    """Pairs that the quality rule lets through; they need ``avg_qvals`` of the rare clonotype."""
    if not opts.cluster_quality:
        return pairs
    low = S.low_quality_positions(F.col("avg_qvals"), opts.cluster_quality_sd)
    errors = F.filter(F.sequence(F.lit(0), F.length("cdr3") - 1), lambda i: F.substr("cdr3", i + 1, F.lit(1)) != F.substr("cdr3_to", i + 1, F.lit(1)))
    free = F.least(F.lit(opts.cluster_quality_errors), F.size(F.array_intersect(errors, low)))
    return pairs.where(F.col("n_err") - free <= (opts.cluster_simple_errors if opts.cluster_simple else 0))


def components(pairs: DataFrame) -> DataFrame:
    """node, comp of all clonotypes in pairs; by the smallest label of the neighbours, until nothing changes."""
    a, b = F.struct(*KEY), F.struct(*[F.col(f"{c}_to").alias(c) for c in KEY])
    name = lambda s: F.to_json(s)
    edges = checkpoint(pairs.select(name(a).alias("x"), name(b).alias("y")).distinct())
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    now = checkpoint(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("c")))
    while True:
        low = both.join(now.select(F.col("x").alias("y"), F.col("c").alias("cy")), "y").groupBy("x").agg(F.min("cy").alias("m"))
        step = now.join(low, "x").select("x", F.least("c", "m").alias("c"))
        jump = step.join(step.select(F.col("x").alias("c"), F.col("c").alias("c2")), "c").select("x", F.least("c", "c2").alias("c"))
        new = checkpoint(jump)
        if new.join(now.withColumnRenamed("c", "old"), "x").where("c <> old").isEmpty():
            break
        now = new
    return new.select(F.col("x").alias("node"), F.col("c").alias("comp"))


def cluster(clones: DataFrame, opts: Options) -> DataFrame:
    """Clonotypes after clustering: v_ids, cdr3, j_ids, count, and ``bcs`` and ``avg_qvals`` if they are there.

    Rare ones are taken by their first count, ascending; each goes to its accepted partners with
    the most mismatches, in proportion to their counts at that moment, and is gone. All its barcodes
    go to each of them; its qualities count by the share, but for the mismatches. Groups that no
    pair joins are independent, so each is folded on its own; barcodes are joined afterwards.
    """
    columns = [*KEY, "count", *[c for c in ("bcs", "avg_qvals") if c in clones.columns]]
    clones = clones.select(columns)
    if not opts.cluster_errors:
        return clones
    pairs = candidate_pairs(clones, opts.cluster_errors, opts.cluster_ratio)
    if opts.cluster_quality:
        pairs = pairs.join(clones.select(*KEY, "avg_qvals"), KEY)
    pairs = accepted_pairs(pairs, opts).select(*KEY, "count", *[f"{c}_to" for c in (*KEY, "count")], "n_err")
    most = checkpoint(pairs.join(pairs.groupBy(*KEY).agg(F.max("n_err").alias("_m")), KEY).where("n_err = _m"))
    if most.isEmpty():
        return clones
    comps = components(most)
    named = F.to_json(F.struct(*KEY))
    rows = most.withColumn("node", named).join(comps, "node").drop("node")
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # else both sides of the cogroup have the same attributes
    nodes = clones.drop("bcs").withColumn("node", named).join(comps, "node").drop("node")
    if "avg_qvals" not in columns:
        nodes = nodes.withColumn("avg_qvals", F.lit(None).cast("array<double>"))

    def fold(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        k = lambda r, s="": (tuple(r["j_ids" + s]), tuple(r["v_ids" + s]), r["cdr3" + s])
        live, qualities, taken, targets = {}, {}, {}, {}
        for r in nodes.to_dict("records"):
            live[k(r)], qualities[k(r)], taken[k(r)] = int(r["count"]), r["avg_qvals"], {k(r)}
        first = dict(live)
        for r in links.to_dict("records"):
            targets.setdefault(k(r), set()).add(k(r, "_to"))
        for a in sorted(targets, key=lambda a: (first[a], a)):
            majors = sorted((b for b in targets[a] if b in live), key=lambda b: (-first[b], b))
            if majors:
                for b, n in zip(majors, shares(live[a], [live[b] for b in majors])):
                    if qualities[a] is not None and qualities[b] is not None:
                        qualities[b] = [q if x != y else (live[b] * q + n * p) / (live[b] + n) for q, p, x, y in zip(qualities[b], qualities[a], b[2], a[2])]
                    live[b] += n
                    taken[b] |= taken[a]
                del live[a]
        out = sorted(live)
        whole = [[{"v_ids": list(x[1]), "cdr3": x[2], "j_ids": list(x[0])} for x in sorted(taken[y])] for y in out]
        quals = [None if qualities[x] is None else list(qualities[x]) for x in out]
        return pd.DataFrame({"v_ids": [list(x[1]) for x in out], "cdr3": [x[2] for x in out], "j_ids": [list(x[0]) for x in out], "count": [live[x] for x in out], "taken": whole, "avg_qvals": quals})

    schema = f"v_ids array<int>, cdr3 string, j_ids array<int>, count long, taken {TAKEN}, avg_qvals array<double>"
    folded = with_barcodes(nodes.groupBy("comp").cogroup(rows.groupBy("comp")).applyInPandas(fold, schema), clones)
    touched = most.select(*KEY).unionByName(most.select(*[F.col(f"{c}_to").alias(c) for c in KEY])).distinct()
    return clones.join(touched, KEY, "left_anti").unionByName(folded.select(columns))
