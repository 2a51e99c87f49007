"""Receptor steps whose cost may not grow faster than their input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vdjspark import queries as Q
from vdjspark.operators import reads as R, umi
from vdjspark.plans import fixtures as X
from vdjspark.sources import sinks

UNIQUE = "bc_seq string, seq string, n_reads long"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_dealt_reads(spark):
    """They are the rows that the SQL makes, for odd keys too, and no shuffle follows the one by id."""
    keys = [(0, 1, 1), (17, 3, 2), (53, 29, 7), (97, 5, 1), (89, 5, 4), (143, 8, 3), (143, 8, 3), (11, 900, 6), (-11, 40, 2), (-53, -7, -4), (10**12 + 13, 999, 5), (None, 4, 1), (4, None, 2), (22, 3, None), (None, None, None)]
    rows = spark.createDataFrame(keys, "l_orderkey long, l_suppkey long, l_linenumber int")
    rows.createOrReplaceTempView("lineitem")
    want = spark.sql(f"WITH {X.reads(False)} SELECT id, ok, ln, seq, qual FROM reads").collect()
    dealt = X.dealt_reads(rows)
    assert dealt.columns == ["id", "ok", "ln", "seq", "qual"]
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, want))
    ids = plan(R.read_ids(R.prepare(dealt, Q.OPTIONS)))
    assert "lambdafunction(s + x" not in ids and ids.count("Exchange hashpartitioning") == 1


def test_quality_is_summed_side_by_side(spark):
    """Places are summed in rows of several, with empty, short, long and null arrays, and an id counts once."""
    rng = random.Random(2)
    rows = [("A", "ACGT" * 10, f"r{i % 7}", [rng.randint(0, 40) for _ in range(n)]) for i, n in enumerate([40] * 9 + [16, 17, 3])]
    rows += [("C", "AC", "x", []), ("G", "AC", "x", None), ("T", "AC", "x", [5, None]), ("T", "AC", "y", [7, 9]), ("T", "AC", "z", [None, None])]
    df = spark.createDataFrame([(*r, None) for r in rows], "bc_seq string, seq string, id string, qual array<int>, reject string")
    got = {r["bc_seq"]: (r["n_reads"], r["avg_qual"]) for r in R.mean_qualities(df).collect()}
    least = {}
    for bc, _, i, q in rows:
        if bc == "A":
            least[i] = min(least.get(i, q), q)
    places = [[q[k] for q in least.values() if len(q) > k] for k in range(max(map(len, least.values())))]
    assert got["A"] == (len(least), [sum(p) / len(p) for p in places])
    assert got["C"] == (1, []) and got["G"] == (1, []) and got["T"] == (3, [6.0, 9.0])
    assert "posexplode" not in plan(R.mean_qualities(df))


def test_umi_meets_slices(spark):
    """Slices of abundant reads give what all pairs give: edits of all kinds, near ones beyond the first slices, other letters."""
    rng = random.Random(6)
    bases = [[rng.choice("ACGT") for _ in range(rng.choice([40, 60]))] for _ in range(12)] + [list("é" * 20 + "ACGN" * 10)]
    rows = {}
    for _ in range(400):
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(s)), rng.randrange(3)
            s[at : at + (kind > 0)] = [rng.choice("ACGTN")] if kind < 2 else []
        rows[rng.choice(["AAAA", "AAAC", "CCCC"]), "".join(s)] = rng.choice([1, 1, 2, 3, 8, 30, 31, 200])
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()], UNIQUE)
    for ratio in (0.2, 1.0):
        want = {}
        for (b, s), n in rows.items():
            near = []
            for (c, t), m in rows.items():
                if (b, s) != (c, t) and n <= ratio * m and (ratio < 1 or n < m or (b, s) > (c, t)) and sum(x != y for x, y in zip(b, c)) <= 1:
                    if abs(len(s) - len(t)) <= 3 and distance(s, t) <= int(0.05 * max(len(s), len(t))):
                        near.append((-m, c, t))
            if near:
                want[b, s] = (min(near)[1:], -min(near)[0])
        for first in (32, 2):
            before, umi.SLICE = umi.SLICE, first
            try:
                got = {(r["bc_seq"], r["seq"]): ((r["bc_to"], r["seq_to"]), r["n_to"]) for r in umi.merge_pairs(df, ratio=ratio).collect()}
            finally:
                umi.SLICE = before
            assert got == want and len(want) > 50


def test_umi_of_a_large_barcode(spark):
    """5,000 rare reads beside 60 abundant ones of one barcode: each meets few, not all others."""
    rng = random.Random(8)
    tops = ["".join(rng.choices("ACGT", k=120)) for _ in range(60)]
    seen = {(t, 1000 + i) for i, t in enumerate(tops)}
    for k in range(5_000):
        t, at = tops[k % 60], rng.sample(range(120), 3)
        seen.add(("".join(rng.choice("ACGT".replace(x, "")) if i in at else x for i, x in enumerate(t)), 5 + k % 3))
    df = spark.createDataFrame([("ACGT", s, n) for s, n in {s: n for s, n in sorted(seen)}.items()], UNIQUE)
    got = umi.merge_pairs(df)
    assert got.where("n_to >= 1000").count() == got.count() >= 4_900


def test_rejects_in_one_pass(spark):
    """Reads judged keep their number, ids of rejected sequences come once, and the reads stay where they are."""
    judged = spark.createDataFrame([("a", "AC", "SHORT"), ("a", "AC", "SHORT"), ("b", "AC", None), ("b", "AC", None), ("b", "GG", None), ("c", "TT", None)], "id string, seq string, reject string")
    analysed = spark.createDataFrame([("AC", "LATE"), ("GG", "LATE"), ("TT", None)], "seq string, reject string")
    out = sinks.rejected_reads(judged, analysed)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "SHORT"), ("a", "SHORT"), ("b", "LATE"), ("b", "LATE")]
    assert "SortMergeJoin" not in plan(out)


def test_read_table_sends_rows_to_reads(spark):
    columns = "seq string, v_ids array<int>, j_ids array<int>, cdr_begin int, cdr_end int, v_err_pos array<int>, v_outer_len int, j_err_pos array<int>, j_outer_len int, cdr3_nt string, cdr3_aa string, reject string"
    analysed = spark.createDataFrame([("AC", [1], [2], 3, 9, [-1], 5, None, None, "TGT", "C", None), ("GG", [1], [2], 3, 9, [], 5, [], 1, "TGT", "C", "LATE")], columns)
    segments = spark.createDataFrame([(1, "V", "1", "01"), (2, "J", "2", "01")], "seg_idx int, seg_type string, seg_id string, allele string")
    ids = spark.createDataFrame([("AC", "x"), ("AC", "x"), ("AC", "y"), ("GG", "z")], "seq string, id string")
    out = sinks.read_table(analysed, ids, segments)
    assert sorted((r["SEQ_ID"], r["V_MATCHES"], r["V_ERRPOS"], r["J_ERRPOS"]) for r in out.collect()) == [("x", "V1*01", "-1", None), ("y", "V1*01", "-1", None)]
    assert "SortMergeJoin" not in plan(out)
