"""Unit vectors of the receptor operators, and alignments against plain dynamic programming."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vdjspark.functions import sequences as S
from vdjspark.operators import align, cluster, clonotypes, reads as R, segments as G, umi
from vdjspark.options import Options
from vdjspark.sources import fastx, sinks

CLONE = "v_ids array<int>, cdr3 string, j_ids array<int>, count long"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_barcode_split(spark):
    df = spark.createDataFrame([("a", "GATCGGTAACGATCGAATGC", [30] * 20), ("b", "GATC", [30] * 4)], "id string, seq string, qual array<int>")
    got = {r["id"]: r for r in R.split_barcode(df, 10).collect()}
    assert (got["a"]["bc_seq"], got["a"]["seq"], len(got["a"]["qual"]), got["a"]["bc_short"]) == ("GATCGGTAAC", "GATCGAATGC", 10, False)
    assert (got["b"]["bc_seq"], got["b"]["seq"], got["b"]["bc_short"]) == ("", "GATC", True)


@pytest.mark.parametrize("nt,aa", [("TGTGCCAGCAGT", "CASS"), ("TAATAGTGA", "XXX"), ("TGNTGT", "XC"), ("TGTG", "C"), ("AT", "")])
def test_translate(spark, nt, aa):
    assert one(spark, S.translate(F.lit(nt))) == aa


def test_scalars(spark):
    assert one(spark, S.revcomp(F.lit("AACGN"))) == "NCGTT"
    q = F.array(*[F.lit(float(x)) for x in [30] * 14 + [10]])
    assert one(spark, S.low_quality_positions(q, 1.0)) == [14]
    assert one(spark, S.average_below(F.array().cast("array<int>"), 30)) is False
    assert one(spark, S.edit_rate_at_most(F.lit("A" * 20), F.lit("A" * 19 + "C"), 0.05)) is True
    assert one(spark, S.edit_rate_at_most(F.lit("A" * 20), F.lit("A" * 18 + "CC"), 0.05)) is False


def test_quality_control(spark):
    rows = [("ok", "A" * 80, [30] * 80, "ACGT", [30] * 4), ("mean", "A" * 80, [30] * 79 + [25], "ACGT", [30] * 4), ("bc", "A" * 80, [30] * 80, "ACGT", [30, 29, 30, 30]), ("n", "A" * 80, [30] * 80, "ANGT", [30] * 4), ("short", "A" * 74, [30] * 74, "ACGT", [30] * 4)]
    df = spark.createDataFrame([(*r, False) for r in rows], "id string, seq string, qual array<int>, bc_seq string, bc_qual array<int>, bc_short boolean")
    got = {r["id"]: r["reject"] for r in R.quality_control(df, Options()).collect()}
    assert got == {"ok": None, "mean": "AVERAGE_QUAL_FAIL", "bc": "LOW_QUALITY_BARCODE_BASE", "n": "N_IN_BARCODE", "short": "READ_TOO_SHORT"}


def test_umi_chain(spark):
    df = spark.createDataFrame([("AAAAAAAATT", "ACGT" * 20, 1), ("AAAAAAAAAT", "ACGT" * 20, 10), ("AAAAAAAAAA", "ACGT" * 20, 100)], "bc_seq string, seq string, n_reads long")
    assert [tuple(r) for r in umi.corrected(df).collect()] == [("AAAAAAAAAA", "ACGT" * 20, 111)]


def test_cluster_split(spark):
    df = spark.createDataFrame([([1], "AAAAAA", [1], 100), ([1], "AAAACC", [1], 40), ([1], "AAAAAC", [1], 8)], CLONE)
    got = {(r["cdr3"], r["count"]) for r in cluster.cluster(df, Options(cluster_simple=True)).collect()}
    assert got == {("AAAAAA", 106), ("AAAACC", 42)}


def test_ambiguity(spark):
    df = spark.createDataFrame([([1, 2], "AAA", [9], 10), ([1], "AAA", [9], 3), ([2], "AAA", [9], 1), ([1], "CCC", [9], 5)], CLONE)
    got = {(tuple(r["v_ids"]), r["cdr3"], r["count"]) for r in clonotypes.resolve_ambiguity(df).collect()}
    assert got == {((1,), "AAA", 11), ((2,), "AAA", 3), ((1,), "CCC", 5)}


def test_auto_length():
    assert [G.auto_v_core_length(n, 280) for n in (100, 120, 150, 300)] == [10, 10, 40, 60] and G.auto_v_core_length(300, 40) == 42


def test_semi_global_and_overlap():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choices("ACGT", k=40))
        p = text[10:22]
        p = p[:5] + rng.choice("ACGT") + p[6:]
        found = align.semi_global(p, text, 2)
        assert (10, 22) in found or found
    segment = "".join(rng.choices("ACGT", k=60))
    m = align.overlap(segment[20:] + "ACGTACGT", segment, -20, 3, "V", 57)
    assert m == (40, 40, 37, 0)
    m = align.overlap("GGG" + segment[:30] + segment[31:], segment, 3, 4, "J", 0)
    assert m[3] == 1 and m[2] == 3


def plain_edits(pattern, text):
    """Fewest edits up to each place of the text, by the whole table."""
    row = list(range(len(pattern) + 1))
    out = [row[-1]]
    for t in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != t), row[i + 1] + 1, new[-1] + 1))
        row = new
        out.append(row[-1])
    return out


def test_edits_and_hull():
    rng = random.Random(8)
    assert align.edits_at("", "AC") == [0, 0, 0] and align.edits_at("AC", "") == [2]
    for _ in range(400):
        pattern, text, most = "".join(rng.choices("ACGT", k=rng.randint(1, 90))), "".join(rng.choices("ACGT", k=rng.randint(0, 60))), rng.randint(0, 4)
        if rng.random() < 0.7:
            text += pattern[: len(pattern) // 2] + rng.choice(["", "A", "CC"]) + pattern[len(pattern) // 2 + rng.randint(0, 2) :] + "ACGTTA"
        want = plain_edits(pattern, text)
        assert align.edits_at(pattern, text) == want
        best, part = min(want), align.hull(pattern, text, most)
        inside = align.semi_global(pattern, text[slice(*part)], most) if part else []
        ends = [e + part[0] for _, e in inside] if part else []
        assert ends == ([e for e, d in enumerate(want) if d == best] if best <= most else [])
        for b, e in inside:
            assert b == min(k for k in range(e + 1) if distance(pattern, text[slice(*part)][k:e]) == best)
        assert align.v_read_edits(pattern, text, most) == min(best, most + 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain_score(read, segment, side):
    """The best overlap score without a band."""
    bad, head = -(10**6), side == "V"
    table = {}
    for i in range(len(segment) + 1):
        for j in range(len(read) + 1):
            best = 0 if i == 0 or (j == 0 and head) else bad
            if i and j:
                best = max(best, table[i - 1, j - 1] + (1 if segment[i - 1] == read[j - 1] else -1))
            best = max(best, table.get((i - 1, j), bad) - 1, table.get((i, j - 1), bad) - 1)
            table[i, j] = best
    ends = [(len(segment), j) for j in range(len(read) + 1)] + ([] if head else [(i, len(read)) for i in range(len(segment) + 1)])
    return max(table[e] for e in ends)


def test_batches_of_overlaps():
    rng = random.Random(14)
    for side in "VJ":
        tasks = []
        for _ in range(60):
            segment = "".join(rng.choices("ACGT", k=rng.randint(4, 30)))
            read = "".join(rng.choices("ACGT", k=rng.randint(1, 12))) + segment[rng.randint(0, 3) :] + rng.choice(["", "ACG"])
            wide = len(read) + len(segment)
            tasks.append(align.Task(read, segment, 0, -wide, wide, rng.randrange(len(segment))))
        for task, found in zip(tasks, align.aligned(tasks, side)):
            best = plain_score(task.read, task.segment, side)
            if not found:
                assert best <= 0 or side == "J"  # nothing to align, or a motif beyond the end of the read
                continue
            (score, size, _, errors), columns = found
            pairs = [(task.read[r] if r >= 0 else "-", task.segment[s] if s >= 0 else "-") for r, s in columns]
            assert score == best and size == len(columns) and errors == (size - score) // 2
            assert sum(1 if a == b else -1 for a, b in pairs) >= score
            for k in (0, 1):
                places = [c[k] for c in columns if c[k] >= 0]
                assert places == list(range(places[0], places[0] + len(places)))
        alone = [next(align.aligned([t], side)) for t in tasks]
        assert alone == list(align.aligned(tasks, side))


def test_outer_gaps():
    # the segment's last two bases lie against a gap though the read goes on, and so on at the other end
    assert align.without_outer_gaps([(0, 0), (1, 1), (-1, 2), (-1, 3)], 9, 4, (0, 0)) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert align.without_outer_gaps([(0, 0), (1, 1), (-1, 2), (-1, 3)], 3, 4, (0, 0)) == [(0, 0), (1, 1), (-1, 2), (2, 3)]
    assert align.without_outer_gaps([(-1, 0), (2, 1)], 3, 2, (2, 0)) == [(1, 0), (2, 1)]
    assert align.without_outer_gaps([(0, 3), (1, -1)], 2, 6, (0, 3)) == [(0, 3), (1, 4)]
    assert align.without_outer_gaps([(-1, 0), (0, 1)], 1, 2, (0, 0)) == [(-1, 0), (0, 1)]


def test_diagonal_of_v_is_clamped():
    """A read that begins far before the segment has no alignment in the band, one that begins a base before it has."""
    rng = random.Random(3)
    segment = "".join(rng.choices("ACGT", k=60))
    fragments, segments = [(segment[40:60], -17, [0])], {0: (segment, 57)}
    best = lambda before: list(align.best_alignments(["C" * before + segment], fragments, segments, "V", 0, 0.05))[0]
    assert best(0)[0][1][0] == (60, 60, 57, 0) and best(1)[0][1][0] == (60, 60, 58, 0) and best(20) == []


def test_similar_reads_of_250_bases(spark):
    rng = random.Random(250)
    a = rng.choices("ACGT", k=250)
    at = rng.sample(range(250), 13)
    turned = lambda k: "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in at[:k] else c for i, c in enumerate(a))
    for other, want in ((turned(12), True), (turned(13), distance("".join(a), turned(13)) <= 12), ("".join(a[3:]), True), ("".join(a[13:]), False), ("", False)):
        assert one(spark, S.edit_rate_at_most(F.lit("".join(a)), F.lit(other), 0.05)) is want


def test_files(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">L|V|1|01|3\nacg\ntgtaa\n>L|J|2|01|x\nttt\n>L|D|3|01|0\nac\n")
    got = fastx.read_segments(spark, str(tmp_path / "s.fa")).collect()
    assert [(r["seg_type"], r["seq"], r["motif_pos"]) for r in got] == [("V", "ACGTGTAA", 3), ("J", "TTT", 0)]
    (tmp_path / "r.fq").write_text("@a\nACN\n+\nII!\n@b\nGG\n+\n@@\n")
    got = fastx.read_fastq(spark, str(tmp_path / "r.fq")).orderBy("record_no").collect()
    assert [(r["id"], r["seq"], r["qual"]) for r in got] == [("a", "ACN", [40, 40, 0]), ("b", "GG", [31, 31])]
    assert [r["id"] for r in fastx.read_fastq(spark, str(tmp_path / "r.fq"), most=1).collect()] == ["a"]
    assert [r["seg_id"] for r in fastx.read_segments(spark, str(tmp_path / "s.fa")).collect()] == ["1", "2"] and fastx.read_fasta(spark, str(tmp_path / "s.fa"), most=2).count() == 2
    assert sinks.output_name("oa", "-", "/x/reads.fq.gz") == "reads.act" and sinks.output_name("oa", "y", "z") == "y"
    gapped = spark.createDataFrame([("x|IGHV1-2*1|y", "AC..GTTGT"), ("x|IGHV9*02|y", "AC")], "id string, seq string")
    assert [tuple(r) for r in fastx.reference_from_gapped(gapped, "IGH", 7).collect()] == [("IGH", "V", "1-2", "01", 4, "ACGTTGT")]


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
