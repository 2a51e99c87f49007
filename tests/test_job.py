"""Barcodes of pairs, barcodes and qualities through clustering, places of errors, the command line, streamed counts."""

from __future__ import annotations

import random

from vdjspark import __main__ as cli
from vdjspark.operators import align, cluster, clonotypes, reads as R, segments as G, umi
from vdjspark.options import Options
from vdjspark.plans.job import ClonotypeJob
from vdjspark.sources import fastx
from vdjspark.streaming import barcodes

CLONE = "v_ids array<int>, cdr3 string, j_ids array<int>, count long"
SEGMENTS = "seg_idx int, locus string, seg_type string, seg_id string, allele string, motif_pos int, seq string"


def bases(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def test_umi_pairs(spark):
    seq, other = "ACGT" * 20, "TTGCA" * 16
    rows = [("AAAA", seq, seq, 1), ("AAAT", seq, seq, 10), ("AATT", seq, seq, 100), ("AAAC", other, seq, 1), ("AAAG", "", seq, 1), ("AAGA", "", seq, 8)]
    df = spark.createDataFrame(rows, "bc_seq string, fw_seq string, seq string, n_reads long")
    got = {tuple(r) for r in umi.corrected(df).collect()}
    # the mate of AAAC differs; blanked mates join each other only, and these two differ in two bases
    assert got == {("AATT", seq, seq, 111), ("AAAC", other, seq, 1), ("AAAG", "", seq, 1), ("AAGA", "", seq, 8)}
    ids = spark.createDataFrame([("AAAA", seq, seq, "x"), ("AAAC", other, seq, "y")], "bc_seq string, fw_seq string, seq string, id string")
    assert {(r["bc_seq"], r["id"]) for r in umi.surviving_ids(ids, umi.assigned(df)).collect()} == {("AATT", "x"), ("AAAC", "y")}


def test_umi_is_all_near_pairs(spark):
    rng = random.Random(1)
    rows = list({(bases(rng, 4), "ACGT" * 5): rng.choice([1, 2, 9, 50]) for _ in range(120)}.items())
    rows = [(b, s, n) for (b, s), n in rows]
    df = spark.createDataFrame(rows, "bc_seq string, seq string, n_reads long")
    for errors in (0, 1, 2):
        want = set()
        for b, s, n in rows:
            near = [(-m, c, t) for c, t, m in rows if (b, s) != (c, t) and n <= 0.2 * m and sum(x != y for x, y in zip(b, c)) <= errors]
            if near:
                want.add((b, min(near)[1]))
        assert {(r["bc_seq"], r["bc_to"]) for r in umi.merge_pairs(df, errors).collect()} == want


def test_qualities_of_survivors(spark):
    quals = spark.createDataFrame([("AA", "ACG", [30.0, 30.0, 10.0]), ("CC", "ACG", [10.0, 30.0, 40.0]), ("GG", "ACG", [0.0] * 3)], "bc_seq string, seq string, avg_qual array<double>")
    alive = spark.createDataFrame([("AA", "ACG", 3), ("CC", "ACG", 1)], "bc_seq string, seq string, n_reads long")
    assert R.sequence_qualities(quals, alive).first()["avg_qual"] == [25.0, 30.0, 17.5]


def test_cluster_carries_barcodes_and_qualities(spark):
    rows = [([1], "AAAAAA", [1], 100, ["x"], [30.0] * 6), ([1], "AAAACC", [1], 40, ["y"], [20.0] * 6), ([1], "AAAAAC", [1], 8, ["w", "x"], [10.0] * 6), ([2], "GGGGGG", [1], 5, ["q"], [5.0] * 6)]
    df = spark.createDataFrame(rows, f"{CLONE}, bcs array<string>, avg_qvals array<double>")
    got = {r["cdr3"]: r for r in cluster.cluster(df, Options(cluster_simple=True)).collect()}
    assert {c: (r["count"], r["bcs"]) for c, r in got.items()} == {"AAAAAA": (106, ["w", "x"]), "AAAACC": (42, ["w", "x", "y"]), "GGGGGG": (5, ["q"])}
    merged = (100 * 30 + 6 * 10) / 106
    assert all(abs(a - b) < 1e-9 for a, b in zip(got["AAAAAA"]["avg_qvals"], [merged] * 5 + [30.0]))
    assert got["GGGGGG"]["avg_qvals"] == [5.0] * 6


def test_ambiguity_carries_barcodes(spark):
    rows = [([1, 2], "AAA", [9], 10, ["a", "b"]), ([1], "AAA", [9], 3, ["b", "c"]), ([2], "AAA", [9], 1, []), ([1], "CCC", [9], 5, ["z"])]
    df = spark.createDataFrame(rows, f"{CLONE}, bcs array<string>")
    got = {(tuple(r["v_ids"]), r["cdr3"]): (r["count"], r["bcs"]) for r in clonotypes.resolve_ambiguity(df).collect()}
    assert got == {((1,), "AAA"): (11, ["a", "b", "c"]), ((2,), "AAA"): (3, ["a", "b"]), ((1,), "CCC"): (5, ["z"])}


def test_alleles_weigh_qualities(spark):
    df = spark.createDataFrame([([1], "AC", [5], 3, [40.0, 20.0]), ([2], "AC", [5], 1, [0.0, 20.0])], f"{CLONE}, avg_qvals array<double>")
    first = spark.createDataFrame([(1, 1), (2, 1), (5, 5)], "seg_idx int, first_idx int")
    assert [(r["count"], r["avg_qvals"]) for r in clonotypes.drop_alleles(df, first).collect()] == [(4, [30.0, 20.0])]


def test_places_of_errors(spark):
    rng = random.Random(5)
    v, j, middle = bases(rng, 60) + "TGT" + bases(rng, 6), "TTT" + bases(rng, 30), bases(rng, 12)
    other = lambda c: "C" if c == "A" else "A"
    whole = v[10:63] + middle + j
    at_v, at_j = 5, 53 + 12 + 20  # of the read
    read = "".join(other(c) if i in (at_v, at_j) else c for i, c in enumerate(whole))
    segs = spark.createDataFrame([(0, "L", "V", "1", "01", 60, v), (1, "L", "J", "1", "01", 0, j)], SEGMENTS)
    df = spark.createDataFrame([(read,)], "seq string")
    for side, length, offset, motif, outer, places in (("V", 20, 0, 50, 53, [at_v - 52]), ("J", 12, 0, 65, 33, [20])):
        plain = G.ungapped_matches(df, segs, side, length, 2, 0.15, offset).first()
        gapped = align.gapped_matches(df, segs, G.core_fragments(segs, side, length, offset), side, 2, 0.15, offset).collect()
        assert (plain["motif_at"], plain["n_err"], plain["outer_len"], plain["err_pos"]) == (motif, 1, outer, places)
        assert [(g["motif_at"], g["n_err"], g["outer_len"], g["err_pos"]) for g in gapped] == [(motif, 1, outer, places)]


def test_printed_alignment():
    found = align.traced("GGGACGTACGT", "ACGTTACGT", 3, 3, "J", 0)
    above, bars, below = align.printed("GGGACGTACGT", "ACGTTACGT", found[1])
    assert above.replace("-", "") == "ACGTACGT" and below.replace("-", "") == "ACGTTACGT" and bars.count("|") == 8 and found[0][3] == 1


def test_command_line(spark, tmp_path, capsys):
    rng = random.Random(9)
    v, j = bases(rng, 97) + "TGT" + "GCC", "TTT" + bases(rng, 40)
    read = v[20:] + "AGCAGT" * 2 + j  # 83 + 12 + 43 bases; the CDR3 is TGTGCC AGCAGT AGCAGT TTT
    (tmp_path / "ref.fa").write_text(f">TRB|V|7|01|97\n{v}\n>TRB|V|7|02|97\n{'A' + v[1:]}\n>TRB|J|2|01|0\n{j}\n")
    records = [("ACGTACGTAC", read, 6), ("ACGTACGTAA", read, 1), ("GGGGGGGGGG", read[:60], 1)]
    names = [(f"r{i}_{k}", bc + s) for i, (bc, s, n) in enumerate(records) for k in range(n)]
    (tmp_path / "reads.fq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in names))
    out = {o: str(tmp_path / o) for o in ("oa", "on", "o", "rlog", "bst", "oab", "pa")}
    args = cli.parsed([*[x for o, p in out.items() for x in (f"-{o}", p)], "-ref", str(tmp_path / "ref.fa"), "-r", "-bcl", "10", "-jco", "0", "-s", str(tmp_path / "reads.fq")])
    assert cli.options_of(args) == Options(reverse=True, barcode_length=10, j_core_offset=0)
    cli.run(spark, args)
    assert capsys.readouterr().err.splitlines()[-5:] == ["reads: 8", "rejected: 1", "longest that passed: 138", "shortest that passed: 138", "unique reads: 2"]
    rows = {o: [tuple(r) for r in spark.read.csv(p, sep="\t", header=o in ("o", "bst")).collect()] for o, p in out.items() if o != "pa"}
    assert rows["oa"] == [("V7:CASSSSF:J2", "7")] and rows["oab"] == [("V7:CASSSSF:J2", "1")]
    assert rows["on"] == [("V7:TGTGCCAGCAGTAGCAGTTTT:J2", "7")]
    assert rows["rlog"] == [("r2_0", "READ_TOO_SHORT")]
    assert sorted(rows["bst"]) == [("ACGTACGTAA", "1", "1"), ("ACGTACGTAC", "6", "1")]
    table = spark.read.csv(out["o"], sep="\t", header=True)
    assert table.columns == ["SEQ_ID", "read", "CDR3_BEGIN", "CDR3_END", "V_MATCHES", "V_ERRPOS", "V_MATCHLEN", "J_MATCHES", "J_ERRPOS", "J_MATCHLEN", "CDR3_NUCSEQ", "CDR3_AASEQ"]
    assert table.count() == 7 and {(r["V_MATCHES"], r["V_MATCHLEN"], r["CDR3_BEGIN"], r["CDR3_END"]) for r in table.collect()} == {("V7", "80", "77", "98")}
    assert spark.read.csv(out["pa"], sep="\t", header=True).where("line like '%|||%'").count() >= 2


def test_streamed_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good, short = "ACGT" + "A" * 80, "CC"
    (folder / "a.fq").write_text(f"@1\n{good}\n+\n{'I' * 84}\n@2\n{short}\n+\nII\n")
    (folder / "b.fq").write_text(f"@3\n{good}\n+\n{'I' * 84}")
    counts = barcodes.barcode_counts(barcodes.stream_reads(spark, str(folder)), Options(barcode_length=4, reverse=True))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("streamed").collect()} == {("ACGT", None, 2), ("", "TOO_SHORT_FOR_BARCODE", 1)}


def test_best_of_the_allowed(spark):
    """The VDJ read is nearest to V1, but its V read lies in V2 only: the pair has V2."""
    rng = random.Random(21)
    tail, j = bases(rng, 60) + "TGT", "TTT" + bases(rng, 40)
    one, two = bases(rng, 90) + tail, bases(rng, 90) + ("A" if tail[0] != "A" else "C") + tail[1:]
    v_read, read = two[5:85], tail + "GCCAGCAGTAGC" + j
    quality = lambda s: [40] * len(s)
    reads = spark.createDataFrame([("r", v_read, quality(v_read), read, quality(read))], "id string, fw_seq string, fw_qual array<int>, seq string, qual array<int>")
    segs = spark.createDataFrame([(0, "L", "V", "1", "01", 150, one), (1, "L", "V", "2", "01", 150, two), (2, "L", "J", "1", "01", 0, j)], SEGMENTS)
    for gapped in (False, True):
        for v, want in ((v_read, [1]), ("", [0])):
            # an oriented VDJ read turns, so it is given turned
            df = reads.selectExpr("id", f"'{v}' as fw_seq", "slice(fw_qual, 1, length('%s')) as fw_qual" % v, "reverse(translate(seq, 'ACGT', 'TGCA')) as seq", "qual")
            got = ClonotypeJob(df, segs, Options(v_core_length=20, j_core_offset=0, min_read_length=0, single_end_fallback=True), gapped).analysed.first()
            assert (got["v_ids"], got["j_ids"], got["reject"]) == (want, [2], None)


def test_umi_long_chain(spark):
    """Equal counts chain to the first barcode, over more steps than pointers double in 64."""
    seq, n = "ACGT" * 20, 90
    rows = [("A" * k + "C" * (n - k), seq, 5) for k in range(n + 1)]
    df = spark.createDataFrame(rows, "bc_seq string, seq string, n_reads long")
    assert [(r["bc_seq"], r["n_reads"]) for r in umi.corrected(df, ratio=1.0).collect()] == [("A" * n, 5 * (n + 1))]


def test_mates_of_several_files(spark, tmp_path):
    for mate in "12":
        folder = tmp_path / mate
        folder.mkdir()
        for k, size in enumerate((3, 50, 1)):
            (folder / f"part{k}.fq").write_text("".join(f"@{k}_{i}\n{'ACGT'[i % 4] * 5}\n+\nIIIII\n" for i in range(size)))
    one, two = (fastx.read_fastq(spark, str(tmp_path / mate)) for mate in "12")
    assert [r["record_no"] for r in one.orderBy("record_no").collect()] == list(range(54))
    both = R.paired(one, two.withColumnRenamed("id", "other")).collect()
    assert len(both) == 54 and all(r["fw_seq"] == r["seq"] for r in both)
    assert [r["id"] for r in one.orderBy("record_no").collect()][:4] == ["0_0", "0_1", "0_2", "1_0"]
    assert R.paired(one, two.where("record_no < 50").withColumnRenamed("id", "other")).count() == 50
