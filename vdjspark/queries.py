"""Queries over synthetic receptors, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import sequences as S
from .operators import clonotypes as C, cluster as K, fuzzy, reads as R, segments as G, umi as U
from .operators.checkpoints import checkpoint
from .options import Options
from .plans import fixtures as X
from .plans.job import ClonotypeJob

OPTIONS = Options(barcode_length=10, reverse=True, v_core_length=40, j_core_offset=0, min_clone_quality=0)
V_CORE, J_CORE, ERRORS = 40, 12, 2


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows.createOrReplaceTempView("lineitem")
    return rows


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dealt_reads(_lineitem(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lineitem(spark, sf_dir)
    return checkpoint(spark.sql(f"WITH {X.segments()} SELECT * FROM segments"))


def _toys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _lineitem(spark, sf_dir)
    return spark.sql(f"WITH {X.toy_clones(False)} SELECT * FROM toys")


def _job(spark: SparkSession, sf_dir: str, gapped: bool = False) -> ClonotypeJob:
    """Without barcode correction, which has queries of its own."""
    job = ClonotypeJob(_reads(spark, sf_dir), _segments(spark, sf_dir), OPTIONS, gapped)
    job.__dict__["sequences"] = checkpoint(R.drop_barcode(job.unique))
    return job


def _ids(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


# The same steps in DuckDB's SQL.
JUDGED = f"""WITH {X.reads(True)},
split AS (SELECT id, ok, ln, CASE WHEN length(seq) >= 10 THEN substr(seq, 1, 10) ELSE '' END AS bc_seq, list_slice(qual, 1, 10) AS bc_qual,
  CASE WHEN length(seq) >= 10 THEN substr(seq, 11) ELSE seq END AS seq, list_slice(qual, 11, len(qual)) AS qual, length(seq) < 10 AS bc_short FROM reads),
judged AS (SELECT *, CASE WHEN bc_short THEN 'TOO_SHORT_FOR_BARCODE' WHEN contains(bc_seq, 'N') THEN 'N_IN_BARCODE' WHEN list_min(bc_qual) < 30 THEN 'LOW_QUALITY_BARCODE_BASE'
  WHEN list_sum(qual) / len(qual)::DOUBLE < 30 THEN 'AVERAGE_QUAL_FAIL' WHEN length(seq) < 75 THEN 'READ_TOO_SHORT' END AS reject FROM split),
uniq AS (SELECT bc_seq, seq, count(DISTINCT id) AS n_reads FROM judged WHERE reject IS NULL GROUP BY 1, 2),
seqs AS (SELECT seq, sum(n_reads)::BIGINT AS n_reads, list(DISTINCT bc_seq) AS bcs FROM uniq GROUP BY 1)"""

MATCHED = f"""{JUDGED}, {X.segments(True)},
v_hits AS (SELECT r.seq, s.seg_idx, o.off + 37 AS motif_at, s.motif_pos, s.seq AS seg FROM seqs r, (SELECT *, substr(seq, motif_pos + 4 - 40, 40) AS scf FROM segments WHERE seg_type = 'V') s, (SELECT unnest(range(0, 119)) AS off) o
  WHERE o.off + 40 <= length(r.seq) AND CASE WHEN o.off + 40 <= length(r.seq) THEN hamming(substr(r.seq, o.off + 1, 40), s.scf) <= 2 ELSE FALSE END),
v_cut AS (SELECT *, greatest(0, motif_at - motif_pos) AS first, motif_at + 3 - greatest(0, motif_at - motif_pos) AS n FROM v_hits),
v_all AS (SELECT seq, seg_idx, motif_at, n, list_transform(list_filter(range(0, n::BIGINT), lambda i: substr(seg, (motif_pos - motif_at + first + 1 + i)::BIGINT, 1) <> substr(seq, (first + 1 + i)::BIGINT, 1)), lambda i: i - n + 1) AS err_pos, hamming(substr(seg, motif_pos - motif_at + first + 1, n), substr(seq, first + 1, n)) AS n_err FROM v_cut),
v_best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY seq ORDER BY n - 2 * n_err DESC) AS r FROM v_all WHERE n_err <= 0.05::DOUBLE * n) WHERE r = 1),
j_hits AS (SELECT r.seq, s.seg_idx, o.off AS motif_at, s.motif_pos, s.seq AS seg FROM seqs r, (SELECT *, substr(seq, motif_pos + 1, 12) AS scf FROM segments WHERE seg_type = 'J') s, (SELECT unnest(range(0, 147)) AS off) o
  WHERE CASE WHEN o.off + 12 <= length(r.seq) THEN hamming(substr(r.seq, o.off + 1, 12), s.scf) <= 2 ELSE FALSE END),
j_cut AS (SELECT *, least(length(seg) - motif_pos, length(seq) - motif_at) AS n FROM j_hits),
j_all AS (SELECT seq, seg_idx, motif_at, n, list_filter(range(1, n::BIGINT), lambda i: substr(seg, (motif_pos + 1 + i)::BIGINT, 1) <> substr(seq, (motif_at + 1 + i)::BIGINT, 1)) AS err_pos, hamming(substr(seg, motif_pos + 1, n), substr(seq, motif_at + 1, n)) AS n_err FROM j_cut),
j_best AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY seq ORDER BY n - 2 * n_err DESC) AS r FROM j_all WHERE n_err <= 0.15::DOUBLE * n) WHERE r = 1),
v_ties AS (SELECT seq, list_sort(list(DISTINCT seg_idx)) AS v_ids, CASE WHEN min(motif_at) = max(motif_at) THEN min(motif_at) END AS v_motif, CASE WHEN min(n_err) = max(n_err) THEN min(n_err) END AS v_err, max(n) AS v_len, min(err_pos) = max(err_pos) AS v_agreed, min(err_pos) AS v_places, arg_min(n, seg_idx) AS v_outer FROM v_best GROUP BY 1),
j_ties AS (SELECT seq, list_sort(list(DISTINCT seg_idx)) AS j_ids, CASE WHEN min(motif_at) = max(motif_at) THEN min(motif_at) END AS j_motif, CASE WHEN min(n_err) = max(n_err) THEN min(n_err) END AS j_err, max(n) AS j_len, min(err_pos) = max(err_pos) AS j_agreed, min(err_pos) AS j_places, arg_min(n, seg_idx) AS j_outer FROM j_best GROUP BY 1)"""


def translate_sql(nt: str) -> str:
    digit = lambda k: f"(instr('ACGT', substr({nt}, i * 3 + {k}, 1)) - 1)"
    return f"array_to_string(list_transform(range(0, length({nt}) // 3), lambda i: CASE WHEN {' OR '.join(f'{digit(k)} < 0' for k in (1, 2, 3))} THEN 'X' ELSE substr('{S.CODE}', 16 * {digit(1)} + 4 * {digit(2)} + {digit(3)} + 1, 1) END), '')"


ANALYSED = f"""{MATCHED},
placed AS (SELECT s.*, v_ids, j_ids, v_motif, j_motif, v_err, j_err, v_len, j_len, v_agreed, v_places, v_outer, j_agreed, j_places, j_outer, v_motif AS cdr_begin, j_motif + 3 AS cdr_end, CASE WHEN j_motif + 3 > v_motif THEN substr(s.seq, v_motif + 1, j_motif + 3 - v_motif) END AS cdr3_nt
  FROM seqs s LEFT JOIN v_ties USING (seq) LEFT JOIN j_ties USING (seq)),
spelt AS (SELECT *, {translate_sql('cdr3_nt')} AS cdr3_aa, cdr_end - cdr_begin AS size FROM placed),
analysed AS (SELECT *, CASE WHEN v_ids IS NULL OR j_ids IS NULL THEN 'SEGMENT_MATCH_FAILED' WHEN v_motif IS NULL OR j_motif IS NULL THEN 'MOTIF_AMBIGUOUS' WHEN size <= 0 THEN 'BROKEN_CDR_BOUNDARIES'
  WHEN size % 3 <> 0 THEN 'OUT_OF_READING_FRAME' WHEN size < 15 THEN 'CDR3_TOO_SHORT' WHEN contains(cdr3_aa, 'X') THEN 'NONSENSE_IN_CDR3' END AS reject FROM spelt),
nuc AS (SELECT v_ids, cdr3_nt AS cdr3, j_ids, sum(n_reads)::BIGINT AS count FROM analysed WHERE reject IS NULL GROUP BY 1, 2, 3),
nuc_bc AS (SELECT DISTINCT v_ids, cdr3_nt AS cdr3, j_ids, unnest(bcs) AS bc FROM analysed WHERE reject IS NULL),
firsts AS (SELECT seg_idx, min(seg_idx) OVER (PARTITION BY locus, seg_type, seg_id) AS first_idx FROM segments),
named AS (SELECT nuc.*, (SELECT string_agg(DISTINCT seg_type || seg_id, '') FROM segments WHERE list_contains(v_ids, seg_idx)) AS vn, (SELECT string_agg(DISTINCT seg_type || seg_id, '') FROM segments WHERE list_contains(j_ids, seg_idx)) AS jn FROM nuc)"""

KEYS = "array_to_string(v_ids, ',') AS v_ids, cdr3, array_to_string(j_ids, ',') AS j_ids"


def read_steps(spark, d):
    r = R.oriented(R.truncated(R.split_barcode(_reads(spark, d), 10), 60), False)
    return r.select("id", "bc_seq", "seq", F.size("qual").alias("n_qual"), F.element_at("qual", 1).alias("first_qual"))


def qc_reject_reasons(spark, d):
    return R.prepare(_reads(spark, d), OPTIONS).select("id", "reject")


def qc_summary(spark, d):
    return R.prepare(_reads(spark, d), OPTIONS).groupBy("reject").agg(F.count("*").alias("n"))


def paired_qc(spark, d):
    r = _reads(spark, d)
    pairs = r.withColumn("fw_seq", F.substr("seq", F.lit(1), (F.lit(60) + F.col("ok") % 40).cast("int"))).withColumn("fw_qual", F.slice("qual", F.lit(1), (F.lit(60) + F.col("ok") % 40).cast("int")))
    q = R.prepare(pairs, Options(barcode_length=10, single_end_fallback=True))
    return q.select("id", "reject", "bc_seq", F.length("fw_seq").cast("int").alias("fw_length"), "seq")


def input_stats(spark, d):
    return R.input_stats(R.prepare(_reads(spark, d), OPTIONS)).select("n_reads", "n_rejected", F.col("min_length").cast("long"), F.col("max_length").cast("long"))


def unique_reads(spark, d):
    return R.unique_reads(R.prepare(_reads(spark, d), OPTIONS)).select("bc_seq", "seq", "n_reads")


def unique_read_quality(spark, d):
    q = R.mean_qualities(R.prepare(_reads(spark, d), OPTIONS))
    return q.select("bc_seq", "seq", F.size("avg_qual").alias("n_pos"), F.round(F.aggregate("avg_qual", F.lit(0.0), lambda s, x: s + x) * F.col("n_reads")).cast("long").alias("sum_q"))


def barcode_stats(spark, d):
    return R.barcode_stats(R.unique_reads(R.prepare(_reads(spark, d), OPTIONS)))


def drop_barcode(spark, d):
    return R.drop_barcode(R.unique_reads(R.prepare(_reads(spark, d), OPTIONS))).select("seq", "n_reads", F.array_join("bcs", ",").alias("bcs"))


def segment_scf(spark, d):
    s = _segments(spark, d)
    out = [G.core_fragments(s, side, n).select(F.lit(side).alias("side"), "scf", _ids("segs")) for side, n in (("V", V_CORE), ("J", J_CORE))]
    return out[0].unionByName(out[1])


def first_allele(spark, d):
    return G.first_alleles(_segments(spark, d))


def kmer_seed_hits(spark, d):
    job = _job(spark, d)
    return G.seed_hits(job.sequences, G.core_fragments(job.segments, "V", V_CORE), V_CORE, ERRORS)


def best_segment_ties(spark, d):
    job = _job(spark, d)
    pick = lambda side: job.matches(side).select("seq", "seg_idx", F.col("score").cast("long"), F.col("aln_len").cast("long"), F.col("n_err").cast("long"), F.col("motif_at").cast("long"))
    return pick("V").unionByName(pick("J"))


def cdr3_extract(spark, d):
    a = _job(spark, d).analysed
    return a.select("seq", _ids("v_ids"), _ids("j_ids"), F.col("cdr_begin").cast("long"), F.col("cdr_end").cast("long"), "cdr3_nt", "cdr3_aa", "reject")


def reject_log(spark, d):
    from .sources.sinks import rejected_reads

    job = _job(spark, d)
    return rejected_reads(job.judged, job.analysed)


def translate_cdr3(spark, d):
    return _job(spark, d).sequences.select("seq", S.translate(F.col("seq")).alias("aa"))


def clonotypes_nuc(spark, d):
    return C.group_clonotypes(_job(spark, d).analysed).select(_ids("v_ids"), "cdr3", _ids("j_ids"), "count", F.size("bcs").cast("long").alias("n_barcodes"))


def drop_alleles(spark, d):
    job = _job(spark, d)
    return C.drop_alleles(C.group_clonotypes(job.analysed), G.first_alleles(job.segments)).select(_ids("v_ids"), "cdr3", _ids("j_ids"), "count")


def clonotypes_aa(spark, d):
    return C.translated(C.group_clonotypes(_job(spark, d).analysed)).select(_ids("v_ids"), "cdr3", _ids("j_ids"), "count", F.size("bcs").cast("long").alias("n_barcodes"))


def clonotype_counts(spark, d):
    job = _job(spark, d)
    return C.rendered(C.group_clonotypes(job.analysed).drop("bcs"), job.segments)


def top10_clonotypes(spark, d):
    return C.top_clonotypes(clonotype_counts(spark, d))


def freq_outer_join(spark, d):
    t = _toys(spark, d).select(F.concat_ws(":", _ids("v_ids"), "cdr3", _ids("j_ids")).alias("fingerprint"), "count")
    out = C.compared(t.where("count >= 60"), t.where("count < 90"))
    return out.select("fingerprint", F.round("freq_a", 9).alias("freq_a"), F.round("freq_b", 9).alias("freq_b"))


def hamming_pairs(spark, d):
    c = _job(spark, d).analysed.where("reject is null").select(F.col("cdr3_nt").alias("cdr3")).distinct()
    return fuzzy.hamming_pairs(c, "cdr3", 2, ["cdr3"])


def umi_merge_pairs(spark, d):
    return U.merge_pairs(R.unique_reads(R.prepare(_reads(spark, d), OPTIONS))).select("bc_seq", "seq", "bc_to", "seq_to")


def umi_corrected(spark, d):
    return U.corrected(R.unique_reads(R.prepare(_reads(spark, d), OPTIONS)))


def cluster_candidate_pairs(spark, d):
    p = K.candidate_pairs(C.group_clonotypes(_job(spark, d).analysed), 1, 0.25)
    return p.select(_ids("v_ids"), "cdr3", _ids("j_ids"), _ids("v_ids_to"), "cdr3_to", _ids("j_ids_to"), F.col("n_err").cast("long").alias("n_err"))


def cluster_result(spark, d):
    clones = C.group_clonotypes(_job(spark, d).analysed)
    return K.cluster(clones, Options(cluster_simple=True)).select(_ids("v_ids"), "cdr3", _ids("j_ids"), "count")


def lq_positions(spark, d):
    _lineitem(spark, d)
    q = spark.sql(f"SELECT l_orderkey, l_linenumber, {X.mapped('12', 'CAST(20 + (l_orderkey * i * 7 + l_linenumber * i * i) % 21 AS DOUBLE)', False)} AS q FROM lineitem")
    return q.select("l_orderkey", "l_linenumber", F.array_join(F.transform(S.low_quality_positions(F.col("q"), 1.0), lambda i: i.cast("string")), ",").alias("positions"))


def quality_having(spark, d):
    job = ClonotypeJob(_reads(spark, d), _segments(spark, d), OPTIONS, gapped=False)
    means = checkpoint(R.mean_qualities(job.judged))
    job.__dict__["unique"] = means.select("bc_seq", "seq", "n_reads")  # as there's no barcode correction
    job.__dict__["sequences"] = checkpoint(R.drop_barcode(job.unique))
    quals = R.sequence_qualities(means, job.unique)
    return C.drop_low_quality(C.clone_qualities(job.analysed, quals), 35.0).select(_ids("v_ids"), "cdr3", _ids("j_ids"), F.round(S.mean(F.col("avg_qvals")), 6).alias("quality"))


def ambiguity_candidates(spark, d):
    return C.ambiguity_pairs(_toys(spark, d)).select(_ids("v_ids"), "cdr3", _ids("j_ids"), _ids("v_of"), _ids("j_of"), "count", "count_of")


def redistribute_counts(spark, d):
    p = C.ambiguity_pairs(_toys(spark, d)).select(_ids("v_ids"), "cdr3", _ids("j_ids"), _ids("v_of"), _ids("j_of"), "count", "count_of")
    return C.redistribution(p, ["v_ids", "cdr3", "j_ids"], "count", "count_of", ["v_of", "j_of"])


def ambiguity_result(spark, d):
    return C.resolve_ambiguity(_toys(spark, d)).select(_ids("v_ids"), "cdr3", _ids("j_ids"), "count")


def rdt_rows(spark, d):
    from .sources.sinks import read_table

    job = _job(spark, d)
    number = {c: F.col(c).cast("long") for c in ("CDR3_BEGIN", "CDR3_END", "V_MATCHLEN", "J_MATCHLEN")}
    return read_table(job.analysed, job.judged.where("reject is null"), job.segments).withColumns(number)


def gapped_match(spark, d):
    return _job(spark, d, gapped=True).matches("J").select("seq", "seg_idx", "score", "aln_len", "motif_at")


def clonotyping(spark, d):
    """The flagship: reads with barcode correction to amino-acid clonotype counts."""
    job = ClonotypeJob(_reads(spark, d), _segments(spark, d), OPTIONS, gapped=False)
    return C.rendered(job.amino_clonotypes, job.segments)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        read_steps, qc_reject_reasons, qc_summary, paired_qc, input_stats, unique_reads, unique_read_quality, barcode_stats, drop_barcode, segment_scf, first_allele, kmer_seed_hits, best_segment_ties, cdr3_extract,
        reject_log, translate_cdr3, clonotypes_nuc, drop_alleles, clonotypes_aa, clonotype_counts, top10_clonotypes, freq_outer_join, hamming_pairs, umi_merge_pairs, umi_corrected, cluster_candidate_pairs,
        cluster_result, lq_positions, quality_having, ambiguity_candidates, redistribute_counts, ambiguity_result, rdt_rows, gapped_match, clonotyping,
    )
}

_PAIRS = """pairs AS (SELECT a.bc_seq, a.seq, b.bc_seq AS bc_to, b.seq AS seq_to, row_number() OVER (PARTITION BY a.bc_seq, a.seq ORDER BY b.n_reads DESC, b.bc_seq, b.seq) AS r
  FROM uniq a, uniq b WHERE a.n_reads <= 0.2::DOUBLE * b.n_reads AND (a.bc_seq <> b.bc_seq OR a.seq <> b.seq) AND CASE WHEN length(a.bc_seq) = length(b.bc_seq) THEN hamming(a.bc_seq, b.bc_seq) <= 1 ELSE FALSE END
  AND CASE WHEN abs(length(a.seq) - length(b.seq)) <= floor(0.05::DOUBLE * greatest(length(a.seq), length(b.seq))) THEN levenshtein(a.seq, b.seq) <= 0.05::DOUBLE * greatest(length(a.seq), length(b.seq)) ELSE FALSE END),
firstp AS (SELECT bc_seq, seq, bc_to, seq_to FROM pairs WHERE r = 1)"""
_AMB = "amb AS (SELECT a.v_ids, a.cdr3, a.j_ids, b.v_ids AS v_of, b.j_ids AS j_of, a.count, b.count AS count_of FROM toys a JOIN toys b ON a.cdr3 = b.cdr3 AND list_has_all(a.v_ids, b.v_ids) AND list_has_all(a.j_ids, b.j_ids) AND (a.v_ids <> b.v_ids OR a.j_ids <> b.j_ids))"
_AMB_KEYS = f"{KEYS}, array_to_string(v_of, ',') AS v_of, array_to_string(j_of, ',') AS j_of, count, count_of"
_COUNTS = "SELECT vn || ':' || cdr3 || ':' || jn AS fingerprint, sum(count)::BIGINT AS count FROM named GROUP BY 1"
_RDT_NAMES = "(SELECT string_agg(seg_type || seg_id || '*' || allele, '' ORDER BY seg_idx) FROM segments WHERE list_contains({0}, seg_idx))"

_CORRECTED = JUDGED.replace("WITH", "WITH RECURSIVE", 1).replace("FROM uniq GROUP BY 1)", "FROM fixed GROUP BY 1)").replace(
    "seqs AS (",
    f"""{_PAIRS}, chain AS (SELECT bc_seq, seq, n_reads, bc_seq AS b, seq AS s FROM uniq UNION ALL SELECT c.bc_seq, c.seq, c.n_reads, p.bc_to, p.seq_to FROM chain c JOIN firstp p ON p.bc_seq = c.b AND p.seq = c.s),
fixed AS (SELECT b AS bc_seq, s AS seq, sum(n_reads)::BIGINT AS n_reads FROM chain WHERE NOT EXISTS (SELECT 1 FROM firstp p WHERE p.bc_seq = b AND p.seq = s) GROUP BY 1, 2),
seqs AS (""",
)
_NAMES = "(SELECT string_agg(seg_type || seg_id, '' ORDER BY seg_idx) FROM segments WHERE list_contains({0}, seg_idx))"

SQL: dict[str, str] = {
    "clonotyping": ANALYSED.replace(JUDGED, _CORRECTED)
    + f""", mapped AS (SELECT list_sort(list_distinct(list_transform(v_ids, lambda x: CASE WHEN x >= 100 THEN x - 100 ELSE x END))) AS v_ids, cdr3_aa, j_ids, n_reads, bcs FROM analysed WHERE reject IS NULL),
fp AS (SELECT {_NAMES.format('v_ids')} || ':' || cdr3_aa || ':' || {_NAMES.format('j_ids')} AS fingerprint, n_reads, bcs FROM mapped),
codes AS (SELECT fingerprint, count(DISTINCT bc) AS n FROM (SELECT fingerprint, unnest(bcs) AS bc FROM fp) WHERE bc <> '' GROUP BY 1)
SELECT f.fingerprint, f.count, coalesce(codes.n, 0)::BIGINT AS n_barcodes FROM (SELECT fingerprint, sum(n_reads)::BIGINT AS count FROM fp GROUP BY 1) f LEFT JOIN codes USING (fingerprint)""",
    "quality_having": f"""{ANALYSED}, one AS (SELECT bc_seq, seq, id, min(qual) AS qual FROM judged WHERE reject IS NULL GROUP BY 1, 2, 3),
by_pos AS (SELECT seq, pos, avg(q) AS m FROM (SELECT seq, unnest(qual) AS q, unnest(range(1, len(qual) + 1)) AS pos FROM one) GROUP BY 1, 2),
cut AS (SELECT v_ids, cdr3_nt AS cdr3, j_ids, pos - cdr_begin AS place, floor(m + 1e-9) * n_reads AS q, n_reads FROM analysed a JOIN by_pos b ON a.seq = b.seq AND pos > cdr_begin AND pos <= cdr_end WHERE reject IS NULL),
means AS (SELECT v_ids, cdr3, j_ids, place, sum(q) / sum(n_reads)::DOUBLE AS m FROM cut GROUP BY 1, 2, 3, 4),
rated AS (SELECT v_ids, cdr3, j_ids, avg(m) AS quality FROM means GROUP BY 1, 2, 3)
SELECT {KEYS}, round(quality, 6) AS quality FROM rated WHERE quality >= 35.0::DOUBLE - 1e-9""",
    "read_steps": f"{JUDGED} SELECT id, bc_seq, reverse(translate(substr(seq, 1, 60), 'ACGTN', 'TGCAN')) AS seq, least(60, len(qual))::INT AS n_qual, qual[least(60, len(qual))] AS first_qual FROM split",
    "qc_reject_reasons": f"{JUDGED} SELECT id, reject FROM judged",
    "qc_summary": f"{JUDGED} SELECT reject, count(*) AS n FROM judged GROUP BY 1",
    "paired_qc": f"""WITH {X.reads(True)}, pr AS (SELECT id, seq, qual, substr(seq, 1, 60 + ok % 40) AS fw, list_slice(qual, 1, least(len(qual), 60 + ok % 40)) AS fq FROM reads),
sp AS (SELECT id, seq, qual, CASE WHEN length(fw) >= 10 THEN substr(fw, 1, 10) ELSE '' END AS bc_seq, list_slice(fq, 1, 10) AS bq, CASE WHEN length(fw) >= 10 THEN substr(fw, 11) ELSE fw END AS fw, list_slice(fq, 11, len(fq)) AS fq, length(fw) < 10 AS short FROM pr)
SELECT id, CASE WHEN short THEN 'TOO_SHORT_FOR_BARCODE' WHEN contains(bc_seq, 'N') THEN 'N_IN_BARCODE' WHEN list_min(bq) < 30 THEN 'LOW_QUALITY_BARCODE_BASE' WHEN list_sum(qual) / len(qual)::DOUBLE < 30 THEN 'AVERAGE_QUAL_FAIL' WHEN length(seq) < 75 THEN 'READ_TOO_SHORT' END AS reject,
bc_seq, CASE WHEN coalesce(list_sum(fq) / len(fq)::DOUBLE < 30, FALSE) OR length(fw) < 75 THEN 0 ELSE length(fw) END::INT AS fw_length, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS seq FROM sp""",
    "input_stats": f"{JUDGED} SELECT count(*) AS n_reads, count(reject) AS n_rejected, min(length(seq)) FILTER (reject IS NULL) AS min_length, max(length(seq)) FILTER (reject IS NULL) AS max_length FROM judged",
    "unique_reads": f"{JUDGED} SELECT bc_seq, seq, n_reads FROM uniq",
    "unique_read_quality": f"{JUDGED}, one AS (SELECT bc_seq, seq, id, min(qual) AS qual FROM judged WHERE reject IS NULL GROUP BY 1, 2, 3) SELECT bc_seq, seq, max(len(qual))::INT AS n_pos, sum(list_sum(qual))::BIGINT AS sum_q FROM one GROUP BY 1, 2",
    "barcode_stats": f"{JUDGED} SELECT bc_seq, sum(n_reads)::BIGINT AS n_reads, count(*) AS n_unique FROM uniq GROUP BY 1",
    "drop_barcode": f"{JUDGED} SELECT seq, n_reads, array_to_string(list_sort(bcs), ',') AS bcs FROM seqs",
    "segment_scf": f"WITH {X.segments(True)}, s AS (SELECT seg_type AS side, CASE WHEN seg_type = 'V' THEN substr(seq, motif_pos + 4 - 40, 40) ELSE substr(seq, motif_pos + 1, 12) END AS scf, seg_idx FROM segments) SELECT side, scf, array_to_string(list_sort(list(seg_idx)), ',') AS segs FROM s GROUP BY 1, 2",
    "first_allele": f"WITH {X.segments(True)} SELECT seg_idx, min(seg_idx) OVER (PARTITION BY locus, seg_type, seg_id) AS first_idx FROM segments",
    "kmer_seed_hits": f"""{JUDGED}, {X.segments(True)}, scfs AS (SELECT DISTINCT substr(seq, motif_pos + 4 - 40, 40) AS scf FROM segments WHERE seg_type = 'V'), o AS (SELECT unnest(range(0, 119)) AS off)
SELECT r.seq, scf, off::INT AS begin FROM seqs r, scfs, o WHERE off + 40 <= length(r.seq) AND ({' OR '.join(f'substr(r.seq, off + {k * 13 + 1}, 13) = substr(scf, {k * 13 + 1}, 13)' for k in range(3))})""",
    "best_segment_ties": f"{MATCHED} SELECT seq, seg_idx, (n - 2 * n_err)::BIGINT AS score, n::BIGINT AS aln_len, n_err::BIGINT AS n_err, motif_at::BIGINT AS motif_at FROM (SELECT * FROM v_best UNION ALL SELECT * FROM j_best)",
    "cdr3_extract": f"{ANALYSED} SELECT seq, array_to_string(v_ids, ',') AS v_ids, array_to_string(j_ids, ',') AS j_ids, cdr_begin::BIGINT AS cdr_begin, cdr_end::BIGINT AS cdr_end, cdr3_nt, cdr3_aa, reject FROM analysed",
    "reject_log": f"{ANALYSED} SELECT id, reject AS reason FROM judged WHERE reject IS NOT NULL UNION ALL SELECT id, reason FROM (SELECT DISTINCT a.seq, i.id, a.reject AS reason FROM analysed a JOIN judged i ON i.seq = a.seq AND i.reject IS NULL WHERE a.reject IS NOT NULL)",
    "translate_cdr3": f"{JUDGED} SELECT seq, {translate_sql('seq')} AS aa FROM seqs",
    "clonotypes_nuc": f"{ANALYSED} SELECT {KEYS}, count, (SELECT count(*) FROM nuc_bc b WHERE b.v_ids = nuc.v_ids AND b.cdr3 = nuc.cdr3 AND b.j_ids = nuc.j_ids) AS n_barcodes FROM nuc",
    "drop_alleles": f"""{ANALYSED}, m AS (SELECT list_sort(list_distinct(list_transform(v_ids, lambda x: CASE WHEN x >= 100 THEN x - 100 ELSE x END))) AS v_ids, cdr3, j_ids, count FROM nuc) SELECT {KEYS}, sum(count)::BIGINT AS count FROM m GROUP BY m.v_ids, m.cdr3, m.j_ids""",
    "clonotypes_aa": f"{ANALYSED}, aa AS (SELECT v_ids, cdr3_aa AS cdr3, j_ids, sum(n_reads)::BIGINT AS count FROM analysed WHERE reject IS NULL GROUP BY 1, 2, 3), bc AS (SELECT DISTINCT v_ids, cdr3_aa AS cdr3, j_ids, unnest(bcs) AS b FROM analysed WHERE reject IS NULL) SELECT {KEYS}, count, (SELECT count(*) FROM bc WHERE bc.v_ids = aa.v_ids AND bc.cdr3 = aa.cdr3 AND bc.j_ids = aa.j_ids) AS n_barcodes FROM aa",
    "clonotype_counts": f"{ANALYSED} {_COUNTS}",
    "top10_clonotypes": f"{ANALYSED} SELECT * FROM ({_COUNTS}) ORDER BY count DESC, fingerprint LIMIT 10",
    "freq_outer_join": f"WITH {X.toy_clones(True)}, t AS (SELECT array_to_string(v_ids, ',') || ':' || cdr3 || ':' || array_to_string(j_ids, ',') AS fingerprint, count FROM toys), a AS (SELECT fingerprint, count / sum(count) OVER ()::DOUBLE AS f FROM t WHERE count >= 60), b AS (SELECT fingerprint, count / sum(count) OVER ()::DOUBLE AS f FROM t WHERE count < 90) SELECT fingerprint, round(coalesce(a.f, 0), 9) AS freq_a, round(coalesce(b.f, 0), 9) AS freq_b FROM a FULL JOIN b USING (fingerprint)",
    "hamming_pairs": f"{ANALYSED}, c AS (SELECT DISTINCT cdr3_nt AS cdr3 FROM analysed WHERE reject IS NULL) SELECT a.cdr3 AS cdr3_1, b.cdr3 AS cdr3_2 FROM c a, c b WHERE a.cdr3 <> b.cdr3 AND CASE WHEN length(a.cdr3) = length(b.cdr3) THEN hamming(a.cdr3, b.cdr3) <= 2 ELSE FALSE END",
    "umi_merge_pairs": f"{JUDGED}, {_PAIRS} SELECT * FROM firstp",
    "umi_corrected": JUDGED.replace("WITH", "WITH RECURSIVE", 1) + f", {_PAIRS}, chain AS (SELECT bc_seq, seq, n_reads, bc_seq AS b, seq AS s FROM uniq UNION ALL SELECT c.bc_seq, c.seq, c.n_reads, p.bc_to, p.seq_to FROM chain c JOIN firstp p ON p.bc_seq = c.b AND p.seq = c.s) SELECT b AS bc_seq, s AS seq, sum(n_reads)::BIGINT AS n_reads FROM chain WHERE NOT EXISTS (SELECT 1 FROM firstp p WHERE p.bc_seq = b AND p.seq = s) GROUP BY 1, 2",
    "cluster_candidate_pairs": f"{ANALYSED}, p AS (SELECT a.v_ids, a.cdr3, a.j_ids, b.v_ids AS v2, b.cdr3 AS c2, b.j_ids AS j2, CASE WHEN length(a.cdr3) = length(b.cdr3) THEN hamming(a.cdr3, b.cdr3) END AS n_err FROM nuc a, nuc b WHERE a.count <= 0.25 * b.count AND list_has_any(a.v_ids, b.v_ids) AND list_has_any(a.j_ids, b.j_ids) AND (a.cdr3 <> b.cdr3 OR a.v_ids <> b.v_ids OR a.j_ids <> b.j_ids)) SELECT {KEYS}, array_to_string(v2, ',') AS v_ids_to, c2 AS cdr3_to, array_to_string(j2, ',') AS j_ids_to, n_err::BIGINT AS n_err FROM p WHERE n_err <= 1",
    "lq_positions": f"WITH q AS (SELECT l_orderkey, l_linenumber, {X.mapped('12', 'CAST(20 + (l_orderkey * i * 7 + l_linenumber * i * i) % 21 AS DOUBLE)', True)} AS q FROM lineitem), t AS (SELECT *, list_median(q) - list_stddev_samp(q) AS lim FROM q) SELECT l_orderkey, l_linenumber, array_to_string(list_filter(range(0, 12), lambda i: q[i + 1] <= lim), ',') AS positions FROM t",
    "ambiguity_candidates": f"WITH {X.toy_clones(True)}, {_AMB} SELECT {_AMB_KEYS} FROM amb",
    "redistribute_counts": f"WITH {X.toy_clones(True)}, {_AMB}, k AS (SELECT {_AMB_KEYS} FROM amb), f AS (SELECT *, (count * count_of) // (sum(count_of) OVER (PARTITION BY v_ids, cdr3, j_ids)) AS g, row_number() OVER (PARTITION BY v_ids, cdr3, j_ids ORDER BY v_of, j_of) AS r FROM k) SELECT v_ids, cdr3, j_ids, v_of, j_of, count, count_of, (g + CASE WHEN r <= count - sum(g) OVER (PARTITION BY v_ids, cdr3, j_ids) THEN 1 ELSE 0 END)::BIGINT AS given FROM f",
    "rdt_rows": f"{ANALYSED}, i AS (SELECT DISTINCT seq, id FROM judged WHERE reject IS NULL) SELECT id AS SEQ_ID, cdr_begin::BIGINT AS CDR3_BEGIN, cdr_end::BIGINT AS CDR3_END, {_RDT_NAMES.format('v_ids')} AS V_MATCHES, CASE WHEN v_agreed THEN array_to_string(v_places, ',') END AS V_ERRPOS, CASE WHEN v_agreed THEN v_outer END::BIGINT AS V_MATCHLEN, {_RDT_NAMES.format('j_ids')} AS J_MATCHES, CASE WHEN j_agreed THEN array_to_string(j_places, ',') END AS J_ERRPOS, CASE WHEN j_agreed THEN j_outer END::BIGINT AS J_MATCHLEN, cdr3_nt AS CDR3_NUCSEQ, cdr3_aa AS CDR3_AASEQ FROM analysed JOIN i USING (seq) WHERE reject IS NULL",
}
