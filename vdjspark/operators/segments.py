"""Germline segments: core fragments, seeds, and best matches with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequences as S
from .fuzzy import kmers


def auto_v_core_length(min_read_length: int, min_motif: int) -> int:
    """10 for short reads, else what exceeds 110 bases; at most the shortest segment's part before the motif's end, and 60."""
    return min(10 if min_read_length <= 120 else min_read_length - 110, min_motif + 2, 60)


def core_fragments(segments: DataFrame, side: str, length: int, offset: int = 0) -> DataFrame:
    """scf, scf_start (against the motif) and the segments that have it. A segment that can't have one is an error."""
    start = 3 - length + offset if side == "V" else offset
    at = F.col("motif_pos") + start
    inside = (at >= 0) & (at + length <= F.length("seq"))
    checked = segments.where(F.col("seg_type") == side).withColumn("scf", F.when(inside, F.substr("seq", at + 1, F.lit(length))).otherwise(F.raise_error(F.concat(F.lit("no core fragment in segment "), F.col("seg_id")))))
    return checked.groupBy("scf").agg(F.array_sort(F.collect_list("seg_idx")).alias("segs")).withColumn("scf_start", F.lit(start))


def first_alleles(segments: DataFrame) -> DataFrame:
    """seg_idx, first_idx: the first segment of the same locus, type and id."""
    return segments.select("seg_idx", F.min("seg_idx").over(Window.partitionBy("locus", "seg_type", "seg_id")).alias("first_idx"))


def seed_hits(reads: DataFrame, scfs: DataFrame, length: int, errors: int) -> DataFrame:
    """seq, scf, begin: places at which a fragment may match with up to ``errors`` mismatches.

    One of the fragment's errors + 1 pieces is in the read as it is, so an equi-join finds all.
    """
    q = length // (errors + 1)
    parts = scfs.select("scf", F.explode(F.transform(F.sequence(F.lit(0), F.lit(errors)), lambda k: F.struct((k * q).alias("at"), F.substr("scf", k * q + 1, F.lit(q)).alias("kmer")))).alias("p")).select("scf", "p.at", "p.kmer")
    found = reads.select("seq", F.explode(kmers(F.col("seq"), q)).alias("k")).select("seq", "k.pos", "k.kmer")
    begin = F.col("pos") - F.col("at")
    return found.join(parts, "kmer").select("seq", "scf", begin.alias("begin")).where((F.col("begin") >= 0) & (F.col("begin") + length <= F.length("seq"))).distinct()


def ungapped_matches(reads: DataFrame, segments: DataFrame, side: str, length: int, errors: int, max_rate: float, offset: int = 0, every: bool = False) -> DataFrame:
    """seq, seg_idx, score, aln_len, n_err, motif_at, outer_len, err_pos of the best segments of each read, ties kept, or of every one; substitutions only.

    ``err_pos``: errors outside of the CDR3, against the last base of V's motif (0, -1, ...) or the
    first base of J's (1, 2, ...; that base itself isn't asked). ``outer_len``: the bases there.
    """
    scfs = core_fragments(segments, side, length, offset)
    hits = seed_hits(reads, scfs, length, errors).where(S.mismatches(F.col("scf"), F.substr("seq", F.col("begin") + 1, F.lit(length))) <= errors)
    where = hits.join(scfs, "scf").select("seq", (F.col("begin") - F.col("scf_start")).alias("motif_at"), F.explode("segs").alias("seg_idx")).distinct()
    whole = where.join(segments.select("seg_idx", "motif_pos", F.col("seq").alias("seg")), "seg_idx")
    if side == "V":  # the segment up to its motif's end; a read may begin inside it
        first = F.greatest(F.lit(0), F.col("motif_at") - F.col("motif_pos"))
        n = F.col("motif_at") + 3 - first
        segment = F.substr("seg", F.col("motif_pos") - F.col("motif_at") + first + 1, n)
    else:  # the segment from its motif on; a read may end inside it
        first = F.col("motif_at")
        n = F.least(F.length("seg") - F.col("motif_pos"), F.length("seq") - first)
        segment = F.substr("seg", F.col("motif_pos") + 1, n)
    scored = whole.withColumn("aln_len", n).withColumn("n_err", S.mismatches(segment, F.substr("seq", first + 1, n))).withColumn("score", F.col("aln_len") - 2 * F.col("n_err"))
    scored = scored.where(F.col("n_err") <= max_rate * F.col("aln_len"))
    wrong = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (i < n) & (F.substr(segment, i + 1, F.lit(1)) != F.substr("seq", first + i + 1, F.lit(1))))
    scored = scored.withColumn("outer_len", n).withColumn("err_pos", F.transform(wrong, lambda i: (i - n + 1).cast("int")) if side == "V" else F.filter(wrong, lambda i: i > 0))
    return (scored if every else best_of(scored, ["seq"])).select("seq", "seg_idx", "score", "aln_len", "n_err", "motif_at", "outer_len", "err_pos").distinct()


def best_of(matches: DataFrame, key: list[str]) -> DataFrame:
    """The matches with the highest score of each key, ties kept."""
    return matches.withColumn("rank", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("score")))).where("rank = 1").drop("rank")


def ties(matches: DataFrame, side: str) -> DataFrame:
    """One row a read: sorted segment ids; the motif's place, the errors' number and places, each null where ties disagree."""
    s = side.lower()
    same = F.when(F.min("motif_at") == F.max("motif_at"), F.min("motif_at"))
    errors = F.when(F.min("n_err") == F.max("n_err"), F.min("n_err"))
    agreed = F.min("err_pos") == F.max("err_pos")
    places, outer = F.when(agreed, F.min("err_pos")), F.when(agreed, F.min_by("outer_len", "seg_idx"))
    return matches.groupBy("seq").agg(
        F.array_sort(F.collect_set("seg_idx")).alias(f"{s}_ids"), same.alias(f"{s}_motif"), errors.alias(f"{s}_err"), F.max("aln_len").alias(f"{s}_len"),
        places.alias(f"{s}_err_pos"), outer.alias(f"{s}_outer_len"),
    )


def cdr3(reads: DataFrame, v: DataFrame, j: DataFrame, min_length: int = 5) -> DataFrame:
    """Adds segment ids, CDR3 bounds (half-open, motifs included), its bases and amino acids, and ``reject``."""
    return judge_cdr3(reads.join(ties(v, "V"), "seq", "left").join(ties(j, "J"), "seq", "left"), min_length)


def judge_cdr3(joined: DataFrame, min_length: int = 5) -> DataFrame:
    """As ``cdr3``, of reads that have their ties already."""
    begin, end = F.col("v_motif"), F.col("j_motif") + 3
    joined = joined.withColumn("cdr_begin", begin).withColumn("cdr_end", end)
    nt = F.when(F.col("cdr_end") > F.col("cdr_begin"), F.substr("seq", F.col("cdr_begin") + 1, F.col("cdr_end") - F.col("cdr_begin")))
    joined = joined.withColumn("cdr3_nt", nt).withColumn("cdr3_aa", S.translate(F.col("cdr3_nt")))
    size = F.col("cdr_end") - F.col("cdr_begin")
    reason = (
        F.when(F.col("v_ids").isNull() | F.col("j_ids").isNull(), "SEGMENT_MATCH_FAILED")
        .when(F.col("v_motif").isNull() | F.col("j_motif").isNull(), "MOTIF_AMBIGUOUS").when(size <= 0, "BROKEN_CDR_BOUNDARIES")
        .when(size % 3 != 0, "OUT_OF_READING_FRAME").when(size < 3 * min_length, "CDR3_TOO_SHORT").when(F.col("cdr3_aa").contains("X"), "NONSENSE_IN_CDR3")
    )
    return joined.withColumn("reject", reason)
