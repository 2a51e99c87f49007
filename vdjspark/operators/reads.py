"""Reads: barcode, orientation, quality control, unique reads and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sequences as S
from ..options import Options

PLACES = 16  # of an array, summed in one row


def split_barcode(reads: DataFrame, n: int, side: str = "seq") -> DataFrame:
    """Moves the first ``n`` bases and qualities of a read to ``bc_seq``, ``bc_qual``; ``bc_short`` marks reads that have none."""
    qual = "fw_qual" if side == "fw_seq" else "qual"
    if n <= 0:
        return reads.withColumns({"bc_seq": F.lit(""), "bc_qual": F.array().cast("array<int>"), "bc_short": F.lit(False)})
    long = F.length(side) >= n
    return reads.withColumns({
        "bc_seq": S.barcode_of(F.col(side), n), "bc_qual": F.when(long, F.slice(qual, 1, n)).otherwise(F.array().cast("array<int>")), "bc_short": ~long,
        side: S.after_barcode(F.col(side), n), qual: F.when(long, F.slice(F.col(qual), F.lit(n + 1), F.greatest(F.size(qual) - n, F.lit(0)))).otherwise(F.col(qual)),
    })


def truncated(reads: DataFrame, n: int | None) -> DataFrame:
    if not n:
        return reads
    pairs = [(s, q) for s, q in (("seq", "qual"), ("fw_seq", "fw_qual")) if s in reads.columns]
    return reads.withColumns({c: e for s, q in pairs for c, e in ((s, S.truncate(F.col(s), n)), (q, F.slice(q, 1, n)))})


def oriented(reads: DataFrame, reverse: bool) -> DataFrame:
    """Single reads turn unless ``reverse``; of pairs the VDJ read turns, or with ``reverse`` the V read."""
    paired = "fw_seq" in reads.columns
    if not paired and reverse:
        return reads
    seq, qual = ("fw_seq", "fw_qual") if paired and reverse else ("seq", "qual")
    return reads.withColumns({seq: S.revcomp(F.col(seq)), qual: F.reverse(qual)})


def reject_reason(opts: Options, paired: bool) -> Column:
    """The first failing rule, null for reads that pass. N counts as quality 0 in barcodes."""
    out = F.when(F.col("bc_short"), "TOO_SHORT_FOR_BARCODE").when(F.col("bc_seq").contains("N"), "N_IN_BARCODE")
    if opts.barcode_min_quality > 0:
        out = out.when(S.any_below(F.col("bc_qual"), opts.barcode_min_quality), "LOW_QUALITY_BARCODE_BASE")
    strict = paired and not opts.single_end_fallback
    if opts.min_quality > 0:
        bad = S.average_below(F.col("qual"), opts.min_quality)
        out = out.when(bad | S.average_below(F.col("fw_qual"), opts.min_quality) if strict else bad, "AVERAGE_QUAL_FAIL")
    short = F.length("seq") < opts.min_read_length
    return out.when(short | (F.length("fw_seq") < opts.min_read_length) if strict else short, "READ_TOO_SHORT")


def quality_control(reads: DataFrame, opts: Options) -> DataFrame:
    """Adds ``reject``; with the single-end fallback a failing V read is blanked instead."""
    paired = "fw_seq" in reads.columns
    judged = reads.withColumn("reject", reject_reason(opts, paired))
    if paired and opts.single_end_fallback:
        bad = S.average_below(F.col("fw_qual"), opts.min_quality) | (F.length("fw_seq") < opts.min_read_length)
        judged = judged.withColumn("fw_seq", F.when(bad, F.lit("")).otherwise(F.col("fw_seq"))).withColumn("fw_qual", F.when(bad, F.array().cast("array<int>")).otherwise(F.col("fw_qual")))
    return judged


def _settled(df: DataFrame, before: DataFrame) -> DataFrame:
    """``df`` with all that isn't named as in ``before``, and its reads, as rows of a generator: each is worked out once, however often later steps ask."""
    new = [c for c in df.columns if c not in before.columns or c in ("seq", "qual", "fw_seq", "fw_qual")]
    return df.select(*[c for c in df.columns if c not in new], F.inline(F.array(F.struct(*new))))


def prepare(reads: DataFrame, opts: Options) -> DataFrame:
    """Barcode split, truncation, quality control, orientation, in that order."""
    side = "fw_seq" if "fw_seq" in reads.columns and not opts.barcode_in_vdj else "seq"
    cut = _settled(truncated(split_barcode(reads, opts.barcode_length, side), opts.truncate), reads)
    return oriented(_settled(quality_control(cut, opts), cut), opts.reverse)


def input_stats(judged: DataFrame) -> DataFrame:
    """total reads, rejected, and the shortest and longest of those that passed, in one row."""
    passed, lengths = F.col("reject").isNull(), [F.length("seq")] + [F.length("fw_seq")] * ("fw_seq" in judged.columns)
    low, high = (F.least(*lengths), F.greatest(*lengths)) if len(lengths) > 1 else (lengths[0], lengths[0])
    return judged.agg(F.count("*").alias("n_reads"), F.count("reject").alias("n_rejected"), F.min(F.when(passed, low)).alias("min_length"), F.max(F.when(passed, high)).alias("max_length"))


def _key(df: DataFrame) -> list[str]:
    return [c for c in ("bc_seq", "fw_seq", "seq") if c in df.columns]


def read_ids(judged: DataFrame) -> DataFrame:
    """Key and id of each read that passed; an id counts once for a key."""
    return judged.where("reject is null").select(*_key(judged), "id").distinct()


def unique_reads(judged: DataFrame) -> DataFrame:
    """One row for each barcode and sequence: n_reads, different ids."""
    return read_ids(judged).groupBy(*_key(judged)).agg(F.count("*").alias("n_reads"))


def _place_means(rows: DataFrame, key: list[str], values: str, weight: Column) -> DataFrame:
    """Key, the sum of the weights (``n``), and the weighted mean at each place of an array (``m``).

    A row gives one row for each ``PLACES`` places, whose sums lie side by side, so no group's arrays come together in one place.
    """
    size = F.coalesce(F.size(values), F.lit(0))
    parts = rows.select(*key, values, weight.alias("_w"), size.alias("_size"), F.explode(F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / PLACES).cast("int"))).alias("_part"))
    at = [F.get(values, F.col("_part") * PLACES + i) for i in range(PLACES)]
    sums = [F.sum(x * F.col("_w")).alias(f"_s{i}") for i, x in enumerate(at)] + [F.sum(F.when(x.isNotNull(), F.col("_w"))).alias(f"_n{i}") for i, x in enumerate(at)]
    means = parts.groupBy(*key, "_part").agg(F.sum("_w").alias("n"), F.max("_size").alias("_size"), *sums)
    means = means.select(*key, "n", "_size", "_part", F.array(*[F.col(f"_s{i}") / F.col(f"_n{i}") for i in range(PLACES)]).alias("m"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "m"))), lambda x: x["m"]))
    return means.groupBy(*key).agg(F.max(F.when(F.col("_part") == 0, F.col("n"))).alias("n"), F.slice(whole, F.lit(1), F.max("_size")).alias("m"))


def mean_qualities(judged: DataFrame, qual: str = "qual") -> DataFrame:
    """Key, n_reads and the mean quality at each position (``avg_qual``); an id counts once for a key."""
    key = _key(judged)
    rows = judged.where("reject is null").groupBy("id", *key).agg(F.min(qual).alias("q"))
    return _place_means(rows, key, "q", F.lit(1)).select(*key, F.col("n").alias("n_reads"), F.col("m").alias("avg_qual"))


def sequence_qualities(qualities: DataFrame, surviving: DataFrame) -> DataFrame:
    """Sequence and ``avg_qual`` over its barcodes, weighted by their reads after correction.

    Only surviving reads have a say: what joined one of them adds to its weight, not to its qualities.
    """
    key = _key(surviving)
    rows = surviving.select(*key, "n_reads").join(qualities.select(*key, "avg_qual"), key).where(F.size("avg_qual") > 0)
    key = [c for c in key if c != "bc_seq"]
    return _place_means(rows, key, "avg_qual", F.col("n_reads")).select(*key, F.col("m").alias("avg_qual"))


def barcode_stats(unique: DataFrame) -> DataFrame:
    return unique.groupBy("bc_seq").agg(F.sum("n_reads").alias("n_reads"), F.count("*").alias("n_unique"))


def drop_barcode(unique: DataFrame) -> DataFrame:
    """Sequences over all barcodes: n_reads, and the barcodes that contributed, sorted."""
    key = [c for c in _key(unique) if c != "bc_seq"]
    return unique.groupBy(*key).agg(F.sum("n_reads").alias("n_reads"), F.array_sort(F.collect_set(F.when(F.col("bc_seq") != "", F.col("bc_seq")))).alias("bcs"))


def paired(v_reads: DataFrame, vdj_reads: DataFrame) -> DataFrame:
    """Mates by record number; the id is the V read's, and what one file has more is left out."""
    v = v_reads.select("record_no", "id", F.col("seq").alias("fw_seq"), F.col("qual").alias("fw_qual"))
    return v.join(vdj_reads.select("record_no", "seq", "qual"), "record_no")
