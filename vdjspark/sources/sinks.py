"""Tab-separated outputs, and the names they get."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

SUFFIX = {"oa": ".act", "on": ".nct", "o": ".rdt", "rlog": ".rlg", "bst": ".bst", "oab": ".bact", "onb": ".bnct"}


def output_name(option: str, value: str, source: str) -> str:
    """The value, or for ``-`` the input's base name (without .gz and its extension) with the option's suffix."""
    if value != "-":
        return value
    base = os.path.basename(source).removesuffix(".gz")
    return os.path.splitext(base)[0] + SUFFIX[option]


def write_tsv(df: DataFrame, path: str, header: bool, sort: bool = False) -> None:
    """One folder of part files; with ``sort`` the parts, in order, are sorted by the line."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns])
    out = df.select(*df.columns, line.alias("_line")).repartitionByRange("_line").sortWithinPartitions("_line").drop("_line") if sort else df
    out.write.mode("overwrite").csv(path, sep="\t", header=header, nullValue="NA")


def reject_log(*parts: DataFrame) -> DataFrame:
    """id, reason of all rejected reads."""
    out = parts[0].where("reject is not null").select("id", F.col("reject").alias("reason"))
    for p in parts[1:]:
        out = out.unionByName(p.where("reject is not null").select("id", F.col("reject").alias("reason")))
    return out


def rejected_reads(judged: DataFrame, analysed: DataFrame) -> DataFrame:
    """As ``reject_log``, of reads that keep their barcodes, in one pass: those judged, and those whose sequence the analysis rejected, each id once for a sequence."""
    from ..operators.checkpoints import checkpoint, handed_out

    key = [c for c in ("fw_seq", "seq") if c in analysed.columns]
    late = handed_out(checkpoint(analysed.where("reject is not null").select(*key, F.col("reject").alias("_late"))))
    rows = judged.select("id", *key, "reject").join(late, key, "left").where("reject is not null or _late is not null")
    early = F.col("reject").isNotNull()
    # a number sets each of the judged ones apart
    rows = rows.select("id", *[F.when(~early, F.col(c)).alias(c) for c in key], F.coalesce("reject", "_late").alias("reason"), F.when(early, F.monotonically_increasing_id()).alias("_n"))
    return rows.distinct().select("id", "reason")


def read_table(analysed: DataFrame, ids: DataFrame, segments: DataFrame, with_sequence: bool = False, merge_alleles: bool = False) -> DataFrame:
    """One row for each read id of an accepted read, in the columns of the per-read table.

    Places of errors, and the length that they refer to, are null where tied segments disagree.
    """
    from ..functions import sequences as S
    from ..operators.checkpoints import checkpoint, handed_out

    rows, key = analysed.where("reject is null"), [c for c in ("fw_seq", "seq") if c in analysed.columns]
    for c in ("v_ids", "j_ids"):
        each = rows.select(c).distinct().select(c, F.posexplode(c).alias("pos", "seg_idx")).join(segments.select("seg_idx", "seg_type", "seg_id", "allele"), "seg_idx")
        rows = rows.join(each.groupBy(c).agg(S.gene_list(F.array_sort(F.collect_list(F.struct("pos", "seg_type", "seg_id", "allele"))), merge_alleles).alias(f"{c}_name")), c)
    for s in "vj":
        rows = rows.withColumn(f"{s}_places", F.array_join(F.transform(f"{s}_err_pos", lambda x: x.cast("string")), ","))
    # ids meet the rows' numbers first, so no sequence is carried along
    rows = checkpoint(rows.withColumn("_n", F.monotonically_increasing_id()))
    numbers = handed_out(rows.select(*key, "_n"))
    out = ids.select(*key, "id").join(numbers, key).select("_n", "id").distinct().join(handed_out(rows), "_n")
    # the table's column names are fixed values
    reads = {"fw_seq": "vRead", "seq": "vdjRead"} if "fw_seq" in key else {"seq": "read"}
    names = {"id": "SEQ_ID"} | (reads if with_sequence else {}) | {"cdr_begin": "CDR3_BEGIN", "cdr_end": "CDR3_END", "v_ids_name": "V_MATCHES", "v_places": "V_ERRPOS", "v_outer_len": "V_MATCHLEN", "j_ids_name": "J_MATCHES", "j_places": "J_ERRPOS", "j_outer_len": "J_MATCHLEN", "cdr3_nt": "CDR3_NUCSEQ", "cdr3_aa": "CDR3_AASEQ"}
    return out.select(*[F.col(c).alias(n) for c, n in names.items()])
