"""Command line: ``python -m vdjspark -ref segments.fa -on counts reads.fastq``, or two files of pairs, V reads first."""

from __future__ import annotations

import argparse
import re
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import clonotypes as C, reads as R
from .functions import sequences as S
from .options import Options
from .plans.job import ClonotypeJob
from .sources import fastx, sinks

#: Option letters by the field of ``Options``. Fixed values.
FLAGS = {
    "max_err_v": "ev", "max_err_j": "ej", "v_core_length": "vcl", "v_core_offset": "vco", "j_core_length": "jcl", "j_core_offset": "jco", "v_core_errors": "vce", "j_core_errors": "jce", "min_quality": "mq",
    "min_clone_quality": "mcq", "min_read_length": "mrl", "min_cdr3_length": "mcl", "single_end_fallback": "sfb", "truncate": "tr", "reverse": "r", "keep_alleles": "al", "barcode_length": "bcl", "barcode_in_vdj": "bvdj",
    "barcode_errors": "bse", "barcode_min_quality": "bmq", "barcode_seq_rate": "ber", "barcode_ratio": "bfr", "merge_ambiguous": "ma", "cluster_quality": "qc", "cluster_simple": "sc", "cluster_quality_errors": "qcme",
    "cluster_quality_sd": "qcsd", "cluster_simple_errors": "scme", "cluster_ratio": "mcr",
}
OUTPUTS = {"oa": "amino-acid clonotypes", "on": "nucleotide clonotypes", "o": "per-read table", "rlog": "rejected reads", "bst": "reads of each barcode", "oab": "barcodes of amino-acid clonotypes", "onb": "barcodes of nucleotide clonotypes"}
IGNORED = {"j": "threads; Spark has its own", "pve": "without effect", "vcr": "without effect"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("vdjspark", description=__doc__, allow_abbrev=False)
    out.add_argument("reads", nargs="+", help="one file, or the V reads and the VDJ reads of pairs")
    out.add_argument("-ref", required=True, help="germline segments")
    for name, text in OUTPUTS.items():
        out.add_argument(f"-{name}", help=f"folder of {text}; - for a name out of the input's")
    out.add_argument("-s", action="store_true", help="sequences in the per-read table")
    out.add_argument("-so", action="store_true", help="sorted outputs")
    out.add_argument("-pa", help="folder of printed alignments")
    for f in fields(Options):
        if f.name in FLAGS:
            kind = {"bool": None, "int": int, "int | None": int, "float": float}[f.type]
            how = {"action": "store_true"} if kind is None else {"type": kind, "default": f.default}
            out.add_argument(f"-{FLAGS[f.name]}", dest=f.name, help=f.name.replace("_", " "), **how)
    for name, text in IGNORED.items():
        out.add_argument(f"-{name}", dest=f"ignored_{name}", help=text)
    return out


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    p = parser()
    args = p.parse_args(argv)
    if len(args.reads) > 2:
        p.error("one file of reads, or two of pairs")
    if not (args.o or args.oa or args.on):
        p.error("at least one of -o, -oa, -on")
    if args.oab and not args.oa:
        p.error("-oab needs -oa")
    return args


def options_of(args: argparse.Namespace) -> Options:
    return Options(**{name: getattr(args, name) for name in FLAGS})


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ, by the name's extension."""
    return (fastx.read_fastq if re.search(r"\.(fq|fastq)(\.gz)?$", path.lower()) else fastx.read_fasta)(spark, path)


def alignments(job: ClonotypeJob) -> DataFrame:
    """seq, side, segment, lines of the best alignments of each read."""
    names = job.segments.select("seg_idx", S.descriptor(F.struct("locus", "seg_type", "seg_id", "allele")).alias("segment"))
    both = job.matches("V", lines=True).withColumn("side", F.lit("V")).unionByName(job.matches("J", lines=True).withColumn("side", F.lit("J")))
    return both.join(names, "seg_idx").select("seq", "side", "segment", "score", F.explode(F.split("lines", "\n")).alias("line"))


def run(spark: SparkSession, args: argparse.Namespace) -> ClonotypeJob:
    files = [read_file(spark, p) for p in args.reads]
    job = ClonotypeJob(R.paired(*files) if len(files) == 2 else files[0], fastx.read_segments(spark, args.ref), options_of(args))
    merged = not job.options.keep_alleles
    print(*job.report(), sep="\n", file=sys.stderr)

    def put(option: str, df: DataFrame, header: bool = False, sort: bool = False) -> None:
        value = getattr(args, option)
        if value:
            sinks.write_tsv(df, sinks.output_name(option, value, args.reads[-1]), header, sort or args.so)

    put("bst", R.barcode_stats(job.unique).select(F.col("bc_seq").alias("BarcodeSeq"), F.col("n_reads").alias("nReads"), F.col("n_unique").alias("nUniqueReads")), header=True)
    if args.o:
        put("o", job.read_table(args.s), header=True)
    if args.rlog:
        put("rlog", job.rejects)
    for counts, codes, clones in (("on", "onb", lambda: job.clonotypes), ("oa", "oab", lambda: job.amino_clonotypes)):
        if getattr(args, counts) or getattr(args, codes):
            named = C.rendered(clones(), job.segments, merged)
            put(counts, named.select("fingerprint", "count"), sort=True)
            put(codes, named.select("fingerprint", "n_barcodes"), sort=True)
    if args.pa:
        alignments(job).write.mode("overwrite").csv(args.pa, sep="\t", header=True)
    return job


if __name__ == "__main__":
    given = parsed()
    run(SparkSession.builder.appName("vdjspark").getOrCreate(), given)
