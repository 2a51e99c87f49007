"""The whole clonotyping job. Unique sequences and analysed reads, which later steps use many times, are checkpointed; the rest is lazy."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, functions as F

from ..operators import align, clonotypes as C, cluster as K, reads as R, segments as G, umi as U
from ..operators.checkpoints import checkpoint
from ..options import Options
from ..sources import sinks


@dataclass
class ClonotypeJob:
    """reads: id, seq, qual, and fw_seq, fw_qual of pairs. segments: see sources.fastx.read_segments."""

    reads: DataFrame
    segments: DataFrame
    options: Options = Options()
    gapped: bool = True

    @cached_property
    def judged(self) -> DataFrame:
        return R.prepare(self.reads, self.options)

    @cached_property
    def unique(self) -> DataFrame:
        return R.unique_reads(self.judged)

    @cached_property
    def assigned(self) -> DataFrame | None:
        """The surviving read of each unique read, if reads have barcodes."""
        o = self.options
        return checkpoint(U.assigned(self.unique, o.barcode_errors, o.barcode_ratio, o.barcode_seq_rate)) if o.barcode_length else None

    @cached_property
    def surviving(self) -> DataFrame:
        return self.unique if self.assigned is None else U.survivors(self.assigned)

    @cached_property
    def ids(self) -> DataFrame:
        """Ids of all reads that passed, under the sequence that they count for."""
        ids = R.read_ids(self.judged)
        return (ids if self.assigned is None else U.surviving_ids(ids, self.assigned)).drop("bc_seq").distinct()

    @cached_property
    def rejects(self) -> DataFrame:
        """id, reason: reads rejected before the analysis and in it."""
        key = [c for c in ("fw_seq", "seq") if c in self.ids.columns]
        return sinks.reject_log(self.judged, self.analysed.where("reject is not null").select(*key, "reject").join(self.ids, key))

    def read_table(self, with_sequence: bool = False) -> DataFrame:
        return sinks.read_table(self.analysed, self.ids, self.segments, with_sequence, not self.options.keep_alleles)

    @cached_property
    def sequences(self) -> DataFrame:
        """Sequences with counts and the barcodes that survive; pairs keep their V read."""
        return checkpoint(R.drop_barcode(self.surviving))

    @cached_property
    def stats(self) -> Row:
        """Figures of ``reads.input_stats``."""
        return R.input_stats(self.judged).first()

    def report(self) -> list[str]:
        """What a user sees of the input: reads, those rejected, lengths of those that passed, unique ones."""
        s = self.stats
        figures = {"reads": s["n_reads"], "rejected": s["n_rejected"], "longest that passed": s["max_length"] or 0, "shortest that passed": s["min_length"] or 0, "unique reads": self.unique.count()}
        return [f"{name}: {n}" for name, n in figures.items()]

    @cached_property
    def v_core_length(self) -> int:
        if self.options.v_core_length:
            return self.options.v_core_length
        shortest = self.stats["min_length"]
        motif = self.segments.where("seg_type = 'V'").agg(F.min("motif_pos")).first()[0]
        return G.auto_v_core_length(shortest or 0, motif if motif is not None else 58)

    def matches(self, side: str, lines: bool = False, every: bool = False) -> DataFrame:
        """Best segments of each sequence, or every one within the error rate; ``lines`` adds printed alignments, which only gapped ones have."""
        o = self.options
        length, offset = (self.v_core_length, o.v_core_offset) if side == "V" else (o.j_core_length, o.j_core_offset)
        rate = o.max_err_v if side == "V" else o.max_err_j
        errors = o.v_core_errors if side == "V" else o.j_core_errors
        errors = math.ceil(rate * length) if errors is None else errors
        reads = self.sequences.select("seq").distinct()
        if self.gapped:
            return align.gapped_matches(reads, self.segments, G.core_fragments(self.segments, side, length, offset), side, errors, rate, offset, lines=lines, every=every)
        return G.ungapped_matches(reads, self.segments, side, length, errors, rate, offset, every)

    @cached_property
    def analysed(self) -> DataFrame:
        seqs, j = self.sequences, self.matches("J")
        v = self.matches("V", every="fw_seq" in seqs.columns)
        if "fw_seq" in seqs.columns:  # V reads narrow the segments that the best of a pair is chosen from; a blanked one doesn't
            allowed = align.v_read_matches(seqs, self.segments, self.options.max_err_v).select("fw_seq", "seg_idx")
            pairs = seqs.select("fw_seq", "seq").distinct()
            narrowed = pairs.where("fw_seq <> ''").join(v, "seq").join(allowed, ["fw_seq", "seg_idx"], "left_semi")
            v = G.best_of(narrowed.unionByName(pairs.where("fw_seq = ''").join(v, "seq")), ["fw_seq", "seq"])
            keyed = lambda df: df.withColumn("seq", F.concat_ws("|", "fw_seq", "seq")) if "fw_seq" in df.columns else df
            tied = G.ties(keyed(v).drop("fw_seq"), "V")
            both = seqs.withColumn("_pair", F.concat_ws("|", "fw_seq", "seq")).join(tied.withColumnRenamed("seq", "_pair"), "_pair", "left").drop("_pair")
            return checkpoint(G.judge_cdr3(both.join(G.ties(j, "J"), "seq", "left"), self.options.min_cdr3_length))
        return checkpoint(G.cdr3(seqs, v, j, self.options.min_cdr3_length))

    @cached_property
    def clonotypes(self) -> DataFrame:
        """Nucleotide clonotypes after alleles, clustering, quality and ambiguity."""
        o = self.options
        clones = C.group_clonotypes(self.analysed)
        rated = o.min_clone_quality > 0 or o.cluster_quality
        if rated:
            by_seq = R.sequence_qualities(R.mean_qualities(self.judged), self.surviving)
            clones = clones.join(C.clone_qualities(self.analysed, by_seq), C.KEY, "left")
        if not o.keep_alleles:
            clones = C.drop_alleles(clones, G.first_alleles(self.segments))
        clones = K.cluster(checkpoint(clones), o) if o.cluster_errors else clones
        clones = C.drop_low_quality(clones, o.min_clone_quality) if rated else clones
        return C.resolve_ambiguity(clones) if o.merge_ambiguous else clones

    @cached_property
    def amino_clonotypes(self) -> DataFrame:
        aa = C.translated(self.clonotypes)
        return C.resolve_ambiguity(aa) if self.options.merge_ambiguous else aa
