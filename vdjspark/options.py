"""Options of a clonotyping job; defaults are those of the command line that users know."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    max_err_v: float = 0.05  # -ev
    max_err_j: float = 0.15  # -ej
    v_core_length: int | None = None  # -vcl, None: from the shortest read
    v_core_offset: int = 0  # -vco
    j_core_length: int = 12  # -jcl
    j_core_offset: int = -6  # -jco
    v_core_errors: int | None = None  # -vce
    j_core_errors: int | None = None  # -jce
    min_quality: int = 30  # -mq
    min_clone_quality: float = 30  # -mcq
    min_read_length: int = 75  # -mrl
    min_cdr3_length: int = 5  # -mcl
    single_end_fallback: bool = False  # -sfb
    truncate: int | None = None  # -tr
    reverse: bool = False  # -r
    keep_alleles: bool = False  # -al
    barcode_length: int = 0  # -bcl
    barcode_in_vdj: bool = False  # -bvdj
    barcode_errors: int = 1  # -bse
    barcode_min_quality: int = 30  # -bmq
    barcode_seq_rate: float = 0.05  # -ber
    barcode_ratio: float = 0.2  # -bfr
    merge_ambiguous: bool = False  # -ma
    cluster_quality: bool = False  # -qc
    cluster_simple: bool = False  # -sc
    cluster_quality_errors: int = 1  # -qcme
    cluster_quality_sd: float = 1.0  # -qcsd
    cluster_simple_errors: int = 1  # -scme
    cluster_ratio: float = 0.25  # -mcr
    default_quality: int = 60  # of FASTA input

    def __post_init__(self) -> None:
        if not 5 <= self.j_core_length <= 45:
            raise ValueError("j_core_length lies between 5 and 45")
        if self.v_core_length is not None and self.v_core_length < 5:
            raise ValueError("v_core_length is 5 at least")
        if not 0 <= self.min_quality <= 60:
            raise ValueError("min_quality lies between 0 and 60")
        if not 0 < self.max_err_v < 1 or not 0 <= self.max_err_j < 1:
            raise ValueError("error rates are fractions, that of V above zero")

    @property
    def cluster_errors(self) -> int:
        """Most mismatches of a clustered pair."""
        return self.cluster_quality * self.cluster_quality_errors + self.cluster_simple * self.cluster_simple_errors
