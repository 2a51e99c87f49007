"""Column functions over nucleotide sequences, qualities and segment sets; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: The standard genetic code, codons in the order of ACGT; stops read X. Fixed values.
CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVVXYXYSSSSXCWCLFLF"


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def truncate(seq: Column, n: int) -> Column:
    return F.substring(seq, 1, n)


def barcode_of(seq: Column, n: int) -> Column:
    """The barcode prefix; empty if the read is shorter, as then there's none."""
    return F.when(F.length(seq) >= n, F.substring(seq, 1, n)).otherwise(F.lit(""))


def after_barcode(seq: Column, n: int) -> Column:
    return F.when(F.length(seq) >= n, F.substr(seq, F.lit(n + 1))).otherwise(seq)


def translate(nt: Column) -> Column:
    """Amino acids of frame 0; codons with a letter other than A, C, G, T read X; 1 or 2 bases left over are dropped."""
    digit = lambda i: F.instr(F.lit("ACGT"), F.substr(nt, i, F.lit(1))) - 1

    def codon(i: Column) -> Column:
        a, b, c = (digit(i * 3 + k) for k in (1, 2, 3))
        return F.when((a < 0) | (b < 0) | (c < 0), F.lit("X")).otherwise(F.substr(F.lit(CODE), 16 * a + 4 * b + c + 1, F.lit(1)))

    n = F.floor(F.length(nt) / 3).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), codon), "")).otherwise(F.lit(""))


def mean(values: Column) -> Column:
    """Mean of an array; null for an empty one, which then fails no threshold."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def average_below(qual: Column, t: float) -> Column:
    """Whether the mean is less than ``t``; that is asked of arrays that hold less than ``t`` only."""
    return F.coalesce(any_below(qual, t) & (mean(qual) < t), F.lit(False))


def any_below(qual: Column, t: float) -> Column:
    return F.array_min(qual) < t


def mismatches(a: Column, b: Column) -> Column:
    """Mismatches of two sequences over the length of the first."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))


def hamming_at_most(a: Column, b: Column, most: Column | int) -> Column:
    return (F.length(a) == F.length(b)) & ((a == b) | (mismatches(a, b) <= most))


def edit_rate_at_most(a: Column, b: Column, rate: float) -> Column:
    """Levenshtein distance over the longer length; the length difference is asked first."""
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer * rate).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)  # -1: more than most


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def median(values: Column) -> Column:
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def middle(v: Column) -> Column:
        upper = F.element_at(v, half + 1)
        return F.when(n % 2 == 1, upper).otherwise((F.element_at(v, F.greatest(half, F.lit(1))) + upper) / 2)

    return once(F.array_sort(values), middle)


def sample_sd(values: Column) -> Column:
    squares = once(mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1))).otherwise(F.lit(0.0))


def low_quality_positions(values: Column, sd: float) -> Column:
    """Positions, from 0, at which the quality is at most the median less ``sd`` standard deviations."""
    limit = median(values) - sd * sample_sd(values)
    return once(limit, lambda t: F.filter(F.transform(values, lambda x, i: F.when(x <= t, i).otherwise(F.lit(-1))), lambda i: i >= 0))


def gene_list(segments: Column, merge_alleles: bool) -> Column:
    """Names of an array of (seg_type, seg_id, allele), in its order, without separator."""
    name = lambda s: F.concat(s["seg_type"], s["seg_id"])
    if merge_alleles:
        return F.array_join(F.array_distinct(F.transform(segments, name)), "")
    return F.array_join(F.transform(segments, lambda s: F.concat(name(s), F.lit("*"), s["allele"])), "")


def descriptor(s: Column) -> Column:
    return F.concat(F.lit("["), s["locus"], F.lit(" "), s["seg_type"], s["seg_id"], F.lit("*"), s["allele"], F.lit("]"))


def contains_all(major: Column, minor: Column) -> Column:
    return F.size(F.array_except(minor, major)) == 0
