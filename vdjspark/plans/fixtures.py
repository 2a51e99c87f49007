"""Synthetic receptors out of ``lineitem``, as SQL that Spark and DuckDB both run.

All rows become reads: 96 bases of one of 24 V segments, the conserved cysteine, a core of 8 codons
that the clone decides, the conserved phenylalanine, and 32 bases of one of 8 J segments, after a
barcode of 10. Some have a substitution, a barcode error, an N, low qualities, or end early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CODONS = "GCTCGTAATGATTGTCAAGAAGGTCATATTCTTAAAATGTTTCCTTCT"  # by hex digit, none a stop


def nt(x: str) -> str:
    """32 bases from the MD5 of a text expression."""
    return f"translate(md5({x}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def mapped(n: str, expr: str, duck: bool) -> str:
    """An array of ``expr`` over i from 1 to n."""
    return f"list_transform(range(1, {n} + 1), lambda i: {expr})" if duck else f"transform(sequence(1, {n}), i -> {expr})"


def _v(v: str) -> str:
    return " || ".join(nt(f"'v' || {text(v)} || '{k}'") for k in "abc") + " || 'TGT'"


def _j(j: str) -> str:
    return f"'TTT' || {nt(f"'j' || {text(j)}")}"


def _flipped(s: str, p: str) -> str:
    return f"substr({s}, 1, {p} - 1) || translate(substr({s}, {p}, 1), 'ACGT', 'CGTA') || substr({s}, {p} + 1)"


ROWS = 1 << 17  # of lineitem, whose reads one task makes
BASE = ["l_orderkey AS ok", "CAST(l_linenumber AS BIGINT) AS ln", "least(l_orderkey % 50, l_suppkey % 30) AS cl"]
ID = f"'r' || {text('ok')} || '_' || {text('ln')}"
HASH = f"md5('c' || {text('cl')})"
PLACES = ["CAST(1 + (13 * ln + ok) % 158 AS INT) AS p", "CAST(1 + ok % 10 AS INT) AS bp"]
MARKED = [
    f"CASE WHEN ok % 11 = 0 THEN {_flipped('s', 'p')} ELSE s END AS s",
    f"CASE WHEN ok % 89 = 0 THEN 'N' || substr(b, 2) WHEN ok % 13 = 0 THEN {_flipped('b', 'bp')} ELSE b END AS b",
]
READ = "b || CASE WHEN ok % 97 = 0 THEN substr(s, 1, 60) ELSE s END AS seq"
LONGEST = 168


def _whole() -> str:
    codons = " || ".join(f"substr('{CODONS}', CAST(3 * instr('0123456789abcdef', substr(h, {k}, 1)) - 2 AS INT), 3)" for k in range(1, 9))
    return f"{_v('cl % 24')} || {codons} || {_j('cl % 8')}"


def _barcode(k: str) -> str:
    return f"substr({nt(f"'b' || {text(k)}")}, 1, 10)"


def _quality(low: str, first: str, level: str, line: str) -> str:
    return f"CAST(CASE WHEN {low} THEN 22 WHEN {first} AND i = 1 THEN 12 ELSE 33 + {level} - (i * {line}) % 3 END AS INT)"


QUALITY = ("ok % 17 = 0", "ok % 53 = 0", "(ok * 7 + ln * 3) % 8", "ln")


def reads(duck: bool) -> str:
    """CTEs that end in ``reads`` (id, ok, ln, seq, qual)."""
    return f"""
base AS (SELECT {', '.join(BASE)} FROM lineitem),
clones AS (SELECT ok, ln, cl, {HASH} AS h FROM base),
whole AS (SELECT ok, ln, {_whole()} AS s, {_barcode('ok % 200')} AS b,
  {', '.join(PLACES)} FROM clones),
marked AS (SELECT ok, ln, {f",{chr(10)}  ".join(MARKED)} FROM whole),
reads AS (SELECT {ID} AS id, ok, ln, seq, {mapped('CAST(length(seq) AS INT)', _quality(*QUALITY), duck)} AS qual
  FROM (SELECT ok, ln, {READ} FROM marked) t)"""


def dealt_reads(lineitem: DataFrame) -> DataFrame:
    """The rows of ``reads``, dealt by id, so that what is asked of each id needs no other shuffle.

    Bases and qualities follow from remainders of the keys, so they are worked out once for each remainder and looked up.
    """
    spark = lineitem.sparkSession
    numbers = lambda low, high, name: spark.range(low, high, 1, 1).withColumnRenamed("id", name)
    wholes = numbers(-49, 50, "cl").selectExpr("cl", f"{HASH} AS h").selectExpr("cl", f"{_whole()} AS s")
    barcodes = numbers(-199, 200, "b_key").selectExpr("b_key", f"{_barcode('b_key')} AS b")
    levels = numbers(-7, 8, "level").crossJoin(numbers(-2, 3, "line")).crossJoin(numbers(0, 2, "first")).selectExpr("level * 10 + line + 200 * first AS q_key", "level", "line", "first = 1 AS first", "false AS low")
    levels = levels.unionByName(spark.range(0, 1, 1, 1).selectExpr("1000L AS q_key", "0L AS level", "0L AS line", "false AS first", "true AS low"))
    levels = levels.selectExpr("q_key", f"{mapped(str(LONGEST), _quality('low', 'first', 'level', 'line'), False)} AS q")
    low, first, level, line = QUALITY
    # the ids of an input of few files are dealt over all cores, those of a large one over tasks of like size
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-lineitem.count() // ROWS))
    out = lineitem.selectExpr(*BASE).selectExpr(f"{ID} AS id", "ok", "ln", "cl").repartition(tasks, "id")
    out = out.selectExpr("*", "ok % 200 AS b_key", f"CASE WHEN {low} THEN 1000L ELSE {level} * 10 + {line} % 3 + CASE WHEN {first} THEN 200 ELSE 0 END END AS q_key", *PLACES)
    for table, key in ((wholes, "cl"), (barcodes, "b_key"), (levels, "q_key")):
        out = out.join(F.broadcast(table), key, "left")
    out = out.selectExpr("id", "ok", "ln", "q", *MARKED).selectExpr("id", "ok", "ln", "q", READ)
    n = "CAST(length(seq) AS INT)"
    # where a key is null, there's nothing to look up
    qual = f"coalesce(CASE WHEN {n} = {LONGEST} THEN q ELSE slice(q, 1, {n}) END, {mapped(n, _quality(*QUALITY), False)}) AS qual"
    # rows of a generator are as those of a scan: else the optimizer would copy the recipe into each filter
    read = out.selectExpr("id", "inline(array(struct(ok, ln, seq, q)))").selectExpr("id", "ok", "ln", "seq", qual)
    return read.select("id", F.inline(F.array(F.struct("ok", "ln", "seq", "qual"))))


def segments(duck: bool = False) -> str:
    """CTEs that end in ``segments`` (seg_idx, locus, seg_type, seg_id, allele, motif_pos, seq)."""
    return f"""
vs AS (SELECT DISTINCT CAST(l_orderkey % 24 AS INT) AS v FROM lineitem), js AS (SELECT DISTINCT CAST(l_orderkey % 8 AS INT) AS j FROM lineitem),
segments AS (
  SELECT v AS seg_idx, 'SYN' AS locus, 'V' AS seg_type, {text('v + 1')} AS seg_id, '01' AS allele, 96 AS motif_pos, {_v('v')} AS seq FROM vs
  UNION ALL SELECT v + 100, 'SYN', 'V', {text('v + 1')}, '02', 96, {_flipped(f"({_v('v')})", '50')} FROM vs WHERE v IN (0, 5, 10, 15, 20)
  UNION ALL SELECT j + 200, 'SYN', 'J', {text('j + 1')}, '01', 6, 'GCTTCT' || {_j('j')} FROM js)"""


def toy_clones(duck: bool) -> str:
    """CTEs that end in ``toys`` (v_ids, cdr3, j_ids, count): clonotypes with several segments."""
    array = (lambda *x: f"list_sort(list_distinct([{', '.join(x)}]))") if duck else (lambda *x: f"array_sort(array_distinct(array({', '.join(x)})))")
    return f"""
toys AS (SELECT {array('a', 'b')} AS v_ids, cdr3, {array('j')} AS j_ids, count(*) AS count FROM (SELECT CAST(l_orderkey % 4 AS INT) AS a, CAST(l_suppkey % 5 AS INT) AS b,
  CAST(l_linenumber % 2 AS INT) AS j, substr({nt(f"'t' || {text('l_partkey % 40')}")}, 1, 12) AS cdr3 FROM lineitem) t GROUP BY 1, 2, 3)"""
