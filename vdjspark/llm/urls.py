"""Operator 10, URL filters.

Rules for a host, its subdomains and a path prefix decide first, the longest that fits. For other
urls an Aho-Corasick automaton counts terms of a weighted vocabulary: one strict term or several
distinct soft ones block. A term counts only between boundaries, which are the ends of the url and
characters other than ASCII letters and digits.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule, and are
judged by their terms (null: allow). Repeated rows are judged alike, other columns are kept, and
columns named as those added raise a ValueError. An empty table gives no row. The terms are lists
given by the caller; those here are a small example of such a vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INNER = frozenset(LOWER + "0123456789")
STRICT = ("porn", "xxx", "casino", "jackpot", "escort", "viagra", "malware", "warez", "spam-farm", "cheap-pills")
SOFT = ("adult", "bet", "bonus", "cheap", "crack", "dating", "farm", "free", "gambling", "hot", "pills", "poker", "sexy", "slots", "spam", "torrent", "win")
SOFT_HITS = 2


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    """Terms in lower case with their weights; a term that is in both lists is strict."""
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for t in terms:
            found.add_word(t, (t, weight))
    if len(found):
        found.make_automaton()
    return found


def blocked(url: str | None, terms: ahocorasick.Automaton, soft_hits: int) -> bool:
    if not url or not len(terms):
        return False
    url, soft = url.translate(str.maketrans(UPPER, LOWER)), set()
    for end, (term, weight) in terms.iter(url):
        begin = end - len(term) + 1
        if (begin and url[begin - 1] in INNER) or (end + 1 < len(url) and url[end + 1] in INNER):
            continue
        if weight == 2:
            return True
        soft.add(term)
        if len(soft) >= soft_hits:
            return True
    return False


def filter_urls(df: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to the columns of ``df``."""
    if clash := {"host", "path", "rule", "verdict"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    @F.pandas_udf("boolean")
    def by_terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = automaton(strict, soft)
        for urls in batches:
            yield urls.map(lambda u: blocked(u, terms, soft_hits)).astype(bool)

    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    judged = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).withColumn("rule", rule).withColumn("verdict", verdict)
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(by_terms(F.col(url)), "block").otherwise("allow")))


def filter_urls_sql(table: str = "pages", rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> str:
    """The same judgement in DuckDB's SQL."""

    def cases(pick) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{pick(r)}'" for r in sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True))

    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH parts AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS low,
  coalesce({lower.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM {table}),
ruled AS (SELECT *, {cases(lambda r: r.text)} ELSE NULL END AS rule FROM parts)
SELECT page_id, host, path, rule, {cases(lambda r: r.verdict)}
  WHEN {" OR ".join(map(hit, strict))} OR ({" + ".join(f"{hit(t)}::INT" for t in soft)}) >= {soft_hits} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
