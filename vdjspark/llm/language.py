"""Operator 1, language identification.

Script ranges narrow each word's candidate languages; learned letter-trigram scores rate the word
in each of them; Viterbi with a switching penalty labels the words, so mixed texts fall into spans.

Defined results: a null text or one without a letter is ``und`` with score 0 and no span. Ties go
to the language that sorts first. Words in a script that no learned language uses are neutral.
Repeated rows are judged alike; further columns are carried along, and a clash with an output
name raises a ValueError before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import codes_of, in_chunks, mix32, scripts, slices

BUCKETS = 1 << 16
CHUNK = 1 << 18  # characters whose arrays are in memory at once
PENALTY = 12.0
FAR = -1e3  # a word's score in a language that doesn't use its script
SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


@dataclass
class LanguageModel:
    """langs, sorted; log-probabilities by language and trigram bucket; languages by script."""

    langs: list[str]
    logp: np.ndarray
    uses: np.ndarray


def _grams(codes: np.ndarray):
    """Script, starts and ends of the words; word starts among the features; trigram buckets."""
    table, _ = scripts()
    script = table[np.minimum(codes, len(table) - 1)]
    letter = script > 0
    before = np.concatenate([[False], letter[:-1]])
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(~letter & before)
    at = np.flatnonzero(letter | before)
    c = np.where(letter, codes, 0).astype(np.uint32)
    p1 = np.concatenate([c[:1] * 0, c[:-1]])
    p2 = np.concatenate([c[:1] * 0, p1[:-1]])
    p2[p1 == 0] = 0
    h = c[at] * np.uint32(0x9E3779B1) + p1[at] * np.uint32(0x85EBCA77) + p2[at] * np.uint32(0xC2B2AE3D)
    h = mix32(h) >> np.uint32(16)
    return script[starts], starts, ends, np.searchsorted(at, starts), h


def train_language_model(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Count letter trigrams by language over all rows; what reaches the driver is bounded by languages times buckets."""
    n_scripts = len(scripts()[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            by: dict[str, list[str]] = {}
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(t.lower())
            for k, texts in by.items():
                total = sums.setdefault(k, np.zeros(BUCKETS + n_scripts, np.int64))
                for i, j in in_chunks(texts, CHUNK):
                    script, starts, ends, _, h = _grams(codes_of(texts[i:j])[0])
                    total[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script, ends - starts, n_scripts).astype(np.int64)
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = (
        df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
        .mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    )
    langs = sorted({r["lang"] for r in rows})
    seen = np.zeros((len(langs), BUCKETS + n_scripts))
    for r in rows:
        seen[langs.index(r["lang"]), r["bucket"]] = r["n"]
    grams, share = seen[:, :BUCKETS] + 0.5, seen[:, BUCKETS:]
    logp = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
    uses = share > 0.01 * np.maximum(1, share.sum(1, keepdims=True))
    return LanguageModel(langs, logp, uses)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of the best path over words (rows), where each change of label costs ``penalty``."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), np.int32)
    own = np.arange(k, dtype=np.int32)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - penalty
        back[i] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - penalty) + scores[i]
    path = np.empty(n, np.int32)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label_words(scores: np.ndarray, penalty: float) -> np.ndarray:
    """As ``viterbi``; a single label is returned at once where no interval can pay for a change.

    If no interval of words gains more than half the penalty over the best single label, each
    stretch of other labels costs at least what it gains, so the single label is a best path.
    """
    total = scores.sum(0)
    top = int(total.argmax())
    ahead = np.cumsum(scores - scores[:, top : top + 1], 0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, ahead.shape[1])), ahead]), 0)[:-1]
    if (ahead - low).max() <= penalty / 2:
        return np.full(len(scores), top, np.int32)
    return viterbi(scores, penalty)


def _judge(model: LanguageModel, texts: list[str | None], penalty: float, spans: bool):
    out = [("und", 0.0, [])] * len(texts)
    real = [i for i, t in enumerate(texts) if t] if model.langs else []
    # lower-casing may lengthen a text; then spans are given in the lower-cased text
    lowered = [texts[i].lower() for i in real]
    for a, b in in_chunks(lowered, CHUNK):
        codes, offsets = codes_of(lowered[a:b])
        script, starts, ends, first, h = _grams(codes)
        if not len(starts):
            continue
        may = model.uses[:, script]
        score = np.stack([np.add.reduceat(lp[h].astype(np.float64), first) for lp in model.logp])
        score -= score.max(0)
        score = np.where(may, score, FAR) * may.any(0)
        score = (score - score.max(0)).T
        edges = np.searchsorted(starts, offsets)
        letters = ends - starts
        for k in range(b - a):
            i, j = edges[k], edges[k + 1]
            if i == j:
                continue
            w = score[i:j]
            path = label_words(w, penalty)
            total = w.sum(0)
            by = np.bincount(path, letters[i:j], len(model.langs))
            lang = int(by.argmax())
            sure = 1 / np.exp(np.clip(total - total[lang], -700, 700)).sum()
            found = []
            if spans:
                cut = np.flatnonzero(np.diff(path)) + 1
                for x, y in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(path)]])):
                    found.append({"lang": model.langs[path[x]], "start": int(starts[i + x] - offsets[k]), "end": int(ends[i + y - 1] - offsets[k])})
            share = by[lang] / by.sum()
            out[real[a + k]] = (model.langs[lang], float(share * (sure if share == 1 else 1)), found)
    return out


def identify_languages(df: DataFrame, model: LanguageModel, text: str = "text", penalty: float = PENALTY, spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and, if asked, ``lang_spans`` to the columns in ``keep`` (all if None).

    The score is the share of letters in the label's spans; of a text in one language it is the
    posterior of that language. Span bounds count characters of the lower-cased text.
    """
    keep = df.columns if keep is None else keep
    if clash := {"lang_pred", "score", "lang_spans"} & {c.lower() for c in keep}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    new += [T.StructField("lang_spans", T.ArrayType(SPAN))] * spans
    source = df.select(F.col(text).alias("_text"), *keep)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = _judge(model, b.column(0).to_pylist(), penalty, spans)
            arrays = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                arrays.append(pa.array([x[2] for x in found], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *arrays], [*b.schema.names[1:], "lang_pred", "score", "lang_spans"][: len(keep) + len(arrays)])

    return source.mapInArrow(judge, T.StructType([*df.select(*keep).schema.fields, *new]))
