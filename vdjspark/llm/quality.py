"""Operator 5, quality classifier.

Supervised subword embeddings: words and character trigrams are hashed to rows of a learned
table, a document is the mean of its rows, and a softmax gives the class; numpy stochastic
gradient descent fits it on a bounded sample of the labelled documents.

Defined results: null and empty texts have no feature and score by the bias alone. Labels that
are null take no part; a document with several labels takes their majority, ties as 1. Without a
labelled row every score is 0.5; an empty table gives no row. Repeated rows score alike; clashing column names raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import codes_of, in_chunks, mix32, slices

WORDS = 1 << 16  # buckets of words; as many follow for character trigrams
CHUNK = 1 << 18
SAMPLE = 6000  # most labelled documents that the model is fitted on
DIM, EPOCHS, RATE = 8, 12, 0.5


@dataclass
class QualityModel:
    """Logit that each bucket adds to a mean, the product of its embedding and the output layer; bias."""

    gain: np.ndarray
    bias: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and character trigrams of the texts, and the number of the text of each."""
    codes, offsets = codes_of(texts)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    c = codes.astype(np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | (c == 0x3000)
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    place = np.arange(len(c), dtype=np.uint32)
    if len(starts):
        word = np.cumsum(~space & before) - 1
        place = place - starts[np.maximum(word, 0)].astype(np.uint32)
    mixed = mix32(c * np.uint32(0x9E3779B1) + place * np.uint32(0x85EBCA77))
    mixed[space] = 0
    words = np.add.reduceat(mixed, starts, dtype=np.uint32) if len(starts) else np.zeros(0, np.uint32)
    words = mix32(words) >> np.uint32(16)
    c = np.where(space, np.uint32(32), c)
    h = c[:-2] * np.uint32(0xC2B2AE3D) + c[1:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    h = (mix32(h) >> np.uint32(16)) + np.uint32(WORDS)
    at = np.concatenate([starts, np.arange(len(h))])
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = np.concatenate([np.ones(len(starts), bool), np.arange(len(h)) + 3 < offsets[doc[len(starts) :] + 1]])
    return np.concatenate([words, h])[inside], doc[inside]


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> QualityModel:
    """Fit on (buckets, counts, label) of each document, in the order given but for a seeded shuffle."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (2 * WORDS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    samples = [(b, n / n.sum(), y) for b, n, y in samples if len(b)]
    steps, done = max(1, EPOCHS * len(samples)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            b, w, y = samples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = table[b]
            mean = w @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * g
            table[b] = rows - rate * len(b) ** 0.5 * np.outer(w, back)
    return QualityModel((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train_quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on the labelled documents that come first by a hash of their id, ``sample`` at most, whole texts.

    docs: doc_id, text; labels: doc_id, quality. Executors turn texts into bucket counts, which
    are bounded by the number of buckets whatever the length of a text.
    """
    chosen = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, ys, found = b.column(0).to_pylist(), b.column(2).to_pylist(), []
            for t in b.column(1).to_pylist():
                bucket, _ = features([t])
                found.append(np.unique(bucket, return_counts=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), b.column(3), pa.array([x.tolist() for x, _ in found], pa.list_(pa.int32())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int32()))], ["doc_id", "quality", "hash", "bucket", "n"]
            )

    rows = (
        docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "text", "quality", F.xxhash64("text").alias("hash"))
        .mapInArrow(count, "doc_id long, quality int, hash long, bucket array<int>, n array<int>")
    )
    got = sorted({(r["doc_id"], r["hash"]): r for r in rows.toLocalIterator()}.items())  # texts of one id are documents of their own
    return fit([(np.array(r["bucket"], np.int64), np.array(r["n"], np.float64), r["quality"]) for _, r in got])


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (of label 1, 0 to 1) and ``predicted`` to the columns in ``keep`` (all if None)."""
    keep = df.columns if keep is None else keep
    if clash := {"score", "predicted"} & {c.lower() for c in keep}:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column(0).to_pylist()]
            mean = np.zeros(len(texts))
            for i, j in in_chunks(texts, CHUNK):
                bucket, doc = features(texts[i:j])
                mean[i:j] = np.bincount(doc, model.gain[bucket], j - i) / np.maximum(1, np.bincount(doc, minlength=j - i))
            score = 1 / (1 + np.exp(-np.clip(mean + model.bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names[1:], "score", "predicted"])

    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(judge, T.StructType([*df.select(*keep).schema.fields, *new]))
