"""Operator 4, best-fit packing.

Documents become token ids; those longer than a sequence are cut, the first piece being the
shorter one. Pieces are packed online as they arrive: a fixed number of bins is open, a bitset keyed
by free space finds the bin that a piece fits best, and when a new bin is needed the fullest closes
first. Pieces wait in runs of ``RUN`` and leave each run longest first, so that short ones find gaps;
beyond the open bins and a run nothing is held.

Pieces arrive in the order of the table (of a stored one: by file, then by row), so that sequences
follow a mixture that was written in its order. Ranges of that order, of about ``GROUP`` pieces, are
packed on their own, so that the work grows with executors and no state is shared.

Defined results: a null text is as an empty one, a document of the end-of-text id alone. Rows that
repeat, and those without an id, are documents of their own. Ties between bins of equal free space
go to the one that got that free space last, ties in a run to the first to arrive. Names of special
tokens in a text are ordinary text. Sequence ids are unique but have gaps. An empty table gives no
row. Other columns take no part, whatever their names; a key named as a result raises a ValueError.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from .common import Scratch, arrival, slices

CAPACITY = 2048
OPEN_BINS = 128
RUN = 512  # pieces that are put in order of length
GROUP = 32_768  # pieces that are packed together, about
NEW = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
WORDS = 1_000_000  # words whose ids a worker remembers
#: Texts of these characters are split alike by any version of Unicode's tables.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞₠-€]*")


def _plain(kind: str) -> str:
    """The plain characters of a Unicode category, for a character class."""
    return "".join(c for c in map(chr, range(0x20AD)) if PLAIN.fullmatch(c) and unicodedata.category(c)[0] == kind)


#: The splitting pattern of byte-level BPE vocabularies of this kind, a fixed value, with letters and numbers spelt out.
_L, _N = _plain("L"), _plain("N")
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts by a tokenizer file. Splits common texts into words itself and asks for each word once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split, self.known = re.compile(PATTERN).findall, {}
        # a token of these can't lie inside a word that begins with its only blank
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Ids of new words; those of a blank and letters are encoded as one text, whose tokens tell where each begins."""
        known = self.known
        blank = [w for w in words if w[0] == " " and w[1:].isalpha()]
        rest = [w for w in words if not (w[0] == " " and w[1:].isalpha())]
        for i in range(0, len(blank), 4096):
            part = blank[i : i + 4096]
            ids = self.whole("".join(part))
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                rest += part
                continue
            at, blob = [*(4 * starts).tolist(), 4 * len(ids)], ids.tobytes()
            known.update((w, blob[a:b]) for w, a, b in zip(part, at, at[1:]))
        for w, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            known[w] = np.array(x.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [bool(PLAIN.fullmatch(t)) for t in texts]
        words = [self.split(t) if p else [] for t, p in zip(texts, plain)]
        if len(self.known) > WORDS:
            self.known.clear()
        self._learn(list(set().union(*words).difference(self.known)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), "<u4") if p else self.whole(t) for t, p, w in zip(texts, plain, words)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are full."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


class BestFit:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.bins, self.n_open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _open(self, free: int, bin_id: int) -> None:
        self.bins[free].append(bin_id)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        bin_id = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def add(self, length: int) -> tuple[int, int]:
        """Number of the bin that takes the piece, and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.made
            self.made += 1
            if self.n_open >= self.most and length < free:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        if free > length:
            self._open(free - length, bin_id)
        return bin_id, self.capacity - free


def pieces_of(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, eot: int = 0, ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids) of each piece of each document, and _part, _row: its place in the table."""
    if key.lower() in NEW:
        raise ValueError(f"the key can't be named {key}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in slices(batches, 1024):
            out: list[list] = [[], [], [], [], [], []]
            for row, found in enumerate(enc([t or "" for t in b.column(0).to_pylist()])):
                tokens = np.append(found, np.array([eot], "<u4"))
                for k, (start, n) in enumerate(cut(len(tokens), capacity)):
                    part = tokens[start : start + n]
                    for column, x in zip(out, (row, k, start, n, zlib.crc32(part.tobytes()), part.tolist() if ids else None)):
                        column.append(x)
            at = pa.array(out[0], pa.int64())
            arrays = [b.column(1).take(at), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
            arrays += [pa.array(out[5], pa.list_(pa.int64()))] * ids + [b.column(2).take(at), b.column(3).take(at)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    rows = arrival(df.select(F.col(text).alias("_text"), F.col(key).alias(key)))
    schema = T.StructType([df.schema[key], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    schema = T.StructType([*schema, *[T.StructField("ids", T.ArrayType(T.LongType()))] * ids, T.StructField("_part", T.StringType()), T.StructField("_row", T.LongType())])
    return rows.select("_text", key, "_part", "_row").mapInArrow(encode, schema)


def pack(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, run: int = RUN, group: int = GROUP, eot: int = 0, ids: bool = False) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of all documents; ``ids`` also returns the tokens."""
    pieces = Scratch(df.sparkSession).put(pieces_of(df, tokenizer, text, key, capacity, eot, ids))
    columns = pieces.columns[:-2]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in slices(batches, run):
            length = b.column(columns.index("length")).to_numpy()
            order = np.argsort(-length, kind="stable")
            put = np.array([bins.add(n) for n in length[order].tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(order)) for c in columns), pa.array(base + put[:, 0]), pa.array(put[:, 1])], [*columns, "sequence_id", "offset"])

    places = ["_part", "_row", "piece"]
    dealt = pieces.repartitionByRange(max(1, math.ceil(pieces.count() / group)), *places).sortWithinPartitions(*places)
    return dealt.mapInArrow(place, T.StructType([*pieces.schema.fields[:-2], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
