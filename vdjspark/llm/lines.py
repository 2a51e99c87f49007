"""Operator 9, fuzzy line dedup.

Lines are normalised to words of lower-case letters, marks and digits. Equal lines collapse first.
Each different one has a SimHash of its words. Lines meet on pigeonhole blocks of that hash: two
within ``BITS`` agree on all but ``BITS`` of its blocks. As most pairs of edit similarity 0.8 are
farther apart than any radius that blocks can serve, lines also meet on bands of minhashes: of
their pairs of neighbouring words, and lines of up to ``SHORT`` letters on those of their character
6-grams. Lines of up to ``TINY`` letters meet on what is left when characters are deleted, which
misses none of their pairs. Of lines that meet, those whose SimHash differs in more than ``NEAR`` of
32 bits part again. The others are verified: a pair is a link if its edit similarity, 1 - distance /
longer length, is at least ``similarity``. Of each connected group the occurrence in the smallest
document, then line, stays.

Keys are packed in blobs, a few for each task, and sorted in numpy where they meet. Up to ``most``
lines that meet on a key are compared with each other; of more, each with the one in the middle of
their hashes and with those next to it in two orders of the hash, so that pairs grow with the lines.
Lines too far from the middle have a middle one of their own, and so on until none is left. Then
all that meet and that links leave in different groups are compared, the nearest first, in a task
that has their set, so that no link is lost in a large set and no row is made of a pair.

Defined results: lines without a letter or digit are never removed, nor is a null text touched.
Texts whose lines all go become empty. Rows that repeat id and text are one document and keep the
same lines. A null id sorts before all others. An empty table gives none. Other columns are kept;
columns named as those added or used meanwhile raise a ValueError.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import LETTER_LIMIT, Scratch, codes_of, free_of, in_chunks, majority, mix64, odd, skewed_join, slices
from .graph import connected_components, joined
from .meet import apart, meetings, members, packed, pairs_of, sets_of

BITS, BLOCKS, SIMILARITY, MOST = 2, 4, 0.8, 8
WORD_ROWS, WORD_BANDS = 3, 8  # minhashes in a band and bands, of neighbouring words
GRAM, GRAM_ROWS, GRAM_BANDS = 6, 4, 24  # letters of a gram, minhashes in a band and bands, of grams
TINY, LONG, SHORT = 14, 48, 80  # most letters of lines that meet by deletions; least for words; below this, by grams
NEAR = 9  # most bits in which the lower halves of the SimHashes differ
CHUNK = 1 << 19
FLUSH = 1 << 19  # keys that a task gathers before it packs them
TOGETHER = 4096  # pairs whose distances are asked together
COUNTED = 512  # pairs whose letters are counted at once
PART = 4096  # lines of a large set that a task compares with as many others
FEW, TABLE = 32, 1 << 18  # least pairs whose distances are worked out side by side; words of each letter's places then, at 64 letters a fourth of the most
PLACES = 1 << 27  # bits of the map that tells which lines are wanted


@lru_cache(maxsize=1)
def _inner() -> np.ndarray:
    """Which code points are letters, marks or digits."""
    return np.array([unicodedata.category(chr(i))[0] in "LMN" for i in range(LETTER_LIMIT)])


class _Letters(dict):
    """Code points of letters, marks and digits as they are, others as blanks."""

    def __missing__(self, c: int) -> int:
        self[c] = c if c < LETTER_LIMIT and _inner()[c] else 32
        return self[c]


_letters = _Letters()


@lru_cache(maxsize=1)
def _blanked() -> bytes:
    """The first 256 code points, those that aren't letters, marks or digits as blanks."""
    return bytes(i if x else 32 for i, x in enumerate(_inner()[:256]))


def normalise(line: str) -> str:
    """Words of lower-case letters, marks and digits, one blank between them."""
    line = line.lower()
    try:
        return b" ".join(line.encode("latin-1").translate(_blanked()).split()).decode("latin-1")
    except UnicodeEncodeError:
        return " ".join(line.translate(_letters).split())


def _mix32(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def _bands(h: np.ndarray, opens: np.ndarray, rows: int, bands: int, kind: int) -> np.ndarray:
    """Keys of the bands of minhashes of each run of ``h``; opens: where runs begin."""
    out = np.zeros((len(opens), bands), np.uint64)
    seeds = (odd(rows * bands, 0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32).reshape(bands, rows)
    for k in range(bands):
        key = np.full(len(opens), (kind << 8) + k, np.uint64)
        for seed in seeds[k]:
            y = h ^ seed
            y *= np.uint32(0x9E3779B1)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x85EBCA77)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, opens))
        out[:, k] = key
    return out


def word_bands(words: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Keys by pairs of neighbouring words, with nothing before the first and after the last; words: hashes, by line."""
    ends = np.append(opens[1:], len(words))
    padded = np.concatenate([np.zeros(1, np.uint64), np.insert(words, ends, np.uint64(0))])
    pairs = mix64(padded[:-1] * np.uint64(0x9E3779B97F4A7C15) + padded[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return _bands((pairs >> np.uint64(32)).astype(np.uint32), opens + np.arange(len(opens)), WORD_ROWS, WORD_BANDS, 1)


def gram_bands(codes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Keys by grams of letters; codes: of the lines, each with a blank before every word; opens: where lines begin."""
    size = np.diff(np.append(opens, len(codes)))
    begin = opens + (GRAM - 1) * np.arange(len(opens))  # blanks follow each line, so that grams don't reach into the next
    padded = np.full(len(codes) + (GRAM - 1) * len(opens), 32, np.uint32)
    real = np.zeros(len(padded), bool)
    at = np.arange(len(codes)) + np.repeat(begin - opens, size)
    padded[at], real[at] = codes, True
    letters = np.append(_mix32(padded + np.uint32(1)), np.zeros(GRAM, np.uint32))
    h = np.zeros(len(padded), np.uint32)
    for j, times in enumerate((odd(GRAM, 0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)):
        h += letters[j : j + len(h)] * times
    return _bands(_mix32(h)[real], opens, GRAM_ROWS, GRAM_BANDS, 2)


def hash_blocks(sim: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """Keys of a SimHash, one for each choice of the blocks that agree if at most ``bits`` bits differ."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen) for chosen in combinations(range(blocks), blocks - bits)]
    return np.stack([mix64((sim & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((3 << 8) + k)) for k, m in enumerate(masks)], 1)


def _left(line: str, similarity: float) -> set[str]:
    """What deletions leave of a short line, as many as a pair of short lines with it may differ by."""
    allowed = lambda n: math.floor((1 - similarity) * n + 1e-9)
    deep = max(allowed(n) for n in range(len(line), TINY + 1) if n - allowed(n) <= len(line))
    out = now = {line}
    for _ in range(min(deep, len(line))):
        now = {x[:i] + x[i + 1 :] for x in now for i in range(len(x))}
        out = out | now
    return out


def line_keys(one: np.ndarray, sim: np.ndarray, words: np.ndarray, word_opens: np.ndarray, codes: np.ndarray, opens: np.ndarray, similarity: float, bits: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that different lines meet on, the line's key ``one``, and the lower half of its SimHash (zero for short ones, which it doesn't part)."""
    _, pick = np.unique(one, return_index=True)
    size = np.diff(np.append(opens, len(codes))) - 1  # less the blank before the first word
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(keys: np.ndarray, at: np.ndarray, low: np.ndarray | None = None) -> None:
        n = keys.shape[1]
        out.append((keys.ravel(), np.repeat(one[at], n), np.repeat(np.zeros(len(at), np.uint32) if low is None else low, n)))

    if len(at := pick[size[pick] >= LONG]):
        part, begins = _parts(words, word_opens, at)
        low = (sim[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        add(np.hstack([word_bands(part, begins), hash_blocks(sim[at], bits, blocks)]), at, low)
    if len(at := pick[(size[pick] < SHORT) & (size[pick] > GRAM)]):
        add(gram_bands(*_parts(codes, opens, at)), at)
    for i in pick[size[pick] <= TINY].tolist():
        line = codes[opens[i] + 1 : opens[i] + 1 + size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        add(np.array([[xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in _left(line, similarity)]], np.uint64), np.array([i]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, t in enumerate((np.uint64, np.uint64, np.uint32)))


def _parts(values: np.ndarray, opens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of the values, one after the other, and where they begin."""
    size = np.diff(np.append(opens, len(values)))[at]
    begins = np.cumsum(size) - size
    return values[np.repeat(opens[at] - begins, size) + np.arange(size.sum())], begins


def line_hashes(texts: list[str]) -> tuple[np.ndarray, ...]:
    """For each line with a word: text's number, line's number there, two keys of its words in order, SimHash."""
    return _hashes(texts)[:5]


@lru_cache(maxsize=1)
def _inner_bytes() -> bytes:
    return _inner()[:256].tobytes()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``codes_of`` returns, codes of texts that have none above 255 as bytes, and which codes are letters, marks or digits."""
    joined = "\n".join(texts) + "\n" if texts else ""
    try:
        raw = joined.encode("latin-1")
    except UnicodeEncodeError:
        codes, offsets = codes_of(texts)
        table = _inner()
        return codes, offsets, table[np.minimum(codes, len(table) - 1)] & (codes < len(table))
    offsets = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.frombuffer(raw, np.uint8), np.append(0, offsets), np.frombuffer(bytearray(raw.translate(_inner_bytes())), bool)


def _hashes(texts: list[str]) -> tuple[np.ndarray, ...]:
    """What ``line_hashes`` returns, the normalised lines' codes with a blank before every word and where lines begin there, their words' hashes and where lines begin there."""
    codes, offsets, inner = _codes([t.lower() for t in texts])
    head = inner.copy()
    head[1:] &= ~inner[:-1]
    starts = np.flatnonzero(head)
    if not len(starts):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int32, np.uint64, np.uint64, np.uint64, np.uint32, np.int64, np.uint64, np.int64))
    # each word with what is before it, which becomes the blank; the last code is a line end, so all words end
    whole = inner.copy()
    whole[:-1] |= head[1:]
    spaced = codes[whole] if not head[0] else np.concatenate([codes[:1], codes[whole]])
    inner[:-1] &= ~inner[1:]
    size = np.flatnonzero(inner) + 2 - starts
    begins = np.cumsum(size) - size
    spaced[begins] = 32
    place = np.ones(len(spaced), np.int32)
    place[begins[1:]] -= size[:-1].astype(np.int32)
    place[0] = 0
    letters = np.append(np.uint64(0), odd(int(size.max()) - 1, 0x9E3779B97F4A7C15))[np.cumsum(place)]
    letters *= spaced
    words = mix64(np.add.reduceat(letters, begins))
    breaks = np.flatnonzero(codes == 10)
    line = np.searchsorted(breaks, starts)
    new = np.concatenate([[True], line[1:] != line[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(words)))
    order = np.arange(len(words)) - np.repeat(first, count)
    one, two = (mix64(np.add.reduceat(words * odd(int(count.max()), seed)[order], first)) for seed in (0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D))
    # each different word of a line counts once, else the commonest words decide; half of a word's bits tell words apart
    different = (np.cumsum(new).astype(np.uint64) << np.uint64(32)) | (words >> np.uint64(32))
    different.sort()
    different = different[np.concatenate([[True], different[1:] != different[:-1]])]
    runs = different >> np.uint64(32)
    opens = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    sim = majority(mix64((different & np.uint64(0xFFFFFFFF)) * np.uint64(0xABC98388FB8FAC03)), opens)
    line, begins = line[first], begins[first]
    doc = np.searchsorted(offsets, starts[first], "right") - 1
    own = line - np.searchsorted(breaks, offsets[doc])
    return doc, own.astype(np.int32), one, two, sim, spaced, begins, words, first


def _occurrences(docs: DataFrame, similarity: float, bits: int, blocks: int, shards: int) -> DataFrame:
    """row, doc_id, line_no, k1, k2 of each line with a word, and rows of shard and keys, a blob of keys that lines meet on."""
    names = ["row", "doc_id", "line_no", "k1", "k2", "shard", "keys"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, nulls = [], 0, []
        for b in slices(batches):
            nulls = [pa.int64(), b.column(2).type, pa.int32(), pa.int64(), pa.int64()]
            texts = b.column(0).to_pylist()
            for i, j in in_chunks(texts, CHUNK):
                doc, line, one, two, sim, codes, opens, words, word_opens = _hashes(texts[i:j])
                if not len(doc):
                    continue
                found.append(line_keys(one, sim, words, word_opens, codes, opens, similarity, bits, blocks))
                n += len(found[-1][0])
                if n >= FLUSH:
                    yield packed(found, shards, names, nulls)
                    found, n = [], 0
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(line), *(pa.array(x.view(np.int64)) for x in (one, two)), pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary())], names)
        if n:
            yield packed(found, shards, names, nulls)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text is not null").select("text", "row", "doc_id").mapInArrow(work, f"row long, doc_id {kind}, line_no int, k1 long, k2 long, shard int, keys binary")


def _place(row: str, line: str) -> Column:
    """A line's bit in the map of wanted lines."""
    return (F.col(row).bitwiseAND(F.lit(PLACES - 1)) + F.col(line).cast("long") * 2654435).bitwiseAND(F.lit(PLACES - 1))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, line: normalised texts of the wanted (k1, row, line_no).

    A map of ``PLACES`` bits, whatever the number of lines, goes to all tasks; they return the lines
    whose bit is set, so that no whole text is shuffled, and a join takes the wanted ones of these.
    """
    at = _place("row", "line_no") + 1
    found = wanted.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    marks = np.zeros(PLACES // 8, np.uint8)
    for r in found:
        begin = (r["k"] - 1) * 4096
        marks[begin : begin + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for b in slices(batches):
            texts, rows = b.column(1), b.column(0).to_numpy()
            n = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False).astype(np.int64) + 1
            doc = np.repeat(np.arange(len(texts)), n)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            place = ((rows[doc] & (PLACES - 1)) + line * 2654435) & (PLACES - 1)
            hit = np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            out, last, lines = [], -1, []
            for d, k in zip(doc[hit].tolist(), line[hit].tolist()):
                if d != last:
                    last, lines = d, texts[d].as_py().split("\n")
                out.append(normalise(lines[k]))
            yield pa.RecordBatch.from_arrays([pa.array(rows[doc[hit]]), pa.array(line[hit].astype(np.int32)), pa.array(out, pa.string())], ["row", "line_no", "line"])

    lines = docs.where("text is not null").select("row", "text").mapInArrow(work, "row long, line_no int, line string")
    return lines.join(wanted, ["row", "line_no"]).select("k1", "line").dropDuplicates(["k1"])


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a column of the distances' table at a time, as bits of whole numbers.

    Spark's own function walks both texts for each character, whatever distance is allowed.
    """
    known, a, b = _plain(a, b, most)
    if known is not None:
        return known
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    places = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(a) & set(b)}
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)  # where a row's distance is one more, or one less, than that of the row above
    for rest, c in zip(range(len(b) - 1, -1, -1), b):
        same = places.get(c, 0)
        free = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(free | up)), up & free
        if more & last:
            distance += 1
        elif less & last:
            distance -= 1
        if distance - rest > most:
            return False
        if distance + rest <= most:
            return True
        more, less = (more << 1 | 1) & full, less << 1 & full
        free = same | down
        up, down = less | (full & ~(free | more)), more & free
    return distance <= most


def _plain(a: str, b: str, most: int) -> tuple[bool | None, str, str]:
    """Whether the edit distance is at most ``most``, if that is plain (else None), and the texts without their common ends."""
    if abs(len(a) - len(b)) > most:
        return False, a, b
    begin = _alike(a, b)
    a, b = a[begin:], b[begin:]
    end = _alike(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if max(len(a), len(b)) <= most:
        return True, a, b
    if not a or not b:
        return False, a, b
    return (True if _by_words(a.split(" "), b.split(" "), most) else None), a, b


def at_least(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair a distance that the edit distance isn't below, by how often letters and pairs of neighbours occur.

    An edit takes one letter away and brings one at most, and two neighbours of each; letters that share a counter only make the bound lower.
    """
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), COUNTED):
        some = [x[i : i + COUNTED] for x in (a, b)]
        n = len(some[0])
        counts, pairs = np.zeros((2, n * 64), np.int32), np.zeros((2, n * 256), np.int32)
        for k, texts in enumerate(some):
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
            of = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in texts])
            counts[k] = np.bincount((of << 6) + (codes & 63).astype(np.int32), minlength=n * 64)
            inner = of[1:] == of[:-1]
            pairs[k] = np.bincount(((of[1:] << 8) + ((codes[:-1] * 37 + codes[1:]) & 255).astype(np.int32))[inner], minlength=n * 256)
        more = (counts[0] - counts[1]).reshape(n, 64)
        apart = np.abs((pairs[0] - pairs[1]).reshape(n, 256)).sum(1)
        out[i : i + n] = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
        np.maximum(out[i : i + n], -(-apart // 4), out=out[i : i + n])
    return out


def screened(a: list[str], b: list[str], most: list[int]) -> tuple[np.ndarray, list[tuple]]:
    """``within`` of the pairs for which letters or words tell, and for each other its longer length, place, texts without their common ends, most."""
    out, open_ = np.zeros(len(a), bool), []
    for i in np.flatnonzero(at_least(a, b) <= np.array(most, np.int64)).tolist():
        x, y, m = a[i], b[i], most[i]
        known, x, y = _plain(x, y, m)
        if known is None:
            open_.append((max(len(x), len(y)), i, x, y, m))
        else:
            out[i] = known
    return out, open_


def aligned(open_: list[tuple]) -> list[int]:
    """Places of the pairs within their distance, worked out side by side in groups of like length; takes all pairs out of the list."""
    open_.sort(key=lambda p: p[:2])
    out: list[int] = []
    while open_:
        longest, n = open_[-1][0], 1
        room = TABLE // (longest // 64 + 2) // 64
        while n < min(len(open_), room) and open_[-n - 1][0] * (5 if n >= FEW else 8) >= longest * 4 - 64:
            n += 1
        part = open_[-n:]
        del open_[-n:]
        near = [within(*p[2:]) for p in part] if n < FEW else _side_by_side([p[2] for p in part], [p[3] for p in part], np.array([p[4] for p in part])).tolist()
        out += [p[1] for p, x in zip(part, near) if x]
    return out


def all_within(a: list[str], b: list[str], most: list[int]) -> np.ndarray:
    """``within`` of many pairs."""
    out, open_ = screened(a, b, most)
    out[aligned(open_)] = True
    return out


def _side_by_side(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's distance is at most ``most``, columns of all tables at once, as bits of words of 64 rows.

    The pairs get the same ending each until all ``b`` are equally long, which leaves distances as
    they are. Word w is at column t - w in step t, so that a step needs only what the one before it
    handed on. Words outside the band of the largest ``most`` are left out: what enters there is one more.
    """
    n = np.array([len(y) for y in b])
    steps = int(n.max())
    size = np.array([len(x) for x in a]) + steps - n
    wide, pairs = int(-(-size.max() // 64)), len(a)
    codes = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), "<u4") for x in (a, b)]
    seen = np.zeros(max(int(c.max()) for c in codes) + 1, bool)
    for c in codes:
        seen[c] = True
    rank = np.cumsum(seen)  # from 1; zero is the ending
    letters = int(rank[-1]) + 1

    def table(c: np.ndarray, own: np.ndarray, height: int) -> np.ndarray:
        out = np.zeros((height, pairs), np.int64)
        of = np.repeat(np.arange(pairs), own)
        out[np.arange(len(c)) - np.repeat(np.cumsum(own) - own, own), of] = rank[c]
        return out

    if letters * wide * pairs > 4 * TABLE:  # many different letters
        return np.array([within(x, y, m) for x, y, m in zip(a, b, most.tolist())])
    rows = table(codes[0], size - (steps - n), 64 * wide)
    same = np.zeros(letters * wide * pairs, np.uint64)
    i, p = np.nonzero(np.arange(64 * wide)[:, None] < size)
    np.add.at(same, (rows[i, p] * wide + i // 64) * pairs + p, np.uint64(1) << (i % 64).astype(np.uint64))
    column = table(codes[1], n, steps) * (wide * pairs)
    place = np.arange(wide * pairs).reshape(wide, pairs)
    up, down = np.full((wide, pairs), ~np.uint64(0)), np.zeros((wide, pairs), np.uint64)
    more_in, less_in = np.ones((wide + 1, pairs), np.uint64), np.zeros((wide + 1, pairs), np.uint64)
    one, top, band = np.uint64(1), np.uint64(63), int(most.max())
    begins = [max(w, 65 * w - band - 1) for w in range(wide)]
    stops = [min(steps - 1 + w, 65 * w + 64 + band) for w in range(wide)]
    low = high = 0
    for t in range(stops[-1] + 1):
        while high < wide and begins[high] <= t:
            high += 1
        last, low = low, low + (stops[low] < t)
        at = slice(low, high)
        eq = same[column[t - high + 1 : t - low + 1][::-1] + place[at]]
        u, d, carry, borrow = up[at], down[at], more_in[at], less_in[at]
        either = eq | d
        eq |= borrow
        free = eq & u
        free += u
        free ^= u
        free |= eq
        more = free | u
        np.invert(more, out=more)
        more |= d
        less = u & free
        more_out, less_out = more >> top, less >> top
        more <<= one
        more |= carry
        less <<= one
        less |= borrow
        np.bitwise_or(either, more, out=u)
        np.invert(u, out=u)
        u |= less
        np.bitwise_and(more, either, out=d)
        more_in[low + 1 : high + 1], less_in[low + 1 : high + 1] = more_out, less_out
        if low > last:  # the last of the word before has been taken
            more_in[low], less_in[low] = 1, 0
    left = np.clip(size - 64 * np.arange(wide)[:, None], 0, 64)
    mask = np.where(left == 64, ~np.uint64(0), (one << np.minimum(left, 63).astype(np.uint64)) - one)
    distance = steps + (np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask)).sum(0)
    return distance <= most


def _by_words(x: list[str], y: list[str], most: int) -> bool:
    """Whether replacing, leaving out and adding whole words, as they come, takes few enough edits."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        more, less = i + 1 < n and x[i + 1] == y[j], j + 1 < m and x[i] == y[j + 1]
        if more != less and not (i + 1 < n and j + 1 < m and x[i + 1] == y[j + 1]):
            cost += len(x[i] if more else y[j]) + 1
            i, j = i + more, j + less
        else:
            cost += max(len(x[i]), len(y[j]))
            i, j = i + 1, j + 1
        if cost > most:
            return False
    return cost + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:]) <= most


def _alike(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v of the pairs (u, v, a, b, most) within their distance; pairs that have to be aligned wait until they are many."""
    wait, ends = [], []

    def verified() -> pa.RecordBatch:
        found = [ends[i] for i in aligned(wait)]
        ends.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    for b in slices(batches, TOGETHER):
        known, open_ = screened(*(b.column(k).to_pylist() for k in (2, 3, 4)))
        yield b.select([0, 1]).filter(pa.array(known))
        for longest, i, *rest in open_:
            wait.append((longest, len(ends), *rest))
            ends.append((b.column(0)[i].as_py(), b.column(1)[i].as_py()))
        if len(wait) >= TOGETHER:
            yield verified()
    if wait:
        yield verified()


def links_left(sets: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """u, v: links that join the lines of each set which ``nodes`` (node, component) leave apart; texts: k1, line.

    Lines go with their texts to a task that compares them, so rows grow with the lines: all near pairs of
    different groups, the nearest first, but for those whose groups its links have joined by then. Sets of more
    than ``PART`` lines are compared part by part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        wait: list[tuple] = []

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        def verified() -> pa.RecordBatch:
            some = [p for p in wait if root(p[0]) != root(p[1])]
            wait.clear()
            found = []
            for p, near in zip(some, all_within(*([p[k] for p in some] for k in (4, 5, 6)))):
                if near and (x := root(p[0])) != (y := root(p[1])):
                    above[max(x, y)] = min(x, y)
                    found.append(p)
            return pa.RecordBatch.from_arrays([pa.array([f(p[2], p[3]) for p in found], pa.int64()) for f in (min, max)], ["u", "v"])

        for b in batches:
            for i in range(b.num_rows):
                across, rows = b.column(0)[i].as_py() != b.column(1)[i].as_py(), b.column(2)[i].values
                label, one, low, part = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("label", "one", "low", "part"))
                lines = rows.field("line").to_pylist()
                size = np.array([len(x) for x in lines])
                for x, y, bits in apart(label, low.view(np.uint64), NEAR):
                    most = np.floor((1 - similarity) * np.maximum(size[x], size[y]) + 1e-9).astype(np.int64)
                    at = np.flatnonzero((np.abs(size[x] - size[y]) <= most) & ((part[x] != part[y]) | (not across)))
                    at = at[np.argsort(bits[at], kind="stable")]
                    for k in range(0, len(at), TOGETHER):
                        p, q, n = x[at[k : k + TOGETHER]], y[at[k : k + TOGETHER]], most[at[k : k + TOGETHER]]
                        of = label[p].tolist(), label[q].tolist(), one[p].tolist(), one[q].tolist()
                        wait.extend(zip(*of, (lines[j] for j in p.tolist()), (lines[j] for j in q.tolist()), n.tolist()))
                        if len(wait) >= TOGETHER:
                            yield verified()
        if wait:
            yield verified()

    key = Window.partitionBy("key")
    rows = members(sets).join(nodes.select(F.col("node").alias("one"), F.col("component").alias("label")), "one", "left").withColumn("label", F.coalesce("label", "one"))
    rows = rows.select("*", F.min("label").over(key).alias("least"), F.max("label").over(key).alias("greatest"), F.ceil(F.count("*").over(key) / PART).cast("int").alias("parts")).where("least < greatest")
    rows = rows.join(texts.select(F.col("k1").alias("one"), "line"), "one").withColumn("part", F.pmod(F.xxhash64("one"), F.col("parts")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("key", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), F.struct("label", "one", "low", "part", "line").alias("row"))
    # dealt to all tasks: coalesced for their few bytes, a few tasks would compare all
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(tasks, "key", "first", "second").groupBy("key", "first", "second").agg(F.collect_list("row").alias("rows"))
    return grouped.select("first", "second", "rows").mapInArrow(work, "u long, v long")


def fuzzy_groups(lines: DataFrame, blobs: DataFrame, docs: DataFrame, scratch: Scratch, similarity: float, most: int, shards: int) -> DataFrame:
    """node, component (by k1) of near-equal lines. lines: k1, row, line_no; blobs: shard, keys."""
    met = scratch.put(meetings(blobs, shards, most, NEAR, hashes=True, middle=True))
    pairs, sets = scratch.put(pairs_of(met).distinct()), sets_of(met)
    ends = pairs.select(F.col("u").alias("k1")).unionByName(pairs.select(F.col("v").alias("k1"))).unionByName(members(sets).select(F.col("one").alias("k1"))).distinct()
    wanted = scratch.put(lines.join(ends, "k1").dropDuplicates(["k1"]))
    texts = scratch.put(_texts(docs, wanted))
    scratch.drop(wanted)
    both = pairs.join(texts.select(F.col("k1").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("k1").alias("v"), F.col("line").alias("b")), "v")
    both = both.withColumn("most", F.floor((1 - similarity) * F.greatest(F.length("a"), F.length("b")) + 1e-9).cast("int"))
    links = scratch.put(both.where(F.abs(F.length("a") - F.length("b")) <= F.col("most")).select("u", "v", "a", "b", "most").mapInArrow(_linked, "u long, v long"))
    nodes = connected_components(links, scratch)
    if not sets.isEmpty():
        nodes = scratch.put(nodes)
        more = scratch.put(links_left(sets, nodes, texts, similarity))
        if not more.isEmpty():
            nodes = joined(nodes, more, scratch)
    scratch.drop(texts)
    return nodes


def removed_lines(docs: DataFrame, scratch: Scratch, bits: int = BITS, blocks: int = BLOCKS, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """row, line_no of all occurrences but the first of each group. docs: row, doc_id, text."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = scratch.put(_occurrences(docs, similarity, bits, blocks, shards))
    seen = hashed.where("shard is null").select("row", "doc_id", "line_no", "k1", "k2")
    place = F.struct("doc_id", "line_no", "row")
    lines = scratch.put(seen.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    blobs = hashed.where("shard is not null").select("shard", "keys")
    nodes = fuzzy_groups(lines.select("k1", "first.row", "first.line_no"), blobs, docs, scratch, similarity, most, shards).withColumnRenamed("node", "k1")
    grouped = scratch.put(lines.join(nodes, "k1", "left").where("n > 1 or component is not null").select("k1", "k2", "n", "first", F.coalesce("component", "k1").alias("root"), F.when(F.col("component").isNull(), F.col("k2")).otherwise(F.lit(0)).alias("alone")))
    kept = grouped.groupBy("root", "alone").agg(F.min("first").alias("kept"), F.count("*").alias("n_lines"))
    n_lines, n_seen = (r or 0 for r in lines.agg(F.count("*"), F.sum("n")).first())
    by_key = scratch.put(skewed_join(grouped.select("k1", "k2", "n", "root", "alone"), kept, ["root", "alone"], "n_lines", n_lines).select("k1", "k2", "n", "kept"))
    return skewed_join(seen, by_key, ["k1", "k2"], "n", n_seen).where(~place.eqNullSafe(F.col("kept"))).select("row", "line_no")


def without(texts: pa.Array, gone: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The texts less the lines whose numbers ``gone`` lists, how many lines they had and how many went; all on the texts' bytes."""
    texts = texts.cast(pa.string())
    count = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int32())
    size = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int32())
    at = np.flatnonzero((size.to_numpy() > 0) & (count.to_numpy() > 0))
    if not len(at):
        return texts, count, size
    some, lists = texts.take(pa.array(at)), gone.take(pa.array(at))
    opens = np.frombuffer(some.buffers()[1], np.int32, len(at) + 1, 4 * some.offset).astype(np.int64)
    raw = np.frombuffer(some.buffers()[2], np.uint8, int(opens[-1] - opens[0]), int(opens[0])) if opens[-1] > opens[0] else np.zeros(0, np.uint8)
    opens -= opens[0]
    n = count.to_numpy()[at].astype(np.int64)
    last = np.cumsum(n) - 1  # each text's last line, of all lines
    inner = np.ones(int(n.sum()), bool)
    inner[last] = False
    after = np.empty(len(inner), np.int64)  # the byte after a line and its end; a text's last line has no end
    after[last], after[inner] = opens[1:], np.flatnonzero(raw == 10) + 1
    stays = np.ones(len(inner), bool)
    of, line = np.repeat(np.arange(len(at)), size.to_numpy()[at]), lists.flatten().to_numpy()
    stays[((last - n + 1)[of] + line)[line < n[of]]] = False
    kept = np.repeat(stays, np.diff(after, prepend=0))
    left = np.flatnonzero(stays)
    final = left[np.diff(np.searchsorted(last, left), append=len(last)) > 0]  # the last line that stays of each text
    kept[after[final[inner[final]]] - 1] = False  # the end of one that lines followed
    ends = np.append(0, np.cumsum(kept))[opens].astype(np.int32)
    short = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(raw[kept].tobytes()))
    where = np.arange(len(texts))
    where[at] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([texts, short]).take(pa.array(where)), count, size


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", bits: int = BITS, blocks: int = BLOCKS, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """The rows of ``df`` with ``text`` reduced to the lines that stay, and ``n_lines``, ``n_removed`` added."""
    free_of(df, "n_lines", "n_removed", "_row", "_gone", "_text")
    scratch = Scratch(df.sparkSession)
    row = F.xxhash64(F.col(key), F.col(text))
    docs = df.select(row.alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    gone = scratch.put(removed_lines(docs, scratch, bits, blocks, similarity, most).distinct().groupBy("row").agg(F.collect_list("line_no").alias("_gone")))
    scratch.only(gone)
    joined = df.withColumn("_row", row).join(gone.withColumnRenamed("row", "_row").hint("shuffle_hash"), "_row", "left")  # texts aren't sorted
    rest = [c for c in df.columns if c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, n, dropped = without(b.column(0), b.column(1))
            by = dict(zip(b.schema.names[2:], b.columns[2:])) | {text: texts}
            yield pa.RecordBatch.from_arrays([*(by[c] for c in df_columns), n, dropped], [*df_columns, "n_lines", "n_removed"])

    df_columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    return joined.select(F.col(text).alias("_text"), "_gone", *rest).mapInArrow(work, schema)
