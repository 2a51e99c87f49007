"""Gapped alignment of reads with segments, in Arrow batches; only where substitutions don't suffice.

Scores are +1 for a match, -1 for a mismatch or a gap. Among equal scores an alignment prefers the
diagonal, and has no gap at an end where bases lie free beyond it. The length that an error rate
refers to is that of the overlap. Core fragments are looked for in reads that hold one of their
pieces only, which loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

Match = tuple[int, int, int, int]  # score, columns, read place of the motif, errors
BAD = -(10**9)  # score of what can't be reached
START, BOTH, SEGMENT, READ = range(4)  # steps of an alignment: none, a base of both, of one
CELLS = 1 << 23  # of the tables that are filled together
BATCH = 512  # reads

Traced = tuple[Match, list[tuple[int, int]]]  # and the columns: read place, segment place; -1 at a gap


def edits_at(pattern: str, text: str) -> list[int]:
    """Fewest edits of the whole pattern in the text, up to each of its places; a column of the table is two bit vectors (Myers 1999)."""
    full, top, at = (1 << len(pattern)) - 1, 1 << len(pattern) >> 1, {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    rises, falls, here = full, 0, len(pattern)
    out = [here]
    for c in text:
        same = at.get(c, 0)
        flat = ((same & rises) + rises ^ rises) | same
        up, down = falls | full & ~(flat | rises), rises & flat
        here += bool(up & top) - bool(down & top)
        up, down, kept = up << 1 & full, down << 1 & full, same | falls
        rises, falls = down | full & ~(kept | up), up & kept
        out.append(here)
    return out


@lru_cache(maxsize=100_000)
def leftmost(pattern: str, text: str) -> int:
    """Where the longest of the nearest matches that end with the text begins; texts are windows hardly longer than a fragment, so few differ."""
    row = list(range(len(pattern) + 1))  # of the reversed texts, both from their begins
    edits = [row[-1]]
    for t in reversed(text):
        new = [row[0] + 1]
        for i, p in enumerate(reversed(pattern)):
            new.append(min(row[i] + (p != t), row[i + 1] + 1, new[-1] + 1))
        row = new
        edits.append(row[-1])
    best = min(edits)
    return len(text) - max(k for k, d in enumerate(edits) if d == best)


def hull(pattern: str, text: str, errors: int) -> tuple[int, int] | None:
    """The part of the text that all places with up to ``errors`` edits of the pattern lie in; None without one.

    One of the pattern's errors + 1 pieces is in such a place as it is. Where pieces would be empty it is all of the text.
    """
    size = len(pattern)
    q = size // (errors + 1)
    if not q:
        return 0, len(text)
    begin, end = len(text), 0
    for at in range(0, q * (errors + 1), q):
        piece = pattern[at : at + q]
        first = text.find(piece)
        if first >= 0:
            begin, end = min(begin, first - at - errors), max(end, text.rfind(piece) - at + size + errors)
    return (max(0, begin), min(len(text), end)) if begin < end else None


def semi_global(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """(begin, end) of all places in the text with the fewest edits, ``most`` at most; the leftmost begin of each end."""
    edits = edits_at(pattern, text)
    best = min(edits)
    window = len(pattern) + best
    return [(max(0, e - window) + leftmost(pattern, text[max(0, e - window) : e]), e) for e, d in enumerate(edits) if d == best] if best <= most else []


def overlap(read: str, segment: str, diagonal: int, band: int, side: str, motif: int) -> Match | None:
    """The figures of ``traced``."""
    found = traced(read, segment, diagonal, band, side, motif)
    return found[0] if found else None


def outer_errors(read: str, segment: str, columns: list[tuple[int, int]], side: str, motif: int) -> tuple[int, tuple[int, ...]]:
    """Columns outside of the CDR3, and the places of the errors there.

    V: up to the motif's last base, which is 0, those before it negative. J: from the motif's first
    base, which isn't asked itself; the next is 1. A gap in the segment has the place of its next base.
    """
    here, out, n = next((s for _, s in columns if s >= 0), 0), [], 0
    for r, s in columns:
        here = s if s >= 0 else here
        if here < motif + 3 if side == "V" else here >= motif:
            n += 1
            wrong = r < 0 or s < 0 or read[r] != segment[s]
            if wrong and side == "V":
                out.append(here - motif - 2)
            elif wrong and n > 1:
                out.append(here - motif)
        here += s >= 0
    return n, tuple(out)


def printed(read: str, segment: str, columns: list[tuple[int, int]]) -> tuple[str, str, str]:
    """An alignment as three lines: the read, a bar at each match, the segment."""
    above = "".join(read[r] if r >= 0 else "-" for r, _ in columns)
    below = "".join(segment[s] if s >= 0 else "-" for _, s in columns)
    return above, "".join("|" if a == b else " " for a, b in zip(above, below)), below


def traced(read: str, segment: str, diagonal: int, band: int, side: str, motif: int) -> Traced | None:
    """``aligned`` of one pair, with a band to both sides of the diagonal."""
    return next(aligned([Task(read, segment, diagonal, diagonal - band, diagonal + band, motif)], side))


@dataclass(frozen=True)
class Task:
    """``diagonal``: where the segment's first base would fall in the read; the band is from ``low`` to ``high``. ``motif``: the segment's base whose place in the read is wanted."""

    read: str
    segment: str
    diagonal: int
    low: int
    high: int
    motif: int


def aligned(tasks: list[Task], side: str, max_rate: float = 1.0) -> Iterator[Traced | None]:
    """Banded overlap alignments, None beyond the error rate. V: free heads, the segment's end is aligned; J: its begin is, with free ends.

    The tables of many tasks are filled together, a segment's base at a time.
    """
    order = sorted(range(len(tasks)), key=lambda t: (tasks[t].high - tasks[t].low, len(tasks[t].segment)))
    found: list[Traced | None] = [None] * len(tasks)
    while order:
        width, rows = tasks[order[-1]].high - tasks[order[-1]].low + 1, max(len(tasks[t].segment) for t in order) + 1
        some = order[-max(1, CELLS // (width * rows)) :]
        del order[-len(some) :]
        for t, x in zip(some, _filled([tasks[t] for t in some], side, max_rate)):
            found[t] = x
    yield from found


def _filled(tasks: list[Task], side: str, max_rate: float) -> Iterator[Traced | None]:
    head = side == "V"
    n, m = (np.array([len(getattr(t, x)) for t in tasks])[:, None] for x in ("read", "segment"))
    low, size = np.array([t.low for t in tasks])[:, None], np.array([t.high - t.low + 1 for t in tasks])[:, None]
    bases = lambda texts, k: np.array([np.frombuffer(x.encode("latin-1", "replace").ljust(k, b"\0"), np.uint8) for x in texts])
    width, rows = int(size.max()), int(m.max())
    reads, segs = bases([t.read for t in tasks], max(1, int(n.max()))), bases([t.segment for t in tasks], max(1, rows))
    w = np.arange(width)
    back = np.zeros((rows + 1, len(tasks), width), np.uint8)
    last, right = np.full((len(tasks), width), BAD), np.full((rows + 1, len(tasks)), BAD)
    old = np.full((len(tasks), width + 1), BAD)
    for i in range(rows + 1):
        j = i + low + w
        inside = (j >= 0) & (j <= n) & (w < size) & (i <= m)
        score, step = np.where(inside & ((j == 0) & head | (i == 0)), 0, BAD), np.full(j.shape, START, np.uint8)
        if i:
            equal = np.take_along_axis(reads, np.clip(j - 1, 0, reads.shape[1] - 1), 1) == segs[:, i - 1, None]
            both = np.where((j > 0) & (old[:, :-1] > BAD), old[:, :-1] + np.where(equal, 1, -1), BAD)
            step[(both >= score) & (both > BAD)] = BOTH
            score = np.maximum(score, both)
            gap = np.where(old[:, 1:] > BAD, old[:, 1:] - 1, BAD)
            step[gap > score] = SEGMENT
            score = np.maximum(score, gap)
        score = np.where(inside, score, BAD)
        along = np.maximum.accumulate(score + w, 1) - w
        along = np.where(inside & (along > BAD // 2), along, BAD)
        step[along > score] = READ
        back[i], old[:, :-1] = step, along
        last = np.where(i == m, along, last)
        k = n - i - low
        at = np.take_along_axis(along, np.clip(k, 0, width - 1), 1)
        right[i] = np.where((k >= 0) & (k < width), at, BAD)[:, 0]
    for c, t in enumerate(tasks):
        end, ends = len(t.segment), []
        score = int(max(last[c].max(), BAD if head else right[: end + 1, c].max()))
        if score <= BAD:
            yield None
            continue
        ends += [(-abs(t.low + int(k) - t.diagonal), end, end + t.low + int(k)) for k in np.flatnonzero(last[c] == score)]
        if not head:
            ends += [(-abs(len(t.read) - int(i) - t.diagonal), int(i), len(t.read)) for i in np.flatnonzero(right[: end + 1, c] == score)]
        _, i, j = max(ends)
        fewest = min(i, j) if head else i  # columns
        if max_rate < 0.5 and (score <= 0 or fewest - score > 2 * max_rate * fewest):
            yield None
            continue
        columns = []
        while (step := back.item(i, c, j - i - t.low)) != START:
            i, j = i - (step != READ), j - (step != SEGMENT)
            columns.append((-1 if step == SEGMENT else j, -1 if step == READ else i))
        columns = without_outer_gaps(columns[::-1], len(t.read), len(t.segment), (j, i))
        place, size = read_place(columns, t.motif, j), len(columns)
        yield ((score, size, place, (size - score) // 2), columns) if size and place >= 0 and (size - score) / 2 / size <= max_rate else None


def read_place(columns: list[tuple[int, int]], motif: int, start: int) -> int:
    """Where a segment's base lies in the read, at a gap where the read's next base does; -1 if it isn't aligned."""
    for r, s in columns:
        if s == motif:
            return max(r, start)
        start = r + 1 if r >= 0 else start
    return -1


def without_outer_gaps(columns: list[tuple[int, int]], n: int, m: int, start: tuple[int, int]) -> list[tuple[int, int]]:
    """A gap at an alignment's end takes the base that lies free beyond it: the score is the same or, where these match, no less."""
    ends = list(start)
    for k in (0, 1):
        ends[k] = next((c[k] for c in reversed(columns) if c[k] >= 0), start[k] - 1) + 1
    for gap, free in ((0, n - ends[0]), (1, m - ends[1])):  # of the read, of the segment
        run = next((k for k, c in enumerate(reversed(columns)) if c[gap] >= 0), len(columns))
        for k in range(take := min(run, free)):
            c = columns[-take + k]
            columns[-take + k] = (ends[0] + k, c[1]) if gap == 0 else (c[0], ends[1] + k)
    for gap in (0, 1):
        run = next((k for k, c in enumerate(columns) if c[gap] >= 0), len(columns))
        for k in range(take := min(run, start[gap])):
            c, at = columns[k], start[gap] - take + k
            columns[k] = (at, c[1]) if gap == 0 else (c[0], at)
    return columns


def best_alignments(reads: list[str], fragments: list[tuple[str, int, list[int]]], segments: dict[int, tuple[str, int]], side: str, errors: int, max_rate: float, core_offset: int = 0, every: bool = False) -> Iterator[list[tuple[int, Traced, str, int]]]:
    """Of each read: segment, alignment, the part of the segment that was aligned and its motif's place, of the best segments, or of every one within the error rate.

    V's diagonal is the one of the core fragment's end, 0 at most; J's band is as wide as what follows the fragment's begin.
    """
    tasks: dict[tuple[int, int, Task], None] = {}
    for scf, start, segs in fragments:
        for r, read in enumerate(reads):
            if not (part := hull(scf, read, errors)):
                continue
            first, last = part
            for begin, end in semi_global(scf, read[first:last], errors):
                begin, end = begin + first, end + first
                for s in segs:
                    seq, motif = segments[s]
                    if side == "V":
                        part, at = seq[: motif + 3 + max(core_offset, 0)], motif
                        diagonal, band = min(0, end - len(part) + max(0, -core_offset)), math.ceil(end * max_rate)
                        low, high = diagonal - band, diagonal + band + 1
                    else:
                        cut = motif + min(core_offset, 0)
                        part, at = seq[cut:], motif - cut
                        diagonal, band = begin - (start - min(core_offset, 0)), len(read) - begin
                        low, high = max(begin - band, -len(part)), min(begin + band + 1, len(read))
                    tasks[r, s, Task(read, part, diagonal, low, high, at)] = None
    out: list[list[tuple[int, Traced, str, int]]] = [[] for _ in reads]
    for (r, s, task), found in zip(tasks, aligned([t for _, _, t in tasks], side, max_rate)):
        if found:
            best, new = out[r], (s, found, task.segment, task.motif)
            if not every and best and found[0][0] > best[0][1][0][0]:
                best.clear()
            if (every or not best or found[0][0] == best[0][1][0][0]) and new not in best:
                best.append(new)
    yield from out


def gapped_matches(reads: DataFrame, segments: DataFrame, scfs: DataFrame, side: str, errors: int, max_rate: float, core_offset: int = 0, most_segments: int = 20_000, lines: bool = False, every: bool = False) -> DataFrame:
    """seq, seg_idx, score, aln_len, n_err, motif_at, outer_len, err_pos, and with ``lines`` the alignment printed. Segments are a reference of bounded size; more than ``most_segments`` are an error."""
    table = segments.where(F.col("seg_type") == side).select("seg_idx", "seq", "motif_pos").limit(most_segments + 1).collect()
    if len(table) > most_segments:
        raise ValueError(f"more than {most_segments} segments")
    by_id = {r["seg_idx"]: (r["seq"], r["motif_pos"]) for r in table}
    fragments = [(r["scf"], r["scf_start"], list(r["segs"])) for r in scfs.limit(most_segments).collect()]
    shared = reads.sparkSession.sparkContext.broadcast((by_id, sorted(fragments)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segs, frags = shared.value
        for b in batches:
            rows = []
            for i in range(0, len(b), BATCH):
                some = b["seq"].iloc[i : i + BATCH].tolist()
                for r, best in zip(some, best_alignments(some, frags, segs, side, errors, max_rate, core_offset, every)):
                    for s, (figures, columns), part, at in best:
                        n, places = outer_errors(r, part, columns, side, at)
                        rows.append((r, s, *figures, n, list(places), "\n".join(printed(r, part, columns)) if lines else None))
            yield pd.DataFrame(rows, columns=["seq", "seg_idx", "score", "aln_len", "motif_at", "n_err", "outer_len", "err_pos", "lines"])

    schema = "seq string, seg_idx int, score int, aln_len int, motif_at int, n_err int, outer_len int, err_pos array<int>, lines string"
    out = reads.select("seq").distinct().mapInPandas(work, schema)
    return out if lines else out.drop("lines").distinct()


def v_read_edits(read: str, segment: str, most: int) -> int:
    """Fewest edits of a whole V read within a V segment, or most + 1."""
    part = hull(read, segment, most)
    return min(most + 1, *edits_at(read, segment[slice(*part)])) if part else most + 1


def v_read_matches(reads: DataFrame, segments: DataFrame, max_rate: float, most_segments: int = 20_000) -> DataFrame:
    """fw_seq, seg_idx, n_err: V segments that hold the V read with the fewest edits, ceil(rate * length) at most, ties kept."""
    table = segments.where("seg_type = 'V'").select("seg_idx", "seq").limit(most_segments + 1).collect()
    if len(table) > most_segments:
        raise ValueError(f"more than {most_segments} segments")
    shared = reads.sparkSession.sparkContext.broadcast(sorted((r["seg_idx"], r["seq"]) for r in table))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for read in b["fw_seq"]:
                most = math.ceil(max_rate * len(read))
                edits = [(v_read_edits(read, s, most), i) for i, s in shared.value]
                low = min((e for e, _ in edits), default=most + 1)
                out += [(read, i, e) for e, i in edits if e == low <= most]
            yield pd.DataFrame(out, columns=["fw_seq", "seg_idx", "n_err"])

    return reads.where("fw_seq <> ''").select("fw_seq").distinct().mapInPandas(work, "fw_seq string, seg_idx int, n_err int")
