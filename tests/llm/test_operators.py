"""The training-data operators against brute force, on small tables that hold the awkward cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vdjspark.llm import ann, graph, language, lines, meet, mixing, packing, quality, simhash, suffix, topk, urls
from vdjspark.llm.common import Scratch, majority
from vdjspark.llm.queries import TOKENIZER, tokenizer_file

BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix strange potions in a very old cellar below town"
TEXTS = [None, "", " \n ", "one", BASE, BASE, BASE.replace("seven", "eight"), BASE + " again\n" + BASE, "¿Qué? ñandú 東京 " + BASE, "x" * 9000, "a b\n" * 700, BASE.upper(), "\x1c\x85tab\there 'll we've"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, 7) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, BASE, "en", "s1", 1)]  # a repeated row, and one without an id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Few links are joined in one task, and give the components that rounds give."""
    rng = np.random.RandomState(5)
    links = spark.createDataFrame([tuple(x) for x in rng.randint(0, 300, (200, 2)).tolist()], "u long, v long")
    scratch = Scratch(spark)
    few = sorted(map(tuple, graph.connected_components(links, scratch).collect()))
    assert len(scratch.paths) == 2  # the links and what they join
    monkeypatch.setattr(graph, "FEW", 0)
    assert few and sorted(map(tuple, graph.connected_components(links, Scratch(spark)).collect())) == few


@pytest.mark.parametrize("parts,most", [(1, 1024), (2, 1024), (2, 0)])
def test_simhash(spark, docs, parts, most):
    got = simhash.near_duplicates(docs, parts=parts, most=most).collect()
    assert len(got) == docs.count()
    for r in docs.collect():
        assert f"{brute_fingerprint(r['text']):016x}" in {x["fingerprint"] for x in got if x["doc_id"] == r["doc_id"]}
    fps = {int(r["fingerprint"], 16) for r in got}
    label = {f: f for f in fps}
    for _ in fps:
        for a, b in combinations(fps, 2):
            if (a ^ b).bit_count() <= 4:
                label[a] = label[b] = min(label[a], label[b])
    low = defaultdict(list)
    for r in got:
        if r["doc_id"] is not None:
            low[label[int(r["fingerprint"], 16)]].append(r["doc_id"])
    assert all(r["component_id"] == min(low[label[int(r["fingerprint"], 16)]]) for r in got)


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(30):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(6):
            g = f
            for b in rng.integers(0, 63, rng.integers(0, 5)):
                g ^= 1 << int(b)
            fps.add(g)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comps = []
    for parts, most in ((1, 9), (2, 9), (2, 0)):
        found = graph.connected_components(simhash.near_links(df, Scratch(spark), 4, parts, most), Scratch(spark))
        comps.append({(r["node"], r["component"]) for r in found.collect()})
    near = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    brute = graph.connected_components(spark.createDataFrame(near, "u long, v long"), Scratch(spark))
    assert comps[0] == comps[1] == comps[2] == {(r["node"], r["component"]) for r in brute.collect()}


def word_shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def test_similar_duplicates_by_all_pairs(spark):
    """Groups are those of all pairs of five-word similarity 0.8, but for pairs beyond the radius."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 8))) for _ in range(300)]
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d", "a b c d e"]
    for n in (30, 120, 400):
        for _ in range(12):
            base = [str(w) for w in rng.choice(words, n)]
            for changes in (0, 0, 1, max(1, n // 60), max(1, n // 25), n // 4):
                other = list(base)
                for at in rng.choice(n, changes, replace=False):
                    other[at] = str(rng.choice(words))
                texts.append(" ".join(other).title() if changes == 1 else " ".join(other))
    texts += [texts[-3]] * 30
    sets = [word_shingles(t) for t in texts]
    label = list(range(len(texts)))
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in near):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*enumerate(texts), (None, texts[20]), (20, texts[20])], "doc_id long, text string")
    got = simhash.similar_duplicates(df).collect()
    assert len(got) == len(texts) + 2
    found = {r["doc_id"]: r["component_id"] for r in got}
    together = [found[a] == found[b] for a, b in near if texts[a] != texts[b]]
    assert sum(together) >= 0.95 * len(together)
    assert all(label[i] == label[found[i]] for i in range(len(texts)))  # nothing else is joined
    assert all(found[a] == found[b] for a, b in near if sets[a] == sets[b])
    assert simhash.similar_duplicates(df.limit(0)).count() == 0


def test_colliding_by_all_pairs(spark):
    """Pairs and what is left of large sets are all pairs within the radius, each of them once."""
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 64, 20, dtype=np.uint64)}
    for base in list(fps)[:2]:
        for _ in range(40):
            fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, 5, replace=False)))
            fps.add(base ^ sum(1 << int(b) for b in rng.choice(32, 4, replace=False)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = sorted(tuple(sorted((signed(a), signed(b)))) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 9)
    df, none = spark.createDataFrame([(signed(f),) for f in fps], "fp long"), spark.createDataFrame([], "one long, label long")
    for most in (8, 1000):
        pairs, sets = simhash.colliding(df, Scratch(spark), 9, most, waves=2)
        first = [tuple(r) for r in pairs.collect()]
        assert len(first) == len(set(first)) and (most == 8) == (len(first) < len(want))
        left = [tuple(r) for r in meet.rest(sets, none, 9, simhash.paired_at(9, int(spark.conf.get("spark.sql.shuffle.partitions")))).collect()]
        assert sorted({*first, *left}) == want


def test_variants_are_made_where_they_meet():
    """A task makes all variants within two bits of a half out of a row for each upper quarter, once each, and parts share no key."""
    own = np.random.RandomState(3).randint(0, 2**63, 40).astype(np.uint64)
    flips, low = simhash._flips(2), np.uint64(0xFFFF)
    place = np.concatenate([((own >> np.uint64(32 * part + 16) & low)[:, None] ^ flips).ravel() + np.uint64(part << 16) for part in (0, 1)])
    masks = np.array([sum(1 << b for b in c) for k in range(3) for c in combinations(range(32), k)], np.uint64)
    halves = [own & np.uint64(0xFFFFFFFF), own >> np.uint64(32)]
    want = sorted((k, o) for part, half in enumerate(halves) for h, o in zip(half, own.tolist()) for k in simhash.mix64((h ^ masks) + np.uint64(part + 1 << 32)).tolist())
    assert 3 * len(place) < len(want)  # what is shuffled
    for most in (50, 1000, 1 << 20):
        parts = list(simhash.variants(place, np.tile(np.repeat(own, len(flips)), 2), 2, most))
        keys = [k for a, _ in parts for k in set(a.tolist())]
        assert sorted((k, o) for a, b in parts for k, o in zip(a.tolist(), b.tolist())) == want and len(keys) == len(set(keys))
        assert max(len(a) for a, _ in parts) <= 2 * most


def test_similar_duplicates_of_one_fingerprint(spark):
    """Texts that share a fingerprint are linked, though the first of them is like none of the others."""
    for i in range(100):  # one pair of words is over half of all pairs
        texts = [" ".join([f"a{i}", "b"] * n) for n in (1, 3, 4)]
        node, fp, _ = simhash.shingle_sets(texts, 2, 5)
        if node.view(np.int64).argmin() == 0:
            break
    assert len(set(fp.tolist())) == 1 and len(set(node.tolist())) == 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_duplicates(df).collect()} == {0: 0, 1: 1, 2: 1}


def test_suffix(spark, docs):
    got = sorted((tuple(r) for r in suffix.kept_digest(suffix.remove_repeats(docs)).collect()), key=str)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    low: dict[bytes, int] = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            if i is not None:
                low[b[p : p + 50]] = min(i, low.get(b[p : p + 50], i))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and low[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert got == sorted(want, key=str)


def test_suffix_waves(spark, docs):
    """Waves have all rows of a round together, each a part of them, and rows that meet are in one."""
    named = docs.where("doc_id is not null").select(F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("bytes"), "doc_id", F.lit(0).alias("tag")).coalesce(1)
    rows = lambda wave, waves: [tuple(r) for r in suffix._round_one(named, 50, 20, wave, waves).collect()]
    parts, whole = [rows(k, suffix.WAVES) for k in range(suffix.WAVES)], rows(0, 1)
    assert suffix.WAVES > 1 and sorted(sum(parts, [])) == sorted(whole) and all(0 < len(x) < 0.8 * len(whole) for x in parts)
    assert not {r[5] for r in parts[0]} & {r[5] for r in parts[1]}


def test_suffix_ranks_in_tiles(monkeypatch):
    """Ranks don't depend on the tiles they are worked out in, of which no array is much larger."""
    rng, most = np.random.default_rng(5), []
    blobs = [b"", b"x" * 700, *(bytes(rng.integers(97, 99, int(n), dtype=np.uint8)) for n in rng.integers(0, 400, 30)), b"", b"y" * 49]
    pair = suffix._pair
    monkeypatch.setattr(suffix, "_pair", lambda a, b: (most.append(len(a)), pair(a, b))[1])
    whole = suffix._runs(blobs, 50, 20)
    ranks, joined = {}, b"".join(blobs)
    for n, r in zip((50, 20), (suffix.Ranks(np.frombuffer(joined, np.uint8))[n] for n in (50, 20))):
        ranks[n] = r
    want = []  # as single strings: a run goes on while the smallest rank of 20 bytes and the document stay
    ends = np.cumsum([len(b) for b in blobs])
    for k, b in enumerate(blobs):
        begin, last = ends[k] - len(b), None
        for i in range(len(b) - 49):
            low = ranks[20][begin + i : begin + i + 31].min()
            if low == last and want[-1][2] < suffix.LONGEST:
                want[-1][2] += 1
            else:
                want.append([k, i, 1, low])
            last = low
    assert [list(x) for x in zip(*whole[:4])] == want
    monkeypatch.setattr(suffix, "TILE", 64)
    most.clear()
    first, low = suffix._ranked(joined, 50, 20)
    assert max(most) < 2 * 64 and (first == ranks[50]).all() and len(low) == len(first)
    assert all((x == y).all() for x, y in zip(whole, suffix._runs(blobs, 50, 20)))


def test_packing(spark, docs):
    path = tokenizer_file(TOKENIZER)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = docs.select("text").collect()
    for got, r in zip(packing.encoder(path)([r["text"] or "" for r in texts]), texts):
        assert got.tolist() == t.encode(r["text"] or "", add_special_tokens=False).ids
    rows = packing.pack(docs, path, ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 2048
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    parts = sorted(by_doc[10], key=lambda r: r["piece"])
    assert [x for r in parts for x in r["ids"]] == t.encode(TEXTS[10], add_special_tokens=False).ids + [0]
    assert all(r["length"] == 2048 for r in parts[1:])
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_bounded_best_fit():
    bins = packing.BestFit(10, 2)
    assert [bins.add(n) for n in (6, 7, 4, 3, 5, 8)] == [(0, 0), (1, 0), (0, 6), (1, 7), (2, 0), (3, 0)]
    assert bins.add(9)[0] == 4 and bins.n_open == 2  # the fullest closed
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def brute_packing(lengths, capacity, most, run):
    """Bins by scanning all open ones: the fullest that has room; when too many are open the fullest closes."""
    out, open_, made, since = [None] * len(lengths), [], 0, 0  # open: [free, since, number]
    for begin in range(0, len(lengths), run):
        for i in sorted(range(begin, min(begin + run, len(lengths))), key=lambda i: -lengths[i]):
            n = lengths[i]
            fitting = [b for b in open_ if b[0] >= n]
            if fitting:
                b = min(fitting, key=lambda b: (b[0], -b[1]))
                open_.remove(b)
            else:
                b = [capacity, 0, made]
                made += 1
                if len(open_) >= most and n < capacity:
                    open_.remove(min(open_, key=lambda b: (b[0], -b[1])))
            out[i] = (b[2], capacity - b[0])
            if b[0] > n:
                since += 1
                open_.append([b[0] - n, since, b[2]])
    return out


def test_packing_by_brute_force(spark, tmp_path):
    """Bins close in this input; sequences are those of a plain packer over pieces as they arrive."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 60, 500))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d.parquet")
    kwargs = dict(capacity=64, open_bins=3, run=20)
    got = packing.pack(spark.read.parquet(f"{tmp_path}/d.parquet"), tokenizer_file(TOKENIZER), **kwargs).collect()
    place = {(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"]) for r in got}
    arrived = sorted(place)
    lengths = {(r["doc_id"], r["piece"]): r["length"] for r in got}
    assert [place[k] for k in arrived] == brute_packing([lengths[k] for k in arrived], 64, 3, 20)
    closed = brute_packing([lengths[k] for k in arrived], 64, 10_000, 20)
    assert closed != [place[k] for k in arrived]  # the bound is in force


def test_packing_follows_the_mixture(spark, docs, tmp_path):
    """Another mixture gives other sequences, and each holds documents that are near in it."""
    rows = [(i, f"text number {i} " * 40, f"s{i % 2}") for i in range(600)]
    df, found = spark.createDataFrame(rows, "doc_id long, text string, source string"), []
    for k, weights in enumerate(({"s0": 1, "s1": 1}, {"s0": 9, "s1": 1})):
        mixed = mixing.mix(df, weights=weights, block=2)
        order = {r["doc_id"]: (r["slot"], r["place"]) for r in mixed.collect()}
        mixed.repartitionByRange(4, "slot", "place").sortWithinPartitions("slot", "place").select(df.columns).write.parquet(f"{tmp_path}/{k}")
        got = packing.pack(spark.read.parquet(f"{tmp_path}/{k}"), tokenizer_file(TOKENIZER), run=16, open_bins=4).collect()
        rank = {d: i for i, d in enumerate(sorted(order, key=order.get))}
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append(rank[r["doc_id"]])
        assert max(max(x) - min(x) for x in by.values()) < 80
        found.append({frozenset(x) for x in ((r["doc_id"] for r in got if r["sequence_id"] == s) for s in by)})
        first = [rows[d][2] for d in sorted(order, key=order.get)[:100]]
        assert abs(first.count("s0") - (50, 90)[k]) <= 2
    assert found[0] != found[1]


def brute_viterbi(scores, penalty):
    best = [(list(scores[0]), [[k] for k in range(scores.shape[1])])]
    value, paths = best[0]
    for row in scores[1:]:
        new = [max((value[j] - (penalty if j != k else 0), j == k, -j) for j in range(len(row))) for k in range(len(row))]
        paths = [paths[-j] + [k] for k, (_, _, j) in enumerate(new)]
        value = [v + s for (v, _, _), s in zip(new, row)]
    return max(value)


def test_viterbi():
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores, penalty = rng.normal(0, rng.choice([1, 4]), (rng.integers(1, 30), 3)), 5.0
        path = language.label_words(scores, penalty)
        total = scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert total == pytest.approx(brute_viterbi(scores, penalty))


def test_language(spark):
    en, fr = "the cat and the other dog were there ", "le chat et les autres chiens étaient là "
    train = spark.createDataFrame([(en * 5, "en"), (fr * 5, "fr"), (None, "en"), ("да нет", None)], "text string, lang string")
    model = language.train_language_model(train)
    rows = [(1, en), (2, fr), (3, None), (4, "123 !?"), (5, ""), (6, en * 4 + fr * 4), (7, "москва")]
    got = {r["i"]: r for r in language.identify_languages(spark.createDataFrame(rows, "i int, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert [s["lang"] for s in got[6]["lang_spans"]] == ["en", "fr"] and got[7]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality(spark):
    rows = [(i, ("good plain words here " if i % 2 else "B4D!! $$$ ## ") * (i % 5 + 1)) for i in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, quality.train_quality_model(docs, labels), keep=["doc_id"]).collect()}
    assert len(got) == 82 and all(got[i]["predicted"] == i % 2 for i in range(60, 80)) and got[80]["score"] == got[81]["score"]


def test_lines(spark):
    near = BASE + " with plenty of other words that make this line long enough for a small change to leave its hash nearly as it was before"
    rows = [(2, f"alpha beta\n{BASE}\n***\n"), (1, f"Alpha, BETA!\nother line\n***"), (3, None), (4, ""), (5, f"{near}\nbeta alpha"), (1, "Alpha, BETA!\nother line\n***")]
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, f"{BASE}\n***\n"), (1, "Alpha, BETA!\nother line\n***"), (3, None), (4, ""), (5, f"{near}\nbeta alpha")}


def test_lines_by_all_pairs(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9))) for _ in range(600)]
    texts = []
    for n in (1, 2, 3, 6, 12, 20, 40):
        for _ in range(12):
            line = [str(w) for w in rng.choice(words, n)]
            texts.append(" ".join(line))
            for _ in range(3):
                other = list(line)
                at = int(rng.integers(n))
                other[at] = str(rng.choice(words)) if n >= 12 else other[at][:-1] + "z"
                texts.append(" ".join(other))
    texts = list(dict.fromkeys(texts))
    label = list(range(len(texts)))
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if lines.within(texts[a], texts[b], int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9))]
    while any(label[a] != label[b] for a, b in near):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert len(set(label)) < len(texts) / 2
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kept = {r["doc_id"] for r in out if r["text"]}
    assert kept >= set(label) and len(kept) - len(set(label)) <= 0.02 * (len(texts) - len(set(label)))


def test_large_sets_of_lines(spark):
    """Variants of a long line share most keys, so that sets exceed ``most``; groups are those of all pairs."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts = []
    for base in range(2):
        line = words[base * 200 : base * 200 + 40]
        for k in range(15):
            other = list(line)
            for at in rng.choice(40, 4, replace=False):
                other[at] = words[int(rng.integers(400))]
            texts.append(" ".join(other))
    texts.append(" ".join(words[20:40] + words[380:400]))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    label = list(range(len(texts)))
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if lines.within(texts[a], texts[b], int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9))]
    while any(label[a] != label[b] for a, b in near):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    for most in (2, 8):
        out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=most).collect()
        assert {r["doc_id"] for r in out if r["text"]} == set(label)


def test_large_sets_lose_no_link(spark):
    """Groups are those of all pairs that share a key and have near hashes, however many lines share it."""
    rng = np.random.default_rng(15)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts = []
    for base in range(2):
        line = words[base * 200 : base * 200 + 40]
        for _ in range(40):
            other = list(line)
            for at in rng.choice(40, int(rng.integers(4, 9)), replace=False):
                other[at] = words[int(rng.integers(400))]
            texts.append(" ".join(other))
    _, _, one, _, sim, codes, opens, word, word_opens = lines._hashes(texts)
    keys, of, low = lines.line_keys(one, sim, word, word_opens, codes, opens, lines.SIMILARITY, lines.BITS, lines.BLOCKS)
    text, sets, hashes = dict(zip(one.tolist(), range(len(texts)))), defaultdict(set), {}
    for k, x, h in zip(keys.tolist(), of.tolist(), low.tolist()):
        sets[k].add(text[x])
        hashes[text[x]] = h
    met = {p for x in sets.values() for p in combinations(sorted(x), 2) if (hashes[p[0]] ^ hashes[p[1]]).bit_count() <= lines.NEAR}
    near = [(a, b) for a, b in met if lines.within(texts[a], texts[b], int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9))]
    label = list(range(len(texts)))
    while any(label[a] != label[b] for a, b in near):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (2, lines.MOST):
        assert {r["doc_id"] for r in lines.dedup_lines(df, most=most).collect() if r["text"]} == set(label)


def test_a_task_holds_one_shard(spark):
    """Rows that meet are dealt to as many tasks as there are shards; no two shards come to one task."""
    shards, keys = 24, np.arange(24, dtype=np.uint64) << np.uint64(32)
    blobs = spark.createDataFrame([(k, bytearray(np.array([7], "<u4").tobytes() + np.array([one], "<u8").tobytes())) for k in range(len(keys)) for one in (2 * k, 2 * k + 1)], "shard int, keys binary")
    met = meet.meetings(blobs, shards, 8, 64, hashes=False, middle=False)
    rows = met.select("u", "v", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["u"], r["v"]) for r in rows) == [(2 * k, 2 * k + 1) for k in range(shards)] and len({r["task"] for r in rows}) == shards


def test_links_left_are_as_many_as_they_join(spark, monkeypatch):
    """Lines of a set that are apart are compared in their task, without a row for each pair; what links join is not compared on."""
    rng, scratch = random.Random(11), Scratch(spark)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    firsts = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(6)]
    texts = list(dict.fromkeys(x if k == 0 else x.replace(rng.choice(x), rng.choice("xyz"), 1) for x in firsts for k in range(12)))
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if lines.within(texts[a], texts[b], int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9))]
    label = list(range(len(texts)))
    for a, b in near:
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    ones = np.arange(len(texts), dtype="<u8")
    sets = spark.createDataFrame([(k, bytearray(ones.tobytes()), bytearray(np.zeros(len(ones), "<u8").tobytes())) for k in (1, 2)], "key long, ones binary, lows binary")
    frame = spark.createDataFrame(list(enumerate(texts)), "k1 long, line string")
    none = spark.createDataFrame([], "node long, component long")
    for part in (4096, 20):
        monkeypatch.setattr(lines, "PART", part)
        links = lines.links_left(sets, none, frame, 0.8)
        found = {tuple(r) for r in links.collect()}
        assert found <= set(near) and len(near) > 200 and len(set(label)) == 6
        if part == 4096:  # a task joins 6 groups of some 12 lines with so many links, for each of two sets
            assert links.count() <= 2 * (len(texts) - 6)
        joined = {r["node"]: r["component"] for r in graph.connected_components(links, scratch).collect()}
        assert [joined.get(k, k) for k in range(len(texts))] == label


def test_distances_side_by_side():
    """As one by one: texts of like and unlike lengths, near and far, of few and of many letters."""
    rng, pairs = random.Random(12), []
    for n in (3, 17, 64, 65, 130, 400):
        for _ in range(150):
            letters = rng.choice(["ab", "abcdefghij ", "".join(map(chr, range(0x4E00, 0x4E00 + 500)))])
            x = "".join(rng.choice(letters) for _ in range(max(1, n + rng.randrange(-n // 5, n // 5 + 1))))
            y = list(x) if rng.random() < 0.7 else [rng.choice(letters) for _ in range(len(x))]
            for _ in range(rng.randrange(0, n // 2 + 2)):
                k = rng.randrange(len(y) + 1)
                y[k : k + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
            pairs.append((x, "".join(y), rng.randrange(0, n // 2 + 2)))
    rng.shuffle(pairs)
    want = [lines.within(*p) for p in pairs]
    assert lines.all_within(*map(list, zip(*pairs))).tolist() == want and 0.2 < np.mean(want) < 0.8
    open_ = [(x, y, m) for x, y, m in pairs if x and y]
    x, y, m = map(list, zip(*open_))
    assert lines._side_by_side(x, y, np.array(m)).tolist() == [lines.within(*p) for p in open_]


def test_letters_rule_out_far_pairs(monkeypatch):
    """The bound by letters is never above the edit distance, and most pairs that are too far apart aren't aligned."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoprstuäж字") for _ in range(rng.randint(1, 8))) for _ in range(200)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    a, b = ["", "a", ""], ["", "", "bc"]
    for _ in range(700):  # more than are counted at once
        x = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        y = [rng.choice(words) if rng.random() < rng.choice((0.1, 0.6)) else w for w in x]
        a.append(" ".join(x))
        b.append(" ".join(y)[rng.randint(0, 2) :])
    true = [distance(x, y) for x, y in zip(a, b)]
    most = [int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)]
    assert len(a) > lines.COUNTED and all(k <= d for k, d in zip(lines.at_least(a, b).tolist(), true))
    tried, plain = [], lines._plain
    monkeypatch.setattr(lines, "_plain", lambda *p: tried.append(p) or plain(*p))
    assert lines.all_within(a, b, most).tolist() == [d <= m for d, m in zip(true, most)]
    near = sum(d <= m for d, m in zip(true, most))
    assert near > 100 and len(tried) - near < (len(a) - near) / 2


def test_hash_blocks():
    """Hashes within the radius share a block's key, others as a rule don't."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 300, np.uint64)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    x, y = lines.hash_blocks(a, 2, 4), lines.hash_blocks(b, 2, 4)
    assert (x == y).any(1).all() and not (x[1:] == y[:-1]).any()


def test_line_distances():
    rng = np.random.default_rng(5)

    def text(most):
        return "".join(rng.choice(list("ab \u00e9\U0001f600"), rng.integers(0, most)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(400):
        a, b, tail = text(12), text(12), text(90)
        for x, y in ((a, b), (a + tail, b + tail), (tail + a, tail + b), (a + tail + b, b + tail + a)):
            d = distance(x, y)
            assert [lines.within(x, y, most) for most in range(14)] == [d <= most for most in range(14)]


def test_line_majority():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 64, 3000, np.uint64)
    opens = np.array([0, 1, 3, 258, 513, 769, 2999])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i:j]) > j - i) for i, j in zip(opens, [*opens[1:], len(h)])]
    assert majority(h, opens).tolist() == want


def fluid_shares(blocks, weights):
    """Blocks that each source has had after each slot, if all flow at their weights at once; in exact numbers."""
    had, weights = [Fraction(0)] * len(blocks), [Fraction(w) for w in weights]
    for _ in range(sum(blocks)):
        left = Fraction(1)
        while left:
            active = [i for i, n in enumerate(blocks) if had[i] < n]
            total = sum(weights[i] for i in active)
            step = min([left, *((blocks[i] - had[i]) * total / weights[i] for i in active)])
            for i in active:
                had[i] += step * weights[i] / total
            left -= step
        yield had


def test_mixing_schedule_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(25):
        n = int(rng.integers(1, 9))
        blocks, weights = [int(x) for x in rng.integers(1, 40, n)], [float(x) for x in rng.random(n) ** 3 + 1e-3]
        placed = mixing.schedule(blocks, weights)
        owner = {t: i for i, s in enumerate(placed) for t, _, _ in s}
        assert sorted(owner) == list(range(sum(blocks))) and all(r <= t < d for s in placed for t, r, d in s)
        done = [0] * n
        for t, had in enumerate(fluid_shares(blocks, weights)):
            done[owner[t]] += 1
            assert all(abs(x - y) < 1 for x, y in zip(done, had))


@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 1, None: 2}])
def test_mixing(spark, weights):
    rows = [(i, f"s{i % 3}" if i % 10 else None) for i in range(900)] + [(900, "s2")] * 2 + [(None, "s1")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block=4, period=32, bucket=50).collect()
    assert sorted(((r["doc_id"], r["source"]) for r in got), key=str) == sorted(rows, key=str) and len({(r["slot"], r["place"]) for r in got}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert {r["slot"] for r in got} == set(range(max(r["slot"] for r in got) + 1))
    assert all(len({r["source"] for r in got if r["slot"] == t}) == 1 for t in range(50))
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
    large = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block=4, plan=64)
    assert large.count() == len(rows) and large.select("slot").distinct().count() <= 64


def test_mixing_keeps_to_the_given_weights():
    weights = [1 / 3] + [2 / 21] * 6 + [2 / 21 - 0.0001, 0.0001]
    for blocks, weights in (([40_000] * 9, weights), ([200, 200_000], [0.001, 0.999])):
        order = {t: i for i, s in enumerate(mixing.schedule(blocks, weights)) for t, _, _ in s}
        done = [0] * len(blocks)
        for t in range(100_000):
            done[order[t]] += 1
            assert all(abs(n - (t + 1) * w / sum(weights)) < 1.000001 for n, w in zip(done, weights))


def test_mixing_of_many_sources(spark):
    df = spark.range(600).selectExpr("id as doc_id", "concat('s', id % 300) as source")
    weights = {f"s{i}": 1 + 8 * (i == 299) for i in range(300)}
    got = mixing.mix(df, weights=weights, block=1).collect()
    assert len({r["slot"] for r in got}) == 600
    assert [r["deadline"] - r["release"] for r in got if r["source"] == "s299" and r["block"] == 0] == [35]  # 308 / 9, rounded up


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (900, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 24), (1060, [float("nan")] * 24), (1080, [None] + [1.0] * 23), (1100, [float("inf")] * 24), (1120, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = x.astype(np.float64)
    got, hits = defaultdict(list), 0
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, block=400).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 900, 20):
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(s == pytest.approx(score[i]) for _, i, s in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert set(got) == set(range(0, 900, 20)) and hits >= 0.9 * 45 * 20
    exact = defaultdict(list)
    for r in topk.top_scores(df, F.col("vec_id") % 50 == 0, block=300).collect():
        exact[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y = np.floor(256 * x).astype(np.int64)
    for q in range(0, 900, 50):
        score = y @ y[q]
        best = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:5]
        assert sorted(exact[q]) == [(k + 1, i, score[i]) for k, i in enumerate(best)]


def test_open_pairs_of_several_batches_meet(monkeypatch):
    """Pairs that have to be aligned wait for others, and none is lost on the way."""
    rng = random.Random(8)
    pairs = []
    for i in range(120):
        a = "".join(rng.choice("abcdefgh") for _ in range(100))
        b = "".join(rng.choice("abcdefgh") if rng.random() < 0.25 else c for c in a)
        pairs.append((i, -i, a, b, 20))
    want = {p[0] for p in pairs if lines.within(*p[2:])}
    within, alone = lines.within, []
    monkeypatch.setattr(lines, "within", lambda *p: alone.append(p) or within(*p))
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some)], ["u", "v", "a", "b", "most"])
    got = pa.Table.from_batches(lines._linked(batch(pairs[i : i + 10]) for i in range(0, 120, 10))).to_pylist()
    assert sorted(r["u"] for r in got) == sorted(want) and all(r["v"] == -r["u"] for r in got) and 10 < len(want) < 110
    assert not alone  # in batches of ten, each pair was aligned by itself
    monkeypatch.setattr(lines, "TOGETHER", 4)
    assert {r["u"] for r in pa.Table.from_batches(lines._linked(iter([batch(pairs)]))).to_pylist()} == want


def test_lines_go_from_bytes():
    """Removing lines from a batch's bytes is removing them from its texts; letters hash alike, whatever else is in the chunk."""
    rng = random.Random(3)
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab é\n\n東") for _ in range(rng.choice([0, 1, 2, 20]))) for _ in range(rng.randint(0, 6))]
        gone = [None if t is None or rng.random() < 0.3 else rng.sample(range(t.count("\n") + 1), rng.randint(0, t.count("\n") + 1)) for t in texts]
        some = pa.array(["x\ny", *texts, "z"]).slice(1, len(texts)), pa.array([[1], *gone, None], pa.list_(pa.int32())).slice(1, len(texts))
        got = [x.to_pylist() for x in lines.without(*some)]
        split = [[] if t is None else t.split("\n") for t in texts]
        assert got[0] == [t if not g else "\n".join(x for i, x in enumerate(s) if i not in g) for t, g, s in zip(texts, gone, split)]
        assert got[1:] == [[len(s) for s in split], [len(g or ()) for g in gone]]
    text = "Zwei µ²-Wörter, ÀÉ\x85x\n\n" + BASE + "\n--\nend"
    one, two = lines._hashes([text]), lines._hashes([text, "東京"])
    n = len(one[0])
    assert all((x == y[:n]).all() for x, y in zip(one[:5], two[:5])) and (one[5] == two[5][: len(one[5])]).all()
    assert [bytes(one[5][i:j].astype(np.uint8)).decode("latin-1")[1:] for i, j in zip(one[6], [*one[6][1:], len(one[5])])] == [x for x in map(lines.normalise, text.split("\n")) if x]


def test_few_vectors_are_verified(monkeypatch):
    """Windows' counts are those of each row and line; near rows are found among few verified ones."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(0, 1, (700, 16)), rng.normal(0, 1, (9, 16))
    index = ann.Pages(x, 21, 700, 3)
    at = index.project(q)
    scaled = x / np.abs(x).max()
    size = (scaled**2).sum(1)
    px = scaled @ index.a[:-1] + np.sqrt(size.max() - size)[:, None] * index.a[-1]
    w = index.length * rng.uniform(0.5, 2, 9)
    for threshold in (1, 12, 13, 21):
        want = (np.abs(px[None] - at.T[:, None]) <= w[:, None, None]).sum(2) >= threshold
        got = np.unpackbits(index.passing(at, w, threshold).view(np.uint8), axis=1, bitorder="little")
        assert (got[:, :700] == want).all() and not got[:, 700:].any()
    x = rng.normal(0, 1, (6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    collide, verified = ann.collide, []

    def counted(*args):
        for rows in collide(*args):
            verified.append(len(rows))
            yield rows

    monkeypatch.setattr(ann, "collide", counted)
    found = ann.nearest_in_block(20)(np.arange(6000), x, np.arange(100), x[:100]).groupby("query_id")["vec_id"].agg(set)
    score = x[:100] @ x.T
    score[np.arange(100), np.arange(100)] = -9
    hits = sum(len(found[i] & set(np.argsort(-s)[:20].tolist())) for i, s in enumerate(score))
    assert hits >= 0.95 * 2000 and np.mean(verified) < 0.2 * 6000


def test_vectors_of_any_size(spark):
    """No finite vector is left out, however large, and the search ends."""
    values = [(1, [1.0, 0.0]), (50, [2.0, 0.0]), (2, [300_000.0, 0.0]), (3, [-1e30, 1.0]), (100, [1e25, -3.5]), (4, [1e200, 1e200]), (5, [0.25, 8.0]), (5, [0.25, 8.0])]
    df = spark.createDataFrame(values, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_scores(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = lambda v: [int(Fraction(x) * 256 // 1) for x in v]
    for q, v in ((50, [2.0, 0.0]), (100, [1e25, -3.5])):
        scored = [(-sum(a * b for a, b in zip(whole(v), whole(x))), i) for i, x in values if i != q]
        clamp = lambda s: min(max(-s, -(1 << 63)), (1 << 63) - 1)
        best = sorted(((clamp(s), i) for s, i in scored), key=lambda x: (-x[0], x[1]))[:5]
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(best)]
    near = ann.nearest(df, F.col("vec_id") == 50, k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == [4, 100, 2]


def test_urls(spark):
    rows = [
        ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://b.net/", "b.net", "/", "net/", "block"), ("http://b.net", "b.net", "", None, "allow"),
        ("x://example.com/de/?q", "example.com", "/de/", "example.com/de/", "block"), ("http://q.org/fr/xxx", "q.org", "/fr/xxx", "org/fr/", "allow"), (None, "", "", None, "allow"), ("casino", "", "", None, "block"),
        ("http://a.com/casinos", "a.com", "/casinos", None, "allow"), ("http://a.com/free-win", "a.com", "/free-win", None, "block"), ("http://a.com/free-free", "a.com", "/free-free", None, "allow"),
    ]
    got = urls.filter_urls(spark.createDataFrame([(r[0],) for r in rows], "url string")).collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == rows


def test_clashing_columns(spark, docs):
    """Operators that keep other columns refuse names of their own; the others don't mind."""
    model = language.LanguageModel([], np.zeros((0, language.BUCKETS)), np.zeros((0, 1)))
    for name, run in (
        ("slot", mixing.mix), ("_source", mixing.mix), ("N_lines", lines.dedup_lines), ("_row", lines.dedup_lines), ("score", lambda df: language.identify_languages(df, model)),
        ("predicted", lambda df: quality.score_quality(df, quality.fit([]))), ("host", lambda df: urls.filter_urls(df, url="text")),
    ):
        with pytest.raises(ValueError):
            run(docs.withColumn(name, F.lit(1)))
    for run, name in ((simhash.near_duplicates, "fingerprint"), (simhash.similar_duplicates, "component_id"), (suffix.remove_repeats, "kept"), (lambda df, key: packing.pack(df, "", key=key), "piece")):
        with pytest.raises(ValueError):
            run(docs.withColumnRenamed("doc_id", name), key=name)
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("fp", "key", "n", "s", "_group", "piece", "bytes", "tag", "gone", "member", "node", "low", "u", "v")])
    assert simhash.near_duplicates(more).count() == suffix.remove_repeats(more).count() == mixing.mix(more).count() == docs.count()
    assert simhash.similar_duplicates(more).count() == docs.count() and packing.pack(more, tokenizer_file(TOKENIZER)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == suffix.remove_repeats(none).count() == packing.pack(none, tokenizer_file(TOKENIZER)).count() == lines.dedup_lines(none).count() == 0
    model = language.train_language_model(none)
    assert {r["lang_pred"] for r in language.identify_languages(docs, model).collect()} == {"und"}
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, F.lit(True)).count() == topk.top_scores(vectors, F.lit(True)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        seen.append((name, now.count()))
    counts = dict(seen)
    assert counts["line_dedup"] == counts["language_id"] >= counts["simhash_near_dedup"] == counts["source_mixing"] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
