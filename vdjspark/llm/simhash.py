"""Operator 3, SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits both lie within r/2 bits of some third value. So
each fingerprint emits every variant within half the radius, variants are shuffled, and
fingerprints that meet on one are verified. In its plain form (``parts=1``) that is 2,081 variants
of 64 bits at r = 4, and all that meet are within r bits of each other, so a star of links stands
for all pairs. By default the bits fall into two halves, one of which has at most half the
differences: the balls are those of half the radius in 32 bits, 66 variants in all, and no link is
lost. Halves that meet lead to the fingerprints that have them, which are verified; where these
are many (more than ``most`` pairs), they meet once more on variants of their other halves within
what is left of the radius, where a star again stands for all pairs.

``similar_duplicates`` is for whole documents: it takes fingerprints of pairs of words, which near
copies share more of, a radius of 9, of which one half has 4 at most, and verifies colliding
documents by the similarity of their sets of five-word shingles.

Defined results: null and empty texts have no word and fingerprint zero, and are linked like any
other. Repeated rows share fingerprint and component. Rows with a null id keep a fingerprint and
join components, but a null id never names one unless all are null. An empty table gives no row.
Other columns take no part, whatever their names; a key named as a result raises a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import Scratch, in_chunks, majority, mix64, odd, skewed_join, slices
from .graph import connected_components, joined
from .meet import meetings, packed, pairs_of, rest, sets_of, unpacked

SEED = 42
WORDS = 4
BLOCK = 1 << 16  # shingles whose bits are counted at once
CHUNK = 1 << 18  # characters whose words are hashed at once
FLUSH = 1 << 19  # rows that a task gathers before it packs them
WAVES = 2  # parts of these rows that are shuffled one after the other
MADE = 1 << 20  # variants that a task makes at once where they meet


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash over the hashes of word shingles, unsigned; zero without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed long, to the columns in ``keep`` (all if None)."""
    keep = df.columns if keep is None else keep

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(0)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], [*b.schema.names[1:], "fp"])

    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(work, T.StructType([*df.select(*keep).schema.fields, T.StructField("fp", T.LongType())]))


def ball(bits: range, radius: int) -> list[int]:
    """Masks, as signed longs, of all ways to flip up to ``radius`` of the bits."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def longs(values: list[int]) -> Column:
    """An array literal; long ones take a while as single literals."""
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def _mask(a: int, b: int) -> int:
    """Bits a to b - 1, as a signed long."""
    mask = (1 << b) - (1 << a)
    return mask - (1 << 64) if mask >> 63 else mask


def _stars(rows: DataFrame, on: list[str]) -> DataFrame:
    """u, v: links of all ``fp`` that meet on ``on`` with the smallest of them."""
    low = rows.groupBy(on).agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(low, on).where("fp <> low").select(F.col("low").alias("u"), F.col("fp").alias("v")).distinct()


def near_links(fps: DataFrame, scratch: Scratch, radius: int = 4, parts: int = 2, most: int = 1024) -> DataFrame:
    """u, v: links that join all fingerprints (``fp``, distinct) within ``radius`` bits, even, into their components."""
    if radius % 2 or radius < 0 or parts not in (1, 2):
        raise ValueError("the radius is even, so that half of it is a whole number; parts are 1 or 2")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts == 1:
        spread = fps.repartition(tasks, "fp")
        return _stars(spread.select("fp", F.explode(longs(ball(range(64), radius // 2))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value")), ["value"])

    inner, half = [F.lit(_mask(0, 32)), F.lit(_mask(32, 64))], (radius // 2 + 1) // 2
    of = lambda x: F.when(F.col("part") == 0, x[0]).otherwise(x[1])
    own = fps.select("fp", F.explode(F.lit([0, 1])).alias("part")).withColumn("a", F.col("fp").bitwiseAND(of(inner)))
    sizes = scratch.put(own.groupBy("part", "a").agg(F.count("*").alias("n")))
    # halves that meet on a variant; a variant has as many as a ball at most
    balls = [longs(ball(range(0, 32), half)), longs(ball(range(32, 64), half))]
    met = sizes.select("part", "a").repartition(tasks, "a").select("part", "a", F.explode(of(balls)).alias("mask")).select("part", F.col("a").bitwiseXOR(F.col("mask")).alias("value"), "a")
    met = met.groupBy("part", "value").agg(F.collect_list("a").alias("all")).where(F.size("all") > 1)
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    halves = met.select("part", F.explode("all").alias("a"), "all").select("part", "a", F.explode("all").alias("a2")).where((F.col("a") < F.col("a2")) & (apart("a", "a2") <= radius // 2)).distinct()
    halves = halves.unionByName(sizes.where("n > 1").select("part", "a", F.col("a").alias("a2")))
    n1, n2 = sizes.withColumnRenamed("n", "n1"), sizes.select("part", F.col("a").alias("a2"), F.col("n").alias("n2"))
    halves = scratch.put(halves.join(n1, ["part", "a"]).join(n2, ["part", "a2"]).withColumn("large", F.col("n1") * F.col("n2") > most))

    left, right = own.withColumnRenamed("fp", "u"), own.select("part", F.col("a").alias("a2"), F.col("fp").alias("v"))
    small = halves.where("not large").join(left, ["part", "a"]).join(right, ["part", "a2"])
    pairs = small.where((F.col("u") != F.col("v")) & (apart("u", "v") <= radius)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    # large sets meet on variants of their other halves, within what the halves leave of the radius
    large = halves.where("large").withColumn("d", apart("a", "a2"))
    sides = large.join(left.withColumnRenamed("u", "fp"), ["part", "a"]).withColumn("reach", F.expr(f"{radius // 2} - d div 2")).select("part", "a", "a2", "fp", "reach")
    sides = sides.unionByName(large.where("a <> a2").join(right.withColumnRenamed("v", "fp"), ["part", "a2"]).withColumn("reach", F.expr(f"{radius // 2} - (d + 1) div 2")).select("part", "a", "a2", "fp", "reach"))
    choice = F.lit(None).cast("array<bigint>")
    for k, bits in ((0, range(32, 64)), (1, range(0, 32))):
        for reach in range(radius // 2 + 1):
            choice = F.when((F.col("part") == k) & (F.col("reach") == reach), longs(ball(bits, reach))).otherwise(choice)
    rows = sides.select("part", "a", "a2", "fp", F.explode(choice).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(of(inner[::-1])).bitwiseXOR(F.col("mask"))).drop("mask")
    return pairs.unionByName(_stars(rows, ["part", "a", "a2", "value"]))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, parts: int = 2, most: int = 1024, words: int = WORDS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id, the smallest key that links reach, of each row."""
    if key.lower() in ("fingerprint", "component_id"):
        raise ValueError(f"the key can't be named {key}")
    scratch = Scratch(df.sparkSession)
    docs = scratch.put(fingerprints(df.select(F.col(text).alias("text"), F.col(key).alias("key")), keep=["key"], words=words))
    groups = docs.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n"))
    nodes = connected_components(near_links(groups.select("fp"), scratch, radius, parts, most), scratch)
    rooted = scratch.put(groups.join(nodes, groups["fp"] == nodes["node"], "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("root")))
    named = _named(rooted)
    return skewed_join(docs, named.withColumnRenamed("node", "fp"), ["fp"], "n", docs.count()).select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(rooted: DataFrame) -> DataFrame:
    """node (the first column), n, and component_id, the smallest ``low`` of its root."""
    roots = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_root"))
    return skewed_join(rooted, roots, ["root"], "n_root", rooted.count()).select(F.col(rooted.columns[0]).alias("node"), "n", "component_id")


def shingle_sets(texts: list[str | None], hashed: int, words: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each text a key of its words in order, the SimHash of its shingles of ``hashed`` words, and its set of those of ``words`` words, as sorted hashes of 32 bits."""
    key, fp, sets = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), [b""] * len(texts)
    blobs = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    for i, j in in_chunks(blobs, CHUNK):
        data = np.frombuffer(b"".join(blobs[i:j]), np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        inner = ~space
        head = inner.copy()
        head[1:] &= space[:-1]
        starts = np.flatnonzero(head)
        if not len(starts):
            continue
        letters = data[inner].astype(np.uint64)
        letters += np.uint64(32) * ((letters >= 65) & (letters <= 90)) + np.uint64(1)
        first = np.flatnonzero(head[inner])
        size = np.diff(np.append(first, len(letters)))
        letters *= odd(int(size.max()), 0x9E3779B97F4A7C15)[np.arange(len(letters)) - np.repeat(first, size)]
        word = mix64(np.add.reduceat(letters, first) + size.astype(np.uint64))
        ends = np.cumsum([len(b) for b in blobs[i:j]])
        doc = np.searchsorted(ends, starts, "right")
        opens = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        n = np.diff(np.append(opens, len(word)))
        place = np.arange(len(word)) - np.repeat(opens, n)
        rows = doc[opens] + i
        key[rows] = mix64(np.add.reduceat(word * odd(int(n.max()), 0x8CB92BA72F3D8DD7)[place], opens) + n.astype(np.uint64))

        def shingles(width: int) -> tuple[np.ndarray, np.ndarray]:
            """Hashes of shingles, and the place among ``opens`` of the text of each; a text with fewer words is one."""
            h = word * odd(width, 0xD6E8FEB86659FD93)[0]
            left = np.repeat(n, n) - place  # words from here on
            for k in range(1, width):
                h[:-k] += np.where(left[:-k] > k, word[k:] * odd(width, 0xD6E8FEB86659FD93)[k], np.uint64(0))
            keep = (left >= width) | (place == 0)
            return mix64(h[keep]), np.repeat(np.arange(len(opens)), n)[keep]

        h, of = shingles(hashed)
        fp[rows] = majority(h, np.searchsorted(of, np.arange(len(opens))))
        h, of = shingles(words)
        both = np.unique(of.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
        cuts = np.searchsorted(both, np.arange(len(opens) + 1).astype(np.uint64) << np.uint64(32))
        low = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
        for r, a, b in zip(rows.tolist(), cuts, cuts[1:]):
            sets[r] = low[a:b].tobytes()
    return key, fp, sets


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of hashes, sorted, share so large a part of all their members."""
    n, m = len(a) // 4, len(b) // 4
    if min(n, m) < similarity * max(n, m):
        return False
    both = np.concatenate([np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same >= similarity * (n + m - same)


def paired_at(radius: int, shards: int | None = None):
    """Whether a key is the one, of all variants that two fingerprints meet on, at which they are paired; ``shards`` make no difference.

    That is in the first half with few enough differences, the lesser version of it with the lower half of these flipped.
    """
    reach = (radius // 2 + 1) // 2

    def own(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = np.uint64(0xFFFFFFFF)
        part = (np.bitwise_count((a ^ b) & low) > 2 * reach).astype(np.uint64)
        a, b = (x >> (np.uint64(32) * part) & low for x in (a, b))
        value, differ = np.minimum(a, b), a ^ b
        n = np.bitwise_count(differ) // 2
        for k in range(reach):
            bit = differ & (~differ + np.uint64(1))
            value = np.where(k < n, value ^ bit, value)
            differ = differ ^ bit
        return mix64(value + ((part + np.uint64(1)) << np.uint64(32))) == keys

    return own


def _flips(reach: int) -> np.ndarray:
    """Masks of all ways to flip up to ``reach`` of 16 bits."""
    return np.array([sum(1 << b for b in c) for k in range(reach + 1) for c in combinations(range(16), k)], np.uint64)


def variants(place: np.ndarray, own: np.ndarray, reach: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the variants and the fingerprint of each, in parts of some ``most`` that share no key.

    place: the number of a half, above 16 bits that the variants' upper quarter has there; what
    flips have led to it leaves the others to the lower quarter.
    """
    sixteen, low = np.uint64(16), np.uint64(0xFFFF)
    masks = [_flips(k) for k in range(reach + 1)]
    order = np.argsort(place, kind="stable")
    place, own = place[order], own[order]
    part = place >> sixteen
    half = own >> (part << np.uint64(5)) & np.uint64(0xFFFFFFFF)
    left = reach - np.bitwise_count(half >> sixteen ^ place & low).astype(np.int64)
    base = (half & low | (place & low) << sixteen) + ((part + np.uint64(1)) << np.uint64(32))
    n = np.array([len(m) for m in masks])[left]
    opens = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    size = np.add.reduceat(n, opens) if len(opens) else opens
    ends, begin = np.append(opens[1:], len(place)), 0
    while begin < len(opens):
        end, made = begin + 1, int(size[begin])
        while end < len(opens) and made + size[end] <= most:
            made, end = made + int(size[end]), end + 1
        rows = np.arange(opens[begin], ends[end - 1])
        turns, step = -(-made // most), max(1, most // len(masks[-1]))  # a place of more is made again in each turn, which keeps a part of the keys
        for turn in range(turns):
            out = []
            for i in range(0, len(rows), step):
                for k, flips in enumerate(masks):
                    at = rows[i : i + step]
                    at = at[left[at] == k]
                    keys, of = mix64((base[at][:, None] ^ flips).ravel()), np.repeat(own[at], len(flips))
                    here = keys % np.uint64(turns) == turn if turns > 1 else slice(None)
                    out.append((keys[here], of[here]))
            yield tuple(np.concatenate(x) for x in zip(*out))
        begin = end


def colliding(fps: DataFrame, scratch: Scratch, radius: int, most: int = 8, waves: int = WAVES) -> tuple[DataFrame, DataFrame]:
    """u, v: pairs of fingerprints (``fp``, distinct) within ``radius`` bits that meet on variants of a half, each once; of many that meet, each with a first one. What is left of these sets, for ``rest``.

    One of two halves has at most half of the differences; its two versions meet on a value at half
    their distance. Variants of one upper quarter go to one task, so that a fingerprint is shuffled
    once for all of them, and the task flips the lower quarter. That is done in waves, so that only a
    part of the rows is on disk at once.
    """
    shards = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = (radius // 2 + 1) // 2

    def emit(wave: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, n, masks = [], 0, _flips(reach)
            mixed = mix64(np.arange(1, (2 << 16) + 1, dtype=np.uint64))
            for b in slices(batches, 1024):
                own = b.column(0).to_numpy().view(np.uint64)
                for part in (0, 1):
                    place = ((own >> np.uint64(32 * part + 16) & np.uint64(0xFFFF))[:, None] ^ masks).ravel() + np.uint64(part << 16)
                    deal = mixed[place]
                    at = np.flatnonzero(deal % np.uint64(waves) == wave)
                    found.append((deal[at] & ~np.uint64(0xFFFFFFFF) | place[at], own[at // len(masks)]))
                    n += len(at)
                    if n >= FLUSH:
                        yield packed(found, shards, ["shard", "keys"], [])
                        found, n = [], 0
            if n:
                yield packed(found, shards, ["shard", "keys"], [])

        return work

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        place, own, _ = unpacked(batches, False)
        for keys, of in variants(place & np.uint64(0xFFFFFFFF), own, reach, MADE):
            yield keys, of, of

    # dealt by a hash of its own: by fp itself it would be the grouping's exchange, which is coalesced to a few tasks for its few bytes
    spread, out = fps.select("fp").repartition(shards, F.xxhash64("fp")), []
    for wave in range(waves):
        met = scratch.put(meetings(spread.mapInArrow(emit(wave), "shard int, keys binary"), shards, most, radius, hashes=False, middle=False, own=paired_at(radius), read=read))
        out.append(met)
    met = scratch.put(reduce(DataFrame.unionByName, out))
    for wave in out:
        scratch.drop(wave)
    return pairs_of(met), sets_of(met)


def similar_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = 0.8, words: int = 5, hashed: int = 2, radius: int = 9) -> DataFrame:
    """key and component_id, the smallest key that links reach, of each row; a link is a similarity of the sets of ``words``-word shingles.

    Texts of the same words in order are one. Each of those that share a fingerprint is verified
    against the first of them, and these against their nearest that collides. Then all that collide
    or share a fingerprint and aren't joined yet are verified: those of small sets, and of large
    ones each with its nearest and then all others.
    """
    if key.lower() == "component_id":
        raise ValueError(f"the key can't be named {key}")
    scratch = Scratch(df.sparkSession)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("members", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            node, fp, sets = shingle_sets(b.column(0).to_pylist(), hashed, words)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(sets, pa.binary())], ["key", "node", "fp", "members"])

    docs = scratch.put(df.select(F.col(text).alias("_text"), F.col(key).alias("_key")).mapInArrow(work, schema))
    nodes = scratch.put(docs.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "fp")).alias("x"), F.count("*").alias("n")).select("node", F.col("x.key").alias("low"), F.col("x.fp").alias("fp"), "n"))
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n_fp"))
    pairs, sets = colliding(firsts.select("fp"), scratch, radius)
    same = nodes.join(firsts.where("n_fp > 1"), "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    first = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    met = scratch.put(pairs.withColumn("apart", F.bit_count(F.col("u").bitwiseXOR(F.col("v")))).join(first("u"), "u").join(first("v"), "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"), "apart"))
    nearest = met.groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u")).select("u", "v")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "low"), "node").withColumnRenamed("node", "end")
        texts = scratch.put(docs.join(ends, (docs["node"] == ends["end"]) & docs["key"].eqNullSafe(ends["low"])).select("node", "members").dropDuplicates(["node"]))
        both = pairs.join(texts.select(F.col("node").alias("u"), F.col("members").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.select([0, 1]).filter(pa.array([alike(x, y, similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_()))

        links = scratch.put(both.select("u", "v", "a", "b").mapInArrow(keep, "u long, v long"))
        scratch.drop(texts)
        return links

    found = scratch.put(connected_components(verified(nearest.unionByName(same)), scratch))
    tried = scratch.put(nearest.unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    shared = firsts.where("n_fp > 1").select(F.col("fp").alias("u"), F.col("fp").alias("v"))

    def crossing(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
        """Pairs of nodes of the pairs of fingerprints whose labels differ; labels are compared first, so that large groups aren't crossed."""
        labels = labelled.select("fp", "label").distinct()
        end = lambda df, c: df.select(*[F.col(x).alias({"fp": c}.get(x, f"{c}_{x}")) for x in df.columns])
        apart = pairs.join(end(labels, "u"), "u").join(end(labels, "v"), "v").where("u_label <> v_label and (u <> v or u_label < v_label)")
        both = apart.join(end(labelled, "u"), ["u", "u_label"]).join(end(labelled, "v"), ["v", "v_label"])
        return both.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()

    large = not sets.isEmpty()
    for step in ("met", "nearest", "rest") if large else ("met",):
        labelled = scratch.put(nodes.join(found, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("label")))  # read several times
        if step == "met":
            wanted = pairs.unionByName(shared)
        else:
            wanted = rest(sets, labelled.select(F.col("fp").alias("one"), "label").distinct(), radius, paired_at(radius), step == "nearest")
        left = scratch.put(crossing(wanted, labelled).join(tried, ["u", "v"], "left_anti"))
        scratch.drop(labelled)
        if not left.isEmpty():
            found, tried = joined(found, verified(left), scratch), tried.unionByName(left)
    rooted = scratch.put(nodes.join(found, "node", "left").select("node", "low", "n", F.coalesce("component", "node").alias("root")))
    # ids only, so that the sets of shingles don't stay on disk while the result is in use
    return scratch.only(scratch.put(skewed_join(docs.select("key", "node"), _named(rooted), ["node"], "n", docs.count()).select(F.col("key").alias(key), "component_id")))
