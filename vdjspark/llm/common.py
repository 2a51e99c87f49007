"""Helpers shared by the training-data operators: tables, checkpoints, text arrays."""

from __future__ import annotations

import atexit
import tempfile
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever file system Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables in the shared checkpoint folder, which cut lineage and outlive lost executors.

    ``put`` writes a DataFrame as Parquet and rereads it. ``drop`` deletes one of the tables
    earlier, ``only`` all but one; what is left goes when the process ends, as lazy results may
    still read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.paths = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", {}
        atexit.register(self.close)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")  # shuffle files go as soon as the table is written
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        if id(df) in self.paths:
            _delete(self.spark, self.paths[id(df)][0])

    def only(self, df: DataFrame) -> DataFrame:
        for _, out in list(self.paths.values()):
            if out is not df:
                self.drop(out)
        return df

    def close(self) -> None:
        try:
            _delete(self.spark, self.top)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass


def free_of(df: DataFrame, *names: str) -> None:
    """Raises a ValueError if the frame has one of the columns already that an operator adds or uses meanwhile."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")


def arrival(df: DataFrame) -> DataFrame:
    """Add ``_part`` and ``_row``, by which rows sort in the order of the table: by file and row of a stored one, else by partition and row."""
    try:
        out = df.select("*", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.row_index").alias("_row"))
        out.schema  # noqa: B018  only stored tables have these
        return out
    except AnalysisException:
        return df.select("*", F.lpad(F.spark_partition_id().cast("string"), 12, "0").alias("_part"), F.monotonically_increasing_id().alias("_row"))


HOT = 1000  # a key with more than one row in so many is joined by broadcast; there can't be more such keys


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int) -> DataFrame:
    """Inner join with a side that has each key once and the number ``n`` of its rows on the left, of ``rows`` in all.

    Keys with a large part of all rows, fewer than ``HOT``, are broadcast, so no task gets all rows of one.
    """
    hot = F.broadcast(right.where(F.col(n) * HOT > rows).drop(n))
    rest = left.join(F.broadcast(right.where(F.col(n) * HOT > rows).select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(right.where(F.col(n) * HOT <= rows).drop(n), on))


def fold_is(column: str, divisor: int, remainder: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``, is ``remainder``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor == remainder


LETTER_LIMIT = 0x30000  # letters above this plane don't exist in Unicode


@lru_cache(maxsize=1)
def scripts() -> tuple[np.ndarray, list[str]]:
    """For each code point the number of its script (0: no letter), and the scripts' names.

    A letter's script is the first word of its Unicode name: LATIN, CYRILLIC, CJK, HIRAGANA.
    """
    names, seen = [""], {}
    out = np.zeros(LETTER_LIMIT, np.uint16)
    for i in range(LETTER_LIMIT):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            name = unicodedata.name(c, "OTHER").split()[0]
            if name not in seen:
                seen[name] = len(names)
                names.append(name)
            out[i] = seen[name]
    return out, names


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line end, and where each begins (with the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = "\n".join(texts) + "\n" if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def mix32(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit keys, in place."""
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h


def slices(batches, rows: int = 256):
    """Arrow batches in slices, so that few texts at once are Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def in_chunks(texts: list[str], most: int):
    """Slices of a list of texts that hold ``most`` characters, or one text that is longer."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def odd(n: int, seed: int) -> np.ndarray:
    """Odd multipliers of the places 0 to n - 1."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


@lru_cache(maxsize=1)
def _spread() -> np.ndarray:
    """For each byte its bits as the bytes of a word, lowest first, so that sums of up to 255 count all of them at once."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


def majority(h: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """For each run of ``h`` the bits that are set in over half of it; opens: where runs begin."""
    size = np.diff(np.append(opens, len(h)))
    parts = -(-size // 255)
    begins = np.cumsum(parts) - parts
    at = np.repeat(opens, parts) + 255 * (np.arange(parts.sum()) - np.repeat(begins, parts))
    out = np.zeros((len(opens), 8), np.uint8)
    for k in range(8):
        sums = np.add.reduceat(_spread()[(h >> np.uint64(8 * k)) & np.uint64(255)], at)
        on = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), begins, axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * on > size[:, None], axis=1, bitorder="little").ravel()
    return out.view("<u8").ravel().astype(np.uint64)
