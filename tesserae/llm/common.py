"""Pieces that several operators share: table access, staged tables and byte-level hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D (fixed by the operators' contracts).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Stands for a null doc_id where rows are joined by it.
NO_ID = 2**63 - 1
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random odd 64-bit code per byte value, the base of the polynomial and its inverse modulo 2^64.
BYTE_CODE = (_rng.integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local folder, in local mode alone."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tesserae-")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: whatever was made from them has been staged itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unified(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the polynomial's high bits over all of them."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Polynomial prefix hashes of one byte buffer: the hash of any span costs two lookups."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up = powers(BASE, n + 1)
        terms = BYTE_CODE[data] * powers(BASE_INV, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all spans of n bytes, in order."""
        count = max(0, len(self.sums) - n)
        return (self.sums[n:] - self.sums[:count]) * self.up[:count]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of data[start:end] that depends on the content alone."""
        return (self.sums[end] - self.sums[start]) * self.up[start]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def words_of(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and the number of words of each text.

    Texts are hashed about a megabyte at a time, as the prefix sums take 32 bytes for each byte of text.
    """
    parts, own, size = [], [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= 1 << 20:
            parts.append(located_words(own, lower)[:2])
            own, size = [], 0
    parts.append(located_words(own, lower)[:2])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def located_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, ...]:
    """words_of(), and the start and end of each word in the texts joined by single spaces."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    gap = _IS_SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(sizes + 1)
    per = np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    return mix(Prefix(data).span(start, end)), per, start, end


def chunks(ids, texts, limit: int = 4 << 20):
    """Batches of (ids, encoded texts) of about limit bytes; null texts count as empty."""
    keep_i, keep_t, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        b = t.encode() if isinstance(t, str) else b""
        keep_i.append(i)
        keep_t.append(b)
        size += len(b)
        if size >= limit:
            yield keep_i, keep_t
            keep_i, keep_t, size = [], [], 0
    if keep_i:
        yield keep_i, keep_t


def release() -> None:
    """Gives memory that is no longer used back to the system: workers stay alive, beside an executor's heap, for whatever
    task comes next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """A function of batches that releases memory when it has ended."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def filter_places(key: np.ndarray, size: int) -> np.ndarray:
    """The bit of each key in a filter of 2^size bits."""
    return mix(key) >> np.uint64(64 - size)


def key_filter(keys: DataFrame, least: int = 20, most: int = 28) -> tuple[int, bytes]:
    """The size and the compressed bits of a bitmap of keys (column key, 64 bits): 16 bits a key, 2^most at most.

    It lets all keys pass and, up to 16 million keys, about one in sixteen others; with more keys more of the others pass, so
    what is decided after it must not rest on it. The pages are made by Spark; the driver joins them, 32 MB at most.
    """
    size = min(most, max(least, (16 * keys.count()).bit_length()))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"place": filter_places(pdf["key"].to_numpy(np.int64).view(np.uint64), size).astype(np.int64)})

    placed = keys.select("key").mapInPandas(run, "place long")
    pages = placed.groupBy(F.expr("place div 32768").alias("page")).agg(F.bitmap_construct_agg((F.col("place") % 32768).cast("long")).alias("bits")).collect()
    out = bytearray(2**size // 8)
    for p in pages:
        out[p.page * 4096 : p.page * 4096 + 4096] = p.bits
    return size, zlib.compress(bytes(out), 1)


class KeyFilter:
    """A key_filter() in a task."""

    def __init__(self, size: int, packed: bytes):
        self.size, self.bits = size, np.frombuffer(zlib.decompress(packed), np.uint8)

    def passes(self, key: np.ndarray) -> np.ndarray:
        place = filter_places(key.view(np.uint64), self.size)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
