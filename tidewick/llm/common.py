"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of one Arrow batch; whole texts travel in it, so it bounds a worker's memory.
BATCH_ROWS = 512

#: A key of more rows than one in so many is heavy; there are fewer than so many, whatever the size of a table.
HEAVY = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only where none is named and all runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder, so that a lost executor costs nothing before it.

    Shuffle files of the work go when it is written. Lineage ends here; free() deletes the table again.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)



def free(*tables: DataFrame) -> None:
    """Deletes stored() tables of which no plan is left that will still read them."""
    spark = tables[0].sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = folder(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, made of names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fold(doc_id: int) -> int:
    """The fold that the contracts deal by: crc32 of the id as text, mod 4."""
    return zlib.crc32(str(doc_id).encode()) % 4


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


# -- hashing of symbol sequences with numpy ---------------------------------------------------------

def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_ONE, _TWO, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair, not linear in either."""
    h = a * _ONE
    h ^= h >> _HALF
    h += b
    h *= _TWO
    h ^= h >> _HALF
    return h


class Hashes:
    """64-bit hashes of ranges of a symbol array.

    A block of 2k symbols is the pair of its halves, so blocks of 1, 2, 4, ... symbols take one pass
    each. Any other range is that of up to three overlapping blocks. Bytes start with blocks of 8,
    which are their own value.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        self.blocks: dict[int, np.ndarray] = {}
        size, h = 1, symbols
        if symbols.dtype == np.uint8:
            n = max(len(symbols) - 7, 0)
            size, h = 8, np.ndarray((n,), "<u8", symbols.tobytes() if n else b"", strides=(1,)).copy() if n else np.zeros(0, np.uint64)
        self.blocks[size] = h
        while 2 * size <= longest:
            h = paired(h[:-size], h[size:]) if len(h) > size else h[:0]
            size *= 2
            self.blocks[size] = h

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k consecutive symbols."""
        size = max(x for x in self.blocks if x <= k)
        h = self.blocks[size]
        if size == k:
            return mixed(h)
        rest = k - size
        return mixed(paired(h[: max(len(h) - rest, 0)], h[rest:]))

    def ranges(self, start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
        """Hashes of the ranges start:end, all of `least` symbols or more and of at most three times its block."""
        size = max(x for x in self.blocks if x <= least)
        h, n = self.blocks[size], end - start
        mid = start + np.minimum(size, n - size)
        return mixed(paired(paired(h[start], h[mid]), h[end - size]) + n.astype(np.uint64))


def word_symbols(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word of a byte array, by a cryptographic hash of each distinct one."""
    ids, words = word_ids(data, first, last)
    table = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words.to_pylist()), np.uint64)
    return table[ids] if len(ids) else np.zeros(0, np.uint64)


def word_ids(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word of a byte array, equal for equal words, and the distinct words."""
    space = data == 32
    space |= (data >= 9) & (data <= 13)
    ends = np.r_[0, np.cumsum(last - first)]
    kind, of = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    words = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(ends.astype(of)), pa.py_buffer(data[~space])]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word of a UTF-8 byte array."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    body = inside[1:-1]
    body[data == 32] = False
    body[(data >= 9) & (data <= 13)] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(a)
    if n < w:
        return a[:0]
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(a.dtype).max, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(grams: np.ndarray, bounds: np.ndarray, win: int, k: int) -> tuple[np.ndarray, ...]:
    """Content-chosen anchors of all windows of `win` symbols, by the hashes of all k-grams.

    The symbols hold several documents, document i in bounds[i]:bounds[i + 1]. A window's anchor is its
    leftmost k-gram of least hash, so equal windows have equal anchors at equal offsets. Returned for
    each anchor: hash, document, position in the buffer, and the farthest and nearest window start
    that it serves, as distances to its left. At most 2**24 symbols at a time.
    """
    w = win - k + 1
    pos_bits = np.uint64(0xFFFFFF)
    key = (grams & ~pos_bits) | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_min(key, w) & pos_bits).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(chosen)]
    start = np.flatnonzero(np.arange(len(chosen)) + win <= bounds[doc + 1])
    if not len(start):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    at = chosen[start]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])])
    last = np.r_[first[1:], len(start)] - 1
    a = at[first]
    return grams[a], doc[start[first]], a, a - start[first], a - start[last]


def runs(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one index of each run of equal values."""
    if not len(groups):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return first, np.r_[first[1:], len(groups)]
