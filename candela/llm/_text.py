"""Vectorised word splitting and hashing for Arrow batches of texts, and the shared-storage helper.

A word class is a table of 256 flags over UTF-8 bytes. The classes used here only ever name ASCII
delimiters, so a byte-wise split equals the code-point-wise one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def _flags(delimiters: list[int]) -> np.ndarray:
    out = np.ones(256, bool)
    out[delimiters] = False
    return out


#: `[^\x20\x09-\x0D]+`
SPACED = _flags([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, to be used with `LOWER`
ALNUM = _flags([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+` before lower-casing is the same set as ALNUM after it
KEEP = np.arange(256, dtype=np.uint8)
LOWER = KEEP.copy()
LOWER[65:91] += 32

#: Bytes of text that are handled at once, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 2 << 20


class Words:
    """Words of a slice of texts.

    vocab: distinct words (binary array); codes: index into vocab per word; at: offset of each
    row's first word, one more than rows; start, end: byte range of each word in `data`;
    row_at: offset of each row's first byte in `data`.
    """

    __slots__ = ("at", "codes", "data", "end", "row_at", "start", "vocab")

    def __init__(self, texts: pa.Array, flags: np.ndarray, lower: np.ndarray | None, cut: np.ndarray | None = None):
        """cut: a class for each byte; a word also ends between bytes of the classes 1 and 2."""
        offsets, data = buffers(texts)
        self.data, self.row_at = data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = flags[data]
        firsts = np.zeros(len(data) + 1, bool)
        firsts[offsets] = True
        if cut is not None and len(data) > 1:
            kinds = cut[data]
            firsts[1:-1] |= (kinds[:-1] + kinds[1:] == 3) & (kinds[:-1] > 0) & (kinds[1:] > 0)
        here, before = inside[1:], inside[:-1]
        start = np.flatnonzero(here & (firsts | ~before))
        end = np.flatnonzero(before & (firsts | ~here))
        self.start, self.end = start, end
        kept = data[inside[1:-1]]
        if lower is not None:
            kept = lower[kept]
        word_at = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=word_at[1:])
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(word_at), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        self.vocab = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.at = np.searchsorted(start, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word, equal on every machine."""
        return word_hashes(self.vocab, seed)[self.codes]

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the rows, from 0, and the bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_string(texts.type) and not pa.types.is_binary(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if off is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def word_hashes(vocab: pa.Array, seed: int = 0) -> np.ndarray:
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w, seed) for w in vocab.to_pylist()), U64, len(vocab))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    x = a * U64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of a sequence of word hashes, by doubling; len(h) - k + 1 of them.

    The value depends on the window's words and k alone. Windows across rows are the caller's to skip.
    """
    if len(h) < k:
        return np.zeros(0, U64)
    parts, power, size = [], h, 1
    rest = k
    while True:
        if rest & 1:
            parts.append((size, power))
        rest >>= 1
        if not rest:
            break
        power = pair(power[:-size], power[size:])
        size *= 2
    n, at, out = len(h) - k + 1, 0, None
    for width, values in reversed(parts):
        piece = values[at : at + n]
        out = piece if out is None else pair(out, piece)
        at += width
    return mix(out ^ U64(k))


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold at most about `limit` bytes, or one row."""
    at = None
    for batch in batches:
        if at is None:
            at = batch.schema.get_field_index(column)
        offsets, _ = buffers(batch.column(at))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow under batches small enough for a Python worker of a few hundred MB."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(f, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where unset in local mode as in tests, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if not at:
        import atexit
        import shutil
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="candela-")
        atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Tables written by this driver and not yet cleared.
TABLES: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete the tables that operators have written so far, once their results have been written; how many there were."""
    n = len(TABLES)
    while TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    small: few rows beside the input, from many tasks; they are dealt out to as many files as cores.
    Files are what writing costs most there: each makes a local file system start a process.
    """
    spark = df.sparkSession
    if small:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/candela/{name}-{uuid.uuid4().hex}"
    TABLES.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieve(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose value may be among the keys (one column of the same type): all that are, and few others.

    Keys are marked in a bitmap of eight bits each or more, 16 MB at most, which is broadcast; beyond that
    more of the other rows pass. So a join with the keys afterwards has less to shuffle, and stays exact.
    """
    size = 1 << max(15, min(27, (8 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)) + 1
    at = place(F.col(keys.columns[0]))
    marks = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    bit = F.bitmap_bit_position(place(F.col(column)))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(place(F.col(column)))).join(F.broadcast(marks), "_bucket")
    return joined.where(F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1).select(*df.columns)


def renamed(df: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ..., so that none clashes with a name of our own, and the new names of `named`."""
    at = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*at.values()), [at[c] for c in named]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
