"""Small helpers of the document operators: folds, stage tables, words as numpy arrays over Arrow buffers.

Words are never turned into Python strings: a batch of texts is one byte buffer, its words are start and end
offsets, and a word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftline.store import work_folder

CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_fold(key: str, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the key as text leaves ``fold``; a null key is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``box``, so that none can clash with the columns an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("box"))


def field(name: str) -> Column:
    return F.col("box").getField(name)


class Stages:
    """Tables written to the shared folder, so a lost executor costs a re-read; dropped one by one when done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{work_folder(self.spark)}/llm-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        path, _ = self.paths.pop(id(df))
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the ones with the smallest hash of the key: a repeatable bounded sample."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(rows)


# ---- words of a batch -------------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of a-z, 0-9 and everything beyond ASCII; to be applied after LOWER.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_TABLE = np.random.default_rng(20_011).integers(0, 2**64, 32 * 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunked(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def spans(low: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and per text the number of its first word (one more entry than texts)."""
    inside = member[low]
    if not len(inside):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    begins[heads] = inside[heads]
    ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """64-bit hash of every word: random table by place and byte, summed over the word."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), step):
        s, n = starts[a : a + step], ends[a : a + step] - starts[a : a + step]
        head = np.cumsum(n) - n
        k = np.arange(int(n.sum())) - np.repeat(head, n)
        byte = low[k + np.repeat(s, n)]
        value = _TABLE[(k & 31) << 8 | byte]
        if n.max() > 32:
            value = value * (2 * (k >> 5) + 1).astype(np.uint64)
        out[a : a + step] = np.add.reduceat(value, head) ^ (n.astype(np.uint64) << np.uint64(48))
    return mix(out)


def words_of(column: pa.Array, member: np.ndarray):
    """Lower-cased bytes, word starts, word ends, first word per text and word hashes of a text column."""
    buf, offsets = text_bytes(column)
    low = LOWER[buf]
    starts, ends, first = spans(low, offsets, member)
    return low, starts, ends, first, hashes(low, starts, ends)
