"""Packing by concatenating all documents and cutting: prefix sums give every document its place.

Pass one tokenizes each document once and writes its ids with the number of the input partition and the running token
count inside it. The totals of the partitions, one number each, are summed up in order; that is the only thing the
driver sees. Pass two reads the ids, knows the global place of every document and cuts it at multiples of the window.
A window that crosses from one partition into the next is marked as a boundary record; only those meet rows of another
partition when sequences are put together. All windows but the last are full.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import Stages, chunked

LENGTH = 1024
END = 0  # fixed value: the id that ends a document
SPECIAL = "<|endoftext|>"  # fixed value: the one text that the vocabulary takes as a special token

_LOADED: dict = {}


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None):
    """A function from text to ids. With the same vocabulary given as ranks, ordinary texts take a faster path to the
    same ids; a text that spells the special token, or that the faster path refuses, goes through the tokenizer file."""
    found = _LOADED.get((vocabulary, ranks, pattern))
    if found:
        return found
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    encode = plain
    if ranks:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> list[int]:
            if SPECIAL in text:
                return plain(text)
            try:
                return fast.encode_ordinary(text)
            except Exception:  # its regular expressions give up on some very long runs of one kind
                return plain(text)

    _LOADED[(vocabulary, ranks, pattern)] = encode
    return encode


def _tokenized(batches: Iterator[pa.RecordBatch], files: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encode, part, total = encoder(*files), TaskContext.get().partitionId(), 0
    for batch in chunked(batches, "_text"):
        ids = [np.array([*encode(t or ""), END], np.uint32) for t in batch.column("_text").to_pylist()]
        n = np.array([len(x) for x in ids])
        at = total + np.cumsum(n) - n
        total += int(n.sum())
        small = [x.astype(np.uint16) if x.max() < 65_536 else x for x in ids]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(at), pa.array(n),
            pa.array([x.tobytes() for x in small], pa.binary()),
        ], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], base: np.ndarray, length: int, with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield _cut_rows(batch.slice(at, 512), base, length, with_ids, schema)


def _cut_rows(batch: pa.RecordBatch, base: np.ndarray, length: int, with_ids: bool, schema: pa.Schema) -> pa.RecordBatch:
    part, inside, n = (batch.column(c).to_numpy() for c in ("part", "at", "n"))
    begin = base[part] + inside
    pieces = (begin + n - 1) // length - begin // length + 1
    row = np.repeat(np.arange(len(n)), pieces)
    sequence = begin[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.maximum(sequence * length - begin[row], 0)
    stop = np.minimum((sequence + 1) * length - begin[row], n[row])
    crc, raw = np.empty(len(row), np.int64), []
    last, ids = -1, None
    for k, (r, a, b) in enumerate(zip(row.tolist(), start.tolist(), stop.tolist())):
        if r != last:
            data = batch.column("ids")[r].as_buffer()
            ids, last = np.frombuffer(data, np.uint16 if data.size == 2 * n[r] else np.uint32).astype("<u4"), r
        piece = ids[a:b].tobytes()
        crc[k] = zlib.crc32(piece)
        raw.append(piece)
    first, after = base[part][row], base[part + 1][row]
    crosses = (sequence * length < first) | ((sequence + 1) * length > after) & (after < base[-1])
    columns = [
        batch.column(0).take(pa.array(row)), pa.array(start), pa.array(stop - start), pa.array(crc), pa.array(n[row]),
        pa.array(sequence), pa.array(begin[row] + start - sequence * length), pa.array(crosses),
    ]
    return pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if with_ids else columns, schema=schema)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id",
         text: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary, ids.

    Every row of ``docs`` gives its tokens and the end id, so a null or empty text is the end id alone; rows that repeat
    are packed each. An empty table gives no rows; other columns, whatever their names, are not read. The vocabulary
    files must be readable on every executor.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    ddl = "_key " + kind + ", part int, at long, n long, ids binary"
    arrow, files = to_arrow_schema(StructType.fromDDL(ddl)), (vocabulary, ranks, pattern)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    tokens = stages.write(rows.mapInArrow(lambda batches: _tokenized(batches, files, arrow), ddl))

    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n")).collect()  # a number per partition
    size = np.zeros(max([r["part"] for r in totals], default=-1) + 1, np.int64)
    for r in totals:
        size[r["part"]] = r["n"]
    base = spark.sparkContext.broadcast(np.r_[0, np.cumsum(size)])
    ddl = "_key " + kind + ", start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"
    ddl += ", ids binary" if with_ids else ""
    out = to_arrow_schema(StructType.fromDDL(ddl))
    return tokens.mapInArrow(lambda batches: _cut(batches, base.value, length, with_ids, out), ddl).withColumnRenamed("_key", key)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids of all its pieces in order (little-endian 32-bit), n_ids.

    A sequence has at most as many pieces as ids. Pieces must carry their ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", joined.alias("ids")).withColumn("n_ids", F.octet_length("ids") / 4)
