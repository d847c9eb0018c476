"""Fill-in-the-middle training texts, cut at units found by word-parallel arithmetic on UTF-8.

A unit is a run of other characters with the white space before it, or white space at the end of a text. The texts of a
batch lie in one buffer, each from an eighth byte on and followed by at least one blank, and the buffer is read as 64-bit
words. Seven-bit sums mark the white space of eight bytes at once; a byte ends a unit if it is no white space and the next
one is. ``bitwise_count`` of the marks and a running sum say in which word the k-th end lies, and clearing lowest marks
finds its byte in the word. Characters are counted the same way, from the marks of continuation bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftline.llm.common import chunked, text_bytes

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def _at_least(low: np.ndarray, byte: int) -> np.ndarray:
    """Marks the bytes (below 128 each) that are ``byte`` or more; the sums never carry into the next byte."""
    return low + _ONES * np.uint64(128 - byte)


def blanks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a blank or one of 9 to 13."""
    low = words & _LOW
    return (_at_least(low, 9) & ~_at_least(low, 14) | _at_least(low, 32) & ~_at_least(low, 33)) & ~words & _HIGH


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as 64-bit words, and the first word of each text (one more entry than texts)."""
    size = np.diff(offsets)
    first = np.r_[0, np.cumsum(size // 8 + 1)]
    out = np.full(8 * first[-1], 32, np.uint8)
    raw, at = data.tobytes(), offsets.tolist()
    view = memoryview(out)
    for k, w in enumerate(first[:-1].tolist()):
        view[8 * w : 8 * w + at[k + 1] - at[k]] = raw[at[k] : at[k + 1]]
    return out.view("<u8"), first


def unit_ends(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks the last byte of every unit."""
    blank = blanks(words)
    after = blank >> np.uint64(8)
    after[:-1] |= blank[1:] << np.uint64(56)
    after[-1:] |= np.uint64(1 << 63)
    ends = ~blank & after & _HIGH
    last = 8 * first[:-1] + size - 1
    byte = np.uint64(0x80) << ((last & 7) * 8).astype(np.uint64)
    closing = (size > 0) & (blank[np.maximum(last, 0) >> 3] & byte > 0)
    ends[last[closing] >> 3] |= byte[closing]
    return ends


def select(ends: np.ndarray, running: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The byte of the mark with each rank (from 1); ``running`` are the marks of all words up to and with each."""
    word = np.searchsorted(running, rank)
    marks = ends[word]
    left = rank - (running[word] - np.bitwise_count(marks))
    for k in range(1, 8):
        marks = np.where(left > k, marks & (marks - np.uint64(1)), marks)
    lowest = marks & (~marks + np.uint64(1))
    return 8 * word + np.bitwise_count(lowest - np.uint64(1)) // 8


def characters(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the continuation bytes and their running sum before each word."""
    marks = words & ~(words << np.uint64(1)) & _HIGH
    return marks, np.r_[0, np.cumsum(np.bitwise_count(marks), dtype=np.int64)]


def _before(marks: np.ndarray, running: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Marks in all bytes before each place."""
    word, inside = byte >> 3, ((byte & 7) * 8).astype(np.uint64)
    part = np.append(marks, np.uint64(0))[word] & ((np.uint64(1) << inside) - np.uint64(1))
    return running[word] + np.bitwise_count(part)


def _arranged(batches: Iterator[pa.RecordBatch], rate: int, spm: int, marker: tuple[str, str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in marker)
    for batch in chunked(batches, "_text"):
        data, offsets = text_bytes(batch.column("_text"))
        size = np.diff(offsets)
        words, first = layout(data, offsets)
        ends = unit_ends(words, first, size)
        running = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
        before = np.r_[0, running][first]
        n = np.diff(before)
        h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
        start = 8 * first[:-1]

        def cut(units: np.ndarray) -> np.ndarray:
            at = start.copy()
            some = units > 0
            at[some] = select(ends, running, (before[:-1] + units)[some]) + 1
            return at

        one, two = h[0] % (n + 1), h[1] % (n + 1)
        a, b = cut(np.minimum(one, two)), cut(np.maximum(one, two))
        marks, sums = characters(words)
        chars = lambda u, v: v - u - (_before(marks, sums, v) - _before(marks, sums, u))
        prefix, middle = chars(start, a), chars(a, b)
        raw, plain = words.tobytes(), (size == 0) | (h[2] % 100 >= rate)
        forms, texts = [], []
        for k, (u, v, w, z) in enumerate(zip(start.tolist(), a.tolist(), b.tolist(), (start + size).tolist())):
            text = raw[u:z]
            if plain[k] or p in text or s in text or m in text:
                plain[k] = True
                forms.append("plain")
                texts.append(text)
            elif h[3][k] % 100 < spm:
                forms.append("spm")
                texts.append(b"".join((s, raw[w:z], p, raw[u:v], m, raw[v:w])))
            else:
                forms.append("psm")
                texts.append(b"".join((p, raw[u:v], s, raw[w:z], m, raw[v:w])))
        yield pa.RecordBatch.from_arrays([
            batch.column("_key"), pa.array(n), pa.array(forms), pa.array(prefix, mask=plain), pa.array(middle, mask=plain),
            pa.array(texts, pa.binary()),
        ], schema=schema)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM,
                   marker: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """One row per row of ``docs``: key, n (units), form, prefix_chars, middle_chars, output.

    The draws are the first four groups of eight digits of the SHA-256 of ``seed:key``: two cuts between units, whether the
    text is rearranged (``rate`` in 100) and how (``spm`` in 100 of these with the suffix first). A null key counts as
    empty text there. Null texts are empty; empty texts and texts that hold a marker stay as they are (``plain``, no
    lengths). Rows that repeat a key get the same draws. An empty table gives no rows; other columns, whatever their
    names, are not read. Nothing is shuffled, and memory is bounded by the longest text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = docs.select(key).schema[0].dataType.simpleString()
    ddl = f"_key {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *draws)
    out = rows.mapInArrow(lambda batches: _arranged(batches, rate, spm, marker, schema), ddl)
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("_key", key)


def restored(output: Column, form: Column, marker: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text behind an output. No marker occurs in a rearranged text, so the first one found is the one put there."""
    p, s, m = marker

    def between(left: str, right: str | None) -> Column:
        rest = F.substring(output, F.locate(left, output) + F.lit(len(left)), F.length(output))
        return rest if right is None else F.substring(rest, F.lit(1), F.locate(right, rest) - 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
