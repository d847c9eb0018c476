"""Benchmark decontamination: an FM-index per training shard, searched backwards for the phrases of the test items.

Each task cuts its texts into shards of about a million words and indexes one after the other: suffix array over word
symbols, wavelet tree over the transform, sampled suffix positions. Every shard is indexed once and searched for all test
phrases, of which one part of bounded size is spread out at a time; occurrences are located on the unchanged text and
merged into removal spans. The texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import ALNUM, chunked, words_of
from driftline.llm.fm_index import FMIndex

PHRASE = 10
#: Bytes of text in one index. About 150 bytes of memory for each byte of text.
SHARD_BYTES = 2_500_000
#: Words of all windows in one part of the test items. A task spreads out one part after the other, and keeps eight bytes
#: for each word of the items themselves.
PASS_WORDS = 2_000_000

_SPREAD: dict = {}


def packed(items) -> dict:
    """Item ids, word hashes and the first word of each item; null has no words."""
    _, _, _, first, words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM)
    return {"names": [None if i is None else str(i) for i, _ in items], "words": words, "first": first}


def phrases_of(part: dict, width: int = PHRASE) -> dict:
    """Windows of the items by length: rows of word hashes, and the items of each row as two index arrays.

    A window is ``width`` consecutive words; an item of fewer, but not none, is one window.
    """
    names, words, first = part["names"], part["words"], part["first"]
    by: dict[int, tuple[list, list]] = {}
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        n = min(width, int(b - a))
        for at in range(a, b - n + 1) if n else ():
            rows, owners = by.setdefault(n, ([], []))
            rows.append(words[at : at + n])
            owners.append(k)
    out = {}
    for n, (rows, owners) in by.items():
        unique, inverse = np.unique(np.array(rows), axis=0, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        out[n] = unique, np.array(owners)[order], np.searchsorted(inverse[order], np.arange(len(unique) + 1))
    return {"names": names, "windows": out}


def spread(parts: list) -> Iterator[dict]:
    """The phrases of one part after the other; the last one stays for the next shard. ``parts``: name and broadcast."""
    for name, shared in parts:
        if _SPREAD.get("name") != name:
            _SPREAD.clear()
            _SPREAD.update(name=name, phrases=phrases_of(shared.value))
        yield _SPREAD["phrases"]


def hits(first: np.ndarray, words: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Per word whether an occurrence covers it, per text whether it has one, and the ids of the items found."""
    texts = len(first) - 1
    cover, some, found = np.zeros(len(words) + 1, np.int64), np.zeros(texts, bool), [set() for _ in range(texts)]
    if len(words):
        index = FMIndex(words, first)
        for phrases in spread(parts):
            for n, (rows, owners, at) in phrases["windows"].items():
                for phrase, word in index.occurrences(rows):
                    np.add.at(cover, word, 1)
                    np.add.at(cover, word + n, -1)
                    text = np.searchsorted(first, word, "right") - 1
                    some[text] = True
                    for t, p in {*zip(text.tolist(), phrase.tolist())}:
                        found[t].update(phrases["names"][k] for k in owners[at[p] : at[p + 1]].tolist())
    return np.cumsum(cover)[:-1] > 0, some, found


def merged(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of hit words: first word and the word after the last."""
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _searched(batches: Iterator[pa.RecordBatch], text: str, parts: list, clean: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, text, SHARD_BYTES):
        column = batch.column(batch.schema.get_field_index(text))
        low, starts, ends, first, words = words_of(column, ALNUM)
        hit, some, found = hits(first, words, parts)
        if clean:
            texts, keep = column.to_pylist(), np.ones(len(column), bool)
            todo = np.flatnonzero(some)
            for k in todo:
                texts[k] = _cut(texts[k].encode(), starts[first[k] : first[k + 1]] - _origin(column, k), ends[first[k] : first[k + 1]] - _origin(column, k), hit[first[k] : first[k + 1]])
            while len(todo):  # words that a cut brought together may be a phrase again
                part = pa.array([texts[k] for k in todo], pa.string())
                _, starts, ends, first, words = words_of(part, ALNUM)
                hit, some, found = hits(first, words, parts)
                for i, k in enumerate(todo):
                    a, b = first[i], first[i + 1]
                    keep[k] = a < b
                    if some[i]:
                        texts[k] = _cut(texts[k].encode(), starts[a:b] - _origin(part, i), ends[a:b] - _origin(part, i), hit[a:b])
                todo = todo[some]
            at = batch.schema.get_field_index(text)
            cleaned = pa.RecordBatch.from_arrays([pa.array(texts, schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)], schema=schema)
            yield cleaned.filter(pa.array(keep))
            continue
        rows = []
        for k in range(len(column)):
            a, b = first[k], first[k + 1]
            if not some[k]:
                rows.append((int(b - a), 0, [], []))
                continue
            spans = [{"first": int(x), "after": int(y)} for x, y in zip(*merged(hit[a:b]))]
            rows.append((int(b - a), int(hit[a:b].sum()), sorted(found[k] - {None}), spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(4))], schema=schema)


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without its hit words, from the start of the first to the end of the last of each run."""
    kept, last = [], 0
    for a, b in zip(*merged(hit)):
        kept.append(raw[last : starts[a]])
        last = ends[b - 1]
    return b"\n".join([*kept, raw[last:]]).decode()


def _origin(column: pa.Array, k: int) -> int:
    """Byte offset of text ``k`` in the buffer of the batch."""
    off = column.fill_null("").cast(pa.large_string())
    values = np.frombuffer(off.buffers()[1], np.int64)[off.offset : off.offset + len(off) + 1]
    return int(values[k] - values[0])


def _shared(items: DataFrame, item: str, text: str, pass_words: int) -> list:
    """The items in parts of bounded size, each broadcast under a name of its own."""
    context, parts, part, size = items.sparkSession.sparkContext, [], [], 0

    def close():
        parts.append((uuid.uuid4().hex, context.broadcast(packed(part))))

    for row in items.select(F.col(item), F.col(text)).toLocalIterator():
        part.append((row[0], row[1]))
        size += PHRASE * (row[1] or "").count(" ")
        if size > pass_words:
            close()
            part, size = [], 0
    close()
    return parts


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (found ids as sorted texts), spans of hit words.

    Words: runs of a-z (after lower-casing A-Z), 0-9 and characters beyond ASCII. A null text has none, an empty table
    gives no rows, rows that repeat or have no key each get their row; of both tables only key and text are read. Items
    that share an id count as one; an item without an id is searched for, but not listed. The corpus is read once, and
    the result does not depend on ``pass_words``.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    out = f"`{key}` {kind}, n_words long, n_hit long, items array<string>, spans array<struct<first:long,after:long>>"
    parts, arrow = _shared(items, item, item_text, pass_words), _arrow(docs.sparkSession, out)
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    return rows.mapInArrow(lambda batches: _searched(batches, "_text", parts, False, arrow), out)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 pass_words: int = PASS_WORDS) -> DataFrame:
    """``docs`` with every hit word span cut out of the text, a line break in its place, until no phrase is left.

    All phrases are located on the text as it is, then their spans are cut together, and what the cuts brought together
    is searched again, so the result does not depend on ``pass_words``. A text that the cuts leave without a word goes
    with its row; all other rows stay, with their other columns as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    parts, arrow = _shared(items, item, item_text, pass_words), to_arrow_schema(docs.schema)
    return docs.mapInArrow(lambda batches: _searched(batches, text, parts, True, arrow), docs.schema)
