"""Language identification, words first: a known word scores by its log frequency per language, an unseen one by the
longest known character n-grams along it, falling back to shorter ones.

The model is fitted on a bounded sample of labelled rows and keeps all words and n-grams of it, so no language loses its
own to another. The sample bounds it, so it is sent to the executors whatever the size of the corpus; scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftline.llm.common import ALNUM, chunked, hashes, words_of

#: About so many labelled rows of each language are learned from.
ROWS = 4_000
LONGEST = 4
SMOOTH = 0.1
UNKNOWN = "und"  # fixed value: no text, or no letter in it


def sample_per_label(rows: DataFrame, label: str, key: str, about: int) -> DataFrame:
    """About ``about`` rows of each label, chosen by a hash of the key: counts first, then one filter; no group is gathered."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row per label
    if not counts:
        return rows.limit(0)
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000))
    share = F.coalesce(*[F.when(F.col(label) == v, F.lit(min(1_000_000, int(1_000_000 * about / n)))) for v, n in counts.items()])
    return rows.where(place < share)


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(label, word, n) of each chunk; words with a digit are left out."""
    for batch in chunked(batches, "_text"):
        low, starts, ends, first, words = words_of(batch.column("_text"), ALNUM)
        labels, code = np.unique(np.array(batch.column("_label").to_pylist(), object).astype(str), return_inverse=True)
        code = np.repeat(code, np.diff(first))
        order = np.lexsort((words, code))
        new = np.r_[True, (words[order][1:] != words[order][:-1]) | (code[order][1:] != code[order][:-1])][: len(order)]
        at = np.flatnonzero(new)
        raw = low.tobytes()
        rows = [(labels[code[k]], raw[starts[k] : ends[k]].decode("utf-8", "replace"), int(c)) for k, c in zip(order[at], np.diff(np.r_[at, len(order)]))]
        rows = [r for r in rows if r[1].isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)


def grams(word: Column, longest: int = LONGEST) -> Column:
    """All n-grams of the word between ``^`` and ``$``."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))

    def of(n: int) -> Column:  # a function of one argument: with a second one transform would pass the place
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))

    return F.flatten(F.array(*[F.filter(of(n), _as_long(n)) for n in range(1, longest + 1)]))


def _as_long(n: int):
    return lambda g: F.length(g) == n


def fit(rows: DataFrame, label: str, text: str) -> dict:
    """Log frequencies per language of all words and n-grams of labelled rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "label string, word string, n long"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    plain = rows.select(F.col(label).cast("string").alias("_label"), F.col(text).alias("_text"))
    counted = plain.mapInArrow(lambda batches: _counted(batches, arrow), ddl).groupBy("label", "word").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # bounded by the sample
    labels = sorted(found["label"].unique().to_pylist())
    if not labels:
        return {"labels": []}
    known, n = _table(found, labels)
    raw = [w.encode() for w in known]
    low = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    key = hashes(low, ends - [len(r) for r in raw], ends)
    order, freq = np.argsort(key), _log_frequency(n)
    cut = counted.select("label", F.explode(grams(F.col("word"))).alias("word"), "n").groupBy("label", "word").agg(F.sum("n").alias("n"))
    pieces, n = _table(cut.toArrow(), labels)
    length, value = np.array([len(g) for g in pieces]), np.empty(n.shape, np.float32)
    for k in range(1, LONGEST + 1):
        value[length == k] = _log_frequency(n[length == k])
    place = {g: i for i, g in enumerate(pieces)}
    return {"labels": labels, "key": key[order], "freq": freq[order], "grams": place, "gram_freq": value, "least": value.min(initial=0.0)}


def _table(found: pa.Table, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of (label, word, n) rows, and how often each stands in each label."""
    code = found["word"].combine_chunks().dictionary_encode()
    n = np.zeros((len(code.dictionary), len(labels)))
    column = np.searchsorted(np.array(labels, object), found["label"].to_numpy())
    n[code.indices.to_numpy(), column] = found["n"].to_numpy()
    return code.dictionary.to_pylist(), n


def _log_frequency(n: np.ndarray) -> np.ndarray:
    return np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * max(len(n), 1))).astype(np.float32)


def unseen(word: str, model: dict) -> np.ndarray:
    """Mean over the places of the word of the longest known n-gram that begins there."""
    marked, table = f"^{word.lower()}$", model["grams"]
    total, places = np.zeros(len(model["labels"]), np.float32), 0
    for i in range(len(marked)):
        for n in range(min(LONGEST, len(marked) - i), 0, -1):
            found = table.get(marked[i : i + n])
            if found is not None:
                total = total + model["gram_freq"][found]
                break
        else:
            total = total + model["least"]
        places += 1
    return total / places


def _scored(batches: Iterator[pa.RecordBatch], model: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    labels = model["labels"]
    for batch in chunked(batches, "_text"):
        column = batch.column("_text")
        low, starts, ends, first, words = words_of(column, ALNUM)
        ascii_letter = np.r_[0, np.cumsum((low >= 97) & (low <= 122))]
        offsets = np.r_[0, np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in column])]
        letters = (np.diff(ascii_letter[offsets]) > 0).tolist()
        letters = [a or (t.is_valid and any(c.isalpha() for c in t.as_py())) for a, t in zip(letters, column)]
        names, scores = [UNKNOWN] * len(column), np.zeros(len(column))
        if labels:
            key, at, inverse = np.unique(words, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(model["key"], key), len(model["key"]) - 1)
            known = model["key"][place] == key if len(key) else np.zeros(0, bool)
            value = model["freq"][place]
            raw = low.tobytes()
            for k in np.flatnonzero(~known):
                word = raw[starts[at[k]] : ends[at[k]]].decode("utf-8", "replace")
                value[k] = unseen(word, model) if any(c.isalpha() for c in word) else 0
            text = np.repeat(np.arange(len(column)), np.diff(first))
            total = np.stack([np.bincount(text, value[inverse, j], len(column)) for j in range(len(labels))], axis=1)
            best = total.argmax(axis=1)
            likely = np.exp(total - total.max(axis=1, keepdims=True))
            sure = 1 / likely.sum(axis=1)
            for k, ok in enumerate(letters):
                if ok:
                    names[k], scores[k] = labels[best[k]], sure[k]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], schema=schema)


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score (share of the best language, 0 to 1).

    A null text and one without a letter give ``und`` with score 0, and so does everything if nothing was learned; ties go
    to the first language by name. Rows that repeat each get their row, an empty table gives none; other columns,
    whatever their names, are not read. Texts are scored whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = docs.select(key).schema[0].dataType.simpleString()
    ddl = f"_key {kind}, lang_pred string, score double"
    arrow, shared = to_arrow_schema(StructType.fromDDL(ddl)), docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return plain.mapInArrow(lambda batches: _scored(batches, shared.value, arrow), ddl).withColumnRenamed("_key", key)
