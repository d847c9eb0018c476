"""Quality by cumulative-link regression on graded ratings.

A text is a sparse vector of hashed words, hashed token shapes and a few ratios. One weight vector gives its latent
quality, ordered thresholds cut the latent line into grades: P(grade > k) = logistic(latent - threshold k). Weights and
thresholds are learned together from a bounded sample of rated rows, by rounds of local steps on every partition whose
results are averaged; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import ALNUM, LOWER, SPACED, Stages, chunked, hashes, spans, text_bytes
from driftline.store import lookup

#: About so many rated rows are learned from, in so many parts.
ROWS, PARTS = 20_000, 8
#: Hashed slots: the first half for words, the second for token shapes; the ratios follow.
SLOTS = 1 << 14
RATIOS = 8
ROUNDS, EPOCHS, STEP, RIDGE, MINI = 6, 2, 0.3, 1e-5, 64

_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = ord("A"), ord("a"), ord("0")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: first entry per text, slots, values. Counts are damped, and words and shapes have length 1 each."""
    buf, offsets = text_bytes(column)
    low, texts = LOWER[buf], len(column)
    starts, ends, first = spans(low, offsets, ALNUM)
    words = hashes(low, starts, ends)
    t_starts, t_ends, t_first = spans(buf, offsets, SPACED)
    shape = _SHAPE[buf]
    ending = [shape[np.maximum(t_ends - k, t_starts)] for k in (1, 2, 3)]
    shapes = (((shape[t_starts].astype(np.uint64) * np.uint64(257) + ending[0]) * np.uint64(257) + ending[1]) * np.uint64(257)) + ending[2]
    half = SLOTS // 2
    parts = [(words % np.uint64(half), first, 0), (shapes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40), t_first, half)]
    rows, slots, values = [], [], []
    for code, at, base in parts:
        text = np.repeat(np.arange(texts), np.diff(at))
        key, n = np.unique(text * half + (code % np.uint64(half)).astype(np.int64), return_counts=True)
        value = np.log1p(n)
        own = key // half
        norm = np.sqrt(np.bincount(own, value * value, texts))
        rows.append(own)
        slots.append(key % half + base)
        values.append(value / norm[own])
    n_words, n_tokens, n_bytes = np.diff(first), np.diff(t_first), np.diff(offsets)
    text = np.repeat(np.arange(texts), n_words)
    same = np.r_[False, (words[1:] == words[:-1]) & (text[1:] == text[:-1])][: len(words)]
    distinct = np.bincount(np.unique(np.stack([text.astype(np.uint64), words], 1), axis=0)[:, 0].astype(np.int64), minlength=texts) if len(words) else np.zeros(texts)
    of_byte = np.repeat(np.arange(texts), n_bytes)
    share = lambda mask: np.bincount(of_byte[mask], minlength=texts) / np.maximum(n_bytes, 1)
    upper, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
    mark = (buf > 32) & (buf < 128) & ~ALNUM[low]
    ratios = np.stack([
        np.ones(texts), np.log1p(n_words) / 8, np.log1p(n_tokens) / 8, distinct / np.maximum(n_words, 1),
        np.bincount(text[same], minlength=texts) / np.maximum(n_words, 1), share(upper) * 4, share(digit) * 4, share(mark) * 4,
    ], axis=1)
    rows.append(np.repeat(np.arange(texts), RATIOS))
    slots.append(np.tile(np.arange(RATIOS) + SLOTS, texts))
    values.append(ratios.ravel())
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(texts + 1)), np.concatenate(slots)[order], np.concatenate(values)[order]


def latent(first: np.ndarray, slots: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[slots] * values, first[:-1]) if len(first) > 1 else np.zeros(0)


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then the logarithms of the gaps."""
    return np.cumsum(np.r_[free[:1], np.exp(free[1:])])


def tails(value: np.ndarray, free: np.ndarray) -> np.ndarray:
    """P(grade > k) for every k but the last grade."""
    return 1 / (1 + np.exp(-np.clip(value[:, None] - thresholds(free)[None, :], -30, 30)))


def gradients(value: np.ndarray, grade: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood, by the latent value of each row and by the free numbers of the thresholds."""
    k, rows = len(free), np.arange(len(value))
    over = tails(value, free)
    upper = np.c_[np.ones(len(value)), over][rows, grade]  # P(grade >= y)
    lower = np.c_[over, np.zeros(len(value))][rows, grade]  # P(grade > y)
    chance = np.maximum(upper - lower, 1e-9)
    by_cut = np.zeros(k)
    np.add.at(by_cut, grade[grade < k], (lower * (1 - lower) / chance)[grade < k])
    np.add.at(by_cut, grade[grade > 0] - 1, -(upper * (1 - upper) / chance)[grade > 0])
    after = np.cumsum(by_cut[::-1])[::-1]  # a gap moves every later threshold
    return 1 - upper - lower, np.r_[after[:1], after[1:] * np.exp(free[1:])]


def _local(batches: Iterator[pa.RecordBatch], start: np.ndarray, size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Some epochs of adaptive steps over the rows of one partition of the bounded sample."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    table = pa.Table.from_batches(kept).combine_chunks()
    grade = table["grade"].to_numpy()
    slots, values = table["slots"].chunk(0), table["vals"].chunk(0)
    first, slot, value = slots.offsets.to_numpy(), slots.values.to_numpy(), values.values.to_numpy()
    state, power, draw = start.copy(), np.full(len(start), 1e-3), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for pick in np.array_split(draw.permutation(len(grade)), max(1, len(grade) // MINI)):
            n = first[pick + 1] - first[pick]
            at = np.repeat(first[pick], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            own = np.r_[0, np.cumsum(n)]
            by_row, by_cut = gradients(latent(own, slot[at], value[at], state[:size]), grade[pick], state[size:])
            step = np.zeros(len(state))
            step[:size] = np.bincount(slot[at], np.repeat(by_row, n) * value[at], size) / len(pick) - RIDGE * state[:size]
            step[size:] = by_cut / len(pick)
            power += step * step
            state = state + STEP * step / np.sqrt(power)
    yield pa.RecordBatch.from_arrays([pa.array([len(grade)], pa.int64()), pa.array([state.tobytes()], pa.binary())], names=["n", "state"])


def _featured(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        first, slots, values = features(batch.column("_text"))
        yield pa.RecordBatch.from_arrays([
            batch.column("_grade"), pa.ListArray.from_arrays(first.astype(np.int32), slots.astype(np.int32)),
            pa.ListArray.from_arrays(first.astype(np.int32), values.astype(np.float32)),
        ], schema=schema)


def fit(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "rating", rows: int = ROWS) -> dict:
    """Weights and ordered thresholds from the documents that ``ratings`` grades; the grades are its distinct values in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    rated = ratings.select(F.col(key).alias("_key"), F.col(rating).alias("_rating")).where("_key is not null and _rating is not null")
    counts = rated.groupBy("_rating").count().orderBy("_rating").collect()  # a row per grade
    grades, total = [r[0] for r in counts], sum(r[1] for r in counts)
    size = SLOTS + RATIOS
    if len(grades) < 2:
        return {"grades": grades, "weights": np.zeros(size), "free": np.zeros(max(len(grades) - 1, 0))}
    code = F.coalesce(*[F.when(F.col("_rating") == g, F.lit(i)) for i, g in enumerate(grades)])
    place = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit("rated")), F.lit(1_000_000))
    chosen = lookup(rated.where(place < min(1_000_000, max(1, int(1_000_000 * rows / total)))).select("_key", code.alias("_grade")))
    ddl = "grade int, slots array<int>, vals array<float>"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    texts = docs.select(F.col(key).alias("_own"), F.col(text).alias("_text")).join(chosen, F.col("_own") == F.col("_key"))
    sample = stages.write(texts.select("_grade", "_text").mapInArrow(lambda b: _featured(b, arrow), ddl).repartition(PARTS))
    above = np.array([sum(r[1] for r in counts[i + 1 :]) / total for i in range(len(grades) - 1)])
    cuts = -np.log(above / (1 - above))
    state = np.r_[np.zeros(size), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))]
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state)
        found = sample.mapInArrow(lambda b, shared=shared, number=number: _local(b, shared.value, size, number), "n long, state binary").collect()
        if not found:
            break
        state = np.average([np.frombuffer(r["state"]) for r in found], axis=0, weights=[r["n"] for r in found])
    stages.drop(sample)
    return {"grades": grades, "weights": state[:size], "free": state[size:]}


def _scored(batches: Iterator[pa.RecordBatch], fitted: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        over = tails(latent(*features(batch.column("_text")), fitted["weights"]), fitted["free"])
        k = over.shape[1]
        values = np.array([float(g) for g in fitted["grades"]]) if fitted["grades"] else np.zeros(1)
        expected = values[0] + over @ np.diff(values)
        share = -np.diff(np.c_[np.ones(len(over)), over, np.zeros(len(over))], axis=1)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(expected), pa.ListArray.from_arrays(np.arange(0, over.size + 1, max(k, 1), dtype=np.int32) if k else np.zeros(len(over) + 1, np.int32), over.ravel()),
            pa.array(values[share.argmax(axis=1)]),
        ], schema=schema)


def grade(docs: DataFrame, fitted: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, expected_grade, tails (chance to be above each grade but the last), likely_grade.

    Null and empty texts are graded as texts without words. Ties go to the lower grade. Rows that repeat each get their
    row, an empty table gives none; other columns, whatever their names, are not read. With fewer than two grades in the
    ratings every row gets that grade, or 0, and no tails.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = docs.select(key).schema[0].dataType.simpleString()
    ddl = f"_key {kind}, expected_grade double, tails array<double>, likely_grade double"
    arrow, shared = to_arrow_schema(StructType.fromDDL(ddl)), docs.sparkSession.sparkContext.broadcast(fitted)
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return plain.mapInArrow(lambda batches: _scored(batches, shared.value, arrow), ddl).withColumnRenamed("_key", key)
