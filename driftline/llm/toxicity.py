"""Toxicity by class-conditional Kneser-Ney models.

Both models share their backoff counts, so words that neither class knows weigh nothing. A text is described by the
difference of its two length-normalised log-likelihoods, over the whole text and over its most suspicious window; a
logistic curve fitted on rows that the models have not seen turns these into a score. Models and curve are learned from
a bounded sample of labelled rows and are small; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import ALNUM, chunked, words_of
from driftline.llm.kneser_ney import Model, grams
from driftline.llm.language_id import sample_per_label
from driftline.store import lookup

#: About so many labelled rows of each class are learned from; three of four for the models, the rest for the curve.
ROWS = 8_000
#: Words in the window of the second feature.
WINDOW = 1
THRESHOLD = 0.7


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        low, starts, ends, first, _ = words_of(batch.column("_text"), ALNUM)
        if not len(starts):
            continue
        key, _ = grams(low, starts, ends)
        label = np.repeat(np.repeat(batch.column("_label").to_numpy(), np.diff(first)), ends - starts + 1)
        for c in (0, 1):
            gram, n = np.unique(key[label == c], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n * (c == 0)), pa.array(n * (c == 1))], schema=schema)


def features(column: pa.Array, model: Model) -> np.ndarray:
    """Per text: mean log ratio, best window's mean log ratio, and whether it has words."""
    low, starts, ends, first, words = words_of(column, ALNUM)
    out = np.zeros((len(column), 3))
    n = np.diff(first)
    if not len(words):
        return out
    _, at, inverse = np.unique(words, return_index=True, return_inverse=True)
    both = model.score(low, starts[at], ends[at])
    ratio = (both[:, 1] - both[:, 0])[inverse]
    total = np.r_[0, np.cumsum(ratio)]
    some = n > 0
    heads = first[:-1][some]
    out[some, 0] = (total[first[1:]] - total[first[:-1]])[some] / n[some]
    text_end = np.repeat(first[1:], n)
    stop = np.minimum(np.arange(len(words)) + WINDOW, text_end)
    mean = (total[stop] - total[np.arange(len(words))]) / WINDOW  # a window cut short by the end counts the rest as neutral
    out[some, 1] = np.maximum.reduceat(mean, heads)
    out[some, 2] = 1
    return out


def _measured(batches: Iterator[pa.RecordBatch], model: Model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        f = features(batch.column("_text"), model)
        yield pa.RecordBatch.from_arrays([batch.column("_label"), *(pa.array(f[:, i]) for i in range(3))], schema=schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic curve by Newton's method; few columns, bounded rows."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS) -> dict:
    """Models and curve from the documents that ``labels`` marks 0 or 1; rows without such a label are not used."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    chosen = lookup(sample_per_label(known, "_label", "_key", rows))
    texts = docs.select(F.col(key).alias("_own"), F.col(text).alias("_text")).join(chosen, F.col("_own") == F.col("_key"))
    part = F.pmod(F.xxhash64(F.col("_own").cast("string"), F.lit("curve")), F.lit(4)) > 0
    ddl = "gram long, n0 long, n1 long"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    counts = texts.where(part).select("_label", "_text").mapInArrow(lambda b: _counted(b, arrow), ddl)
    table = counts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # bounded by the sample
    gram = table["gram"].to_numpy(np.int64)
    model = Model(gram, table[["n0", "n1"]].to_numpy(np.float64).reshape(-1, 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "y int, f0 double, f1 double, f2 double"
    measured_schema = to_arrow_schema(StructType.fromDDL(ddl))
    seen = texts.where(~part).select("_label", "_text").mapInArrow(lambda b: _measured(b, shared.value, measured_schema), ddl).toPandas()
    beta = logistic(seen[["f0", "f1", "f2"]].to_numpy(float), seen["y"].to_numpy(float)) if len(seen) else np.zeros(3)
    return {"model": model, "beta": beta, "base": float(seen["y"].mean()) if len(seen) else 0.0}


def score_texts(column: pa.Array, fitted: dict) -> np.ndarray:
    """Score of each text; one without words gets half the share of marked rows, as there is nothing to hold against it."""
    f = features(column, fitted["model"])
    value = 1 / (1 + np.exp(-np.clip(f @ fitted["beta"], -30, 30)))
    return np.where(f[:, 2] > 0, value, min(0.5, fitted["base"]) / 2)


def _scored(batches: Iterator[pa.RecordBatch], fitted: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column("_text"), fitted))], schema=schema)


def score(docs: DataFrame, fitted: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key and score (0 to 1).

    Null and empty texts are scored too. Rows that repeat each get their row, an empty table gives none; other columns,
    whatever their names, are not read. If nothing was learned every score is 0 or 0.5.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = docs.select(key).schema[0].dataType.simpleString()
    ddl = f"_key {kind}, score double"
    arrow, shared = to_arrow_schema(StructType.fromDDL(ddl)), docs.sparkSession.sparkContext.broadcast(fitted)
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return plain.mapInArrow(lambda batches: _scored(batches, shared.value, arrow), ddl).withColumnRenamed("_key", key)


def _passed(batches: Iterator[pa.RecordBatch], fitted: dict, text: str, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, text):
        keep = score_texts(batch.column(batch.schema.get_field_index(text)), fitted) < threshold
        yield batch.filter(pa.array(keep))


def drop_toxic(docs: DataFrame, fitted: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    return docs.mapInArrow(lambda batches: _passed(batches, shared.value, text, threshold), docs.schema)
