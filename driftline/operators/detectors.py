"""All detectors of a series in one pass over its rows, batch by batch.

The rows of a series reach a task in order, behind one row that lists what watches the series. A task holds one batch and,
per watching line, a few numbers that stand for all earlier rows, so neither the fact nor a series is ever held whole, and
only the rows with a warning leave it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftline.schema import LOW, PERSIST_ROWS, ROLLING_ROWS, Roles
from driftline.store import join_null_safe, lookup

_FOUND = (
    ("column", "string"), ("label", "string"), ("value", "double"), ("value__mean", "double"), ("value__std", "double"),
    ("value__diff", "double"), ("value__slope", "double"), ("z__up", "double"), ("out", "boolean"), ("typed", "boolean"),
    ("entry", "boolean"), ("_spec", "boolean"), ("_limit", "boolean"), ("warn", "boolean"), ("episode_id", "bigint"),
)
_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}


def warnings_of_series(
    df: DataFrame, series: DataFrame, watch: DataFrame, roles: Roles, over: Mapping[str, Column], k: float, h: float
) -> DataFrame:
    """The rows of ``df`` that carry a warning, once per line that warns.

    ``series``: the keys of every series; ``watch``: stratum -> ``_watch``, the lines that watch it; ``over``: measure ->
    whether the row's day exceeds its external limit.
    """
    own = list(dict.fromkeys([*roles.series, *roles.order]))
    rows = df.select(
        *own, F.array(*[F.col(m).cast("double") for m in roles.measures]).alias("_all"),
        F.array(*[F.coalesce(test, F.lit(False)) for test in over.values()]).cast("array<boolean>").alias("_over"), F.lit(False).alias("_head"))
    # the lines as text: an array of structs costs every row, however few have one
    heads = join_null_safe(series, lookup(watch), roles.stratum).withColumns({"_watch": F.to_json("_watch"), "_head": F.lit(True)})
    placed = rows.unionByName(heads, allowMissingColumns=True).repartition(*roles.series)
    ordered = placed.sortWithinPartitions(*roles.series, F.desc("_head"), *roles.order)
    kept = T.StructType([T.StructField(c, df.schema[c].dataType) for c in own])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` {t}" for c, t in _FOUND)])
    listed = list(over)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("_head").to_numpy(zero_copy_only=False))
            found = []
            for begin, end in zip([0, *heads + 1], [*heads, batch.num_rows]):
                if begin:  # behind a head
                    state = _Series(json.loads(batch.column("_watch")[begin - 1].as_py() or "[]"), listed, k, h)
                if begin < end:
                    found += state.warnings(batch.slice(begin, end - begin), own)
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    return ordered.mapInArrow(scan, schema)


def lowest(drift: np.ndarray, resets: np.ndarray, start: float = 0.0) -> np.ndarray:
    """Smallest value since the last reset; ``start`` is the smallest one before the first row."""
    first = int(resets[0]) if len(resets) else len(drift)
    out = drift.copy()
    np.fmin(np.fmin.accumulate(drift[:first]), start, out=out[:first])
    if len(resets) <= 1000:
        for a, b in zip(resets, [*resets[1:], len(drift)]):
            np.fmin.accumulate(drift[a:b], out=out[a:b])
        return out
    # minima over 1, 2, 4, ... rows back, as far as the last reset
    rest = out[first:]
    at = np.arange(len(rest))
    back = at - np.maximum.accumulate(np.where(np.isin(at, resets - first, assume_unique=True), at, 0))
    step = 1
    while step <= back.max():
        rest[step:] = np.where(back[step:] >= step, np.fmin(rest[step:], rest[:-step]), rest[step:])
        step *= 2
    return out


_NUMBERS = ("target", "sd", "threshold", "lsl", "usl", "upper")
_EMPTY = dict.fromkeys((*_NUMBERS, "rises", "direction", "run"))


class _Series:
    """What the rows of a series so far mean for the next ones."""

    def __init__(self, watch: Sequence[Mapping], over: Sequence[str], k: float, h: float):
        self.over, self.rows, self.before = over, 0, None
        self.lines = [_Line({**_EMPTY, **w}, k, h) for w in watch]

    def warnings(self, batch: pa.RecordBatch, own: Sequence[str]) -> list[pa.RecordBatch]:
        n = batch.num_rows
        values = np.asarray(batch.column("_all").flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)
        over = batch.column("_over").flatten().to_numpy(zero_copy_only=False).reshape(n, len(self.over))
        if self.before is None:
            self.before = np.full((ROLLING_ROWS - 1, values.shape[1]), np.nan)
        recent = np.concatenate([self.before, values])
        place = np.arange(self.rows + 1, self.rows + n + 1)
        self.before, self.rows = recent[n:], self.rows + n
        out = []
        for line in self.lines:
            late = over[:, self.over.index(line.column)] if line.column in self.over else None
            with np.errstate(all="ignore"):  # infinite values may meet, as in SQL
                hit, cells = line.warnings(np.ascontiguousarray(recent[:, line.idx]), place, late)
            if len(hit):
                rows = batch.select(list(own)).take(pa.array(hit))
                named = [(c, rows.column(c)) for c in own] + [(c, pa.array(cells[c], _ARROW[t])) for c, t in _FOUND]
                out.append(pa.RecordBatch.from_arrays([a for _, a in named], names=[c for c, _ in named]))
        return out


class _Line:
    """One line that watches a measure: its settings, and where its sums, runs and episodes stand."""

    def __init__(self, line: Mapping, k: float, h: float):
        line = {c: float(v) if c in _NUMBERS and v is not None else v for c, v in line.items()}
        self.k, self.h, self.line = k, h, line
        self.idx, self.column = line["idx"], line["column"]
        scaled = line["sd"] is not None and line["target"] is not None and not line["sd"] <= 0
        self.scale = (line["target"], line["sd"]) if scaled else None
        self.total, self.n, self.low = 0.0, 0, {"up": 0.0, "dn": 0.0}
        self.off = {"spec": 0, "risk": 0}
        self.warned, self.episodes = False, 0

    def warnings(self, recent: np.ndarray, place: np.ndarray, late: np.ndarray | None) -> tuple[np.ndarray, dict]:
        """Places of the warning rows in the batch, and their columns."""
        line, value = self.line, recent[ROLLING_ROWS - 1:]
        missing, ready = np.isnan(value), place >= ROLLING_ROWS
        up, dn = self._sums(value, missing)
        # Spark orders NaN above every number
        above, below = ~(up <= self.h), dn > self.h
        out, spec = None, np.zeros(len(value), bool)
        if line["run"] is not None:
            out = (value < line["lsl"]) | (value > line["usl"])
            spec = self._position("spec", out, place) == line["run"]
        entry = self._position("risk", ready & self._risky(value), place) == PERSIST_ROWS
        if line["type"] == "A":
            typed = above if line["rises"] else below
        elif line["type"] in ("B", "E"):
            typed = above | below
        elif line["type"] == "C" and line["label"]:
            typed = entry | (below if line["direction"] == LOW else above)
        else:
            typed = np.zeros(len(value), bool)
        over = np.zeros(len(value), bool) if late is None or line["upper"] is None else late & (value > line["upper"])
        warn = ready & (typed | spec | over)
        fresh = warn & ~np.concatenate([[self.warned], warn[:-1]])
        episode = self.episodes + np.cumsum(fresh)
        self.warned, self.episodes = bool(warn[-1]), int(episode[-1])

        hit = np.flatnonzero(warn)
        size = len(hit)
        cells = dict(zip(("value__mean", "value__std", "value__diff", "value__slope"), _rolling(recent, hit)))
        cells |= {
            "column": pa.repeat(pa.scalar(self.column, pa.string()), size), "label": pa.repeat(pa.scalar(line["label"], pa.string()), size),
            "value": pa.array(value[hit], mask=missing[hit]), "z__up": up[hit],
            "out": pa.nulls(size, pa.bool_()) if out is None else out[hit], "typed": typed[hit], "entry": entry[hit],
            "_spec": spec[hit], "_limit": over[hit], "warn": warn[hit], "episode_id": episode[hit],
        }
        return hit, cells

    def _risky(self, value: np.ndarray) -> np.ndarray:
        cut, direction = self.line["threshold"], self.line["direction"]
        if cut is None or direction is None:
            return np.zeros(len(value), bool)
        return value <= cut if direction == LOW else value >= cut

    def _position(self, name: str, flag: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Place of each row in its run of true flags, 0 outside."""
        off = np.maximum.accumulate(np.where(flag, self.off[name], place))
        self.off[name] = int(off[-1])
        return place - off

    def _sums(self, value: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The upper and the lower cumulative sum; a missing score resets both."""
        if self.scale is None:
            return np.zeros(len(value)), np.zeros(len(value))
        target, sd = self.scale
        score = np.where(missing, 0.0, (value - target) / sd)
        total = np.cumsum(np.concatenate([[self.total], score]))[1:]
        n = self.n + np.cumsum(~missing)
        self.total, self.n = float(total[-1]), int(n[-1])
        resets, sums = np.flatnonzero(missing), []
        for side, drift in (("up", total - self.k * n), ("dn", -(total + self.k * n))):
            low = lowest(drift, resets, self.low[side])
            self.low[side] = float(low[-1])
            sums.append(drift - low)
        return sums[0], sums[1]


def _rolling(recent: np.ndarray, hit: np.ndarray) -> list[pa.Array]:
    """Mean, sample std, last-first difference and slope of the rows up to each hit, null where one of them is missing."""
    values = [recent[hit + i] for i in range(ROLLING_ROWS)]  # oldest first
    mid = (ROLLING_ROWS - 1) / 2.0
    missing, total = np.isnan(values[0]), values[0]
    for v in values[1:]:
        missing, total = missing | np.isnan(v), total + v
    mean = total / ROLLING_ROWS
    square, lean = np.zeros(len(hit)), np.zeros(len(hit))
    for i, v in enumerate(values):
        square = square + (v - mean) * (v - mean)
        lean = lean + (v - mean) * (i - mid)
    weight = sum((i - mid) ** 2 for i in range(ROLLING_ROWS))
    found = (mean, np.sqrt(square / (ROLLING_ROWS - 1)), values[-1] - values[0], lean / weight)
    return [pa.array(f, mask=missing) for f in found]
