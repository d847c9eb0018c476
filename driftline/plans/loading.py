"""Start of every plan: typed columns, rejected rows with their reasons, the normal flag, derived features.

The raw table may hold anything as text. Every declared column is read as its type; what cannot be read is kept as it was,
beside the reason. Rows without a usable time, key or entity are of no use and go to the rejects, other unreadable cells
become null and are only counted. The checked rows are written once, and their totals are observed during that write.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from driftline.functions.expr import without_nan
from driftline.schema import Roles
from driftline.store import written


@dataclass(frozen=True)
class Loaded:
    """fact: usable rows with ``is_normal``; rejects: raw cells and ``reasons``; report: rows per reason."""

    fact: DataFrame
    rejects: DataFrame
    report: DataFrame
    rows: int
    rejected: int


def _typed(name: str, kind: str, time_format: str | None) -> Column:
    text = F.col(f"`{name}`")
    if kind == "timestamp_ntz" and time_format:
        return F.try_to_timestamp(text, F.lit(time_format)).cast("timestamp_ntz")
    return text.try_cast(kind)


def load(
    raw: DataFrame,
    roles: Roles,
    kinds: Mapping[str, str],
    *,
    time_format: str | None = None,
    features: Callable[[DataFrame], DataFrame] | None = None,
    expected_rows: int | None = None,
) -> Loaded:
    """``kinds``: type of every column that is not text. Other columns pass as they are.

    A cell that is not null and cannot be read gives the reason ``<column>: unreadable``; a row whose time, key or entity
    is null or unreadable is rejected, a null giving ``<column>: missing``. NaN counts as null. ``features`` adds derived
    columns to the usable rows. Raises if the number of raw rows is not the expected one.
    """
    needed = [roles.entity, *roles.order]
    typed = {c: _typed(c, k, time_format) for c, k in kinds.items()}
    unreadable = {c: F.col(f"`{c}`").isNotNull() & t.isNull() for c, t in typed.items()}
    reasons = [F.when(test, F.lit(f"{c}: unreadable")) for c, test in unreadable.items()]
    reasons += [F.when(F.col(f"`{c}`").isNull(), F.lit(f"{c}: missing")) for c in needed]
    useless = F.lit(False)
    for c in needed:
        useless = useless | F.col(f"`{c}`").isNull() | unreadable.get(c, F.lit(False))
    cells = F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias("raw")
    good = F.struct(*[(typed[c] if c in typed else F.col(f"`{c}`")).alias(c) for c in raw.columns]).alias("row")
    why = F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons")
    seen = Observation()
    checked = raw.select(cells, good, why, useless.alias("rejected")).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if("rejected").alias("rejected"))
    # the raw cells are only kept where something is wrong with them
    checked = written(checked.withColumn("raw", F.when(F.size("reasons") > 0, F.col("raw"))))
    rows, rejected = seen.get["rows"], seen.get["rejected"]
    if expected_rows is not None and rows != expected_rows:
        raise ValueError(f"{rows} rows, expected {expected_rows}")
    fact = without_nan(checked.filter("not rejected").select("row.*"))
    if features is not None:
        fact = features(fact)
    fact = fact.withColumn("is_normal", F.coalesce(F.expr(roles.normal), F.lit(False)))
    report = checked.filter("size(reasons) > 0").select("rejected", F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("rejected").alias("n_rejected"))
    return Loaded(fact, checked.filter("rejected").select("raw.*", "reasons"), report, rows, rejected)


def load_training(load_one: Callable[[], Loaded] | None) -> tuple[DataFrame | None, str | None]:
    """The optional training-only table, loaded the same way; without one, or with a wrong number of rows, a warning text.

    It is never merged with the monitored fact.
    """
    if load_one is None:
        return None, "no training table"
    try:
        return load_one().fact, None
    except ValueError as wrong:
        return None, f"training table left out: {wrong}"
