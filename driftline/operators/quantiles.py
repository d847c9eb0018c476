"""Long form, counted values and average ranks of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions.expr import no_nan
from driftline.operators.ordered import running
from driftline.store import join_null_safe, lookup, written


def unpivot(df: DataFrame, keep: Sequence[str], measures: Sequence[str], drop_null: bool = True) -> DataFrame:
    """Wide to long: one row per (row, measure) with columns ``column`` and ``value``; NaN counts as null."""
    typed = df.select(*keep, *[no_nan(F.col(m).cast("double")).alias(f"_m_{m}") for m in measures])
    renamed = typed.toDF(*[f"_k_{c}" for c in keep], *measures)
    long = renamed.unpivot([f"_k_{c}" for c in keep], list(measures), "column", "value")
    out = long.toDF(*keep, "column", "value")
    return out.filter("value is not null") if drop_null else out


def value_counts(long: DataFrame, part: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Rows per distinct value; ties collapse before anything is shuffled."""
    return long.groupBy(*part, "value").agg(F.count(F.lit(1)).alias("n"), *extra)


def average_ranks(long: DataFrame, part: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """(group, value) -> average rank of that value, its count and the group size."""
    counts = written(value_counts(long, part))
    ranked = running(counts, part, ["value"], {"_upto": ("sum", "n")}, limit=limit)
    with_rank = ranked.withColumn("rank", F.col("_upto") - (F.col("n") - 1) / 2.0).drop("_upto")
    size = counts.groupBy(*part).agg(F.sum("n").alias("size"))
    return join_null_safe(with_rank, lookup(size), part)
