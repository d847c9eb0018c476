"""Train/test splits with exact sizes, without ordering the whole table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from driftline.operators.ordered import number_rows

_HEX_DIGITS = 3  # 4096 coarse places of the hash


def _take_lowest(df: DataFrame, part: Sequence[str], order: Sequence[str], coarse: str, quota: DataFrame) -> DataFrame:
    """Flag the first ``quota`` rows of each group in the given order as ``_taken``.

    ``coarse`` is a column that never falls as the order advances. Its counts, a small
    table, tell which coarse values are taken or left whole; only rows of the one value
    per group where the quota ends are numbered.
    """
    w = Window.partitionBy(*(part or [F.lit(1)])).orderBy(coarse)
    counts = df.groupBy(*part, coarse).agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if part:
        joined = upto.join(quota, list(part))
    else:
        joined = upto.withColumn("_k", F.lit(1)).join(quota.withColumn("_k", F.lit(1)), "_k").drop("_k")
    edge = joined.filter((F.col("_upto") > F.col("_quota")) & (F.col("_upto") - F.col("_n") <= F.col("_quota")))
    edge = F.broadcast(edge.select(*part, F.col(coarse).alias("_edge"), (F.col("_quota") - (F.col("_upto") - F.col("_n"))).alias("_rest")))
    if part:
        placed = df.join(edge, list(part), "left")
    else:
        placed = df.withColumn("_k", F.lit(1)).join(edge.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    at_edge = placed.filter(F.col(coarse) == F.col("_edge"))
    numbered = number_rows(at_edge, list(part), list(order), "_pos")
    cut = numbered.withColumn("_taken", F.col("_pos") <= F.col("_rest")).drop("_pos")
    sure = placed.filter(~F.coalesce(F.col(coarse) == F.col("_edge"), F.lit(False))).withColumn(
        "_taken", F.coalesce(F.col(coarse) < F.col("_edge"), F.lit(True))
    )
    return sure.unionByName(cut).drop("_edge", "_rest")


def time_split(df: DataFrame, time: str, key: Sequence[str], test_fraction: float = 0.2) -> DataFrame:
    """``split`` = train for the first int(n (1 - f)) rows in time order, else test. Rows without a time come last."""
    n = df.count()
    quota = df.sparkSession.createDataFrame([(int(n * (1 - test_fraction)),)], "_quota bigint")
    last = F.to_date(F.lit("9999-12-31"))
    dated = df.withColumn("_day", F.coalesce(F.to_date(time), last)).withColumn("_none", F.col(time).isNull())
    out = _take_lowest(dated, [], ["_none", time, *key], "_day", quota)
    return out.withColumn("split", F.when(F.col("_taken"), "train").otherwise("test")).drop("_taken", "_day", "_none")


def class_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per class: proportional, the rest to the largest remainders."""
    n = sum(counts.values())
    total = math.ceil(test_size * n)
    exact = {c: total * k / n for c, k in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    rest = total - sum(quota.values())
    for c in sorted(exact, key=lambda c: (quota[c] - exact[c], str(c)))[:rest]:
        quota[c] += 1
    return quota


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """``split`` with the label rate kept: per class, the rows with the lowest hash are test.

    The hash depends only on the key and the seed, so the split is repeatable.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 2:
        raise ValueError(f"cannot stratify by {label}: class sizes {counts}")
    kind = df.schema[label].dataType.simpleString()
    quota = df.sparkSession.createDataFrame(
        list(class_quotas(counts, test_size).items()), f"{label} {kind}, _quota bigint"
    )
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))))
    coarse = hashed.withColumn("_place", F.substring("_hash", 1, _HEX_DIGITS))
    out = _take_lowest(coarse, [label], ["_hash", *key], "_place", F.broadcast(quota))
    return out.withColumn("split", F.when(F.col("_taken"), "test").otherwise("train")).drop("_taken", "_hash", "_place")
