"""Bins of doubles and selection by counting against sorting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators.selection import log_bin, select_quantiles

NAMES, PROBS = ["a", "b", "c", "d"], [0.0, 0.005, 0.5, 0.995]


def test_bins_keep_the_order_of_the_values(spark):
    draw = np.random.default_rng(0)
    powers = 2.0 ** draw.integers(-1070, 1023, 300)
    any_bits = draw.integers(0, 2**63, 1000, dtype=np.uint64).view(np.float64)
    values = np.r_[0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, np.inf, -np.inf, draw.normal(size=500), powers,
                   np.nextafter(powers, 0), np.nextafter(powers, 1e308), any_bits[np.isfinite(any_bits)]]
    df = spark.createDataFrame([(float(v),) for v in np.r_[values, -values]], "v double")
    got = df.select("v", log_bin(F.col("v")).alias("i")).orderBy("v").toPandas()
    assert got["i"].is_monotonic_increasing and (got["i"][got["v"] == 0] == 0).all()


GROUPS = {
    "narrow": lambda d: d.normal(100, 0.001, 3000), "equal": lambda d: np.repeat(7.0, 500), "steps": lambda d: d.integers(-5, 5, 900) / 2,
    "wide": lambda d: d.lognormal(0, 30, 2000) * d.choice([-1, 1], 2000), None: lambda d: np.array([1.5, 2.5]), "one": lambda d: np.array([3.25]),
    "neighbours": lambda d: 1 + 2.0**-52 * d.integers(0, 50, 700), "zeros": lambda d: np.r_[np.repeat(-0.0, 40), np.repeat(0.0, 41), -1.0, 5e-324],
}


@pytest.mark.parametrize("limit", [None, 40, 1])
def test_selection_equals_sorting(spark, limit):
    draw = np.random.default_rng(6)
    data = {g: make(draw) for g, make in GROUPS.items()}
    rows = [(g, float(v), "x") for g, values in data.items() for v in values]
    draw.shuffle(rows)
    df = spark.createDataFrame([(g if g is None else str(g), float(v), x) for g, v, x in rows], "g string, value double, bin string").repartition(5)
    df = df.withColumnsRenamed({"g": "v", "bin": "slot"})  # names that the operator uses itself
    got = {r["v"]: r for r in select_quantiles(df, ["v", "slot"], PROBS, NAMES, limit=limit).collect()}
    assert got.keys() == data.keys()
    for g, values in data.items():
        r, v = got[g], pd.Series(values)
        assert (r["n"], r["min"], r["max"]) == (len(v), v.min(), v.max())
        assert [r[c] for c in NAMES] == pytest.approx(list(v.quantile(PROBS)), rel=1e-14)
        if g != "wide":
            assert r["mean"] == pytest.approx(v.mean(), rel=1e-12)
            assert r["std"] is None if len(v) == 1 else r["std"] == pytest.approx(v.std(), rel=1e-6, abs=1e-12)


def test_no_rows_give_no_groups(spark):
    df = spark.createDataFrame([], "g string, value double")
    assert select_quantiles(df, ["g"], [0.5], ["m"]).count() == 0


def test_the_first_pass_moves_bins_and_not_rows(spark):
    """A million distinct values of two groups: a row per occupied bin and task leaves the scan."""
    df = spark.range(1_000_000, numPartitions=4).select((F.col("id") % 2).alias("g"), (F.rand(3) * 100 + 1).alias("value"))
    bins = df.groupBy("g", log_bin(F.col("value"))).count().count()
    assert bins < 250
    got = {r["g"]: r["m"] for r in select_quantiles(df, ["g"], [0.5], ["m"]).collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.expr("percentile(value, 0.5)").alias("m")).collect()}
    assert got == pytest.approx(want, rel=1e-12)
