"""Monotone trend tests on day-level series.

A series has one value per calendar day, so its array is bounded by the length of the
calendar however many rows stand behind it. No pairs of days are ever materialised.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftline.functions import expr, tails
from driftline.operators.daily import zone_flags
from driftline.schema import MIN_STABLE_DAYS, TREND_ALPHA, Roles
from driftline.store import join_null_safe, lookup, written


def day_array(value: str, day: str = "dt") -> Column:
    """Values of a series in day order, nulls kept; bounded by the calendar."""
    return F.transform(F.array_sort(F.collect_list(F.struct(day, value))), lambda x: x[value])


def trend_tests(series: DataFrame, keys: Sequence[str], values: str = "_v") -> DataFrame:
    """Kendall's test and the least-squares slope of an array of daily values; nulls and NaN are dropped.

    n, s, tau, z, p, slope, slope_p; all but n are null for fewer than three values, and those of Kendall if all values
    are equal. Array expressions compare each day with the earlier ones inside its row. The exact tail for untied short
    series comes from a table of inversion counts, else the normal one with the tie term and without continuity correction.
    """
    known = series.withColumn("_x", F.expr(f"filter({values}, x -> x is not null and not isnan(x))"))
    known = known.select(*keys, "_x", F.size("_x").alias("n"), F.expr("size(array_distinct(_x))").alias("_levels"))
    ok = "n >= 3 and _levels >= 2"
    ties = "transform(_x, x -> cast(size(filter(_x, y -> y = x)) as bigint))"
    later = "aggregate(slice(_x, 1, j - 1), 0L, (a, x) -> a + cast(sign(_x[j - 1] - x) as bigint))"
    parts = known.selectExpr(
        "*", f"case when {ok} then aggregate(sequence(2, n), 0L, (a, j) -> a + {later}) end as s",
        f"case when {ok} then aggregate({ties}, 0L, (a, t) -> a + (t - 1) * (2 * t + 5)) end as _tie_sum",
        f"case when {ok} then aggregate({ties}, 0L, (a, t) -> a + t - 1) div 2 end as _tie_pairs",
        "cast(n as bigint) * (n - 1) div 2 as _pairs", "(n - 1) / 2 as _mid", "cast(n as double) * (n - 1) * (n + 1) / 12 as _sxx")
    parts = parts.selectExpr(
        "*", "(_pairs - _tie_pairs - abs(s)) div 2 as _fewer",
        "s / sqrt((_pairs * 2 * (2 * n + 5) - _tie_sum) / 18) as z", "s / sqrt(_pairs * (_pairs - _tie_pairs)) as tau",
        "case when n >= 3 then aggregate(sequence(0, n - 1), 0D, (a, i) -> a + (i - _mid) * _x[i]) / _sxx end as slope",
        "aggregate(_x, 0D, (a, x) -> a + x) / nullif(n, 0) as _mean")
    parts = parts.selectExpr(
        "*", "case when n >= 3 then aggregate(sequence(0, n - 1), 0D, (a, i) -> a + pow(_x[i] - _mean - slope * (i - _mid), 2)) end as _rest")
    exact = F.broadcast(tails.inversion_table(series.sparkSession).toDF("_n", "_c", "_chance"))  # a table of fixed size
    parts = parts.join(exact, (F.col("n") == F.col("_n")) & (F.col("_fewer") == F.col("_c")) & (F.col("_tie_pairs") == 0), "left")
    extreme = (F.col("_tie_pairs") == 0) & (F.col("_fewer") <= 1)
    p = (
        F.when(F.col("s").isNull(), F.lit(None).cast("double"))
        .when(F.col("_chance").isNotNull(), F.when(F.col("_fewer") * 4 == F.col("_pairs") * 2, 1.0).otherwise(F.least(F.lit(1.0), F.col("_chance") * 2)))
        .when(extreme, 0.0)
        .otherwise(tails.normal_two_sided_column("z"))
    )
    t = "(slope / sqrt(_rest / (n - 2) / _sxx))"
    slope_p = F.when(F.col("_rest") <= 0, 0.0).when(F.col("n") >= 3, tails.student_two_sided_column(t, "(n - 2)"))
    return parts.select(*keys, "n", "s", "tau", "z", p.alias("p"), "slope", slope_p.alias("slope_p"))


@F.pandas_udf(T.IntegerType())
def stable_days(series: pd.Series) -> pd.Series:
    """Length of the phase before the first prefix with a significant upward trend."""
    return pd.Series([_stable_length(a) for a in series], dtype="int32")


def _stable_length(series) -> int:
    v = [x for x in series if x is not None and not math.isnan(x)]
    if len(v) < MIN_STABLE_DAYS:
        return len(v)
    s = tie_sum = tie_pairs = 0
    seen: dict[float, int] = {}
    done = np.empty(len(v))
    for j, x in enumerate(v):
        s += int(np.sign(x - done[:j]).sum())
        t = seen.get(x, 0)
        # t(t-1)(2t+5) and t(t-1)/2 after one more equal value
        tie_sum += (t + 1) * t * (2 * t + 7) - t * (t - 1) * (2 * t + 5)
        tie_pairs += t
        seen[x] = t + 1
        done[j] = x
        end = j + 1
        if end >= MIN_STABLE_DAYS and s > 0 and tails.kendall_p(s, end, tie_sum, tie_pairs) < TREND_ALPHA:
            return end - 1
    return len(v)


def trend_table(daily: DataFrame, keys: Sequence[str], value: str = "daily_mean_z") -> DataFrame:
    """Kendall tau, OLS slope and drift class per series."""
    tested = trend_tests(daily.groupBy(*keys).agg(day_array(value).alias("_v")), keys)
    drift = F.col("p") < TREND_ALPHA
    return tested.select(
        *keys,
        F.col("n").alias("n_days"),
        F.col("s").alias("kendall_s"),
        F.col("tau").alias("kendall_tau"),
        F.col("z").alias("kendall_z"),
        F.col("p").alias("kendall_p"),
        F.col("slope").alias("ols_slope"),
        F.col("slope_p").alias("ols_p"),
        F.when(drift & (F.col("s") > 0), "candidate_upward_drift")
        .when(drift, "candidate_downward_drift")
        .otherwise("no_trend").alias("trend_class"),
    )


def column_summary(trends: DataFrame) -> DataFrame:
    """Trend classes of all entities folded to one class per column."""
    up = F.bool_or(F.col("trend_class") == "candidate_upward_drift")
    down = F.bool_or(F.col("trend_class") == "candidate_downward_drift")
    return trends.groupBy("column").agg(
        F.when(up & down, "mixed")
        .when(up, "candidate_upward_drift")
        .when(down, "candidate_downward_drift")
        .otherwise("no_trend").alias("trend_class")
    )


def raw_direction(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """up / down / flat from the raw daily means; a gap in the series makes it flat."""
    series = daily.groupBy(*keys).agg(day_array("daily_mean").alias("_v"))
    whole = F.expr("if(exists(_v, x -> x is null), array(), _v)").alias("_v")
    flat = F.coalesce(F.col("p") >= TREND_ALPHA, F.lit(True))
    return trend_tests(series.select(*keys, whole), keys).select(
        *keys, F.when(flat, "flat").when(F.col("s") > 0, "up").otherwise("down").alias("raw_direction")
    )


def crosscheck(raw: DataFrame, trends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two independent trend directions side by side; both tables are day-level results."""
    judged = trends.select(*keys, "trend_class", expr.trend_direction(F.col("trend_class")).alias("direction"))
    return (
        raw.join(judged, list(keys), "inner")
        .filter("direction is not null")
        .withColumn("agree", F.col("raw_direction") == F.col("direction"))
    )


def ok_zone_days(df: DataFrame, thresholds: DataFrame, roles: Roles) -> DataFrame:
    """Rows and risk-zone rows of the OK rows per (entity, column, label, group, day)."""
    ok = df.filter(roles.ok).withColumn("dt", F.to_date(roles.time))
    return (
        zone_flags(ok, thresholds, roles, [roles.entity, "dt"])
        .groupBy(roles.entity, "column", "label", "group_key", "dt")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("in_zone").alias("hit"))
    )


def stable_phase(zone_days: DataFrame, roles: Roles) -> DataFrame:
    """Stable days per (entity, column, label) of the daily zone share of ``ok_zone_days``."""
    keys = [roles.entity, "column", "label"]
    daily = zone_days.groupBy(*keys, "dt").agg((F.sum("hit") / F.sum("n")).alias("rate"))
    return daily.groupBy(*keys).agg(
        F.sort_array(F.collect_list("dt")).alias("days"), day_array("rate").alias("_v")
    ).select(*keys, stable_days("_v").alias("stable_days"), "days")


def entry_rate_baseline(df: DataFrame, thresholds: DataFrame, roles: Roles) -> DataFrame:
    """Usual zone share per (entity, column, label, group): OK rows of the stable phase.

    The stable set is a prefix of the days, so one cut-off day per series replaces the
    set of days. The fact is read once: both steps work on its day table.
    """
    keys = [roles.entity, "column", "label"]
    per_day = written(ok_zone_days(df, thresholds, roles))
    phase = stable_phase(per_day, roles).select(
        *keys, "stable_days", F.element_at("days", F.col("stable_days")).alias("_until")
    )
    joined = join_null_safe(per_day, lookup(phase), keys, "inner").filter("dt <= _until")
    return (
        joined.groupBy(*keys, "group_key", "stable_days")
        .agg(F.sum("n").alias("n_ok_rows"), F.sum("hit").alias("n_in_zone"))
        .withColumn("baseline_rate", F.col("n_in_zone") / F.col("n_ok_rows"))
    )
