"""Limit checks: violation rates, required runs and day-level breaches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions import expr
from driftline.functions.tails import binomial_quantile_udf
from driftline.schema import ROLLING_ROWS, SPEC_RUN_EXPECTED_MAX, Roles


@dataclass(frozen=True)
class UpperLimit:
    """External upper limit of a measure and the labels it may relate to."""

    limit: float
    labels: tuple[str, ...] = ()


def required_run(rate: Column, n: Column, expected_max: float = SPEC_RUN_EXPECTED_MAX, cap: int = ROLLING_ROWS) -> Column:
    """Smallest r with rate^r * n < expected_max, at most ``cap``."""
    out = F.lit(cap)
    for r in range(cap - 1, 0, -1):
        out = F.when(F.pow(rate, F.lit(r)) * n < expected_max, r).otherwise(out)
    return out.cast("int")


def day_table(df: DataFrame, roles: Roles, limits: Mapping[str, UpperLimit]) -> DataFrame:
    """(series, day) -> rows, violations of every limited measure, rows over every external limit.

    One aggregate of the fact, from which the sizes of the series, the strata, the limit
    rules and the breach days all follow.
    """
    limited = [m for m in roles.measures if m in roles.limits]
    return df.groupBy(*roles.series, F.to_date(roles.time).alias("dt")).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(expr.out_of_spec(F.col(m), roles.limits[m])).alias(f"_v_{m}") for m in limited],
        *[F.count_if(expr.no_nan(F.col(m).cast("double")) > rule.limit).alias(f"_o_{m}") for m, rule in limits.items()],
    )


def spec_rules(df: DataFrame, roles: Roles, days: DataFrame | None = None) -> DataFrame:
    """Violation rate of every limited measure over the whole table and the run of
    consecutive violations that cannot be chance. Missing values stay in the denominator.
    ``days``: the day table, if the caller has it."""
    limited = [m for m in roles.measures if m in roles.limits]
    days = day_table(df, roles, {}) if days is None else days
    rates = days.agg(F.sum("_rows").alias("_rows"), *[(F.sum(f"_v_{m}") / F.sum("_rows")).alias(f"r_{m}") for m in limited])
    cells = [
        F.struct(
            F.lit(m).alias("column"), F.lit(float(roles.limits[m].lsl)).alias("lsl"),
            F.lit(float(roles.limits[m].usl)).alias("usl"), F.col(f"r_{m}").alias("rate"),
        )
        for m in limited
    ]
    return rates.select("_rows", F.inline(F.array(*cells))).select(
        "column", "lsl", "usl", "rate", required_run(F.col("rate"), F.col("_rows")).alias("run")
    )


def breach_days(
    df: DataFrame, roles: Roles, limits: Mapping[str, UpperLimit], quantile: float = 0.99, rate: float = 0.001,
    days: DataFrame | None = None,
) -> DataFrame:
    """(entity, dt, column) -> rows, rows over the limit, rows needed, breach.

    The binomial point is computed on the day table (``days``, if the caller has it), once per
    distinct row count of a task.
    """
    days = day_table(df, roles, limits) if days is None else days
    daily = days.groupBy(roles.entity, "dt").agg(
        F.sum("_rows").alias("n_rows"), *[F.sum(f"_o_{m}").alias(f"o_{m}") for m in limits]
    )
    needed = F.greatest(binomial_quantile_udf(F.lit(quantile), "n_rows", F.lit(rate)), F.lit(1))
    cells = [
        F.struct(F.lit(m).alias("column"), F.lit(float(r.limit)).alias("upper_limit"), F.col(f"o_{m}").alias("n_over"))
        for m, r in limits.items()
    ]
    long = daily.withColumn("need", needed).select(roles.entity, "dt", "n_rows", "need", F.inline(F.array(*cells)))
    return long.withColumn("breach", F.col("n_over") >= F.col("need"))


def upper_limits(table: DataFrame) -> DataFrame:
    """External limit rules per factor: its numeric limit and the linked labels.

    ``table``: factor, upper_limit (text), defect, evidence_level, position. The limit is
    the first one in table order that reads as a number.
    """
    limit = F.col("upper_limit").try_cast("double")
    return table.groupBy("factor").agg(
        F.min_by(limit, F.when(limit.isNotNull(), F.col("position"))).alias("upper_limit"),
        F.array_sort(F.collect_list(F.struct("defect", "evidence_level"))).alias("defects"),
    ).filter("upper_limit is not null")


def upper_rules(table: DataFrame) -> dict[str, UpperLimit]:
    """The limits of ``upper_limits`` as the detector takes them (a row per factor)."""
    return {
        r["factor"]: UpperLimit(float(r["upper_limit"]), tuple(dict.fromkeys(d["defect"] for d in r["defects"] if d["defect"])))
        for r in upper_limits(table).collect()
    }


def capability(df: DataFrame, roles: Roles, groups: Sequence[str]) -> DataFrame:
    """Process capability min(usl - mean, mean - lsl) / 3 sigma per group and measure."""
    limited = [m for m in roles.measures if m in roles.limits]
    wide = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[f(m).alias(f"{t}_{m}") for m in limited for t, f in (("m", F.avg), ("s", F.stddev_samp))],
    )
    cells = [
        F.struct(
            F.lit(m).alias("column"),
            F.try_divide(
                F.least(F.lit(float(roles.limits[m].usl)) - F.col(f"m_{m}"), F.col(f"m_{m}") - F.lit(float(roles.limits[m].lsl))),
                F.col(f"s_{m}") * 3,
            ).alias("cpk"),
        )
        for m in limited
    ]
    return wide.select(*groups, "n_rows", F.inline(F.array(*cells)))


def capability_gap(cpk: DataFrame, entity: str, normal: str) -> DataFrame:
    """Capability of every other entity beside the normal one's, per measure (``cpk``: entity, column, cpk)."""
    base = cpk.filter(F.col(entity) == normal).select("column", F.col("cpk").alias("normal_cpk"))
    return cpk.filter(F.col(entity) != normal).join(base, "column").select(
        entity, "column", "cpk", "normal_cpk", (F.col("cpk") - F.col("normal_cpk")).alias("gap"), (F.col("cpk") < F.col("normal_cpk")).alias("degraded")
    )


def fixed_offsets(df: DataFrame, stats: DataFrame, roles: Roles, min_rows: int = 30) -> DataFrame:
    """|entity mean - stratum mean| / stratum std per (entity, stratum, measure)."""
    means = df.groupBy(*roles.series).agg(
        *[F.avg(m).alias(f"m_{m}") for m in roles.measures], *[F.count(m).alias(f"n_{m}") for m in roles.measures]
    )
    cells = [F.struct(F.lit(m).alias("column"), F.col(f"m_{m}").alias("v"), F.col(f"n_{m}").alias("n")) for m in roles.measures]
    long = means.select(*roles.series, F.inline(F.array(*cells)))
    joined = long.join(stats.select(*roles.stratum, "column", "mean", "std"), [*roles.stratum, "column"])
    return joined.filter((F.col("n") >= min_rows) & (F.col("std") > 0)).select(
        *roles.series, "column", F.abs((F.col("v") - F.col("mean")) / F.col("std")).alias("offset_sigma")
    )


def offset_shares(offsets: DataFrame, entity: str, cuts: Sequence[float] = (0.2, 0.3, 0.44)) -> DataFrame:
    """Median and largest offset per entity, and how many series reach each cut."""
    return offsets.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_series"),
        F.median("offset_sigma").alias("median_offset"),
        F.max("offset_sigma").alias("max_offset"),
        *[F.count_if(F.col("offset_sigma") >= c).alias(f"n_ge_{str(c).replace('.', '_')}") for c in cuts],
    )
