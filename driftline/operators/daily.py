"""Day-level tables: series, rates and risk-zone shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from driftline.functions import expr
from driftline.operators.baseline import robust_z
from driftline.schema import Roles
from driftline.store import join_null_safe, lookup


def daily_series(df: DataFrame, stats: DataFrame, roles: Roles) -> DataFrame:
    """(entity, column, date) -> rows, mean and mean robust score.

    The fact stays wide and is aggregated before it becomes long, so the shuffle carries
    one partial row per entity and day, whatever the number of measures.
    """
    scored = robust_z(df, stats, roles.stratum, roles.measures)
    daily = scored.groupBy(roles.entity, F.to_date(roles.time).alias("dt")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(m).alias(f"m_{m}") for m in roles.measures],
        *[F.avg(f"{m}_z").alias(f"z_{m}") for m in roles.measures],
    )
    cells = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("column"),
                    F.col(f"m_{m}").alias("daily_mean"),
                    F.col(f"z_{m}").alias("daily_mean_z"),
                )
                for m in roles.measures
            ]
        )
    )
    return daily.select(roles.entity, "dt", "n_rows", cells)


def daily_rates(
    df: DataFrame,
    roles: Roles,
    averaged: Sequence[str],
    labels: Sequence[str],
    rows: int = 7,
    min_rows: int = 3,
) -> DataFrame:
    """(entity, date) -> process means with a moving average over ``rows`` days, label rates.

    The average runs over rows of the daily table, not over calendar days, and needs at
    least ``min_rows`` of them.
    """
    daily = df.groupBy(roles.entity, F.to_date(roles.time).alias("dt")).agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.avg(c).alias(c) for c in averaged],
        *[F.avg(c).alias(f"{c}_rate") for c in labels],
    )
    w = Window.partitionBy(roles.entity).orderBy("dt").rowsBetween(-(rows - 1), 0)
    return daily.select(
        "*",
        *[
            F.when(F.count(c).over(w) >= min_rows, F.avg(c).over(w)).alias(f"{c}_{rows}d_ma")
            for c in averaged
        ],
    )


def zone_flags(df: DataFrame, thresholds: DataFrame, roles: Roles, keep: Sequence[str]) -> DataFrame:
    """Rows of every (column, label) pair with a threshold in their group, flagged in_zone.

    ``thresholds`` has column, label, group_key, threshold, direction. All pairs of a group
    travel as one array, so the fact is joined once.
    """
    per_group = thresholds.groupBy("group_key").agg(
        F.collect_list(F.struct("column", "label", "threshold", "direction")).alias("_pairs")
    )
    keyed = df.withColumn("group_key", roles.group_key())
    joined = join_null_safe(keyed, lookup(per_group), ["group_key"], "inner")
    value = F.coalesce(
        *[F.when(F.col("_p.column") == m, F.col(m).cast("double")) for m in roles.measures]
    )
    spread = joined.select(*keep, "group_key", *roles.measures, F.explode("_pairs").alias("_p"))
    return spread.select(
        *keep, "group_key",
        F.col("_p.column").alias("column"), F.col("_p.label").alias("label"),
        expr.in_zone(value, F.col("_p.threshold"), F.col("_p.direction")).cast("int").alias("in_zone"),
    ).filter("in_zone is not null")


def zone_rate_daily(df: DataFrame, thresholds: DataFrame, roles: Roles) -> DataFrame:
    """Share of the day's rows inside the risk zone per (entity, column, label)."""
    dated = df.withColumn("dt", F.to_date(roles.time))
    return (
        zone_flags(dated, thresholds, roles, [roles.entity, "dt"])
        .groupBy(roles.entity, "column", "label", "dt")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("in_zone").alias("n_in_zone"))
        .withColumn("zone_rate", F.col("n_in_zone") / F.col("n_rows"))
    )
