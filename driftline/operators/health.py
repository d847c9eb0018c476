"""What alert rows add up to: active alerts, funnels, scores, entity health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.functions import expr
from driftline.operators.sequence import days_between, gap_sessions, longest_session
from driftline.schema import ACTIVE_WITHIN_DAYS, ALERT_THRESHOLD, RECENT_DAYS, Roles
from driftline.store import written


def active_alerts(alerts: DataFrame, entity: str, time: str, within_days: int = ACTIVE_WITHIN_DAYS) -> DataFrame:
    """(entity, column) pairs whose last alert is recent, and since when they are on."""
    keys = [entity, "column"]
    sessions = gap_sessions(alerts, keys, time, within_days)
    # read twice below: the table has one line per entity and measure
    last = written(
        sessions.groupBy(*keys).agg(
            F.max_by("start_ts", "session").alias("since"), F.max("end_ts").alias("last_ts")
        )
    )
    latest = last.agg(F.max("last_ts").alias("latest"))
    joined = last.withColumn("_k", F.lit(1)).join(F.broadcast(latest.withColumn("_k", F.lit(1))), "_k").drop("_k")
    recent = F.col("last_ts") >= F.col("latest") - F.expr(f"INTERVAL {int(within_days)} DAY")
    return joined.filter(recent).select(
        *keys, "since", "last_ts", F.round(days_between("since", "latest"), 2).alias("days")
    )


def strength(active: DataFrame, eta_days: str | None = None) -> DataFrame:
    """Alert strength and level; ``full`` from strength 1 on."""
    value = expr.alert_strength(F.col("days"), F.col(eta_days) if eta_days else None, RECENT_DAYS)
    return active.withColumn("strength", value).withColumn(
        "alert_level", F.when(F.col("strength") >= 1.0, "full").otherwise("early")
    )


def maturity_sweep(active: DataFrame, entity: str, days: Sequence[float], normal: str, faulty: Sequence[str]) -> DataFrame:
    """Alerts that have lasted at least T days per entity, and whether T separates the
    normal entity from all faulty ones."""
    grid = F.array(*[F.lit(float(t)) for t in days])
    everyone = [normal, *faulty]
    per_entity = active.groupBy(entity).agg(F.collect_list("days").alias("_d"))  # one value per measure
    counts = per_entity.select(entity, "_d", F.explode(grid).alias("t")).select(
        entity, "t", F.size(F.filter("_d", lambda x: x >= F.col("t"))).alias("n")
    )
    wide = counts.groupBy("t").agg(
        *[F.coalesce(F.max(F.when(F.col(entity) == e, F.col("n"))), F.lit(0)).alias(f"n_{e}") for e in everyone]
    )
    clean = F.col(f"n_{normal}") == 0
    hits = F.lit(True)
    for e in faulty:
        hits = hits & (F.col(f"n_{e}") >= 1)
    return wide.withColumn(
        "verdict", F.when(clean & hits, "separated").when(~clean, "false_alarm").otherwise("missed")
    )


def separable_range(active: DataFrame, entity: str, normal: str, faulty: Sequence[str]) -> DataFrame:
    """Days above the longest alert of the normal entity and up to the shortest of the
    faulty entities' longest alerts."""
    top = active.groupBy(entity).agg(F.max("days").alias("top"))
    return top.agg(
        F.coalesce(F.max(F.when(F.col(entity) == normal, F.col("top"))), F.lit(0.0)).alias("above_days"),
        F.min(F.when(F.col(entity).isin(list(faulty)), F.col("top"))).alias("up_to_days"),
    ).withColumn("separable", F.coalesce(F.col("above_days") < F.col("up_to_days"), F.lit(False)))


def funnel(alerts: DataFrame, roles: Roles, n_rows: DataFrame) -> DataFrame:
    """Input rows -> alert rows -> distinct alerting rows -> episodes -> (entity, column)
    -> active -> full. ``n_rows``: one row, one column."""
    series = [*roles.series, "column"]
    alerts = written(alerts.select(*series, roles.time, "episode_id"))  # read three times below
    shots = alerts.groupBy(*series, roles.time).agg(F.count(F.lit(1)).alias("rows")).groupBy(*series).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("shots")
    )
    events = alerts.select(*series, "episode_id").distinct().groupBy(*series).agg(F.count(F.lit(1)).alias("episodes"))
    merged = shots.join(events, series).groupBy(roles.entity, "column").agg(
        F.sum("rows").alias("rows"), F.sum("shots").alias("shots"), F.sum("episodes").alias("episodes")
    )
    live = strength(active_alerts(alerts, roles.entity, roles.time))
    tops = live.agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("alert_level") == "full").alias("full_strength"))
    sums = merged.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("alert_rows"),
        F.coalesce(F.sum("shots"), F.lit(0)).alias("alert_shots"),
        F.coalesce(F.sum("episodes"), F.lit(0)).alias("episodes"),
        F.count(F.lit(1)).alias("entity_columns"),
    )
    one = [t.withColumn("_k", F.lit(1)) for t in (n_rows.toDF("input_rows"), sums, tops)]
    return one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")


def episode_count(alerts: DataFrame, roles: Roles) -> DataFrame:
    """Distinct episodes of the alert rows."""
    return alerts.select(*roles.series, "column", "episode_id").distinct().agg(F.count(F.lit(1)).alias("episodes"))


def alert_scale(alerts: DataFrame, roles: Roles, near_days: int = 3, top: int = 4) -> DataFrame:
    """Rows, strata and days with alerts per (entity, column), and how fresh they are."""
    keys = [roles.entity, "column"]
    day = alerts.groupBy(*keys, *roles.stratum, F.to_date(roles.time).alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    per_key = day.groupBy(*keys).agg(
        F.sum("n").alias("alert_rows"),
        F.count_distinct(F.struct(*roles.stratum)).alias("n_strata"),
        F.count_distinct("dt").alias("n_days"),
        F.max("dt").alias("_last"),
    )
    per_key = written(per_key)
    end = per_key.agg(F.max("_last").alias("_end")).withColumn("_k", F.lit(1))
    first = per_key.orderBy(F.desc("alert_rows"), *keys).limit(top).select(*keys, F.lit(True).alias("_top"))
    placed = per_key.withColumn("_k", F.lit(1)).join(F.broadcast(end), "_k").join(F.broadcast(first), keys, "left")
    since = F.datediff("_end", "_last")
    return placed.select(
        *keys, "alert_rows", "n_strata", "n_days", since.alias("days_since_last"),
        (since <= near_days).alias("near_now"), F.coalesce("_top", F.lit(False)).alias("top_group"),
    )


def scale_summary(scale: DataFrame) -> DataFrame:
    """Share of fresh pairs and the gap between the top group and the rest."""
    low_top = F.min(F.when(F.col("top_group"), F.col("alert_rows")))
    high_rest = F.max(F.when(~F.col("top_group"), F.col("alert_rows")))
    return scale.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("near_now").alias("near_now_pairs"),
        low_top.alias("top_lowest"), high_rest.alias("rest_highest"),
        F.try_divide(low_top, high_rest).alias("gap_ratio"),
    )


def level_ranges(levels: DataFrame) -> DataFrame:
    """Health range of full and early alerts and whether the two overlap."""
    def of(level, fn):
        return fn(F.when(F.col("alert_level") == level, F.col("health")))

    out = levels.agg(
        *[of(lv, fn).alias(f"{lv}_{n}") for lv in ("full", "early") for n, fn in (("min", F.min), ("max", F.max))]
    )
    return out.withColumn("disjoint", F.col("full_max") < F.col("early_min"))


def detector_overlap(alerts: DataFrame, roles: Roles) -> DataFrame:
    """Series found by threshold entry, by cumulative sum, or by both, and the mean lead."""
    firsts = alerts.filter("type = 'C'").groupBy(roles.entity, "column", *roles.stratum).agg(
        F.min(F.when(F.col("entry_warning"), F.col(roles.time))).alias("t_entry"),
        F.min(F.when(F.col("typed_warning") & ~F.col("entry_warning"), F.col(roles.time))).alias("t_cusum"),
    )
    e, c = F.col("t_entry"), F.col("t_cusum")
    both = e.isNotNull() & c.isNotNull()
    return firsts.agg(
        F.count_if(e.isNotNull() & c.isNull()).alias("entry_only"),
        F.count_if(e.isNull() & c.isNotNull()).alias("cusum_only"),
        F.count_if(both).alias("both"),
        F.count_if(both & (e < c)).alias("entry_first"),
        F.avg(F.when(both & (e < c), days_between("t_entry", "t_cusum"))).alias("mean_lead_days"),
    )


def grid_verdicts(scores: DataFrame, n_known: int, max_lag: int = 10, early_tolerance: int = -10) -> DataFrame:
    """Verdict of every cell: normal entity alarms, alarm before the change, late, pass.

    The tolerance before the onset is our own parameter; only the verdict names are given.
    """
    return scores.withColumn(
        "verdict",
        F.when(F.col("normal_sustained") > 0, "normal_false_alarm")
        .when(F.col("earliest_lag") < early_tolerance, "pre_onset_false_alarm")
        .when((F.coalesce("n_detected", F.lit(0)) < n_known) | (F.col("worst_lag") > max_lag), "late")
        .otherwise("pass"),
    )


def verdict_grid(verdicts: DataFrame, hs: Sequence[float]) -> DataFrame:
    """The verdicts as a K by H grid."""
    return verdicts.groupBy("k").agg(
        *[F.max(F.when(F.col("h") == float(h), F.col("verdict"))).alias(f"h_{str(h).replace('.', '_')}") for h in hs]
    )


def onset_days(daily: DataFrame, entity: str, value: str = "daily_mean", base_days: int = 30, sigmas: float = 3.0, hold: int = 5) -> DataFrame:
    """First day a daily mean leaves the band of the first days for at least ``hold`` days,
    and, as comparison, the first day it crosses the band at all."""
    keys = [entity, "column"]
    w = Window.partitionBy(*keys).orderBy("dt")
    numbered = daily.withColumn("_i", F.row_number().over(w))
    whole = Window.partitionBy(*keys)
    early = F.when(F.col("_i") <= base_days, F.col(value))
    band = numbered.withColumn("_m", F.avg(early).over(whole)).withColumn("_s", F.stddev_samp(early).over(whole))
    outside = F.coalesce(F.abs(F.col(value) - F.col("_m")) > sigmas * F.col("_s"), F.lit(False))
    ahead = w.rowsBetween(0, hold - 1)
    flagged = band.withColumn("_o", outside.cast("int")).withColumn("_run", F.sum("_o").over(ahead))
    return flagged.groupBy(*keys).agg(
        F.min(F.when(F.col("_run") == hold, F.col("dt"))).alias("onset_day"),
        F.min(F.when(F.col("_o") == 1, F.col("dt"))).alias("first_crossing"),
    )


def entity_health(factors: DataFrame, entity: str, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Entity health = its worst cause factor; a warning below the threshold.

    ``factors``: entity, defect, health (one line per watched pair).
    """
    worst = factors.groupBy(entity).agg(
        F.min("health").alias("health_index"),
        F.min_by("defect", F.struct("health", "defect")).alias("worst_defect"),
    )
    return worst.withColumn("warning", F.coalesce(F.col("health_index") < threshold, F.lit(False)))
