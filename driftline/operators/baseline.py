"""Stratum statistics, robust scores, dispersion classes and typed baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions import expr
from driftline.operators.quantiles import unpivot
from driftline.operators.selection import select_quantiles
from driftline.schema import (
    CV_STABLE,
    CV_VARIABLE,
    DISPERSION_STABLE,
    DISPERSION_VARIABLE,
    MAD_SCALE,
    ZERO_EPS,
    Limits,
    limits_frame,
    stratum_key,
)
from driftline.store import join_null_safe, lookup


def stratum_stats(normal: DataFrame, strata: Sequence[str], measures: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """Twelve statistics per (stratum, column) of the normal rows, at any grain.

    Two selections, one on the values and one on their distances from the median; no values are shuffled but
    those of the few bins that hold a wanted position.
    """
    part = [*strata, "column"]
    long = unpivot(normal, strata, measures)
    centre = lookup(select_quantiles(long, part, [0.005, 0.5, 0.995], ["p0_5", "median", "p99_5"], limit=limit))
    off = join_null_safe(long, centre.select(*part, "median"), part, "inner").withColumn("value", F.abs(F.col("value") - F.col("median")))
    width = select_quantiles(off.drop("median"), part, [0.5], ["mad"], limit=limit)
    return join_null_safe(centre, width.select(*part, "mad"), part).select(
        *part, "n", "mean", "std",
        F.when(F.abs("mean") > ZERO_EPS, F.col("std") / F.col("mean")).alias("cv"),
        "median", "mad",
        (F.col("mad") * MAD_SCALE).alias("robust_z_scale"),
        "p0_5", "p99_5", "min", "max",
    )


def control_limits(normal: DataFrame, strata: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Provisional limits: count, median and the 0.5 / 99.5 % points per stratum."""
    part = [*strata, "column"]
    cut = select_quantiles(unpivot(normal, strata, measures), part, [0.5, 0.005, 0.995], ["median", "lower_warning", "upper_warning"])
    return cut.select(*part, F.col("n").alias("normal_count"), "median", "lower_warning", "upper_warning")


def per_stratum(stats: DataFrame, strata: Sequence[str], measures: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Long statistics as one row per stratum, columns ``<measure>__<field>``.

    The fact table can then stay wide: one lookup per row instead of one per measure.
    """
    return stats.groupBy(*strata).agg(
        *[
            F.max(F.when(F.col("column") == m, F.col(f))).alias(f"{m}__{f}")
            for m in measures
            for f in fields
        ]
    )


def robust_z(df: DataFrame, stats: DataFrame, strata: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``<measure>_z`` = (value - median) / (1.4826 MAD); null without a usable scale."""
    table = lookup(per_stratum(stats, strata, measures, ["median", "robust_z_scale"]))
    joined = join_null_safe(df, table, strata)
    scores = [
        F.when(
            F.abs(f"{m}__robust_z_scale") > ZERO_EPS,
            (F.col(m) - F.col(f"{m}__median")) / F.col(f"{m}__robust_z_scale"),
        ).alias(f"{m}_z")
        for m in measures
    ]
    return joined.select(*df.columns, *scores)


def spec_exceedance(df: DataFrame, stats: DataFrame, strata: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``<measure>_spec_exceedance``: distance outside the stratum's 0.5 / 99.5 % points."""
    table = lookup(per_stratum(stats, strata, measures, ["p0_5", "p99_5"]))
    joined = join_null_safe(df, table, strata)
    out = [
        expr.exceedance(F.col(m), F.col(f"{m}__p0_5"), F.col(f"{m}__p99_5")).alias(f"{m}_spec_exceedance")
        for m in measures
    ]
    return joined.select(*df.columns, *out)


def _spread_class(ratio: Column, stable: float, variable: float) -> Column:
    return (
        F.when(ratio.isNull(), "unknown")
        .when(ratio < stable, "stable")
        .when(ratio < variable, "moderate")
        .otherwise("variable")
    )


def dispersion_continuous(normal: DataFrame, strata: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Median over strata of |std/mean|, or of std/range where the mean is near zero."""
    cells = unpivot(normal.dropna(subset=list(strata)), strata, measures).groupBy(*strata, "column").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"),
        (F.max("value") - F.min("value")).alias("_r"),
    )
    m, s, r = F.col("_m"), F.col("_s"), F.col("_r")
    ratio = (
        F.when(F.col("_n") < 5, F.lit(None).cast("double"))
        .when(s == 0, 0.0)
        .when(F.abs(m) > 0.1 * s, F.abs(F.try_divide(s, m)))
        .when(r > ZERO_EPS, F.try_divide(s, r))
        .otherwise(0.0)
    )
    out = cells.withColumn("ratio", ratio).groupBy("column").agg(F.median("ratio").alias("variability_ratio"))
    return _with_class(out, CV_STABLE, CV_VARIABLE, "cv_or_range_normalized")


def dispersion_binary(df: DataFrame, strata: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Variation of the stratum rates of a 0/1 label, over all rows."""
    rates = unpivot(df.dropna(subset=list(strata)), strata, labels).groupBy(*strata, "column").agg(
        F.avg("value").alias("rate")
    )
    mean = F.avg("rate")
    cv = F.when((F.count("rate") >= 2) & (mean != 0), F.try_divide(F.stddev_samp("rate"), mean))
    return _with_class(rates.groupBy("column").agg(cv.alias("variability_ratio")), CV_STABLE, CV_VARIABLE, "rate_cv")


def dispersion_count(df: DataFrame, strata: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Median over strata of var/mean of a count column, over all rows."""
    cells = unpivot(df.dropna(subset=list(strata)), strata, counts).groupBy(*strata, "column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")
    )
    index = F.when((F.col("n") >= 5) & (F.col("m") != 0), F.try_divide(F.col("v"), F.col("m")))
    out = cells.withColumn("ratio", index).groupBy("column").agg(F.median("ratio").alias("variability_ratio"))
    return _with_class(out, DISPERSION_STABLE, DISPERSION_VARIABLE, "index_of_dispersion")


def _with_class(df: DataFrame, stable: float, variable: float, method: str) -> DataFrame:
    ratio = F.col("variability_ratio")
    return df.select(
        "column", "variability_ratio",
        _spread_class(ratio, stable, variable).alias("variability_class"),
        F.lit(method).alias("dispersion_method"),
    )


def ok_medians(ok: DataFrame, strata: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(group_key, column) -> median of the OK rows, five decimals."""
    keyed = unpivot(ok.dropna(subset=list(strata)).withColumn("group_key", stratum_key(strata)), ["group_key"], measures)
    cut = select_quantiles(keyed, ["group_key", "column"], [0.5], ["median"])
    return cut.select("group_key", "column", F.round("median", 5).alias("median"))


def _medians_of(ok: DataFrame, strata: Sequence[str], measures: Sequence[str], medians: DataFrame | None) -> DataFrame:
    return ok_medians(ok, strata, measures) if medians is None else medians.filter(F.col("column").isin(list(measures)))


def baseline_a(
    ok: DataFrame,
    strata: Sequence[str],
    rises_is_bad: Mapping[str, bool],
    limits: Mapping[str, Limits],
    medians: DataFrame | None = None,
) -> DataFrame:
    """One-sided drift measures: target if one is given, else the OK median; bad direction.

    ``medians``: the OK medians of these and maybe more measures, if the caller has them."""
    medians = _medians_of(ok, strata, list(rises_is_bad), medians)
    up = [c for c, up in rises_is_bad.items() if up]
    targets = F.broadcast(limits_frame(ok.sparkSession, limits)).select("column", "target")
    return medians.join(targets, "column", "left").select(
        F.lit("A").alias("type"), "column", "group_key",
        F.when(F.col("target").isNotNull(), "given_target").otherwise("group_ok_median").alias("baseline_method"),
        F.coalesce("target", "median").alias("baseline_value"),
        F.when(F.col("column").isin(up), "up").otherwise("down").alias("bad_direction"),
    )


def baseline_b(
    ok: DataFrame,
    strata: Sequence[str],
    measures: Sequence[str],
    limits: Mapping[str, Limits],
    recompute_target: Sequence[str] = (),
    medians: DataFrame | None = None,
) -> DataFrame:
    """Two-sided optimum measures. ``recompute_target`` keeps the OK median although a
    target is given: the limits are trusted, the centre is learned. ``medians`` as in ``baseline_a``."""
    medians = _medians_of(ok, strata, measures, medians)
    targets = F.broadcast(limits_frame(ok.sparkSession, limits)).select("column", "target")
    learned = F.col("column").isin(list(recompute_target)) | F.col("target").isNull()
    return medians.join(targets, "column", "left").select(
        F.lit("B").alias("type"), "column", "group_key",
        F.when(F.col("target").isNull(), "group_ok_median")
        .when(learned, "group_ok_median_recomputed")
        .otherwise("given_target").alias("baseline_method"),
        F.when(learned, F.col("median")).otherwise(F.col("target")).alias("baseline_value"),
    )


def baseline_e(ok: DataFrame, constants: Mapping[str, float]) -> DataFrame:
    """Theoretical constants with the mean and spread the OK rows really show."""
    spark = ok.sparkSession
    table = spark.createDataFrame(
        [(c, float(v)) for c, v in constants.items()], "column string, baseline_value double"
    )
    seen = unpivot(ok, [], list(constants)).groupBy("column").agg(
        F.round(F.avg("value"), 5).alias("reference_ok_mean"),
        F.round(F.stddev_samp("value"), 5).alias("reference_ok_std"),
    )
    return F.broadcast(table).join(seen, "column", "left").select(
        F.lit("E").alias("type"), "column",
        F.lit("theoretical_constant").alias("baseline_method"),
        "baseline_value", "reference_ok_mean", "reference_ok_std",
    )


def override_targets(stats: DataFrame, limits: Mapping[str, Limits]) -> DataFrame:
    """Centre the statistics on a given target and record where the centre comes from."""
    targets = F.broadcast(limits_frame(stats.sparkSession, limits)).select("column", "target")
    joined = stats.join(targets, "column", "left")
    source = F.when(F.col("target").isNotNull(), "given_target").otherwise("empirical")
    return joined.select(
        *[F.coalesce("target", "median").alias("median") if c == "median" else F.col(c) for c in stats.columns],
        source.alias("median_source"),
    )


def resolve_types(ab: DataFrame, c: DataFrame, e: DataFrame) -> DataFrame:
    """One type per column where several tables list it: E before C before A/B."""
    listed = (
        ab.select("column", "type", F.lit(3).alias("priority"))
        .unionByName(c.select("column", F.lit("C").alias("type"), F.lit(2).alias("priority")))
        .unionByName(e.select("column", "type", F.lit(1).alias("priority")))
    )
    return listed.groupBy("column").agg(F.min_by("type", "priority").alias("type"))
