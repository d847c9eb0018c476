"""From a fact table to early-warning rows: learn the references, run the detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from driftline.functions.expr import without_nan
from driftline.operators import baseline, daily, health, threshold, trend
from driftline.operators.alerts import References, alert_rows, warning_rates
from driftline.operators.spec import UpperLimit
from driftline.schema import Roles
from driftline.sources.writers import save_alerts, save_table
from driftline.store import lookup, stages, together, written


def learn_references(
    df: DataFrame,
    roles: Roles,
    types: Mapping[str, str],
    *,
    rises_is_bad: Mapping[str, bool] | None = None,
    labels: Mapping[str, Sequence[str]] | None = None,
    constants: Mapping[str, float] | None = None,
    upper: Mapping[str, UpperLimit] | None = None,
    directions: DataFrame | None = None,
    recompute_target: Sequence[str] = (),
    training: DataFrame | None = None,
) -> References:
    """Stratum statistics of the normal rows and the typed baselines the types call for."""
    df = without_nan(df)
    training = None if training is None else without_nan(training)
    ok = df.filter(roles.ok)
    rises = dict(rises_is_bad or {})
    watched = {m: tuple(ds) for m, ds in (labels or {}).items() if types.get(m) == "C"}
    pairs = [(m, d) for m, ds in watched.items() for d in ds]
    e = {m: (constants or {})[m] for m, t in types.items() if t == "E"}

    def statistics() -> DataFrame:
        stats = baseline.stratum_stats(df.filter(roles.normal), roles.stratum, roles.measures)
        return lookup(baseline.override_targets(stats, roles.limits))

    def centres() -> DataFrame | None:
        a = {m: rises[m] for m, t in types.items() if t == "A"}
        b = [m for m, t in types.items() if t == "B"]
        if not a and not b:
            return None
        medians = baseline.ok_medians(ok, roles.stratum, [*a, *b])  # of all measures in the same passes
        parts = []
        if a:
            parts.append(baseline.baseline_a(ok, roles.stratum, a, roles.limits, medians).drop("bad_direction"))
        if b:
            parts.append(baseline.baseline_b(ok, roles.stratum, b, roles.limits, recompute_target, medians))
        return lookup(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def thresholds() -> DataFrame | None:
        if not pairs:
            return None
        if training is None:
            learned = threshold.stump_thresholds(df, roles.stratum, sorted(watched), sorted({d for _, d in pairs}), pairs)
        else:
            learned = threshold.routed_thresholds(df, training, roles.stratum, pairs)
        return lookup(learned if directions is None else threshold.agreeing(learned, directions))

    def theory() -> DataFrame | None:
        return lookup(baseline.baseline_e(ok, e)) if e else None

    stats, ab, learned, constants_table = together(df.sparkSession, statistics, centres, thresholds, theory)
    return References(
        stats=stats, types=dict(types), ab=ab, thresholds=learned,
        constants=constants_table,
        rises_is_bad=rises, upper=dict(upper or {}),
    )


def read_references(
    spark: SparkSession,
    paths: Mapping[str, str],
    *,
    rises_is_bad: Mapping[str, bool] | None = None,
    upper: Mapping[str, UpperLimit] | None = None,
) -> References:
    """References from the tables that preprocessing wrote: stratum_stats, and any of baseline_ab, thresholds, baseline_e.

    The type of a measure is the one its table stands for, E before C before A or B. Which way a type A measure goes bad
    is read from the table unless it is given.
    """
    def read(name: str, schema: str) -> DataFrame:
        return spark.read.parquet(paths[name]) if name in paths else spark.createDataFrame([], schema)

    ab = read("baseline_ab", "group_key string, column string, type string, baseline_value double")
    learned = read("thresholds", "group_key string, column string, label string, threshold double, direction string")
    constants = read("baseline_e", "column string, type string, baseline_value double, reference_ok_mean double, reference_ok_std double")
    types = {r["column"]: r["type"] for r in baseline.resolve_types(ab, learned, constants).collect()}  # a row per measure
    rises = dict(rises_is_bad or {})
    if rises_is_bad is None and "bad_direction" in ab.columns:
        known = ab.filter("type = 'A'").select("column", "bad_direction").distinct().collect()
        rises = {r["column"]: r["bad_direction"] == "up" for r in known}
    return References(
        stats=lookup(spark.read.parquet(paths["stratum_stats"])), types=types, ab=lookup(ab), thresholds=lookup(learned),
        constants=lookup(constants), rises_is_bad=rises, upper=dict(upper or {}),
    )


def alert_job(df: DataFrame, roles: Roles, refs: References, folder: str, trends: DataFrame | None = None, **options) -> dict[str, str]:
    """Run the detectors, save the alerts, and report on what was saved; returns the paths.

    Beside the alerts: the number of episodes, the out-of-spec share, and with ``trends`` (entity, column, trend_class)
    the comparison of the trends with the plain daily means.
    """
    with stages(df.sparkSession):
        path = f"{folder.rstrip('/')}/alerts"
        save_alerts(run_alerts(df, roles, refs, **options), path, roles.entity, roles.time)
        saved = df.sparkSession.read.parquet(path)
        paths = {
            "alerts": path,
            "episodes": save_table(health.episode_count(saved, roles), folder, "episodes"),
            "warning_rates": save_table(warning_rates(saved), folder, "warning_rates"),
        }
        if trends is not None:
            keys = [roles.entity, "column"]
            series = written(daily.daily_series(without_nan(df), refs.stats, roles))
            checked = trend.crosscheck(trend.raw_direction(series, keys), trends, keys)
            paths["crosscheck"] = save_table(checked, folder, "crosscheck")
        return paths


def run_alerts(df: DataFrame, roles: Roles, refs: References, **options) -> DataFrame:
    """The alert table: rows with an early warning only."""
    return alert_rows(df, refs, roles, **options)
