"""Exploration plan: correlations, stratified effects, limits, associations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from driftline import store
from driftline.functions.expr import without_nan
from driftline.operators import baseline, daily, explore, quality
from driftline.schema import Roles
from driftline.sources.writers import dashboard_records, save_records, save_table


def stage_pairs(stages: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> list[tuple[str, str]]:
    """Every input of a stage with every output of it (names only), without repeats."""
    return list(dict.fromkeys((x, y) for inputs, outputs in stages.values() for x in inputs for y in outputs))


def explore_fact(
    df: DataFrame,
    roles: Roles,
    stages: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    features: Mapping[str, Sequence[str]],
    categories: Sequence[str],
    outcomes: Sequence[str],
    folder: str,
) -> dict[str, str]:
    """Write the exploration tables below ``folder`` and return their paths."""
    with store.stages(df.sparkSession):
        return _explore(without_nan(df), roles, stages, features, categories, outcomes, folder)


def _explore(df, roles, stages, features, categories, outcomes, folder) -> dict[str, str]:
    numeric = quality.numeric_columns(df, [c for c in df.columns if c not in {roles.time, *roles.key, *categories}])
    pairs = explore.spearman_matrix(df, numeric)
    rates = daily.daily_rates(df, roles, roles.measures[:2], roles.labels)
    averages = [f"{m}_7d_ma" for m in roles.measures[:2]]
    tables = {
        "key_report": quality.key_report(df, roles),
        "correlation_screen": explore.spearman_pairs(df, stage_pairs(stages), {"all": "true", "normal": roles.normal}),
        "effect_ranking": explore.effect_ranking(df, roles.series, features),
        "control_limits": baseline.control_limits(df.filter(roles.normal), roles.stratum, roles.measures),
        "correlation_pairs": pairs.orderBy(F.desc("absolute_r")),
        "process_pairs": explore.process_pairs(pairs, roles.labels).orderBy(F.desc("absolute_r")),
        "associations": explore.cramers_v(df, categories, outcomes).orderBy(F.desc("cramers_v")),
        "scope": quality.analysis_scope(df, numeric),
    }
    paths = {name: save_table(table, folder, name) for name, table in tables.items()}
    bins = explore.histogram(df, roles.measures[:2], roles.normal)
    paths["visual"] = save_records(dashboard_records(bins, rates, roles.entity, "dt", averages), folder, "visual")
    return paths
