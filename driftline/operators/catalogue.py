"""The column catalogue: data type, role, dispersion, trend, faults and notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftline.schema import Roles


@dataclass(frozen=True)
class ColumnRules:
    """Plain lists that decide type and role of a column; the first match wins."""

    subsystems: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ids: Sequence[str] = ()
    categories: Sequence[str] = ()
    counts: Sequence[str] = ()
    label_counts: Sequence[str] = ()
    excluded_ids: Sequence[str] = ()
    excluded_measures: Sequence[str] = ()
    excluded_labels: Sequence[str] = ()
    outcomes: Sequence[str] = ()
    undocumented: Sequence[str] = ()
    undocumented_kept: Sequence[str] = ()
    notes: Mapping[str, str] = field(default_factory=dict)
    pending: Mapping[str, str] = field(default_factory=dict)


# Roles that go downstream by default.
INCLUDED_ROLES = ("predictor", "context_stratum", "target_defect", "target_outcome", "undocumented_retained")


def taxonomy(spark: SparkSession, columns: Sequence[str], roles: Roles, rules: ColumnRules) -> DataFrame:
    """column, subsystem, data_type, analysis_role of every fact column (metadata)."""
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, column string")
    c = F.col("column")

    def among(values: Sequence[str]) -> Column:
        return c.isin(list(values)) if values else F.lit(False)

    subsystem = F.lit("id_production")
    for name, members in reversed(list(rules.subsystems.items())):
        subsystem = F.when(among(members), name).otherwise(subsystem)
    data_type = (
        F.when(c == roles.time, "datetime").when(among(rules.ids), "id").when(among(rules.categories), "categorical")
        .when(among(roles.labels), "binary").when(among(rules.counts), "count").otherwise("continuous")
    )
    role = (
        F.when(c == roles.time, "datetime")
        .when(among(rules.excluded_ids), "identifier_excluded")
        .when(among(rules.excluded_measures), "excluded_by_expert")
        .when(among(roles.series), "context_stratum")
        .when(among(rules.outcomes), "target_outcome")
        .when(among(rules.excluded_labels), "excluded_defect")
        .when(among([*roles.labels, *rules.label_counts]), "target_defect")
        .when(among(rules.undocumented), "undocumented_excluded")
        .when(among(rules.undocumented_kept), "undocumented_retained")
        .otherwise("predictor")
    )
    return names.select(
        "position", "column", subsystem.alias("subsystem"), data_type.alias("data_type"), role.alias("analysis_role")
    )


def classification(
    base: DataFrame, spread: DataFrame, trend: DataFrame, faults: DataFrame, flat: DataFrame, rules: ColumnRules,
    roles: Roles, n_rows: int,
) -> DataFrame:
    """The catalogue with dispersion, trend summary, fault rates, notes and default flag.

    All inputs have one row per column, so every join is a broadcast of metadata.
    """
    notes = base.sparkSession.createDataFrame(
        [(c, rules.notes.get(c, ""), rules.pending.get(c, "")) for c in sorted({*rules.notes, *rules.pending, ""})],
        "column string, note string, pending string",
    )
    joined = base
    for part in (spread, trend, faults, flat, notes):
        joined = joined.join(F.broadcast(part), "column", "left")
    c = F.col("column")
    return joined.select(
        "position", "column", "subsystem", "data_type", "analysis_role",
        F.coalesce("variability_class", F.lit("not_applicable")).alias("variability_class"),
        "variability_ratio",
        F.coalesce("dispersion_method", F.lit("not_applicable")).alias("dispersion_method"),
        F.coalesce("trend_class", F.lit("not_applicable")).alias("degradation_trend_class"),
        "missing_rate", F.col("zero_rate").alias("zero_fault_rate"),
        (F.coalesce("flatline_count", F.lit(0)) / F.lit(max(n_rows, 1))).alias("flatline_fault_rate"),
        c.isin(list(roles.stratum)).alias("is_operation_condition_key"),
        (F.coalesce("pending", F.lit("")) != "").alias("pending_review"),
        F.col("analysis_role").isin(list(INCLUDED_ROLES)).alias("include_in_downstream_default"),
        F.concat_ws(" ", F.nullif("note", F.lit("")), F.nullif("pending", F.lit(""))).alias("decision_note"),
    )


def analysis_columns(catalogue: DataFrame) -> list[str]:
    """Continuous predictors, in column order (metadata)."""
    rows = catalogue.filter("data_type = 'continuous' and analysis_role = 'predictor'").orderBy("position").collect()
    return [r["column"] for r in rows]
