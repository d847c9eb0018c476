"""Data checks: keys, normal share, missing values, implausible zeros."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from driftline.schema import Roles


def key_report(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: rows, distinct keys, surplus rows, repeats of the last key part, normal rows.

    It reports; ``expect`` turns a report into an error.
    """
    per_key = df.groupBy(*roles.key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr(roles.normal)).alias("normal")
    )
    per_part = per_key.groupBy(roles.key[-1]).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.sum("normal").alias("normal")
    )
    return per_part.agg(
        F.sum("n").alias("row_count"),
        F.sum("keys").alias("unique_keys"),
        (F.sum("n") - F.sum("keys")).alias("duplicate_rows"),
        (F.sum("n") - F.count(F.lit(1))).alias("repeated_last_key"),
        F.sum("normal").alias("normal_count"),
    )


def expect(report: DataFrame, wanted: Mapping[str, int]) -> None:
    """Raise if a one-row report differs from the expected counts."""
    seen = report.first().asDict()
    wrong = {k: (seen[k], v) for k, v in wanted.items() if seen[k] != v}
    if wrong:
        raise ValueError(f"unexpected counts (seen, wanted): {wrong}")


def missing_and_zero(df: DataFrame, columns: Sequence[str], zero_implausible: Sequence[str]) -> DataFrame:
    """Missing rows and implausible zeros per column, from one aggregation over the fact."""
    zero = set(zero_implausible)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in columns],
        *[F.count_if(F.col(c) == 0).alias(f"_z_{c}") for c in columns if c in zero],
    )
    cells = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"_m_{c}").alias("missing_count"),
                    (F.col(f"_z_{c}") if c in zero else F.lit(0).cast("bigint")).alias("zero_count"),
                )
                for c in columns
            ]
        )
    )
    return counts.select("_rows", cells).select(
        "column", "missing_count", F.try_divide("missing_count", "_rows").alias("missing_rate"),
        "zero_count", F.try_divide("zero_count", "_rows").alias("zero_rate"),
        F.lit("flag_only").alias("suggested_handling"),
    )


def numeric_columns(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Columns with at least one value that reads as a number (one row reaches the driver)."""
    row = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in candidates]).first()
    return [c for c in candidates if row[c] > 0]


def analysis_scope(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Which analysis each column takes part in."""
    kind = {True: "numeric_spearman", False: "categorical_association_or_excluded"}
    rows = [(c, kind[c in set(numeric)]) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, analysis_type string")
