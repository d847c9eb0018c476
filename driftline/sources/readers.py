"""Reading fact, relation and artefact tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftline.functions.expr import without_nan
from driftline.schema import Roles, require_columns


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by default; CSV (with header, declared schema) and JSON by file ending."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith((".csv", ".csv.gz")):
        if schema is None:
            return reader.option("header", True).csv(path)
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def load_fact(df: DataFrame, roles: Roles, time_format: str | None = None) -> DataFrame:
    """Parse the time column, turn NaN into null and add the normal flag."""
    kind = df.schema[roles.time].dataType
    time = F.to_timestamp_ntz(roles.time, F.lit(time_format)) if time_format else F.to_timestamp_ntz(roles.time)
    stamped = df if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) else df.withColumn(roles.time, time)
    clean = without_nan(stamped)
    return clean.withColumn("is_normal", F.coalesce(F.expr(roles.normal), F.lit(False)))


def read_optional(
    spark: SparkSession, path: str, needed: Sequence[str], schema: T.StructType | str
) -> DataFrame:
    """A relation table, or an empty one if it is absent or lacks a needed column."""
    empty = spark.createDataFrame([], schema)
    try:
        table = read_table(spark, path)
    except AnalysisException:
        return empty
    return table if require_columns(table, set(needed)) else empty


def read_training(spark: SparkSession, path: str, expected_rows: int | None = None) -> tuple[DataFrame | None, str | None]:
    """The optional training-only table and a warning text; never merged with the fact."""
    try:
        table = read_table(spark, path)
    except AnalysisException:
        return None, f"no training table at {path}"
    if expected_rows is not None and (n := table.count()) != expected_rows:
        return table, f"training table has {n} rows, expected {expected_rows}"
    return table, None


SNAPSHOT = (
    "machines map<string, struct<health_index: double, defect_signals: map<string, "
    "struct<health_index: double, causes: map<string, struct<alert_active_days: double, "
    "health_index: double, margin_used_pct: double>>>>>>"
)


def flatten_snapshot(texts: DataFrame, column: str) -> DataFrame:
    """Nested health snapshot (JSON text) as rows: machine, defect, factor, metrics."""
    parsed = texts.select(F.from_json(column, SNAPSHOT).alias("s"))
    machines = parsed.select(F.explode("s.machines").alias("machine", "m"))
    signals = machines.select("machine", F.col("m.health_index").alias("machine_health"), F.explode("m.defect_signals").alias("defect", "d"))
    causes = signals.select("machine", "machine_health", "defect", F.explode("d.causes").alias("factor", "c"))
    return causes.select("machine", "machine_health", "defect", "factor", "c.alert_active_days", "c.health_index", "c.margin_used_pct")


def summary_text(report: DataFrame, extra: dict) -> DataFrame:
    """A one-row report and fixed facts, nested ones too, as one JSON text."""
    facts = json.dumps(extra, ensure_ascii=False, separators=(",", ":"))[1:]
    open_end = F.regexp_replace(F.to_json(F.struct(*report.columns)), r"\}$", "," if extra else "")
    return report.select(F.concat(open_end, F.lit(facts)).alias("summary"))
