"""Writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def save_table(df: DataFrame, folder: str, name: str, subfolder: str | None = None, fmt: str = "parquet") -> str:
    """Overwrite one result table; CSV gets a header and keeps UTF-8."""
    path = "/".join(p for p in (folder.rstrip("/"), subfolder, name) if p)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def save_alerts(alerts: DataFrame, path: str, entity: str, time: str) -> None:
    """Replace the stored alerts, one folder per entity and day.

    Rows are spread by (entity, day) plus a hash salt, so a hot entity is not written by
    one task; each folder gets at most a few files.
    """
    dated = alerts.withColumn("alert_date", F.to_date(time))
    salt = F.pmod(F.xxhash64(*alerts.columns[:3]), F.lit(4))
    dated.repartition(entity, "alert_date", salt).write.mode("overwrite").partitionBy(entity, "alert_date").parquet(path)


def dashboard_records(histogram: DataFrame, daily: DataFrame, entity: str, day: str, fields: Sequence[str], digits: int = 6) -> DataFrame:
    """kind, name, record: one JSON text per measure with its histogram and one per entity with its days.

    Numbers are fixed decimals, so the text does not depend on how floats are printed; missing values are left out. A
    record holds the bins of one measure or the calendar of one entity.
    """
    fixed = lambda c: F.col(c).cast(f"decimal(24,{digits})").alias(c)
    bins = histogram.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("bin", fixed("edge"), "normal_rows", "other_rows"))).alias("bins"))
    days = daily.groupBy(entity).agg(
        F.array_sort(F.collect_list(F.struct(F.col(day).cast("string").alias(day), *[fixed(f) for f in fields]))).alias("days"))
    records = bins.select(F.lit("histogram").alias("kind"), F.col("column").alias("name"), F.to_json(F.struct("column", "bins")).alias("record")).unionAll(
        days.select(F.lit("daily"), F.col(entity), F.to_json(F.struct(entity, "days"))))
    # a zero of more than six digits would be printed with an exponent
    return records.withColumn("record", F.regexp_replace("record", f'":0E-{digits}(?=[,}}])', f'":0.{"0" * digits}'))


def save_records(records: DataFrame, folder: str, name: str) -> str:
    """Records as JSON lines, a folder per kind."""
    path = f"{folder.rstrip('/')}/{name}"
    records.select("kind", F.col("record").alias("value")).write.mode("overwrite").partitionBy("kind").text(path)
    return path
