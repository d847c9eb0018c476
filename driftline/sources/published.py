"""Alert days that can be written again: versions of days, made visible by a manifest.

Every write goes to a folder of its own, and one manifest row, written last, says which days it covers. A day shows the
rows of the latest write that covers it, so repeating a period replaces exactly its days, also those that have become
empty, and a write that broke off shows nothing. Nothing that a reader may be using is changed in place.
"""

from __future__ import annotations

import datetime as dt
import json
import time as clock

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftline.store import file_system

MANIFEST = "run long, first_day date, last_day date, n_rows long, schema string"


def publish_days(rows: DataFrame, path: str, entity: str, time: str, first_day: dt.date, last_day: dt.date) -> int:
    """Write the rows of a period, one folder per entity and day, then make them visible; returns the number of the write.

    Rows outside the period are left out. Rows are spread by (entity, day) and a hash, so a hot entity is not written by
    one task. There must be one writer at a time.
    """
    spark, run, base = rows.sparkSession, clock.time_ns(), path.rstrip("/")
    dated = rows.withColumn("alert_date", F.to_date(time)).where(F.col("alert_date").between(F.lit(first_day), F.lit(last_day)))
    salt = F.pmod(F.xxhash64(*rows.columns[:3]), F.lit(4))
    target = f"{base}/runs/run={run}"
    dated.repartition(entity, "alert_date", salt).write.partitionBy(entity, "alert_date").parquet(target)
    schema = T.StructType([*rows.schema.fields, T.StructField("alert_date", T.DateType())])
    written = spark.read.schema(schema).parquet(target).count()
    row = [(run, first_day, last_day, written, schema.json())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifest")
    return run


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished write."""
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest")


def visible_days(spark: SparkSession, path: str) -> DataFrame:
    """(alert_date, run): the write that each covered day shows; bounded by the calendar."""
    days = manifest(spark, path).select("run", F.explode(F.sequence("first_day", "last_day")).alias("alert_date"))
    return days.groupBy("alert_date").agg(F.max("run").alias("run"))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The visible rows with alert_date; columns as in the latest write. Folders of other writes are pruned."""
    latest = manifest(spark, path).agg(F.max_by("schema", "run")).first()[0]  # the text of a schema
    schema = T.StructType.fromJson(json.loads(latest)).add("run", T.LongType())
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/runs")
    shown = visible_days(spark, path).withColumnsRenamed({"alert_date": "_day", "run": "_run"})
    return rows.join(F.broadcast(shown), (F.col("alert_date") == F.col("_day")) & (F.col("run") == F.col("_run"))).drop("_day", "_run", "run")


def remove_superseded(spark: SparkSession, path: str) -> int:
    """Delete the folders of writes that no day shows any more, and of broken ones before the latest; returns how many."""
    base = f"{path.rstrip('/')}/runs"
    system, target = file_system(spark, base)
    last = manifest(spark, path).agg(F.max("run")).first()[0]
    kept = {r["run"] for r in visible_days(spark, path).select("run").distinct().collect()}  # writes, not rows
    gone = 0
    for folder in system.listStatus(target):
        name = folder.getPath().getName()
        if name.startswith("run=") and int(name[4:]) not in kept and int(name[4:]) < last:
            gone += bool(system.delete(folder.getPath(), True))
    return gone
