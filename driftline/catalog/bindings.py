"""The driver tables read as process data.

``shots``: one row per event. Users are spread over four machines, three products and two
recipes; the event type is the outcome code. ``panel``: one row per order line; suppliers
are machines, line status and part class the stratum, return flag and line number the
outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.operators.spec import UpperLimit
from driftline.schema import Limits, Roles

SHOTS = Roles(
    entity="machine",
    stratum=("product", "recipe"),
    time="ts",
    key=("shot_id",),
    measures=("value", "k", "load", "ratio"),
    labels=("error", "signup"),
    normal="ng_code NOT IN ('error', 'signup')",
    ok="ng_code <> 'error'",
    limits={"k": Limits(5, 50, 60), "value": Limits(0, 45, 120)},
)

PANEL = Roles(
    entity="machine",
    stratum=("product", "recipe"),
    time="l_shipdate",
    key=("l_orderkey", "l_linenumber"),
    measures=("quantity", "price", "discount", "tax"),
    labels=("returned", "untouched", "first_line"),
    normal="returned = 0 AND l_linenumber <> 7",
    ok="returned = 0",
    limits={"quantity": Limits(2, 25, 49), "discount": Limits(0.0, 0.05, 0.09), "tax": Limits(0.0, 0.04, 0.07)},
)

UPPER = {"load": UpperLimit(200.0, ("error",))}
TYPES = {"load": "A", "ratio": "B", "value": "C", "k": "E"}
RISES_IS_BAD = {"load": True}
WATCHED = {"value": ("error", "signup")}
CONSTANTS = {"k": 50.0}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shots(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    user = F.col("user_id")
    return events.withColumn("k", k).select(
        F.col("event_id").alias("shot_id"),
        "ts",
        F.concat(F.lit("M"), (user % 4).cast("string")).alias("machine"),
        F.concat(F.lit("P"), (F.floor(user / 4) % 3).cast("string")).alias("product"),
        F.concat(F.lit("R"), (F.floor(user / 12) % 2).cast("string")).alias("recipe"),
        F.col("event_type").alias("ng_code"),
        "value",
        "k",
        (F.col("value") * F.col("k") / 100).alias("load"),
        F.try_divide("value", F.col("k") + 1).alias("ratio"),
        (F.col("event_type") == "error").cast("int").alias("error"),
        (F.col("event_type") == "signup").cast("int").alias("signup"),
    )


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate",
        F.concat(F.lit("M"), (F.col("l_suppkey") % 4).cast("string")).alias("machine"),
        F.col("l_linestatus").alias("product"),
        F.concat(F.lit("R"), (F.col("l_partkey") % 3).cast("string")).alias("recipe"),
        F.col("l_returnflag").alias("ng_code"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_returnflag") == "N").cast("int").alias("untouched"),
        (F.col("l_linenumber") == 1).cast("int").alias("first_line"),
    )


SHOTS_SQL = """shots AS (
  SELECT shot_id, ts, machine, product, recipe, product || '|' || recipe AS group_key, ng_code, value, k,
    value * k / 100 AS load, value / (k + 1) AS ratio,
    CASE WHEN ng_code = 'error' THEN 1 ELSE 0 END AS error,
    CASE WHEN ng_code = 'signup' THEN 1 ELSE 0 END AS signup,
    ng_code NOT IN ('error', 'signup') AS is_normal, ng_code <> 'error' AS is_ok,
    CAST(ts AS DATE) AS dt
  FROM (SELECT event_id AS shot_id, ts, 'M' || CAST(user_id % 4 AS VARCHAR) AS machine,
      'P' || CAST((user_id // 4) % 3 AS VARCHAR) AS product,
      'R' || CAST((user_id // 12) % 2 AS VARCHAR) AS recipe,
      event_type AS ng_code, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k
    FROM events))"""

PANEL_SQL = """panel AS (
  SELECT *, product || '|' || recipe AS group_key, returned = 0 AS is_ok,
    returned = 0 AND l_linenumber <> 7 AS is_normal
  FROM (SELECT l_orderkey, l_linenumber, l_shipdate, 'M' || CAST(l_suppkey % 4 AS VARCHAR) AS machine,
      l_linestatus AS product, 'R' || CAST(l_partkey % 3 AS VARCHAR) AS recipe, l_returnflag AS ng_code,
      l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
      CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS untouched,
      CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS first_line
    FROM lineitem))"""
