"""The steps as jobs: preprocessing writes its tables, alerting reads them and writes its own."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.plans.alerting import alert_job, learn_references, read_references, run_alerts
from driftline.plans.preprocess import PreprocessOptions, preprocess_raw
from driftline.schema import Limits, Roles
from driftline.store import work_folder

ROLES = Roles(entity="m", stratum=("product", "recipe"), time="ts", key=("id",), measures=("a", "b", "c", "e"), labels=("bad",), normal="bad = 0", ok="bad = 0",
              limits={"a": Limits(-4.0, 0.0, 4.0)})
OPTIONS = PreprocessOptions(pairs=[("c", "bad")], rises_is_bad={"a": True}, two_sided=["b"], constants={"e": 5.0}, permutations=2, min_labels=0, consistency=("c", "c"))


@pytest.fixture(scope="module")
def fact(spark):
    draw, rows = np.random.default_rng(6), []
    for i in range(1200):
        shift = 2.0 if i % 3 == 0 and i > 700 else 0.0
        c = float(round(draw.normal(), 3))
        values = [float(round(draw.normal() + shift, 3)), float(round(draw.normal() - shift, 3)), c, float(round(5 + draw.normal() / 9, 3))]
        if i % 50 == 0:
            values[i // 50 % 4] = float("nan")
        rows.append((f"M{i % 3}", f"P{i % 2}", "R", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, *values, int(c > 1.2)))
    return spark.createDataFrame(rows, "m string, product string, recipe string, ts timestamp_ntz, id long, a double, b double, c double, e double, bad int")


def shown(df):
    cells = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(cells(v) for v in r) for r in df.select(sorted(df.columns)).collect())


def test_alerts_from_files_equal_those_in_memory(spark, fact, tmp_path):
    before = set(map(str, _stage_folders(spark)))
    texts = fact.select([F.col(c).cast("string").alias(c) for c in fact.columns])
    spoilt = texts.limit(1).withColumn("ts", F.lit("never"))
    kinds = {"ts": "timestamp_ntz", "id": "bigint", "bad": "int", **dict.fromkeys(ROLES.measures, "double")}
    paths = preprocess_raw(texts.unionAll(spoilt), ROLES, OPTIONS, f"{tmp_path}/references", kinds, expected_rows=1201, relation_tables=(None, None))
    assert [r["reasons"] for r in spark.read.parquet(paths["rejects"]).collect()] == [["ts: unreadable"]]
    assert tuple(spark.read.parquet(paths["load_notes"]).first()) == (1201, 1, "no training table")
    assert set(map(str, _stage_folders(spark))) == before  # nothing is left behind
    summary = json.loads(spark.read.json(paths["summary"]).first()["summary"])
    assert summary["consistency"]["spearman_r"] > 0.99 and sum(summary["subsystem_column_counts"].values()) == len(fact.columns) + 1
    assert summary["pending_review_columns"] == {} and summary["excluded_columns"] == [] and "a" in summary["included_columns"]
    assert json.loads(summary["included_columns"]) == summary["include_in_downstream_default_columns"]  # text and list
    assert {tuple(r) for r in spark.read.parquet(paths["pairing"]).collect()} == {("c", "bad", "fallback")}
    refs = read_references(spark, paths)
    assert refs.types == {"a": "A", "b": "B", "c": "C", "e": "E"} and refs.rises_is_bad == {"a": True}
    memory = learn_references(fact, ROLES, refs.types, rises_is_bad={"a": True}, labels={"c": ("bad",)}, constants={"e": 5.0})
    want = shown(run_alerts(fact, ROLES, memory).drop("message"))
    assert want and shown(run_alerts(fact, ROLES, refs).drop("message")) == want

    out = alert_job(fact, ROLES, refs, f"{tmp_path}/alerts", spark.read.parquet(paths["trends"]))
    saved = spark.read.parquet(out["alerts"])
    assert saved.count() == len(want)
    episodes = saved.select("m", "product", "recipe", "column", "episode_id").distinct().count()
    assert spark.read.parquet(out["episodes"]).first()["episodes"] == episodes
    assert spark.read.parquet(out["warning_rates"]).first()["alert_rows"] == len(want)
    assert spark.read.parquet(out["crosscheck"]).count() > 0


def _stage_folders(spark):
    from pathlib import Path

    return Path(work_folder(spark).removeprefix("file:")).glob("stage-*")


def test_published_days_are_replaced_and_broken_writes_stay_hidden(spark, tmp_path):
    from driftline.sources.published import publish_days, read_published, remove_superseded

    day, path = dt.date(2024, 1, 1), f"{tmp_path}/days"
    stamp = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=3)
    rows = lambda mark, days: spark.createDataFrame([("007", stamp(d), mark) for d in days], "m string, ts timestamp_ntz, mark string")
    at = lambda n: day + dt.timedelta(days=n)
    shown = lambda: sorted((r["m"], r["ts"].day, r["mark"]) for r in read_published(spark, path).collect())
    publish_days(rows("a", [0, 1, 2, 3, 9]), path, "m", "ts", at(0), at(3))  # the tenth day is outside the period
    assert shown() == [("007", d, "a") for d in (1, 2, 3, 4)]
    second = publish_days(rows("b", [3, 4]), path, "m", "ts", at(2), at(4))  # the third day has become empty
    want = [("007", 1, "a"), ("007", 2, "a"), ("007", 4, "b"), ("007", 5, "b")]
    assert shown() == want
    for run in (second - 1, second + 1):  # writes without a line in the manifest
        rows("c", [0, 4]).selectExpr("*", "to_date(ts) as alert_date").write.partitionBy("m", "alert_date").parquet(f"{path}/runs/run={run}")
    assert shown() == want
    assert remove_superseded(spark, path) == 1 and shown() == want
    publish_days(rows("d", []), path, "m", "ts", at(0), at(4))
    assert shown() == [] and remove_superseded(spark, path) == 3


def test_dashboard_records_hold_one_entity_and_plain_decimals(spark):
    import json

    from driftline.sources.writers import dashboard_records, save_records

    bins = spark.createDataFrame([("a", 1, 0.5, 2, 0), ("a", 0, 0.0, 3, 1)], "column string, bin int, edge double, normal_rows long, other_rows long")
    daily = spark.createDataFrame([("m1", dt.date(2024, 1, 2), None), ("m1", dt.date(2024, 1, 1), 1e-7), ("m2", dt.date(2024, 1, 1), 3e9)], "m string, dt date, v double")
    got = {(r["kind"], r["name"]): r["record"] for r in dashboard_records(bins, daily, "m", "dt", ["v"], digits=8).collect()}
    assert got["histogram", "a"] == ('{"column":"a","bins":[{"bin":0,"edge":0.00000000,"normal_rows":3,"other_rows":1},'
                                     '{"bin":1,"edge":0.50000000,"normal_rows":2,"other_rows":0}]}')
    assert json.loads(got["daily", "m1"])["days"] == [{"dt": "2024-01-01", "v": 1e-7}, {"dt": "2024-01-02"}]
    assert json.loads(got["daily", "m2"])["days"][0]["v"] == 3e9


def test_loading_keeps_what_it_cannot_read(spark):
    from driftline.plans.loading import load, load_training

    roles = Roles("m", (), "ts", ("id",), ("a", "b"), normal="a > 0")
    rows = [("1", "2024-01-01 00:00", "x", "1.5", "2"), ("2", "soon", "x", "1", "2"), ("3", "2024-01-02 00:00", None, "1", "n/a"),
            ("q", None, None, "1", "2"), ("5", "2024-01-03 00:00", "x", "NaN", "oops"), ("6", "2024-01-03 00:00", "x", None, None)]
    raw = spark.createDataFrame(rows, "id string, ts string, m string, a string, b string")
    kinds = {"id": "bigint", "ts": "timestamp_ntz", "a": "double", "b": "double"}
    run = lambda **more: load(raw, roles, kinds, time_format="yyyy-MM-dd HH:mm", **more)
    got = run(features=lambda df: df.selectExpr("*", "a * b as ab"), expected_rows=6)
    assert (got.rows, got.rejected) == (6, 3)
    assert sorted(map(tuple, got.fact.select("id", "a", "b", "ab", "is_normal").collect())) == [
        (1, 1.5, 2.0, 3.0, True), (5, None, None, None, False), (6, None, None, None, False)]
    assert sorted((r["id"], r["ts"], sorted(r["reasons"])) for r in got.rejects.collect()) == [
        ("2", "soon", ["ts: unreadable"]), ("3", "2024-01-02 00:00", ["b: unreadable", "m: missing"]),
        ("q", None, ["id: unreadable", "m: missing", "ts: missing"])]
    assert {tuple(r) for r in got.report.collect()} == {
        ("ts: unreadable", 1, 1), ("b: unreadable", 2, 1), ("m: missing", 2, 2), ("id: unreadable", 1, 1), ("ts: missing", 1, 1)}
    with pytest.raises(ValueError, match="6 rows, expected 7"):
        run(expected_rows=7)
    assert load_training(None) == (None, "no training table")
    assert load_training(lambda: run(expected_rows=7)) == (None, "training table left out: 6 rows, expected 7")
    assert load_training(run)[0].count() == 3
    nothing = load(raw.limit(0), roles, kinds)
    assert (nothing.rows, nothing.fact.count(), nothing.report.count()) == (0, 0, 0)


def test_pairs_come_from_the_relation_tables_or_from_the_fallback_alone(spark):
    from driftline.operators.relations import PASSED, pairing_in_use

    pairs = lambda *rows: spark.createDataFrame(list(rows), "factor string, defect string")
    fallback, verified, alarm = pairs(("x", "d")), pairs(("a", "e"), ("b", "e")), pairs(("b", "f"), ("c", "f"))
    interface = spark.createDataFrame([("a", "d", "True"), ("q", "d", "False")], "factor string, defect string, alert_usable string")
    tiers = spark.createDataFrame([("a", "d", f" {PASSED} ", "w"), ("q", "d", PASSED, "w")], "factor string, defect string, repro_state string, watch_mode string")
    shown = lambda i, t: sorted(map(tuple, pairing_in_use(i, t, fallback, verified, alarm).collect()))
    assert shown(interface, tiers) == [("a", "d", "relation"), ("b", "e", "verified"), ("c", "f", "alarm_only")]
    for i, t in ((None, tiers), (interface, None), (interface.drop("alert_usable"), tiers)):
        assert shown(i, t) == [("x", "d", "fallback")]


def test_columns_that_must_move_together(spark):
    from driftline.plans.preprocess import check_consistency

    df = spark.range(50).selectExpr("cast(id as double) as x", "cast(id * id as double) as y", "cast(-id as double) as z")
    assert check_consistency(df, "x", "y") == check_consistency(df, "x", "-z") == 1.0
    for wrong in ("z", "-y"):
        with pytest.raises(ValueError):
            check_consistency(df, "x", wrong)
