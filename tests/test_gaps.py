"""NaN, nulls and awkward strata: missing values never count as limits broken, zones entered or values learned."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline import store
from driftline.functions import expr
from driftline.operators import alerts, quantiles, spec, splits
from driftline.operators.spec import UpperLimit
from driftline.plans.alerting import learn_references, run_alerts
from driftline.schema import Limits, Roles, stratum_key
from driftline.streaming import live

T0 = dt.datetime(2024, 1, 1)
ROLES = Roles(entity="m", stratum=("p", "r"), time="ts", key=("id",), measures=("v",), labels=("bad",), normal="bad = 0", ok="bad = 0",
              limits={"v": Limits(0, 5, 10)})


def fact(spark, fill, strata=("P", "R")):
    rows = [("M", *strata, T0 + dt.timedelta(hours=i), i, fill if i % 2 else float(i % 7), 0) for i in range(100)]
    return spark.createDataFrame(rows, "m string, p string, r string, ts timestamp_ntz, id long, v double, bad int")


def test_nan_is_like_null(spark):
    nan, null = fact(spark, float("nan")), fact(spark, None)
    assert spec.spec_rules(nan, ROLES).first()["rate"] == 0
    upper = {"v": UpperLimit(8.0)}
    assert spec.breach_days(nan, ROLES, upper).agg(F.sum("n_over")).first()[0] == 0
    part = ["p", "column"]
    for df in (nan, null):
        counts = quantiles.value_counts(quantiles.unpivot(df, ["p"], ["v"]), part)
        assert counts.agg(F.sum("n")).first()[0] == 50
    zone = nan.select(expr.in_zone(F.col("v"), F.lit(3.0), F.lit("high_is_risky")).alias("z"), "v")
    assert zone.where("z and isnan(v)").isEmpty()
    want, got = [], []
    for df, out in ((null, want), (nan, got)):
        refs = learn_references(df, ROLES, {"v": "B"}, upper=upper)
        out += sorted(map(tuple, refs.stats.collect())) + sorted(map(str, run_alerts(df, ROLES, refs).collect()))
    assert got == want


def test_strata_with_nulls_and_bars(spark):
    rows = [(None, "A"), ("A", None), ("A|B", "C"), ("A", "B|C"), ("A\\", "C"), ("A", "C")]
    keys = [r[0] for r in spark.createDataFrame(rows, "p string, r string").select(stratum_key(("p", "r"))).collect()]
    assert keys[:2] == [None, None] and len(set(keys[2:])) == 4 and keys[5] == "A|C"
    odd = fact(spark, 99.0, ("P", None))
    refs = learn_references(fact(spark, 1.0), ROLES, {"v": "B"})
    assert alerts.alert_rows(odd, refs, ROLES).isEmpty()


def test_rows_without_a_time_are_test_rows(spark):
    rows = [(i, None if i % 5 == 0 else T0 + dt.timedelta(days=i)) for i in range(50)]
    got = {r["id"]: r["split"] for r in splits.time_split(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), "ts", ["id"], 0.3).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or T0, r[0]))
    assert [got[i] for i, _ in ordered] == ["train"] * 35 + ["test"] * 15


def test_lookup_checks_bytes_and_scopes_clean_up(spark):
    df = spark.range(1000).withColumn("t", F.sha2(F.col("id").cast("string"), 256))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(store.lookup(df)) and not hinted(store.lookup(df, max_rows=999)) and not hinted(store.lookup(df, max_bytes=10_000))
    with store.stages(spark) as own:
        assert store.written(df).count() == 1000
        assert len(own) == 1 and store.written_bytes(spark, own[0]) > 10_000
    with pytest.raises(Exception):
        store.written_bytes(spark, own[0])


def test_pacing_counts_from_the_last_notice(spark, tmp_path):
    days = [3, 4, 9, 10, 11, 16, 17, 30]
    rows = [("M", "v", T0, T0 + dt.timedelta(days=d - 1)) for d in days]
    spark.createDataFrame(rows, "m string, column string, since timestamp, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("m string, column string, since timestamp, ts timestamp").parquet(f"{tmp_path}/in")
    query = live.paced_notifications(stream, "m", "ts").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = sorted(pd.Timestamp(r["ts"]).day for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [3, 10, 17, 30]


def test_rank_matrix_of_many_columns_with_gaps(spark):
    import numpy as np

    from driftline.operators.explore import spearman_matrix

    draw = np.random.default_rng(4)
    data = draw.normal(size=(300, 30)).round(1)
    data[:, 1] = data[:, 0] * 2
    data[:, 2] = 7.0
    data[draw.random(data.shape) < 0.1] = np.nan
    frame = pd.DataFrame(data, columns=[f"c{i}" for i in range(30)])
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"c{i} double" for i in range(30)))
    got = {(r["variable_1"], r["variable_2"]): r["spearman_r"] for r in spearman_matrix(df, list(frame.columns)).collect()}
    ranks = frame.rank()  # each column is ranked once, a pair uses the rows with both
    want = ranks.corr()
    assert len(got) == 29 * 28 // 2
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=6e-5)
    plan = spearman_matrix(df, list(frame.columns))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_flat_runs_against_brute_force(spark):
    import random

    from driftline.operators.sequence import flatline_counts

    draw = random.Random(2)
    rows = [(f"M{i % 2}", T0 + dt.timedelta(minutes=i), i, draw.choice([1.0, 1.0, 1.0, 2.0, None]), 5.0) for i in range(400)]
    roles = Roles(entity="m", stratum=("m",), time="ts", key=("id",), measures=("v", "w"))
    df = spark.createDataFrame(rows, "m string, ts timestamp_ntz, id long, v double, w double")
    for least, limit in ((2, None), (5, None), (3, 40)):
        want = {}
        for at, name in ((3, "v"), (4, "w")):
            runs = []
            for m in ("M0", "M1"):
                last = object()
                for r in rows:
                    if r[0] == m:
                        if r[at] is not None and r[at] == last:
                            runs[-1] += 1
                        else:
                            runs.append(1)
                        last = r[at]
            want[name] = (sum(n for n in runs if n >= least), max(runs))
        got = {r["column"]: (r["flatline_count"], r["longest_run"]) for r in flatline_counts(df, roles, least, limit=limit).collect()}
        assert got == want
    assert flatline_counts(df.limit(0), roles).count() == 0


def test_limit_rules_feed_the_detector(spark):
    table = spark.createDataFrame([("x", "n/a", "chip", "E1", 0), ("x", "8.5", "burn", "E2", 1), ("x", "9", "chip", "E1", 2), ("y", "none", "chip", "E1", 0)],
                                  "factor string, upper_limit string, defect string, evidence_level string, position int")
    assert spec.upper_rules(table) == {"x": UpperLimit(8.5, ("burn", "chip"))}
