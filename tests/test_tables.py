"""Relations, splits, features, sources, sinks, plans and streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftline.functions import expr
from driftline.operators import baseline, quality, relations, splits
from driftline.plans.exploration import explore_fact, stage_pairs
from driftline.plans.preprocess import PreprocessOptions, check_consistency, preprocess
from driftline.schema import HIGH, LOW, Limits, Roles, require_columns
from driftline.sources import readers, writers
from driftline.streaming import live

T0 = dt.datetime(2024, 1, 1)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# ------------------------------------------------------------------ relations

def test_adopted_pairs_need_both_verdicts(spark):
    iface = frame(spark, "factor string, defect string, alert_usable string, threshold_direction string",
                  ("f", "a", "True", "아래로 내려가면 위험"), ("f", "b", "false", "위로 올라가면 위험"),
                  ("g", "a", "TRUE", "?"), ("h", "a", "True", " 위로 올라가면 위험 "))
    tiers = frame(spark, "factor string, defect string, repro_state string, watch_mode string",
                  ("f", "a", " 통과", "level"), ("f", "b", "통과", "level"), ("g", "a", "판정불가", "level"))
    detail = relations.adopted_pairs(iface, tiers)
    assert [(r["factor"], r["defect"]) for r in detail.filter("adopted").collect()] == [("f", "a")]
    assert relations.adopted_pairs(iface.drop("alert_usable"), tiers) is None
    verified = frame(spark, "factor string, defect string", ("f", "c"), ("g", "c"))
    alarm = frame(spark, "factor string, defect string", ("g", "d"), ("k", "d"))
    got = {(r["factor"], r["defect"], r["origin"]) for r in relations.resolved_pairs(detail, verified, alarm).collect()}
    assert got == {("f", "a", "relation"), ("g", "c", "verified"), ("k", "d", "alarm_only")}
    known = {(r["column"], r["label"]): r["direction"] for r in relations.known_directions(iface).collect()}
    assert known == {("f", "a"): LOW, ("f", "b"): HIGH, ("h", "a"): HIGH}
    assert relations.known_directions(iface.drop("threshold_direction")).count() == 0


def test_pair_flag_beats_factor_flag(spark):
    factors = frame(spark, "factor string, defect string, factor_usable boolean",
                    ("a", "x", True), ("a", "y", True), ("b", "x", False), ("c", "x", False), ("d", "x", None))
    flags = frame(spark, "factor string, defect string, pair_usable boolean", ("a", "y", False), ("c", "x", True))
    usable = relations.usable_defects(factors, flags)
    got = {(r["factor"], r["defect"]) for r in usable.collect()}
    assert got == {("a", "x"), ("c", "x"), ("d", "x")}
    verified = frame(spark, "factor string, defect string", ("a", "x"), ("z", "x"))
    scored = {(r["factor"], r["defect"]) for r in relations.scored_defects(usable, verified).collect()}
    assert scored == {("a", "x")} <= got
    assert relations.scored_defects(usable, None).count() == 3


def test_most_urgent_tier_wins_whatever_the_order(spark):
    rows = [("f", "x", "T2"), ("f", "a", "T1"), ("g", "z", "M1"), ("g", "y", "T4"), ("h", "x", "??"), ("h", "y", "M1")]
    for order in (rows, rows[::-1]):
        got = {r["factor"]: r["defect"] for r in relations.most_urgent(frame(spark, "factor string, defect string, tier string", *order)).collect()}
        assert got == {"f": "a", "g": "y", "h": "y"}


def test_factor_without_direction_is_watched_both_ways(spark):
    known = frame(spark, "factor string, direction string", ("flow", LOW), ("temp", HIGH))
    got = {r[0]: r[1] for r in relations.directions_of(frame(spark, "factor string", ("flow",), ("temp",), ("x",)), known).collect()}
    assert got == {"flow": "down", "temp": "up", "x": "either"}


def test_pair_survival_names_every_reason(spark):
    schema = "column string, label string, group_key string, direction string"
    raw = frame(spark, schema, ("v", "d", "g1", LOW), ("v", "d", "g2", HIGH), ("v", "d", "g4", LOW))
    kept = raw.filter("group_key = 'g1'")
    groups = frame(spark, "group_key string", ("g1",), ("g2",), ("g3",), ("g4",))
    known = frame(spark, "column string, label string, direction string", ("v", "d", LOW))
    got = {r["group_key"]: r["state"] for r in relations.pair_survival([("v", "d")], groups, kept, raw, known).collect()}
    assert got == {"g1": "learned", "g2": "expected_missing", "g3": "expected_missing", "g4": "unexplained"}
    twice = relations.pair_survival([("v", "d")], groups.filter("group_key = 'g1'"), kept.union(kept), raw, known)
    assert [r["state"] for r in twice.collect()] == ["duplicate"]


def test_same_set(spark):
    a, b = frame(spark, "x int", (1,), (2,), (2,)), frame(spark, "x int", (2,), (1,))
    assert relations.same_set(a, b, ["x"]) and not relations.same_set(a, b.filter("x = 1"), ["x"])


# ------------------------------------------------------------------ features

def test_features(spark):
    df = frame(spark, "a double, b double, c double", (1.0, 0.0, 4.0), (6.0, 3.0, None), (None, 1e-12, 2.0))
    got = df.select(
        expr.guarded_ratio(F.col("a"), F.col("b")).alias("r"), expr.row_std(["a", "b", "c"]).alias("s"),
        expr.exceedance(F.col("a"), F.lit(2.0), F.lit(5.0)).alias("e"),
    ).collect()
    assert [r["r"] for r in got] == [None, 2.0, None]
    assert [r["s"] for r in got] == pytest.approx([2.081666, 2.12132, 1.4142136], abs=1e-5)
    assert [r["e"] for r in got] == [1.0, 1.0, None]


def test_zone_inclusivity(spark):
    df = frame(spark, "v double, t double, d string", (5.0, 5.0, LOW), (5.0, 5.0, HIGH), (None, 5.0, LOW), (1.0, None, LOW))
    strict = [r[0] for r in df.select(expr.in_zone(F.col("v"), F.col("t"), F.col("d"))).collect()]
    wide = [r[0] for r in df.select(expr.in_zone(F.col("v"), F.col("t"), F.col("d"), True)).collect()]
    assert strict == [False, False, False, None] and wide == [True, True, False, None]


def test_zone_from_range_text(spark):
    df = frame(spark, "v double, t double, r string", (4.0, 5.0, "1.0~5.0"), (6.0, 5.0, "1.0~5.0"), (6.0, 5.0, "5.0~9"), (4.0, 5.0, "5~9"))
    assert [r[0] for r in df.select(expr.zone_from_range(F.col("v"), F.col("t"), F.col("r"))).collect()] == [True, False, True, False]


def test_null_keys_match_in_robust_scores(spark):
    rows = [(None, "r", float(v)) for v in range(9)] + [("p", "r", 5.0)] * 4
    df = frame(spark, "product string, recipe string, v double", *rows)
    stats = baseline.stratum_stats(df, ["product", "recipe"], ["v"])
    scored = baseline.robust_z(df, stats, ["product", "recipe"], ["v"])
    by = {(r["product"], r["v"]): r["v_z"] for r in scored.collect()}
    assert by[(None, 8.0)] == pytest.approx(4 / (1.4826 * 2)) and by[("p", 5.0)] is None
    assert stats.filter("product = 'p'").first()["std"] == 0.0
    blocked = {r["product"]: r["mad"] for r in baseline.stratum_stats(df, ["product", "recipe"], ["v"], limit=4).collect()}
    assert blocked == {None: 2.0, "p": 0.0}


def test_single_row_group_has_no_std(spark):
    df = frame(spark, "p string, v double", ("a", 1.0))
    assert baseline.stratum_stats(df, ["p"], ["v"]).first()["std"] is None


# ------------------------------------------------------------------ splits

@pytest.mark.parametrize("limit", [None, "40"])
def test_splits_are_exact(spark, limit):
    if limit:
        spark.conf.set("driftline.maxGroupRows", limit)
    try:
        rows = [(i, T0 + dt.timedelta(hours=(i * 37) % 300), "x" if i % 4 else "y") for i in range(403)]
        df = frame(spark, "id bigint, ts timestamp_ntz, label string", *rows)
        train = splits.time_split(df, "ts", ["id"]).filter("split = 'train'").collect()
        want = sorted(rows, key=lambda r: (r[1], r[0]))[: int(403 * 0.8)]
        assert {r["id"] for r in train} == {r[0] for r in want}
        out = splits.stratified_split(df, "label", ["id"])
        got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
        assert got == {("x", "test"): 61, ("x", "train"): 241, ("y", "test"): 20, ("y", "train"): 81}
        again = splits.stratified_split(df.repartition(7), "label", ["id"])
        assert relations.same_set(out, again, ["id", "split"])
    finally:
        spark.conf.unset("driftline.maxGroupRows")


def test_split_needs_two_rows_per_class(spark):
    with pytest.raises(ValueError):
        splits.stratified_split(frame(spark, "id int, y int", (1, 0), (2, 0), (3, 1)), "y", ["id"])


# ------------------------------------------------------------------ sources, sinks, plans

def test_sources_and_sinks(spark, tmp_path):
    schema = "id bigint, ts string, v double, code string"
    df = frame(spark, schema, (1, "2024-01-01 10:00:00", 1.5, "OK"), (2, "2024-01-02 11:30:00", float("nan"), "NG"))
    roles = Roles("code", (), "ts", ("id",), ("v",), normal="code = 'OK'")
    for fmt in ("csv", "json", "parquet"):
        path = writers.save_table(df, str(tmp_path), f"t.{fmt}", "sub", fmt)
        fact = readers.load_fact(readers.read_table(spark, path, schema), roles).orderBy("id").collect()
        assert [r["is_normal"] for r in fact] == [True, False] and fact[1]["v"] is None
        assert fact[0]["ts"] == dt.datetime(2024, 1, 1, 10)
    assert readers.read_optional(spark, str(tmp_path / "none"), ["a"], "a int").count() == 0
    assert readers.read_optional(spark, str(tmp_path / "sub/t.parquet"), ["zzz"], "zzz int").columns == ["zzz"]
    assert readers.read_training(spark, str(tmp_path / "none"))[0] is None
    table, warning = readers.read_training(spark, str(tmp_path / "sub/t.parquet"), expected_rows=5)
    assert table.count() == 2 and "expected 5" in warning
    stamped = df.drop("ts").withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    for _ in range(2):  # a second run replaces the first
        writers.save_alerts(stamped, str(tmp_path / "alerts"), "code", "ts")
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 2
    assert require_columns(df, {"id"}) and not require_columns(df, {"nope"})


def test_snapshot_flattening(spark):
    snap = {"machines": {"M1": {"health_index": 40.0, "defect_signals": {"d": {"health_index": 40.0, "causes": {
        "f": {"alert_active_days": 3.0, "health_index": 40.0, "margin_used_pct": 66.0}, "g": {"health_index": 90.0}}}}},
        "M2": {"health_index": 99.0, "defect_signals": {}}}}
    rows = readers.flatten_snapshot(frame(spark, "t string", (json.dumps(snap),)), "t").collect()
    assert {(r["machine"], r["factor"], r["health_index"], r["alert_active_days"]) for r in rows} == {("M1", "f", 40.0, 3.0), ("M1", "g", 90.0, None)}


def process_data(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = []
    for i in range(2400):
        flow = rng.normal(10, 1)
        bad = int(rng.random() < (0.4 if flow < 9 else 0.05))
        rows.append((i, T0 + dt.timedelta(minutes=25 * i), f"M{i % 2}", "P", f"R{i % 3 % 2}", float(flow), float(rng.normal(5, 1)),
                     bad, int(rng.integers(0, 4)), "NG" if bad else "OK", float(100 - 10 * bad)))
    return frame(spark, "id bigint, ts timestamp_ntz, machine string, product string, recipe string, flow double, temp double, "
                 "bad int, doors int, code string, yield double", *rows)


PROCESS = Roles("machine", ("product", "recipe"), "ts", ("id",), ("flow", "temp"), ("bad",),
                normal="yield = 100 and code = 'OK'", ok="code = 'OK'", limits={"temp": Limits(1, 5, 9)})


def test_preprocess_plan_writes_every_table(spark, tmp_path):
    from driftline.operators.catalogue import ColumnRules, analysis_columns

    df = process_data(spark)
    options = PreprocessOptions(
        pairs=[("flow", "bad")], rises_is_bad={"flow": False}, two_sided=["temp"], constants={"temp": 5.0},
        zero_implausible=["flow"], expected={"row_count": 2400, "duplicate_rows": 0}, permutations=5, min_labels=50,
        rules=ColumnRules(ids=["id"], categories=["machine", "product", "recipe", "code"], counts=["doors"],
                          excluded_ids=["id"], outcomes=["code", "yield"]),
    )
    paths = preprocess(df, PROCESS, options, str(tmp_path))
    assert {"stratum_stats", "daily_series", "trends", "columns", "baseline_ab", "baseline_e", "candidates", "findings",
            "thresholds", "zone_rates", "entry_rates", "summary"} <= set(paths)
    thresholds = spark.read.parquet(paths["thresholds"])
    assert {r["direction"] for r in thresholds.collect()} == {LOW} and thresholds.count() == 2
    # two groups agree by chance often enough, so the direction ceiling is 1 and cannot be passed
    scan = spark.read.parquet(paths["candidates"]).filter("column = 'flow'").first()
    assert scan["passes_fwer"] and scan["consistency_ceiling_fwer"] == 1.0 and not scan["passes_direction"]
    assert spark.read.parquet(paths["findings"]).first()["finding"] == "assigned_but_weak"
    assert analysis_columns(spark.read.parquet(paths["columns"])) == ["flow", "temp"]
    text = json.loads(spark.read.json(paths["summary"]).first()["summary"])
    assert text["row_count"] == 2400 and "flow" in json.loads(text["included_columns"])
    with pytest.raises(ValueError):
        quality.expect(quality.key_report(df, PROCESS), {"row_count": 1})
    assert check_consistency(df.withColumn("loss", 100 - F.col("yield")), "loss", "bad") == pytest.approx(1.0)
    with pytest.raises(ValueError):
        check_consistency(df, "yield", "bad")


def test_exploration_plan(spark, tmp_path):
    stages = {"s": (["flow", "temp"], ["bad"]), "t": (["flow"], ["bad", "doors"])}
    assert stage_pairs(stages) == [("flow", "bad"), ("temp", "bad"), ("flow", "doors")]
    paths = explore_fact(process_data(spark), PROCESS, stages, {"bad": ["flow", "temp"]},
                         ["machine", "product", "recipe", "code"], ["code", "bad"], str(tmp_path))
    ranking = {r["feature"]: r["weighted_effect"] for r in spark.read.parquet(paths["effect_ranking"]).collect()}
    assert ranking["flow"] < -0.5 < ranking["temp"]
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{paths['visual']}/kind=histogram").collect()]
    assert all(sum(b["normal_rows"] + b["other_rows"] for b in x["bins"]) == 2400 for x in lines) and len(lines) == 2
    days = [json.loads(r["value"]) for r in spark.read.text(f"{paths['visual']}/kind=daily").collect()]
    assert len({x["machine"] for x in days}) == len(days) > 1


# ------------------------------------------------------------------ streaming

def run_stream(spark, tmp_path, df, name, make):
    df.write.parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    done = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    return spark.table(name)


def test_live_sessions_match_the_batch_rule(spark, tmp_path):
    hours = [0, 5, 29, 60, 61, 400]
    df = frame(spark, "machine string, column string, ts timestamp", *[("m", "c", T0 + dt.timedelta(hours=h)) for h in hours])
    got = run_stream(spark, tmp_path, df, "sessions", lambda s: live.live_sessions(s, "machine", "ts"))
    closed = sorted((r["start_ts"], r["n_rows"]) for r in got.collect())
    assert closed == [(T0, 3), (T0 + dt.timedelta(hours=60), 2)]


def test_notifications_are_paced(spark, tmp_path):
    rows = [("m", "c", T0, T0 + dt.timedelta(days=d, hours=1)) for d in (3, 4, 5, 11)]
    df = frame(spark, "machine string, column string, since timestamp, ts timestamp", *rows)
    got = run_stream(spark, tmp_path, df, "notes", lambda s: live.paced_notifications(s, "machine", "ts"))
    assert got.count() == 2
