"""Alert job on planted faults, and the operators that read its output."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from driftline.functions import expr, messages
from driftline.operators import health, spec, sweep
from driftline.operators.sequence import gap_sessions
from driftline.operators.spec import UpperLimit
from driftline.plans.alerting import learn_references, run_alerts
from driftline.schema import Limits, Roles
from driftline.store import written

T0 = dt.datetime(2024, 1, 1)
ONSET = {"M1": ("drift", 30), "M2": ("flow", 35)}
ROLES = Roles(
    "machine", ("product", "recipe"), "ts", ("id",), ("drift", "flow", "align", "free"), ("bad",),
    normal="bad = 0", ok="bad = 0", limits={"free": Limits(-3.2, 0.0, 3.2)},
)
TYPES = {"drift": "A", "flow": "C", "align": "E"}


@pytest.fixture(scope="module")
def fact(spark):
    """Three machines, two recipes, 60 days; M1 drifts up, the flow of M2 falls."""
    rng = np.random.default_rng(11)
    rows, i = [], 0
    for m in ("M0", "M1", "M2"):
        for day in range(60):
            for j in range(6):
                late = max(0, day - ONSET[m][1]) if m in ONSET else 0
                drift = rng.normal(0, 1) + (0.12 * late if m == "M1" else 0)
                flow = rng.normal(10, 1) - (0.12 * late if m == "M2" else 0)
                bad = int(rng.random() < (0.5 if flow < 8.2 else 0.03))
                free = 9.0 if (m, day) == ("M0", 50) else float(rng.normal(0, 1))
                align = None if day == 20 else float(rng.normal(50.5, 2))
                rows.append((i, T0 + dt.timedelta(days=day, hours=3 * j), m, "P", f"R{j % 2}", float(drift), float(flow), align, free, bad))
                i += 1
    schema = "id bigint, ts timestamp_ntz, machine string, product string, recipe string, drift double, flow double, align double, free double, bad int"
    return written(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def refs(fact):
    calm = fact.filter("ts < timestamp_ntz'2024-01-30'")  # references from the quiet phase
    learned = learn_references(
        calm, ROLES, TYPES, rises_is_bad={"drift": True}, constants={"align": 50.0},
        labels={"flow": ("bad",)}, upper={"free": UpperLimit(8.0, ("bad",))},
    )
    return learned


@pytest.fixture(scope="module")
def rows(fact, refs):
    return written(run_alerts(fact, ROLES, refs))


def test_planted_drift_is_found_and_the_clean_machine_stays_quiet(rows):
    sessions = gap_sessions(rows.filter("typed_warning"), ["machine", "column"], "ts")
    long = {(r["machine"], r["column"]): r for r in sessions.filter("days >= 10").collect()}
    assert set(long) == {("M1", "drift"), ("M2", "flow")}
    for m, (column, day) in ONSET.items():
        lag = (long[(m, column)]["start_ts"] - T0).days - day
        assert -1 <= lag <= 15


def test_blocked_sequences_give_the_same_alerts(fact, refs, rows):
    columns = [c for c in rows.columns]
    again = run_alerts(fact, ROLES, refs, limit=50).select(columns)
    key = lambda r: (r["id"], r["column"], r["matched_label"])
    a, b = sorted(rows.collect(), key=key), sorted(again.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 100
    for x, y in zip(a, b):
        for c in columns:
            assert x[c] == (pytest.approx(y[c], abs=1e-8) if isinstance(y[c], float) else y[c])


def test_a_series_is_gone_through_once_in_small_batches(spark, fact, refs, rows):
    odd = fact.withColumn("align", F.when(F.col("id") % 7 != 0, F.col("align"))).withColumn("free", F.when(F.col("id") % 11 == 0, float("inf")).otherwise(F.col("free")))
    show = lambda df: sorted(str([round(v, 8) if isinstance(v, float) else v for v in r]) for r in df.collect())
    want = show(run_alerts(odd, ROLES, refs, limit=119))  # longer series than that are cut into blocks
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        once = run_alerts(fact, ROLES, refs)
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan and "Generate" not in plan
        assert show(once) == show(rows)
        got = show(run_alerts(odd, ROLES, refs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) > 100 and got == want


def test_rows_start_at_the_tenth_of_a_series(fact, rows):
    first = fact.withColumn("rn", F.row_number().over(
        Window.partitionBy("machine", "product", "recipe").orderBy("ts", "id")))
    assert rows.join(first, "id").agg(F.min("rn")).first()[0] >= 10


def test_external_limit_and_spec_run(fact, rows):
    over = rows.filter("external_limit_warning").collect()
    assert {(r["machine"], r["column"]) for r in over} == {("M0", "free")} and len(over) == 6
    assert all(r["type"] == "NONE" and "설비 상한(8)" in r["message"] for r in over)
    rules = spec.spec_rules(fact, ROLES).first()
    out = fact.filter("free < -3.2 or free > 3.2").count()
    n = fact.count()
    assert rules["rate"] == pytest.approx(out / n)
    want = next(r for r in range(1, 11) if r == 10 or (out / n) ** r * n < 0.01)
    assert rules["run"] == want
    series = {}
    for r in fact.orderBy("ts", "id").collect():
        series.setdefault((r["machine"], r["recipe"]), []).append(r)
    events = set()
    for part in series.values():
        run = 0
        for pos, r in enumerate(part, start=1):
            run = run + 1 if abs(r["free"]) > 3.2 else 0
            if run == want and pos >= 10:
                events.add(r["id"])
    assert {r["id"] for r in rows.filter("spec_violation_warning").collect()} == events and len(events) == 2


def test_message_order_and_direction(rows):
    drift = rows.filter("column = 'drift' and typed_warning").first()
    assert drift["trend_direction"] == "up" and "지속적인 상승 추세" in drift["message"]
    entry = rows.filter("entry_warning").first()
    assert "위험 Threshold(" in entry["message"] and entry["matched_label"] == "bad"
    off = rows.filter("type = 'E'").first()
    if off:
        assert "정상 수준(" in off["message"] and "이론 기준값 50.0000" in off["message"]


def test_compose_puts_the_external_text_first(spark):
    df = spark.createDataFrame([("e", "s", "t"), ("", "s", ""), ("", "", "")], "e string, s string, t string")
    got = [r[0] for r in df.select(messages.compose(F.col("e"), F.col("s"), F.col("t"))).collect()]
    assert got == ["e s t", "s", ""]


def test_unmapped_groups_keep_one_unlabelled_variant(fact, refs):
    """A type C group without a threshold still reports its other warnings, once."""
    from dataclasses import replace

    none = replace(refs, thresholds=refs.thresholds.filter("group_key = 'none'"), upper={"flow": UpperLimit(11.0)})
    got = run_alerts(fact, ROLES, none).filter("column = 'flow'")
    assert [r[0] for r in got.select("matched_label").distinct().collect()] == [""]
    assert got.filter("typed_warning").count() == 0 and got.count() > 0


def test_sweep_agrees_with_single_runs(fact, refs):
    only = [m for m in ("drift", "align")]
    from dataclasses import replace

    plain = replace(refs, types={m: refs.types[m] for m in only}, upper={})
    days = sweep.sweep_days(fact, plain, ROLES, [0.5, 0.7], [4.5, 4.0])
    grid = sweep.alert_days(days, ["k", "column"], [4.5, 4.0])
    got = {(r["k"], r["h"], r["column"]): r["n"] for r in grid.groupBy("k", "h", "column").agg(F.sum("n_rows").alias("n")).collect()}
    for k, h in ((0.5, 4.0), (0.7, 4.5)):
        one = run_alerts(fact, ROLES, plain, k=k, h=h).filter("typed_warning").groupBy("column").count().collect()
        for r in one:
            assert got[(k, h, r["column"])] == r["count"]


def test_scores_and_verdicts(fact, refs):
    days = written(sweep.sweep_days(fact, refs, ROLES, [0.7], [4.5]))
    onset = fact.sparkSession.createDataFrame(
        [(m, c, (T0 + dt.timedelta(days=d)).date()) for m, (c, d) in ONSET.items()], "machine string, column string, onset_day date")
    scores = sweep.sweep_scores(days, ROLES, "M0", [4.5], onset)
    row = health.grid_verdicts(scores, 2, max_lag=15).first()
    assert row["normal_sustained"] == 0 and row["n_detected"] == 2 and row["verdict"] == "pass"
    folds = sweep.leave_one_out(days, ROLES, "M0", [4.5], onset, max_lag=15).collect()
    assert {tuple(r) for r in folds} == {("M1", 1, True), ("M2", 1, True)}


def test_sums_of_a_series_against_the_recurrence():
    draw = np.random.default_rng(1)
    for rows, gaps in ((60, 0.0), (500, 0.1), (4_000, 0.5)):
        score = draw.normal(size=rows)
        score[draw.random(rows) < gaps] = np.nan
        up = dn = 0.0
        want = []
        for z in score:
            up, dn = (0.0, 0.0) if np.isnan(z) else (max(0.0, up + z - 0.4), max(0.0, dn - z - 0.4))
            want.append((up, dn, max(up, dn)))
        for i, side in enumerate(("up", "dn", "both")):
            assert sweep._reach(score, 0.4, side) == pytest.approx([w[i] for w in want], abs=1e-9)


def test_sweep_of_whole_series_equals_that_of_blocks(fact, refs):
    run = lambda **kw: sorted(map(tuple, sweep.sweep_days(fact, refs, ROLES, [0.4, 0.7], [3.0, 4.5], **kw).collect()))
    whole = run()
    assert whole and whole == run(limit=150)


def test_boundary_of_subsets_against_single_sessions(fact, refs):
    """Every subset of rows gives the boundary that sessions of just these alert rows give."""
    ks, hs = [0.1, 0.4, 0.7], [4.5, 3.0]
    days = written(sweep.sweep_days(fact, refs, ROLES, ks, hs))
    days = days.select("k", "machine", F.col("recipe").alias("product"), "column", "dt", "passed", "n_rows", "first_ts", "last_ts")
    middle = sweep.middle_day(fact, "ts")
    got = {(r["kind"], r["subset"]): r["boundary_k"] for r in
           sweep.boundary_stability(days, ROLES, "M1", ks, hs, middle, h=3.0, sustained_days=5).collect()}
    assert set(got) == {
        *[("part", n) for n in ("all", "odd_columns", "even_columns", "first_half", "second_half")], ("products", "R0"), ("products", "R1"), ("products", "R0+R1")}
    lines = [r.asDict() for r in days.filter("machine = 'M1'").collect()]
    columns = sorted({x["column"] for x in lines})
    middle_date = (T0 + dt.timedelta(days=29)).date()
    tests = {"all": lambda x: True, "odd_columns": lambda x: columns.index(x["column"]) % 2 == 0, "even_columns": lambda x: columns.index(x["column"]) % 2 == 1,
             "first_half": lambda x: x["dt"] < middle_date, "second_half": lambda x: x["dt"] >= middle_date,
             "R0": lambda x: x["product"] == "R0", "R1": lambda x: x["product"] == "R1", "R0+R1": lambda x: True}
    for (_, name), found in got.items():
        want = None
        for k in ks:
            longest = 0.0
            for c in columns:
                spans = sorted((x["first_ts"], x["last_ts"]) for x in lines if x["k"] == k and x["column"] == c and tests[name](x))
                start = end = None
                for a, b in spans:
                    start, end = (a, b) if end is None or a > end + dt.timedelta(days=1) else (start, max(end, b))
                    longest = max(longest, (end - start).total_seconds() / 86400)
            if longest < 5:
                want = k
                break
        assert found == want, name


def test_combinations_of_strata():
    assert sweep.stratum_subsets(["b", "a"], (1, 2, 3), 10) == [("a", 1, "a"), ("b", 1, "b"), ("a+b", 2, "a"), ("a+b", 2, "b")]
    many = sweep.stratum_subsets([f"p{i}" for i in range(9)], (4,), 10)
    assert len({s for s, size, _ in many if size == 4}) == 10 and many == sweep.stratum_subsets([f"p{i}" for i in range(9)], (4,), 10)


def test_alert_totals(fact, rows):
    n = fact.agg(F.count(F.lit(1)).alias("n"))
    top = health.funnel(rows, ROLES, n).first()
    assert top["input_rows"] == 1080 and top["alert_rows"] == rows.count()
    assert top["alert_rows"] >= top["alert_shots"] >= top["episodes"] >= top["entity_columns"] >= top["active"] >= top["full_strength"]
    active = health.active_alerts(rows, "machine", "ts")
    sweep = {r["t"]: r for r in health.maturity_sweep(active, "machine", [1, 14, 60], "M0", ["M1", "M2"]).collect()}
    assert sweep[14.0]["verdict"] == "separated" and sweep[60.0]["verdict"] == "missed"
    limits = health.separable_range(active, "machine", "M0", ["M1", "M2"]).first()
    assert limits["separable"] and limits["above_days"] < 14 <= limits["up_to_days"]


def test_funnel_writes_only_what_it_counts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(health, "written", lambda df: seen.append(set(df.columns)) or written(df))
    alerts = spark.createDataFrame(
        [(T0 + dt.timedelta(hours=i), "M1", "P", "R0", "flow", 1 + i // 2, "long text") for i in range(4)],
        "ts timestamp_ntz, machine string, product string, recipe string, column string, episode_id bigint, message string")
    row = health.funnel(alerts, ROLES, spark.createDataFrame([(9,)], "n bigint")).first()
    assert (row["input_rows"], row["alert_rows"], row["alert_shots"], row["episodes"], row["entity_columns"], row["active"]) == (9, 4, 4, 2, 1, 1)
    assert seen[0] == {"ts", "machine", "product", "recipe", "column", "episode_id"}


def test_onset_day(spark):
    values = [10 + 0.1 * ((i * 7) % 5) for i in range(40)] + [10.2, 14, 10.1, 14, 14, 14, 14, 14, 14]
    df = spark.createDataFrame([("m", "c", (T0 + dt.timedelta(days=i)).date(), float(v)) for i, v in enumerate(values)],
                               "machine string, column string, dt date, daily_mean double")
    row = health.onset_days(df, "machine").first()
    assert row["onset_day"] == (T0 + dt.timedelta(days=43)).date()
    assert row["first_crossing"] == (T0 + dt.timedelta(days=41)).date()


# ------------------------------------------------------------------ scores

def health_of(spark, *margins):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(margins)], "i int, m double")
    return [r[1] for r in df.select("i", expr.margin_to_health(F.col("m"))).orderBy("i").collect()]


def test_margin_to_health_properties(spark):
    assert health_of(spark, 0.0, -50.0, None) == [100.0, 100.0, None]
    assert health_of(spark, 100.0) == [pytest.approx(10.0)]
    low, high = health_of(spark, 99.999, 100.001)
    assert low == pytest.approx(high, abs=1e-3)
    grid = [x / 2 for x in range(0, 2001)]
    curve = health_of(spark, *grid)
    assert all(a >= b for a, b in zip(curve, curve[1:])) and curve[-1] > 0
    assert all((h < 10.0) == (m > 100) for m, h in zip(grid, curve))


@pytest.mark.parametrize("direction,usl,values,want", [
    ("up", 20.0, [10.0, 15.0, 20.0, 5.0, -5.0], [0, 50, 100, 0, 0]),
    ("down", 20.0, [5.0, 0.0, 15.0], [50, 100, 0]),
    ("either", 20.0, [5.0, 15.0], [50, 50]),
    ("either", 10.0, [15.0, 5.0], [None, 50]),
])
def test_spec_margin(spark, direction, usl, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    col = expr.spec_margin(F.col("v"), F.lit(direction), F.lit(0.0), F.lit(10.0), F.lit(usl))
    assert [r[1] for r in df.select("i", col).orderBy("i").collect()] == want


def test_entity_health_is_the_worst_factor(spark):
    df = spark.createDataFrame([("a", "x", 80.0), ("a", "y", 12.0), ("b", "x", 55.0)], "machine string, defect string, health double")
    got = {r["machine"]: tuple(r)[1:] for r in health.entity_health(df, "machine").collect()}
    assert got == {"a": (12.0, "y", True), "b": (55.0, "x", False)}


def test_level_ranges(spark):
    df = spark.createDataFrame([("full", 10.0), ("full", 30.0), ("early", 40.0)], "alert_level string, health double")
    assert health.level_ranges(df).first()["disjoint"]


def test_alert_strength(spark):
    df = spark.createDataFrame([(7.0, None), (28.0, None), (1.0, 7.0), (1.0, 28.0)], "days double, eta double")
    got = [r[0] for r in df.select(expr.alert_strength(F.col("days"), F.col("eta"))).collect()]
    assert got == [0.5, 1.0, 1.0, 0.5]
