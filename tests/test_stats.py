"""Tails, trend tests, stumps and label studies against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions import tails
from driftline.operators import explore, labels, threshold, trend
from driftline.schema import HIGH, LOW, Roles


def pmf(k, n, p):
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)


@pytest.mark.parametrize("rate", [0.005, 0.064, 0.32])
@pytest.mark.parametrize("n", [10, 20])
def test_alert_count_is_minimal(rate, n):
    k = tails.alert_count(rate, n, 0.05)
    tail = lambda j: sum(pmf(i, n, rate) for i in range(j, n + 1))
    assert tail(k) < 0.05 and (k == 1 or tail(k - 1) >= 0.05)


def test_alert_count_properties():
    ks = [tails.alert_count(p, 10, 0.05) for p in (0.005, 0.064, 0.32)]
    assert ks == sorted(ks) and len(set(ks)) > 1
    assert tails.alert_count(0.0, 10, 0.05) == 1
    assert tails.alert_count(0.9, 10, 0.05) == 11
    by_alpha = [tails.alert_count(0.064, 10, a) for a in (0.1, 0.05, 0.01, 0.001)]
    assert by_alpha == sorted(by_alpha)


@pytest.mark.parametrize("rate,n", [(float("nan"), 10), (-0.1, 10), (0.05, 0)])
def test_alert_count_invalid_input_never_alerts(rate, n):
    assert tails.alert_count(rate, n, 0.05) == n + 1


@pytest.mark.parametrize("n", [1, 5, 83, 270, 1000])
@pytest.mark.parametrize("p", [0.001, 0.3])
def test_binomial_quantile(n, p):
    total, want = 0.0, None
    for k in range(n + 1):
        total += pmf(k, n, p)
        if total >= 0.99:
            want = k
            break
    assert tails.binomial_quantile(0.99, n, p) == want


def test_binomial_quantile_of_a_huge_day():
    n, p = 10**9, 0.001
    k = tails.binomial_quantile(0.99, n, p)
    assert k == pytest.approx(n * p + 2.3263 * math.sqrt(n * p * (1 - p)), abs=5)


def test_student_tail_known_points():
    assert tails.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.student_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.student_two_sided(0.0, 5) == pytest.approx(1.0)


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_exact_kendall_against_all_permutations(n):
    scores = [sum(np.sign(q[j] - q[i]) for i in range(n) for j in range(i + 1, n)) for q in itertools.permutations(range(n))]
    for s in sorted(set(scores)):
        share = sum(abs(x) >= abs(s) for x in scores) / len(scores)
        assert tails.kendall_p(int(s), n, 0, 0) == pytest.approx(min(1.0, share))


def kendall_parts(v):
    """S, the tie term and the number of tied pairs, by comparing all pairs."""
    s = int(sum(np.sign(v[j] - v[i]) for j in range(len(v)) for i in range(j)))
    t = np.unique(v, return_counts=True)[1].astype(int)
    return s, int((t * (t - 1) * (2 * t + 5)).sum()), int((t * (t - 1) // 2).sum())


def test_trend_tests_match_pairwise_counting(spark):
    rng = np.random.default_rng(0)
    series = [np.round(rng.normal(0, 1, n) + 0.05 * np.arange(n), d) for n in (3, 4, 12, 33, 34, 40, 180) for d in (1, 6)]
    series += [np.arange(60.0), -np.arange(200.0), np.array([1.0, 2, 3, 5, 4, *range(6, 50)])]
    rows = [(i, [float(x) for x in v] + [None, float("nan")] * (i % 2)) for i, v in enumerate(series)]
    rows += [(100, [1.0, None, 2.0]), (101, [1.0] * 5), (102, []), (103, [None, 1.0])]
    got = {r["k"]: r for r in trend.trend_tests(spark.createDataFrame(rows, "k int, _v array<double>"), ["k"]).collect()}
    for i, v in enumerate(series):
        n, r, x = len(v), got[i], np.arange(len(v)) - (len(v) - 1) / 2
        s, ties, pairs = kendall_parts(v)
        assert (r["n"], r["s"]) == (n, s)
        assert r["z"] == pytest.approx(s / math.sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18))
        assert r["tau"] == pytest.approx(s / math.sqrt(n * (n - 1) / 2 * (n * (n - 1) / 2 - pairs)))
        assert r["p"] == pytest.approx(tails.kendall_p(s, n, ties, pairs), rel=1e-8, abs=1e-15)
        assert r["slope"] == pytest.approx(np.polyfit(np.arange(n), v, 1)[0])
        rest = ((v - v.mean() - r["slope"] * x) ** 2).sum()
        if rest > 1e-12:
            assert r["slope_p"] == pytest.approx(tails.student_two_sided(r["slope"] / math.sqrt(rest / (n - 2) / (x * x).sum()), n - 2), rel=1e-7, abs=1e-13)
    assert tuple(got[100]) == (100, 2, *[None] * 6) and tuple(got[102]) == (102, 0, *[None] * 6)
    assert got[101]["s"] is None and got[101]["p"] is None and got[101]["slope"] == 0.0


def test_tails_as_columns(spark):
    grid = [(t, n, z) for t in (0.0, 0.3, -1.7, 4.0, 12.706) for n in (1, 2, 3, 4, 9, 10, 57) for z in (0.0, 0.1, -1.96, 2.8, 2.83, 5.0, 9.0)]
    df = spark.createDataFrame(grid, "t double, n int, z double")
    for r in df.select("*", tails.student_two_sided_column("t", "n").alias("a"), tails.normal_two_sided_column("z").alias("b")).collect():
        assert r["a"] == pytest.approx(tails.student_two_sided(r["t"], r["n"]), rel=1e-9, abs=1e-13)
        assert r["b"] == pytest.approx(tails.normal_two_sided(r["z"]), rel=1e-8, abs=1e-14)


def test_the_trend_plan_has_no_python_worker(spark):
    daily = spark.createDataFrame([("m", i, float(i % 7)) for i in range(20)], "m string, dt int, daily_mean_z double")
    plan = trend.trend_table(daily, ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stable_length_is_the_longest_quiet_prefix():
    rng = np.random.default_rng(5)
    for case in range(12):
        n = int(rng.integers(5, 60))
        v = np.round(rng.random(n) + (0.03 * np.arange(n) if case % 2 else 0), 2 if case % 3 else 6)
        want = n
        for end in range(14, n + 1):
            s, ties, pairs = kendall_parts(v[:end])
            if len(set(v[:end])) > 1 and s > 0 and tails.kendall_p(s, end, ties, pairs) < 0.05:
                want = end - 1
                break
        assert trend._stable_length(list(v)) == want


# ------------------------------------------------------------------ stumps

def brute_stump(values, flags, leaf=10):
    n, p = len(values), int(sum(flags))
    if p < leaf or p == n:
        return None
    best = None
    xs = sorted(set(values))
    for a, b in zip(xs, xs[1:]):
        left = [f for v, f in zip(values, flags) if v <= a]
        nl, pl = len(left), sum(left)
        if nl < leaf or n - nl < leaf:
            continue
        one, zero = pl / p / 2, (nl - pl) / (n - p) / 2
        score = round((one**2 + zero**2) / (one + zero) + ((0.5 - one) ** 2 + (0.5 - zero) ** 2) / (1 - one - zero), 12)
        if best is None or score > best[0]:
            best = (score, (a + b) / 2, pl / nl, (p - pl) / (n - nl))
    return best


def two_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for recipe, low_bad in (("ok", True), ("bad", False)):
        values = np.concatenate([rng.normal(1.0, 0.05, 60), rng.normal(9.0, 0.05, 60)])
        flags = np.zeros(120, dtype=int)
        flags[slice(0, 15) if low_bad else slice(105, 120)] = 1
        rows += [("P1", recipe, float(v), int(f), int(f)) for v, f in zip(values, flags)]
    return rows, spark.createDataFrame(rows, "product string, recipe string, value double, flag int, other int")


@pytest.mark.parametrize("limit", [10_000, 25])
def test_stump_finds_the_side(spark, limit):
    rows, df = two_groups(spark)
    got = {r["group_key"]: r for r in threshold.stump_thresholds(
        df, ["product", "recipe"], ["value"], ["flag"], limit=limit).collect()}
    assert got["P1|ok"]["direction"] == LOW and got["P1|ok"]["rate_below"] > got["P1|ok"]["rate_above"]
    assert got["P1|bad"]["direction"] == HIGH
    for recipe in ("ok", "bad"):
        part = [(v, f) for _, r, v, f, _ in rows if r == recipe]
        _, cut, below, above = brute_stump(*zip(*part))
        row = got[f"P1|{recipe}"]
        assert row["threshold"] == pytest.approx(cut, abs=1e-5)
        assert (row["rate_below"], row["rate_above"]) == pytest.approx((below, above), abs=1e-5)


@pytest.mark.parametrize("limit", [10_000, 40])
def test_stump_matches_brute_force_with_ties(spark, limit):
    rng = np.random.default_rng(8)
    values = np.round(rng.normal(0, 1, 400), 1)
    flags = (rng.random(400) < 0.1 + 0.2 * (values > 0.4)).astype(int)
    df = spark.createDataFrame([("p", "r", float(v), int(f)) for v, f in zip(values, flags)],
                               "product string, recipe string, value double, flag int")
    row = threshold.stump_thresholds(df, ["product", "recipe"], ["value"], ["flag"], limit=limit).first()
    _, cut, below, above = brute_stump(list(values), list(flags))
    assert row["threshold"] == pytest.approx(cut, abs=1e-5)
    assert row["rate_above"] == pytest.approx(above, abs=1e-5)


@pytest.mark.parametrize("positives", [0, 9])
def test_too_few_positives_give_no_threshold(spark, positives):
    df = spark.createDataFrame([("p", "r", i / 10, int(i < positives)) for i in range(100)],
                               "product string, recipe string, value double, flag int")
    assert threshold.stump_thresholds(df, ["product", "recipe"], ["value"], ["flag"]).count() == 0


def test_direction_filter_and_pairs(spark):
    _, df = two_groups(spark)
    learned = threshold.stump_thresholds(df, ["product", "recipe"], ["value"], ["flag", "other"],
                                         [("value", "flag"), ("value", "other")])
    assert learned.count() == 4
    for direction, kept in ((LOW, "P1|ok"), (HIGH, "P1|bad")):
        known = spark.createDataFrame([("value", "flag", direction)], "column string, label string, direction string")
        rows = threshold.agreeing(learned, known).collect()
        assert [r["group_key"] for r in rows if r["label"] == "flag"] == [kept]
        assert len([r for r in rows if r["label"] == "other"]) == 2
        dropped = threshold.contradicting_counts(learned, known).first()
        assert (dropped["n_dropped"], dropped["n_groups"]) == (1, 2)


def planted(spark, n=1500):
    rng = np.random.default_rng(1)
    rows = []
    for g in ("x", "y", "z"):
        a, b = rng.normal(0, 1, n), np.round(rng.normal(0, 1, n), 1)
        flag = (rng.random(n) < np.where(a > 0.5, 0.25, 0.05)).astype(int)
        rows += [("p", g, float(u), float(v), int(f)) for u, v, f in zip(a, b, flag)]
    return spark.createDataFrame(rows, "product string, recipe string, a double, b double, flag int")


@pytest.mark.parametrize("limit", [100_000, 400])
def test_scan_separates_signal_from_noise(spark, limit):
    scan = threshold.candidate_scan(planted(spark), ["product", "recipe"], ["a", "b"], ["flag"],
                                    [("b", "flag")], reps=20, limit=limit)
    got = {r["column"]: r for r in scan.collect()}
    assert got["a"]["passes_fwer"] and not got["b"]["passes_fwer"]
    assert got["a"]["dominant_direction"] == HIGH and got["a"]["direction_consistency"] == 1.0
    assert got["a"]["noise_ceiling_fwer"] >= got["a"]["noise_ceiling_p95"] > 1.0
    assigned = spark.createDataFrame([("b", "flag"), ("c", "flag")], "column string, label string")
    found = {r["column"]: r["finding"] for r in threshold.scan_findings(scan, assigned).collect()}
    assert found["b"] == "assigned_but_weak" and found["c"] == "assigned_but_not_fitted"


def test_shuffled_stumps_repeat_exactly(spark):
    df = planted(spark, 200)
    runs = [sorted(map(tuple, threshold.shuffled_stumps(df, ["product", "recipe"], ["a"], ["flag"], 5).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 15


# ------------------------------------------------------------------ label studies

def test_rank_effects_and_fdr(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(300) < 0.3).astype(int)
    x = np.round(rng.normal(0, 1, 300) + 0.8 * y, 1)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    row = labels.rank_effects(df, ["x"], {"y": "y = 1"}, limit=10).first()
    a, b = x[y == 1], x[y == 0]
    greater = sum((u > b).sum() + 0.5 * (u == b).sum() for u in a)
    assert row["u"] == pytest.approx(greater)
    assert row["delta"] == pytest.approx(2 * greater / (len(a) * len(b)) - 1)
    ties = sum(t**3 - t for t in pd.Series(x).value_counts())
    n, n1, n2 = 300, len(a), len(b)
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert row["p_raw"] == pytest.approx(math.erfc((abs(greater - n1 * n2 / 2) - 0.5) / sd / math.sqrt(2)))

    tests = spark.createDataFrame([("f", c, p) for c, p in zip("abcd", (0.01, 0.04, 0.03, 0.9))], "f string, c string, p_raw double")
    got = {r["c"]: r["p_fdr"] for r in labels.bh_adjust(tests, ["f"], tie=["c"]).collect()}
    assert [got[c] for c in "abcd"] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.9])


def test_verdict(spark):
    rows = [("d", "x", 0.3, 0.01, "up"), ("d", "y", 0.3, 0.01, "down"), ("d", "z", -0.1, 0.001, "down"), ("d", "w", 0.5, 0.2, "up")]
    effects = spark.createDataFrame([r[:4] for r in rows], "label string, column string, delta double, p_fdr double")
    expected = spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "label string, column string, expected string")
    got = {r["column"]: (r["direction_ok"], r["effect_ok"]) for r in labels.verdicts(effects, expected).collect()}
    assert got == {"x": (True, True), "y": (False, True), "z": (True, False), "w": (True, False)}


def test_spearman_drops_incomplete_rows_before_ranking(spark):
    rows = [(1.0, 5.0), (2.0, None), (2.0, 3.0), (None, 1.0), (7.0, 4.0), (7.0, 8.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    row = explore.spearman_pairs(df, [("x", "y")], {"all": "true"}, limit=2).first()
    kept = pd.DataFrame([r for r in rows if None not in r])
    assert row["n_rows"] == 4
    assert row["spearman_r"] == pytest.approx(kept[0].rank().corr(kept[1].rank()))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert explore.spearman_pairs(flat, [("x", "y")], {"all": "true"}).first()["spearman_r"] is None


def _with_gaps(spark, rows=400):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"a": rng.integers(0, 5, rows).astype(float), "b": rng.normal(size=rows).round(2), "c": rng.integers(-2, 3, rows).astype(float),
                         "d": rng.normal(size=rows).round(3)})
    data["b"] += data["a"]
    data["d"] -= data["c"]
    for c in data:
        data.loc[rng.random(rows) < 0.1, c] = np.nan
    data["ok"] = rng.integers(0, 2, rows)
    plain = data.astype(object).where(data.notna(), None)
    return data, spark.createDataFrame(plain.values.tolist(), "a double, b double, c double, d double, ok int")


@pytest.mark.parametrize("few, limit", [(0, None), (50, 60), (10_000, None)])
def test_rank_correlations_whatever_the_number_of_values(spark, monkeypatch, few, limit):
    """Ranks in place on no, one or both sides of a pair: the same result as ranking the complete rows of each pair."""
    monkeypatch.setattr(explore, "FEW_VALUES", few)
    data, df = _with_gaps(spark)
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "c"), ("d", "a")]
    got = {(r["population"], r["x_name"], r["y_name"]): (r["n_rows"], r["spearman_r"])
           for r in explore.spearman_pairs(df, pairs, {"all": "true", "fine": "ok = 1", "none": "ok = 5"}, limit=limit).collect()}
    assert len(got) == 2 * len(pairs)
    for name, part in (("all", data), ("fine", data[data.ok == 1])):
        for x, y in pairs:
            kept = part[[x, y]].dropna() if x != y else pd.concat([part[x].dropna()] * 2, axis=1)
            assert got[(name, x, y)] == (len(kept), pytest.approx(kept.iloc[:, 0].rank().corr(kept.iloc[:, 1].rank()), abs=1e-9))


@pytest.mark.parametrize("columns, few", [("abcd", 50), ("acb", 50), ("bca", 50), ("abcd", 10_000)])
def test_rank_matrix_whatever_the_number_of_values(spark, monkeypatch, columns, few):
    monkeypatch.setattr(explore, "FEW_VALUES", few)
    data, df = _with_gaps(spark)
    want = data[list(columns)].rank().corr()
    got = {(r["variable_1"], r["variable_2"]): r["spearman_r"] for r in explore.spearman_matrix(df, list(columns), limit=60).collect()}
    assert list(sorted(got)) == sorted((x, y) for i, x in enumerate(columns) for y in columns[i + 1:])
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=6e-5)


def test_best_cuts_need_no_second_sort(spark):
    """Values are put in order once per group; the best cut of all labels is found in that order, without a row per label."""
    rows = [("p", "r", float(i % 50), int(i % 7 == 0), int(i % 50 > 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "product string, recipe string, a double, x int, y int")
    out = threshold.stump_thresholds(df, ["product", "recipe"], ["a"], ["x", "y"], [("a", "y")])
    assert [(r["label"], r["threshold"]) for r in out.collect()] == [("y", 30.5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line for line in plan.split("Initial Plan")[0].splitlines()) == 1


def test_risk_ratios_of_subsets_in_one_pass(spark):
    rng = np.random.default_rng(9)
    names = list("abcdef")
    data = pd.DataFrame(rng.integers(0, 9, (600, 6)).astype(float), columns=names)
    for c in ("u", "v"):
        data[c] = rng.integers(0, 2, 600)
    data["part"] = rng.integers(0, 3, 600)
    data.loc[::17, "a"] = np.nan
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in names) + ", u int, v int, part int")
    zones = [("a", "u", 4.0, "-1e18~4"), ("a", "v", 6.0, "6~1e18"), ("f", "v", 2.0, "-1e18~2")]
    table = spark.createDataFrame(zones, "column string, label string, threshold double, risky_range string")
    roles = Roles("m", ("p",), "ts", ("id",), tuple(names), ("u", "v"), normal="u = 0", ok="u = 0")
    subsets = {"low": "part < 2", "all": "true"}
    got = {(r["dataset"], r["column"], r["label"]): r for r in labels.risk_ratios(df, table, roles, ["u", "v"], subsets).collect()}
    assert len(got) == 6
    for name, part in (("low", data[data.part < 2]), ("all", data)):
        for c, d, cut, text in zones:
            risky = part[c] <= cut if text.startswith("-") else part[c] >= cut
            other = part["v" if d == "u" else "u"] == 1
            r = got[(name, c, d)]
            assert r["n_risky"] == risky.sum() and r["n_label_risky"] == (risky & (part[d] == 1)).sum()
            assert r["binary_ratio"] == pytest.approx(part[d][risky].mean() / part[d][~risky].mean(), abs=0.0051)
            assert r["pure_ratio"] == pytest.approx(part[d][risky & ~other].mean() / part[d][~risky & ~other].mean(), abs=0.0051)
            assert r["co_pct"] == pytest.approx(100 * other[risky & (part[d] == 1)].mean(), abs=0.501)
    plain = {tuple(r)[:3] for r in labels.risk_ratios(df, table, roles, ["u", "v"]).select("column", "label", "n_risky").collect()}
    assert plain == {(c, d, got[("all", c, d)]["n_risky"]) for _, c, d in got}


def test_cramers_v_matches_the_dense_table(spark):
    rng = np.random.default_rng(4)
    a = rng.choice(list("abc"), 500)
    b = np.where(rng.random(500) < 0.4, a, rng.choice(list("abc"), 500))
    df = spark.createDataFrame(list(zip(map(str, a), map(str, b), ["k"] * 500)), "a string, b string, one string")
    got = {r["outcome"]: r["cramers_v"] for r in explore.cramers_v(df, ["a"], ["b", "one"]).collect()}
    o = pd.crosstab(a, b).to_numpy(float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert got["b"] == pytest.approx(math.sqrt(((o - e) ** 2 / e).sum() / 500 / 2)) and got["one"] is None


def test_entry_rate_uses_the_stable_phase(spark):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(0)
    rows = []
    for day in range(40):
        level = 0.0 if day < 20 else 0.25 * (day - 19)
        for j in range(20):
            rows.append(("m", "p", "r", datetime(2024, 1, 1) + timedelta(days=day, minutes=j), float(rng.normal(level, 1)), "OK"))
    df = spark.createDataFrame(rows, "m string, p string, r string, ts timestamp_ntz, v double, code string")
    roles = Roles("m", ("p", "r"), "ts", (), ("v",), ok="code = 'OK'")
    thr = spark.createDataFrame([("v", "d", "p|r", 1.5, HIGH)], "column string, label string, group_key string, threshold double, direction string")
    row = trend.entry_rate_baseline(df, thr, roles).first()
    daily = [np.mean([r[4] > 1.5 for r in rows[d * 20:(d + 1) * 20]]) for d in range(40)]
    stable = trend._stable_length(daily)
    assert 14 <= row["stable_days"] == stable < 40
    assert row["n_ok_rows"] == stable * 20 and row["baseline_rate"] == pytest.approx(np.mean(daily[:stable]))
