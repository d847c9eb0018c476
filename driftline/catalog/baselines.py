"""Stratum statistics, scores, daily series, trends and typed baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.bindings import CONSTANTS, PANEL, PANEL_SQL, SHOTS, SHOTS_SQL, panel, shots
from driftline.catalog.registry import day_text, query, rounded, union_sql
from driftline.functions.tails import exact_critical_s
from driftline.operators import baseline, daily, trend
from driftline.schema import TREND_ALPHA
from driftline.store import written

PM = list(PANEL.measures)
SM = list(SHOTS.measures)


def stats_sql(source: str, strata: str, measures, where: str = "is_normal", prefix: str = "st") -> str:
    """CTEs <prefix>l (long rows), <prefix>0 (moments and points), <prefix> (with MAD)."""
    keys = f'{strata}, "column"'
    return f"""{prefix}l AS ({union_sql(source, strata, list(measures), where)}),
 {prefix}0 AS (SELECT {keys}, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
   max(value) AS max, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.005) AS p0_5,
   quantile_cont(value, 0.995) AS p99_5 FROM {prefix}l GROUP BY ALL),
 {prefix}d AS (SELECT {keys}, quantile_cont(abs(value - median), 0.5) AS mad
   FROM {prefix}l JOIN {prefix}0 USING ({keys}) GROUP BY ALL),
 {prefix} AS (SELECT *, CASE WHEN abs(mean) > 1e-9 THEN std / mean END AS cv, mad * 1.4826 AS robust_z_scale
   FROM {prefix}0 JOIN {prefix}d USING ({keys}))"""


_MOMENTS = ["mean", "std", "cv"]
_POINTS = ["median", "mad", "robust_z_scale", "p0_5", "p99_5", "min", "max"]
_STAT_LIST = ", ".join([f"round({c}, 4) AS {c}" for c in _MOMENTS] + [f"round({c}, 8) AS {c}" for c in _POINTS])


def _stats_rounded(df):
    return rounded(rounded(df, 4, *_MOMENTS), 8, *_POINTS)


@query("stratum_stats", f"""WITH {PANEL_SQL}, {stats_sql('panel', 'product, recipe', PM)}
  SELECT product, recipe, "column", n, {_STAT_LIST} FROM st""")
def stratum_stats(spark, folder):
    df = panel(spark, folder).filter(PANEL.normal)
    return _stats_rounded(baseline.stratum_stats(df, PANEL.stratum, PM))


@query("stratum_stats_fine", f"""WITH {PANEL_SQL}, {stats_sql('panel', 'machine, product, recipe', PM)}
  SELECT machine, product, recipe, "column", n, {_STAT_LIST} FROM st""")
def stratum_stats_fine(spark, folder):
    df = panel(spark, folder).filter(PANEL.normal)
    return _stats_rounded(baseline.stratum_stats(df, PANEL.series, PM))


@query("provisional_limits", f"""WITH {PANEL_SQL}, {stats_sql('panel', 'product, recipe', ['price', 'quantity'])}
  SELECT product, recipe, "column", n AS normal_count, round(median, 8) AS median, round(p0_5, 8) AS lower_warning,
    round(p99_5, 8) AS upper_warning FROM st0""")
def provisional_limits(spark, folder):
    df = panel(spark, folder).filter(PANEL.normal)
    out = baseline.control_limits(df, PANEL.stratum, ["price", "quantity"])
    return rounded(out, 8, "median", "lower_warning", "upper_warning")


Z_SQL = f"""{stats_sql('shots', 'product, recipe', SM)},
 zl AS ({union_sql('shots', 'shot_id, ts, dt, machine, product, recipe', SM)}),
 zz AS (SELECT zl.*, CASE WHEN abs(robust_z_scale) > 1e-9 THEN (value - median) / robust_z_scale END AS z
   FROM zl LEFT JOIN st USING (product, recipe, "column"))"""


def shot_stats(df):
    return baseline.stratum_stats(df.filter(SHOTS.normal), SHOTS.stratum, SM)


@query("robust_z", f"""WITH {SHOTS_SQL}, {Z_SQL} SELECT shot_id, "column", round(z, 6) AS z FROM zz""")
def robust_z(spark, folder):
    df = shots(spark, folder)
    scored = baseline.robust_z(df, shot_stats(df), SHOTS.stratum, SM)
    cells = [F.struct(F.lit(m).alias("column"), F.round(f"{m}_z", 6).alias("z")) for m in SM]
    return scored.select("shot_id", F.inline(F.array(*cells)))


DAILY_SQL = f"""{Z_SQL}, dd AS (SELECT machine, "column", dt, count(*) AS n_rows, avg(value) AS daily_mean,
   avg(z) AS daily_mean_z FROM zz GROUP BY ALL)"""


def shot_daily(df):
    return daily.daily_series(df, shot_stats(df), SHOTS)


@query("daily_series", f"""WITH {SHOTS_SQL}, {DAILY_SQL} SELECT machine, "column", CAST(dt AS VARCHAR) AS dt, n_rows,
  round(daily_mean, 6) AS daily_mean, round(daily_mean_z, 6) AS daily_mean_z FROM dd""")
def daily_series(spark, folder):
    return day_text(rounded(shot_daily(shots(spark, folder)), 6, "daily_mean", "daily_mean_z"), "dt")


@query("daily_rates_ma7", f"""WITH {SHOTS_SQL}, d AS (SELECT machine, dt, count(*) AS samples, avg(value) AS value,
    avg(load) AS load, avg(error) AS error_rate, avg(signup) AS signup_rate FROM shots GROUP BY 1, 2)
  SELECT machine, CAST(dt AS VARCHAR) AS dt, samples, round(value, 6) AS value, round(load, 6) AS load, round(error_rate, 6) AS error_rate,
    round(signup_rate, 6) AS signup_rate,
    round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 6) AS value_7d_ma,
    round(CASE WHEN count(load) OVER w >= 3 THEN avg(load) OVER w END, 6) AS load_7d_ma
  FROM d WINDOW w AS (PARTITION BY machine ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def daily_rates_ma7(spark, folder):
    out = daily.daily_rates(shots(spark, folder), SHOTS, ["value", "load"], ["error", "signup"])
    return day_text(rounded(out, 6, "value", "load", "error_rate", "signup_rate", "value_7d_ma", "load_7d_ma"), "dt")


def _class_sql(stable, variable):
    return f"""CASE WHEN variability_ratio IS NULL THEN 'unknown' WHEN variability_ratio < {stable} THEN 'stable'
      WHEN variability_ratio < {variable} THEN 'moderate' ELSE 'variable' END AS variability_class"""


@query("dispersion_continuous", f"""WITH {PANEL_SQL}, l AS ({union_sql('panel', 'product, recipe', PM, 'is_normal')}),
  c AS (SELECT "column", product, recipe, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s,
    max(value) - min(value) AS r FROM l GROUP BY ALL),
  q AS (SELECT "column", CASE WHEN n < 5 THEN NULL WHEN s = 0 THEN 0 WHEN abs(m) > 0.1 * s THEN abs(s / m)
    WHEN r > 1e-9 THEN s / r ELSE 0 END AS ratio FROM c),
  o AS (SELECT "column", median(ratio) AS variability_ratio FROM q GROUP BY 1)
  SELECT "column", round(variability_ratio, 6) AS variability_ratio, {_class_sql(0.02, 0.1)},
    'cv_or_range_normalized' AS dispersion_method FROM o""")
def dispersion_continuous(spark, folder):
    df = panel(spark, folder).filter(PANEL.normal)
    return rounded(baseline.dispersion_continuous(df, PANEL.stratum, PM), 6, "variability_ratio")


@query("dispersion_binary", f"""WITH {PANEL_SQL}, l AS ({union_sql('panel', 'product, recipe', list(PANEL.labels))}),
  c AS (SELECT "column", product, recipe, avg(value) AS rate FROM l GROUP BY ALL),
  o AS (SELECT "column", CASE WHEN count(rate) >= 2 AND avg(rate) <> 0 THEN stddev_samp(rate) / avg(rate) END AS variability_ratio
    FROM c GROUP BY 1)
  SELECT "column", round(variability_ratio, 6) AS variability_ratio, {_class_sql(0.02, 0.1)}, 'rate_cv' AS dispersion_method FROM o""")
def dispersion_binary(spark, folder):
    return rounded(baseline.dispersion_binary(panel(spark, folder), PANEL.stratum, PANEL.labels), 6, "variability_ratio")


@query("dispersion_count", f"""WITH {PANEL_SQL}, l AS ({union_sql('panel', 'product, recipe', ['l_linenumber', 'quantity'])}),
  c AS (SELECT "column", product, recipe, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM l GROUP BY ALL),
  o AS (SELECT "column", median(CASE WHEN n >= 5 AND m <> 0 THEN v / m END) AS variability_ratio FROM c GROUP BY 1)
  SELECT "column", round(variability_ratio, 6) AS variability_ratio, {_class_sql(0.5, 2.0)}, 'index_of_dispersion' AS dispersion_method FROM o""")
def dispersion_count(spark, folder):
    out = baseline.dispersion_count(panel(spark, folder), PANEL.stratum, ["l_linenumber", "quantity"])
    return rounded(out, 6, "variability_ratio")


# ------------------------------------------------------------------ trends

def kendall_sql(source: str, value: str, keys: str) -> str:
    """CTEs kp (series with index), ks (S), kt (ties), kk (n, S, z, tau) of a daily table."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""kp AS (SELECT {keys}, dt, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY dt) AS i
   FROM {source} WHERE {value} IS NOT NULL),
 kn AS (SELECT {keys}, count(*) AS n, count(DISTINCT v) AS nd, regr_slope(v, i) AS slope FROM kp GROUP BY ALL),
 ks AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, sum(sign(a.v - b.v)) AS s
   FROM kp a JOIN kp b ON {on} AND a.i > b.i GROUP BY ALL),
 kt AS (SELECT {keys}, sum(t * (t - 1) * (2 * t + 5)) AS tie_sum, sum(t * (t - 1) / 2) AS tie_pairs
   FROM (SELECT {keys}, v, count(*) AS t FROM kp GROUP BY ALL) GROUP BY ALL),
 kk AS (SELECT {keys}, n, slope, CASE WHEN nd >= 2 AND n >= 3 THEN CAST(s AS BIGINT) END AS s,
   CASE WHEN nd >= 2 AND n >= 3 THEN s / sqrt((n * (n - 1) * (2 * n + 5) - tie_sum) / 18.0) END AS z,
   CASE WHEN nd >= 2 AND n >= 3 THEN s / sqrt((n * (n - 1) / 2) * (n * (n - 1) / 2 - tie_pairs)) END AS tau
   FROM kn JOIN ks USING ({keys}) JOIN kt USING ({keys}))"""


_CLASS = """CASE WHEN abs(z) > 1.959964 AND s > 0 THEN 'candidate_upward_drift'
  WHEN abs(z) > 1.959964 THEN 'candidate_downward_drift' ELSE 'no_trend' END"""


@query("kendall_trend", f"""WITH {SHOTS_SQL}, {DAILY_SQL}, {kendall_sql('dd', 'daily_mean', 'machine, "column"')}
  SELECT machine, "column", CAST(n AS INT) AS n_days, s AS kendall_s, round(tau, 6) AS kendall_tau, round(z, 6) AS kendall_z FROM kk""")
def kendall_trend(spark, folder):
    out = trend.trend_table(shot_daily(shots(spark, folder)), ["machine", "column"], "daily_mean")
    return rounded(out, 6, "kendall_tau", "kendall_z").select("machine", "column", "n_days", "kendall_s", "kendall_tau", "kendall_z")


TREND_SQL = f"""{DAILY_SQL}, {kendall_sql('dd', 'daily_mean_z', 'machine, "column"')},
 tt AS (SELECT *, {_CLASS} AS trend_class FROM kk)"""


@query("trend_table", f"""WITH {SHOTS_SQL}, {TREND_SQL} SELECT machine, "column", CAST(n AS INT) AS n_days, s AS kendall_s,
  round(tau, 6) AS kendall_tau, round(z, 6) AS kendall_z, round(slope, 6) AS ols_slope, trend_class FROM tt""")
def trend_table(spark, folder):
    out = trend.trend_table(shot_daily(shots(spark, folder)), ["machine", "column"])
    return rounded(out, 6, "kendall_tau", "kendall_z", "ols_slope").drop("kendall_p", "ols_p")


# p values: inversion counts by their recursion, Student's finite sum and the normal series by gamma functions
PVALUE_SQL = """inv AS (SELECT 1 AS m, [1.0::DOUBLE] AS f UNION ALL SELECT m + 1,
   list_transform(range(0, (m + 1) * m // 2 + 1), lambda c: list_sum(f[greatest(1, c - m + 1):least(len(f), c + 1)]) / (m + 1)) FROM inv WHERE m < 33),
 ex AS (SELECT m, unnest(range(len(f))) AS c, unnest(f) AS share FROM inv),
 cdf AS (SELECT m, c, sum(share) OVER (PARTITION BY m ORDER BY c) AS chance FROM ex),
 r2 AS (SELECT machine, "column", count(*) - 2 AS df, regr_r2(v, i) AS r2 FROM kp GROUP BY ALL),
 fit AS (SELECT machine, "column", df, sqrt(r2 / nullif(1 - r2, 0) * df) AS t FROM r2),
 ang AS (SELECT *, atan(t / sqrt(df)) AS o FROM fit),
 sp AS (SELECT machine, "column", CASE WHEN df = 1 THEN 1 - 2 * o / pi()
   WHEN df % 2 = 1 THEN 1 - 2 / pi() * (o + sin(o) * cos(o) * list_sum(list_transform(range(0, (df - 1) // 2),
     lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos(o), 2 * k))))
   ELSE 1 - sin(o) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(o), 2 * k))) END AS ols_p
   FROM ang),
 pk AS (SELECT kk.*, tie_pairs, (n * (n - 1) // 2 - tie_pairs - abs(s)) // 2 AS fewer, abs(z) / sqrt(2) AS x FROM kk JOIN kt USING (machine, "column")),
 pv AS (SELECT machine, "column", CASE WHEN s IS NULL THEN NULL
   WHEN tie_pairs = 0 AND n <= 33 THEN CASE WHEN 4 * fewer = n * (n - 1) THEN 1.0 ELSE least(1.0, 2 * chance) END
   ELSE 1 - exp(-x * x) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(x, 1e-300)) - lgamma(k + 1.5)))) END AS kendall_p
   FROM pk LEFT JOIN cdf ON cdf.m = pk.n AND cdf.c = pk.fewer)"""


@query("trend_pvalues", f"""WITH RECURSIVE {SHOTS_SQL}, {TREND_SQL}, {PVALUE_SQL}
  SELECT machine, "column", round(greatest(kendall_p, 0), 6) AS kendall_p, round(greatest(ols_p, 0), 6) AS ols_p FROM pv JOIN sp USING (machine, "column")""")
def trend_pvalues(spark, folder):
    out = trend.trend_table(shot_daily(shots(spark, folder)), ["machine", "column"])
    return rounded(out, 6, "kendall_p", "ols_p").select("machine", "column", "kendall_p", "ols_p")


@query("trend_summary", f"""WITH {SHOTS_SQL}, {TREND_SQL}, f AS (SELECT "column",
    bool_or(trend_class = 'candidate_upward_drift') AS up, bool_or(trend_class = 'candidate_downward_drift') AS down FROM tt GROUP BY 1)
  SELECT "column", CASE WHEN up AND down THEN 'mixed' WHEN up THEN 'candidate_upward_drift'
    WHEN down THEN 'candidate_downward_drift' ELSE 'no_trend' END AS trend_class FROM f""")
def trend_summary(spark, folder):
    return trend.column_summary(trend.trend_table(shot_daily(shots(spark, folder)), ["machine", "column"]))


@query("trend_crosscheck", f"""WITH {SHOTS_SQL}, {DAILY_SQL},
  {kendall_sql('dd', 'daily_mean_z', 'machine, "column"')},
  t1 AS (SELECT machine, "column", {_CLASS} AS trend_class FROM kk),
  {kendall_sql('dd', 'daily_mean', 'machine, "column"').replace('kp', 'rp').replace('kn', 'rn').replace('ks', 'rs').replace('kt', 'rt').replace('kk', 'rk')},
  t2 AS (SELECT machine, "column", CASE WHEN abs(z) > 1.959964 THEN CASE WHEN s > 0 THEN 'up' ELSE 'down' END ELSE 'flat' END AS raw_direction FROM rk),
  j AS (SELECT *, CASE trend_class WHEN 'candidate_upward_drift' THEN 'up' WHEN 'candidate_downward_drift' THEN 'down' ELSE 'flat' END AS direction
    FROM t1 JOIN t2 USING (machine, "column"))
  SELECT *, raw_direction = direction AS agree FROM j""")
def trend_crosscheck(spark, folder):
    series = written(shot_daily(shots(spark, folder)))
    keys = ["machine", "column"]
    return trend.crosscheck(trend.raw_direction(series, keys), trend.trend_table(series, keys), keys)


CRITICAL_SQL = "VALUES " + ", ".join(f"({n}, {exact_critical_s(n, TREND_ALPHA)})" for n in range(14, 34))

# ------------------------------------------------------------------ typed baselines

_A = {"price": True, "quantity": False}
_B = ["discount", "tax", "quantity"]
_OK_SQL = f"""{PANEL_SQL}, okl AS ({union_sql('panel', 'group_key', PM, 'is_ok')}),
  om AS (SELECT group_key, "column", round(quantile_cont(value, 0.5), 5) AS median FROM okl GROUP BY ALL),
  li("column", lsl, target, usl) AS (VALUES """ + ", ".join(
    f"('{c}', {float(v.lsl)}, {float(v.target)}, {float(v.usl)})" for c, v in PANEL.limits.items()) + ")"


@query("baseline_a", f"""WITH {_OK_SQL} SELECT 'A' AS type, om."column", group_key,
  CASE WHEN target IS NOT NULL THEN 'given_target' ELSE 'group_ok_median' END AS baseline_method,
  CAST(coalesce(target, median) AS DOUBLE) AS baseline_value, CASE WHEN om."column" = 'price' THEN 'up' ELSE 'down' END AS bad_direction
  FROM om LEFT JOIN li USING ("column") WHERE om."column" IN ('price', 'quantity')""")
def baseline_a(spark, folder):
    df = panel(spark, folder).filter(PANEL.ok)
    return baseline.baseline_a(df, PANEL.stratum, _A, PANEL.limits)


@query("baseline_b", f"""WITH {_OK_SQL} SELECT 'B' AS type, om."column", group_key,
  CASE WHEN target IS NULL THEN 'group_ok_median' WHEN om."column" = 'tax' THEN 'group_ok_median_recomputed' ELSE 'given_target' END AS baseline_method,
  CAST(CASE WHEN om."column" = 'tax' OR target IS NULL THEN median ELSE target END AS DOUBLE) AS baseline_value
  FROM om LEFT JOIN li USING ("column") WHERE om."column" IN ('discount', 'tax', 'quantity')""")
def baseline_b(spark, folder):
    df = panel(spark, folder).filter(PANEL.ok)
    return baseline.baseline_b(df, PANEL.stratum, _B, PANEL.limits, recompute_target=["tax"])


@query("baseline_e", f"""WITH {SHOTS_SQL} SELECT 'E' AS type, 'k' AS "column", 'theoretical_constant' AS baseline_method,
  50.0::DOUBLE AS baseline_value, round(avg(k), 5) AS reference_ok_mean, round(stddev_samp(k), 5) AS reference_ok_std FROM shots WHERE is_ok""")
def baseline_e(spark, folder):
    return baseline.baseline_e(shots(spark, folder).filter(SHOTS.ok), CONSTANTS)


@query("target_override", f"""WITH {_OK_SQL}, {stats_sql('panel', 'product, recipe', PM)} SELECT product, recipe, "column", n,
  round(CAST(coalesce(target, median) AS DOUBLE), 8) AS median, round(robust_z_scale, 8) AS robust_z_scale,
  CASE WHEN target IS NOT NULL THEN 'given_target' ELSE 'empirical' END AS median_source FROM st LEFT JOIN li USING ("column")""")
def target_override(spark, folder):
    stats = baseline.stratum_stats(panel(spark, folder).filter(PANEL.normal), PANEL.stratum, PM)
    out = baseline.override_targets(stats, PANEL.limits)
    return rounded(out, 8, "median", "robust_z_scale").select(
        "product", "recipe", "column", "n", "median", "robust_z_scale", "median_source"
    )


@query("baseline_types", f"""WITH {_OK_SQL}, u AS (SELECT DISTINCT "column", CASE WHEN "column" IN ('tax') THEN 'E'
    WHEN "column" IN ('discount') THEN 'C' WHEN "column" IN ('price') THEN 'A' ELSE 'B' END AS type FROM om)
  SELECT * FROM u""")
def baseline_types(spark, folder):
    ok = panel(spark, folder).filter(PANEL.ok)
    ab = baseline.baseline_a(ok, PANEL.stratum, {"price": True}, PANEL.limits).select("column", "type").unionByName(
        baseline.baseline_b(ok, PANEL.stratum, _B, PANEL.limits).select("column", "type")
    )
    c = baseline.control_limits(ok, PANEL.stratum, ["discount"])
    return baseline.resolve_types(ab, c, baseline.baseline_e(ok, {"tax": 0.04}))
