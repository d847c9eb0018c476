"""Early-warning rows and what follows from them."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from driftline.catalog.baselines import DAILY_SQL, shot_daily, stats_sql
from driftline.catalog.bindings import CONSTANTS, RISES_IS_BAD, SHOTS, SHOTS_SQL, TYPES, UPPER, WATCHED, shots
from driftline.catalog.registry import day_text, query, rounded, union_sql
from driftline.catalog.thresholds import BREACH_SQL, RULES_SQL, SHOT_STUMPS
from driftline.functions import expr, messages as text
from driftline.operators import alerts, health, sweep
from driftline.operators.sequence import gap_sessions
from driftline.plans.alerting import learn_references, read_references, run_alerts
from driftline.schema import LOW, RECENT_DAYS
from driftline.sources.published import publish_days, read_published
from driftline.sources.writers import save_table
from driftline.store import work_folder, written

SM = list(SHOTS.measures)


def references(df, measures=None):
    kept = {m: t for m, t in TYPES.items() if measures is None or m in measures}
    return learn_references(
        df, SHOTS if measures is None else _only(measures), kept, rises_is_bad=RISES_IS_BAD, labels=WATCHED,
        constants=CONSTANTS, upper={m: u for m, u in UPPER.items() if m in kept},
    )


def _only(measures):
    return replace(SHOTS, measures=tuple(measures), limits={m: v for m, v in SHOTS.limits.items() if m in measures})


def parsed_shots(spark, folder):
    """The shots, written: references and detectors read them a dozen times, the JSON is parsed once."""
    return written(shots(spark, folder))


def alert_table(spark, folder, measures=None, with_messages=False):
    df = parsed_shots(spark, folder)
    roles = SHOTS if measures is None else _only(measures)
    return run_alerts(df, roles, references(df, measures), with_messages=with_messages)


_W = 'PARTITION BY machine, product, recipe, "column", label ORDER BY ts, shot_id'
_LIMITS = 'li("column", lsl, target, usl) AS (VALUES ' + ", ".join(
    f"('{c}', {float(v.lsl)}::DOUBLE, {float(v.target)}::DOUBLE, {float(v.usl)}::DOUBLE)" for c, v in SHOTS.limits.items()) + ")"

BASE_SQL = f"""{stats_sql('shots', 'group_key', SM)}, {SHOT_STUMPS}, {RULES_SQL}, {BREACH_SQL}, {_LIMITS},
 okl AS ({union_sql('shots', 'group_key', SM, 'is_ok')}),
 om AS (SELECT group_key, "column", round(quantile_cont(value, 0.5), 5) AS ok_median FROM okl GROUP BY ALL),
 oe AS (SELECT "column", round(avg(value), 5) AS ok_mean, round(stddev_samp(value), 5) AS ok_std FROM okl GROUP BY ALL),
 ty("column", type) AS (VALUES {', '.join(f"('{m}', '{t}')" for m, t in TYPES.items())}),
 rf AS (SELECT st.group_key, st."column", type, std,
   CASE type WHEN 'E' THEN 50.0 WHEN 'C' THEN coalesce(target, median) ELSE coalesce(target, ok_median) END AS base,
   CASE type WHEN 'E' THEN ok_mean WHEN 'C' THEN coalesce(target, median) ELSE coalesce(target, ok_median) END AS ctarget,
   CASE type WHEN 'E' THEN coalesce(nullif(ok_std, 0), std) ELSE std END AS csd
   FROM st JOIN ty USING ("column") LEFT JOIN li USING ("column") JOIN om USING (group_key, "column") JOIN oe USING ("column")),
 rv AS (SELECT rf.*, coalesce(b.label, '') AS label, b.threshold, b.direction FROM rf LEFT JOIN b
   ON b.group_key = rf.group_key AND b."column" = rf."column" AND rf.type = 'C'),
 sl AS ({union_sql('shots', 'shot_id, ts, dt, machine, product, recipe, group_key', SM)}),
 s1 AS (SELECT sl.*, rv.* EXCLUDE (group_key, "column"), row_number() OVER ({_W}) AS rn, (value - ctarget) / csd AS z,
   rules.lsl, rules.usl, rules.run, coalesce(value < rules.lsl OR value > rules.usl, false) AS oos
   FROM sl JOIN rv USING (group_key, "column") LEFT JOIN rules USING ("column")),
 s2 AS (SELECT *, sum(z - 0.7) OVER w AS p, sum(z + 0.7) OVER w AS q, avg(value) OVER r AS rmean, stddev_samp(value) OVER r AS rstd,
   value - lag(value, 9) OVER ({_W}) AS rdiff, regr_slope(value, rn) OVER r AS rslope,
   rn >= 10 AND coalesce(CASE direction WHEN '{LOW}' THEN value <= threshold ELSE value >= threshold END, false) AND direction IS NOT NULL AS risk
   FROM s1 WINDOW w AS ({_W}), r AS ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
 s3 AS (SELECT *, p - least(0, min(p) OVER w) AS up, q - greatest(0, max(q) OVER w) AS dn,
   rn - coalesce(max(CASE WHEN NOT risk THEN rn END) OVER w, 0) AS risk_pos,
   rn - coalesce(max(CASE WHEN NOT oos THEN rn END) OVER w, 0) AS oos_pos FROM s2 WINDOW w AS ({_W})),
 s4 AS (SELECT s3.*, rn >= 10 AS ready, risk_pos = 5 AS entry, run IS NOT NULL AND oos_pos = run AS spec_hit,
   "column" = 'load' AND coalesce(breach, false) AND value > {UPPER['load'].limit} AS over_hit,
   CASE WHEN type = 'A' THEN up > 4.5 WHEN type IN ('B', 'E') THEN up > 4.5 OR dn < -4.5
     WHEN label <> '' THEN risk_pos = 5 OR (CASE direction WHEN '{LOW}' THEN dn < -4.5 ELSE up > 4.5 END) ELSE false END AS typed
   FROM s3 LEFT JOIN breach ON breach.machine = s3.machine AND breach.dt = s3.dt),
 s5 AS (SELECT *, ready AND (typed OR spec_hit OR over_hit) AS warn FROM s4),
 s6 AS (SELECT *, CASE WHEN warn AND NOT coalesce(lag(warn) OVER ({_W}), false) THEN 1 ELSE 0 END AS edge FROM s5),
 s7 AS (SELECT *, CAST(sum(edge) OVER ({_W}) AS BIGINT) AS episode_id, coalesce(nullif(rstd, 0), nullif(csd, 0)) AS eff FROM s6),
 al AS (SELECT shot_id, ts, machine, product, recipe, "column", type, label AS matched_label, base AS baseline, threshold,
   lsl AS spec_lsl, usl AS spec_usl, CASE WHEN lsl IS NULL THEN '' WHEN oos THEN 'OUT_OF_SPEC' ELSE 'OK' END AS spec_status,
   value AS current_value, rmean AS rolling_mean, rstd AS rolling_std, rdiff AS difference, rslope AS slope,
   CASE WHEN eff IS NOT NULL THEN (rmean - base) / eff WHEN base <> 0 THEN (rmean - base) / abs(base) ELSE rmean - base END AS normalized_deviation,
   CASE WHEN type = 'C' AND typed THEN CASE direction WHEN '{LOW}' THEN 'down' ELSE 'up' END
     WHEN type IN ('A', 'B', 'E') AND up > 4.5 THEN 'up' WHEN type IN ('B', 'E') AND dn < -4.5 THEN 'down'
     WHEN rslope > 0 THEN 'up' WHEN rslope < 0 THEN 'down' ELSE 'flat' END AS trend_direction,
   spec_hit AS spec_violation_warning, over_hit AS external_limit_warning, warn AS early_warning, episode_id,
   typed AS typed_warning, entry AND type = 'C' AND label <> '' AS entry_warning FROM s7 WHERE warn)"""

_ROUND = ["baseline", "threshold", "rolling_mean", "rolling_std", "difference", "slope", "normalized_deviation", "current_value"]
_REPLACE = "REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUND) + ")"


def _show(df):
    return rounded(df, 6, *_ROUND)


@query("alerts_from_tables", f"WITH {SHOTS_SQL}, {BASE_SQL} SELECT * {_REPLACE} FROM al")
def alerts_from_tables(spark, folder):
    """The alerts of references that were saved and read again, as a later job would."""
    df = parsed_shots(spark, folder)
    refs = references(df)
    saved = {"stratum_stats": refs.stats, "baseline_ab": refs.ab, "thresholds": refs.thresholds, "baseline_e": refs.constants}
    paths = {name: save_table(table, f"{work_folder(spark)}/references-{uuid.uuid4().hex}", name) for name, table in saved.items()}
    again = read_references(spark, paths, rises_is_bad=RISES_IS_BAD, upper=UPPER)
    return _show(run_alerts(df, SHOTS, again, with_messages=False))


@query("alerts_all", f"WITH {SHOTS_SQL}, {BASE_SQL} SELECT * {_REPLACE} FROM al")
def alerts_all(spark, folder):
    return _show(alert_table(spark, folder))


@query("alerts_published", f"WITH {SHOTS_SQL}, {BASE_SQL} SELECT * {_REPLACE} FROM al")
def alerts_published(spark, folder):
    """Two overlapping periods, the first with every row of the overlap twice, and a write that breaks off."""
    rows, path = written(alert_table(spark, folder)), f"{work_folder(spark)}/published-{uuid.uuid4().hex}"
    first, last = rows.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    part = (last - first) // 5
    publish_days(rows.unionAll(rows.where(F.to_date("ts") >= F.lit(first + 2 * part))), path, "machine", "ts", first, first + 3 * part)
    run = publish_days(rows, path, "machine", "ts", first + 2 * part, last)
    rows.withColumn("alert_date", F.to_date("ts")).write.partitionBy("machine", "alert_date").parquet(f"{path}/runs/run={run + 1}")
    return _show(read_published(spark, path).drop("alert_date"))


def _typed(kind, measure):
    @query(f"alerts_{kind.lower()}", f"WITH {SHOTS_SQL}, {BASE_SQL} SELECT * {_REPLACE} FROM al WHERE \"column\" = '{measure}'")
    def run(spark, folder):
        return _show(alert_table(spark, folder, [measure]))


for _m, _t in TYPES.items():
    _typed(_t, _m)


@query("alert_messages", f"""WITH {SHOTS_SQL}, {BASE_SQL} SELECT shot_id, "column", matched_label,
  machine || ' / ' || product || ' / ' || recipe || '의 value에서 ' || CASE WHEN entry_warning
    THEN '위험 Threshold(' || printf('%.4f', threshold) || ')에 진입했습니다.'
    ELSE '정상 Baseline 대비 ' || CASE trend_direction WHEN 'down' THEN '낮은' ELSE '높은' END || ' 방향으로 지속적으로 벌어지는 편차가 감지되었습니다.' END AS message
  FROM al WHERE "column" = 'value' AND typed_warning AND NOT spec_violation_warning""")
def alert_messages(spark, folder):
    rows = alert_table(spark, folder, ["value"], with_messages=True)
    return rows.filter("typed_warning and not spec_violation_warning").select("shot_id", "column", "matched_label", "message")


def _printf(pattern, *args):
    return f"printf('{pattern}', {', '.join(args)})"


_WHO = ("machine", "product", "recipe", '"column"')
_MESSAGES_SQL = f"""mm AS (SELECT al.*, ok_mean, r.rate, r.run AS need, typed_warning AND type = 'C' AND entry_warning AS entered
    FROM al JOIN oe USING ("column") LEFT JOIN rules r ON r."column" = al."column"),
  mt AS (SELECT *, CASE WHEN NOT typed_warning THEN ''
      WHEN type = 'A' THEN {_printf(text.DRIFT_ONE_SIDED, *_WHO, f"'{text.RISE}'")}
      WHEN type = 'B' THEN {_printf(text.DRIFT_TWO_SIDED, *_WHO, f"CASE trend_direction WHEN 'up' THEN '{text.ABOVE}' ELSE '{text.BELOW}' END")}
      WHEN entered THEN {_printf(text.ENTERED, *_WHO, 'threshold')}
      WHEN type = 'C' THEN {_printf(text.DRIFT_TO_RISK, *_WHO, f"CASE trend_direction WHEN 'down' THEN '{text.BELOW}' ELSE '{text.ABOVE}' END")}
      ELSE {_printf(text.OFF_NORMAL, *_WHO, 'ok_mean', f"CASE WHEN abs(baseline - ok_mean) > 1e-9 THEN {_printf(text.THEORY, 'baseline')} ELSE '' END")} END AS typed_text,
    CASE WHEN spec_violation_warning THEN {_printf(text.SPEC_RUN, *_WHO, "CAST(CAST(spec_lsl AS INT) AS VARCHAR)", "CAST(CAST(spec_usl AS INT) AS VARCHAR)", 'need', 'current_value', 'rate * 100')} END AS spec_text,
    CASE WHEN external_limit_warning THEN {_printf(text.OVER_LIMIT, 'machine', '"column"', f"'{text.number_text(UPPER['load'].limit)}'", 'current_value', f"'{text.RELATED % 'error'}'")} END AS over_text
    FROM mm)"""


@query("alert_messages_all", f"""WITH {SHOTS_SQL}, {BASE_SQL}, {_MESSAGES_SQL}
  SELECT shot_id, "column", matched_label, concat_ws(' ', over_text, spec_text, nullif(typed_text, '')) AS message FROM mt""")
def alert_messages_all(spark, folder):
    return alert_table(spark, folder, with_messages=True).select("shot_id", "column", "matched_label", "message")


@query("strength_days_left", f"""WITH {SHOTS_SQL} SELECT shot_id, round(greatest(least(1.0, load / 14.0),
  CASE WHEN k - 10 > 0 THEN least(1.0, 14.0 / (k - 10)) WHEN k - 10 <= 0 THEN 1.0 END), 6) AS strength FROM shots""")
def strength_days_left(spark, folder):
    return rounded(shots(spark, folder).select("shot_id", expr.alert_strength(F.col("load"), F.col("k") - 10).alias("strength")), 6, "strength")


@query("spec_violation_events", f"""WITH {SHOTS_SQL}, {BASE_SQL} SELECT shot_id, "column", round(current_value, 6) AS current_value, episode_id
  FROM al WHERE spec_violation_warning AND type = 'E'""")
def spec_violation_events(spark, folder):
    rows = alert_table(spark, folder, ["k"]).filter("spec_violation_warning")
    return rounded(rows.select("shot_id", "column", "current_value", "episode_id"), 6, "current_value")


@query("external_limit_alerts", f"""WITH {SHOTS_SQL}, {BASE_SQL} SELECT shot_id, machine, round(current_value, 6) AS current_value FROM al WHERE external_limit_warning""")
def external_limit_alerts(spark, folder):
    rows = alert_table(spark, folder, ["load"]).filter("external_limit_warning")
    return rounded(rows.select("shot_id", "machine", "current_value"), 6, "current_value")


@query("out_of_spec_share", f"""WITH {SHOTS_SQL}, {BASE_SQL} SELECT count(*) AS alert_rows, count(*) FILTER (spec_violation_warning) AS spec_alerts,
  count(*) FILTER (spec_status <> '') AS checked_rows, count(*) FILTER (spec_status = 'OUT_OF_SPEC') AS out_of_spec_rows,
  round(count(*) FILTER (spec_status = 'OUT_OF_SPEC') / count(*) FILTER (spec_status <> ''), 6) AS out_of_spec_share FROM al""")
def out_of_spec_share(spark, folder):
    return rounded(alerts.warning_rates(alert_table(spark, folder)), 6, "out_of_spec_share")


@query("episode_count", f"""WITH {SHOTS_SQL}, {BASE_SQL} SELECT count(DISTINCT (machine, product, recipe, "column", episode_id)) AS episodes FROM al""")
def episode_count(spark, folder):
    return health.episode_count(alert_table(spark, folder), SHOTS)


ACTIVE_SQL = f"""{BASE_SQL}, aw AS (SELECT machine, "column", ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh
   FROM al WINDOW w AS (PARTITION BY machine, "column" ORDER BY ts)),
 ar AS (SELECT *, sum(fresh) OVER (PARTITION BY machine, "column" ORDER BY ts) AS session FROM aw),
 as1 AS (SELECT machine, "column", session, min(ts) AS since, max(ts) AS last_ts FROM ar GROUP BY ALL),
 la AS (SELECT max(ts) AS latest FROM al),
 act AS (SELECT machine, "column", since, last_ts, round((epoch_us(latest) - epoch_us(since)) / 86400000000.0, 2) AS days
   FROM as1, la QUALIFY row_number() OVER (PARTITION BY machine, "column" ORDER BY session DESC) = 1 AND last_ts >= latest - INTERVAL 1 DAY)"""


@query("active_alerts", f"WITH {SHOTS_SQL}, {ACTIVE_SQL} SELECT * FROM act")
def active_alerts(spark, folder):
    return health.active_alerts(alert_table(spark, folder), "machine", "ts")


@query("alert_strength", f"""WITH {SHOTS_SQL}, {ACTIVE_SQL} SELECT machine, "column", round(least(1.0, days / 14.0), 6) AS strength,
  CASE WHEN days >= 14 THEN 'full' ELSE 'early' END AS alert_level FROM act""")
def alert_strength(spark, folder):
    active = health.active_alerts(alert_table(spark, folder), "machine", "ts")
    return rounded(health.strength(active), 6, "strength").select("machine", "column", "strength", "alert_level")


_SWEEP = [1, 2, 3, 4, 5, 7, 10, 14, 21, 28]
_FAULTY = ["M1", "M2", "M3"]


@query("maturity_sweep", f"""WITH {SHOTS_SQL}, {ACTIVE_SQL}, g(t) AS (VALUES {', '.join(f'({float(t)}::DOUBLE)' for t in _SWEEP)}),
  c AS (SELECT t, {', '.join(f"count(*) FILTER (machine = '{m}' AND days >= t) AS n_{m}" for m in ['M0', *_FAULTY])} FROM g, act GROUP BY t)
  SELECT *, CASE WHEN n_M0 = 0 AND n_M1 >= 1 AND n_M2 >= 1 AND n_M3 >= 1 THEN 'separated' WHEN n_M0 > 0 THEN 'false_alarm' ELSE 'missed' END AS verdict FROM c""")
def maturity_sweep(spark, folder):
    active = health.active_alerts(alert_table(spark, folder), "machine", "ts")
    return health.maturity_sweep(active, "machine", _SWEEP, "M0", _FAULTY)


@query("separable_range", f"""WITH {SHOTS_SQL}, {ACTIVE_SQL}, t AS (SELECT machine, max(days) AS top FROM act GROUP BY 1),
  r AS (SELECT coalesce(max(top) FILTER (machine = 'M0'), 0) AS above_days, min(top) FILTER (machine <> 'M0') AS up_to_days FROM t)
  SELECT *, coalesce(above_days < up_to_days, false) AS separable FROM r""")
def separable_range(spark, folder):
    active = health.active_alerts(alert_table(spark, folder), "machine", "ts")
    return health.separable_range(active, "machine", "M0", _FAULTY)


@query("alert_funnel", f"""WITH {SHOTS_SQL}, {ACTIVE_SQL} SELECT (SELECT count(*) FROM shots) AS input_rows, count(*) AS alert_rows,
  count(DISTINCT (machine, product, recipe, "column", ts)) AS alert_shots, count(DISTINCT (machine, product, recipe, "column", episode_id)) AS episodes,
  count(DISTINCT (machine, "column")) AS entity_columns, (SELECT count(*) FROM act) AS active,
  (SELECT count(*) FILTER (days >= 14) FROM act) AS full_strength FROM al""")
def alert_funnel(spark, folder):
    n = shots(spark, folder).agg(F.count(F.lit(1)).alias("n"))
    return health.funnel(alert_table(spark, folder), SHOTS, n)


SCALE_SQL = f"""{BASE_SQL}, sk AS (SELECT machine, "column", count(*) AS alert_rows, count(DISTINCT (product, recipe)) AS n_strata,
   count(DISTINCT CAST(ts AS DATE)) AS n_days, max(CAST(ts AS DATE)) AS last_day FROM al GROUP BY ALL),
 sc AS (SELECT machine, "column", alert_rows, n_strata, n_days, date_diff('day', last_day, max(last_day) OVER ()) AS days_since_last,
   date_diff('day', last_day, max(last_day) OVER ()) <= 3 AS near_now,
   row_number() OVER (ORDER BY alert_rows DESC, machine, "column") <= 4 AS top_group FROM sk)"""


@query("alert_scale", f"WITH {SHOTS_SQL}, {SCALE_SQL} SELECT * FROM sc")
def alert_scale(spark, folder):
    return health.alert_scale(alert_table(spark, folder), SHOTS)


@query("alert_scale_summary", f"""WITH {SHOTS_SQL}, {SCALE_SQL} SELECT count(*) AS pairs, count(*) FILTER (near_now) AS near_now_pairs,
  min(alert_rows) FILTER (top_group) AS top_lowest, max(alert_rows) FILTER (NOT top_group) AS rest_highest,
  round(min(alert_rows) FILTER (top_group) / max(alert_rows) FILTER (NOT top_group), 6) AS gap_ratio FROM sc""")
def alert_scale_summary(spark, folder):
    return rounded(health.scale_summary(health.alert_scale(alert_table(spark, folder), SHOTS)), 6, "gap_ratio")


@query("detector_overlap", f"""WITH {SHOTS_SQL}, {BASE_SQL}, f AS (SELECT min(ts) FILTER (entry_warning) AS e,
    min(ts) FILTER (typed_warning AND NOT entry_warning) AS c FROM al WHERE type = 'C' GROUP BY machine, "column", product, recipe)
  SELECT count(*) FILTER (e IS NOT NULL AND c IS NULL) AS entry_only, count(*) FILTER (e IS NULL AND c IS NOT NULL) AS cusum_only,
    count(*) FILTER (e IS NOT NULL AND c IS NOT NULL) AS both, count(*) FILTER (e < c) AS entry_first,
    round(avg((epoch_us(c) - epoch_us(e)) / 86400000000.0) FILTER (e < c), 6) AS mean_lead_days FROM f""")
def detector_overlap(spark, folder):
    return rounded(health.detector_overlap(alert_table(spark, folder, ["value"]), SHOTS), 6, "mean_lead_days")


# ------------------------------------------------------------------ parameter sweep

KS, HS = [0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9], [3.5, 4.0, 4.3, 4.5, 5.0, 6.0]
SWEEP_SQL = f"""{BASE_SQL}, kg(k) AS (VALUES {', '.join(f'({k}::DOUBLE)' for k in KS)}), hg(h) AS (VALUES {', '.join(f'({h}::DOUBLE)' for h in HS)}),
 k1 AS (SELECT k, s1.*, sum(z - k) OVER w AS p, sum(z + k) OVER w AS q FROM s1, kg
   WINDOW w AS (PARTITION BY k, machine, product, recipe, "column", label ORDER BY ts, shot_id)),
 k2 AS (SELECT *, p - least(0, min(p) OVER w) AS up, greatest(0, max(q) OVER w) - q AS dn FROM k1
   WINDOW w AS (PARTITION BY k, machine, product, recipe, "column", label ORDER BY ts, shot_id)),
 k3 AS (SELECT k, h, machine, product, recipe, "column", ts FROM k2, hg WHERE rn >= 10 AND h < CASE WHEN type = 'A' THEN up
   WHEN type IN ('B', 'E') THEN greatest(up, dn) WHEN direction = '{LOW}' THEN dn WHEN label <> '' THEN up END),
 k4 AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM k3 WINDOW w AS (PARTITION BY k, h, machine, "column" ORDER BY ts)),
 k5 AS (SELECT *, sum(fresh) OVER (PARTITION BY k, h, machine, "column" ORDER BY ts) AS session FROM k4),
 k6 AS (SELECT k, h, machine, "column", session, count(*) AS n_rows, min(ts) AS start_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days FROM k5 GROUP BY ALL),
 k7 AS (SELECT k, h, CAST(sum(n_rows) AS BIGINT) AS alert_rows, count(*) FILTER (machine = 'M0' AND days >= 5) AS normal_sustained,
   coalesce(max(days) FILTER (machine = 'M0'), 0) AS normal_longest FROM k6 GROUP BY ALL)"""


def swept_days(spark, folder):
    df = shots(spark, folder)
    return sweep.sweep_days(df, references(df), SHOTS, KS, HS)


@query("kh_sweep_default", f"WITH {SHOTS_SQL}, {SWEEP_SQL.replace('days >= 5', 'days >= 14')} SELECT * REPLACE (round(normal_longest, 6) AS normal_longest) FROM k7")
def kh_sweep_default(spark, folder):
    return rounded(sweep.sweep_scores(swept_days(spark, folder), SHOTS, "M0", HS), 6, "normal_longest")


@query("kh_sweep", f"WITH {SHOTS_SQL}, {SWEEP_SQL} SELECT * REPLACE (round(normal_longest, 6) AS normal_longest) FROM k7")
def kh_sweep(spark, folder):
    return rounded(sweep.sweep_scores(swept_days(spark, folder), SHOTS, "M0", HS, sustained_days=5), 6, "normal_longest")


def _onset_sql(base, sigmas, hold):
    return f"""{DAILY_SQL.replace('st0', 'ot0').replace('stl', 'otl').replace('std AS', 'otd AS').replace('JOIN std', 'JOIN otd').replace('st AS', 'ot AS').replace('JOIN st ', 'JOIN ot ')},
 o1 AS (SELECT *, row_number() OVER w AS i FROM dd WINDOW w AS (PARTITION BY machine, "column" ORDER BY dt)),
 o2 AS (SELECT machine, "column", avg(daily_mean) AS m, stddev_samp(daily_mean) AS s FROM o1 WHERE i <= {base} GROUP BY ALL),
 o3 AS (SELECT *, CASE WHEN abs(daily_mean - m) > {sigmas} * s THEN 1 ELSE 0 END AS o FROM o1 JOIN o2 USING (machine, "column")),
 o4 AS (SELECT *, sum(o) OVER (PARTITION BY machine, "column" ORDER BY dt ROWS BETWEEN CURRENT ROW AND {hold - 1} FOLLOWING) AS r FROM o3),
 onset AS (SELECT machine, "column", min(dt) FILTER (r = {hold}) AS onset_day, min(dt) FILTER (o = 1) AS first_crossing FROM o4 GROUP BY ALL)"""


_ONSET_SQL = _onset_sql(10, 1.0, 2)  # short enough to find onsets in the driver tables; the defaults have a query each


@query("onset_day", f"""WITH {SHOTS_SQL}, {_ONSET_SQL} SELECT machine, "column", CAST(onset_day AS VARCHAR) AS onset_day,
  CAST(first_crossing AS VARCHAR) AS first_crossing FROM onset""")
def onset_day(spark, folder):
    out = health.onset_days(shot_daily(shots(spark, folder)), "machine", base_days=10, sigmas=1.0, hold=2)
    return day_text(out, "onset_day", "first_crossing")


@query("onset_day_default", f"""WITH {SHOTS_SQL}, {_onset_sql(30, 3.0, 5)} SELECT machine, "column", CAST(onset_day AS VARCHAR) AS onset_day,
  CAST(first_crossing AS VARCHAR) AS first_crossing FROM onset""")
def onset_day_default(spark, folder):
    return day_text(health.onset_days(shot_daily(shots(spark, folder)), "machine"), "onset_day", "first_crossing")


_KNOWN_CELLS = """kd AS (SELECT k6.*, row_number() OVER (PARTITION BY k, h, machine, "column" ORDER BY days DESC, session) AS i FROM k6),
 kl AS (SELECT k, h, date_diff('day', onset_day, CAST(start_ts AS DATE)) AS lag FROM kd JOIN onset USING (machine, "column") WHERE i = 1 AND machine <> 'M0' AND onset_day IS NOT NULL),
 kw AS (SELECT k, h, max(lag) AS worst_lag, min(lag) AS earliest_lag, count(*) AS n FROM kl GROUP BY ALL),
 kn AS (SELECT count(*) AS known FROM onset WHERE machine <> 'M0' AND onset_day IS NOT NULL),
 kv AS (SELECT k, h, CASE WHEN normal_sustained > 0 THEN 'normal_false_alarm' WHEN earliest_lag < -10 THEN 'pre_onset_false_alarm'
   WHEN coalesce(n, 0) < known OR worst_lag > 10 THEN 'late' ELSE 'pass' END AS verdict FROM k7 LEFT JOIN kw USING (k, h), kn)"""


def known_changes(spark, folder, **band):
    onset = health.onset_days(shot_daily(shots(spark, folder)), "machine", **band)
    return written(onset.filter("machine <> 'M0' and onset_day is not null").select("machine", "column", "onset_day"))


def _grid(spark, folder, known, sustained_days):
    scores = sweep.sweep_scores(swept_days(spark, folder), SHOTS, "M0", HS, known, sustained_days)
    return health.verdict_grid(health.grid_verdicts(scores, known.count()), HS)


_GRID = f"""SELECT k, {', '.join(f"max(verdict) FILTER (h = {h}) AS h_{str(h).replace('.', '_')}" for h in HS)} FROM kv GROUP BY k"""
_LONG_SQL = SWEEP_SQL.replace("days >= 5", "days >= 14")
_BAND = dict(base_days=10, sigmas=1.0, hold=2)  # narrow enough to find changes in the driver tables


@query("kh_grid", f"WITH {SHOTS_SQL}, {SWEEP_SQL}, {_ONSET_SQL}, {_KNOWN_CELLS} {_GRID}")
def kh_grid(spark, folder):
    return _grid(spark, folder, known_changes(spark, folder, **_BAND), 5)


@query("kh_grid_default", f"WITH {SHOTS_SQL}, {_LONG_SQL}, {_onset_sql(30, 3.0, 5)}, {_KNOWN_CELLS} {_GRID}")
def kh_grid_default(spark, folder):
    return _grid(spark, folder, known_changes(spark, folder), RECENT_DAYS)


@query("kh_leave_one_out", f"""WITH {SHOTS_SQL}, {SWEEP_SQL}, {_ONSET_SQL}, {_KNOWN_CELLS},
  lo AS (SELECT DISTINCT machine AS left_out FROM onset WHERE machine <> 'M0' AND onset_day IS NOT NULL),
  ll AS (SELECT left_out, k, h, date_diff('day', onset_day, CAST(start_ts AS DATE)) AS lag FROM kd JOIN onset USING (machine, "column"), lo
    WHERE i = 1 AND machine <> 'M0' AND onset_day IS NOT NULL AND machine <> left_out),
  lw AS (SELECT left_out, k, h, max(lag) AS worst_lag, min(lag) AS earliest_lag, count(*) AS n FROM ll GROUP BY ALL),
  ln AS (SELECT left_out, count(onset_day) FILTER (machine <> left_out AND machine <> 'M0') AS known FROM onset, lo GROUP BY 1),
  lv AS (SELECT left_out, k, h, CASE WHEN normal_sustained > 0 THEN 'normal_false_alarm' WHEN earliest_lag < -10 THEN 'pre_onset_false_alarm'
    WHEN coalesce(n, 0) < known OR worst_lag > 10 THEN 'late' ELSE 'pass' END AS verdict FROM k7 CROSS JOIN ln LEFT JOIN lw USING (left_out, k, h))
  SELECT left_out, count(*) FILTER (verdict = 'pass') AS n_pass, coalesce(bool_or(verdict = 'pass' AND k = 0.7 AND h = 4.5), false) AS chosen_passes FROM lv GROUP BY 1""")
def kh_leave_one_out(spark, folder):
    return sweep.leave_one_out(written(swept_days(spark, folder)), SHOTS, "M0", HS, known_changes(spark, folder, **_BAND), sustained_days=5)


def _boundary_sql(days: int) -> str:
    """CTE ys: kind, subset, size, boundary_k; combinations of the three products are all of one, two and three."""
    return f"""{SWEEP_SQL}, y0 AS (SELECT k, product, "column", ts FROM k3 WHERE machine = 'M0' AND h = 4.5),
  ym AS (SELECT min(dt) + CAST((max(dt) - min(dt)) // 2 AS INTEGER) AS day FROM shots),
  yc AS (SELECT "column", row_number() OVER (ORDER BY "column") AS place FROM (SELECT DISTINCT "column" FROM y0)),
  yp AS (SELECT DISTINCT product FROM y0),
  yq AS (SELECT a.product AS subset, 1 AS size, [a.product] AS members FROM yp a
    UNION ALL SELECT a.product || '+' || b.product, 2, [a.product, b.product] FROM yp a JOIN yp b ON a.product < b.product
    UNION ALL SELECT a.product || '+' || b.product || '+' || c.product, 3, [a.product, b.product, c.product]
      FROM yp a JOIN yp b ON a.product < b.product JOIN yp c ON b.product < c.product),
  yr AS (SELECT 'part' AS kind, 'all' AS subset, * FROM y0
    UNION ALL SELECT 'part', CASE place % 2 WHEN 1 THEN 'odd_columns' ELSE 'even_columns' END, y0.* FROM y0 JOIN yc USING ("column")
    UNION ALL SELECT 'part', CASE WHEN CAST(ts AS DATE) < day THEN 'first_half' ELSE 'second_half' END, y0.* FROM y0, ym
    UNION ALL SELECT 'products', subset, y0.* FROM y0 JOIN yq ON list_contains(members, product)),
  y1 AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM yr WINDOW w AS (PARTITION BY kind, subset, k, "column" ORDER BY ts)),
  y2 AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, subset, k, "column" ORDER BY ts) AS session FROM y1),
  y3 AS (SELECT kind, subset, k, "column", session, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days FROM y2 GROUP BY ALL),
  y4 AS (SELECT DISTINCT kind, subset, k FROM y3 WHERE days >= {days}),
  yn AS (SELECT 'part' AS kind, unnest(['all', 'odd_columns', 'even_columns', 'first_half', 'second_half']) AS subset, 0 AS size
    UNION ALL SELECT 'products', subset, size FROM yq),
  ys AS (SELECT kind, subset, size, min(n.k) FILTER (y4.k IS NULL) AS boundary_k
    FROM (SELECT yn.*, kg.k FROM yn, kg) n LEFT JOIN y4 USING (kind, subset, k) GROUP BY ALL)"""


def boundaries(spark, folder, sustained_days):
    df = shots(spark, folder)
    days = sweep.sweep_days(df, references(df), SHOTS, KS, HS)
    return sweep.boundary_stability(days, SHOTS, "M0", KS, HS, sweep.middle_day(df, "ts"), sustained_days=sustained_days)


@query("boundary_stability", f"WITH {SHOTS_SQL}, {_boundary_sql(3)} SELECT * FROM ys")
def boundary_stability(spark, folder):
    return boundaries(spark, folder, 3)


@query("boundary_stability_default", f"WITH {SHOTS_SQL}, {_boundary_sql(RECENT_DAYS)} SELECT * FROM ys")
def boundary_stability_default(spark, folder):
    return boundaries(spark, folder, RECENT_DAYS)


@query("boundary_by_size", f"""WITH {SHOTS_SQL}, {_boundary_sql(3)} SELECT size, count(*) AS n_subsets, median(boundary_k) AS median_k,
  min(boundary_k) AS lowest_k, max(boundary_k) AS highest_k FROM ys WHERE kind = 'products' GROUP BY 1""")
def boundary_by_size(spark, folder):
    return sweep.boundary_by_size(boundaries(spark, folder, 3))


# ------------------------------------------------------------------ health

def _margins_sql():
    parts = []
    for c, v in SHOTS.limits.items():
        for d in ("up", "down", "either"):
            up = f"greatest((m - {v.target}) / ({v.usl} - {v.target}), 0) * 100"
            dn = f"greatest(({v.target} - m) / ({v.target} - {v.lsl}), 0) * 100"
            body = {"up": up, "down": dn, "either": f"CASE WHEN m >= {v.target} THEN {up} ELSE {dn} END"}[d]
            parts.append(f"SELECT machine, product, recipe, '{c}' AS \"column\", '{d}' AS direction, {body} AS margin FROM (SELECT machine, product, recipe, avg({c}) AS m FROM shots GROUP BY ALL)")
    return " UNION ALL ".join(parts)


_HEALTH = "CASE WHEN margin IS NULL THEN NULL WHEN margin <= 100 THEN 100 - greatest(margin, 0) * 0.9 ELSE 1000.0 / margin END"


def margins(spark, folder):
    means = shots(spark, folder).groupBy(*SHOTS.series).agg(*[F.avg(m).alias(m) for m in SHOTS.limits])
    cells = [
        F.struct(
            F.lit(m).alias("column"), F.lit(d).alias("direction"),
            expr.spec_margin(F.col(m), F.lit(d), *[F.lit(float(x)) for x in (v.lsl, v.target, v.usl)]).alias("margin"),
        )
        for m, v in SHOTS.limits.items() for d in ("up", "down", "either")
    ]
    return means.select(*SHOTS.series, F.inline(F.array(*cells)))


@query("spec_margin", f"WITH {SHOTS_SQL} SELECT machine, product, recipe, \"column\", direction, round(margin, 6) AS margin FROM ({_margins_sql()})")
def spec_margin(spark, folder):
    return rounded(margins(spark, folder), 6, "margin")


@query("margin_health", f"WITH {SHOTS_SQL} SELECT machine, product, recipe, \"column\", direction, round({_HEALTH}, 6) AS health FROM ({_margins_sql()})")
def margin_health(spark, folder):
    out = margins(spark, folder).withColumn("health", expr.margin_to_health(F.col("margin")))
    return rounded(out, 6, "health").drop("margin")


@query("entity_health", f"""WITH {SHOTS_SQL}, h AS (SELECT *, {_HEALTH} AS health, "column" || '/' || direction || '/' || product || recipe AS defect FROM ({_margins_sql()})),
  w AS (SELECT machine, min(health) AS health_index, arg_min(defect, (health, defect)) AS worst_defect FROM h GROUP BY 1)
  SELECT machine, round(health_index, 6) AS health_index, worst_defect, health_index < 30 AS warning FROM w""")
def entity_health(spark, folder):
    rows = margins(spark, folder).select(
        "machine", F.concat_ws("/", "column", "direction", F.concat("product", "recipe")).alias("defect"),
        expr.margin_to_health(F.col("margin")).alias("health"),
    )
    return rounded(health.entity_health(rows, "machine"), 6, "health_index")


@query("alert_level_ranges", f"""WITH {SHOTS_SQL}, {ACTIVE_SQL}, m AS (SELECT machine, "column", max(abs(normalized_deviation)) AS dev FROM al GROUP BY ALL),
  j AS (SELECT CASE WHEN days >= 14 THEN 'full' ELSE 'early' END AS lv, 100 / (1 + dev) AS health FROM act JOIN m USING (machine, "column"))
  SELECT round(min(health) FILTER (lv = 'full'), 6) AS full_min, round(max(health) FILTER (lv = 'full'), 6) AS full_max,
    round(min(health) FILTER (lv = 'early'), 6) AS early_min, round(max(health) FILTER (lv = 'early'), 6) AS early_max,
    max(health) FILTER (lv = 'full') < min(health) FILTER (lv = 'early') AS disjoint FROM j""")
def alert_level_ranges(spark, folder):
    rows = written(alert_table(spark, folder))
    worst = rows.groupBy("machine", "column").agg(F.max(F.abs("normalized_deviation")).alias("dev"))
    levels = health.strength(health.active_alerts(rows, "machine", "ts")).join(worst, ["machine", "column"])
    out = health.level_ranges(levels.withColumn("health", 100 / (1 + F.col("dev"))))
    return rounded(out, 6, "full_min", "full_max", "early_min", "early_max")
