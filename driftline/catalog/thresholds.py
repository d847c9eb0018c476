"""Learned thresholds, zone rates, noise ceilings and limit rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.baselines import CRITICAL_SQL, shot_stats
from driftline.catalog.bindings import PANEL, PANEL_SQL, SHOTS, SHOTS_SQL, UPPER, WATCHED, panel, shots, table
from driftline.catalog.registry import day_text, query, rounded, union_sql
from driftline.functions.tails import alert_count_udf, binomial_quantile_udf
from driftline.operators import daily, spec, threshold, trend
from driftline.operators.shuffles import PRIME, ROUNDS
from driftline.schema import HIGH, LOW
from driftline.store import written

PM = list(PANEL.measures)
LABELS = ["returned", "first_line"]


def stump_sql(source: str, pairs, prefix: str = "b") -> str:
    """CTEs <prefix>c (value counts), <prefix>s (running counts), <prefix> (best split)."""
    counts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{d}' AS label, group_key, CAST({c} AS DOUBLE) AS value, count(*) AS n, sum({d}) AS pos
    FROM {source} WHERE {c} IS NOT NULL GROUP BY ALL""" for c, d in pairs)
    w = 'PARTITION BY "column", label, group_key'
    return f"""{prefix}c AS ({counts}),
 {prefix}s AS (SELECT *, sum(n) OVER ({w}) AS nn, sum(pos) OVER ({w}) AS pp,
   sum(n) OVER ({w} ORDER BY value) - n AS nl, sum(pos) OVER ({w} ORDER BY value) - pos AS pl,
   (value + lag(value) OVER ({w} ORDER BY value)) / 2 AS cut FROM {prefix}c),
 {prefix}h AS (SELECT *, pl / pp * 0.5 AS a, (nl - pl) / (nn - pp) * 0.5 AS b FROM {prefix}s
   WHERE pp >= 10 AND pp < nn AND nl >= 10 AND nn - nl >= 10),
 {prefix}x AS (SELECT *, round((a * a + b * b) / (a + b) + ((0.5 - a) * (0.5 - a) + (0.5 - b) * (0.5 - b)) / ((0.5 - a) + (0.5 - b)), 12) AS score FROM {prefix}h),
 {prefix}r AS (SELECT *, row_number() OVER ({w} ORDER BY score DESC, cut) AS i FROM {prefix}x),
 {prefix} AS (SELECT "column", label, group_key, round(cut, 5) AS threshold, CAST(pp AS BIGINT) AS n_positive,
   round(pl / nl, 5) AS rate_below, round((pp - pl) / (nn - nl), 5) AS rate_above,
   CASE WHEN pl / nl > (pp - pl) / (nn - nl) THEN '{LOW}' ELSE '{HIGH}' END AS direction FROM {prefix}r WHERE i = 1)"""


PANEL_PAIRS = [(c, d) for c in PM for d in LABELS]


@query("stump_threshold", f"WITH {PANEL_SQL}, {stump_sql('panel', PANEL_PAIRS)} SELECT * FROM b")
def stump_threshold(spark, folder):
    return threshold.stump_thresholds(panel(spark, folder), PANEL.stratum, PM, LABELS)


_KNOWN = [("quantity", "returned", HIGH), ("price", "returned", LOW)]
_KNOWN_SQL = 'kd("column", label, known) AS (VALUES ' + ", ".join(str(k) for k in _KNOWN) + ")"


def known_directions(spark):
    return spark.createDataFrame(_KNOWN, "column string, label string, direction string")


@query("stump_direction_filter", f"""WITH {PANEL_SQL}, {stump_sql('panel', PANEL_PAIRS)}, {_KNOWN_SQL}
  SELECT b.* FROM b LEFT JOIN kd USING ("column", label) WHERE known IS NULL OR known = direction""")
def stump_direction_filter(spark, folder):
    learned = threshold.stump_thresholds(panel(spark, folder), PANEL.stratum, PM, LABELS)
    return threshold.agreeing(learned, known_directions(spark))


@query("stump_dropped_groups", f"""WITH {PANEL_SQL}, {stump_sql('panel', PANEL_PAIRS)}, {_KNOWN_SQL}
  SELECT "column", label, count(*) FILTER (direction <> known) AS n_dropped, count(*) AS n_groups FROM b JOIN kd USING ("column", label) GROUP BY 1, 2""")
def stump_dropped_groups(spark, folder):
    learned = threshold.stump_thresholds(panel(spark, folder), PANEL.stratum, PM, LABELS)
    return threshold.contradicting_counts(learned, known_directions(spark))


@query("separation_ratio", f"""WITH {PANEL_SQL}, {stump_sql('panel', PANEL_PAIRS)} SELECT "column", label, group_key,
  CASE WHEN least(rate_below, rate_above) > 0 THEN round(greatest(rate_below, rate_above) / least(rate_below, rate_above), 6) END AS separation_ratio FROM b""")
def separation_ratio(spark, folder):
    learned = threshold.stump_thresholds(panel(spark, folder), PANEL.stratum, PM, LABELS)
    return rounded(threshold.with_separation(learned), 6, "separation_ratio").select("column", "label", "group_key", "separation_ratio")


_ROUTE = [("quantity", "returned"), ("price", "first_line")]
_ROUTE_MIN = 15_000


@query("source_routing", f"""WITH {PANEL_SQL}, mon AS (SELECT * FROM panel WHERE l_linenumber <= 4), trn AS (SELECT * FROM panel WHERE l_linenumber <> 3),
  {stump_sql('mon', _ROUTE, 'm')}, {stump_sql('trn', _ROUTE, 't')},
  c AS (SELECT sum(returned) AS returned, sum(first_line) AS first_line FROM mon),
  e AS (SELECT 'returned' AS label, returned >= {_ROUTE_MIN} AS enough FROM c UNION ALL SELECT 'first_line', first_line >= {_ROUTE_MIN} FROM c)
  SELECT m.*, 'monitored' AS learned_from FROM m JOIN e USING (label) WHERE enough
  UNION ALL SELECT t.*, 'training' FROM t JOIN e USING (label) WHERE NOT enough""")
def source_routing(spark, folder):
    df = panel(spark, folder)
    monitored, training = df.filter("l_linenumber <= 4"), df.filter("l_linenumber <> 3")
    return threshold.routed_thresholds(monitored, training, PANEL.stratum, _ROUTE, _ROUTE_MIN)


SHOT_PAIRS = [(c, d) for c, ds in WATCHED.items() for d in ds]
SHOT_STUMPS = stump_sql("shots", SHOT_PAIRS)


def shot_thresholds(df):
    return threshold.stump_thresholds(df, SHOTS.stratum, list(WATCHED), ["error", "signup"], SHOT_PAIRS)


ZONE_SQL = f"""{SHOT_STUMPS}, zf AS (SELECT s.*, "column", label, CASE WHEN (direction = '{LOW}' AND value < threshold)
   OR (direction = '{HIGH}' AND value > threshold) THEN 1 ELSE 0 END AS in_zone FROM shots s JOIN b USING (group_key))"""


@query("zone_rate_daily", f"""WITH {SHOTS_SQL}, {ZONE_SQL} SELECT machine, "column", label, CAST(dt AS VARCHAR) AS dt, count(*) AS n_rows,
  CAST(sum(in_zone) AS BIGINT) AS n_in_zone, round(avg(in_zone), 6) AS zone_rate FROM zf GROUP BY ALL""")
def zone_rate_daily(spark, folder):
    df = shots(spark, folder)
    return day_text(rounded(daily.zone_rate_daily(df, shot_thresholds(df), SHOTS), 6, "zone_rate"), "dt")


STABLE_SQL = f"""{ZONE_SQL}, zo AS (SELECT machine, "column", label, dt, sum(in_zone) / count(*) AS rate FROM zf WHERE is_ok GROUP BY ALL),
 zd AS (SELECT *, row_number() OVER (PARTITION BY machine, "column", label ORDER BY dt) AS j FROM zo),
 zs AS (SELECT a.machine, a."column", a.label, a.j, a.dt, coalesce(sum(sign(a.rate - b.rate)), 0) AS sj,
   count(b.rate) FILTER (b.rate = a.rate) AS c FROM zd a LEFT JOIN zd b
   ON a.machine = b.machine AND a."column" = b."column" AND a.label = b.label AND b.j < a.j GROUP BY ALL),
 zp AS (SELECT *, sum(sj) OVER w AS s, sum(c) OVER w AS ties,
   sum((c + 1) * c * (2 * c + 7) - c * (c - 1) * (2 * c + 5)) OVER w AS tie_sum FROM zs
   WINDOW w AS (PARTITION BY machine, "column", label ORDER BY j)),
 zc(n, critical) AS ({CRITICAL_SQL}),
 zq AS (SELECT zp.*, CASE WHEN j < 14 OR s <= 0 THEN false WHEN ties = 0 AND critical IS NOT NULL THEN s >= critical
   ELSE s / sqrt((j * (j - 1) * (2 * j + 5) - tie_sum) / 18.0) > 1.9599639845 END AS up FROM zp LEFT JOIN zc ON zc.n = zp.j),
 zz AS (SELECT machine, "column", label, CAST(coalesce(min(j) FILTER (up) - 1, max(j)) AS INT) AS stable_days FROM zq GROUP BY ALL)"""


@query("stable_days", f"""WITH {SHOTS_SQL}, {STABLE_SQL} SELECT * FROM zz""")
def stable_days(spark, folder):
    df = shots(spark, folder)
    return trend.stable_phase(trend.ok_zone_days(df, shot_thresholds(df), SHOTS), SHOTS).drop("days")


ENTRY_SQL = f"""{STABLE_SQL}, er AS (SELECT zf.machine, zf."column", zf.label, group_key, stable_days, count(*) AS n_ok_rows,
   CAST(sum(in_zone) AS BIGINT) AS n_in_zone, avg(in_zone) AS baseline_rate FROM zf JOIN zd USING (machine, "column", label, dt)
   JOIN zz USING (machine, "column", label) WHERE is_ok AND j <= stable_days GROUP BY ALL)"""


@query("entry_rate_baseline", f"""WITH {SHOTS_SQL}, {ENTRY_SQL} SELECT * REPLACE (round(baseline_rate, 6) AS baseline_rate) FROM er""")
def entry_rate_baseline(spark, folder):
    df = shots(spark, folder)
    return rounded(trend.entry_rate_baseline(df, shot_thresholds(df), SHOTS), 6, "baseline_rate")


# ------------------------------------------------------------------ noise ceilings

_ASSIGNED = [("quantity", "returned"), ("tax", "first_line"), ("discount", "absent_label")]
_REPS = 40


def network_sql(rows: str) -> str:
    """Rows with ``y`` moved once through the keyed network on an ``a`` x ``b`` rectangle (a0, f0, a1, f1, ... are the keys)."""
    out = f"SELECT * EXCLUDE (y), y // b AS l, y % b AS r FROM ({rows})"
    for k in range(ROUNDS):
        one, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        mixed = f"(({other} + a{k}) * ({other} + a{k})) % {PRIME} * f{k} % {PRIME}"
        out = f"SELECT * REPLACE (({one} + ({mixed}) * {size} // {PRIME + 1}) % {size} AS {one}) FROM ({out})"
    return f"SELECT * EXCLUDE (l, r), l * b + r AS y FROM ({out})"


def shuffled_sql(source: str, columns, labels, reps: int = _REPS, seed: int = 0) -> str:
    """CTEs xc (value counts), xt (totals and keys), xw (permuted positions), xb (best split per replicate)."""
    sums = ", ".join(f"sum({d}) AS pos_{d}" for d in labels)
    counts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", group_key, CAST({c} AS DOUBLE) AS value, count(*) AS n, {sums} FROM {source} WHERE {c} IS NOT NULL GROUP BY ALL"""
        for c in columns)
    text = f"""'{seed}|' || group_key || '|' || "column" || '|' || rep || '|'"""
    drawn = ", ".join(f"('0x' || md5({text} || '{k}')[1:7])::BIGINT AS a{k}, ('0x' || md5({text} || '{k}')[8:14])::BIGINT + 1 AS f{k}" for k in range(ROUNDS))
    step = network_sql("SELECT * FROM xw WHERE y >= nn")
    w = 'PARTITION BY "column", label, group_key, rep'
    each = " UNION ALL ".join(
        f"""SELECT "column", group_key, '{d}' AS label, rep, value, count(*) AS n, count(*) FILTER (y < pp_{d}) AS pos FROM xw WHERE y < nn GROUP BY ALL"""
        for d in labels)
    return f"""xc AS ({counts}),
 xt AS (SELECT "column", group_key, sum(n)::BIGINT AS nn, {', '.join(f'sum(pos_{d})::BIGINT AS pp_{d}' for d in labels)},
   CAST(ceil(sqrt(sum(n))) AS BIGINT) AS a FROM xc GROUP BY ALL),
 xk AS (SELECT *, (nn + a - 1) // a AS b, {drawn} FROM xt, (SELECT unnest(range({reps})) AS rep)),
 xp AS (SELECT "column", group_key, value, (sum(n) OVER (PARTITION BY "column", group_key ORDER BY value) - n)::BIGINT + unnest(range(n)) AS y FROM xc),
 xw AS ({network_sql('SELECT * FROM xp JOIN xk USING ("column", group_key)')} UNION ALL {step}),
 xm AS ({each}),
 xs AS (SELECT *, sum(n) OVER ({w}) AS nn, sum(pos) OVER ({w}) AS pp, sum(n) OVER ({w} ORDER BY value) - n AS nl,
   sum(pos) OVER ({w} ORDER BY value) - pos AS pl FROM xm),
 xh AS (SELECT *, pl / pp * 0.5 AS u, (nl - pl) / (nn - pp) * 0.5 AS v FROM xs WHERE pp >= 10 AND pp < nn AND nl >= 10 AND nn - nl >= 10),
 xo AS (SELECT *, round((u * u + v * v) / (u + v) + ((0.5 - u) * (0.5 - u) + (0.5 - v) * (0.5 - v)) / ((0.5 - u) + (0.5 - v)), 12) AS score FROM xh),
 xr AS (SELECT *, row_number() OVER ({w} ORDER BY score DESC, nl) AS i FROM xo),
 xb AS (SELECT "column", label, group_key, rep, round(pl / nl, 5) AS rate_below, round((pp - pl) / (nn - nl), 5) AS rate_above,
   CASE WHEN pl / nl > (pp - pl) / (nn - nl) THEN '{LOW}' ELSE '{HIGH}' END AS direction FROM xr WHERE i = 1)"""


def _fold_sql(source: str, keys: str, more: str = "") -> str:
    return f"""SELECT {keys}, count(*) AS n_groups_fitted, median(greatest(rate_below, rate_above) / least(rate_below, rate_above)) AS separation,
    greatest(count(*) FILTER (direction = '{LOW}'), count(*) FILTER (direction = '{HIGH}')) / count(*) AS consistency,
    CASE WHEN count(*) FILTER (direction = '{LOW}') * 2 >= count(*) THEN '{LOW}' ELSE '{HIGH}' END AS dominant_direction {more}
    FROM {source} WHERE least(rate_below, rate_above) > 0 GROUP BY ALL"""


_LISTED_SQL = ", ".join(str(p) for p in _ASSIGNED)
SCAN_SQL = f"""{PANEL_SQL}, {stump_sql('panel', PANEL_PAIRS)}, {shuffled_sql('panel', PM, LABELS)},
 seen AS ({_fold_sql('b', 'label, "column"', ', median(threshold) AS threshold_median')}),
 noise AS ({_fold_sql('xb', 'label, "column", rep')}),
 single AS (SELECT label, quantile_cont(separation, 0.95) AS p95 FROM noise GROUP BY 1),
 joint AS (SELECT label, quantile_cont(s, 0.95) AS fwer, quantile_cont(c, 0.95) AS cons FROM (
   SELECT label, rep, max(separation) AS s, max(consistency) AS c FROM noise GROUP BY ALL) GROUP BY 1),
 scan AS (SELECT label, "column", n_groups_fitted, round(separation, 3) AS separation_ratio_median, round(p95, 3) AS noise_ceiling_p95,
   round(fwer, 3) AS noise_ceiling_fwer, round(cons, 3) AS consistency_ceiling_fwer, round(separation / nullif(p95, 0), 2) AS signal_over_noise,
   coalesce(separation > fwer, false) AS passes_fwer, coalesce(consistency > cons, false) AS passes_direction,
   round(threshold_median, 5) AS threshold_median, dominant_direction, round(consistency, 3) AS direction_consistency,
   ("column", label) IN ({_LISTED_SQL}) AS assigned FROM seen LEFT JOIN single USING (label) LEFT JOIN joint USING (label)),
 found AS (SELECT "column", label, CASE WHEN assigned AND passes_fwer AND passes_direction THEN 'confirmed' WHEN assigned THEN 'assigned_but_weak'
     WHEN passes_fwer AND passes_direction THEN 'candidate_without_pair' END AS finding FROM scan
   UNION ALL SELECT * , 'assigned_but_not_fitted' FROM (VALUES {_LISTED_SQL}) v("column", label) WHERE ("column", label) NOT IN (SELECT ("column", label) FROM scan)),
 findings AS (SELECT *, CASE finding WHEN 'confirmed' THEN 'info' WHEN 'candidate_without_pair' THEN 'candidate' ELSE 'warning' END AS severity
   FROM found WHERE finding IS NOT NULL)"""


@query("permutation_scan", f"WITH RECURSIVE {SCAN_SQL} SELECT * FROM scan")
def permutation_scan(spark, folder):
    return threshold.candidate_scan(panel(spark, folder), PANEL.stratum, PM, LABELS, _ASSIGNED, _REPS)


def assigned_pairs(spark):
    return spark.createDataFrame(_ASSIGNED, "column string, label string")


@query("scan_findings", f"WITH RECURSIVE {SCAN_SQL} SELECT * FROM findings")
def scan_findings(spark, folder):
    return threshold.scan_findings(permutation_scan(spark, folder), assigned_pairs(spark))


@query("scan_label_counts", f"""WITH RECURSIVE {SCAN_SQL}, f AS (SELECT label, count(*) FILTER (finding = 'confirmed') AS n_confirmed,
    count(*) FILTER (finding = 'assigned_but_weak') AS n_weak, count(*) FILTER (finding = 'assigned_but_not_fitted') AS n_not_fitted,
    count(*) FILTER (finding = 'candidate_without_pair') AS n_candidates FROM findings GROUP BY 1),
  n AS (SELECT label, count(*) AS n_scanned FROM scan GROUP BY 1)
  SELECT label, coalesce(n_scanned, 0) AS n_scanned, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(n_weak, 0) AS n_weak,
    coalesce(n_not_fitted, 0) AS n_not_fitted, coalesce(n_candidates, 0) AS n_candidates,
    coalesce(n_weak, 0) + coalesce(n_not_fitted, 0) = 0 AS all_assigned_pass FROM n FULL JOIN f USING (label)""")
def scan_label_counts(spark, folder):
    scan = written(permutation_scan(spark, folder))
    return threshold.finding_counts(threshold.scan_findings(scan, assigned_pairs(spark)), scan)


@query("scan_observed", f"""WITH {PANEL_SQL}, {stump_sql('panel', PANEL_PAIRS)}, r AS (SELECT *,
    greatest(rate_below, rate_above) / least(rate_below, rate_above) AS ratio FROM b WHERE least(rate_below, rate_above) > 0)
  SELECT label, "column", count(*) AS n_groups_fitted, round(median(ratio), 3) AS separation_ratio_median,
    round(median(threshold), 5) AS threshold_median, CASE WHEN count(*) FILTER (direction = '{LOW}') * 2 >= count(*) THEN '{LOW}' ELSE '{HIGH}' END AS dominant_direction,
    round(greatest(count(*) FILTER (direction = '{LOW}'), count(*) FILTER (direction = '{HIGH}')) / count(*), 3) AS direction_consistency FROM r GROUP BY 1, 2""")
def scan_observed(spark, folder):
    scan = threshold.candidate_scan(panel(spark, folder), PANEL.stratum, PM, LABELS, _ASSIGNED, reps=2)
    return scan.select("label", "column", "n_groups_fitted", "separation_ratio_median", "threshold_median",
                       "dominant_direction", "direction_consistency")


# ------------------------------------------------------------------ tails and limits

def _pmf(k: str, n: str, p: str) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


@query("binomial_k", f"""WITH {SHOTS_SQL}, {ENTRY_SQL}, g AS (SELECT machine, "column", label, group_key, baseline_rate AS p, k.k AS k FROM er, range(0, 11) k(k)),
  f AS (SELECT *, CASE WHEN p <= 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END WHEN p >= 1 THEN CASE WHEN k = 10 THEN 1.0 ELSE 0.0 END
    ELSE {_pmf('k', '10', 'p')} END AS pmf FROM g),
  t AS (SELECT *, sum(pmf) OVER (PARTITION BY machine, "column", label, group_key ORDER BY k DESC) AS sf FROM f)
  SELECT machine, "column", label, group_key, CAST(coalesce(min(k) FILTER (sf < 0.01 AND k >= 1), 11) AS BIGINT) AS alert_count FROM t GROUP BY ALL""")
def binomial_k(spark, folder):
    df = shots(spark, folder)
    rates = trend.entry_rate_baseline(df, shot_thresholds(df), SHOTS)
    count = alert_count_udf("baseline_rate", F.lit(10).cast("bigint"), F.lit(0.01))
    return rates.select("machine", "column", "label", "group_key", count.alias("alert_count"))


@query("binomial_ppf", f"""WITH {SHOTS_SQL}, d AS (SELECT DISTINCT n FROM (SELECT count(*) AS n FROM shots GROUP BY machine, dt)),
  g AS (SELECT n, k.k AS k, {_pmf('k.k', 'n', '0.3')} AS pmf FROM d, LATERAL (SELECT unnest(range(0, n + 1)) AS k) k),
  c AS (SELECT n, k, sum(pmf) OVER (PARTITION BY n ORDER BY k) AS cdf FROM g)
  SELECT n AS n_rows, CAST(min(k) AS BIGINT) AS need FROM c WHERE cdf >= 0.99 GROUP BY 1""")
def binomial_ppf(spark, folder):
    sizes = shots(spark, folder).groupBy("machine", F.to_date("ts")).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.select("n_rows").distinct().select(
        "n_rows", binomial_quantile_udf(F.lit(0.99), "n_rows", F.lit(0.3)).alias("need")
    )


_RUN_SQL = "CASE " + " ".join(f"WHEN pow(rate, {r}) * n < 0.01 THEN {r}" for r in range(1, 10)) + " ELSE 10 END"
RULES_SQL = "ru AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {float(v.lsl)}::DOUBLE AS lsl, {float(v.usl)}::DOUBLE AS usl, count(*) AS n,
    avg(CASE WHEN {c} < {v.lsl} OR {c} > {v.usl} THEN 1.0 ELSE 0.0 END) AS rate FROM shots""" for c, v in SHOTS.limits.items()
) + f"), rules AS (SELECT \"column\", lsl, usl, rate, CAST({_RUN_SQL} AS INT) AS run FROM ru)"


@query("required_run", f"""WITH {SHOTS_SQL}, {RULES_SQL} SELECT * REPLACE (round(rate, 6) AS rate) FROM rules""")
def required_run(spark, folder):
    return rounded(spec.spec_rules(shots(spark, folder), SHOTS), 6, "rate")


BREACH_SQL = f"""bd AS (SELECT machine, dt, count(*) AS n_rows, count(*) FILTER (load > {UPPER['load'].limit}) AS n_over FROM shots GROUP BY 1, 2),
 bn AS (SELECT DISTINCT n_rows AS n FROM bd),
 bg AS (SELECT n, k.k AS k, {_pmf('k.k', 'n', '0.001')} AS pmf FROM bn, LATERAL (SELECT unnest(range(0, n + 1)) AS k) k),
 bq AS (SELECT n, k, sum(pmf) OVER (PARTITION BY n ORDER BY k) AS cdf FROM bg),
 bz AS (SELECT n AS n_rows, greatest(min(k), 1) AS need FROM bq WHERE cdf >= 0.99 GROUP BY 1),
 breach AS (SELECT machine, dt, n_rows, CAST(need AS BIGINT) AS need, n_over, n_over >= need AS breach FROM bd JOIN bz USING (n_rows))"""


@query("limit_breach_days", f"""WITH {SHOTS_SQL}, {BREACH_SQL} SELECT machine, CAST(dt AS VARCHAR) AS dt, n_rows, need, 'load' AS "column",
  {UPPER['load'].limit} ::DOUBLE AS upper_limit, n_over, breach FROM breach""")
def limit_breach_days(spark, folder):
    return day_text(spec.breach_days(shots(spark, folder), SHOTS, UPPER), "dt")


@query("upper_limit_rules", """WITH p AS (SELECT p_type AS factor, p_name AS defect, min(p_partkey) AS position, min_by(p_size, p_partkey) AS size FROM part GROUP BY 1, 2),
  t AS (SELECT *, CASE WHEN size % 3 = 0 THEN 'n/a' ELSE CAST(size AS VARCHAR) END AS upper_limit FROM p)
  SELECT factor, CAST(min_by(TRY_CAST(upper_limit AS DOUBLE), CASE WHEN TRY_CAST(upper_limit AS DOUBLE) IS NOT NULL THEN position END) AS DOUBLE) AS upper_limit,
    count(*) AS n_defects FROM t GROUP BY 1 HAVING count(TRY_CAST(upper_limit AS DOUBLE)) > 0""")
def upper_limit_rules(spark, folder):
    # one line per (type, name) pair: the vocabulary of the parts, not the parts
    pairs = table(spark, folder, "part").groupBy(F.col("p_type").alias("factor"), F.col("p_name").alias("defect")).agg(
        F.min("p_partkey").alias("position"), F.min_by("p_size", "p_partkey").alias("size")
    )
    text = F.when(F.col("size") % 3 == 0, "n/a").otherwise(F.col("size").cast("string"))
    rules = pairs.select("factor", "defect", "position", text.alias("upper_limit"), F.lit("").alias("evidence_level"))
    return spec.upper_limits(rules).select("factor", "upper_limit", F.size("defects").cast("bigint").alias("n_defects"))


@query("cpk", f"""WITH {SHOTS_SQL}, l AS (""" + " UNION ALL ".join(
    f"""SELECT machine, '{c}' AS "column", count(*) AS n_rows, least({v.usl} - avg({c}), avg({c}) - {v.lsl}) / (3 * stddev_samp({c})) AS cpk FROM shots GROUP BY 1"""
    for c, v in SHOTS.limits.items()) + """) SELECT machine, "column", n_rows, round(cpk, 6) AS cpk FROM l""")
def cpk(spark, folder):
    return rounded(spec.capability(shots(spark, folder), SHOTS, ["machine"]), 6, "cpk")


@query("cpk_degraded", f"""WITH {SHOTS_SQL}, l AS (""" + " UNION ALL ".join(
    f"""SELECT machine, '{c}' AS "column", least({v.usl} - avg({c}), avg({c}) - {v.lsl}) / (3 * stddev_samp({c})) AS cpk FROM shots GROUP BY 1"""
    for c, v in SHOTS.limits.items()) + """) SELECT l.machine, "column", round(l.cpk, 6) AS cpk, round(n.cpk, 6) AS normal_cpk, round(l.cpk - n.cpk, 6) AS gap,
    l.cpk < n.cpk AS degraded FROM l JOIN (SELECT "column", cpk FROM l WHERE machine = 'M0') n USING ("column") WHERE machine <> 'M0'""")
def cpk_degraded(spark, folder):
    values = spec.capability(shots(spark, folder), SHOTS, ["machine"])
    return rounded(spec.capability_gap(values, "machine", "M0"), 6, "cpk", "normal_cpk", "gap")


@query("fixed_offsets", f"""WITH {SHOTS_SQL}, sl AS ({union_sql('shots', 'product, recipe', list(SHOTS.measures), 'is_normal')}),
  st AS (SELECT product, recipe, "column", avg(value) AS mean, stddev_samp(value) AS std FROM sl GROUP BY ALL),
  l AS ({union_sql('shots', 'machine, product, recipe', list(SHOTS.measures))}),
  m AS (SELECT machine, product, recipe, "column", avg(value) AS v, count(*) AS n FROM l GROUP BY ALL),
  o AS (SELECT machine, abs((v - mean) / std) AS offset_sigma FROM m JOIN st USING (product, recipe, "column") WHERE n >= 30 AND std > 0)
  SELECT machine, count(*) AS n_series, round(median(offset_sigma), 6) AS median_offset, round(max(offset_sigma), 6) AS max_offset,
    count(*) FILTER (offset_sigma >= 0.2) AS n_ge_0_2, count(*) FILTER (offset_sigma >= 0.3) AS n_ge_0_3, count(*) FILTER (offset_sigma >= 0.44) AS n_ge_0_44
  FROM o GROUP BY 1""")
def fixed_offsets(spark, folder):
    df = shots(spark, folder)
    out = spec.offset_shares(spec.fixed_offsets(df, shot_stats(df), SHOTS), "machine")
    return rounded(out, 6, "median_offset", "max_offset")
