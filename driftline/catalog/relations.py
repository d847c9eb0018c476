"""Relation tables derived from the data, the column catalogue and text artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.baselines import TREND_SQL, shot_daily
from driftline.catalog.bindings import PANEL, PANEL_SQL, SHOTS, SHOTS_SQL, panel, shots
from driftline.catalog.registry import query, rounded, union_sql
from driftline.catalog.thresholds import LABELS, PANEL_PAIRS, PM, stump_sql
from driftline.catalog.warnings import SCALE_SQL, _margins_sql, alert_table, margins
from driftline.functions import expr
from driftline.operators import baseline, catalogue, daily, explore, health, quality, relations, sequence, threshold, trend
from driftline.schema import HIGH, LOW, ZERO_EPS
from driftline.sources import readers, writers
from driftline.store import lookup

_RULES = [("T1", 0.01), ("T2", 0.007), ("T3", 0.004)]


def relation_tables(spark, folder):
    """Interface and tier table: which measure goes with which outcome, how clearly, and
    whether half of the lines shows the same sign."""
    df = panel(spark, folder)
    features = {d: PM for d in PANEL.labels}
    whole = explore.effect_ranking(df, PANEL.series, features)
    half = explore.effect_ranking(df.filter("l_linenumber <= 3"), PANEL.series, features)
    size = F.round("absolute_effect", 9)
    tier = F.lit("T4")
    for name, least in reversed(_RULES):
        tier = F.when(size >= least, name).otherwise(tier)
    joined = whole.join(half.select("label", "feature", F.col("weighted_effect").alias("h")), ["label", "feature"])
    rel = joined.select(
        F.col("feature").alias("factor"), F.col("label").alias("defect"),
        F.when(F.col("weighted_effect") > 0, "True").otherwise("False").alias("alert_usable"),
        F.when(F.col("weighted_effect") > 0, "위로 올라가면 위험").otherwise("아래로 내려가면 위험").alias("threshold_direction"),
        F.when(F.signum("weighted_effect") == F.signum("h"), " 통과 ").otherwise("판정불가").alias("repro_state"),
        F.lit("level").alias("watch_mode"), tier.alias("tier"),
    )
    rel = lookup(rel)  # one line per measure and outcome, used by several steps
    return rel.select("factor", "defect", "alert_usable", "threshold_direction"), rel.select(
        "factor", "defect", "repro_state", "watch_mode", "tier"
    )


def _effects(name, where):
    cells = " UNION ALL ".join(
        f"""SELECT '{d}' AS label, '{m}' AS feature, count(*) FILTER ({d} = 1) AS w, count(*) FILTER ({d} = 0) AS neg, stddev_samp({m}) AS sd,
    avg({m}) FILTER ({d} = 1) - avg({m}) FILTER ({d} = 0) AS gap FROM panel WHERE {where} GROUP BY machine, product, recipe"""
        for d in PANEL.labels for m in PM)
    return f"""{name}0 AS ({cells}), {name} AS (SELECT label, feature, sum(gap / sd * w) / sum(w) AS e FROM {name}0 WHERE w >= 3 AND neg >= 10 AND sd > 0 GROUP BY 1, 2)"""


REL_SQL = f"""{PANEL_SQL}, {_effects('ew', 'true')}, {_effects('eh', 'l_linenumber <= 3')},
 rel AS (SELECT feature AS factor, label AS defect, ew.e > 0 AS usable, ew.e > 0 AS rises, sign(ew.e) = sign(eh.e) AS passed,
   CASE WHEN round(abs(ew.e), 9) >= 0.01 THEN 'T1' WHEN round(abs(ew.e), 9) >= 0.007 THEN 'T2' WHEN round(abs(ew.e), 9) >= 0.004 THEN 'T3' ELSE 'T4' END AS tier
   FROM ew JOIN eh USING (label, feature))"""


@query("pairing_detail", f"""WITH {REL_SQL} SELECT factor, defect, CASE WHEN usable THEN 'True' ELSE 'False' END AS alert_usable,
  CASE WHEN passed THEN ' 통과 ' ELSE '판정불가' END AS repro_state, 'level' AS watch_mode, usable AND passed AS adopted FROM rel""")
def pairing_detail(spark, folder):
    interface, tiers = relation_tables(spark, folder)
    return relations.adopted_pairs(interface, tiers)


@query("pairing_resolved", f"""WITH {REL_SQL}, a AS (SELECT factor, defect, 'relation' AS origin FROM rel WHERE usable AND passed),
  v AS (SELECT factor, defect, 'verified' AS origin FROM rel WHERE NOT passed AND tier <> 'T4' AND factor NOT IN (SELECT factor FROM a)),
  t AS (SELECT * FROM a UNION ALL SELECT * FROM v),
  o AS (SELECT factor, defect, 'alarm_only' AS origin FROM rel WHERE NOT usable AND factor NOT IN (SELECT factor FROM t))
  SELECT * FROM t UNION ALL SELECT * FROM o""")
def pairing_resolved(spark, folder):
    interface, tiers = relation_tables(spark, folder)
    detail = relations.adopted_pairs(interface, tiers)
    verified = tiers.filter("trim(repro_state) <> '통과' and tier <> 'T4'").select("factor", "defect")
    alarm_only = interface.filter("alert_usable = 'False'").select("factor", "defect")
    return relations.resolved_pairs(detail, verified, alarm_only)


@query("pairing_lists", f"""WITH {REL_SQL} SELECT factor, string_agg(defect, ',' ORDER BY defect) AS defects, count(*) > 1 AS multi
  FROM rel WHERE usable AND passed GROUP BY 1""")
def pairing_lists(spark, folder):
    detail = relations.adopted_pairs(*relation_tables(spark, folder))
    lists = relations.pairing_lists(detail.filter("adopted"))
    return lists.withColumn("defects", F.concat_ws(",", "defects"))


@query("known_directions", f"""WITH {REL_SQL} SELECT factor AS "column", defect AS label, CASE WHEN rises THEN '{HIGH}' ELSE '{LOW}' END AS direction FROM rel""")
def known_directions(spark, folder):
    return relations.known_directions(relation_tables(spark, folder)[0])


_USABLE_SQL = f"""{REL_SQL}, fu AS (SELECT factor, bool_and(usable) AS factor_usable FROM rel GROUP BY 1),
 us AS (SELECT factor, defect, passed FROM rel JOIN fu USING (factor) WHERE CASE WHEN tier <> 'T4' THEN usable ELSE factor_usable END)"""


def _usable(spark, folder):
    interface, tiers = relation_tables(spark, folder)
    yes = F.col("alert_usable") == "True"
    per_factor = interface.groupBy("factor").agg(F.bool_and(yes).alias("factor_usable"))
    factors = interface.select("factor", "defect").join(per_factor, "factor")
    judged = tiers.filter("tier <> 'T4'").select("factor", "defect")
    flags = interface.join(judged, ["factor", "defect"], "left_semi").select("factor", "defect", yes.alias("pair_usable"))
    return relations.usable_defects(factors, flags), tiers


@query("usable_defects", f"WITH {_USABLE_SQL} SELECT factor, defect FROM us")
def usable_defects(spark, folder):
    return _usable(spark, folder)[0]


@query("scored_defects", f"WITH {_USABLE_SQL} SELECT factor, defect FROM us WHERE passed")
def scored_defects(spark, folder):
    usable, tiers = _usable(spark, folder)
    return relations.scored_defects(usable, tiers.filter("trim(repro_state) = '통과'").select("factor", "defect"))


@query("tier_pick", f"""WITH {REL_SQL} SELECT factor, defect, tier, CAST(substr(tier, 2, 1) AS INT) AS tier_rank FROM rel
  QUALIFY row_number() OVER (PARTITION BY factor ORDER BY tier, defect) = 1""")
def tier_pick(spark, folder):
    return relations.most_urgent(relation_tables(spark, folder)[1])


@query("factor_direction", f"""WITH {REL_SQL}, p AS (SELECT factor, rises FROM rel WHERE tier <> 'T4' QUALIFY row_number() OVER (PARTITION BY factor ORDER BY tier, defect) = 1),
  c AS (SELECT DISTINCT factor FROM rel UNION SELECT 'l_linenumber')
  SELECT factor, CASE WHEN rises THEN 'up' WHEN NOT rises THEN 'down' ELSE 'either' END AS watch_direction FROM c LEFT JOIN p USING (factor)""")
def factor_direction(spark, folder):
    interface, tiers = relation_tables(spark, folder)
    best = relations.most_urgent(tiers.filter("tier <> 'T4'"))
    known = relations.known_directions(interface).toDF("factor", "defect", "direction")
    chosen = best.join(known, ["factor", "defect"]).select("factor", "direction")
    factors = interface.select("factor").distinct().unionByName(spark.createDataFrame([("l_linenumber",)], "factor string"))
    return relations.directions_of(factors, chosen)


@query("pair_survival", f"""WITH {REL_SQL}, {stump_sql('panel', PANEL_PAIRS)}, g AS (SELECT DISTINCT group_key FROM panel),
  p("column", label) AS (VALUES {', '.join(str(x) for x in PANEL_PAIRS)}),
  d AS (SELECT factor AS "column", defect AS label, CASE WHEN rises THEN '{HIGH}' ELSE '{LOW}' END AS known FROM rel)
  SELECT p."column", p.label, g.group_key, CASE WHEN b.direction IS NOT NULL AND coalesce(known = direction, true) THEN 'learned' ELSE 'expected_missing' END AS state
  FROM p CROSS JOIN g LEFT JOIN b ON b."column" = p."column" AND b.label = p.label AND b.group_key = g.group_key
  LEFT JOIN d ON d."column" = p."column" AND d.label = p.label""")
def pair_survival(spark, folder):
    df = panel(spark, folder)
    known = relations.known_directions(relation_tables(spark, folder)[0])
    learned = lookup(threshold.stump_thresholds(df, PANEL.stratum, PM, LABELS))
    kept = threshold.agreeing(learned, known)
    groups = df.select(PANEL.group_key().alias("group_key")).distinct()
    return relations.pair_survival(PANEL_PAIRS, groups, kept, learned, known)


# ------------------------------------------------------------------ catalogue

_COLUMNS = ["shot_id", "ts", "machine", "product", "recipe", "ng_code", "value", "k", "load", "ratio", "error", "signup"]
_CAT = catalogue.ColumnRules(
    subsystems={"sensor": ["value", "k"], "derived": ["load", "ratio"], "outcome": ["error", "signup", "ng_code"]},
    ids=["shot_id"], categories=["machine", "product", "recipe", "ng_code"], excluded_ids=["shot_id"],
    excluded_measures=["ratio"], outcomes=["ng_code"], notes={"k": "whole number sensor."}, pending={"load": "under review."},
)


@query("column_catalogue", f"""WITH {SHOTS_SQL}, {TREND_SQL},
  c0 AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, {i} AS position, count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing, " + (f"count(*) FILTER ({c} = 0)" if c in ('value', 'load') else "0") + " AS zeros FROM shots" for i, c in enumerate(_COLUMNS))}),
  tr AS (SELECT "column" AS column_name, bool_or(trend_class = 'candidate_upward_drift') AS up, bool_or(trend_class = 'candidate_downward_drift') AS down FROM tt GROUP BY 1),
  dl AS ({union_sql('shots', 'product, recipe', list(SHOTS.measures), 'is_normal')}),
  dc AS (SELECT "column" AS column_name, product, recipe, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM dl GROUP BY ALL),
  dr AS (SELECT column_name, median(CASE WHEN n < 5 THEN NULL WHEN s = 0 THEN 0 ELSE abs(s / m) END) AS ratio FROM dc GROUP BY 1),
  bl AS ({union_sql('shots', 'product, recipe', ['error', 'signup'])}),
  br AS (SELECT "column" AS column_name, product, recipe, avg(value) AS r FROM bl GROUP BY ALL),
  bv AS (SELECT column_name, stddev_samp(r) / avg(r) AS ratio FROM br GROUP BY 1),
  f0 AS (SELECT machine, ts, shot_id, "column", value FROM ({union_sql('shots', 'machine, ts, shot_id', list(SHOTS.measures))})),
  f1 AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS edge FROM f0 WINDOW w AS (PARTITION BY machine, "column" ORDER BY ts, shot_id)),
  f2 AS (SELECT *, sum(edge) OVER (PARTITION BY machine, "column" ORDER BY ts, shot_id) AS run FROM f1),
  f3 AS (SELECT machine, "column" AS column_name, run, count(*) AS length FROM f2 GROUP BY ALL),
  fl AS (SELECT column_name, sum(length) FILTER (length >= 5) AS flat FROM f3 GROUP BY 1),
  sp AS (SELECT column_name, ratio, 'cv_or_range_normalized' AS method FROM dr UNION ALL SELECT column_name, ratio, 'rate_cv' FROM bv)
  SELECT position, column_name AS "column",
    CASE WHEN column_name IN ('value', 'k') THEN 'sensor' WHEN column_name IN ('load', 'ratio') THEN 'derived' WHEN column_name IN ('error', 'signup', 'ng_code') THEN 'outcome' ELSE 'id_production' END AS subsystem,
    CASE WHEN column_name = 'ts' THEN 'datetime' WHEN column_name = 'shot_id' THEN 'id' WHEN column_name IN ('machine', 'product', 'recipe', 'ng_code') THEN 'categorical' WHEN column_name IN ('error', 'signup') THEN 'binary' ELSE 'continuous' END AS data_type,
    CASE WHEN column_name = 'ts' THEN 'datetime' WHEN column_name = 'shot_id' THEN 'identifier_excluded' WHEN column_name = 'ratio' THEN 'excluded_by_expert' WHEN column_name IN ('machine', 'product', 'recipe') THEN 'context_stratum' WHEN column_name = 'ng_code' THEN 'target_outcome' WHEN column_name IN ('error', 'signup') THEN 'target_defect' ELSE 'predictor' END AS analysis_role,
    CASE WHEN method IS NULL THEN 'not_applicable' WHEN sp.ratio < 0.02 THEN 'stable' WHEN sp.ratio < 0.1 THEN 'moderate' ELSE 'variable' END AS variability_class,
    round(sp.ratio, 6) AS variability_ratio, coalesce(method, 'not_applicable') AS dispersion_method,
    CASE WHEN up IS NULL THEN 'not_applicable' WHEN up AND down THEN 'mixed' WHEN up THEN 'candidate_upward_drift' WHEN down THEN 'candidate_downward_drift' ELSE 'no_trend' END AS degradation_trend_class,
    round(missing / c0.n, 6) AS missing_rate, round(zeros / c0.n, 6) AS zero_fault_rate, round(coalesce(flat, 0) / c0.n, 6) AS flatline_fault_rate,
    column_name IN ('product', 'recipe') AS is_operation_condition_key, column_name = 'load' AS pending_review,
    column_name NOT IN ('ts', 'shot_id', 'ratio') AS include_in_downstream_default,
    CASE column_name WHEN 'k' THEN 'whole number sensor.' WHEN 'load' THEN 'under review.' ELSE '' END AS decision_note
  FROM c0 LEFT JOIN sp USING (column_name) LEFT JOIN tr USING (column_name) LEFT JOIN fl USING (column_name)""")
def column_catalogue(spark, folder):
    df = shots(spark, folder)
    spread = baseline.dispersion_continuous(df.filter(SHOTS.normal), SHOTS.stratum, SHOTS.measures).unionByName(
        baseline.dispersion_binary(df, SHOTS.stratum, SHOTS.labels)
    )
    summary = trend.column_summary(trend.trend_table(shot_daily(df), ["machine", "column"]))
    out = catalogue.classification(
        catalogue.taxonomy(spark, _COLUMNS, SHOTS, _CAT), spread, summary,
        quality.missing_and_zero(df, _COLUMNS, ["value", "load"]),
        sequence.flatline_counts(df, SHOTS).select("column", "flatline_count"), _CAT, SHOTS, df.count(),
    )
    return rounded(out, 6, "variability_ratio", "missing_rate", "zero_fault_rate", "flatline_fault_rate")


# ------------------------------------------------------------------ text artefacts

@query("snapshot_flatten", f"""WITH {SHOTS_SQL}, {SCALE_SQL}, m AS ({_margins_sql()}), g AS (SELECT machine, direction AS defect, "column" AS factor, avg(margin) AS margin FROM m GROUP BY ALL),
  d AS (SELECT machine, max(margin) AS top FROM g GROUP BY 1)
  SELECT g.machine, round(100 - top, 4) AS machine_health, defect, factor, coalesce(n_days, 0)::DOUBLE AS alert_active_days, round(100 - margin, 4) AS health_index, round(margin, 4) AS margin_used_pct FROM g JOIN d USING (machine) LEFT JOIN sc ON sc.machine = g.machine AND sc."column" = g.factor""")
def snapshot_flatten(spark, folder):
    return rounded(
        readers.flatten_snapshot(snapshot_text(spark, folder), "text"), 4, "machine_health", "health_index", "margin_used_pct"
    )


def snapshot_text(spark, folder):
    """Health snapshot as one JSON text: machines -> signals -> causes (bounded metadata)."""
    used = margins(spark, folder).groupBy("machine", F.col("direction").alias("defect"), F.col("column").alias("factor")).agg(
        F.avg("margin").alias("margin")
    )
    lasted = health.alert_scale(alert_table(spark, folder), SHOTS).select("machine", F.col("column").alias("factor"), "n_days")
    used = used.join(lasted, ["machine", "factor"], "left")
    cause = F.struct(
        F.coalesce(F.col("n_days").cast("double"), F.lit(0.0)).alias("alert_active_days"), (100 - F.col("margin")).alias("health_index"), F.col("margin").alias("margin_used_pct")
    )

    def as_map(key, value):
        return F.map_from_entries(F.collect_list(F.struct(F.col(key), value)))

    causes = used.groupBy("machine", "defect").agg(as_map("factor", cause).alias("causes"), (100 - F.max("margin")).alias("health_index"))
    signals = causes.groupBy("machine").agg(
        as_map("defect", F.struct("health_index", "causes")).alias("defect_signals"), F.min("health_index").alias("health_index")
    )
    machines = signals.agg(as_map("machine", F.struct("health_index", "defect_signals")).alias("machines"))
    return machines.select(F.to_json(F.struct("machines")).alias("text"))


@query("scale_with_metrics", f"""WITH {SHOTS_SQL}, {SCALE_SQL}, m AS ({_margins_sql()}), g AS (SELECT machine, "column", avg(margin) AS margin FROM m WHERE direction = 'either' GROUP BY ALL)
  SELECT sc.machine, sc."column", alert_rows, n_days, days_since_last, round(100 - margin, 4) AS health_index, round(margin, 4) AS margin_used_pct
  FROM sc LEFT JOIN g USING (machine, "column")""")
def scale_with_metrics(spark, folder):
    scale = health.alert_scale(alert_table(spark, folder), SHOTS)
    metrics = readers.flatten_snapshot(snapshot_text(spark, folder), "text").filter("defect = 'either'").select(
        "machine", F.col("factor").alias("column"), "health_index", "margin_used_pct"
    )
    joined = scale.join(metrics, ["machine", "column"], "left")
    return rounded(joined, 4, "health_index", "margin_used_pct").select(
        "machine", "column", "alert_rows", "n_days", "days_since_last", "health_index", "margin_used_pct"
    )


@query("summary_json", f"""WITH {PANEL_SQL}, s AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS u,
    count(DISTINCT l_linenumber) AS p, count(*) FILTER (is_normal) AS m FROM panel)
  SELECT '{{"row_count":' || n || ',"unique_keys":' || u || ',"duplicate_rows":' || (n - u) || ',"repeated_last_key":' || (n - p) || ',"normal_count":' || m || ',"policy":"flag_only"}}' AS summary FROM s""")
def summary_json(spark, folder):
    return readers.summary_text(quality.key_report(panel(spark, folder), PANEL), {"policy": "flag_only"})


def _histogram_sql(columns, digits=8, bins=32):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", b.bin, round(lo + b.bin * ((hi - lo) / {bins}), {digits}) AS edge,
    coalesce(n.normal_rows, 0) AS normal_rows, coalesce(n.other_rows, 0) AS other_rows
    FROM (SELECT unnest(range({bins})) AS bin) b, (SELECT min({c}) AS lo, max({c}) AS hi FROM shots) e
    LEFT JOIN (SELECT least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1})::BIGINT AS bin, count(*) FILTER (is_normal) AS normal_rows,
      count(*) FILTER (NOT is_normal) AS other_rows FROM shots, (SELECT min({c}) AS lo, max({c}) AS hi FROM shots) WHERE {c} IS NOT NULL GROUP BY 1) n
      ON n.bin = b.bin""" for c in columns)


def _fixed_sql(name):
    return f"""coalesce(',"{name}":' || CAST({name} AS DECIMAL(24, 8))::VARCHAR, '')"""


@query("visual_json", f"""WITH {SHOTS_SQL}, hb AS ({_histogram_sql(['value', 'load'])}),
  dr AS (SELECT machine, dt, avg(value) AS value, avg(load) AS load FROM shots GROUP BY 1, 2),
  dm AS (SELECT machine, dt, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS value_7d_ma,
    CASE WHEN count(load) OVER w >= 3 THEN avg(load) OVER w END AS load_7d_ma
    FROM dr WINDOW w AS (PARTITION BY machine ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  SELECT 'histogram' AS kind, "column" AS name, '{{"column":"' || "column" || '","bins":[' || string_agg('{{"bin":' || bin || {_fixed_sql('edge')}
    || ',"normal_rows":' || normal_rows || ',"other_rows":' || other_rows || '}}', ',' ORDER BY bin) || ']}}' AS record FROM hb GROUP BY "column"
  UNION ALL SELECT 'daily', machine, '{{"machine":"' || machine || '","days":[' || string_agg('{{"dt":"' || dt || '"' || {_fixed_sql('value_7d_ma')}
    || {_fixed_sql('load_7d_ma')} || '}}', ',' ORDER BY dt) || ']}}' FROM dm GROUP BY machine""")
def visual_json(spark, folder):
    df = shots(spark, folder)
    rates = daily.daily_rates(df, SHOTS, ["value", "load"], ["error"])
    bins = explore.histogram(df, ["value", "load"], SHOTS.normal, digits=8)
    return writers.dashboard_records(bins, rates, "machine", "dt", ["value_7d_ma", "load_7d_ma"], digits=8)
