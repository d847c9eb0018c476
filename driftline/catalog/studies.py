"""Label studies, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.baselines import stats_sql
from driftline.catalog.bindings import PANEL, PANEL_SQL, panel, table
from driftline.catalog.registry import query, rounded, union_sql
from driftline.catalog.thresholds import LABELS, PANEL_PAIRS, PM, stump_sql
from driftline.functions import expr
from driftline.operators import labels, relations, splits, threshold
from driftline.operators.baseline import robust_z, stratum_stats
from driftline.schema import HIGH, LOW
from driftline.store import lookup, written

ALL_LABELS = list(PANEL.labels)


def zone_table(df):
    """One zone per (column, label): median threshold and majority direction of the groups."""
    learned = threshold.stump_thresholds(df, PANEL.stratum, PM, LABELS)
    low = F.count_if(F.col("direction") == LOW)
    folded = learned.groupBy("column", "label").agg(
        F.round(F.median("threshold"), 5).alias("threshold"),
        F.when(low * 2 >= F.count(F.lit(1)), LOW).otherwise(HIGH).alias("direction"),
    )
    return folded.withColumn("risky_range", labels.risky_range())


ZONES_SQL = f"""{stump_sql('panel', PANEL_PAIRS)}, zo AS (SELECT "column", label, round(median(threshold), 5) AS threshold,
   CASE WHEN count(*) FILTER (direction = '{LOW}') * 2 >= count(*) THEN '{LOW}' ELSE '{HIGH}' END AS direction FROM b GROUP BY 1, 2)"""


def _risk_sql(source: str, name: str) -> str:
    parts = []
    for c, d in PANEL_PAIRS:
        others = " + ".join(x for x in ALL_LABELS if x != d)
        parts.append(f"""SELECT '{c}' AS "column", '{d}' AS label, {d} AS y, ({others}) > 0 AS other,
      CASE WHEN direction = '{LOW}' THEN {c} <= threshold ELSE {c} >= threshold END AS risky
      FROM {source}, (SELECT * FROM zo WHERE "column" = '{c}' AND label = '{d}')""")
    return f"""{name}0 AS ({' UNION ALL '.join(parts)}),
 {name} AS (SELECT "column", label, count(*) FILTER (risky) AS n_risky,
   round(avg(y) FILTER (risky AND NOT other) / nullif(avg(y) FILTER (NOT risky AND NOT other), 0), 2) AS pure_ratio,
   round(avg(y) FILTER (risky) / nullif(avg(y) FILTER (NOT risky), 0), 2) AS binary_ratio,
   count(*) FILTER (risky AND y = 1) AS n_label_risky,
   round(count(*) FILTER (risky AND y = 1 AND other) * 100 / nullif(count(*) FILTER (risky AND y = 1), 0), 0) AS co_pct FROM {name}0 GROUP BY 1, 2)"""


@query("label_risk_ratio", f"WITH {PANEL_SQL}, {ZONES_SQL}, {_risk_sql('panel', 'rr')} SELECT * FROM rr")
def label_risk_ratio(spark, folder):
    df = panel(spark, folder)
    return labels.risk_ratios(df, zone_table(df), PANEL, ALL_LABELS)


@query("label_grid", f"""WITH {PANEL_SQL}, {ZONES_SQL}, pa AS (SELECT * FROM panel WHERE l_linenumber <= 4), pb AS (SELECT * FROM panel WHERE l_linenumber > 2),
  {_risk_sql('pa', 'ra')}, {_risk_sql('pb', 'rb')}, {_risk_sql('panel', 'rr')},
  u AS (SELECT *, 'early' AS dataset FROM ra UNION ALL SELECT *, 'late' FROM rb)
  SELECT u.*, rr.n_risky AS n_expected, true AS multi_label, u.n_risky - rr.n_risky AS size_drift FROM u JOIN rr USING ("column", label)""")
def label_grid(spark, folder):
    df = panel(spark, folder)
    zones = lookup(zone_table(df))
    subsets = {"early": "l_linenumber <= 4", "late": "l_linenumber > 2", "whole": "true"}
    ratios = written(labels.risk_ratios(df, zones, PANEL, ALL_LABELS, subsets))
    whole = ratios.filter("dataset = 'whole'").select("column", "label", F.col("n_risky").alias("n_expected"))
    expected = whole.select(F.explode(F.array(F.lit("early"), F.lit("late"))).alias("dataset"), "*")
    return labels.invariance_grid(ratios.filter("dataset <> 'whole'"), zones, expected)


_TESTS = {"returned_binary": "returned = 1", "first_line_binary": "first_line = 1",
          "returned_pure": "returned = 1 AND first_line = 0 AND untouched = 0",
          "first_line_pure": "first_line = 1 AND returned = 0 AND untouched = 0"}
_Z_SQL = f"""{stats_sql('panel', 'product, recipe', PM)},
  l AS ({union_sql('panel', 'product, recipe, returned, first_line, untouched', PM)}),
  z AS (SELECT l.*, round((l.value - median) / robust_z_scale, 9) AS s FROM l JOIN st USING (product, recipe, "column")),
  y AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS label, \"column\", s, CASE WHEN {t} THEN 1 ELSE 0 END AS y FROM z" for n, t in _TESTS.items()) + """),
  r AS (SELECT *, rank() OVER (PARTITION BY label, "column" ORDER BY s) + (count(*) OVER (PARTITION BY label, "column", s) - 1) / 2.0 AS rk FROM y),
  e AS (SELECT label, "column", sum(y) AS n1, count(*) - sum(y) AS n2, sum(rk) FILTER (y = 1) AS r1 FROM r GROUP BY ALL)"""


def scored_panel(df):
    stats = stratum_stats(df.filter(PANEL.normal), PANEL.stratum, PM)
    scored = robust_z(df, stats, PANEL.stratum, PM)
    # ranks need equal values to stay equal: cut the float noise of the division
    return scored.select(*ALL_LABELS, *[F.round(f"{m}_z", 9).alias(m) for m in PM])


@query("cliffs_delta", f"""WITH {PANEL_SQL}, {_Z_SQL} SELECT label, "column", CAST(n1 AS BIGINT) AS n_positive,
  round(r1 - n1 * (n1 + 1) / 2, 1) AS u, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) AS delta FROM e""")
def cliffs_delta(spark, folder):
    out = labels.rank_effects(scored_panel(panel(spark, folder)), PM, _TESTS)
    return rounded(rounded(out, 6, "delta"), 1, "u").select("label", "column", F.col("n_positive").cast("bigint").alias("n_positive"), "u", "delta")


_EXPECTED = [("returned_binary", "quantity", "up"), ("returned_binary", "price", "down"), ("first_line_binary", "tax", "up")]


# p values: the normal tail by Simpson's rule over twelve standard deviations
_P_SQL = f"""{_Z_SQL},
  tie AS (SELECT label, "column", sum(c * c * c - c) AS ties FROM (SELECT label, "column", s, count(*)::DOUBLE AS c FROM y GROUP BY ALL) GROUP BY ALL),
  u0 AS (SELECT e.*, ties, r1 - n1 * (n1 + 1) / 2 AS u, (n1 + n2)::DOUBLE AS n FROM e JOIN tie USING (label, "column") WHERE n1 > 0 AND n2 > 0),
  u1 AS (SELECT *, greatest((abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1::DOUBLE * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM u0),
  gr AS (SELECT i, CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(6001) t(i)),
  pv AS (SELECT label, "column", any_value(u) AS u, any_value(n1) AS n1, any_value(n2) AS n2, any_value(z) AS z,
    sum(w * exp(-pow(z + i * 0.002, 2) / 2)) * 0.002 / 3 * 2 / sqrt(2 * pi()) AS p_raw FROM u1, gr GROUP BY ALL),
  br AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p_raw, "column") AS i, count(*) OVER (PARTITION BY label) AS m FROM pv),
  bh AS (SELECT *, least(min(p_raw * m / i) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS p_fdr FROM br)"""


def adjusted_effects(df):
    return labels.bh_adjust(labels.rank_effects(scored_panel(df), PM, _TESTS), ["label"], tie=["column"])


@query("label_verdicts", f"""WITH {PANEL_SQL}, {_P_SQL},
  ex(label, "column", expected) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for a, b, c in _EXPECTED)}),
  dl AS (SELECT bh.*, expected, 2 * u / (n1 * n2) - 1 AS delta FROM bh JOIN ex USING (label, "column"))
  SELECT label, "column", round(delta, 6) AS delta, round(z, 6) AS z, round(p_raw, 8) AS p_raw, round(p_fdr, 8) AS p_fdr, expected,
    sign(delta) = CASE WHEN expected = 'down' THEN -1 ELSE 1 END AS direction_ok, p_fdr < 0.05 AND abs(delta) >= 0.2 AS effect_ok FROM dl""")
def label_verdicts(spark, folder):
    expected = spark.createDataFrame(_EXPECTED, "label string, column string, expected string")
    out = labels.verdicts(adjusted_effects(panel(spark, folder)), expected)
    return rounded(rounded(out, 6, "delta", "z"), 8, "p_raw", "p_fdr").drop("n_positive", "u")


@query("bh_fdr", f"""WITH {PANEL_SQL}, {_P_SQL} SELECT label, "column", round(p_raw, 8) AS p_raw, round(p_fdr, 8) AS p_fdr FROM bh""")
def bh_fdr(spark, folder):
    return rounded(adjusted_effects(panel(spark, folder)), 8, "p_raw", "p_fdr").select("label", "column", "p_raw", "p_fdr")


@query("pure_labels", f"""WITH {PANEL_SQL} SELECT machine, count(*) FILTER (returned = 1) AS binary_returned,
  count(*) FILTER (returned = 1 AND first_line = 0 AND untouched = 0) AS pure_returned,
  count(*) FILTER (first_line = 1 AND returned = 0 AND untouched = 0) AS pure_first_line FROM panel GROUP BY 1""")
def pure_labels(spark, folder):
    pure = {d: expr.pure_label(d, [x for x in ALL_LABELS if x != d]) for d in LABELS}
    return panel(spark, folder).groupBy("machine").agg(
        F.count_if(F.col("returned") == 1).alias("binary_returned"),
        *[F.count_if(test).alias(f"pure_{d}") for d, test in pure.items()],
    )


# ------------------------------------------------------------------ splits and sets

@query("time_split", """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""")
def time_split(spark, folder):
    return splits.time_split(table(spark, folder, "orders"), "o_orderdate", ["o_orderkey"]).select("o_orderkey", "split")


@query("stratified_split", """WITH c AS (SELECT o_orderstatus, count(*) AS k, sum(count(*)) OVER () AS n FROM orders GROUP BY 1),
  q AS (SELECT *, ceil(0.2 * n) * k / n AS exact, floor(ceil(0.2 * n) * k / n) AS base FROM c),
  w AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, o_orderstatus) AS i, ceil(0.2 * n) - sum(base) OVER () AS rest FROM q),
  t AS (SELECT o_orderstatus, base + CASE WHEN i <= rest THEN 1 ELSE 0 END AS quota FROM w),
  h AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) AS j FROM orders)
  SELECT o_orderkey, o_orderstatus, CASE WHEN j <= quota THEN 'test' ELSE 'train' END AS split FROM h JOIN t USING (o_orderstatus)""")
def stratified_split(spark, folder):
    out = splits.stratified_split(table(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"])
    return out.select("o_orderkey", "o_orderstatus", "split")


@query("set_ops", """WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
  u AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F'))
  SELECT 'union_all' AS kind, count(*) AS n FROM u UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT * FROM u)
  UNION ALL SELECT 'only_open', count(*) FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM f)
  UNION ALL SELECT 'only_final', count(*) FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM o)""")
def set_ops(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    opened, final = (orders.filter(F.col("o_orderstatus") == s) for s in ("O", "F"))
    both = opened.unionByName(final)

    def size(kind, df):
        return df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))

    key = ["o_custkey"]
    return (
        size("union_all", both)
        .unionByName(size("distinct", both.distinct()))
        .unionByName(size("only_open", relations.set_difference(opened, final, key)))
        .unionByName(size("only_final", relations.set_difference(final, opened, key)))
    )
