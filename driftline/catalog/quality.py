"""Data checks, features and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.bindings import PANEL, PANEL_SQL, SHOTS, SHOTS_SQL, panel, shots, table
from driftline.catalog.registry import query, rounded, union_sql
from driftline.functions import expr
from driftline.operators import explore, quality, sequence
from driftline.operators.baseline import spec_exceedance, stratum_stats
from driftline.plans.loading import load
from driftline.schema import Roles

PM = list(PANEL.measures)
SM = list(SHOTS.measures)

PANEL_STATS = f"""pl AS ({union_sql('panel', 'product, recipe', PM, 'is_normal')}),
 st AS (SELECT product, recipe, "column", count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std,
   min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median,
   quantile_cont(value, 0.005) AS p0_5, quantile_cont(value, 0.995) AS p99_5 FROM pl GROUP BY ALL)"""


@query("dq_key_report", f"""WITH {PANEL_SQL} SELECT count(*) AS row_count,
  count(DISTINCT (l_orderkey, l_linenumber)) AS unique_keys,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows,
  count(*) - count(DISTINCT l_linenumber) AS repeated_last_key,
  count(*) FILTER (is_normal) AS normal_count FROM panel""")
def dq_key_report(spark, folder):
    return quality.key_report(panel(spark, folder), PANEL)


_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ZERO = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dq_missing_zero", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing_count,
    round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_rate,
    {f'count(*) FILTER ({c} = 0)' if c in _ZERO else '0'} AS zero_count,
    round({f'count(*) FILTER ({c} = 0)' if c in _ZERO else '0'} / count(*), 6) AS zero_rate,
    'flag_only' AS suggested_handling FROM lineitem""" for c in _COLS))
def dq_missing_zero(spark, folder):
    out = quality.missing_and_zero(table(spark, folder, "lineitem"), _COLS, _ZERO)
    return rounded(out, 6, "missing_rate", "zero_rate")


@query("dq_flatline_runs", f"""WITH {SHOTS_SQL}, l AS (SELECT machine, ts, shot_id, "column", value FROM (
    {union_sql('shots', 'machine, ts, shot_id', SM)})),
  e AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS edge FROM l
    WINDOW w AS (PARTITION BY machine, "column" ORDER BY ts, shot_id)),
  r AS (SELECT *, sum(edge) OVER (PARTITION BY machine, "column" ORDER BY ts, shot_id) AS run FROM e),
  c AS (SELECT machine, "column", run, count(*) AS length FROM r GROUP BY ALL)
  SELECT "column", CAST(coalesce(sum(length) FILTER (length >= 2), 0) AS BIGINT) AS flatline_count,
    max(length) AS longest_run FROM c GROUP BY 1""")
def dq_flatline_runs(spark, folder):
    return sequence.flatline_counts(shots(spark, folder), SHOTS, min_run=2)


@query("normal_flag_counts", f"""WITH {PANEL_SQL} SELECT product, recipe, count(*) AS n_rows,
  count(*) FILTER (is_normal) AS n_normal, count(*) FILTER (is_ok) AS n_ok FROM panel GROUP BY 1, 2""")
def normal_flag_counts(spark, folder):
    return panel(spark, folder).groupBy("product", "recipe").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.expr(PANEL.normal)).alias("n_normal"),
        F.count_if(F.expr(PANEL.ok)).alias("n_ok"),
    )


@query("ratio_features", f"""WITH {PANEL_SQL}, f AS (SELECT group_key, price / nullif(quantity, 0) AS unit_price,
    price * (1 - discount) AS net_price, CASE WHEN abs(discount) > 1e-9 THEN tax / discount END AS tax_ratio FROM panel)
  SELECT group_key, round(avg(unit_price), 4) AS unit_price, round(avg(net_price), 2) AS net_price,
    round(avg(tax_ratio), 6) AS tax_ratio, count(tax_ratio) AS n_ratio FROM f GROUP BY 1""")
def ratio_features(spark, folder):
    c = F.col
    featured = panel(spark, folder).select(
        PANEL.group_key().alias("group_key"),
        F.try_divide("price", "quantity").alias("unit_price"),
        (c("price") * (1 - c("discount"))).alias("net_price"),
        expr.guarded_ratio(c("tax"), c("discount")).alias("tax_ratio"),
    )
    out = featured.groupBy("group_key").agg(
        F.round(F.avg("unit_price"), 4).alias("unit_price"), F.round(F.avg("net_price"), 2).alias("net_price"),
        F.round(F.avg("tax_ratio"), 6).alias("tax_ratio"), F.count("tax_ratio").alias("n_ratio"),
    )
    return out


@query("row_asymmetry", f"""WITH {PANEL_SQL}, a AS (SELECT machine, (SELECT stddev_samp(x) FROM
    (SELECT unnest([quantity, discount * 100, tax * 100, CAST(l_linenumber AS DOUBLE)]) AS x)) AS s FROM panel)
  SELECT machine, round(avg(s), 6) AS asymmetry, round(max(s), 6) AS widest FROM a GROUP BY 1""")
def row_asymmetry(spark, folder):
    sized = panel(spark, folder).select(
        "machine", "quantity", (F.col("discount") * 100).alias("d100"), (F.col("tax") * 100).alias("t100"), "l_linenumber"
    )
    spread = sized.select("machine", expr.row_std(["quantity", "d100", "t100", "l_linenumber"]).alias("s"))
    return spread.groupBy("machine").agg(F.round(F.avg("s"), 6).alias("asymmetry"), F.round(F.max("s"), 6).alias("widest"))


@query("spec_exceedance", f"""WITH {PANEL_SQL}, {PANEL_STATS},
  l AS ({union_sql('panel', 'machine, product, recipe', PM)}),
  x AS (SELECT machine, l."column", greatest(value - p99_5, 0) + greatest(p0_5 - value, 0) AS e
    FROM l JOIN st USING (product, recipe, "column"))
  SELECT machine, "column", count(*) FILTER (e > 0) AS n_outside, round(sum(e), 3) AS total FROM x GROUP BY 1, 2""")
def spec_exceedance_query(spark, folder):
    df = panel(spark, folder)
    stats = stratum_stats(df.filter(PANEL.normal), PANEL.stratum, PM)
    out = spec_exceedance(df, stats, PANEL.stratum, PM)
    sums = out.groupBy("machine").agg(
        *[F.count_if(F.col(f"{m}_spec_exceedance") > 0).alias(f"n_{m}") for m in PM],
        *[F.sum(f"{m}_spec_exceedance").alias(f"s_{m}") for m in PM],
    )
    cells = [F.struct(F.lit(m).alias("column"), F.col(f"n_{m}").alias("n_outside"), F.round(f"s_{m}", 3).alias("total")) for m in PM]
    return sums.select("machine", F.inline(F.array(*cells)))


_FEATURES = {"returned": PM, "first_line": ["quantity", "discount", "tax"]}


@query("effect_ranking", f"""WITH {PANEL_SQL}, s AS (""" + " UNION ALL ".join(
    f"""SELECT '{d}' AS label, '{m}' AS feature, machine, product, recipe, count(*) FILTER ({d} = 1) AS w,
    count(*) FILTER ({d} = 0) AS neg, stddev_samp({m}) AS sd, avg({m}) FILTER ({d} = 1) - avg({m}) FILTER ({d} = 0) AS gap
    FROM panel GROUP BY machine, product, recipe""" for d, ms in _FEATURES.items() for m in ms) + """)
  SELECT label, feature, round(sum(gap / sd * w) / sum(w), 6) AS weighted_effect,
    round(abs(sum(gap / sd * w) / sum(w)), 6) AS absolute_effect, count(*) AS valid_strata
  FROM s WHERE w >= 3 AND neg >= 10 AND sd > 0 GROUP BY 1, 2""")
def effect_ranking(spark, folder):
    out = explore.effect_ranking(panel(spark, folder), PANEL.series, _FEATURES)
    return rounded(out, 6, "weighted_effect", "absolute_effect")


_PAIRS = [(x, y) for x in ("quantity", "price") for y in ("discount", "tax", "returned")]


@query("spearman_pairs", f"""WITH {PANEL_SQL}, l AS (""" + " UNION ALL ".join(
    f"SELECT '{p}' AS population, '{x}' AS x_name, '{y}' AS y_name, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM panel WHERE {t}"
    for x, y in _PAIRS for p, t in (("all", "true"), ("normal", "is_normal"))) + """),
  r AS (SELECT *, rank() OVER (PARTITION BY population, x_name, y_name ORDER BY x)
      + (count(*) OVER (PARTITION BY population, x_name, y_name, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY population, x_name, y_name ORDER BY y)
      + (count(*) OVER (PARTITION BY population, x_name, y_name, y) - 1) / 2.0 AS ry FROM l)
  SELECT population, x_name, y_name, count(*) AS n_rows,
    CASE WHEN count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN round(corr(rx, ry), 6) END AS spearman_r
  FROM r GROUP BY 1, 2, 3""")
def spearman_pairs(spark, folder):
    out = explore.spearman_pairs(panel(spark, folder), _PAIRS, {"all": "true", "normal": PANEL.normal})
    return rounded(out, 6, "spearman_r")


_NUM = PM + ["returned", "first_line"]


@query("spearman_matrix", f"""WITH {PANEL_SQL}, r AS (SELECT """ + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM) + """ FROM panel),
  p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, round(corr({a}, {b}), 4) AS spearman_r FROM r"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1:]) + """)
  SELECT *, abs(spearman_r) AS absolute_r FROM p WHERE spearman_r IS NOT NULL""")
def spearman_matrix(spark, folder):
    return explore.spearman_matrix(panel(spark, folder), _NUM)


@query("topn_pairs", f"""WITH {PANEL_SQL}, r AS (SELECT """ + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM) + """ FROM panel),
  p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, round(corr({a}, {b}), 4) AS spearman_r FROM r"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1:]) + """)
  SELECT *, abs(spearman_r) AS absolute_r FROM p
  WHERE variable_1 NOT IN ('returned', 'first_line') AND variable_2 NOT IN ('returned', 'first_line')
  ORDER BY absolute_r DESC, variable_1, variable_2 LIMIT 4""")
def topn_pairs(spark, folder):
    pairs = explore.process_pairs(explore.spearman_matrix(panel(spark, folder), _NUM), ["returned", "first_line"])
    return explore.top_n(pairs, [F.desc("absolute_r"), F.col("variable_1"), F.col("variable_2")], 4)


_CATS, _OUTS = ["o_orderstatus", "o_orderpriority"], ["c_mktsegment", "c_nationkey"]


@query("cramers_v", "WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS category, '{b}' AS outcome, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM j GROUP BY ALL"
    for a in _CATS for b in _OUTS) + """),
  t AS (SELECT *, sum(o) OVER (PARTITION BY category, outcome, a) AS r, sum(o) OVER (PARTITION BY category, outcome, b) AS k FROM c)
  SELECT category, outcome, round(sqrt((sum(o * 1.0 / r * o / k) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS cramers_v
  FROM t GROUP BY 1, 2""")
def cramers_v(spark, folder):
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(explore.cramers_v(joined, _CATS, _OUTS), 6, "cramers_v")


@query("histogram_32", f"""WITH {PANEL_SQL}, l AS ({union_sql('panel', 'is_normal', ['quantity', 'price'])}),
  e AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM l GROUP BY 1),
  b AS (SELECT l."column", least(CAST(floor((value - lo) / (hi - lo) * 32) AS INT), 31) AS bin,
    count(*) FILTER (is_normal) AS normal_rows, count(*) FILTER (NOT is_normal) AS other_rows FROM l JOIN e USING ("column") GROUP BY 1, 2)
  SELECT e."column", CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 32), 8) AS edge,
    coalesce(normal_rows, 0) AS normal_rows, coalesce(other_rows, 0) AS other_rows
  FROM e CROSS JOIN range(32) g(i) LEFT JOIN b ON b."column" = e."column" AND b.bin = i""")
def histogram_32(spark, folder):
    return explore.histogram(panel(spark, folder), ["quantity", "price"], PANEL.normal, digits=8)


@query("analysis_scope", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{'categorical_association_or_excluded' if c in ('l_returnflag', 'l_linestatus', 'l_shipdate') else 'numeric_spearman'}')"
    for c in _COLS) + """) v("column", analysis_type) WHERE EXISTS (SELECT 1 FROM lineitem)""")
def analysis_scope(spark, folder):
    df = table(spark, folder, "lineitem").select(*_COLS)
    numeric = quality.numeric_columns(df, [c for c in _COLS if c != "l_shipdate"])
    return quality.analysis_scope(df, numeric)


# ------------------------------------------------------------------ loading

RAW_KINDS = {"shot_id": "bigint", "ts": "timestamp_ntz", "value": "double", "k": "double"}


def raw_shots(spark, folder):
    """The events as text, as a file would hold them; every 97th time, 89th number and 101st machine is spoilt."""
    n = F.col("event_id")
    return table(spark, folder, "events").select(
        n.cast("string").alias("shot_id"),
        F.when(n % 97 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"),
        F.when(n % 101 != 0, F.concat(F.lit("M"), (F.col("user_id") % 4).cast("string"))).alias("machine"),
        F.col("event_type").alias("ng_code"),
        F.when(n % 89 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.get_json_object("props", "$.k").alias("k"),
    )


RAW_ROLES = Roles("machine", (), "ts", ("shot_id",), ("value", "k"), normal="ng_code NOT IN ('error', 'signup') and value is not null")


@query("fact_load", f"""WITH {SHOTS_SQL}, r AS (SELECT *, shot_id % 97 = 0 AS bad_time, shot_id % 101 = 0 AS no_machine, shot_id % 89 = 0 AS bad_value FROM shots)
  SELECT shot_id, ts, machine, ng_code, CASE WHEN NOT bad_value THEN value END AS value, k, round(CASE WHEN NOT bad_value THEN value END * k / 100, 8) AS load,
    is_normal AND NOT bad_value AND value IS NOT NULL AS is_normal FROM r WHERE NOT bad_time AND NOT no_machine""")
def fact_load(spark, folder):
    loaded = load(raw_shots(spark, folder), RAW_ROLES, RAW_KINDS, features=lambda df: df.withColumn("load", F.round(F.col("value") * F.col("k") / 100, 8)))
    return loaded.fact


@query("fact_rejects", """WITH r AS (SELECT event_id % 97 = 0 AS t, event_id % 101 = 0 AS m, event_id % 89 = 0 AS v FROM events)
  SELECT reason, count(*) AS n_rows, count(*) FILTER (t OR m) AS n_rejected FROM (
    SELECT 'ts: unreadable' AS reason, * FROM r WHERE t UNION ALL SELECT 'machine: missing', * FROM r WHERE m UNION ALL SELECT 'value: unreadable', * FROM r WHERE v) GROUP BY 1""")
def fact_rejects(spark, folder):
    return load(raw_shots(spark, folder), RAW_ROLES, RAW_KINDS).report
