"""Row-ordered operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.catalog.baselines import shot_stats, stats_sql
from driftline.catalog.bindings import SHOTS, SHOTS_SQL, shots
from driftline.catalog.registry import day_text, query, rounded, union_sql
from driftline.operators import sequence
from driftline.operators.baseline import per_stratum
from driftline.operators.ordered import Ordered
from driftline.schema import CUSUM_H, CUSUM_K
from driftline.store import join_null_safe, lookup, work_folder, written
from driftline.streaming import live

SM = list(SHOTS.measures)
_P = "PARTITION BY machine, product, recipe ORDER BY ts, shot_id"


def series(df, fact=None):
    return Ordered.of(df, SHOTS.series, SHOTS.order, fact=fact)


@query("rolling10", f"""WITH {SHOTS_SQL}, n AS (SELECT *, row_number() OVER ({_P}) AS rn FROM shots),
  r AS (SELECT shot_id, rn, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, value - lag(value, 9) OVER ({_P}) AS d,
    regr_slope(value, rn) OVER w AS b FROM n WINDOW w AS ({_P} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT shot_id, round(m, 6) AS rolling_mean, round(s, 6) AS rolling_std, round(d, 6) AS difference, round(b, 6) AS slope FROM r WHERE rn >= 10""")
def rolling10(spark, folder):
    seq = sequence.rolling(series(shots(spark, folder)), ["value"])
    return seq.df.filter("_rn >= 10").select(
        "shot_id", F.round("value__mean", 6).alias("rolling_mean"), F.round("value__std", 6).alias("rolling_std"),
        F.round("value__diff", 6).alias("difference"), F.round("value__slope", 6).alias("slope"),
    )


@query("rolling_min2_delta", f"""WITH {SHOTS_SQL}, r AS (SELECT shot_id, count(value) OVER w AS c, avg(value) OVER w AS m,
    stddev_samp(value) OVER w AS s, value - lag(value) OVER (PARTITION BY machine ORDER BY ts, shot_id) AS d
    FROM shots WINDOW w AS (PARTITION BY machine ORDER BY ts, shot_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT shot_id, CASE WHEN c >= 2 THEN round(m, 6) END AS value_roll5_mean, CASE WHEN c >= 2 THEN round(s, 6) END AS value_roll5_std,
    round(d, 6) AS value_delta FROM r""")
def rolling_min2_delta(spark, folder):
    seq = Ordered.of(shots(spark, folder), ["machine"], SHOTS.order)
    out = sequence.rolling_with_minimum(seq, ["value"]).df.select("shot_id", "value_roll5_mean", "value_roll5_std", "value_delta")
    return rounded(out, 6, "value_roll5_mean", "value_roll5_std", "value_delta")


@query("sustained_first", f"""WITH {SHOTS_SQL}, f AS (SELECT *, row_number() OVER ({_P}) AS rn, CASE WHEN value > 30 THEN 1 ELSE 0 END AS hot FROM shots),
  s AS (SELECT *, sum(hot) OVER ({_P} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AND rn >= 5 AS state FROM f),
  e AS (SELECT *, state AND NOT coalesce(lag(state) OVER ({_P}), false) AS event FROM s)
  SELECT machine, product, recipe, shot_id, state, event FROM e WHERE state""")
def sustained_first(spark, folder):
    seq = series(shots(spark, folder).withColumn("hot", F.col("value") > 30))
    seq = sequence.sustained_state(sequence.sustained(seq, {"event": ("hot", 5)}), {"state": ("hot", 5)})
    return seq.df.filter("state").select("machine", "product", "recipe", "shot_id", "state", "event")


CUSUM_SQL = f"""{stats_sql('shots', 'product, recipe', ['value', 'load'])},
 cz AS (SELECT l.*, (value - median) / std AS z, row_number() OVER (PARTITION BY machine, product, recipe, "column" ORDER BY ts, shot_id) AS rn
   FROM ({union_sql('shots', 'shot_id, ts, machine, product, recipe', ['value', 'load'])}) l JOIN st USING (product, recipe, "column")),
 cp AS (SELECT *, sum(z - {CUSUM_K}) OVER w AS p, sum(z + {CUSUM_K}) OVER w AS q FROM cz
   WINDOW w AS (PARTITION BY machine, product, recipe, "column" ORDER BY rn)),
 cs AS (SELECT *, p - least(0, min(p) OVER w) AS up, q - greatest(0, max(q) OVER w) AS dn FROM cp
   WINDOW w AS (PARTITION BY machine, product, recipe, "column" ORDER BY rn))"""


def scored_shots(df, measures):
    table = lookup(per_stratum(shot_stats(df), SHOTS.stratum, measures, ["median", "std"]))
    joined = join_null_safe(df, table, SHOTS.stratum)
    return joined.select("*", *[((F.col(m) - F.col(f"{m}__median")) / F.col(f"{m}__std")).alias(f"{m}_z") for m in measures])


def _cusum_long(spark, folder):
    df = shots(spark, folder)
    seq = series(scored_shots(df, ["value", "load"]), fact=df)
    seq = sequence.cusum(seq, ["value_z", "load_z"], [CUSUM_K])
    return seq


@query("cusum", f"""WITH {SHOTS_SQL}, {CUSUM_SQL} SELECT shot_id, "column", round(up, 6) AS s_up, round(dn, 6) AS s_dn FROM cs""")
def cusum(spark, folder):
    seq = _cusum_long(spark, folder)
    cells = [
        F.struct(F.lit(m).alias("column"), F.round(f"{m}_z__up", 6).alias("s_up"), F.round(f"{m}_z__dn", 6).alias("s_dn"))
        for m in ("value", "load")
    ]
    return seq.df.select("shot_id", F.inline(F.array(*cells)))


EPISODE_SQL = f"""{CUSUM_SQL}, ce AS (SELECT *, up > {CUSUM_H} OR dn < -{CUSUM_H} AS warn FROM cs),
 cg AS (SELECT *, CASE WHEN warn AND NOT coalesce(lag(warn) OVER (PARTITION BY machine, product, recipe, "column" ORDER BY rn), false)
   THEN 1 ELSE 0 END AS edge FROM ce),
 ep AS (SELECT *, sum(edge) OVER (PARTITION BY machine, product, recipe, "column" ORDER BY rn) AS episode FROM cg)"""


def episode_rows(spark, folder):
    seq = _cusum_long(spark, folder)
    tests = {m: (F.col(f"{m}_z__up") > CUSUM_H) | (F.col(f"{m}_z__dn") < -CUSUM_H) for m in ("value", "load")}
    seq = seq.select(*[t.alias(f"{m}_warn") for m, t in tests.items()])
    seq = sequence.episodes(seq, {f"{m}_ep": f"{m}_warn" for m in tests})
    cells = [F.struct(F.lit(m).alias("column"), F.col(f"{m}_warn").alias("warn"), F.col(f"{m}_ep").alias("episode")) for m in tests]
    rows = seq.df.select("machine", "product", "recipe", "shot_id", "ts", F.inline(F.array(*cells)))
    return rows.filter("warn").drop("warn")


@query("episodes", f"""WITH {SHOTS_SQL}, {EPISODE_SQL} SELECT machine, product, recipe, "column", CAST(episode AS BIGINT) AS episode,
  count(*) AS n_rows, min(ts) AS start_ts, max(ts) AS end_ts FROM ep WHERE warn GROUP BY ALL""")
def episodes(spark, folder):
    return episode_rows(spark, folder).groupBy("machine", "product", "recipe", "column", "episode").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )


GAP_SQL = f"""{EPISODE_SQL}, gw AS (SELECT machine, "column", ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh
   FROM ep WHERE warn WINDOW w AS (PARTITION BY machine, "column" ORDER BY ts)),
 gr AS (SELECT *, sum(fresh) OVER (PARTITION BY machine, "column" ORDER BY ts) AS session FROM gw),
 gs AS (SELECT machine, "column", CAST(session AS BIGINT) AS session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM gr GROUP BY ALL)"""


@query("gap_sessions", f"""WITH {SHOTS_SQL}, {GAP_SQL} SELECT *, round(epoch_us(end_ts) / 86400000000.0 - epoch_us(start_ts) / 86400000000.0, 6) AS days FROM gs""")
def gap_sessions(spark, folder):
    return rounded(sequence.gap_sessions(episode_rows(spark, folder), ["machine", "column"], "ts"), 6, "days")


@query("longest_run", f"""WITH {SHOTS_SQL}, {GAP_SQL}, d AS (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 86400000000.0 AS days FROM gs),
  o AS (SELECT *, row_number() OVER (PARTITION BY machine, "column" ORDER BY days DESC, session) AS i FROM d)
  SELECT machine, "column", CAST(CAST(start_ts AS DATE) AS VARCHAR) AS detected_day, round(days, 6) AS days, n_rows FROM o WHERE i = 1""")
def longest_run(spark, folder):
    keys = ["machine", "column"]
    sessions = sequence.gap_sessions(episode_rows(spark, folder), keys, "ts")
    return day_text(rounded(sequence.longest_session(sessions, keys), 6, "days"), "detected_day")


# ------------------------------------------------------------------ streams

_END = "~end"  # a last row far in the future, so that the watermark closes everything before it


def replayed(spark, rows, make, files: int, part):
    """Rows as a bounded stream of ``files`` files, one a batch, through ``make`` into Parquet files, and those read back.

    ``part``: the file of a row. Keys named ``_END`` only move the watermark and are dropped.
    """
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    split = written(rows.withColumn("_file", part))
    for i in range(files):
        split.where(F.col("_file") == i).drop("_file").coalesce(1).write.parquet(f"{base}/in/{i}")
    ending = rows.agg(F.max("ts").alias("ts")).selectExpr(*[
        "ts + interval 1000 days as ts" if c == "ts" else f"ts as {c}" if c == "since" else f"'{_END}' as `{c}`" for c in rows.columns])
    ending.coalesce(1).write.parquet(f"{base}/in/{files}")
    stream = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*"))
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").where(F.col("machine") != _END)


def _plain_times(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("stream_sessions", f"WITH {SHOTS_SQL}, {GAP_SQL} SELECT machine, \"column\", start_ts, end_ts, n_rows FROM gs")
def stream_sessions(spark, folder):
    """The rows come out of order: each file holds rows of the whole period."""
    rows = episode_rows(spark, folder).select("machine", "column", F.col("ts").cast("timestamp").alias("ts"))
    out = replayed(spark, rows, lambda s: live.live_sessions(s, "machine", "ts", late="400 days"), 5, F.pmod(F.xxhash64("ts"), F.lit(5)))
    return _plain_times(out, "start_ts", "end_ts")


@query("stream_notices", f"""WITH RECURSIVE {SHOTS_SQL}, {GAP_SQL},
  ac AS (SELECT gr.machine, gr."column", start_ts AS since, ts FROM gr JOIN gs USING (machine, "column", session)),
  no AS (SELECT machine, "column", since, min(ts) AS ts FROM ac GROUP BY ALL
    UNION ALL SELECT no.machine, no."column", no.since, min(ac.ts) FROM no JOIN ac ON ac.machine = no.machine AND ac."column" = no."column"
      AND ac.since = no.since AND ac.ts >= no.ts + INTERVAL 2 DAY GROUP BY no.machine, no."column", no.since)
  SELECT * FROM no""")
def stream_notices(spark, folder):
    """The files follow each other in time, as a running job sees them; a notice every two days of an alert."""
    rows = written(episode_rows(spark, folder).select("machine", "column", "ts"))
    sessions = sequence.gap_sessions(rows, ["machine", "column"], "ts").select("machine", "column", F.col("start_ts").alias("since"), "end_ts")
    active = rows.join(sessions, ["machine", "column"]).where("ts between since and end_ts")
    active = active.select("machine", "column", F.col("since").cast("timestamp").alias("since"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = rows.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    width = max(((last - first).days + 1) / 5, 1)
    part = F.least(F.floor(F.datediff(F.to_date("ts"), F.lit(first)) / width), F.lit(4))
    out = replayed(spark, active, lambda s: live.paced_notifications(s, "machine", "ts", "2 days"), 5, part)
    return _plain_times(out, "since", "ts")
