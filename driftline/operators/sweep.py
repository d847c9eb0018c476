"""Parameter sweeps of the cumulative sums from one table of days, and how stable the chosen allowance is.

How far a row's sum reaches beyond the grid of limits is one small number, so rows fold at once to a line per allowance,
series, day and number of limits passed. The alerts of a limit are the lines that pass at least as many, and a subset of
the strata, of the measures or of the period is again a subset of these lines; the fact is not read a second time.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from driftline.operators import sequence
from driftline.operators.alerts import References, reference_rows, watched_long, watched_wide
from driftline.operators.detectors import lowest
from driftline.operators.ordered import RN, Ordered
from driftline.operators.sequence import longest_session, sessions_of_days
from driftline.schema import CUSUM_H, CUSUM_K, LOW, RECENT_DAYS, ROLLING_ROWS, Roles
from driftline.store import lookup, written


def sweep_days(
    df: DataFrame, refs: References, roles: Roles, ks: Sequence[float], hs: Sequence[float], *, limit: int | None = None
) -> DataFrame:
    """(k, series, column, dt, passed) -> rows, first and last time of the rows whose sum passes so many of the limits."""
    table = lookup(reference_rows(df, refs, roles).filter("type <> 'NONE'"))
    wide = watched_wide(df, table, roles, limit)
    lines = _lines_of_blocks(wide, roles, ks, hs) if wide.blocked else _lines_of_series(wide, roles, ks, hs)
    return lines.groupBy("k", *roles.series, "column", "dt", "passed").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def _lines_of_blocks(wide: Ordered, roles: Roles, ks: Sequence[float], hs: Sequence[float]) -> DataFrame:
    """Lines of series that are cut into blocks: the sums of the blocks are carried over by windows."""
    seq = sequence.cusum(watched_long(wide, roles), ["z"], ks, suffix=True)
    kind, cells = F.col("type"), []
    for k in ks:
        tag = str(k).replace(".", "_")
        up, dn = F.col(f"z__up_{tag}"), -F.col(f"z__dn_{tag}")
        reach = (
            F.when(kind == "A", F.when(F.col("rises"), up).otherwise(dn))
            .when(kind.isin("B", "E"), F.greatest(up, dn))
            .when(F.col("label") != "", F.when(F.col("direction") == LOW, dn).otherwise(up))
        )
        passed = F.when(reach > float(max(hs)), len(hs))
        for i, h in reversed(list(enumerate(sorted(hs)))):
            passed = passed.when(reach > float(h), i + 1)
        cells.append(F.struct(F.lit(float(k)).alias("k"), passed.otherwise(0).alias("passed")))
    ready = seq.df.filter(F.col(RN) >= ROLLING_ROWS)
    rows = ready.select(*roles.series, "column", roles.time, F.inline(F.array(*cells))).filter("passed > 0")
    return rows.groupBy("k", *roles.series, "column", F.to_date(roles.time).alias("dt"), "passed").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(roles.time).alias("first_ts"), F.max(roles.time).alias("last_ts"))


def _lines_of_series(wide: Ordered, roles: Roles, ks: Sequence[float], hs: Sequence[float]) -> DataFrame:
    """Lines of whole series: a task goes once through the rows of a series and keeps a few lines a day."""
    series, grid = list(roles.series), np.sort(np.asarray(hs, float))
    rows = wide.df.select(
        *series, RN, F.col(roles.time).alias("_time"), F.to_date(roles.time).alias("dt"), "_all", F.when(F.col(RN) == 1, F.col("_watch")).alias("_watch"))
    named = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {named[c]}" for c in series), "column string", "dt date", "k double", "passed int", "n_rows bigint",
                        f"first_ts {named['_time']}", f"last_ts {named['_time']}"])

    def fold(rows: pa.Table) -> pa.Table:
        if not (np.diff(rows[RN].to_numpy()) > 0).all():
            rows = rows.sort_by(RN)
        place, values = rows[RN].to_numpy(), rows["_all"].combine_chunks()
        values = values.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        own = rows.select([*series, "dt", "_time"])
        found = []
        for line in rows["_watch"][0].as_py() or []:
            side = _side(line)
            if side is None or not line["sd"] or not line["sd"] > 0 or line["target"] is None:
                continue
            score = (values[:, line["idx"]] - line["target"]) / line["sd"]
            for k in ks:
                passed = np.searchsorted(grid, _reach(score, float(k), side), side="left").astype(np.int32)
                hit = np.flatnonzero((passed > 0) & (place >= ROLLING_ROWS))
                part = own.select(["dt", "_time"]).take(hit).append_column("passed", pa.array(passed[hit]))
                part = part.group_by(["dt", "passed"]).aggregate([("_time", "min"), ("_time", "max"), ([], "count_all")])
                found.append(part.append_column("column", pa.repeat(line["column"], len(part))).append_column("k", pa.repeat(float(k), len(part))))
        names = ["column", "dt", "k", "passed", "count_all", "_time_min", "_time_max"]
        empty = own.slice(0, 0).select(["dt", "_time"]).append_column("passed", pa.array([], pa.int32()))
        empty = empty.group_by(["dt", "passed"]).aggregate([("_time", "min"), ("_time", "max"), ([], "count_all")])
        empty = empty.append_column("column", pa.array([], pa.string())).append_column("k", pa.array([], pa.float64()))
        folded = pa.concat_tables([t.select(names) for t in (*found, empty)])
        keys = [pa.chunked_array([pa.repeat(own[c][0], len(folded))]) for c in series]
        return pa.table([*keys, *folded.columns], names=[*series, "column", "dt", "k", "passed", "n_rows", "first_ts", "last_ts"])

    return rows.groupBy(*series).applyInArrow(fold, schema)


def _side(line: Mapping) -> str | None:
    """Which sums a watching line looks at."""
    if line["type"] == "A":
        return "up" if line["rises"] else "dn"
    if line["type"] in ("B", "E"):
        return "both"
    return ("dn" if line["direction"] == LOW else "up") if line["label"] else None


def _reach(score: np.ndarray, k: float, side: str) -> np.ndarray:
    """The upper or lower cumulative sum of scores, or the larger one; a missing score (NaN) resets it."""
    there = ~np.isnan(score)
    total, n = np.cumsum(np.where(there, score, 0.0)), np.cumsum(there)
    sums = []
    for name, drift in (("up", total - k * n), ("dn", -(total + k * n))):
        if side in (name, "both"):
            sums.append(drift - lowest(drift, np.flatnonzero(~there)))
    return sums[0] if len(sums) == 1 else np.maximum(*sums)


def _folded(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    return days.groupBy(*keys, "dt").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def alert_days(days: DataFrame, keys: Sequence[str], hs: Sequence[float]) -> DataFrame:
    """(keys, h, dt) -> alert rows of every limit, summed from the farthest reach down."""
    grid = F.array(*[F.lit(float(h)) for h in sorted(hs)])
    return _folded(days.select("*", F.explode(F.slice(grid, F.lit(1), F.col("passed"))).alias("h")), [*keys, "h"])


def sweep_scores(
    days: DataFrame, roles: Roles, normal: str, hs: Sequence[float], onset: DataFrame | None = None, sustained_days: int = RECENT_DAYS
) -> DataFrame:
    """Per (k, h): alert rows, long sessions and longest session of the normal entity, and
    with ``onset`` (entity, column, onset_day) the detection lag of every known change."""
    return session_scores(sweep_sessions(days, roles, hs), roles, normal, onset, sustained_days)


def sweep_sessions(days: DataFrame, roles: Roles, hs: Sequence[float]) -> DataFrame:
    """Sessions of every (k, h, entity, column), written."""
    return written(sessions_of_days(alert_days(days, ["k", roles.entity, "column"], hs), ["k", "h", roles.entity, "column"]))


def session_scores(
    sessions: DataFrame, roles: Roles, normal: str, onset: DataFrame | None = None, sustained_days: int = RECENT_DAYS
) -> DataFrame:
    """``sweep_scores`` of sessions that are there already."""
    cell = ["k", "h"]
    keys = [*cell, roles.entity, "column"]
    is_normal = F.col(roles.entity) == normal
    score = sessions.groupBy(*cell).agg(
        F.sum("n_rows").alias("alert_rows"),
        F.count_if(is_normal & (F.col("days") >= sustained_days)).alias("normal_sustained"),
        F.coalesce(F.max(F.when(is_normal, F.col("days"))), F.lit(0.0)).alias("normal_longest"),
    )
    if onset is None:
        return score
    lags = longest_session(sessions, keys).join(onset, [roles.entity, "column"]).select(
        *cell, F.datediff("detected_day", "onset_day").alias("lag_days")
    )
    worst = lags.groupBy(*cell).agg(
        F.max("lag_days").alias("worst_lag"), F.min("lag_days").alias("earliest_lag"), F.count(F.lit(1)).alias("n_detected")
    )
    return score.join(worst, cell, "left")


def leave_one_out(
    days: DataFrame, roles: Roles, normal: str, hs: Sequence[float], onset: DataFrame, sustained_days: int = RECENT_DAYS,
    max_lag: int = 10, early_tolerance: int = -10, chosen: tuple[float, float] = (CUSUM_K, CUSUM_H),
) -> DataFrame:
    """For each entity with a known change left out of the judgement: passing cells, and whether the chosen one passes."""
    from driftline.operators.health import grid_verdicts

    out, sessions = None, sweep_sessions(days, roles, hs)
    for entity in sorted(r[0] for r in onset.select(roles.entity).distinct().collect()):  # entities with a known change
        rest = onset.filter(F.col(roles.entity) != entity)
        verdicts = grid_verdicts(session_scores(sessions, roles, normal, rest, sustained_days), rest.count(), max_lag, early_tolerance)
        here = (F.col("k") == chosen[0]) & (F.col("h") == chosen[1])
        fold = verdicts.agg(
            F.lit(entity).alias("left_out"), F.count_if(F.col("verdict") == "pass").alias("n_pass"),
            F.coalesce(F.bool_or(here & (F.col("verdict") == "pass")), F.lit(False)).alias("chosen_passes"))
        out = fold if out is None else out.unionAll(fold)
    return out


def stratum_subsets(names: Sequence[str], sizes: Sequence[int], most: int, seed: int = 0) -> list[tuple[str, int, str]]:
    """(subset, size, name) of all combinations of so many names; of more than ``most`` a seeded choice."""
    draw, out = random.Random(seed), []
    for size in sorted({s for s in (*sizes, len(names)) if 0 < s <= len(names)}):
        if math.comb(len(names), size) <= most:
            chosen = list(itertools.combinations(sorted(names), size))
        else:
            found: set[tuple[str, ...]] = set()
            while len(found) < most:
                found.add(tuple(sorted(draw.sample(sorted(names), size))))
            chosen = sorted(found)
        out += [("+".join(c), size, name) for c in chosen for name in c]
    return out


def boundary_stability(
    days: DataFrame, roles: Roles, normal: str, ks: Sequence[float], hs: Sequence[float], middle, *, h: float = CUSUM_H,
    sustained_days: int = RECENT_DAYS, sizes: Sequence[int] = (1, 2, 3, 4), most: int = 10,
) -> DataFrame:
    """Smallest k without a long alert of the normal entity, per subset: all, measures at odd and even places of their
    order, the days before ``middle`` and from it on, and combinations of the values of the first stratum column.

    kind, subset, size (of a combination, else 0), boundary_k; null if every k has a long alert.
    """
    spark, product = days.sparkSession, roles.stratum[0]
    place = sorted(hs).index(h) + 1
    mine = written(_folded(days.filter((F.col(roles.entity) == normal) & (F.col("passed") >= place)), ["k", product, "column"]))
    rank = lookup(mine.select("column").distinct().select("column", F.row_number().over(Window.orderBy("column")).alias("_place")))
    named = mine.join(rank, "column")
    kinds = {"all": F.lit(True), "odd_columns": F.col("_place") % 2 == 1, "even_columns": F.col("_place") % 2 == 0,
             "first_half": F.col("dt") < middle, "second_half": F.col("dt") >= middle}
    names = F.array(*[F.when(test, F.lit(n)) for n, test in kinds.items()])
    halves = named.withColumn("subset", F.explode(F.filter(names, lambda s: s.isNotNull())))
    products = [r[0] for r in mine.select(product).distinct().collect() if r[0] is not None]  # values of one stratum column
    table = spark.createDataFrame(stratum_subsets(products, sizes, most), f"subset string, size int, `{product}` string")
    combined = mine.join(table.drop("size"), product)
    keys = ["kind", "subset", "k", "column"]
    columns = [*keys, "dt", "n_rows", "first_ts", "last_ts"]
    rows = halves.withColumn("kind", F.lit("part")).select(*columns).unionAll(combined.withColumn("kind", F.lit("products")).select(*columns))
    sessions = sessions_of_days(_folded(rows, keys), keys)
    bad = sessions.filter(F.col("days") >= sustained_days).groupBy("kind", "subset").agg(F.collect_set("k").alias("bad"))
    every = spark.createDataFrame([("part", n, 0) for n in kinds], "kind string, subset string, size int").unionAll(
        table.select(F.lit("products").alias("kind"), "subset", "size").distinct())
    grid = F.array(*[F.lit(float(k)) for k in sorted(ks)])
    free = F.filter(grid, lambda k: ~F.array_contains(F.coalesce("bad", F.array().cast("array<double>")), k))
    return every.join(bad, ["kind", "subset"], "left").select("kind", "subset", "size", F.array_min(free).alias("boundary_k"))


def boundary_by_size(boundaries: DataFrame) -> DataFrame:
    """Number of subsets, median and range of the boundary per size of the combinations."""
    return boundaries.filter("kind = 'products'").groupBy("size").agg(
        F.count(F.lit(1)).alias("n_subsets"), F.median("boundary_k").alias("median_k"), F.min("boundary_k").alias("lowest_k"), F.max("boundary_k").alias("highest_k"))


def middle_day(df: DataFrame, time: str):
    """The day halfway between the first and the last one of a table, as a constant."""
    first, last = df.agg(F.min(F.to_date(time)), F.max(F.to_date(time))).first()
    return F.lit(first if first is None else first + (last - first) // 2)
