"""Row-ordered detectors on (entity, stratum) sequences.

All measures of a row are handled in the same window pass, so a sequence is shuffled and
sorted once, not once per measure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.operators.ordered import BLOCK, RN, Ordered
from driftline.schema import FLATLINE_RUN, ROLLING_ROWS, Roles
from driftline.store import join_null_safe, lookup


def rolling(seq: Ordered, measures: Sequence[str], rows: int = ROLLING_ROWS) -> Ordered:
    """Mean, sample std, last-first difference and slope over the last ``rows`` rows.

    ``<m>__mean``, ``__std``, ``__diff``, ``__slope``; null until the window is full or
    while it holds a null. The window is short, so its values come as lags and the
    statistics are plain expressions on them, which is cheaper than sliding aggregates.
    """
    lagged = seq.with_lookback(
        rows - 1, lambda w: {f"_{m}_lag{j}": F.lag(m, j).over(w) for m in measures for j in range(1, rows)}
    )
    mid = (rows - 1) / 2.0
    weight = sum((i - mid) ** 2 for i in range(rows))
    means, out = [], []
    for m in measures:
        # oldest first
        values = [F.col(f"_{m}_lag{j}") for j in range(rows - 1, 0, -1)] + [F.col(m)]
        total = values[0]
        for v in values[1:]:
            total = total + v
        means.append((total / rows).alias(f"{m}__mean"))
        mean, square, lean = F.col(f"{m}__mean"), F.lit(0.0), F.lit(0.0)
        for i, v in enumerate(values):
            square = square + (v - mean) * (v - mean)
            lean = lean + (v - mean) * (i - mid)
        out += [
            F.sqrt(square / (rows - 1)).alias(f"{m}__std"),
            F.when(mean.isNotNull(), values[-1] - values[0]).alias(f"{m}__diff"),
            (lean / weight).alias(f"{m}__slope"),
        ]
    done = lagged.df.select("*", *means).select("*", *out)
    return seq.with_df(done.drop(*[f"_{m}_lag{j}" for m in measures for j in range(1, rows)]))


def rolling_with_minimum(seq: Ordered, measures: Sequence[str], rows: int = 5, min_rows: int = 2) -> Ordered:
    """Rolling mean and std that start at ``min_rows`` values, and the step to the previous row."""

    def make(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        out = {}
        for m in measures:
            enough = F.count(m).over(frame) >= min_rows
            out[f"{m}_roll{rows}_mean"] = F.when(enough, F.avg(m).over(frame))
            out[f"{m}_roll{rows}_std"] = F.when(enough, F.stddev_samp(m).over(frame))
            out[f"{m}_delta"] = F.col(m) - F.lag(m).over(w)
        return out

    return seq.with_lookback(rows - 1, make)


def sustained(seq: Ordered, flags: Mapping[str, tuple[str, Column | int]]) -> Ordered:
    """Event on the row where a condition has held for exactly n rows in a row.

    ``flags`` maps the new boolean column to (condition column, n); n may be a column, so
    one pass serves measures with different required runs.
    """
    ran = seq.with_run_position({f"_pos_{name}": cond for name, (cond, _) in flags.items()})
    events = {
        name: F.col(f"_pos_{name}") == (n if isinstance(n, Column) else F.lit(n))
        for name, (_, n) in flags.items()
    }
    done = ran.df.select("*", *[c.alias(k) for k, c in events.items()])
    return ran.with_df(done.drop(*[f"_pos_{name}" for name in flags]))


def sustained_state(seq: Ordered, flags: Mapping[str, tuple[str, int]]) -> Ordered:
    """True on every row whose last n rows all meet the condition."""
    ran = seq.with_run_position({f"_pos_{name}": cond for name, (cond, _) in flags.items()})
    done = ran.df.select("*", *[(F.col(f"_pos_{n}") >= k).alias(n) for n, (_, k) in flags.items()])
    return ran.with_df(done.drop(*[f"_pos_{name}" for name in flags]))


def _name(z: str, k: float, side: str) -> str:
    return f"{z}__{side}" if k is None else f"{z}__{side}_{str(k).replace('.', '_')}"


def cusum(seq: Ordered, scores: Sequence[str], ks: Sequence[float], suffix: bool = False) -> Ordered:
    """Two-sided tabular cumulative sums of score columns, for one or many allowances.

    Adds ``<score>__up`` (>= 0) and ``<score>__dn`` (<= 0), with a ``_<k>`` suffix when
    ``suffix`` is set. A null score resets both sums.

    With P the running sum of (z - k), the upper sum is P minus its smallest value since
    the last reset, so the row recurrence needs only running sums and running minima. All
    allowances share the running sum and count of the scores.
    """
    base = seq.select(
        *[F.coalesce(F.col(z), F.lit(0.0)).alias(f"_v_{z}") for z in scores],
        *[F.col(z).isNotNull().cast("bigint").alias(f"_c_{z}") for z in scores],
        *[F.col(z).isNull().cast("bigint").alias(f"_x_{z}") for z in scores],
    )
    w = base.window()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = base.df.select(
        "*",
        *[F.sum(f"_{p}_{z}").over(upto).alias(f"_S{p}_{z}") for z in scores for p in "vcx"],
    )
    extremes = []
    for z in scores:
        segment = -F.col(f"_Sx_{z}")
        for k in ks:
            up, dn = _drifted(z, -k), _drifted(z, k)
            extremes += [
                F.min(F.struct(segment.alias("g"), up.alias("p"))).over(upto).alias(f"_lo_{_name(z, k, 'up')}"),
                F.min(F.struct(segment.alias("g"), (-dn).alias("p"))).over(upto).alias(f"_lo_{_name(z, k, 'dn')}"),
            ]
    local = sums.select("*", *extremes)
    found = []
    for z in scores:
        first = F.col(f"_Sx_{z}") == 0
        for k in ks:
            for side, drift in (("up", _drifted(z, -k)), ("dn", -_drifted(z, k))):
                low = F.col(f"_lo_{_name(z, k, side)}.p")
                low = F.when(first, F.least(low, F.lit(0.0))).otherwise(low)
                found.append((drift - low).alias(f"_s_{_name(z, k, side)}"))
    inner = seq.with_df(local.select("*", *found).drop(*[f"_lo_{_name(z, k, s)}" for z in scores for k in ks for s in ("up", "dn")]))
    if seq.blocked:
        inner = _carry(inner, scores, ks)
    final = []
    for z in scores:
        for k in ks:
            tag = k if suffix else None
            final.append(F.col(f"_s_{_name(z, k, 'up')}").alias(_name(z, tag, "up")))
            final.append((-F.col(f"_s_{_name(z, k, 'dn')}")).alias(_name(z, tag, "dn")))
    kept = seq.df.columns
    return seq.with_df(inner.df.select(*kept, *final))


def _drifted(z: str, k: float) -> Column:
    """Running sum of (z + k) over the rows that have a score."""
    return F.col(f"_Sv_{z}") + F.lit(float(k)) * F.col(f"_Sc_{z}")


def _carry(inner: Ordered, scores: Sequence[str], ks: Sequence[float]) -> Ordered:
    """Bring the sums of earlier blocks into each block.

    A block without a reset maps an incoming sum s to max(b, s + a), with a its total drift
    and b the sum it reaches from zero; a block with a reset ends at b whatever comes in.
    Chained over the blocks this is again a running sum with a running maximum.
    """
    part = [*inner.part, BLOCK]
    ends = inner.df.groupBy(*part).agg(
        *[F.max(f"_Sx_{z}").alias(f"_x_{z}") for z in scores],
        *[F.max_by(f"_S{p}_{z}", RN).alias(f"_S{p}_{z}") for z in scores for p in "vc"],
        *[
            F.max_by(f"_s_{_name(z, k, s)}", RN).alias(f"_b_{_name(z, k, s)}")
            for z in scores for k in ks for s in ("up", "dn")
        ],
    )
    w = Window.partitionBy(*inner.part).orderBy(BLOCK)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    names = [(z, k, s) for z in scores for k in ks for s in ("up", "dn")]
    for z in scores:
        ends = ends.withColumn(f"_g_{z}", F.sum((F.col(f"_x_{z}") > 0).cast("bigint")).over(upto))
    totals = []
    for z, k, s in names:
        drift = _drifted(z, -k) if s == "up" else -_drifted(z, k)
        totals.append(F.sum(F.when(F.col(f"_x_{z}") > 0, 0.0).otherwise(drift)).over(upto).alias(f"_A_{_name(z, k, s)}"))
    ends = ends.select("*", *totals)
    best = [
        F.max(F.struct(F.col(f"_g_{z}").alias("g"), (F.col(f"_b_{_name(z, k, s)}") - F.col(f"_A_{_name(z, k, s)}")).alias("m")))
        .over(upto).alias(f"_M_{_name(z, k, s)}")
        for z, k, s in names
    ]
    ends = ends.select("*", *best)
    out = [
        F.lag(F.col(f"_A_{_name(z, k, s)}") + F.col(f"_M_{_name(z, k, s)}.m"), 1, 0.0).over(w).alias(f"_in_{_name(z, k, s)}")
        for z, k, s in names
    ]
    incoming = lookup(ends.select(*part, *out))
    joined = join_null_safe(inner.df, incoming, part)
    merged = []
    for z, k, s in names:
        drift = _drifted(z, -k) if s == "up" else -_drifted(z, k)
        here = F.col(f"_s_{_name(z, k, s)}")
        merged.append(
            F.when(F.col(f"_Sx_{z}") > 0, here)
            .otherwise(F.greatest(here, F.col(f"_in_{_name(z, k, s)}") + drift))
            .alias(f"_s_{_name(z, k, s)}")
        )
    kept = [c for c in inner.df.columns if not c.startswith("_s_")]
    return inner.with_df(joined.select(*kept, *merged))


def episodes(seq: Ordered, flags: Mapping[str, str]) -> Ordered:
    """Episode number of every row: runs of true flags so far. ``flags``: new column -> flag."""
    edged = seq.with_lookback(
        1,
        lambda w: {
            f"_edge_{name}": (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("bigint")
            for name, flag in flags.items()
        },
    )
    counted = edged.with_running({name: ("sum", f"_edge_{name}") for name in flags})
    return counted.with_df(counted.df.drop(*[f"_edge_{name}" for name in flags]))


def flatline_counts(df: DataFrame, roles: Roles, min_run: int = FLATLINE_RUN, limit: int | None = None) -> DataFrame:
    """Rows that belong to runs of at least ``min_run`` equal values, per measure.

    A null equals nothing, so it is a run of its own.
    """
    seq = Ordered.of(df.select(roles.entity, *roles.order, *roles.measures), [roles.entity], roles.order, limit)
    marked = seq.with_lookback(
        1, lambda w: {f"_e_{m}": F.coalesce(F.col(m) == F.lag(m).over(w), F.lit(False)) for m in roles.measures}
    )
    placed = marked.with_run_position({f"_at_{m}": f"_e_{m}" for m in roles.measures}).df
    # the row that completes a run of min_run counts all of it, every later one itself: nothing is grouped by run
    cells = []
    for m in roles.measures:
        at = F.col(f"_at_{m}") + 1
        rows = F.sum(F.when(at == min_run, min_run).when(at > min_run, 1).otherwise(0))
        cells.append(F.struct(F.lit(m).alias("column"), rows.alias("flatline_count"), F.max(at).alias("longest_run")))
    return placed.agg(F.array(*cells).alias("c")).select(F.inline("c")).filter("longest_run is not null")


def gap_sessions(rows: DataFrame, keys: Sequence[str], time: str, gap_days: int = 1) -> DataFrame:
    """Sessions of rows per key; a new one starts when the gap exceeds ``gap_days``.

    Rows of the same calendar day are never further apart than a day, so the rows are first
    folded to one line per key and day. Only that table, bounded by the calendar, is ordered.
    """
    day = rows.groupBy(*keys, F.to_date(time).alias("dt")).agg(
        F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).alias("n_rows")
    )
    return sessions_of_days(day, keys, gap_days)


def sessions_of_days(day: DataFrame, keys: Sequence[str], gap_days: int = 1) -> DataFrame:
    """Sessions from one line per key and day: dt, first_ts, last_ts, n_rows."""
    w = Window.partitionBy(*keys).orderBy("dt")
    far = F.col("first_ts") > F.lag("last_ts").over(w) + F.expr(f"INTERVAL {int(gap_days)} DAY")
    marked = day.withColumn("_new", F.coalesce(far, F.lit(False)).cast("int"))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(
        F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts"), F.sum("n_rows").alias("n_rows")
    ).withColumn("days", days_between("start_ts", "end_ts"))


def days_between(start: str, end: str) -> Column:
    """Fractional days from start to end."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(86_400_000_000.0)


def longest_session(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest session per key; its start day is when the change counts as detected."""
    best = F.max_by(F.struct("start_ts", "days", "n_rows"), F.struct("days", (-F.col("session")).alias("s")))
    return sessions.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.to_date("_b.start_ts").alias("detected_day"), "_b.days", "_b.n_rows"
    )
