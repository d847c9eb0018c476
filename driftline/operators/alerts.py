"""Early-warning rows: typed detectors over ordered sequences in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions import expr, messages as text
from driftline.operators import sequence
from driftline.operators.detectors import warnings_of_series
from driftline.operators.ordered import BLOCK, RN, Ordered, group_row_limit
from driftline.operators.spec import UpperLimit, breach_days, day_table, spec_rules
from driftline.schema import CUSUM_H, CUSUM_K, LOW, PERSIST_ROWS, ROLLING_ROWS, Roles
from driftline.store import join_null_safe, lookup, together, written


@dataclass(frozen=True)
class References:
    """Learned tables and the type of each measure.

    ``types``: measure -> A/B/C/E (others are only described). ``rises_is_bad``: type A.
    """

    stats: DataFrame
    types: Mapping[str, str]
    ab: DataFrame | None = None
    thresholds: DataFrame | None = None
    constants: DataFrame | None = None
    rises_is_bad: Mapping[str, bool] = field(default_factory=dict)
    upper: Mapping[str, UpperLimit] = field(default_factory=dict)


_VARIANT = ["column", "label"]


def reference_rows(df: DataFrame, refs: References, roles: Roles, days: DataFrame | None = None) -> DataFrame:
    """What is watched in each stratum: one line per (stratum, measure, label).

    A type C measure has one line per threshold of its group, or one unlabelled line if
    there is none. ``base`` is the normal value, ``target`` and ``sd`` scale the cumulative
    sum, ``run`` is the number of limit violations in a row that cannot be chance.
    """
    null = F.lit(None)
    listed = []
    for i, m in enumerate(roles.measures):
        limit, upper = roles.limits.get(m), refs.upper.get(m)
        listed.append(
            F.struct(
                F.lit(i).alias("idx"), F.lit(m).alias("column"), F.lit(refs.types.get(m, "NONE")).alias("type"),
                F.lit(refs.rises_is_bad.get(m)).cast("boolean").alias("rises"),
                (F.lit(float(limit.lsl)) if limit else null.cast("double")).alias("lsl"),
                (F.lit(float(limit.usl)) if limit else null.cast("double")).alias("usl"),
                F.lit(text.number_text(limit.lsl) if limit else "").alias("lsl_text"),
                F.lit(text.number_text(limit.usl) if limit else "").alias("usl_text"),
                (F.lit(float(upper.limit)) if upper else null.cast("double")).alias("upper"),
                F.lit(text.number_text(upper.limit) if upper else "").alias("upper_text"),
                F.lit(" / ".join(text.RELATED % d for d in upper.labels) if upper else "").alias("related"),
            )
        )
    strata = (df if days is None else days).select(*roles.stratum).distinct()
    grid = strata.select(*roles.stratum, roles.group_key().alias("group_key"), F.inline(F.array(*listed)))
    grid = join_null_safe(
        grid, refs.stats.select(*roles.stratum, "column", "std", "median"), [*roles.stratum, "column"]
    )
    spark = df.sparkSession
    ab = refs.ab if refs.ab is not None else spark.createDataFrame(
        [], "group_key string, column string, type string, baseline_value double")
    c = refs.thresholds if refs.thresholds is not None else spark.createDataFrame(
        [], "group_key string, column string, label string, threshold double, direction string")
    e = refs.constants if refs.constants is not None else spark.createDataFrame(
        [], "column string, baseline_value double, reference_ok_mean double, reference_ok_std double")
    joined = (
        grid.join(ab.select("group_key", "column", "type", F.col("baseline_value").alias("ab")), ["group_key", "column", "type"], "left")
        .join(c.select("group_key", "column", F.lit("C").alias("type"), "label", "threshold", "direction"),
              ["group_key", "column", "type"], "left")
        .join(e.select("column", F.lit("E").alias("type"), F.col("baseline_value").alias("theory"),
                       "reference_ok_mean", "reference_ok_std"), ["column", "type"], "left")
    )
    if any(m in roles.limits for m in roles.measures):
        rules = F.broadcast(spec_rules(df, roles, days).select("column", "rate", "run"))  # one row per limited measure
        joined = joined.join(rules, "column", "left")
    else:
        joined = joined.withColumn("rate", null.cast("double")).withColumn("run", null.cast("int"))
    kind = F.col("type")
    base = F.when(kind.isin("A", "B"), F.col("ab")).when(kind == "C", F.col("median")).when(kind == "E", F.col("theory"))
    own = F.when(kind == "E", F.nullif(F.col("reference_ok_std"), F.lit(0.0)))
    return joined.select(
        *roles.stratum, "idx", "column", F.coalesce("label", F.lit("")).alias("label"), "type", "rises",
        base.alias("base"), F.coalesce("reference_ok_mean", base).alias("target"),
        F.coalesce(own, "std").alias("sd"), "threshold", "direction", "lsl", "usl", "rate", "run", "upper",
        "lsl_text", "usl_text", "upper_text", "related",
    )


_WATCH = ("idx", "column", "label", "type", "rises", "target", "sd", "threshold", "direction", "lsl", "usl", "run", "upper")


def watched_wide(
    df: DataFrame, table: DataFrame, roles: Roles, limit: int | None, sizes: tuple[int, int] | None = None
) -> Ordered:
    """The fact as one ordered sequence per (entity, stratum): all measures in ``_all``, what watches them in ``_watch``."""
    extra = [c for c in ("_over_days",) if c in df.columns]
    wide = Ordered.of(
        df.select(*roles.series, *roles.order, *extra, F.array(*[F.col(m).cast("double") for m in roles.measures]).alias("_all")),
        roles.series, roles.order, limit, fact=df, sizes=sizes,
    )
    return wide.with_df(join_null_safe(wide.df, lookup(_watching(table, roles)), roles.stratum))


def _watching(table: DataFrame, roles: Roles) -> DataFrame:
    return table.groupBy(*roles.stratum).agg(F.collect_list(F.struct(*_WATCH)).alias("_watch"))


def watched_sequences(
    df: DataFrame, table: DataFrame, roles: Roles, limit: int | None, sizes: tuple[int, int] | None = None
) -> Ordered:
    """The fact as one ordered sequence per (entity, stratum, measure, label).

    The rows are shuffled while they are wide and become long afterwards, inside their
    partition: the windows over (series, measure, label) need no further shuffle, the plan
    does not grow with the number of measures, and neither does the shuffle by copies of
    the keys.
    """
    return watched_long(watched_wide(df, table, roles, limit, sizes), roles)


def watched_long(wide: Ordered, roles: Roles) -> Ordered:
    extra = [c for c in ("_over_days",) if c in wide.df.columns]
    place = [BLOCK] if wide.blocked else []
    long = wide.df.select(*roles.series, *roles.order, RN, *place, *extra, "_all", F.inline("_watch"))
    value = F.get("_all", F.col("idx"))
    scored = long.select(
        *roles.series, *roles.order, RN, *place, *extra, *_VARIANT, "type", "rises", "direction", "run",
        value.alias("value"),
        F.when(F.col("sd") > 0, (value - F.col("target")) / F.col("sd")).alias("z"),
        F.when(F.col("run").isNotNull(), F.coalesce((value < F.col("lsl")) | (value > F.col("usl")), F.lit(False))).alias("out"),
        F.coalesce(expr.in_zone(value, F.col("threshold"), F.col("direction"), True), F.lit(False)).alias("_zone"),
        F.coalesce(value > F.col("upper"), F.lit(False)).alias("_above"),
    )
    return Ordered(scored, (*roles.series, *_VARIANT), (RN,), wide.blocked, wide.limit)


def _breached(df: DataFrame, refs: References, roles: Roles, days: DataFrame) -> DataFrame:
    """(entity, day) -> externally limited measures with a breach that day."""
    breached = breach_days(df, roles, refs.upper, days=days).filter("breach")
    return breached.groupBy(roles.entity, "dt").agg(F.collect_set("column").alias("_over_days"))


def _series_sizes(per_day: DataFrame, roles: Roles) -> tuple[int, int]:
    """Rows of the fact and of its largest series."""
    sums = per_day.groupBy(*roles.series).agg(F.sum("_rows").alias("n"))
    row = sums.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    return int(row["total"] or 0), int(row["largest"] or 0)


def alert_rows(
    df: DataFrame,
    refs: References,
    roles: Roles,
    k: float = CUSUM_K,
    h: float = CUSUM_H,
    *,
    limit: int | None = None,
    with_messages: bool = True,
) -> DataFrame:
    """One row per (row, measure, label) that carries an early warning.

    One shuffle of the wide fact serves all measures and labels. A series of up to ``limit`` rows is gone through once, in
    batches; a longer one is cut into blocks. NaN counts as missing, and rows whose stratum is not fully known belong to
    no series.
    """
    df = expr.without_nan(df).dropna(subset=list(roles.stratum))
    # one aggregate of the fact, then independent small tables, whose jobs run side by side
    per_day = written(day_table(df, roles, refs.upper))
    table, days, sizes = together(
        df.sparkSession,
        lambda: lookup(reference_rows(df, refs, roles, per_day)),
        lambda: lookup(_breached(df, refs, roles, per_day)) if refs.upper else None,
        lambda: _series_sizes(per_day, roles),
    )
    fact = df
    if refs.upper:
        fact = join_null_safe(df.withColumn("dt", F.to_date(roles.time)), days, [roles.entity, "dt"])
    limit = limit or group_row_limit(df.sparkSession)
    if sizes[1] <= limit:
        series = per_day.select(*roles.series).distinct()
        over = {m: F.array_contains("_over_days", m) for m in refs.upper}
        hits = warnings_of_series(fact, series, _watching(table, roles), roles, over, k, h)
    else:
        hits = _warnings_of_blocks(fact, table, refs, roles, k, h, limit, sizes)
    full = join_null_safe(hits, table.drop("idx"), [*roles.stratum, *_VARIANT])
    return full.select(*roles.key, roles.time, *roles.series, *_output(roles, h, with_messages))


def _warnings_of_blocks(
    fact: DataFrame, table: DataFrame, refs: References, roles: Roles, k: float, h: float, limit: int, sizes: tuple[int, int]
) -> DataFrame:
    """The rows with a warning of series that are cut into blocks: the state of the blocks is carried over by windows."""
    # a task holds the rows of a series once per line that watches them
    lines = table.groupBy(*roles.stratum).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    rows = max(limit // lines, 2 * ROLLING_ROWS)
    seq = watched_sequences(fact, table, roles, rows, sizes)
    seq = sequence.rolling(seq, ["value"])
    seq = sequence.cusum(seq, ["z"], [k])

    ready = F.col(RN) >= ROLLING_ROWS
    seq = seq.select((ready & F.col("_zone")).alias("_risk"))
    seq = sequence.sustained(seq, {"spec_hit": ("out", F.col("run")), "entry": ("_risk", PERSIST_ROWS)})
    over = F.col("_above") & F.coalesce(F.array_contains("_over_days", F.col("column")), F.lit(False)) if refs.upper else F.lit(False)
    seq = seq.select(_typed_signal(h).alias("typed"), F.coalesce("spec_hit", F.lit(False)).alias("_spec"), over.alias("_limit"))
    seq = seq.select((ready & (F.col("typed") | F.col("_spec") | F.col("_limit"))).alias("warn"))
    seq = sequence.episodes(seq, {"episode_id": "warn"})
    return seq.df.filter("warn").drop("type", "rises", "direction", "run")


def _sides(h: float) -> tuple[Column, Column]:
    return F.col("z__up") > h, F.col("z__dn") < -h


def _typed_signal(h: float) -> Column:
    """Does the detector of the row's type fire?"""
    up, down = _sides(h)
    kind = F.col("type")
    risky = F.when(F.col("direction") == LOW, down).otherwise(up)
    fires = (
        F.when(kind == "A", F.when(F.col("rises"), up).otherwise(down))
        .when(kind.isin("B", "E"), up | down)
        .when((kind == "C") & (F.col("label") != ""), F.col("entry") | risky)
    )
    return F.coalesce(fires, F.lit(False))


def _output(roles: Roles, h: float, with_messages: bool) -> list[Column]:
    up, down = _sides(h)
    kind, base, mean, slope = (F.col(c) for c in ("type", "base", "value__mean", "value__slope"))
    sd = F.coalesce(F.nullif(F.col("value__std"), F.lit(0.0)), F.nullif(F.col("sd"), F.lit(0.0)))
    deviation = (
        F.when(sd.isNotNull(), (mean - base) / sd)
        .when(base != 0, F.try_divide(mean - base, F.abs(base)))
        .otherwise(mean - base)
    )
    direction = (
        F.when(F.col("typed") & (kind == "A"), F.when(F.col("rises"), "up").otherwise("down"))
        .when(F.col("typed") & (kind == "C"), F.when(F.col("direction") == LOW, "down").otherwise("up"))
        .when(F.col("typed"), F.when(up, "up").otherwise("down"))
        .when(slope > 0, "up").when(slope < 0, "down").otherwise("flat")
    )
    fields = [
        F.col("column"), kind, F.col("label").alias("matched_label"),
        base.alias("baseline"), F.col("threshold"),
        F.col("lsl").alias("spec_lsl"), F.col("usl").alias("spec_usl"),
        F.when(F.col("lsl").isNull(), "").when(F.col("out"), "OUT_OF_SPEC").otherwise("OK").alias("spec_status"),
        F.col("value").alias("current_value"),
        mean.alias("rolling_mean"), F.col("value__std").alias("rolling_std"),
        F.col("value__diff").alias("difference"), slope.alias("slope"),
        deviation.alias("normalized_deviation"), direction.alias("trend_direction"),
        F.col("_spec").alias("spec_violation_warning"), F.col("_limit").alias("external_limit_warning"),
        F.col("warn").alias("early_warning"), F.col("episode_id"),
        F.col("typed").alias("typed_warning"),
        ((kind == "C") & (F.col("label") != "") & F.col("entry")).alias("entry_warning"),
    ]
    return [*fields, _message(roles, up).alias("message")] if with_messages else fields


def _message(roles: Roles, up: Column) -> Column:
    kind, low = F.col("type"), F.col("direction") == LOW
    who = [F.col(c) for c in (*roles.series, "column")]
    rises = F.when(F.col("rises"), text.RISE).otherwise(text.FALL)
    side = F.when(up, text.ABOVE).otherwise(text.BELOW)
    risk_side = F.when(low, text.BELOW).otherwise(text.ABOVE)
    base, target = F.col("base"), F.col("target")
    theory = F.when(F.abs(base - target) > 1e-9, text.formatted(text.THEORY, base)).otherwise("")
    typed = (
        F.when(~F.col("typed"), "")
        .when(kind == "A", text.formatted(text.DRIFT_ONE_SIDED, *who, rises))
        .when(kind == "B", text.formatted(text.DRIFT_TWO_SIDED, *who, side))
        .when((kind == "C") & F.col("entry"), text.formatted(text.ENTERED, *who, F.col("threshold")))
        .when(kind == "C", text.formatted(text.DRIFT_TO_RISK, *who, risk_side))
        .otherwise(text.formatted(text.OFF_NORMAL, *who, target, theory))
    )
    spec = F.when(
        F.col("_spec"),
        text.formatted(text.SPEC_RUN, *who, F.col("lsl_text"), F.col("usl_text"), F.col("run"), F.col("value"), F.col("rate") * 100),
    ).otherwise("")
    over = F.when(
        F.col("_limit"),
        text.formatted(text.OVER_LIMIT, F.col(roles.entity), F.col("column"), F.col("upper_text"), F.col("value"), F.col("related")),
    ).otherwise("")
    return text.compose(over, spec, typed)


def warning_rates(alerts: DataFrame) -> DataFrame:
    """Out-of-spec share among alert rows of measures that have limits."""
    checked = F.col("spec_status").isin("OK", "OUT_OF_SPEC")
    outside = F.count_if(F.col("spec_status") == "OUT_OF_SPEC")
    return alerts.agg(
        F.count(F.lit(1)).alias("alert_rows"),
        F.count_if("spec_violation_warning").alias("spec_alerts"),
        F.count_if(checked).alias("checked_rows"),
        outside.alias("out_of_spec_rows"),
        F.try_divide(outside, F.count_if(checked)).alias("out_of_spec_share"),
    )
