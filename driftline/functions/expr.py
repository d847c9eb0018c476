"""Column expressions: features, predicates, risk zones and health scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftline.schema import ALARM_BAND, EFFECT_MIN, HIGH, LOW, TREND_ALPHA, ZERO_EPS, Limits

# Urgency of the evidence tiers, most urgent first.
TIERS = ("T1", "T2", "T3", "T4", "M1")
# Wording of a risky direction -> direction name.
DIRECTION_WORDS = {"아래로 내려가면 위험": LOW, "위로 올라가면 위험": HIGH}
# Trend class -> direction.
TREND_DIRECTION = {
    "candidate_upward_drift": "up",
    "candidate_downward_drift": "down",
    "no_trend": "flat",
    "mixed": "flat",
}


def no_nan(c: Column | str) -> Column:
    """NaN as null, so that the SQL null rules apply to it."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), col)


def without_nan(df: DataFrame) -> DataFrame:
    """All floating columns with NaN as null. Spark orders NaN above every number, so a raw one would exceed each limit."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: no_nan(F.col(f"`{c}`")) for c in floating}) if floating else df


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is (nearly) zero."""
    return F.when(F.abs(den) > ZERO_EPS, num / den)


def row_std(columns: Sequence[str]) -> Column:
    """Sample standard deviation across columns of one row; nulls are skipped."""
    cols = [F.col(c) for c in columns]
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / F.nullif(n, F.lit(0))
    ss = sum((F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 1, F.sqrt(ss / F.nullif(n - 1, F.lit(0))))


def exceedance(value: Column, low: Column, high: Column) -> Column:
    """Distance outside [low, high]; zero inside, null if either limit is unknown."""
    over = F.when((value - high).isNotNull(), F.greatest(value - high, F.lit(0.0)))
    under = F.when((low - value).isNotNull(), F.greatest(low - value, F.lit(0.0)))
    return over + under


def in_zone(value: Column, threshold: Column, direction: Column, inclusive: bool = False) -> Column:
    """Inside the risky side of a threshold; null without a threshold.

    Rates use the strict form, alerts the inclusive one. A null value is outside, and so is NaN.
    """
    value = no_nan(value.cast("double"))
    low = value <= threshold if inclusive else value < threshold
    high = value >= threshold if inclusive else value > threshold
    return (
        F.when(threshold.isNull(), F.lit(None).cast("boolean"))
        .when(direction == LOW, F.coalesce(low, F.lit(False)))
        .when(direction == HIGH, F.coalesce(high, F.lit(False)))
    )


def zone_from_range(value: Column, threshold: Column, risky_range: Column) -> Column:
    """Risky side read from a range text ``lo~hi``: low side if lo is below the threshold."""
    value = no_nan(value.cast("double"))
    lo = F.split_part(risky_range, F.lit("~"), F.lit(1)).try_cast("double")
    return F.when(lo < threshold, value <= threshold).otherwise(value >= threshold)


def out_of_spec(value: Column, limit: Limits) -> Column:
    """Outside the limits; a null value counts as inside, and so does NaN."""
    value = no_nan(value.cast("double"))
    return F.coalesce((value < limit.lsl) | (value > limit.usl), F.lit(False))


def pure_label(label: str, others: Sequence[str]) -> Column:
    """The label is set and no other label is."""
    rest = sum((F.col(c) for c in others), F.lit(0))
    return (F.col(label) == 1) & (rest == 0)


def margin_to_health(margin: Column) -> Column:
    """Health 0..100 from the used margin in percent.

    Linear from 100 at margin 0 to the alarm band at 100 %; beyond it band*100/margin,
    which joins without a step, keeps falling and never reaches 0. The tail is our own
    choice: only its properties are given.
    """
    used = F.greatest(margin, F.lit(0.0))
    linear = F.lit(100.0) - used * ((100.0 - ALARM_BAND) / 100.0)
    return F.when(margin.isNull(), F.lit(None).cast("double")).when(used <= 100, linear).otherwise(
        F.lit(ALARM_BAND * 100.0) / used
    )


def spec_margin(value: Column, direction: Column, lsl: Column, target: Column, usl: Column) -> Column:
    """Used share of the limit width in percent on the risky side.

    A side without width gives null, and so does a value that lies on such a side.
    """
    up = F.when(usl > target, F.greatest((value - target) / (usl - target), F.lit(0.0)) * 100)
    down = F.when(target > lsl, F.greatest((target - value) / (target - lsl), F.lit(0.0)) * 100)
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(direction == "up", up)
        .when(direction == "down", down)
        .otherwise(F.when(value >= target, up).otherwise(down))
    )


def tier_rank(tier: Column) -> Column:
    """1 for the most urgent tier; unknown tiers come last."""
    out = F.when(tier == TIERS[0], 1)
    for i, name in enumerate(TIERS[1:], start=2):
        out = out.when(tier == name, i)
    return out.otherwise(len(TIERS) + 1)


def direction_from_words(words: Column) -> Column:
    out = None
    for text, name in DIRECTION_WORDS.items():
        test = F.trim(words) == text
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def factor_direction(risky: Column) -> Column:
    """up / down / either; a factor without a known direction is watched both ways."""
    return F.when(risky == HIGH, "up").when(risky == LOW, "down").otherwise("either")


def trend_direction(trend_class: Column) -> Column:
    out = None
    for name, direction in TREND_DIRECTION.items():
        out = F.when(trend_class == name, direction) if out is None else out.when(trend_class == name, direction)
    return out


def effect_verdict(delta: Column, p_fdr: Column, expected: Column) -> tuple[Column, Column]:
    """(direction agrees with the expectation, effect is significant and large enough)."""
    agrees = F.signum(delta) == F.when(expected == "down", -1.0).otherwise(1.0)
    passes = (p_fdr < TREND_ALPHA) & (F.abs(delta) >= EFFECT_MIN)
    return agrees, F.coalesce(passes, F.lit(False))


def alert_strength(days: Column, eta_days: Column | None = None, full_days: float = 14.0) -> Column:
    """Strength 0..1 from the days an alert has lasted and, if known, the days left."""
    lasted = F.least(F.lit(1.0), days / full_days)
    if eta_days is None:
        return lasted
    left = F.when(eta_days > 0, F.least(F.lit(1.0), full_days / eta_days)).when(eta_days <= 0, 1.0)
    return F.greatest(lasted, left)


def text_prefix(parts: Mapping[str, Column] | Sequence[Column]) -> Column:
    """Non-empty texts joined by a blank, in the given order."""
    cols = list(parts.values()) if isinstance(parts, Mapping) else list(parts)
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols])
