"""Column roles and fixed parameters shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Limits:
    """Lower limit, target and upper limit of one measure."""

    lsl: float
    target: float
    usl: float


def stratum_key(columns: Sequence[str]) -> Column:
    """Values of the columns joined by ``|``: null if one is null, and a ``|`` inside a value is escaped, so that
    different strata never share a name."""
    parts = [F.regexp_replace(F.col(c).cast("string"), r"([|\\])", r"\\$1") for c in columns]
    known = [F.col(c).isNotNull() for c in columns]
    whole = known[0] if known else F.lit(True)
    for k in known[1:]:
        whole = whole & k
    return F.when(whole, F.concat_ws("|", *parts))


@dataclass(frozen=True)
class Roles:
    """Which columns of a fact table play which part.

    ``normal`` and ``ok`` are two SQL predicates on purpose: the strict one feeds the
    stratum statistics, the looser one the typed baselines and the entry rates.
    """

    entity: str
    stratum: tuple[str, ...]
    time: str
    key: tuple[str, ...]
    measures: tuple[str, ...]
    labels: tuple[str, ...] = ()
    normal: str = "true"
    ok: str = "true"
    limits: dict[str, Limits] = field(default_factory=dict)

    @property
    def series(self) -> tuple[str, ...]:
        """Keys of one ordered sequence: the entity within a stratum."""
        return (self.entity, *self.stratum)

    @property
    def order(self) -> tuple[str, ...]:
        """Time, then the key as tie-break, so that the order is total."""
        return (self.time, *self.key)

    def group_key(self) -> Column:
        """The composite stratum name ``product|recipe``."""
        return stratum_key(self.stratum)


# Limits of the detectors.
ROLLING_ROWS = 10
PERSIST_ROWS = 5
CUSUM_K = 0.7
CUSUM_H = 4.5
SPEC_RUN_EXPECTED_MAX = 0.01
TREND_ALPHA = 0.05
MIN_STABLE_DAYS = 14
MIN_LEAF = 10
MIN_LABELS_FOR_MONITORED = 1080
MAD_SCALE = 1.4826
FLATLINE_RUN = 5
CV_STABLE = 0.02
CV_VARIABLE = 0.10
DISPERSION_STABLE = 0.5
DISPERSION_VARIABLE = 2.0
ALARM_BAND = 10.0
ALERT_THRESHOLD = 30.0
RECENT_DAYS = 14
ACTIVE_WITHIN_DAYS = 1
EFFECT_MIN = 0.2
ZERO_EPS = 1e-9
LOW, HIGH = "low_is_risky", "high_is_risky"


def limits_frame(spark: SparkSession, limits: dict[str, Limits]) -> DataFrame:
    """The limit table: one row per measure that has limits."""
    rows = [(c, float(v.lsl), float(v.target), float(v.usl)) for c, v in limits.items()]
    return spark.createDataFrame(rows, "column string, lsl double, target double, usl double")


def require_columns(df: DataFrame, needed: set[str]) -> bool:
    """True if an optional table has every column it needs."""
    return needed <= set(df.columns)
