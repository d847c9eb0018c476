"""Relation tables: which measure is watched for which label, and how."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from driftline.functions import expr
from driftline.schema import require_columns
from driftline.store import lookup

# Fixed value: the reproducibility verdict that admits a pair.
PASSED = "통과"


def adopted_pairs(interface: DataFrame, tiers: DataFrame) -> DataFrame | None:
    """Every interface pair with its verdict; None if a table lacks a needed column."""
    if not require_columns(interface, {"factor", "defect", "alert_usable"}):
        return None
    if not require_columns(tiers, {"factor", "defect", "repro_state", "watch_mode"}):
        return None
    left = interface.select("factor", "defect", "alert_usable")
    right = tiers.select("factor", "defect", "repro_state", "watch_mode")
    usable = F.lower(F.col("alert_usable").cast("string")) == "true"
    passed = F.trim("repro_state") == PASSED
    return left.join(right, ["factor", "defect"], "left").withColumn(
        "adopted", F.coalesce(usable & passed, F.lit(False))
    )


def resolved_pairs(detail: DataFrame, verified: DataFrame, alarm_only: DataFrame) -> DataFrame:
    """Adopted pairs, then verified and alarm-only pairs of factors that have no pair yet.

    ``verified`` and ``alarm_only`` have factor, defect. A factor the relation tables have
    decided on gets nothing added.
    """
    base = detail.filter("adopted").select("factor", "defect", F.lit("relation").alias("origin"))
    more = verified.join(base.select("factor").distinct(), "factor", "left_anti").select(
        "factor", "defect", F.lit("verified").alias("origin")
    )
    two = base.unionByName(more)
    last = alarm_only.join(two.select("factor").distinct(), "factor", "left_anti").select(
        "factor", "defect", F.lit("alarm_only").alias("origin")
    )
    return two.unionByName(last)


def pairing_in_use(
    interface: DataFrame | None, tiers: DataFrame | None, fallback: DataFrame, verified: DataFrame, alarm_only: DataFrame
) -> DataFrame:
    """factor, defect, origin of the pairs a plan works with.

    The relation tables decide. If one is absent or lacks a needed column, the fallback pairs stand alone; otherwise
    verified and alarm-only pairs are added for factors the relation tables say nothing about.
    """
    detail = None if interface is None or tiers is None else adopted_pairs(interface, tiers)
    if detail is None:
        return fallback.select("factor", "defect", F.lit("fallback").alias("origin"))
    return resolved_pairs(detail, verified, alarm_only)


def pairing_lists(pairs: DataFrame) -> DataFrame:
    """Labels of each factor as a list, and whether there is more than one."""
    return pairs.groupBy("factor").agg(F.array_sort(F.collect_list("defect")).alias("defects")).withColumn(
        "multi", F.size("defects") > 1
    )


def known_directions(interface: DataFrame) -> DataFrame:
    """(column, label, direction) for pairs whose direction wording is known."""
    if not require_columns(interface, {"factor", "defect", "threshold_direction"}):
        return interface.sparkSession.createDataFrame([], "column string, label string, direction string")
    return interface.select(
        F.col("factor").alias("column"), F.col("defect").alias("label"),
        expr.direction_from_words(F.col("threshold_direction")).alias("direction"),
    ).filter("direction is not null")


def usable_defects(factors: DataFrame, pair_flags: DataFrame) -> DataFrame:
    """Pairs that may alert: the pair's own flag, else the factor's, else yes.

    ``factors``: factor, defect, factor_usable. ``pair_flags``: factor, defect, pair_usable.
    """
    joined = factors.join(pair_flags, ["factor", "defect"], "left")
    return joined.filter(F.coalesce("pair_usable", "factor_usable", F.lit(True))).select("factor", "defect")


def scored_defects(usable: DataFrame, verified: DataFrame | None) -> DataFrame:
    """Usable pairs that count for the entity score; all of them without a tier table."""
    return usable if verified is None else usable.join(verified, ["factor", "defect"], "left_semi")


def most_urgent(pairs: DataFrame) -> DataFrame:
    """The pair of the most urgent tier per factor; names break ties, not row order."""
    rank = expr.tier_rank(F.col("tier"))
    return pairs.groupBy("factor").agg(
        F.min_by(F.struct("defect", "tier"), F.struct(rank.alias("r"), "defect")).alias("b"),
        F.min(rank).alias("tier_rank"),
    ).select("factor", F.col("b.defect").alias("defect"), F.col("b.tier").alias("tier"), "tier_rank")


def directions_of(factors: DataFrame, known: DataFrame) -> DataFrame:
    """up / down / either per factor; ``known``: factor, direction name."""
    return factors.join(known, "factor", "left").select(
        "factor", expr.factor_direction(F.col("direction")).alias("watch_direction")
    )


def pair_survival(
    pairs: Sequence[tuple[str, str]], groups: DataFrame, thresholds: DataFrame, unfiltered: DataFrame, known: DataFrame
) -> DataFrame:
    """Why each (column, label, group) has or lacks a threshold.

    ``expected_missing`` rows have no stump or contradict the known direction; an
    ``unexplained`` row means a pair was lost on the way, a ``duplicate`` one that it was
    learned twice.
    """
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("label")) for c, d in pairs])
    grid = groups.select("group_key").distinct().select("group_key", F.inline(listed))
    learned = thresholds.groupBy("column", "label", "group_key").agg(F.count(F.lit(1)).alias("n"))
    raw = unfiltered.select("column", "label", "group_key", "direction")
    rule = known.select("column", "label", F.col("direction").alias("known"))
    joined = (
        grid.join(learned, ["column", "label", "group_key"], "left")
        .join(raw, ["column", "label", "group_key"], "left")
        .join(lookup(rule), ["column", "label"], "left")
    )
    excluded = F.col("direction").isNull() | F.coalesce(F.col("known") != F.col("direction"), F.lit(False))
    return joined.select(
        "column", "label", "group_key",
        F.when(F.col("n") > 1, "duplicate")
        .when(F.col("n") == 1, "learned")
        .when(excluded, "expected_missing")
        .otherwise("unexplained").alias("state"),
    )


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key tuples of the left table that the right one lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def same_set(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """True if both tables hold the same key tuples."""
    return set_difference(left, right, keys).isEmpty() and set_difference(right, left, keys).isEmpty()
