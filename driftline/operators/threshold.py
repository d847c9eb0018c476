"""Risk thresholds learned from labels: balanced one-split trees and their noise ceilings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.functions.expr import no_nan
from driftline.operators.ordered import group_row_limit, running
from driftline.operators.quantiles import unpivot, value_counts
from driftline.operators.shuffles import keys, permuted
from driftline.schema import HIGH, LOW, MIN_LABELS_FOR_MONITORED, MIN_LEAF, stratum_key
from driftline.store import lookup, written

#: Row positions of a group that one task marks at a time.
UNIT = 1 << 20


def label_counts(df: DataFrame, strata: Sequence[str], measures: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(group_key, column, value) -> rows and positives of every label.

    All labels share this table and the ordering of its values.
    """
    keyed = df.dropna(subset=list(strata)).withColumn("group_key", stratum_key(strata))
    long = unpivot(keyed, ["group_key", *labels], measures)
    return value_counts(
        long, ["group_key", "column"],
        [F.sum(F.coalesce(no_nan(F.col(d).cast("double")).cast("bigint"), F.lit(0))).alias(f"pos_{d}") for d in labels],
    )


def _balanced_score(n_left: Column, p_left: Column, n: Column, p: Column) -> Column:
    """Purity of a split when both classes weigh one half; larger is purer.

    Rounded so that splits which are equal up to float noise count as ties.
    """
    a, b = p_left / p * 0.5, (n_left - p_left) / (n - p) * 0.5
    c, d = F.lit(0.5) - a, F.lit(0.5) - b
    return F.round((a * a + b * b) / (a + b) + (c * c + d * d) / (c + d), 12)


def stump_thresholds(
    df: DataFrame,
    strata: Sequence[str],
    measures: Sequence[str],
    labels: Sequence[str],
    pairs: Sequence[tuple[str, str]] | None = None,
    *,
    min_leaf: int = MIN_LEAF,
    limit: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Best threshold per (group, column, label), with the label rate on both sides.

    An exact search: values are counted per group, running counts give both sides of every
    boundary, and the best score is kept by a map-side combinable arg-max. Equal scores go
    to the lowest threshold. A pair needs ``min_leaf`` positives and ``min_leaf`` rows on
    each side; otherwise there is no row. ``counts``: the written value counts, if the
    caller has them already.
    """
    part = ["group_key", "column"]
    counts = counts or written(label_counts(df, strata, measures, labels))
    sums = {"_nl": ("sum", "n"), "_prev": ("max", "value"), **{f"_pl_{d}": ("sum", f"pos_{d}") for d in labels}}
    totals = lookup(
        counts.groupBy(*part).agg(
            F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_values"),
            *[F.sum(f"pos_{d}").alias(f"_p_{d}") for d in labels],
        )
    )
    size = totals.agg(F.sum("_values").alias("total"), F.max("_values").alias("largest")).first()
    sizes = (size["total"] or 0, size["largest"] or 0)
    left = running(counts, part, ["value"], sums, inclusive=False, limit=limit, sizes=sizes)
    joined = left.filter("_prev is not null").join(totals.drop("_values"), part)
    # the values of a group lie in order here, so the best cut of every label is found without sorting or copying them
    cut = joined.withColumn("cut", (F.col("_prev") + F.col("value")) / 2)
    nl, n, listed = F.col("_nl"), F.col("_n"), None if pairs is None else set(pairs)
    found, cells = [], []
    for i, d in enumerate(labels):
        pl, p = F.col(f"_pl_{d}"), F.col(f"_p_{d}")
        usable = (p >= min_leaf) & (p < n) & (nl >= min_leaf) & (n - nl >= min_leaf)
        if listed is not None:
            usable = usable & F.col("column").isin([c for c, e in listed if e == d])
        best = F.struct("cut", "_nl", "_n", pl.alias("pl"), p.alias("p"))
        found.append(F.max_by(best, F.when(usable, F.struct(_balanced_score(nl, pl, n, p).alias("score"), (-F.col("cut")).alias("c")))).alias(f"_b{i}"))
        cells.append(F.struct(F.lit(d).alias("label"), F.col(f"_b{i}").alias("b")))
    best = cut.groupBy(*part).agg(*found).select(*part, F.inline(F.array(*cells))).filter("b is not null")
    below = F.col("b.pl") / F.col("b._nl")
    above = (F.col("b.p") - F.col("b.pl")) / (F.col("b._n") - F.col("b._nl"))
    return best.select(
        "column", "label", "group_key",
        F.round("b.cut", 5).alias("threshold"),
        F.col("b.p").alias("n_positive"),
        F.round(below, 5).alias("rate_below"),
        F.round(above, 5).alias("rate_above"),
        F.when(below > above, LOW).otherwise(HIGH).alias("direction"),
    )


def agreeing(thresholds: DataFrame, directions: DataFrame) -> DataFrame:
    """Drop groups whose learned direction contradicts the known one of the pair.

    Pairs without a known direction are kept as they are.
    """
    known = directions.select("column", "label", F.col("direction").alias("_known"))
    joined = thresholds.join(lookup(known), ["column", "label"], "left")
    return joined.filter("_known is null or _known = direction").drop("_known")


def contradicting_counts(thresholds: DataFrame, directions: DataFrame) -> DataFrame:
    """Groups per pair that ``agreeing`` drops."""
    known = directions.select("column", "label", F.col("direction").alias("_known"))
    return (
        thresholds.join(lookup(known), ["column", "label"])
        .groupBy("column", "label")
        .agg(F.count_if(F.col("direction") != F.col("_known")).alias("n_dropped"), F.count(F.lit(1)).alias("n_groups"))
    )


def with_separation(thresholds: DataFrame) -> DataFrame:
    """Ratio of the two side rates; null when one of them is zero."""
    low = F.least("rate_below", "rate_above")
    ratio = F.when(low > 0, F.greatest("rate_below", "rate_above") / low)
    return thresholds.withColumn("separation_ratio", ratio)


def routed_thresholds(
    monitored: DataFrame,
    training: DataFrame,
    strata: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    min_labels: int = MIN_LABELS_FOR_MONITORED,
) -> DataFrame:
    """Learn each pair from the monitored data if it has enough labels, else from the
    training data. One row of label counts decides the routes."""
    labels = sorted({d for _, d in pairs})
    counts = monitored.agg(*[F.sum(d).alias(d) for d in labels]).first()
    enough = {d for d in labels if (counts[d] or 0) >= min_labels}
    out = None
    for name, source, chosen in (
        ("monitored", monitored, [p for p in pairs if p[1] in enough]),
        ("training", training, [p for p in pairs if p[1] not in enough]),
    ):
        if not chosen:
            continue
        part = stump_thresholds(
            source, strata, sorted({c for c, _ in chosen}), sorted({d for _, d in chosen}), chosen
        ).withColumn("learned_from", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ noise ceilings

#: Up to so many cuts in a unit, the positives between two of them are counted piece by piece.
FEW_CUTS = 200
_CORNERS = (
    "group_key string, column string, unit bigint, label string, rep int, n_positive bigint, n bigint, p bigint, "
    "corners array<struct<n_left:bigint,p_left:bigint>>"
)
_CORNER_TYPES = pa.schema([
    *[(c, pa.string()) for c in ("group_key", "column")], ("unit", pa.int64()), ("label", pa.string()), ("rep", pa.int32()),
    *[(c, pa.int64()) for c in ("n_positive", "n", "p")], ("corners", pa.list_(pa.struct([("n_left", pa.int64()), ("p_left", pa.int64())]))),
])


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of points with growing x."""
    found, left = {0, len(x) - 1}, [(0, len(x) - 1, np.arange(1, len(x) - 1), side) for side in (1, -1)]
    while left:
        a, b, between, side = left.pop()
        away = side * ((x[b] - x[a]) * (y[between] - y[a]) - (y[b] - y[a]) * (x[between] - x[a]))
        outside = away > 0
        between, away = between[outside], away[outside]
        if len(between):
            top = int(between[np.argmax(away)])
            found.add(top)
            left += [(a, top, between[between < top], side), (top, b, between[between > top], side)]
    return np.array(sorted(found))


def _positives_before(mark: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Marked places before each of the growing cuts."""
    if len(cuts) <= FEW_CUTS:
        ends = [0, *cuts.tolist()]
        return np.cumsum([np.count_nonzero(mark[i:j]) for i, j in zip(ends, ends[1:])], dtype=np.int64)
    upto = np.zeros(len(mark) + 1, np.int32)
    np.cumsum(mark, dtype=np.int32, out=upto[1:])
    return upto[cuts].astype(np.int64)


def _unit_corners(rows: pa.Table, labels: Sequence[str], reps: int, seed: int, min_leaf: int, length: int) -> pa.Table:
    """Shuffled positives of one unit of row positions, and the cuts in it that can be the best, per replicate and label.

    The purity of a split is a convex function of the rows and the positives on its left, whatever lies before the unit,
    so only corners of the hull of these points can be the best of the unit: a few, and the unit is marked once.
    A shuffle gives every row the same chance, so ties of a value may stand in any order.
    """
    group, column, unit, total = (rows[c][0].as_py() for c in ("group_key", "column", "unit", "n_total"))
    begin, end = unit * length, min((unit + 1) * length, total)
    usable = {d: p for d in labels if min_leaf <= (p := rows[f"p_{d}"][0].as_py()) < total}
    cuts = np.sort(rows["n_before"].to_numpy())
    cuts = cuts[(cuts >= begin) & (cuts >= min_leaf) & (total - cuts >= min_leaf)]
    out = []
    for rep in range(reps if usable else 0):
        place = permuted(begin, end, total, keys(seed, group, column, rep))
        for d, positives in usable.items():
            mark, corners = place < positives, []
            if len(cuts):
                p_left = _positives_before(mark, cuts - begin)
                corners = [{"n_left": int(cuts[i]), "p_left": int(p_left[i])} for i in _corners(cuts, p_left)]
            out.append((group, column, unit, d, rep, int(np.count_nonzero(mark)), total, positives, corners))
    columns = zip(*out) if out else [[]] * len(_CORNER_TYPES)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _CORNER_TYPES)], schema=_CORNER_TYPES)


def shuffled_stumps(
    df: DataFrame,
    strata: Sequence[str],
    measures: Sequence[str],
    labels: Sequence[str],
    reps: int,
    seed: int = 0,
    *,
    min_leaf: int = MIN_LEAF,
    limit: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Best stump per (group, column, label, replicate) with labels shuffled in the group.

    The data is never multiplied by the replicates: the values are counted and ordered once, and their row positions are
    dealt out in units of bounded length, also where one value has very many rows. A task marks the positives of its unit
    by a keyed permutation, so the result depends on the seed alone. It returns the number of positives and the few cuts
    that can be the best one; what lies before a unit is added afterwards. One row per unit and replicate and label
    leaves a task.
    """
    part, names = ["group_key", "column"], list(labels)
    counts = counts or written(label_counts(df, strata, measures, labels))
    length = min(limit or group_row_limit(df.sparkSession), UNIT)
    totals = lookup(counts.groupBy(*part).agg(F.sum("n").alias("n_total"), *[F.sum(f"pos_{d}").alias(f"p_{d}") for d in names]))
    placed = running(counts.select(*part, "value", "n"), part, ["value"], {"_upto": ("sum", "n")}, limit=limit)
    placed = placed.select(*part, (F.col("_upto") - F.col("n")).alias("n_before"), "_upto")
    over = F.sequence(F.floor(F.col("n_before") / length), F.floor((F.col("_upto") - 1) / length))
    units = placed.select(*part, "n_before", F.explode(over).alias("unit")).join(totals, part)
    keyed = [*part, "unit"]
    # a unit is few bytes and much work, so small units must not be put together in one task
    dealt = units.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keyed)
    found = dealt.groupBy(*keyed).applyInArrow(lambda rows: _unit_corners(rows, names, reps, seed, min_leaf, length), _CORNERS)
    earlier = Window.partitionBy(*part, "label", "rep").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_positive").over(earlier), F.lit(0)).alias("before")
    cuts = found.select(*part, "label", "rep", "n", "p", before, "corners").select(*part, "label", "rep", "n", "p", "before", F.inline("corners"))
    cuts = cuts.withColumn("p_left", F.col("p_left") + F.col("before"))
    score = _balanced_score(*map(F.col, ("n_left", "p_left", "n", "p")))
    return cuts.groupBy(*part, "label", "rep").agg(
        F.max_by(F.struct("n_left", "p_left", "n", "p"), F.struct(score.alias("score"), (-F.col("n_left")).alias("c"))).alias("b")
    ).select(
        *part, "label", "rep",
        F.round(F.col("b.p_left") / F.col("b.n_left"), 5).alias("rate_below"),
        F.round((F.col("b.p") - F.col("b.p_left")) / (F.col("b.n") - F.col("b.n_left")), 5).alias("rate_above"),
        F.when(
            F.col("b.p_left") / F.col("b.n_left")
            > (F.col("b.p") - F.col("b.p_left")) / (F.col("b.n") - F.col("b.n_left")), LOW
        ).otherwise(HIGH).alias("direction"),
    )


def _fold_groups(stumps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median separation and share of the dominant direction over the groups."""
    kept = with_separation(stumps).filter("separation_ratio is not null")
    low = F.count_if(F.col("direction") == LOW)
    n = F.count(F.lit(1))
    extra = [F.median("threshold").alias("threshold_median")] if "threshold" in stumps.columns else []
    return kept.groupBy(*keys).agg(
        n.alias("n_groups_fitted"),
        F.median("separation_ratio").alias("separation"),
        (F.greatest(low, n - low) / n).alias("consistency"),
        F.when(low >= n - low, LOW).otherwise(HIGH).alias("dominant_direction"),
        *extra,
    )


def candidate_scan(
    df: DataFrame,
    strata: Sequence[str],
    measures: Sequence[str],
    labels: Sequence[str],
    assigned: Sequence[tuple[str, str]] = (),
    reps: int = 40,
    seed: int = 0,
    *,
    limit: int | None = None,
) -> DataFrame:
    """Every (label, column): observed separation against what shuffled labels produce.

    Two ceilings per label: the 95 % point over all columns and replicates, and the 95 %
    point of the per-replicate maximum, which holds for all columns together.
    """
    counts = written(label_counts(df, strata, measures, labels))
    shuffled = shuffled_stumps(df, strata, measures, labels, reps, seed, limit=limit, counts=counts)
    null = written(_fold_groups(shuffled, ["label", "column", "rep"]))
    single = null.groupBy("label").agg(F.percentile("separation", 0.95).alias("ceiling_p95"))
    joint = null.groupBy("label", "rep").agg(
        F.max("separation").alias("s"), F.max("consistency").alias("c")
    ).groupBy("label").agg(
        F.percentile("s", 0.95).alias("ceiling_fwer"), F.percentile("c", 0.95).alias("consistency_ceiling")
    )
    observed = stump_thresholds(df, strata, measures, labels, limit=limit, counts=counts)
    seen = _fold_groups(observed, ["label", "column"])
    pair = F.struct("column", "label")
    is_assigned = pair.isin(*[F.struct(F.lit(c), F.lit(d)) for c, d in assigned]) if assigned else F.lit(False)
    return seen.join(single, "label", "left").join(joint, "label", "left").select(
        "label", "column", "n_groups_fitted",
        F.round("separation", 3).alias("separation_ratio_median"),
        F.round("ceiling_p95", 3).alias("noise_ceiling_p95"),
        F.round("ceiling_fwer", 3).alias("noise_ceiling_fwer"),
        F.round("consistency_ceiling", 3).alias("consistency_ceiling_fwer"),
        F.round(F.try_divide("separation", "ceiling_p95"), 2).alias("signal_over_noise"),
        F.coalesce(F.col("separation") > F.col("ceiling_fwer"), F.lit(False)).alias("passes_fwer"),
        F.coalesce(F.col("consistency") > F.col("consistency_ceiling"), F.lit(False)).alias("passes_direction"),
        F.round("threshold_median", 5).alias("threshold_median"),
        "dominant_direction",
        F.round("consistency", 3).alias("direction_consistency"),
        is_assigned.alias("assigned"),
    )


def scan_findings(candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """Where the assignment and the scan disagree, in both directions, plus the agreements.

    ``assigned`` has column, label; an assigned pair without a scan row could not be fitted.
    """
    passes = F.col("passes_fwer") & F.col("passes_direction")
    judged = candidates.withColumn(
        "finding",
        F.when(F.col("assigned") & passes, "confirmed")
        .when(F.col("assigned"), "assigned_but_weak")
        .when(passes, "candidate_without_pair"),
    ).filter("finding is not null").select("column", "label", "finding")
    absent = assigned.join(candidates, ["column", "label"], "left_anti").select(
        "column", "label", F.lit("assigned_but_not_fitted").alias("finding")
    )
    return judged.unionByName(absent).withColumn(
        "severity", F.when(F.col("finding") == "confirmed", "info")
        .when(F.col("finding") == "candidate_without_pair", "candidate").otherwise("warning"),
    )


def finding_counts(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per label: how many of its pairs were confirmed, are weak, were not fitted, or are new candidates.

    Labels without any finding have zeros; ``n_scanned`` counts the columns that could be fitted.
    """
    of = lambda name: F.coalesce(F.count_if(F.col("finding") == name), F.lit(0))
    scanned = candidates.groupBy("label").agg(F.count(F.lit(1)).alias("n_scanned"))
    counted = findings.groupBy("label").agg(
        of("confirmed").alias("n_confirmed"), of("assigned_but_weak").alias("n_weak"),
        of("assigned_but_not_fitted").alias("n_not_fitted"), of("candidate_without_pair").alias("n_candidates"))
    joined = scanned.join(counted, "label", "full")
    out = joined.select("label", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in joined.columns if c != "label"])
    return out.withColumn("all_assigned_pass", (F.col("n_weak") == 0) & (F.col("n_not_fitted") == 0))
