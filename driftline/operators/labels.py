"""Label studies: risk ratios, rank effects and multiplicity control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.functions import expr
from driftline.functions.expr import no_nan
from driftline.functions.tails import normal_p_udf
from driftline.operators.quantiles import unpivot, value_counts
from driftline.operators.ordered import running
from driftline.schema import LOW, Roles
from driftline.store import join_null_safe, lookup, written


#: Measures whose zones are told apart in one row; more of them are counted in several rows.
MEASURES_A_ROW = 4


def risk_ratios(
    df: DataFrame, zones: DataFrame, roles: Roles, labels: Sequence[str], subsets: Mapping[str, str] | None = None
) -> DataFrame:
    """Label rate inside / outside the risk zone of each (column, label) pair.

    ``pure`` leaves out rows with another label on both sides, ``binary`` counts every row
    whose label is set. ``zones``: column, label, threshold, risky_range (``lo~hi``), one line per pair.
    ``subsets`` (name -> SQL predicate) gives the ratios of each part of the rows, in ``dataset``.

    One pass over the fact counts rows by their labels and by the zones they lie in; the pairs and
    the subsets are judged from these counts.
    """
    pairs = [(m, d) for m in roles.measures for d in labels]
    lo = F.split_part("risky_range", F.lit("~"), F.lit(1)).try_cast("double")
    zone = F.struct("threshold", F.coalesce(lo < F.col("threshold"), F.lit(False)).alias("low"))
    # the handful of zones travels as one joined row
    known = zones.agg(*[F.max(F.when((F.col("column") == m) & (F.col("label") == d), zone)).alias(f"_z{i}") for i, (m, d) in enumerate(pairs)])
    parts = list((subsets or {"": "true"}).items())
    own = df.select(
        *[no_nan(F.col(m).cast("double")).alias(f"_m{i}") for i, m in enumerate(roles.measures)],
        *[F.col(d).alias(f"_y{i}") for i, d in enumerate(labels)],
        F.array(*[F.expr(test) for _, test in parts]).alias("_in") if subsets else F.lit(None).cast("array<boolean>").alias("_in"),
    ).crossJoin(F.broadcast(known))

    def inside(i: int) -> Column:
        value, z = F.col(f"_m{i // len(labels)}"), F.col(f"_z{i}")
        return F.coalesce(F.when(z.low, value <= z.threshold).otherwise(value >= z.threshold), F.lit(False))

    places = range(0, len(pairs), MEASURES_A_ROW * len(labels))
    masks = [F.struct(F.lit(at).alias("at"), F.array(*[inside(i) for i in range(at, min(at + MEASURES_A_ROW * len(labels), len(pairs)))]).alias("risky")) for at in places]
    named = [f"_y{i}" for i in range(len(labels))]
    zones_known = [f"_z{i}" for i in range(len(pairs))]
    counts = own.select(*named, "_in", F.inline(F.array(*masks))).groupBy(*named, "_in", "at", "risky").agg(F.count(F.lit(1)).alias("n"))

    n_set = sum((F.col(c) for c in named), F.lit(0))
    cells = []
    for i, (m, d) in enumerate(pairs):
        hit = F.col(f"_y{i % len(labels)}") == 1
        here = F.col(f"_z{i}").isNotNull() & (F.col("at") == i - i % (MEASURES_A_ROW * len(labels)))
        cells.append(F.when(here, F.struct(
            F.lit(m).alias("column"), F.lit(d).alias("label"), hit.alias("y"),
            F.get("risky", F.lit(i % (MEASURES_A_ROW * len(labels)))).alias("risky"), (n_set - hit.cast("int") > 0).alias("other"))))
    judged = counts.crossJoin(F.broadcast(known.select(*zones_known)))
    rows = judged.select("_in", "n", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("_in", "n", "c.*")
    if subsets:
        listed = F.arrays_zip(F.array(*[F.lit(name) for name, _ in parts]).alias("dataset"), F.col("_in").alias("member"))
        rows = rows.select("n", "column", "label", "y", "risky", "other", F.inline(listed)).filter("member")
    y, risky, other, n = F.col("y"), F.col("risky"), F.col("other"), F.col("n")

    def count(test):
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    def rate(side, keep):
        return F.try_divide(count(side & keep & y), F.nullif(count(side & keep & y.isNotNull()), F.lit(0)))

    def ratio(keep):
        return F.round(F.try_divide(rate(risky, keep), rate(~risky, keep)), 2)

    return rows.groupBy("column", "label", *(["dataset"] if subsets else [])).agg(
        count(risky).alias("n_risky"),
        ratio(~other).alias("pure_ratio"),
        ratio(F.lit(True)).alias("binary_ratio"),
        count(y & risky).alias("n_label_risky"),
        F.round(F.try_divide(count(y & risky & other) * 100, F.nullif(count(y & risky), F.lit(0))), 0).alias("co_pct"),
    )


def invariance_grid(ratios: DataFrame, zones: DataFrame, expected: DataFrame) -> DataFrame:
    """Risk ratios of several datasets, with the gap to the expected zone size.

    ``ratios``: result of ``risk_ratios`` with a ``dataset``; ``expected``: dataset, column, label, n_expected.
    """
    multi = zones.groupBy("column").agg((F.count(F.lit(1)) > 1).alias("multi_label"))
    return (
        ratios.join(lookup(expected), ["dataset", "column", "label"], "left")
        .join(lookup(multi), "column", "left")
        .withColumn("size_drift", F.col("n_risky") - F.col("n_expected"))
    )


def rank_effects(
    df: DataFrame, measures: Sequence[str], labels: dict[str, str], *, limit: int | None = None
) -> DataFrame:
    """Mann-Whitney U, Cliff's delta and p of every (label, measure).

    ``labels``: name -> SQL predicate. Values are counted per measure once; the positives of
    all labels ride along, so the ranks are shared.
    """
    flagged = df.select(*measures, *[F.expr(test).cast("int").alias(f"_y_{n}") for n, test in labels.items()])
    long = unpivot(flagged, [f"_y_{n}" for n in labels], measures)
    counts = written(
        value_counts(long, ["column"], [F.sum(f"_y_{n}").alias(f"_p_{n}") for n in labels])
    )
    ranked = running(counts, ["column"], ["value"], {"_upto": ("sum", "n")}, limit=limit)
    rank = F.col("_upto") - (F.col("n") - 1) / 2.0
    n = F.col("n").cast("double")
    sums = ranked.groupBy("column").agg(
        F.sum("n").alias("size"), F.sum(n * n * n - n).alias("ties"),
        *[F.sum(f"_p_{d}").alias(f"n1_{d}") for d in labels],
        *[F.sum(rank * F.col(f"_p_{d}")).alias(f"r1_{d}") for d in labels],
    )
    cells = [F.struct(F.lit(d).alias("label"), F.col(f"n1_{d}").alias("n1"), F.col(f"r1_{d}").alias("r1")) for d in labels]
    flat = sums.select("column", "size", "ties", F.inline(F.array(*cells)))
    n1 = F.col("n1").cast("double")
    n2 = F.col("size") - n1
    size = F.col("size").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (size + 1 - F.col("ties") / (size * (size - 1))))
    # normal approximation with continuity correction on the larger U
    z = F.greatest((F.abs(u - n1 * n2 / 2) - 0.5) / F.nullif(sd, F.lit(0.0)), F.lit(0.0))
    return flat.filter((n1 > 0) & (n2 > 0)).select(
        "label", "column", F.col("n1").alias("n_positive"), u.alias("u"),
        (2 * u / (n1 * n2) - 1).alias("delta"), z.alias("z"),
    ).withColumn("p_raw", normal_p_udf("z"))


def bh_adjust(tests: DataFrame, family: Sequence[str], p: str = "p_raw", tie: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each family of tests (a small result table)."""
    w = Window.partitionBy(*family)
    rank = F.row_number().over(w.orderBy(F.col(p), *tie))
    scaled = tests.withColumn("_rank", rank).withColumn("_scaled", F.col(p) * F.count(F.lit(1)).over(w) / F.col("_rank"))
    later = w.orderBy(F.col("_rank")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return scaled.withColumn("p_fdr", F.least(F.min("_scaled").over(later), F.lit(1.0))).drop("_rank", "_scaled")


def verdicts(effects: DataFrame, expected: DataFrame) -> DataFrame:
    """Direction and significance verdict for the pairs with an expected direction."""
    agrees, passes = expr.effect_verdict(F.col("delta"), F.col("p_fdr"), F.col("expected"))
    return effects.join(lookup(expected), ["label", "column"]).withColumn("direction_ok", agrees).withColumn(
        "effect_ok", passes
    )


def risky_range(direction: str = "direction", threshold: str = "threshold"):
    """Range text of a risk zone, open on the far side."""
    t = F.format_string("%.5f", F.col(threshold))
    return F.when(F.col(direction) == LOW, F.concat(F.lit("-1e18~"), t)).otherwise(F.concat(t, F.lit("~1e18")))
