"""Exact quantiles by counting bins: only the values of a few bins ever leave the task that reads them.

The first pass counts bins of the logarithm per group, together with the moments, so one row per group and occupied bin is
shuffled instead of one per row and measure. A running count over the bins tells which of them hold the wanted positions.
Later passes read the source again and look at these bins alone: either cut evenly between their smallest and largest
value, or, once all of them are small, value by value. Every cut is monotone in the value, so the order of the bins is the
order of the values, and the digits of a double are used up after four passes whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from driftline.operators.ordered import group_row_limit
from driftline.store import BROADCAST_ROWS, join_null_safe, written

#: Bins per doubling of the magnitude in the first pass, and bins of a bin in later ones.
PER_DOUBLING, CUTS = 16, 1 << 16
#: Rows of a bin that may be ordered in one task, if the limit of a group allows as many.
SMALL = 100_000


def log_bin(value: Column) -> Column:
    """Number of the logarithmic bin of a double: grows with the value, 0 for zero, opposite for opposite values."""
    power = F.least(F.log2(F.abs(value)) * PER_DOUBLING, F.lit(1025.0 * PER_DOUBLING))
    above = F.floor(power) + 1075 * PER_DOUBLING
    return F.when(value > 0, above).when(value < 0, -above).otherwise(F.lit(0).cast("bigint"))


_MOMENTS = ("n", "mean", "std", "min", "max")
#: Columns of a wanted position: smallest and largest value of its bin, the place inside, the rows of the bin.
_AT = ("low", "high", "rest", "size")


def _located(bins: DataFrame, part: Sequence[str], ks: range, rest: Callable[[int], str], slot: Callable[[int], str], carry: Sequence[str]) -> DataFrame:
    """One row per group: for each wanted position k the bin that holds it, null if none of these does, and ``carry``."""
    found = []
    for k in ks:
        hit = f"slot = {slot(k)} and {rest(k)} >= before and {rest(k)} < before + rows"
        for c, v in zip(_AT, ("least", "most", f"{rest(k)} - before", "rows")):
            found.append(f"max(case when {hit} then {v} end) as _{c}{k}")
    return bins.groupBy(*part).agg(*map(F.expr, [*found, *carry]))


def _before(part: Sequence[str]) -> Column:
    order = Window.partitionBy(*part, "slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.sum("rows").over(order) - F.col("rows")).alias("before")


def _span() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.min("value").alias("least"), F.max("value").alias("most")]


def _first(counted: DataFrame, part: Sequence[str], probs: Sequence[float], ks: range) -> DataFrame:
    """Moments of each group and the bins of its wanted positions."""
    whole = Window.partitionBy(*part)
    total = F.sum("rows").over(whole)
    placed = counted.select("*", _before(part), total.alias("all"), (F.sum(F.col("m") * F.col("rows")).over(whole) / total).alias("mean"))
    square = "sum((v + (m - mean) * (m - mean)) * rows)"
    carry = ["sum(rows) as n", "max(mean) as mean", f"case when sum(rows) > 1 then sqrt({square} / nullif(sum(rows) - 1, 0)) end as std",
             "min(least) as min", "max(most) as max"]
    rest = lambda k: f"{'ceil' if k % 2 else 'floor'}({float(probs[k // 2])!r}D * (all - 1))"
    out = _located(placed, part, ks, rest, lambda k: "0", carry)
    return out.toDF(*part, *[f"{c}{k}" for k in ks for c in _AT], *_MOMENTS)


def _cut(long: DataFrame, at: DataFrame, part: Sequence[str], ks: range, groups: int, by_value: bool) -> DataFrame:
    """One more pass: the bins of positions that are not settled, cut evenly or value by value."""
    some = " or ".join(f"low{k} < high{k}" for k in ks)
    table = F.broadcast(at.where(some)) if groups <= BROADCAST_ROWS else at.where(some)
    # positions in the same bin have the slot of the first of them
    slot = lambda k: "case " + " ".join(f"when low{j} = low{k} then {j}" for j in range(k + 1)) + " end"
    pick = lambda of: "case " + " ".join(f"when low{k} < high{k} and value between low{k} and high{k} then {of(k)}" for k in ks) + " end"
    digit = "value" if by_value else f"floor((value - {pick('low{}'.format)}) / ({pick('high{}'.format)} - {pick('low{}'.format)}) * {CUTS - 1})"
    inside = join_null_safe(long, table, part, "inner").select(*part, "value", *map(F.expr, (f"{pick(slot)} as slot", f"{digit} as digit")))
    bins = inside.where("slot is not null").groupBy(*part, "slot", "digit").agg(*_span())
    placed = join_null_safe(bins.repartition(*part).select("*", _before(part)), table, part, "inner")
    names = [*[f"{c}{k}" for k in ks for c in _AT], *_MOMENTS]
    new = _located(placed, part, ks, "rest{}".format, slot, [f"max({c}) as {c}" for c in names])
    kept = [f"case when low{k} < high{k} then _{c}{k} else {c}{k} end as {c}{k}" for k in ks for c in _AT]
    return at.where(f"not ({some})").unionAll(new.selectExpr(*part, *kept, *_MOMENTS))


def _written(at: DataFrame, ks: range) -> tuple[DataFrame, int, int]:
    """The positions, written; rows of the widest bin that is not a single value (0 if none is left); number of groups."""
    seen = Observation()
    widths = ", ".join(f"case when low{k} < high{k} then size{k} end" for k in ks)
    out = written(at.observe(seen, F.count(F.lit(1)).alias("groups"), F.expr(f"max(greatest({widths}, 0))").alias("widest")))
    return out, seen.get["widest"] or 0, seen.get["groups"]


def select_quantiles(long: DataFrame, part: Sequence[str], probs: Sequence[float], names: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """Per group of ``long`` (its ``value`` without nulls): n, mean, std, min, max and interpolated quantiles.

    ``long`` is read once a pass and should be a plain projection of a table. Bins of more than ``limit`` rows are cut
    further, down to single values. Equal to sorting the whole group.
    """
    small = min(limit or group_row_limit(long.sparkSession), SMALL)
    given, part = list(part), [f"_part{i}" for i in range(len(part))]  # names that no column here has
    long = long.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(given, part)], "value")
    ks, seen = range(2 * len(probs)), Observation()
    counted = long.select(*part, "value", F.lit(0).alias("slot"), log_bin(F.col("value")).alias("digit")).groupBy(*part, "slot", "digit").agg(
        *_span(), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    mixed = F.max(F.when(F.col("least") < F.col("most"), F.col("rows")).otherwise(0))
    counted = written(counted.observe(seen, F.count(F.lit(1)).alias("bins"), mixed.alias("widest")))
    at, widest, groups = _first(counted, part, probs, ks), seen.get["widest"] or 0, seen.get["bins"]
    while widest > small:  # so far over all bins, from here on over those of the wanted positions
        at, widest, groups = _written(at, ks)
        if widest > small:
            at = _cut(long, at, part, ks, groups, by_value=False)
    if widest:
        at = _cut(long, at, part, ks, groups, by_value=True)
    cuts = []
    for i, p in enumerate(probs):
        pos = f"({float(p)!r}D * (n - 1))"
        cuts.append(f"low{2 * i} + (low{2 * i + 1} - low{2 * i}) * ({pos} - floor({pos})) as _cut{i}")
    return at.selectExpr(*part, *_MOMENTS, *cuts).toDF(*given, *_MOMENTS, *names)
