"""Ordered work inside groups of any size.

A window function puts each of its groups into one task. That is the right plan while
the largest group is small, and the wrong one when a single group holds a large part of
the data. Every operator that needs an order therefore goes through this module: it
counts the largest group, uses a plain window when it fits into ``driftline.maxGroupRows``
rows, and otherwise cuts the groups into blocks of bounded size, works inside the blocks
and carries the effect of earlier blocks over with a small per-block table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence as Seq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from driftline.store import join_null_safe, lookup, written

RN = "_rn"
BLOCK = "_blk"
_FN = {"sum": F.sum, "max": F.max, "min": F.min}


def group_row_limit(spark: SparkSession) -> int:
    """Largest number of rows of one group that may go into one task."""
    return int(spark.conf.get("driftline.maxGroupRows", "2000000"))


def group_sizes(df: DataFrame, part: Seq[str]) -> tuple[int, int]:
    """Total rows and rows of the largest group; only two numbers reach the driver."""
    row = (
        df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
        .first()
    )
    return int(row["total"] or 0), int(row["largest"] or 0)


def range_blocks(df: DataFrame, part: Seq[str], order: Seq[str], total: int, limit: int) -> DataFrame:
    """Rows placed by range of (group, order); the block number grows with the order.

    Range bounds come from a sample and can differ between runs of the same plan, so the
    placed rows are written once and every later step reads the same blocks.
    """
    parts = max(2, math.ceil(total / limit))
    placed = df.repartitionByRange(parts, *part, *order)
    return written(placed.withColumn(BLOCK, F.spark_partition_id()))


def _spec(part: Seq[str], order: Seq[str]) -> WindowSpec:
    keys = list(part) or [F.lit(1)]
    return Window.partitionBy(*keys).orderBy(*order)


def running(
    df: DataFrame,
    part: Seq[str],
    order: Seq[str],
    aggs: Mapping[str, tuple[str, str]],
    *,
    inclusive: bool = True,
    limit: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Running sum/max/min per group in the given order.

    ``aggs`` maps a new column to ``(function, column)``. With ``inclusive=False`` the row
    itself is left out. The order must be total inside a group. ``sizes`` is the result of
    ``group_sizes``, if the caller has it already.
    """
    limit = limit or group_row_limit(df.sparkSession)
    total, largest = sizes or group_sizes(df, part)
    if largest <= limit:
        return _running_window(df, part, order, aggs, inclusive)
    return _running_blocks(range_blocks(df, part, order, total, limit), part, order, aggs, inclusive).drop(BLOCK)


def _running_window(df, part, order, aggs, inclusive):
    w = _spec(part, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.select("*", *[_FN[f](c).over(w).alias(name) for name, (f, c) in aggs.items()])


def _running_blocks(blocks, part, order, aggs, inclusive):
    """Windows inside (group, block), plus what the earlier blocks of the group add."""
    inner = _running_window(blocks, [*part, BLOCK], order, aggs, inclusive)
    per_block = blocks.groupBy(*part, BLOCK).agg(
        *[_FN[f](c).alias(f"_t_{name}") for name, (f, c) in aggs.items()]
    )
    before = _spec(part, [BLOCK]).rowsBetween(Window.unboundedPreceding, -1)
    carried = lookup(
        per_block.select(
            *part, BLOCK,
            *[_FN[f](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (f, _) in aggs.items()],
        )
    )
    joined = join_null_safe(inner, carried, [*part, BLOCK])
    kept = [c for c in joined.columns if c not in aggs and not c.startswith("_c_")]
    return joined.select(*kept, *[_combine(f, name).alias(name) for name, (f, _) in aggs.items()])


def _combine(fn: str, name: str) -> Column:
    here, earlier = F.col(name), F.col(f"_c_{name}")
    if fn == "sum":
        return F.when(here.isNull(), earlier).otherwise(here + F.coalesce(earlier, F.lit(0)))
    return F.greatest(here, earlier) if fn == "max" else F.least(here, earlier)


def number_rows(
    df: DataFrame, part: Seq[str], order: Seq[str], name: str = RN, *, limit: int | None = None
) -> DataFrame:
    """Row number inside each group; exact for groups of any size."""
    limit = limit or group_row_limit(df.sparkSession)
    total, largest = group_sizes(df, part)
    if largest <= limit:
        return df.withColumn(name, F.row_number().over(_spec(part, order)))
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    blocks = range_blocks(ones, part, order, total, limit)
    return _running_blocks(blocks, part, order, {name: ("sum", "_one")}, True).drop("_one", BLOCK)


@dataclass(frozen=True)
class Ordered:
    """Rows in order inside each group, cut into blocks when a group is too large.

    In the plain case ``blocked`` is False and all windows share one shuffle on ``part``.
    In the blocked case every row carries its position in the group and the block that
    position falls into, so a block never holds more than ``limit`` rows.
    """

    df: DataFrame
    part: tuple[str, ...]
    order: tuple[str, ...]
    blocked: bool
    limit: int

    @classmethod
    def of(
        cls,
        df: DataFrame,
        part: Seq[str],
        order: Seq[str],
        limit: int | None = None,
        fact: DataFrame | None = None,
        sizes: tuple[int, int] | None = None,
    ) -> Ordered:
        """``fact``: a cheaper table with the same rows, on which the groups are counted;
        ``sizes``: that count, if the caller has it already."""
        limit = limit or group_row_limit(df.sparkSession)
        _, largest = sizes or group_sizes(df if fact is None else fact, part)
        if largest <= limit:
            return cls(
                df.withColumn(RN, F.row_number().over(_spec(part, order))),
                tuple(part), tuple(order), False, limit,
            )
        numbered = number_rows(df, part, order, limit=limit)
        cut = numbered.withColumn(BLOCK, F.floor((F.col(RN) - 1) / limit).cast("bigint"))
        return cls(written(cut), tuple(part), (RN,), True, limit)

    def window(self) -> WindowSpec:
        """Window over one group, or over one block of it."""
        return _spec([*self.part, BLOCK] if self.blocked else self.part, self.order)

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def select(self, *columns: Column | str) -> Ordered:
        return self.with_df(self.df.select("*", *columns))

    def with_lookback(
        self, rows: int, make: Callable[[WindowSpec], Mapping[str, Column]]
    ) -> Ordered:
        """Columns that look at most ``rows`` rows back (lags, rolling frames).

        In the blocked case the last ``rows`` rows of a block are copied to the next one.
        """
        if not self.blocked:
            return self.select(*[c.alias(n) for n, c in make(self.window()).items()])
        if self.limit < rows:
            raise ValueError("blocks must be at least as long as the look-back")
        place = F.pmod(F.col(RN) - 1, F.lit(self.limit))
        copies = F.when(place >= self.limit - rows, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        spread = self.df.withColumn("_copy", F.explode(copies)).withColumn(BLOCK, F.col(BLOCK) + F.col("_copy"))
        done = spread.select("*", *[c.alias(n) for n, c in make(self.window()).items()])
        return self.with_df(done.filter("_copy = 0").drop("_copy"))

    def with_running(self, aggs: Mapping[str, tuple[str, str]]) -> Ordered:
        """Inclusive running aggregates from the start of the group."""
        if not self.blocked:
            return self.with_df(_running_window(self.df, self.part, self.order, aggs, True))
        return self.with_df(_running_blocks(self.df, self.part, self.order, aggs, True))

    def with_run_position(self, flags: Mapping[str, str]) -> Ordered:
        """Position of a row inside its run of true flags (0 where the flag is not true).

        ``flags`` maps the new column to a boolean column.
        """
        marked = self.select(
            *[
                F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(RN)).alias(f"_off_{name}")
                for name, flag in flags.items()
            ]
        )
        ran = marked.with_running({f"_last_{name}": ("max", f"_off_{name}") for name in flags})
        done = ran.df.select(
            "*",
            *[
                (F.col(RN) - F.coalesce(F.col(f"_last_{name}"), F.lit(0))).cast("bigint").alias(name)
                for name in flags
            ],
        )
        return ran.with_df(done.drop(*[f"{p}_{n}" for n in flags for p in ("_off", "_last")]))

    def result(self) -> DataFrame:
        return self.df.drop(RN, BLOCK)
