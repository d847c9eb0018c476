"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round result columns, so that two engines' float noise does not show."""
    wanted = set(columns)
    return df.select(*[F.round(c, digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


def union_sql(table: str, keep: str, columns: list[str], where: str = "true") -> str:
    """SQL text of a wide-to-long step."""
    lead = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {table} WHERE {c} IS NOT NULL AND {where}"
        for c in columns
    )


def day_text(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as ISO text, which reads the same from every engine."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
