"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import Stages


def components(edges: DataFrame, a: str, b: str, stages: Stages) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of its component.

    Alternating large and small stars: each round hangs neighbours on the smallest one around, until nothing moves, in
    a logarithmic number of rounds. A node with very many neighbours is a hot join key against one row, which adaptive
    execution splits. Every round is written, so the plan stays short and a lost executor costs one round.
    """
    edge = F.col(a) != F.col(b)
    links = stages.write(edges.where(edge).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _starred(links):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(around, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        turned = stages.write(hung.unionAll(below.select("u", F.col("m").alias("v"))).distinct())
        stages.drop(links)
        links = turned
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _starred(links: DataFrame) -> bool:
    """True once every node hangs on one other node, and that one on none."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionAll(links.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return node.where("hangs > 1 or hangs + holds > 1").isEmpty()
