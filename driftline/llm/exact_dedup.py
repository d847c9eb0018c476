"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition makes one run: its distinct digests with the smallest identifier and the count of each. In
round ``j`` the runs that differ only in digit ``j`` of their number exchange: a run sends each of its rows to the
partner whose digit equals hex digit ``j`` of the row's digest, and every partner merges what it gets, sixteen ways at
most. Rows shrink at every level, as equal digests meet; after log16(runs) rounds a run owns a range of digests.
A group of copies, however large, is one row per run after the first step, so no task gets more than a row per run
for one digest, and no run is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftline.llm.common import Stages, boxed, field

#: Equal digests count as equal texts only if the length and a second, unrelated hash agree too.
IDENTITY = ["sha", "chars", "proof"]


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input partition and digest: smallest row, count, and the rows themselves."""
    rows = docs.select(
        F.spark_partition_id().alias("run"), F.col(key).alias("id"),
        F.monotonically_increasing_id().alias("row"), normalised(text).alias("plain"),
    ).select(
        "run", "id", "row", F.sha2(F.col("plain").cast("binary"), 256).alias("sha"),
        F.octet_length("plain").alias("chars"), F.xxhash64("plain").alias("proof"),
    )
    ranked = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    return rows.groupBy("run", *IDENTITY).agg(
        F.min(ranked).alias("best"), F.count("*").alias("n"), F.collect_list(F.struct("id", "row")).alias("members"),
    )


def merge_round(level: DataFrame, digit: int) -> DataFrame:
    """Exchange runs along one digit of their number and merge what meets."""
    unit = 16**digit
    own = F.floor(F.col("run") / unit) % 16
    wanted = F.conv(F.substring("sha", digit + 1, 1), 16, 10).cast("int")
    sent = level.withColumn("run", (F.col("run") + (wanted - own) * unit).cast("int")).repartition("run")
    return sent.groupBy("run", *IDENTITY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is folded. The row with the smallest key stays; of rows that
    repeat the same key and text, one; a null key comes last. Null text counts as empty, an empty table gives no rows,
    and other columns of the input, whatever their names, are not touched.
    """
    stages = Stages(docs.sparkSession)
    leaf = stages.write(runs(docs, key, text))
    count = (leaf.agg(F.max("run")).first()[0] or 0) + 1
    level, digit = leaf.select("run", *IDENTITY, "best", "n"), 0
    while 16**digit < count:
        level, digit = merge_round(level, digit), digit + 1
    if not digit:
        level = level.groupBy("run", *IDENTITY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    owner = level.select(*IDENTITY, "best", F.col("n").alias("size"))
    return leaf.select(*IDENTITY, "members").join(owner, IDENTITY).select(
        F.explode("members").alias("m"), "best", "size", "sha",
    ).select(
        F.col("m.id").alias(key), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("m.row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat key and text, one."""
    stay = exact_groups(docs, key, text).where("kept").select(F.col(key).alias("stay"), F.col("text_sha256").alias("sha"))
    rows = boxed(docs).withColumns({"own": field(key), "digest": F.sha2(normalised("box." + text).cast("binary"), 256)})
    found = rows.join(stay, F.col("own").eqNullSafe(F.col("stay")) & (F.col("digest") == F.col("sha")), "left_semi")
    return found.dropDuplicates(["own", "digest"]).select("box.*")
