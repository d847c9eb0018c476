"""From raw documents to packed training sequences: four filters and the packer, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from driftline.llm.common import Stages, in_fold, table
from driftline.llm.queries import vocabulary


#: Near copies link from this Jaccard similarity on; the 85 of query op5 is that query's own.
NEAR_PERCENT = 80


def measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the models learn from the labels of two folds of three, as the query does."""
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 3, 1))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of long lines the first one stays; a document that loses all its lines goes."""
    left = line_dedup.dedup_lines(docs).where("line_dedup.n_removed = 0 or line_dedup.n_removed < line_dedup.n_lines")
    return measured(left.drop("line_dedup"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark_passages),
    ("packing", pack),
]

#: The stages use trained scores, sketches and a tokenizer, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole ``documents`` table."""
    stages, docs = Stages(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
