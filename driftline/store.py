"""Written intermediate tables and size-checked broadcasts.

Lineage is cut by writing a table to the shared checkpoint folder, so an executor that
is lost later only costs a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16_000_000  # of the written, compressed files
_SCOPES: list[list[str]] = []


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local folder only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the work folder and read it back."""
    return _write(df)[0]


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{work_folder(spark)}/stage-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def written_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below a written table."""
    system, target = file_system(spark, path)
    return system.getContentSummary(target).getLength()


@contextmanager
def stages(spark: SparkSession):
    """Removes the tables that were written inside, once the block ends; results must have been saved by then."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.remove(own)
        for path in own:
            system, target = file_system(spark, path)
            system.delete(target, True)


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A learned table, written once, and broadcast only if its rows and its bytes allow it.

    Beyond that the plain table is returned: the join is then a shuffle join, whose hot
    keys are split by the adaptive skew handling.
    """
    seen = Observation()
    table, path = _write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    small = seen.get["n"] <= max_rows and written_bytes(df.sparkSession, path) <= max_bytes
    return F.broadcast(table) if small else table


def together(spark: SparkSession, *steps: Callable) -> list:
    """Run independent learning steps at the same time, so their jobs share the cluster."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return list(pool.map(lambda step: inheritable_thread_target(spark)(step)(), steps))


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi join in which a null key matches a null key; the keys of ``left`` are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        test = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])

