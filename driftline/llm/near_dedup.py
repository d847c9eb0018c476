"""Near duplicates on word shingles by SetSketch: banded registers, joint likelihood estimates, exact verification.

1. One pass over the texts gives per document the size and digest of its shingle set and the band keys of its
   registers. Equal sets collapse first inside their input partition and then everywhere, so a group of exact copies
   is one row from there on.
2. Documents that share a band key hang on the smallest one of that key; the components of these stars are families.
   Bands follow the threshold (``banding``), so that no pair at it is missed by more than 1 in 10^8.
3. Families are cut into blocks, and each pair of blocks is one unit of work: registers are compared, the similarity is
   estimated by maximum likelihood, and what may reach the threshold is verified on the full sets, best first. A pair
   that earlier links already connect needs no check. A unit emits at most one link per document, never all pairs.
4. The components of the verified links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import SPACED, Stages, boxed, chunked, field, mix, words_of
from driftline.llm.graph import components
from driftline.llm.setsketch import bands, joint_estimate, registers
from driftline.store import lookup

SHINGLE = 5
#: Registers in bands at most, and the chance to miss a pair at the threshold.
BANDED, MISS = 400, 1e-8
BLOCK = 1024
#: An estimate this many standard deviations below the threshold rules a pair out.
MARGIN = 6.0


def banding(percent: int) -> tuple[int, int]:
    """Rows of a band, and registers (the prime above all bands) for a threshold: the longest bands that fit ``BANDED``.

    At 85 % these are 48 bands of 7 out of 337 registers, at 80 % 61 bands of 6 out of 367.
    """
    share, best = min(percent / 100, 0.99), (1, 2)
    for rows in range(1, BANDED + 1):
        used = rows * int(np.ceil(np.log(MISS) / np.log1p(-(share**rows))))
        if rows > 1 and used > BANDED:
            break
        best = rows, used + 1
    rows, count = best
    while any(count % d == 0 for d in range(2, int(count**0.5) + 1)):
        count += 1
    return rows, count


def shingles(words: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text, ascending within a text, and the first of each text.

    A text of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at, length = first[text] + offset, np.minimum(n[text], width)
    value = length.astype(np.uint64)
    for k in range(width):
        use = length > k
        step = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[np.where(use, at + k, 0)] if len(words) else value)
        value = np.where(use, step, value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])][: len(value)]
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))


def _sketched(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, count = banding(percent)
    for batch in chunked(batches, "_text"):
        _, _, _, first, words = words_of(batch.column(1), SPACED)
        value, at = shingles(words, first)
        keys = bands(registers(value, at, count), rows).view(np.int64)
        total = lambda x: np.diff(np.r_[np.uint64(0), np.cumsum(x)][at]).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(np.diff(at)), pa.array(total(mix(value))), pa.array(total(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))),
            pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel()),
        ], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    _, count = banding(percent)
    for batch in chunked(batches, "_text"):
        _, _, _, first, words = words_of(batch.column("_text"), SPACED)
        value, at = shingles(words, first)
        regs = registers(value, at, count)
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), batch.column("family"), batch.column("parts"), batch.column("part"),
            pa.array([value[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
            pa.array([r.tobytes() for r in regs], pa.binary()),
        ], schema=schema)


class Forest:
    """Union-find over the rows of one unit of work."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def links_of(sets: list[np.ndarray], regs: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the verified links between rows of side 0 and side 1 (or among all rows, if one side)."""
    sizes = np.array([len(s) for s in sets], np.float64)
    one = side.max() == side.min()
    left, right = (np.arange(len(sets)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    share, m = percent / 100, regs.shape[1]
    least = share - MARGIN * (share * (1 - share) / m) ** 0.5
    found_i, found_j, found_e = [], [], []
    for i in left:
        other = right[right > i] if one else right
        other = other[np.minimum(sizes[i], sizes[other]) >= share * np.maximum(sizes[i], sizes[other])]
        if not len(other):
            continue
        equal = (regs[other] == regs[i]).sum(axis=1)
        near = equal >= (least - 0.05) * m
        other, equal = other[near], equal[near]
        if not len(other):
            continue
        more = (regs[i] > regs[other]).sum(axis=1)
        estimate = joint_estimate(more, m - more - equal, equal, sizes[i], sizes[other])
        good = estimate >= least
        found_i.append(np.full(int(good.sum()), i))
        found_j.append(other[good])
        found_e.append(estimate[good])
    if not found_i:
        return []
    i, j, e = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_e)
    forest, out = Forest(len(sets)), []
    for k in np.argsort(-e, kind="stable"):
        a, b = int(i[k]), int(j[k])
        if forest.root(a) == forest.root(b):
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            forest.join(a, b)
            out.append((a, b))
    return out


def _units(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit is in memory at a time."""
    unit, rows = None, []

    def done():
        sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
        regs = np.array([np.frombuffer(r["regs"], np.uint16) for r in rows])
        links = links_of(sets, regs, np.array([r["part"] != unit[1] for r in rows], int), percent)
        return pa.RecordBatch.from_arrays([pa.array([rows[x[k]]["node"] for x in links], schema.field(k).type) for k in (0, 1)], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            own = (row["family"], row["low"], row["high"])
            if own != unit:
                if len(rows) > 1:
                    yield done()
                unit, rows = own, []
            rows.append(row)
    if len(rows) > 1:
        yield done()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Documents with ``100 * intersection >= percent * union`` of their shingle sets are linked; a component is named by its
    smallest key, and that document is kept. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat a key get the same group; a row with a null key is kept and belongs to no group. An empty table
    gives no rows; other columns, whatever their names, are not read. The key must be an integer.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text"))
    ddl = "id long, n long, d1 long, d2 long, bands array<long>"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    sketched = plain.mapInArrow(lambda batches: _sketched(batches, percent, arrow), ddl)
    alone = F.col("id").isNull() | (F.col("n") == 0)
    leaf = stages.write(sketched.withColumn("run", F.spark_partition_id()).groupBy("run", "n", "d1", "d2").agg(
        F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.collect_list(F.struct("id")).alias("members")))
    classes = leaf.where("n > 0 and rep is not null").groupBy("n", "d1", "d2").agg(F.min("rep").alias("node"), F.min_by("bands", "rep").alias("bands"))

    keyed = classes.select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    star = keyed.join(hubs, "key").where("node <> hub").select("hub", "node")
    family = components(star, "hub", "node", stages).withColumnRenamed("root", "family")

    sizes = family.groupBy("family").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / block).cast("int")
    members = lookup(family.join(sizes, "family").select("node", "family", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")))
    ddl = "node long, family long, parts int, part int, set binary, regs binary"
    set_arrow = to_arrow_schema(StructType.fromDDL(ddl))
    joined = plain.join(members, plain["id"] == members["node"]).select("node", "family", "parts", "part", "_text")
    sets = joined.mapInArrow(lambda batches: _sets(batches, percent, set_arrow), ddl)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    units = sets.withColumn("other", other).select(
        "family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "set", "regs",
    ).repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    link_arrow = to_arrow_schema(StructType.fromDDL("a long, b long"))
    links = units.mapInArrow(lambda batches: _units(batches, percent, link_arrow), "a long, b long")
    roots = components(links, "a", "b", stages)

    named = leaf.join(classes.select("n", "d1", "d2", "node"), ["n", "d1", "d2"], "left").join(roots, "node", "left")
    each = named.select(F.explode("members").alias("m"), "n", F.coalesce("root", "node").alias("root")).select(F.col("m.id").alias("id"), "n", "root")
    component = F.when(alone, F.col("id")).otherwise(F.col("root"))
    return each.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest key; of rows that repeat key and text, one.

    Rows with a null key stay. All columns pass through.
    """
    gone = near_groups(docs, key, text, percent).where(~F.col("kept")).select(F.col(key).alias("gone")).distinct()
    left = boxed(docs).join(lookup(gone), field(key) == F.col("gone"), "left_anti")
    again = lookup(docs.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1 and again is not null").select("again"))
    if not again.isEmpty():
        twice = field(key) == F.col("again")
        one = left.join(again, twice, "left_semi").withColumns({"k": field(key), "t": field(text)}).dropDuplicates(["k", "t"])
        left = left.join(again, twice, "left_anti").unionAll(one.select("box"))
    return left.select("box.*")
