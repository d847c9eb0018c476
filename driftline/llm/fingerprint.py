"""MinHash fingerprints of documents: how much of a text is left after an edit, and which texts are nearly the same.

A fingerprint holds the minima of 128 universal hash permutations over the hashed five-word shingles of a text, 16 bits
of each. The share of equal minima of two fingerprints estimates the Jaccard similarity of their shingle sets.

``fingerprints`` gives every text its fingerprint. ``edits`` also looks at the next document: documents are
range-partitioned by descending key and each task runs over its sorted rows, so a document meets the next one without a
window over the whole table; only the first and the last document of each partition meet through a second, small join.
``families`` joins bands of the fingerprints in Spark and verifies the Jaccard similarity of whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import SPACED, Stages, chunked, mix, words_of
from driftline.llm.graph import components
from driftline.store import lookup

SHINGLE, PERMUTATIONS = 5, 128
#: Minima of a band: at a similarity of 0.8, 32 bands of 4 miss a pair with a chance of 5 in 10^8.
ROWS = 4
PERCENT = 80
#: An estimate this many standard deviations below the threshold rules a pair out.
MARGIN = 6.0

_DRAW = np.random.default_rng(40_961)
_SCALE = _DRAW.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _DRAW.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_PLACE = _DRAW.integers(0, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each text, repeats included, and the first of each text.

    A text of fewer words than a shingle has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, n > 0)
    begin = np.r_[0, np.cumsum(count)]
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    size = np.minimum(n, SHINGLE)[text]
    value = size.astype(np.uint64) * _PLACE[SHINGLE]
    padded = np.r_[words, np.zeros(SHINGLE, np.uint64)]
    for k in range(SHINGLE):
        value += np.where(size > k, padded[at + k] * _PLACE[k], np.uint64(0))
    return mix(value), begin


def signatures(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each text 16 bits of the minimum of every permutation ``a * x + b`` of the 32-bit numbers, a odd; without
    shingles all ones."""
    x = (value >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(begin))
    least = np.full((PERMUTATIONS, len(begin) - 1), 2**32 - 1, np.uint32)
    if len(some):
        for k in range(PERMUTATIONS):
            least[k, some] = np.minimum.reduceat(x * _SCALE[k] + _SHIFT[k], begin[some])
    out = np.ascontiguousarray(((least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)).astype("<u2").T)
    out[np.diff(begin) == 0] = 0xFFFF
    return out


def of_texts(texts: pa.Array) -> np.ndarray:
    """Signatures of a column of texts, in slices of bounded size."""
    rows = chunked([pa.RecordBatch.from_arrays([texts], ["t"])], "t")
    parts = [signatures(*shingle_hashes(words, first)) for _, _, _, first, words in (words_of(b.column(0), SPACED) for b in rows)]
    return np.concatenate(parts) if parts else np.empty((0, PERMUTATIONS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last ``floor(n / 2)`` characters of a text replaced by as many first ones of another, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


# ---- fingerprints -----------------------------------------------------------------------------------------------

def _printed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        _, _, _, first, words = words_of(batch.column("_text"), SPACED)
        value, begin = shingle_hashes(words, first)
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(np.diff(begin)), _binary(signatures(value, begin))], schema=schema)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, shingles (with repeats), signature (bytes) of every row; nothing is shuffled.

    Words end at ASCII white space, A-Z is lower-cased. Null, empty and blank texts have the fingerprint of no shingles.
    """
    schema, ddl = _typed(docs, key, "shingles long, signature binary")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(lambda batches: _printed(batches, schema), ddl).withColumnRenamed("_key", key)


def _typed(docs: DataFrame, key: str, columns: str) -> tuple[pa.Schema, str]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"_key {docs.select(key).schema[0].dataType.simpleString()}, {columns}"
    return to_arrow_schema(StructType.fromDDL(ddl)), ddl


# ---- a document, its edited text and the next document ----------------------------------------------------------

DONE, HEAD, OPEN = 0, 1, 2
_EDITS = "n_chars long, edited_sha256 binary, signature binary, edited_signature binary, near_edited double, near_next double"


def _edit_columns(texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    new = [edited(a, b) for a, b in zip(texts, following)]
    sign = of_texts(pa.array(new, pa.large_string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in new], pa.binary()),
        _binary(own), _binary(sign), pa.array(likeness(own, sign)), pa.array(likeness(own, after)),
    ]


def _chained(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order of the partition. The first one is also given out as its head, the last one stays open."""
    part = TaskContext.get().partitionId()
    last_key = last_text = last_sign = None

    def rows(state: int, keys: pa.Array, texts: list[str] | None, columns: list[pa.Array]) -> pa.RecordBatch:
        n = len(keys)
        full = [*columns[:2], *columns[2:]]
        return pa.RecordBatch.from_arrays([
            keys, *full, pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, state, np.int32)), pa.array(texts or [None] * n, pa.string()),
        ], schema=schema)

    def ends(state: int, keys: pa.Array, text: str, sign: np.ndarray) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(1, kind)
        return rows(state, keys, [text], [none(pa.int64()), none(pa.binary()), _binary(sign[None]), none(pa.binary()), none(pa.float64()), none(pa.float64())])

    for batch in chunked(batches, "_text"):
        keys, texts = batch.column("_key"), batch.column("_text").fill_null("")
        sign = of_texts(texts)
        texts = texts.to_pylist()
        if last_key is None:
            yield ends(HEAD, keys.slice(0, 1), texts[0], sign[0])
        else:
            keys, texts, sign = pa.concat_arrays([last_key, keys]), [last_text, *texts], np.concatenate([last_sign[None], sign])
        if len(texts) > 1:
            yield rows(DONE, keys.slice(0, len(texts) - 1), None, _edit_columns(texts[:-1], texts[1:], sign[:-1], sign[1:]))
        last_key, last_text, last_sign = keys.slice(len(texts) - 1), texts[-1], sign[-1].copy()
    if last_key is not None:
        yield ends(OPEN, last_key, last_text, last_sign)


def _closed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # one row a partition; texts may be very long
            row = batch.slice(k, 1)
            own, after = (np.frombuffer(row.column(c)[0].as_py(), "<u2")[None] for c in ("signature", "next_signature"))
            texts = [row.column(c)[0].as_py() for c in ("text", "next_text")]
            yield pa.RecordBatch.from_arrays([row.column("_key"), *_edit_columns(texts[:1], texts[1:], own, after)], schema=schema)


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document has the next smaller key, the last one is followed by the first one; a single document by itself.
    The last ``floor(n_chars / 2)`` characters of a text are replaced by as many first ones of the next document. Null
    texts are empty. Rows that share a key follow each other by a hash of their text, then by the text; null keys come
    last. Two texts without words are alike, a text with words is unlike one without. An empty table gives no rows;
    other columns, whatever their names, are not read. Memory is bounded by the longest texts.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    schema, ddl = _typed(docs, key, f"{_EDITS}, part int, state int, text string")
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("_key").desc_nulls_last(), F.xxhash64("_text")]
    # equal rows of one key may be cut apart anywhere, so that even they are dealt evenly
    dealt = plain.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_text"), F.col("_row")).drop("_row")
    chained = stages.write(dealt.mapInArrow(lambda batches: _chained(batches, schema), ddl))

    parts = [r["part"] for r in chained.where(F.col("state") == HEAD).select("part").orderBy("part").collect()]  # a number per partition
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    head = chained.where(F.col("state") == HEAD).select(
        F.col("part").alias("next_part"), F.col("signature").alias("next_signature"), F.col("text").alias("next_text"))
    opened = chained.where(F.col("state") == OPEN).select("_key", "part", "signature", "text").join(following, "part").join(head, "next_part")
    closing, closing_ddl = _typed(docs, key, _EDITS)
    closed = opened.mapInArrow(lambda batches: _closed(batches, closing), closing_ddl)
    digest = lambda c: F.lower(F.hex(c))
    return chained.where(F.col("state") == DONE).drop("part", "state", "text").unionAll(closed).select(
        F.col("_key").alias(key), "n_chars", digest("edited_sha256").alias("edited_sha256"), digest("signature").alias("fingerprint"),
        digest("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next")


# ---- texts that are nearly the same -----------------------------------------------------------------------------

def _sketched(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        _, _, _, first, words = words_of(batch.column("_text"), SPACED)
        value, begin = shingle_hashes(words, first)
        total = lambda x: np.diff(np.r_[np.uint64(0), np.cumsum(x)][begin]).view(np.int64)
        digest = [pa.array(np.diff(begin)), pa.array(total(mix(value))), pa.array(total(mix(~value)))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *digest, _binary(signatures(value, begin))], schema=schema)


def _estimated(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    share = percent / 100
    least = share - MARGIN * (share * (1 - share) / PERMUTATIONS) ** 0.5
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, PERMUTATIONS) for c in ("s", "t"))
        yield batch.select(["node", "leader"]).filter(pa.array(likeness(a, b) >= least))


def _sets(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        _, _, _, first, words = words_of(batch.column("_text"), SPACED)
        value, begin = shingle_hashes(words, first)
        sets = [np.unique(value[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], schema=schema)


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for s, t in zip(batch.column("s"), batch.column("t")):
            a, b = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) else 0
            good.append(100 * both >= percent * (len(a) + len(b) - both))
        yield batch.select(["node", "leader"]).filter(pa.array(good, pa.bool_()))


def families(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, family_id of every row: documents linked, directly or through others, to the leaders of their bands.

    Copies collapse to their smallest key first. The leader of a band is the smallest key that has it; a document is
    linked with a leader if ``100 * intersection >= percent * union`` of their whole shingle sets. A family is named by
    its smallest key. Work grows with the number of bands, never with the square of a group: two documents that are both
    unlike every leader they share stay apart. Texts without words and rows with a null key are families of their own;
    rows that repeat a key get one family. An empty table gives no rows; other columns are not read. The key must be an
    integer.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    stages = Stages(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text"))
    ddl = "id long, n long, d1 long, d2 long, signature binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    sketched = stages.write(plain.mapInArrow(lambda batches: _sketched(batches, schema), ddl))
    classes = sketched.where("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("node"), F.min_by("signature", "id").alias("signature"))
    classes = stages.write(classes)

    width, count = 2 * ROWS, PERMUTATIONS // ROWS
    band = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(count)])
    keyed = classes.select("node", F.explode(band).alias("band"))
    leaders = keyed.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("top")).where("leader < top").drop("top")
    star = keyed.join(leaders, "band").where("node <> leader").select("node", "leader").distinct()
    sign = classes.select("node", "signature")
    near = star.join(sign.withColumnRenamed("signature", "s"), "node").join(sign.select(F.col("node").alias("leader"), F.col("signature").alias("t")), "leader")
    near = stages.write(near.mapInArrow(lambda batches: _estimated(batches, percent), "node long, leader long"))

    need = lookup(near.select(F.col("node").alias("id")).unionAll(near.select("leader")).distinct())
    set_schema = to_arrow_schema(StructType.fromDDL("id long, set binary"))
    sets = plain.join(need, "id").dropDuplicates(["id"]).mapInArrow(lambda batches: _sets(batches, set_schema), "id long, set binary")
    sets = stages.write(sets)
    of = lambda name, out: sets.select(F.col("id").alias(name), F.col("set").alias(out))
    pairs = near.join(of("node", "s"), "node").join(of("leader", "t"), "leader").select("node", "leader", "s", "t")
    links = pairs.mapInArrow(lambda batches: _verified(batches, percent), "node long, leader long")
    roots = components(links, "node", "leader", stages)
    stages.drop(sets)
    stages.drop(near)

    named = classes.join(roots, "node", "left").select("n", "d1", "d2", F.coalesce("root", "node").alias("family_id"))
    family = F.coalesce("family_id", "id").alias("family_id")
    return sketched.drop("signature").join(named, ["n", "d1", "d2"], "left").select(F.col("id").alias(key), F.when(F.col("id").isNotNull(), family).alias("family_id"))
