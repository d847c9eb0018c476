"""Which sources of a language use its vocabulary differently: exact divergences from bitmaps per group and count.

A group is a language and source. Its probability of a term depends on the count alone, so the divergence of two groups
is a sum over pairs of counts: how many terms have this count here and that count there, times the value of the pair.

1. Each task counts its terms over whole texts; two shuffled sums follow, by group and term and by language and term. A
   language keeps the terms of enough documents.
2. The kept terms are laid out by falling frequency, so that the 64 terms of a word have similar counts. Each word holds,
   per group and count, the bitset of the terms with that count.
3. Words are dealt out in blocks, and groups in tiles, so that a unit of work is a block and two tiles. A unit adds the
   bitset of the zeros as a complement, takes ANDs of the bitsets of two groups, counts their bits, and multiplies by the
   value of the two counts. Only one sum per pair of groups leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import LOWER, Stages, chunked, spans, text_bytes
from driftline.store import lookup

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000  # fixed value: probabilities are whole parts of this
#: Words of 64 terms in a block, groups in a tile.
BLOCK, TILE = 16, 32
#: Bytes of words that are terms, to be applied after LOWER: letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per chunk: group, term, occurrences, documents; and a row with the empty term for every group."""
    for batch in chunked(batches, "_text"):
        data, offsets = text_bytes(batch.column("_text"))
        low = LOWER[data]
        starts, ends, first = spans(low, offsets, LETTERS)
        label = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["l", "s"])
        names = pa.array([f"{len(x['l'])}:{x['l']}{x['s']}" for x in label.to_pylist()]).dictionary_encode()
        group, some = np.unique(names.indices.to_numpy(), return_index=True)
        groups, member = len(group), names.indices.to_numpy()
        letters = low[LETTERS[low]] if len(low) else low
        at = np.r_[0, np.cumsum(ends - starts)]
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        code, size = terms.indices.to_numpy().astype(np.int64), max(len(terms.dictionary), 1)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        both, times = np.unique(doc * size + code, return_counts=True)
        key = member[both // size].astype(np.int64) * size + both % size
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        count = np.add.reduceat(times, new) if len(new) else times
        docs = np.diff(np.r_[new, len(key)])
        row = pa.array(np.r_[some, some[key[new] // size]])
        yield pa.RecordBatch.from_arrays([
            batch.column("lang").take(row), batch.column("source").take(row),
            pa.concat_arrays([pa.array([b""] * groups, pa.binary()), terms.dictionary.take(pa.array(key[new] % size)).cast(pa.binary())]),
            pa.array(np.r_[np.zeros(groups, np.int64), count]), pa.array(np.r_[np.zeros(groups, np.int64), docs]),
        ], schema=schema)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count, docs over all whole texts; each group also has a row with the empty term and zeros.

    Terms are runs of letters and of characters beyond ASCII, with only A-Z lower-cased. Null texts, languages and
    sources are empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = "lang string, source string, term binary, count long, docs long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    plain = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    rows = docs.select(plain(lang, "lang"), plain(source, "source"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(lambda batches: _counted(batches, schema), ddl).withColumn("term", F.col("term").cast("string"))
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def probability(count: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))`` in whole numbers of any size that occurs."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast({total} + 2 * {terms} as decimal(20, 0))")


def divergence(p, q):
    """``floor((p - q)^2 / (p + q))``; the square of a difference of two probabilities fits into 64 bits."""
    return (p - q) * (p - q) // (p + q)


def joint_sums(words: np.ndarray, group: np.ndarray, p: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Sums over pairs of bitsets of one word: for each group of ``left`` with each later group of ``right``.

    Rows are ordered by (group, word). Yields (a, b, sum): a group, the groups after it, and a whole number for each.
    """
    for a in left.tolist():
        mine = slice(*np.searchsorted(group, [a, a + 1]))
        more = right[right > a]
        if not len(more) or mine.start == mine.stop:
            continue
        rest = slice(np.searchsorted(group, more[0]), np.searchsorted(group, more[-1] + 1))
        word = words[rest]
        start, stop = np.searchsorted(words[mine], word), np.searchsorted(words[mine], word, "right")
        size = stop - start
        other = np.repeat(np.arange(len(word)), size)
        own = np.arange(len(other)) - np.repeat(np.cumsum(size) - size - start, size)
        joint = np.bitwise_count(bits[mine][own] & bits[rest][other]).astype(np.int64)
        hit = joint > 0
        own, other, joint = own[hit], other[hit], joint[hit]
        running = np.r_[0, np.cumsum(joint * divergence(p[mine][own], p[rest][other]))]
        edge = np.searchsorted(other, np.searchsorted(group[rest], np.r_[more, more[-1] + 1]))
        yield a, more, np.diff(running[edge])


def _unit(rows: pd.DataFrame) -> pd.DataFrame:
    """One block and two tiles. Rows: bitsets (word, p, bits) of groups, for each group its probability of a count of
    zero (word -1), and under tile -1 the terms that each word holds."""
    low, high = rows["low"][0], rows["high"][0]
    table = rows[rows["tile"] < 0]
    full = np.zeros(int(table["word"].max()) + 1, np.uint64)
    full[table["word"]] = table["bits"].to_numpy().view(np.uint64)
    own = rows[rows["tile"] >= 0].assign(later=lambda x: x["tile"] != low).sort_values(["later", "source", "word"], kind="stable")
    group, word = pd.factorize(own["source"])[0], own["word"].to_numpy()
    p, bits, zero = own["p"].to_numpy(), own["bits"].to_numpy().view(np.uint64), own["word"].to_numpy() < 0
    names, later = own["source"].to_numpy()[zero], own["later"].to_numpy()[zero]
    used = np.zeros((len(names), len(full)), np.uint64)
    np.bitwise_or.at(used, (group[~zero], word[~zero]), bits[~zero])
    word = np.r_[word[~zero], np.tile(np.arange(len(full)), len(names))]
    bits = np.r_[bits[~zero], (full & ~used).ravel()]
    p = np.r_[p[~zero], np.repeat(p[zero], len(full))]
    group = np.r_[group[~zero], np.repeat(np.arange(len(names)), len(full))]
    order = np.lexsort((word, group))
    left, right = np.flatnonzero(~later), np.flatnonzero(later) if high != low else np.arange(len(names))
    found = list(joint_sums(word[order], group[order], p[order], bits[order], left, right))
    out = pd.DataFrame([(rows["lang"][0], names[a], names[b], int(v)) for a, more, each in found for b, v in zip(more, each)],
                       columns=["lang", "source", "item", "value"])
    return out.astype({"lang": object, "source": object, "item": object, "value": np.int64})


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
                      top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of each language are apart, and by which terms.

    Part ``pair`` has each other source of the language with the summed divergence, of all ranks; part ``term`` the terms
    that a source has more often than its language, up to rank ``top``. Ranks fall with the value, then rise with the
    item's bytes. Null texts, languages and sources count as empty text; a group without terms has zero counts. A
    language none of whose terms is in ``least_docs`` documents has values of 0 and no terms. Repeated rows count each.
    An empty table gives no rows; other columns, whatever their names, are not read.
    """
    stages = Stages(docs.sparkSession)
    counts = stages.write(term_counts(docs, text, lang, source))
    groups = lookup(counts.where("term = ''").select("lang", "source"))
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"))
    kept = kept.where(F.col("docs") >= least_docs).drop("docs")
    # terms of similar frequency share a word; a term is known by its place in the written table
    kept = kept.repartitionByRange(F.col("lang"), F.col("total").desc(), F.col("term")).sortWithinPartitions("lang", F.desc("total"), "term")
    kept = stages.write(kept.withColumn("place", F.monotonically_increasing_id()))
    each = stages.write(counts.where("term <> ''").drop("docs").join(kept, ["lang", "term"]))
    stages.drop(counts)

    per_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all_n"))
    per_group = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sums = groups.join(per_lang, "lang").join(per_group, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sums = lookup(sums.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")))

    # bitsets per group, word and count; every group takes part in every block of its language, if only with zeros
    held = F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit")
    number = F.floor(F.col("place") / 64)
    place = [F.floor(number / block).alias("block"), (number % block).cast("int").alias("word")]
    full = stages.write(kept.select("lang", *place, held).groupBy("lang", "block", "word").agg(F.bit_or("bit").alias("bits")))
    bits = each.select("lang", "source", *place, "count", held).groupBy("lang", "block", "source", "word", "count").agg(F.bit_or("bit").alias("bits"))
    columns = ["lang", "block", "source", "tile", "tiles", "word", "p", "bits"]
    level = bits.join(sums, ["lang", "source"]).withColumn("p", probability("count", "n", "terms")).select(*columns)
    zero = full.select("lang", "block").distinct().join(sums, "lang").withColumn("p", probability("0L", "n", "terms"))
    zero = zero.withColumns({"word": F.lit(-1), "bits": F.lit(0).cast("long")}).select(*columns)
    number = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = level.unionAll(zero).withColumn("other", number)
    dealt = dealt.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    terms = full.join(tiles, "lang").withColumn("low", number).withColumn("high", F.explode(F.sequence(F.col("low"), F.col("tiles") - 1)))
    terms = terms.withColumns({"source": F.lit(""), "tile": F.lit(-1), "p": F.lit(0).cast("long")})
    columns = ["lang", "block", "low", "high", "tile", "source", "word", "p", "bits"]
    units = dealt.select(*columns).unionAll(terms.select(*columns)).groupBy("lang", "block", "low", "high")
    parts = units.applyInPandas(_unit, "lang string, source string, item string, value long")
    value = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = value.unionAll(value.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))

    above = each.join(sums, ["lang", "source"]).withColumns({"p": probability("count", "n", "terms"), "q": probability("total", "all_n", "terms")})
    above = above.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return out(pairs, "pair").unionAll(out(above, "term").where(F.col("rank") <= top))
