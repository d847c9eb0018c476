"""Language-model scores by a hidden Markov model over the whole vocabulary.

The frequent words are those with the largest counts over all training rows, at most ``HEAD``, and the texts are tokenized
once with them. The ``OWN`` most frequent ones are symbols of their own, so each has an emission of its own in every state;
any other word shares the emission of its ending (one of ``CLASSES``), and its chance within that class comes from its
exact count. The states of a hidden Markov model stay a table of bounded size that way, while every count is exact. Rare words meet their counts in one shuffle of (word, document) rows, so what the model gathers
grows with the corpus; nothing but bounded tables reaches the driver.

States are trained by Baum-Welch in ``ROUNDS`` rounds over all training rows, whose expected counts are summed across
partitions; a few rounds on a sample (``SAMPLE_ROUNDS``) only give the values to start from. A score is the forward recursion over the whole text plus the chances of
its rare words within their classes, so it is an exact log probability. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.llm.common import SPACED, Stages, chunked, mix, words_of
from driftline.llm.hmm import Layout, expected, forward, log10_likelihood

HEAD, OWN, CLASSES, STATES = 60_000, 8_000, 2_048, 8
#: About so many training rows give the start values of the states.
STATE_ROWS = 1_500
SAMPLE_ROUNDS, ROUNDS = 10, 4
#: Tokens that are worked on together.
GROUP = 250_000
END = 0


def word_class(low: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of a word by its last three bytes."""
    value = np.zeros(len(ends), np.uint64)
    for k in (1, 2, 3):
        there = ends - k >= starts
        value = value * np.uint64(257) + np.where(there, low[np.where(there, ends - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(value) % np.uint64(CLASSES)).astype(np.int64)


def _head_counts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        low, starts, ends, _, words = words_of(batch.column("_text"), SPACED)
        key, at, n = np.unique(words, return_index=True, return_counts=True)
        group = word_class(low, ends[at], starts[at])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(group), pa.array(n)], schema=schema)


def _tokenized(batches: Iterator[pa.RecordBatch], head: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per text, and at the end of a partition one row with its counts of frequent words."""
    part, row = TaskContext.get().partitionId() << 40, 0
    order = np.argsort(head)
    ordered = head[order]
    counts, rare = np.zeros(len(head) + 1, np.int64), pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())]))
    for batch in chunked(batches, "_text"):
        low, starts, ends, first, words = words_of(batch.column("_text"), SPACED)
        texts = batch.num_rows
        text = np.repeat(np.arange(texts), np.diff(first))
        place = np.minimum(np.searchsorted(ordered, words), max(len(head) - 1, 0))
        known = ordered[place] == words if len(head) else np.zeros(len(words), bool)
        group = word_class(low, ends, starts)
        symbol = np.where(known, (order[place] if len(head) else 0) + 1, len(head) + 1 + group)
        held = batch.column("_held").to_numpy(zero_copy_only=False)
        used = known & ~held[text]
        counts += np.bincount(symbol[used], minlength=len(counts))[: len(counts)]
        counts[END] += int((~held).sum())
        t, w, g = text[~known], words[~known], group[~known]
        by = np.lexsort((w, t))
        t, w, g = t[by], w[by], g[by]
        new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])][: len(w)])
        n = np.diff(np.r_[new, len(w)])
        struct = pa.StructArray.from_arrays([pa.array(w[new].view(np.int64)), pa.array(n), pa.array(g[new])], ["word", "n", "cls"])
        symbols = symbol.astype(np.uint16)
        yield pa.RecordBatch.from_arrays([
            pa.array(part + row + np.arange(texts)), batch.column("_key"), pa.array(held), pa.array(np.diff(first) + 1),
            pa.array([np.append(symbols[a:b], np.uint16(END)).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
            pa.ListArray.from_arrays(np.searchsorted(t[new], np.arange(texts + 1)).astype(np.int32), struct).cast(rare),
            pa.nulls(texts, schema.field(6).type),
        ], schema=schema)
        row += texts
    if counts.any():
        some = np.flatnonzero(counts)
        pairs = pa.array([[{"symbol": int(s), "n": int(counts[s])} for s in some]], schema.field(6).type)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, schema.field(i).type) for i in range(6)), pairs], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches of about ``GROUP`` symbols, with the symbols."""
    for batch in batches:
        sequences = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(column)]
        total = np.cumsum([len(s) for s in sequences])
        at = 0
        while at < len(sequences):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + GROUP, "right")))
            yield batch.slice(at, to - at), sequences[at:to]
            at = to


def _expected(batches: Iterator[pa.RecordBatch], model: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Expected counts of a partition: rows (kind, place, one count per state)."""
    size, states = model["emission"].shape
    starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
    for _, sequences in _groups(batches, "symbols"):
        layout = Layout(np.array([len(s) for s in sequences]))
        symbols = layout.arrange([model["code"][s] for s in sequences])
        s, m, e = expected(layout, symbols, model["emission"], model["start"], model["move"])
        starts, moves, emissions = starts + s, moves + m, emissions + e
    some = np.flatnonzero(emissions.any(axis=1))
    kind = np.r_[0, np.ones(states, int), np.full(len(some), 2)]
    place = np.r_[0, np.arange(states), some]
    rows = np.concatenate([starts[None, :], moves, emissions[some]])
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(place), *(pa.array(rows[:, s]) for s in range(states))], schema=schema)


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach, as fine as a sixteenth of a doubling; exact below 16."""
    place = F.floor(F.log2(F.col("n")) * 16)
    steps = counts.groupBy(place.alias("place")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("place")).collect()  # bounded: 16 rows a doubling
    words, least = 0, 1 << 62
    for step in steps:
        words += step["words"]
        if words > most:
            break
        least = step["least"]
    return least


def baum_welch(tokens: DataFrame, model: dict, weights: np.ndarray) -> dict:
    """One round over the sequences of ``tokens``: expected counts summed across partitions, then new probabilities."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    size, states = model["emission"].shape
    names = [f"s{i}" for i in range(states)]
    ddl = "kind long, place long, " + ", ".join(f"{n} double" for n in names)
    arrow, shared = to_arrow_schema(StructType.fromDDL(ddl)), tokens.sparkSession.sparkContext.broadcast(model)
    found = tokens.select("symbols").mapInArrow(lambda b: _expected(b, shared.value, arrow), ddl)
    rows = found.groupBy("kind", "place").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # bounded: symbols x states
    shared.unpersist()
    counts = rows[names].to_numpy()
    kind, place = rows["kind"].to_numpy(), rows["place"].to_numpy()
    start, move, emission = np.full(states, 0.1), np.full((states, states), 0.1), weights[:, None] * np.full(states, 50.0)
    start += counts[kind == 0].sum(axis=0)
    move[place[kind == 1]] += counts[kind == 1]
    emission[place[kind == 2]] += counts[kind == 2]
    return model | {"start": start / start.sum(), "move": move / move.sum(axis=1, keepdims=True), "emission": emission / emission.sum(axis=0)}


def _first_guess(weights: np.ndarray, code: np.ndarray, states: int) -> dict:
    draw = np.random.default_rng(7)
    emission = weights[:, None] * draw.gamma(1.0, size=(len(weights), states)) + 1e-12
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return {"code": code, "start": np.full(states, 1 / states), "move": move / move.sum(axis=1, keepdims=True), "emission": emission / emission.sum(axis=0)}


def _forward_scores(batches: Iterator[pa.RecordBatch], model: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Forward likelihood, count of known words and log counts of the frequent words of each text."""
    for batch, sequences in _groups(batches, "symbols"):
        layout = Layout(np.array([len(s) for s in sequences]))
        symbols = layout.arrange([model["code"][s] for s in sequences])
        _, scale = forward(layout, model["emission"][symbols], model["start"], model["move"])
        own = layout.arrange([s.astype(np.int64) for s in sequences])
        sums = []
        for table in (model["within"], model["log_count"], model["known"]):
            out = np.empty(len(sequences))
            out[layout.order] = np.bincount(layout.sequence, table[own[layout.place]], len(sequences))
            sums.append(out)
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("row", "key", "held", "n")), pa.array(log10_likelihood(layout, scale) + sums[0]),
            pa.array(sums[1]), pa.array(sums[2].astype(np.int64)),
        ], schema=schema)


def language_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out. A token is a run without ASCII white space, with A-Z lower-cased; each
    text ends in one end token, so null, empty and blank texts have one. ``base_score`` is the add-one unigram score,
    ``score`` the model's, both log10. Rows that repeat are scored each; an empty table gives no rows, and without
    training rows every word is unseen. Other columns, whatever their names, are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark, stages = docs.sparkSession, Stages(docs.sparkSession)
    schema_of = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    kind = docs.select(key).schema[0].dataType.simpleString()
    plain = docs.select(F.col(key).alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text).alias("_text"))

    # frequent words, by their exact counts; partitions add up their own before the shuffle
    train = plain.where(~F.col("_held"))
    rows = train.count()
    ddl = "word long, cls long, n long"
    head_schema = schema_of(ddl)
    counts = train.select("_text").mapInArrow(lambda b: _head_counts(b, head_schema), ddl).groupBy("word", "cls").agg(F.sum("n").alias("n"))
    counts = stages.write(counts)
    chosen = counts.where(F.col("n") >= least_count(counts, HEAD)).toPandas()  # bounded: at most HEAD rows
    stages.drop(counts)
    chosen = chosen.sort_values(["n", "word"], ascending=[False, True])
    head = chosen["word"].to_numpy(np.int64).view(np.uint64)
    own = min(OWN, len(head))

    # one pass over the texts
    ddl = (f"row long, key {kind}, held boolean, n long, symbols binary, rare array<struct<word:long,n:long,cls:long>>, "
           "counts array<struct<symbol:long,n:long>>")
    token_schema, shared_head = schema_of(ddl), spark.sparkContext.broadcast(head)
    # texts of like length lie together, so that the recursions run over many of them to the end
    table = stages.write(plain.mapInArrow(lambda b: _tokenized(b, shared_head.value, token_schema), ddl).sortWithinPartitions("n"))
    tokens = table.where("row is not null")

    # exact counts: frequent words by symbol, rare ones by shuffle
    counted = table.where("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.symbol").agg(F.sum("c.n").alias("n")).collect()
    count = np.zeros(len(head) + 1, np.int64)
    for r in counted:
        count[r["symbol"]] = r["n"]
    trained = F.when(~F.col("held"), F.col("r.n")).otherwise(0)
    rare = tokens.select("row", "held", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"), F.col("r.cls").alias("cls"), trained.alias("t"))
    same = Window.partitionBy("word")
    rare = stages.write(rare.withColumn("c", F.sum("t").over(same)).withColumn("first", F.col("row") == F.min("row").over(same)).drop("t", "word"))
    of_class = rare.where("first").groupBy("cls").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("kinds")).collect()  # bounded: classes
    class_n, class_kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in of_class:
        class_n[r["cls"]], class_kinds[r["cls"]] = r["n"], r["kinds"]
    total = int(count.sum() + class_n.sum())
    kinds = int((count > 0).sum() + class_kinds.sum())

    # symbols: own ones, then classes; frequent words beyond the own ones count in their class
    group = chosen["cls"].to_numpy(np.int64)
    np.add.at(class_n, group[own:], count[own + 1 :])
    np.add.at(class_kinds, group[own:], count[own + 1 :] > 0)
    code = np.r_[0, np.arange(1, own + 1), own + 1 + group[own:], own + 1 + np.arange(CLASSES)]
    spread = class_n + class_kinds + 1
    within = np.zeros(len(code))
    within[own + 1 : len(head) + 1] = np.log10((count[own + 1 :] + 1) / spread[group[own:]])
    weights = np.r_[count[: own + 1] + 1.0, spread]
    weights /= weights.sum()
    model = _first_guess(weights, code, STATES)

    learning = tokens.where("not held")
    place = F.pmod(F.xxhash64("row"), F.lit(1_000_000))
    small = stages.write(learning.where(place < min(1_000_000, int(1_000_000 * STATE_ROWS / max(rows, 1)) + 1)).select("symbols").repartition(6))
    for _ in range(SAMPLE_ROUNDS):
        model = baum_welch(small, model, weights)
    for _ in range(ROUNDS):
        model = baum_welch(learning, model, weights)
    stages.drop(small)

    log_count = np.r_[np.log10(count + 1.0), np.zeros(CLASSES)]
    known = np.r_[(count > 0).astype(float), np.zeros(CLASSES)]
    shared = spark.sparkContext.broadcast(model | {"within": within, "log_count": log_count, "known": known})
    ddl = f"row long, key {kind}, held boolean, n long, score double, counts double, known long"
    score_schema = schema_of(ddl)
    scored = tokens.select("row", "key", "held", "n", "symbols").mapInArrow(lambda b: _forward_scores(b, shared.value, score_schema), ddl)
    classes = F.broadcast(spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.log10(spread))], "cls long, spread double"))
    more = rare.join(classes, "cls").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_counts"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - F.col("spread"))).alias("rare_within"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    none = F.lit(0.0)
    return scored.join(more, "row", "left").select(
        F.col("key").alias(key), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counts") + F.coalesce("rare_counts", none) - F.col("n") * float(np.log10(total + kinds + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_within", none)).alias("score"),
    )
