"""Toxicity, quality and language identification: hand-made cases and held-out accuracy on the driver tables."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import kneser_ney, language_id, quality, queries, toxicity
from tests_llm import AWKWARD

FOLDER = Path("/root/testdata/sf0.01")
tables = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def two_classes(made):
    docs = [(k, f"some ordinary words {k % 7} in a row about nothing {'you awful grumbler' if k % 4 == 0 else 'and so on'}") for k in range(400)]
    return made(docs), [(k, int(k % 4 == 0), k % 4) for k in range(400)]


def test_kneser_ney_sums_to_one():
    words = [b"abc", b"abd", b"b", b"abca", b"dd"]
    low, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    gram, _ = kneser_ney.grams(low, ends - [len(w) for w in words], ends)
    key, at = np.unique(gram, return_inverse=True)
    count = np.stack([np.bincount(at[:8], minlength=len(key)), np.bincount(at[8:], minlength=len(key))], 1)
    model = kneser_ney.Model(key, count.astype(float))
    for head in (b"", b"a", b"ab", b"zz"):
        nexts = np.array([2, *range(3, 256), 0, 1])
        context = [1, *head]
        keys = np.array([sum(b << (8 * i) for i, b in enumerate([n, *context[::-1]])) | (len(context) + 1) << 56 for n in nexts], np.int64)
        found, place = model.full.find(keys)
        known, where = model.contexts.find(kneser_ney.context(keys))
        below = model._shared(kneser_ney.shorter(keys))
        for c in (0, 1):
            log = np.where(found, model.full.values[c][place], below + np.where(known, model.contexts.values[c][where], 0))
            assert abs(np.exp(log).sum() - 1) < 1e-3


def test_toxic_words_are_learned(spark, made, awkward, empty):
    docs, marks = two_classes(made)
    fitted = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int, grade int"))
    rows = made([(1, "grumbler"), (2, "nothing in a row"), (3, "AWFUL awful!"), (4, None), (5, "some ordinary words about nothing")])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, fitted).collect()}
    assert min(got[1], got[3]) > 0.7 > 0.5 > max(got[2], got[4], got[5])
    assert {r["doc_id"] for r in toxicity.drop_toxic(rows, fitted).collect()} == {2, 4, 5}
    scored = toxicity.score(awkward, fitted)
    assert scored.count() == len(AWKWARD) and scored.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score(empty, fitted).count() == 0 and toxicity.drop_toxic(empty, fitted).columns == empty.columns
    nothing = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(awkward, nothing).where("score > 0.5").isEmpty()


def test_grades_are_ordered(spark, made, awkward, empty):
    docs = made([(k, " ".join(["good fine well", "fair so so", "bad poor broken", "junk junk junk"][k % 4].split()[: 2 + k % 2]) + f" x{k % 5}") for k in range(400)])
    ratings = spark.createDataFrame([(k, 3 - k % 4) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, rating int")
    fitted = quality.fit(docs, ratings)
    assert (np.diff(quality.thresholds(fitted["free"])) > 0).all() and fitted["grades"] == [0, 1, 2, 3]
    rows = quality.grade(made([(1, "good fine"), (2, "fair so"), (3, "bad poor"), (4, "junk junk")]), fitted).orderBy("doc_id").collect()
    values = [r["expected_grade"] for r in rows]
    assert values == sorted(values, reverse=True) and values[0] > values[3] + 1
    assert all(list(r["tails"]) == sorted(r["tails"], reverse=True) for r in rows)
    assert quality.grade(awkward, fitted).count() == len(AWKWARD) and quality.grade(empty, fitted).count() == 0
    alone = quality.fit(docs, ratings.where("rating = 2"))
    assert {r["expected_grade"] for r in quality.grade(awkward, alone).collect()} == {2.0}


def test_gradient_of_the_cumulative_link():
    draw = np.random.default_rng(0)
    value, grade, free = draw.normal(size=9), draw.integers(0, 4, 9), np.array([-0.5, 0.1, -0.3])

    def likelihood(v, f):
        over, rows = quality.tails(v, f), np.arange(len(v))
        return np.log(np.c_[np.ones(9), over][rows, grade] - np.c_[over, np.zeros(9)][rows, grade]).sum()

    by_row, by_cut = quality.gradients(value, grade, free)
    for i in range(9):
        d = 1e-6 * (np.arange(9) == i)
        assert abs(by_row[i] - (likelihood(value + d, free) - likelihood(value - d, free)) / 2e-6) < 1e-4
    for i in range(3):
        d = 1e-6 * (np.arange(3) == i)
        assert abs(by_cut[i] - (likelihood(value, free + d) - likelihood(value, free - d)) / 2e-6) < 1e-4


def test_language_of_known_and_unseen_words(spark, made, awkward, empty):
    rows = [(k, f"the thing is running and singing {k}", "en") for k in range(60)] + [(100 + k, f"der Mann hat einen Hund gesehen {k}", "de") for k in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", "text")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(made([(1, "THE thing"), (2, "hat gesehen"), (3, "winging"), (4, "Hundes"), (5, "12 ..."), (6, None), (7, "中文")]), model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6)] == ["en", "de", "en", "de", "und", "und"] and got[7][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got.values())
    predicted = language_id.predict(awkward, model)
    assert predicted.count() == len(AWKWARD)
    assert {r["doc_id"] for r in predicted.where("lang_pred = 'und'").collect()} == {5, 6, 7}
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), "lang", "text")
    assert {r["lang_pred"] for r in language_id.predict(awkward, nothing).collect()} == {"und"}


def test_grams_are_all_pieces_of_up_to_four(spark):
    got = spark.createDataFrame([("abc",), ("a",)], "w string").select(language_id.grams(F.col("w")).alias("g")).collect()
    assert [sorted(r["g"]) for r in got] == [sorted(m[i : i + n] for n in (1, 2, 3, 4) for i in range(len(m) - n + 1)) for m in ("^abc$", "^a$")]


def test_no_word_of_a_small_language_is_cut(spark, made):
    letters = "abcdefghij"
    word = lambda k: "".join(letters[int(d)] for d in f"{k:06d}")
    common = " ".join(word(k) for k in range(160_000))
    rows = [(k, common, "big") for k in range(2)] + [(9, "zuvor zuvielerlei", "small")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", "text")
    assert len(model["key"]) == 160_002
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(made([(1, "zuvor"), (2, "zuvielerlei"), (3, word(159_999))]), model).collect()}
    assert got == {1: "small", 2: "small", 3: "big"}


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("lang"))
    one = language_id.sample_per_label(rows, "lang", "doc_id", 500)
    counts = {r["lang"]: r["count"] for r in one.groupBy("lang").count().collect()}
    assert all(400 < n < 600 for n in counts.values())
    assert one.exceptAll(language_id.sample_per_label(rows.repartition(9), "lang", "doc_id", 500)).isEmpty()


@tables
def test_held_out_toxicity(spark, labels):
    rows = queries.toxicity(spark, str(FOLDER)).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.8
    assert rows[rows["toxic"] == 0]["predicted"].mean() < 0.05


@tables
def test_held_out_quality(spark, labels):
    rows = queries.quality(spark, str(FOLDER)).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows["p_above_0"].to_numpy(), rows["quality"].to_numpy()) > 0.97


@tables
def test_held_out_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = queries.language_id(spark, str(FOLDER)).join(docs, "doc_id").where("held_out").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97


def test_features_of_blank_texts():
    first, slots, values = quality.features(pa.array([None, "", " ", "a b"], pa.string()))
    assert len(first) == 5 and np.isfinite(values).all() and slots.max() < quality.SLOTS + quality.RATIOS
