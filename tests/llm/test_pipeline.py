"""The stages on a small table with planted cases, and the registered queries on the driver's smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests_llm import table

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    words = lambda k, n: " ".join(f"{'abcdefg'[(k + j) % 7]}{(k * 31 + j * j * (k + 3)) % 211}" for j in range(n))
    passage = words(999, 30)
    docs = [(k, words(k, 60) + ".\n" + words(k + 5_000, 40)) for k in range(120)]
    docs = [(k, t + (" you awful grumbler" if k % 5 == 0 else "")) for k, t in docs]
    docs[11] = (11, words(11, 30) + " " + passage + " " + words(12_000, 30))
    docs[12] = (12, docs[13][1] + " end")
    docs[14] = (14, docs[1][1].split("\n")[0] + "\n" + words(7_777, 50))
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), dict(docs), passage


def test_each_stage_takes_effect(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns, name
        assert docs.where("n_chars <> char_length(text)").isEmpty()
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, lines, near, clean = kept
    assert set(toxic) == {k for k in texts if k % 5}
    assert set(lines) == set(toxic) and lines[14] == texts[14].split("\n")[1] and lines[1] == texts[1]
    assert set(near) == set(lines)
    assert passage not in clean[11] and clean[11].split()[:30] == texts[11].split()[:30] and set(clean) == set(near)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == set(clean)


def test_near_copies_go(spark, folder):
    path, texts, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, path).collect()}
    assert left == set(texts) - {13}


def test_near_copies_from_four_fifths_on_go(spark, folder):
    path, _, _ = folder
    base = [f"u{k}" for k in range(104)]  # 100 shingles; ten new words at an end leave 90 of 110, fifteen leave 85 of 115
    near, far = [*base[10:], *(f"n{k}" for k in range(10))], [*base[:89], *(f"f{k}" for k in range(15))]
    docs = table(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))])
    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, path)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_run_is_all_stages(spark, folder):
    path, texts, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == {k for k in texts if k % 5} and sum(r["length"] for r in rows) > 5_000
    by_doc = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(by_doc.values()) == sum(r["length"] for r in rows)


def test_stages_stand_empty_and_null(spark, folder):
    path, _, _ = folder
    for rows in ([], [(1, None), (None, ""), (2, " "), (2, " "), (None, None)]):
        docs = table(spark, rows).withColumnRenamed("n", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() >= 0


def test_names_of_the_queries():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {m[0] for x in names if (m := re.match(r"op\d+", x))} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


@pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", ["op4_line_dedup", "op8_exact_dedup"])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted(map(tuple, entry.queries()[name](spark, str(FOLDER)).select(*columns).collect()))
    assert got == sorted(want.fetchall())
