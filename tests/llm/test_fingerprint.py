import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftline.llm.fingerprint import PERMUTATIONS, edits, families, fingerprints, of_texts
from tests_llm import AWKWARD


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def half(text, following):
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def drawn(seed=2, docs=150):
    draw = random.Random(seed)
    pool = [f"w{k}" for k in range(400)] + ["É", "中文", "😀x"]
    rows, texts = [], []
    for _ in range(docs):
        text = [draw.choice(pool) for _ in range(draw.choice([0, 1, 3, 40, 300]))]
        if texts and draw.random() < 0.3:
            text = list(draw.choice(texts))
            for _ in range(len(text) // 80):
                text[draw.randrange(len(text))] = draw.choice(pool)
        texts.append(text)
        rows.append(draw.choice([" ", "\n"]).join(text))
    return list(zip(draw.sample(range(-500, 5000), docs), rows))


def test_edits_against_brute_force(made):
    rows = drawn()
    rows.sort(key=lambda r: -r[0])
    want = {}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = half(t, following)
        want[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), jaccard(t, new), jaccard(t, following))
    for parts in (1, 7, 40):
        docs = made(random.Random(parts).sample(rows, len(rows))).repartition(parts)
        got = {r["doc_id"]: r for r in edits(docs).collect()}
        assert got.keys() == want.keys()
        for i, (n, sha, to_edited, to_next) in want.items():
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
            assert abs(r["near_edited"] - to_edited) < 0.25 and abs(r["near_next"] - to_next) < 0.25
        error = [got[i]["near_edited"] - w[2] for i, w in want.items()]
        assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_more_partitions_than_rows(spark, made):
    rows = drawn(5, 6)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["doc_id"]: r["edited_sha256"] for r in edits(made(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows.sort(key=lambda r: -r[0])
    assert got == {i: hashlib.sha256(half(t, rows[(k + 1) % 6][1]).encode()).hexdigest() for k, (i, t) in enumerate(rows)}


def test_equal_texts_have_equal_fingerprints_which_do_not_depend_on_the_batch(made):
    rows = drawn(3)
    got = edits(made(rows + [(i + 10_000, t) for i, t in rows]).repartition(5)).select("doc_id", "fingerprint").collect()
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    alone = {r["doc_id"]: bytes(r["signature"]).hex() for r in fingerprints(made(rows)).collect()}
    for i, t in rows:
        assert by[i] == by[i + 10_000] == alone[i] == of_texts(pa.array([t]))[0].tobytes().hex()
        assert len(by[i]) == 4 * PERMUTATIONS


def test_awkward_rows(made, empty):
    assert edits(empty).count() == 0 and families(empty).count() == 0
    got = edits(made(AWKWARD).repartition(3)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (i for i, _ in AWKWARD)))
    rows = {r["doc_id"]: r for r in got}
    text = dict(AWKWARD)
    order = sorted((i for i in text if i is not None), reverse=True) + [None]
    for k, i in enumerate(order):
        if i == 8:
            continue
        assert rows[i]["edited_sha256"] == hashlib.sha256(half(text[i] or "", text[order[(k + 1) % len(order)]] or "").encode()).hexdigest()
    assert rows[6]["near_edited"] == 1.0 and rows[6]["near_next"] == 1.0
    twice = [r for r in got if r["doc_id"] == 8]
    assert sorted(r["near_next"] for r in twice) == [0.0, 1.0]
    alone = edits(made([(1, "one two three four five six")])).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 27


def test_one_key_for_many_rows(made):
    rows = [(7, f"text number {k % 40} of this key") for k in range(300)] + [(9, "first"), (1, "last")]
    got = edits(made(rows).repartition(8)).collect()
    assert len(got) == 302
    ends = {r["doc_id"]: r for r in got}
    assert ends[1]["edited_sha256"] == hashlib.sha256(b"lafi").hexdigest()


def test_families(made):
    rows = drawn(9, 300)
    got = {r["doc_id"]: r["family_id"] for r in families(made(rows).repartition(6)).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [(i, j) for a, (i, s) in enumerate(rows) for j, t in rows[:a] if shingles(s) and 5 * len(shingles(s) & shingles(t)) >= 4 * len(shingles(s) | shingles(t))]
    for i, j in links:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    want = {i: root(i) for i, _ in rows}
    assert all(want[i] == want[f] for i, f in got.items())  # only texts that are linked
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)
    assert families(made(AWKWARD)).count() == len(AWKWARD)
    awkward = {r["doc_id"]: r["family_id"] for r in families(made(AWKWARD)).collect()}
    assert awkward[None] is None and awkward[5] == 5 and awkward[3] == awkward[9] == 2 and awkward[8] == 8
