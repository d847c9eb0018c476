import random
import re
from collections import defaultdict

import numpy as np
import pytest

from driftline.llm.decontaminate import find_leaks, remove_leaks
from driftline.llm.fm_index import FMIndex
from tests_llm import AWKWARD, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].update(() if i is None else (str(i),))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def made_up(seed=4):
    draw = random.Random(seed)
    pool = ["the", "a", "é", "x1", "of", "Zz", "no"]
    items = [(k, " ".join(draw.choice(pool) for _ in range(draw.choice([1, 3, 10, 14, 25])))) for k in range(12)]
    items += [(90, None), (91, ""), (92, "!!"), (93, items[0][1])]
    docs = []
    for k in range(60):
        parts = [" ".join(draw.choice([*pool, "q", "r"]) for _ in range(draw.randint(0, 30)))]
        if k % 3 == 0:
            parts.insert(draw.randint(0, 1), draw.choice(items[:12])[1].upper().replace(" ", " - "))
        docs.append((k, ". ".join(parts)))
    return docs, items


def test_index_finds_every_occurrence():
    draw = np.random.default_rng(1)
    for _ in range(25):
        n, texts = draw.integers(1, 60), draw.integers(1, 6)
        w = draw.integers(0, 3, n).astype(np.uint64)
        first = np.r_[0, np.sort(draw.integers(0, n + 1, texts - 1)), n]
        index = FMIndex(w, first, 4)
        for m in (1, 2, 4):
            phrases = np.unique(draw.integers(0, 4, (8, m)).astype(np.uint64), axis=0)
            got = sorted((int(p), int(x)) for a, b in index.occurrences(phrases, 3) for p, x in zip(a, b))
            want = [(p, i) for p in range(len(phrases)) for t in range(texts) for i in range(first[t], first[t + 1] - m + 1) if (w[i : i + m] == phrases[p]).all()]
            assert got == sorted(want)


@pytest.mark.parametrize("pass_words", [2_000_000, 40, 1])
def test_hits_against_brute_force(spark, made, pass_words):
    docs, items = made_up()
    found = find_leaks(made(docs), spark.createDataFrame(items, "item_id long, text string"), pass_words=pass_words)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute(docs, items)
    for r in found.collect():
        assert sum(s["after"] - s["first"] for s in r["spans"]) == r["n_hit"]


def test_nothing_is_left_after_removal(spark, made, awkward):
    docs, items = made_up(9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    cleaned = remove_leaks(made(docs), bench)
    rows = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    assert all(n == 0 for _, _, n, _ in brute(rows, items))
    clean = {i for i, _, n, _ in brute(docs, items) if not n}
    assert {i: t for i, t in rows if i in clean} == {i: t for i, t in docs if i in clean}
    assert sorted((r["text"] for r in remove_leaks(awkward, bench.limit(0)).collect()), key=repr) == sorted((t for _, t in AWKWARD), key=repr)


def test_awkward_and_empty(spark, awkward, empty):
    items = [(1, "the same text twice"), (2, " ".join(f"w{i % 977}x{i % 31}" for i in range(5_000, 5_020)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in find_leaks(awkward, bench).collect()]
    assert sorted(got, key=repr) == brute(AWKWARD, items)
    assert find_leaks(empty, bench).count() == remove_leaks(empty, bench).count() == 0
    assert find_leaks(awkward, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert remove_leaks(table(spark, []), bench).columns == empty.columns


def cut_by_hand(text, items):
    """Spans of all windows on the text as it is, cut together, until nothing is found."""
    windows = {tuple(w[k : k + n]) for _, t in items for w in [words(t)] for n in [min(10, len(w))] if n for k in range(len(w) - n + 1)}
    while True:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        at = [(m.start(), m.end()) for m in WORD.finditer(low)]
        w, hit = words(text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit:
            return text
        out, last, k = [], 0, 0
        while k < len(w):
            if k in hit:
                end = k
                while end + 1 in hit:
                    end += 1
                out.append(text[last : at[k][0]])
                last, k = at[end][1], end
            k += 1
        text = "\n".join([*out, text[last:]])


@pytest.mark.parametrize("pass_words", [2_000_000, 40, 1])
def test_overlapping_items_repeated_and_missing_ids_in_any_number_of_parts(spark, made, pass_words):
    run = [f"w{k}" for k in range(25)]
    docs = [(None, "aa " + " ".join(run[:20]) + " bb"), (None, "nothing here"), (4, "x " + " ".join(run)), (4, "x " + " ".join(run)),
            (4, "another text"), (5, "p q r s")]
    items = [(1, " ".join(run[:12])), (2, " ".join(run[5:20])), (2, " ".join(run[10:25])), (1, "q r"), (None, "p q"), (3, None), (3, "r s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(made(docs), bench, pass_words=pass_words).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=repr) == brute(docs, items)
    left = remove_leaks(made(docs), bench, pass_words=pass_words).collect()
    want = [(i, cut_by_hand(t, items)) for i, t in docs]
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=repr) == sorted(((i, t) for i, t in want if words(t)), key=repr)
    assert (None, "aa \n bb") in want


def test_registered_query_has_the_digest_of_the_sorted_ids(spark, tmp_path):
    import hashlib

    from driftline.llm.queries import QUERIES

    docs, items = made_up(3)
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in QUERIES["op2_decontaminate"](spark, str(tmp_path)).collect()]
    want = [(i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in brute(docs, items)]
    assert sorted(got) == sorted(want)
