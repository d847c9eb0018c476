import hashlib
import re
from collections import defaultdict

from driftline.llm.exact_dedup import exact_dedup, exact_groups, merge_round, runs
from tests_llm import AWKWARD


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        best = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        seen = False
        for i in ids:
            out.append((i, best, len(ids), i == best and not seen, sha))
            seen |= i == best
    return sorted(out, key=repr)


def test_awkward_rows(awkward):
    got = sorted(map(tuple, exact_groups(awkward).collect()), key=repr)
    assert got == brute(AWKWARD)


def test_many_partitions_and_a_large_group(made):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 50}") for i in range(600)]
    got = sorted(map(tuple, exact_groups(made(rows).repartition(40)).collect()), key=repr)
    assert got == brute(rows)


def test_a_round_keeps_counts_and_smallest(made):
    leaf = runs(made([(i, f"t{i % 7}") for i in range(100)]).repartition(20), "doc_id", "text")
    merged = merge_round(leaf, 0)
    assert merged.agg({"n": "sum"}).first()[0] == 100
    assert {r["best"]["id"] for r in merged.collect()} >= set(range(7))


def test_rows_that_stay(awkward, empty):
    kept = exact_dedup(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([5, 7, None, 8, 2, 10, 11, 12, 13, 14], key=repr)
    assert exact_groups(empty).count() == exact_dedup(empty).count() == 0
