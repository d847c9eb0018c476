import random
import re
from collections import defaultdict

import numpy as np

from driftline.llm.graph import components
from driftline.llm.common import Stages
from driftline.llm.near_dedup import drop_near_duplicates, links_of, near_groups
from driftline.llm.setsketch import joint_estimate, registers
from tests_llm import AWKWARD


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=repr)


def near_copies(seed=3):
    draw = random.Random(seed)
    pool = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(6):
        base = [draw.choice(pool) for _ in range(draw.choice([4, 30, 120, 400]))]
        for _ in range(25 if g else 80):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(text) // 60))):
                text[draw.randrange(len(text))] = draw.choice(pool)
            rows.append(" ".join(text).upper() if draw.random() < 0.2 else "\n".join(text))
    rows += rows[:40]
    ids = draw.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def test_groups_against_brute_force(made):
    rows = near_copies()
    got = sorted(map(tuple, near_groups(made(rows).repartition(7)).collect()), key=repr)
    assert got == brute(rows)


def test_blocks_of_a_family_give_the_same(made):
    rows = near_copies(8)
    got = sorted(map(tuple, near_groups(made(rows), block=16).collect()), key=repr)
    assert got == brute(rows)


def test_awkward_and_empty(awkward, empty):
    assert sorted(map(tuple, near_groups(awkward).collect()), key=repr) == brute(AWKWARD)
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([5, 6, 7, None, 8, 2, 10, 11, 12, 13, 14], key=repr)
    assert near_groups(empty).count() == drop_near_duplicates(empty).count() == 0


def test_estimate_is_near_the_truth_and_registers_merge():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 2**63, 3000).astype(np.uint64)
    for n, m, both in ((900, 900, 830), (300, 200, 190), (500, 500, 0), (40, 40, 38)):
        a, b = pool[:n], np.r_[pool[:both], draw.integers(0, 2**63, m - both).astype(np.uint64)]
        r = registers(np.r_[a, b], np.array([0, n, n + m]), 337)
        merged = registers(np.union1d(a, b), np.array([0, len(np.union1d(a, b))]), 337)
        assert (np.maximum(r[0], r[1]) == merged[0]).all()
        more, equal = (r[0] > r[1]).sum(), (r[0] == r[1]).sum()
        got = joint_estimate(*(np.array([x]) for x in (more, 337 - more - equal, equal, n, m)))
        assert abs(got[0] - both / (n + m - both)) < 0.12


def test_one_unit_links_like_brute_force():
    rows = [(i, t) for i, t in near_copies(5)][:80]
    sets = [np.array(sorted(hash(x) % 2**61 for x in shingles(t)), np.uint64) for _, t in rows]
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    links = links_of(sets, registers(np.concatenate(sets), first, 337), np.zeros(80, int), 85)
    parent = list(range(80))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    names = defaultdict(set)
    for (i, _, c, _) in brute(rows):
        names[c].add(i)
    mine = defaultdict(set)
    for k, (i, _) in enumerate(rows):
        mine[root(k)].add(i)
    assert sorted(map(sorted, names.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 90)] + [(160, 7), (300, 301), (4, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Stages(spark)).collect()}
    want = {k: 5 for k in [*range(5, 90), *range(100, 161)]} | {300: 300, 301: 300}
    assert got == want
