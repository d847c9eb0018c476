import numpy as np
import pytest

from driftline.operators import shuffles, threshold


@pytest.mark.parametrize("total", [1, 2, 3, 10, 97, 4096, 40_001])
def test_every_position_has_one_place(total):
    got = shuffles.permuted(0, total, total, shuffles.keys(1, "g", total))
    assert sorted(got.tolist()) == list(range(total))


def test_places_do_not_depend_on_the_cut():
    total, key = 100_003, shuffles.keys(7, "g")
    whole = shuffles.permuted(0, total, total, key)
    for begin, end in ((0, 10), (4090, 4100), (12_345, 90_000), (100_000, 100_003), (5, 5)):
        assert (shuffles.permuted(begin, end, total, key) == whole[begin:end]).all()


def test_every_position_and_every_pair_of_neighbours_is_as_likely():
    total, marked, reps = 9_000, 900, 400
    hits, both = np.zeros(total), 0
    for rep in range(reps):
        mark = shuffles.permuted(0, total, total, shuffles.keys(3, rep)) < marked
        assert mark.sum() == marked
        hits += mark
        both += int((mark[1:] & mark[:-1]).sum())
    by_part = hits.reshape(9, 1000).sum(axis=1)
    assert abs(by_part / by_part.mean() - 1).max() < 0.03
    spread = hits.var() / (reps * 0.1 * 0.9)
    assert 0.9 < spread < 1.1
    assert abs(both / (reps * (total - 1) * 0.01) - 1) < 0.03


def test_runs_are_as_long_as_by_chance():
    """Marked rows among 100 neighbours spread as a hypergeometric draw does."""
    total, marked = 20_000, 4_000
    shares = np.concatenate([
        (shuffles.permuted(0, total, total, shuffles.keys(5, rep)) < marked).reshape(-1, 100).sum(axis=1) for rep in range(60)])
    assert abs(shares.mean() - 20) < 0.01 and 0.93 < shares.var() / (100 * 0.2 * 0.8 * (total - 100) / (total - 1)) < 1.07


def test_numbers_beyond_32_bits():
    total = 3 * 10**12
    got = shuffles.permuted(total - 1000, total, total, shuffles.keys(1))
    assert len(set(got.tolist())) == 1000 and got.min() >= 0 and got.max() < total
    assert abs(got.mean() / total - 0.5) < 0.05


@pytest.mark.parametrize("limit", [40, 300])
def test_shuffled_stumps_do_not_depend_on_the_limit(spark, limit):
    draw = np.random.default_rng(5)
    rows = [(f"p{i % 2}", "r", float(round(draw.normal(), 3)) if i % 5 else 7.0, int(draw.random() < 0.2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "product string, recipe string, a double, flag int")
    run = lambda **kw: sorted(map(tuple, threshold.shuffled_stumps(df, ["product", "recipe"], ["a"], ["flag"], 6, **kw).collect()))
    plain = run()
    assert len(plain) == 12 and plain == run(limit=limit)


@pytest.mark.parametrize("before", [0, 700, 5_000])
def test_the_best_cut_of_a_unit_is_a_corner(before):
    """Whatever lies before the unit, one of the few corners has the best score of all its cuts."""
    draw = np.random.default_rng(before)
    total, positives = 40_000, 9_000
    for share in (0.05, positives / total, 0.9):
        mark = draw.random(4_000) < share
        cuts = np.sort(draw.choice(np.arange(1, 4_001), 1_500, replace=False))
        local = threshold._positives_before(mark, cuts)
        assert (local == np.cumsum(mark)[cuts - 1]).all() and (threshold._positives_before(mark, cuts[:50]) == local[:50]).all()
        corners = threshold._corners(cuts, local)
        assert len(corners) < 60
        n_left, p_left = cuts + 2 * before, local + before
        a, b = p_left / positives / 2, (n_left - p_left) / (total - positives) / 2
        score = (a * a + b * b) / (a + b) + ((0.5 - a) ** 2 + (0.5 - b) ** 2) / (1 - a - b)
        assert score[corners].max() == score.max()


def test_shuffled_stumps_against_brute_force(spark):
    draw = np.random.default_rng(8)
    rows = [("p", "r", float(round(draw.normal(), 1)), int(draw.random() < 0.3)) for _ in range(900)]
    df = spark.createDataFrame(rows, "product string, recipe string, a double, flag int")
    got = {r["rep"]: (r["rate_below"], r["rate_above"]) for r in threshold.shuffled_stumps(df, ["product", "recipe"], ["a"], ["flag"], 4, limit=100).collect()}
    values, positives = np.sort([r[2] for r in rows]), sum(r[3] for r in rows)
    for rep in range(4):
        mark = shuffles.permuted(0, 900, 900, shuffles.keys(0, "p|r", "a", rep)) < positives
        best = None
        for cut in np.flatnonzero(values[1:] != values[:-1]) + 1:
            if 10 <= cut <= 890:
                p = int(mark[:cut].sum())
                a, b = p / positives / 2, (cut - p) / (900 - positives) / 2
                score = round((a * a + b * b) / (a + b) + ((0.5 - a) ** 2 + (0.5 - b) ** 2) / (1 - a - b), 12)
                if best is None or score > best[0]:
                    best = (score, (round(p / cut, 5), round((positives - p) / (900 - cut), 5)))
        assert got[rep] == best[1]


def test_findings_are_counted_per_label(spark):
    scan = spark.createDataFrame([
        ("l1", "a", True, True, True), ("l1", "b", True, False, True), ("l1", "c", True, True, False), ("l2", "a", False, True, False),
    ], "label string, column string, passes_fwer boolean, passes_direction boolean, assigned boolean")
    pairs = spark.createDataFrame([("a", "l1"), ("b", "l1"), ("z", "l3")], "column string, label string")
    got = threshold.finding_counts(threshold.scan_findings(scan, pairs), scan).collect()
    assert {tuple(r) for r in got} == {("l1", 3, 1, 1, 0, 1, False), ("l2", 1, 0, 0, 0, 0, True), ("l3", 0, 0, 0, 1, 0, False)}
