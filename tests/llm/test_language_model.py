import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from driftline.llm import language_model
from driftline.llm.common import in_fold
from driftline.llm.hmm import Layout, expected, forward, log10_likelihood
from tests_llm import AWKWARD


def tokens(text):
    return [x for x in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x] + [None]


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = Counter(x for i, t in rows if not held[i] for x in tokens(t))
    total, kinds = sum(count.values()), len(count)
    return sorted(((i, held[i], len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 6))
                   for i, w in ((i, tokens(t)) for i, t in rows)), key=repr)


def model(draw, states=3, symbols=5):
    share = lambda *s: (x := draw.random(s)) / x.sum(axis=-1, keepdims=True)
    return share(states), share(states, states), share(states, symbols).T


def paths(symbols, start, move, emission):
    """Sum over all state paths."""
    total = start * emission[symbols[0]]
    for x in symbols[1:]:
        total = np.array([sum(total[i] * move[i, j] for i in range(len(start))) * emission[x, j] for j in range(len(start))])
    return total.sum()


def test_forward_and_counts_are_exact():
    draw = np.random.default_rng(3)
    start, move, emission = model(draw)
    sequences = [draw.integers(0, 5, n) for n in (1, 4, 2, 7, 4, 1)]
    layout = Layout(np.array([len(s) for s in sequences]))
    symbols = layout.arrange(sequences)
    _, scale = forward(layout, emission[symbols], start, move)
    want = [math.log10(paths(s, start, move, emission)) for s in sequences]
    assert np.allclose(log10_likelihood(layout, scale), want)
    starts, moves, emissions = expected(layout, symbols, emission, start, move)
    assert math.isclose(starts.sum(), 6) and math.isclose(moves.sum(), len(symbols) - 6) and math.isclose(emissions.sum(), len(symbols))
    # a round of Baum-Welch never lowers the likelihood
    after = emissions / emissions.sum(axis=0)
    _, better = forward(layout, after[symbols], starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True))
    assert np.log(better).sum() >= np.log(scale).sum()


def made_up():
    return [(k, " ".join(f"{'ab'[k % 2]}{(k * 7 + j * j) % (40 if j % 3 else 900)}" for j in range(k % 60))) for k in range(400)]


def rounded(df):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    return sorted(((*(r[n] for n in names), round(r["base_score"], 6)) for r in df.collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 60)
    monkeypatch.setattr(language_model, "OWN", 20)
    monkeypatch.setattr(language_model, "SAMPLE_ROUNDS", 3)


def test_counts_against_brute_force(made, small):
    rows = made_up()
    got = language_model.language_scores(made(rows).repartition(5), in_fold("doc_id", 7, 2)).cache()
    for a, b in zip(rounded(got), brute(rows)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5
    held = got.where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_awkward_and_empty(awkward, empty, small):
    got = language_model.language_scores(awkward, in_fold("doc_id", 7, 2)).cache()
    for a, b in zip(rounded(got), brute(AWKWARD)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4
    assert got.where("score is null or isnan(score) or score > 0").isEmpty()
    assert language_model.language_scores(empty, in_fold("doc_id", 7, 2)).count() == 0


def test_training_reads_all_rows_and_words(spark, monkeypatch):
    # one word stands 40 times in each of six rows and nowhere else, whichever rows a sample takes
    rows = [(k, "x y" if k % 2 else "y z") for k in range(9_000)]
    for k in range(0, 9_000, 1_500):
        rows[k] = (k, " ".join([f"deep{k}"] * 40))
    train = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(x for _, t in train for x in t.split())
    monkeypatch.setattr(language_model, "HEAD", len(count))
    monkeypatch.setattr(language_model, "OWN", len(count))
    seen, own, round_of = [], [], language_model.baum_welch

    def watched(part, start, weights):
        seen.append(part.count())
        own.append(weights[1 : len(count) + 1])
        return round_of(part, start, weights)

    monkeypatch.setattr(language_model, "baum_welch", watched)
    language_model.language_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), in_fold("doc_id", 7, 2))
    assert seen[language_model.SAMPLE_ROUNDS :] == [len(train)] * language_model.ROUNDS and language_model.ROUNDS > 1
    share = sorted((own[0] / own[0].min()).tolist())
    want = sorted(n + 1 for _, n in count.most_common())
    assert np.allclose(share, np.array(want) / want[0])


def test_least_count_keeps_at_most_so_many_words(spark):
    import numpy as np

    from driftline.llm.language_model import least_count

    counts = np.random.default_rng(1).zipf(1.6, 5000).clip(max=10**12)
    df = spark.createDataFrame([(int(n),) for n in counts], "n long")
    for most in (0, 1, 30, 700, 2000, 5000, 9000):
        least = least_count(df, most)
        assert (counts >= least).sum() <= most
        steps = np.floor(np.log2(counts) * 16)
        left = steps[counts < least]
        assert not len(left) or (steps >= left.max()).sum() > most  # one step more would be too many
    assert least_count(df.limit(0), 10) == 1 << 62
