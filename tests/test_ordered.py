"""Blocked and plain paths of the ordered operators against simple references."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import quantiles, sequence
from driftline.operators.ordered import Ordered, number_rows, running
from driftline.operators.selection import select_quantiles

LIMITS = [10_000, 60]  # plain windows, then blocks
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """One group holds half of the rows; one group key is null; some values are missing."""
    rng = np.random.default_rng(3)
    n = 600
    group = np.where(np.arange(n) < n // 2, "hot", rng.choice(["a", "b", None], n))
    value = np.round(rng.normal(0, 1, n), 2)
    value = [None if rng.random() < 0.04 else float(v) for v in value]
    order = rng.permutation(n)
    return pd.DataFrame({"g": group, "ts": [T0 + dt.timedelta(minutes=int(i)) for i in order], "id": order, "v": value})


@pytest.fixture(scope="module")
def frame(spark, rows):
    data = [tuple(None if x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else x for x in r)
            for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False)]
    data = [(g, t.to_pydatetime() if hasattr(t, "to_pydatetime") else t, int(i), v) for g, t, i, v in data]
    return spark.createDataFrame(data, "g string, ts timestamp_ntz, id bigint, v double")


def groups(rows):
    for g, part in rows.groupby("g", dropna=False):
        yield (None if isinstance(g, float) else g), part.sort_values(["ts", "id"])


def collect(df, key="id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("limit", LIMITS)
def test_row_numbers(frame, rows, limit):
    got = collect(number_rows(frame, ["g"], ["ts", "id"], limit=limit))
    assert len(got) == len(rows)
    for _, part in groups(rows):
        assert [got[i]["_rn"] for i in part["id"]] == list(range(1, len(part) + 1))


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_aggregates(frame, rows, limit, inclusive):
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}
    got = collect(running(frame, ["g"], ["ts", "id"], aggs, inclusive=inclusive, limit=limit))
    for _, part in groups(rows):
        seen = []
        for i, v in zip(part["id"], part["v"]):
            if inclusive and not pd.isna(v):
                seen.append(v)
            want = (sum(seen), max(seen), min(seen)) if seen else (None, None, None)
            row = got[i]
            for x, y in zip((row["s"], row["hi"], row["lo"]), want):
                assert x == pytest.approx(y) if y is not None else x is None
            if not inclusive and not pd.isna(v):
                seen.append(v)


@pytest.mark.parametrize("limit", LIMITS)
def test_rolling_needs_a_full_window(frame, rows, limit):
    seq = Ordered.of(frame, ["g"], ["ts", "id"], limit)
    assert seq.blocked == (limit < 300)
    got = collect(sequence.rolling(seq, ["v"]).df)
    for _, part in groups(rows):
        v = part["v"].astype(float)
        mean, std = v.rolling(10).mean(), v.rolling(10).std()
        for k, i in enumerate(part["id"]):
            row = got[i]
            if pd.isna(mean.iloc[k]):
                assert row["v__mean"] is None and row["v__slope"] is None
            else:
                window = v.iloc[k - 9:k + 1].to_numpy()
                assert row["v__mean"] == pytest.approx(mean.iloc[k])
                assert row["v__std"] == pytest.approx(std.iloc[k])
                assert row["v__diff"] == pytest.approx(window[-1] - window[0])
                assert row["v__slope"] == pytest.approx(np.polyfit(np.arange(10), window, 1)[0])


@pytest.mark.parametrize("limit", LIMITS)
def test_rolling_with_minimum(frame, rows, limit):
    got = collect(sequence.rolling_with_minimum(Ordered.of(frame, ["g"], ["ts", "id"], limit), ["v"]).df)
    for _, part in groups(rows):
        v = part["v"].astype(float)
        mean, delta = v.rolling(5, min_periods=2).mean(), v.diff()
        for k, i in enumerate(part["id"]):
            for x, y in ((got[i]["v_roll5_mean"], mean.iloc[k]), (got[i]["v_delta"], delta.iloc[k])):
                assert x is None if pd.isna(y) else x == pytest.approx(y)


def recurrence(values, k):
    up = dn = 0.0
    for v in values:
        if v is None or math.isnan(v):
            up = dn = 0.0
        else:
            up, dn = max(0.0, up + v - k), min(0.0, dn + v + k)
        yield up, dn


@pytest.mark.parametrize("limit", LIMITS + [20])
def test_cusum_matches_the_recurrence_and_resets_at_gaps(frame, rows, limit):
    seq = Ordered.of(frame, ["g"], ["ts", "id"], limit)
    got = collect(sequence.cusum(seq, ["v"], [0.1, 0.7], suffix=True).df)
    for _, part in groups(rows):
        for k, tag in ((0.1, "0_1"), (0.7, "0_7")):
            for i, (up, dn) in zip(part["id"], recurrence(part["v"].astype(float), k)):
                assert got[i][f"v__up_{tag}"] == pytest.approx(up, abs=1e-9)
                assert got[i][f"v__dn_{tag}"] == pytest.approx(dn, abs=1e-9)


@pytest.mark.parametrize("limit", LIMITS)
def test_sustained_event_fires_once_per_run(frame, rows, limit):
    flagged = frame.withColumn("hot", F.col("v") > -0.6)
    seq = sequence.sustained(Ordered.of(flagged, ["g"], ["ts", "id"], limit), {"event": ("hot", 5)})
    seq = sequence.sustained_state(seq, {"state": ("hot", 5)})
    got = collect(seq.df)
    for _, part in groups(rows):
        run = 0
        for i, v in zip(part["id"], part["v"]):
            run = run + 1 if (not pd.isna(v) and v > -0.6) else 0
            assert got[i]["event"] == (run == 5)
            assert got[i]["state"] == (run >= 5)


@pytest.mark.parametrize("marks,events", [
    ([3, 4, 5, 6], 0), ([3, 4, 5, 6, 7], 1), (list(range(3, 11)), 1), ([2, 4, 7, 9], 0),
])
def test_persistence_cases(spark, marks, events):
    df = spark.createDataFrame([(i, i in marks) for i in range(14)], "i int, hot boolean").withColumn("g", F.lit(1))
    seq = sequence.sustained(Ordered.of(df, ["g"], ["i"]), {"event": ("hot", 5)})
    hits = [r["i"] for r in seq.df.filter("event").collect()]
    assert len(hits) == events and all(h == marks[4] for h in hits)


@pytest.mark.parametrize("limit", LIMITS)
def test_episode_numbers(frame, rows, limit):
    flagged = frame.withColumn("w", F.coalesce(F.col("v") > 0.5, F.lit(False)))
    got = collect(sequence.episodes(Ordered.of(flagged, ["g"], ["ts", "id"], limit), {"e": "w"}).df)
    for _, part in groups(rows):
        count, before = 0, False
        for i, v in zip(part["id"], part["v"]):
            now = not pd.isna(v) and v > 0.5
            count += now and not before
            before = now
            assert got[i]["e"] == count


@pytest.mark.parametrize("limit", LIMITS)
def test_quantiles_match_pandas(frame, rows, limit):
    long = frame.select("g", F.col("v").alias("value")).filter("value is not null")
    out = select_quantiles(long, ["g"], [0.005, 0.5, 0.995], list("abc"), limit=limit)
    got = {r["g"]: r for r in out.collect()}
    for g, part in groups(rows):
        v = part["v"].astype(float).dropna()
        assert got[g]["n"] == len(v)
        assert [got[g][c] for c in "abc"] == pytest.approx(list(v.quantile([0.005, 0.5, 0.995])))


@pytest.mark.parametrize("limit", LIMITS)
def test_average_ranks_match_pandas(frame, rows, limit):
    long = frame.select("g", F.col("v").alias("value")).filter("value is not null")
    got = {(r["g"], r["value"]): r["rank"] for r in quantiles.average_ranks(long, ["g"], limit=limit).collect()}
    for g, part in groups(rows):
        v = part["v"].astype(float).dropna()
        for x, r in zip(v, v.rank()):
            assert got[(g, x)] == r


@pytest.mark.parametrize("limit", LIMITS)
def test_flatline_nulls_are_their_own_runs(spark, limit):
    from driftline.schema import Roles

    values = [1.0] * 5 + [None] * 6 + [2.0] * 4 + [3.0] * 70
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "m string, i int, v double")
    roles = Roles("m", (), "i", (), ("v",))
    row = sequence.flatline_counts(df, roles, limit=limit).first()
    assert (row["flatline_count"], row["longest_run"]) == (75, 70)


def test_gap_sessions_merge_at_exactly_one_gap(spark):
    day = dt.timedelta(days=1)
    times = [T0, T0 + day, T0 + 2 * day + dt.timedelta(seconds=1), T0 + 2 * day + dt.timedelta(hours=1)]
    df = spark.createDataFrame([("m", t) for t in times], "m string, ts timestamp_ntz")
    got = sorted((r["session"], r["n_rows"], r["days"]) for r in sequence.gap_sessions(df, ["m"], "ts").collect())
    assert got[0] == (0, 2, 1.0) and got[1][:2] == (1, 2)
