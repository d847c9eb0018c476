import random
import re

import pytest
from pyspark.sql import functions as F

from driftline.llm.line_dedup import dedup_lines, edit_distance_within, keys
from tests_llm import AWKWARD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, errors, least):
    """Only distinct (key, text) count as documents."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for d, (_, t) in enumerate(docs):
        for place, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line) >= least:
                first.setdefault(line, (d, place))
    lines = sorted(first, key=first.get)
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in lines:
        for b in lines:
            if first[a] < first[b] and abs(len(a) - len(b)) <= errors and distance(a, b) <= errors:
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y, key=first.get)] = min(x, y, key=first.get)
    stay = {first[x] for x in lines if root(x) == x}
    out = {}
    for d, (i, t) in enumerate(docs):
        out[(i, t)] = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < least or (d, p) in stay)
    return sorted(((i, out[(i, t)]) for i, t in rows), key=repr)


def made_up(seed):
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcdé ") for _ in range(draw.choice([3, 12, 21, 40, 90]))) for _ in range(25)]
    pool += [f"page {k} of the same long template" for k in range(40)]  # a frequent segment whose lines all link
    pool += ["a shared head of many lines " + "".join(draw.choice("xyz ") for _ in range(30)) for _ in range(40)]  # and one whose lines don't
    rows = []
    for k in range(90):
        lines = []
        for _ in range(draw.randint(1, 6)):
            line = list(draw.choice(pool))
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                at = draw.randrange(len(line) + 1)
                line[at : at + draw.randint(0, 1)] = draw.choice(["", "b", "éq"])
            lines.append("".join(line))
        rows.append((k, "\n".join(lines)))
    return rows + rows[:5]


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_bit_parallel_distance(spark, errors):
    draw, rows = random.Random(errors), []
    for _ in range(1500):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(5, 24)))
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "c"])
        if len(b) > errors:
            rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(edit_distance_within("a", "b", errors) != (F.levenshtein("a", "b") <= errors)).isEmpty()


@pytest.mark.parametrize("errors,least,seed", [(2, 20, 1), (1, 12, 2), (3, 20, 3)])
def test_lines_against_brute_force(made, errors, least, seed):
    rows = made_up(seed)
    got = dedup_lines(made(rows).repartition(5), errors=errors, least=least)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == brute(rows, errors, least)


def test_awkward_and_empty(awkward, empty):
    got = dedup_lines(awkward)
    assert sorted(got.columns) == sorted(awkward.columns)  # the report stands in for the column of its name
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == brute(AWKWARD, 2, 20)
    assert got.where("text is null and line_dedup.n_lines = 0").count() == 1
    assert dedup_lines(empty).count() == 0


def test_no_python_in_the_plan(awkward):
    plan = dedup_lines(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_keys_are_compiled(spark, capsys, errors):
    """The JVM interprets methods of more than 8,000 bytes; the keys of two errors once took 15,816."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code is known before the run
    try:
        keys(spark.range(3).select(F.col("id").alias("h"), F.repeat(F.lit("ab c"), F.col("id").cast("int")).alias("line")), errors).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_conditions_on_the_report_repeat_no_work(awkward):
    left = dedup_lines(awkward).where("line_dedup.n_removed = 0 or line_dedup.n_removed < line_dedup.n_lines").drop("line_dedup")
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == plan.count("flatten(") == 1
    assert left.count() == sum(r["n_removed"] == 0 or r["n_removed"] < r["n_lines"] for r in dedup_lines(awkward).select("line_dedup.*").collect())
