import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftline.llm.divergence import probability, source_divergence
from tests_llm import AWKWARD


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = Counter(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        groups[lang].add(source)
        docs[lang].update(terms.keys())
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def table(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: table(counts[lang, s]) for s in sources}, table(total)
        value = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(value(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            term = [(value(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, last in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:last])]
    return sorted(out)


def made_of(spark, rows):
    schema = "text string, lang string, source string, term string, count string, docs string, tile string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)


def drawn(seed=4, docs=400):
    draw = random.Random(seed)
    words = [f"{'abcdé中'[k % 6]}{'xyzwv'[k // 6 % 5]}{'qrst'[k % 4] * (k // 30)}" for k in range(260)]
    rows = []
    for _ in range(docs):
        lang = draw.choice(["en", "en", "en", "de", None])
        source = draw.choice(["s0", "s0", "s0", "s1", "s2", "Z", "é", "", None])
        n = draw.choice([0, 3, 20, 80])
        text = " ".join(draw.choice(words) if draw.random() < 0.5 else words[min(int(draw.expovariate(0.05)), 259)] for _ in range(n))
        rows.append((draw.choice([text, text.upper(), text.replace(" ", "1-")]), lang, source))
    return rows + [(None, "en", "s9"), ("rare words only", "fr", "s0"), ("", "fr", "s1"), ("x", "xx", "alone")]


def test_against_brute_force(spark):
    rows = drawn()
    for least, block, tile in ((10, 16, 32), (3, 1, 2), (1, 2, 1)):
        got = source_divergence(made_of(spark, rows).repartition(5), least_docs=least, block=block, tile=tile)
        assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_no_kept_terms_give_pairs_of_zero(spark):
    got = source_divergence(made_of(spark, [("a b", "fr", "s0"), ("b", "fr", "s1"), (None, None, None)]))
    assert sorted(map(tuple, got.collect())) == [("fr", "s0", "pair", "s1", 0, 1), ("fr", "s1", "pair", "s0", 0, 1)]


def test_empty_awkward_and_repeated_rows(spark, empty, made):
    label = {"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 7, "a").otherwise(F.lit("b"))}
    assert source_divergence(empty.withColumns(label)).count() == 0
    rows = [(t, "en", "a" if i is not None and i > 7 else "b") for i, t in AWKWARD * 6]
    got = source_divergence(made(AWKWARD * 6).withColumns(label))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_probabilities_stay_exact_beyond_64_bits(spark):
    n = 10**13
    got = spark.createDataFrame([(n, 3 * n, 12345)], "c long, n long, v long").select(probability("c", "n", "v")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (3 * n + 2 * 12345)
