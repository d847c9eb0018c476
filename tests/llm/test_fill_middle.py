import hashlib
import random
import re

from pyspark.sql import functions as F

from driftline.llm.fill_middle import fill_in_middle, restored
from tests_llm import AWKWARD

ODD = [(20, "a<P>b c d"), (21, "<S>"), (22, "x <M> y"), (23, "<P <S <M ends"), (24, " no break space"),
       (25, " lead"), (26, "trail \n"), (27, "12345678"), (28, "1234567"), (29, "1234567 "), (30, "😀😀 é"), (31, "\x0b\x0c\x1c\x85"),
       (-7, "a negative key"), (32, "\t"), (33, "a  b   c    d     e\n\nf")]


def brute(key, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def drawn(seed=1):
    draw = random.Random(seed)
    signs = "ab<>PSM \t\n\r\x0b\x0cé中😀 \x00"
    return [(k, "".join(draw.choice(signs) for _ in range(draw.randint(0, 60)))) for k in range(100, 500)]


def test_against_brute_force_and_back(made):
    rows = AWKWARD + ODD + drawn()
    for rate, spm in ((50, 80), (100, 0), (100, 100)):
        out = fill_in_middle(made(rows).repartition(3), rate=rate, spm=spm)
        got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        want = sorted(((*brute(i, t, 42, rate, spm), t or "") for i, t in rows), key=repr)
        assert sorted(map(tuple, got), key=repr) == want


def test_empty_table_and_other_key_types(empty, made):
    assert fill_in_middle(empty).count() == 0
    texts = made([(1, "one two three")]).withColumn("doc_id", F.lit("k"))
    assert tuple(fill_in_middle(texts, seed=7).first()) == brute("k", "one two three", 7)
