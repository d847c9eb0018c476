import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftline.llm.packing import encoder, pack, sequences
from driftline.llm.queries import vocabulary
from tests_llm import AWKWARD


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_both_paths_give_the_same_ids(plain):
    draw, encode = random.Random(1), encoder(**vocabulary())
    pool = list("ab  \n\t'sé中😀1.,|") + ["don't", "<|endoftext|>", " ", " ", "ß", "́", "²", "Ⅷ", "﻿", "\x00", "٣"]
    for _ in range(5_000):
        text = "".join(draw.choice(pool) for _ in range(draw.randint(0, 25)))
        assert [*encode(text), 0] == plain(text), text


def check(pieces, rows, plain, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    ids = {i: plain(t) for i, t in rows}
    for i, own in ids.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == zlib.crc32(np.array(own[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(own)
    sizes = []
    for s, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append((s, at))
    assert all(n == length for _, n in sorted(sizes)[:-1]) and [s for s, _ in sorted(sizes)] == list(range(len(sizes)))


def test_every_id_lies_in_one_piece(made, plain):
    draw = random.Random(3)
    rows = [(k, None if k == 7 else " ".join(draw.choice(["the", "a", "x9", "é", "zebra"]) for _ in range(draw.choice([0, 1, 30, 400])))) for k in range(80)]
    packed = pack(made(rows).repartition(6), **vocabulary(), length=64, with_ids=True).cache()
    check(packed.collect(), rows, plain, 64)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in sequences(packed).collect()}
    edges = {p["sequence_id"] for p in packed.collect() if p["boundary"]}
    assert 0 < len(edges) <= 5 and all(len(x) == 64 for s, x in whole.items() if s < max(whole))
    stream = np.concatenate([whole[s] for s in sorted(whole)])
    assert sorted(stream.tolist()) == sorted(x for _, t in rows for x in plain(t))


def test_awkward_and_empty(awkward, empty, plain):
    rows = [(i, t) for i, t in AWKWARD if i != 8]
    check(pack(awkward.where("doc_id is null or doc_id <> 8"), **vocabulary()).collect(), rows, plain, 1024)
    assert pack(awkward, **vocabulary()).where("doc_id = 8").count() == 2
    assert pack(empty, **vocabulary()).count() == 0
