import hashlib
import random
import re

from driftline.llm import pii
from tests_llm import AWKWARD

# the base patterns as the contract spells them
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and luhn % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(2)
    pieces = ["a@b.co", "@", "1.2.3.4", "300.1.1.1", ".", "4111 1111 1111 1111", "+1 (499) 555-6503", "-", " ", "x", "_", "5", "a.b", "00001.2.3.4", "é"]
    for k in range(40_000):
        text = "".join(draw.choice("aB1.@-+ ()_%é 0299") for _ in range(draw.randint(0, 30))) if k % 2 else "".join(draw.choice(pieces) for _ in range(draw.randint(0, 8)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == brute(text), text


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert [s[0] for s in pii.find("my iban GB82 WEST 1234 5698 7654 32 thanks")] == ["iban"]
    assert [s[0] for s in pii.find("call (499) 555-6503 now")] == ["local_phone"]
    assert pii.find("item 499 555-6503 now") == []
    assert pii.score("test card 4111111111111111", ("card", 10, 26)) < pii.score("pay by card 4111111111111111", ("card", 12, 28))
    assert pii.redact("mail a@b.co or +1 499 555 65 03") == "mail [email] or [phone]"


def test_linear_on_long_runs():
    text = "1" * 100_000 + " " + "a" * 100_000 + "@" + "+1" + " " * 100_000 + "a@" * 20_000
    assert pii.find(text) == []


def test_rows(awkward, empty, made):
    got = {(r["doc_id"], r["base_sha256"]) for r in pii.find_pii(awkward).collect()}
    assert got == {(i, hashlib.sha256(pii.joined(brute(t or "")).encode()).hexdigest()) for i, t in AWKWARD}
    assert pii.find_pii(empty).count() == 0
    row = pii.find_pii(made([(1, "é 10.0.0.1 a@b.co")])).first()
    assert (row["n_ip"], row["n_email"]) == (1, 1) and [(s["kind"], s["start"], s["end"]) for s in row["found"]] == [("ip", 2, 10), ("email", 11, 17)]
