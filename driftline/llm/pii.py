"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

The base kinds (email, ip, card, phone) follow fixed patterns: leftmost, non-overlapping per kind, and a match that fails
its check is dropped without another try. The method adds account numbers (mod 97) and local phone numbers, the latter
only where the words around them speak for it. Scanning is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftline.llm.common import chunked, text_bytes

# Kinds in the order of the result, patterns, and the words that raise or lower a score.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
DIGITS = re.compile(r"[^0-9]")
WORD = re.compile(r"[^\W\d_]+")
CONTEXT = {
    "email": {"email", "mail", "contact", "address", "write"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "pay"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "contact"},
    "iban": {"iban", "bank", "account", "konto", "transfer"},
    "local_phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "contact"},
}
AGAINST = {"example", "sample", "version", "test", "order", "invoice", "isbn"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.35}
NEAR, RAISE, LOWER_BY, LEAST = 40, 0.25, 0.25, 0.5

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if place % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Account number check: the first four characters go last, letters count from 10."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """A match has its run of local characters, as far as no earlier match took them, an @ and a domain with a dot."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        else:
            free = max(free, at)  # a run before this @ can't be the start of another match
        at = text.find("@", max(at + 1, free))


def proposals(text: str) -> Iterator[Span]:
    """Confirmed spans of the base kinds and of the added ones."""
    yield from emails(text)
    for m in IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()


def score(text: str, span: Span) -> float:
    """Prior of the kind, raised and lowered by the words within ``NEAR`` characters."""
    kind, start, end = span
    near = {w.lower() for w in WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    value = PRIOR[kind] + RAISE * bool(near & CONTEXT[kind]) - LOWER_BY * bool(near & AGAINST)
    return min(1.0, max(0.0, value))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans by start, then kind. Base spans stay whatever their score; others need ``LEAST`` and must not touch a base span."""
    found = [(*s, score(text, s)) for s in proposals(text)]
    taken = sorted((s[1], s[2]) for s in found if s[0] in BASE)
    reach = list(accumulate((b for _, b in taken), max))

    def clear(s) -> bool:
        before = bisect_left(taken, (s[2], 0))  # base spans that begin before this one ends
        return not before or reach[before - 1] <= s[1]

    kept = [s for s in found if s[0] in BASE or s[3] >= LEAST and clear(s)]
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def _found(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        column = batch.column("_text")
        buf, offsets = text_bytes(column)
        # every pattern needs a digit or an @
        signs = np.r_[0, np.cumsum((buf >= 48) & (buf <= 57) | (buf == 64))]
        rows = []
        for k, some in enumerate(np.diff(signs[offsets]) > 0):
            rows.append(find(column[k].as_py()) if some else [])
        base = [[s for s in r if s[0] in BASE] for r in rows]
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            *(pa.array([sum(s[0] == kind for s in r) for r in rows], pa.int64()) for kind in KINDS),
            pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string()),
            pa.array([[{"kind": s[0], "start": s[1], "end": s[2], "score": s[3]} for s in r] for r in rows], schema.field("found").type),
        ], schema=schema)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, a count per kind, base_sha256, found (kind, start, end, score by code points).

    A null text counts as empty and has no spans. Rows that repeat each get their row, an empty table gives none; other
    columns, whatever their names, are not read. Texts are scanned whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = docs.select(key).schema[0].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    ddl = f"_key {kind}, {counts}, base_sha256 string, found array<struct<kind:string,start:long,end:long,score:double>>"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return plain.mapInArrow(lambda batches: _found(batches, arrow), ddl).withColumnRenamed("_key", key)


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    out, last = [], 0
    for kind, start, end, _ in find(text):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
            last = end
    return "".join([*out, text[last:]])
