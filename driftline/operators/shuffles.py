"""Shuffled labels as keyed permutations of row positions.

Replicate r marks a row as positive if its permuted position lies below the number of positives, so every task marks its
own rows from the position and the key alone, however the rows are cut, and always as many rows as there are positives.
One permutation serves all labels of a replicate. The permutation is a small Feistel network on a rectangle a little
larger than the table: a position is a row and a column of it, each round shifts one by a keyed function of the other, and
a position that leaves the table walks on along its cycle. All steps are whole-number arithmetic below 2^62.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

ROUNDS = 6
PRIME = 2**31 - 1
STEP = 1 << 15


def keys(*parts) -> np.ndarray:
    """Two numbers for each round (an addend and a factor) from the first 14 hex digits of an MD5 of the parts."""
    text = "|".join(str(x) for x in parts)
    digests = [hashlib.md5(f"{text}|{k}".encode()).hexdigest() for k in range(ROUNDS)]
    return np.array([(int(d[:7], 16), int(d[7:14], 16) + 1) for d in digests], np.int64)


def sides(total: int) -> tuple[int, int]:
    """Sides of the rectangle: a square root, and as many rows as hold the table."""
    a = math.isqrt(max(total - 1, 0)) + 1
    return a, -(-total // a) if total else 1


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime 2^31 - 1, for x below 2^62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def _shifts(a: int, b: int, key: np.ndarray) -> list[np.ndarray]:
    """The shift of each round for every row or column of the rectangle: far fewer than positions, so they are looked up."""
    out = []
    for k, (add, factor) in enumerate(key.tolist()):
        other, size = (b, a) if k % 2 == 0 else (a, b)
        mixed = _reduced(_reduced((np.arange(other, dtype=np.int64) + add) ** 2) * factor)
        out.append((mixed * size) >> 31)
    return out


def _network(x: np.ndarray, a: int, b: int, shifts: list[np.ndarray]) -> np.ndarray:
    left = x // b
    right = x - left * b
    spare = np.empty_like(x)
    for k, shift in enumerate(shifts):
        one, other, size = (left, right, a) if k % 2 == 0 else (right, left, b)
        one += np.take(shift, other, out=spare, mode="clip")
        # less the size, if it is no less: below zero is a huge number without a sign
        np.subtract(one, size, out=spare)
        np.minimum(one.view(np.uint64), spare.view(np.uint64), out=one.view(np.uint64))
    left *= b
    left += right
    return left


def permuted(begin: int, end: int, total: int, key: np.ndarray) -> np.ndarray:
    """Places of the positions from ``begin`` to ``end`` under the permutation of ``total`` positions."""
    a, b = sides(total)
    shifts = _shifts(a, b, key)
    out = np.empty(end - begin, np.int64)
    for at in range(begin, end, STEP):
        x = _network(np.arange(at, min(at + STEP, end), dtype=np.int64), a, b, shifts)
        outside = np.flatnonzero(x >= total)
        while len(outside):
            x[outside] = _network(x[outside], a, b, shifts)
            outside = outside[x[outside] >= total]
        out[at - begin : at - begin + len(x)] = x
    return out
