"""Interpolated Kneser-Ney models of the bytes of words, one per class, over shared lower orders.

A gram is a byte with its context, up to ``ORDER`` bytes long, from ``^`` before the word to ``$`` after it, packed into
64 bits with its length on top. The longest grams are counted per class; every lower order is one continuation
distribution over all classes together. So an expression that a class has not seen is scored by the shared counts, and
rare ones differ little between the classes.
"""

from __future__ import annotations

import numpy as np

ORDER = 6
DISCOUNT = 0.75
_HEAD, _TAIL = 1, 2  # bytes that stand for ^ and $


def _length(key: np.ndarray) -> np.ndarray:
    return key >> np.int64(56)


def _body(key: np.ndarray) -> np.ndarray:
    return key & np.int64((1 << 56) - 1)


def context(key: np.ndarray) -> np.ndarray:
    return (_length(key) - 1) << np.int64(56) | _body(key) >> np.int64(8)


def shorter(key: np.ndarray) -> np.ndarray:
    """The gram without its first byte."""
    n = _length(key) - 1
    return n << np.int64(56) | _body(key) & ((np.int64(1) << (8 * n)) - 1)


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest gram at each byte of each word and at its end; and where each word's grams begin."""
    n = ends - starts
    size = n + 2
    head = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(head, size)
    byte = np.empty(len(place), np.int64)
    inner = (place > 0) & (place <= np.repeat(n, size))
    byte[inner] = low[(np.repeat(starts, size) + place - 1)[inner]]
    byte[place == 0] = _HEAD
    byte[place == np.repeat(n + 1, size)] = _TAIL
    key = byte.copy()
    for j in range(1, ORDER):
        back = place >= j
        key[back] |= byte[np.flatnonzero(back) - j] << np.int64(8 * j)
    key |= np.minimum(place + 1, ORDER) << np.int64(56)
    return key[place > 0], np.cumsum(n + 1) - (n + 1)


class Table:
    """Sorted keys with rows of values."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        order = np.argsort(key)
        self.key, self.values = key[order], [v[order].astype(np.float32) for v in values]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, at


class Model:
    """Two classes, ordinary (0) and marked (1)."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        """``gram``: distinct longest grams; ``count``: rows of their counts in class 0 and 1."""
        self.orders: list[tuple[Table, Table]] = []
        present = {k: gram[_length(gram) == k] for k in range(2, ORDER + 1)}
        seen = {ORDER: present[ORDER]}
        for k in range(ORDER - 1, 0, -1):
            seen[k] = np.unique(np.r_[shorter(seen[k + 1]), present.get(k, np.empty(0, np.int64))])
        for k in range(1, ORDER):
            key, n = np.unique(shorter(seen[k + 1]), return_counts=True)
            ctx, at = np.unique(context(key), return_inverse=True)
            total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
            weight = DISCOUNT * kinds / np.maximum(total, 1)
            below = np.exp(self._shared(shorter(key))) if k > 1 else np.full(len(key), 1 / 256)
            p = np.maximum(n - DISCOUNT, 0) / total[at] + weight[at] * below
            self.orders.append((Table(key, np.log(p)), Table(ctx, np.log(weight))))
        ctx, at = np.unique(context(gram), return_inverse=True)
        below = np.exp(self._shared(shorter(gram)))
        logs, backs = [], []
        for c in (0, 1):
            total = np.bincount(at, count[:, c], len(ctx))
            kinds = np.bincount(at, count[:, c] > 0, len(ctx))
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(count[:, c] - DISCOUNT, 0) / np.maximum(total, 1)[at] + weight[at] * below
            logs.append(np.log(p))
            backs.append(np.log(weight))
        self.full, self.contexts = Table(gram, *logs), Table(ctx, *backs)

    def _shared(self, key: np.ndarray) -> np.ndarray:
        """Log probability under the shared lower orders."""
        out, open_ = np.zeros(len(key)), np.arange(len(key))
        key = key.copy()
        for k in range(len(self.orders), 0, -1):
            own = open_[_length(key[open_]) == k]
            table, back = self.orders[k - 1]
            found, at = table.find(key[own])
            out[own[found]] += table.values[0][at[found]]
            rest = own[~found]
            known, at = back.find(context(key[rest]))
            out[rest[known]] += back.values[0][at[known]]
            key[rest] = shorter(key[rest])
            open_ = np.setdiff1d(open_, own[found], assume_unique=True)
        out[open_] += np.log(1 / 256)
        return out

    def score(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word in both classes (words x 2)."""
        key, first = grams(low, starts, ends)
        if not len(key):
            return np.zeros((0, 2))
        distinct, inverse = np.unique(key, return_inverse=True)
        found, at = self.full.find(distinct)
        out = np.empty((len(distinct), 2))
        rest = ~found
        below = self._shared(shorter(distinct[rest]))
        known, where = self.contexts.find(context(distinct[rest]))
        for c in (0, 1):
            out[found, c] = self.full.values[c][at[found]]
            out[rest, c] = below + np.where(known, self.contexts.values[c][where] if len(self.contexts.key) else 0, 0)
        return np.add.reduceat(out[inverse], first, axis=0)
