"""SetSketch registers of many sets at once.

A register holds the truncated minimum of exponential variables as a power of the base: ``floor(1 - log_b(min))`` cut to
[0, q + 1]. The values of one element over the registers ascend: the j-th lies in the j-th interval and goes to the j-th
register of the element's own order, so later steps stop mattering once every register of a set is filled below them.
Registers merge by maximum, and equal ones are as frequent as the Jaccard similarity when the base is near 1.
"""

from __future__ import annotations

import numpy as np

from driftline.llm.common import mix

# The parameters that the published method recommends for two-byte registers.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2


def registers(elements: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """Registers (sets x ``count``, a prime) of distinct 64-bit elements; ``first`` as of words. An empty set is all 0."""
    sets = len(first) - 1
    low = np.full(sets * count, np.inf)
    base = np.repeat(np.arange(sets) * count, np.diff(first))
    element = mix(elements)
    place = (element % np.uint64(count)).astype(np.int64)
    stride = 1 + (mix(element ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(count - 1)).astype(np.int64)
    start = 0.0
    for j in range(1, count + 1):
        end = np.log1p(j / (count - j)) / RATE if j < count else np.inf
        uniform = (mix(element + np.uint64(j)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        width = -np.expm1(-RATE * (end - start)) if j < count else 1.0
        value = start - np.log1p(-uniform * width) / RATE
        np.minimum.at(low, base + place, value)
        place += stride
        place[place >= count] -= count
        start = end
        if j % 4 == 0 or j == count - 1:
            # a set whose largest minimum is below the next interval is done
            live = low.reshape(sets, count).max(axis=1) > start
            of = live[base // count]
            if not of.any():
                break
            if of.mean() < 0.7:
                element, place, stride, base = element[of], place[of], stride[of], base[of]
    out = np.zeros((sets, count), np.uint16)
    some = np.diff(first) > 0
    values = np.floor(1 - np.log(low.reshape(sets, count)[some]) / np.log(BASE))
    out[some] = np.clip(values, 0, TOP + 1).astype(np.uint16)
    return out


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers; the band's number is part of it."""
    number = regs.shape[1] // rows
    used = regs[:, : number * rows].reshape(len(regs), number, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(number, dtype=np.uint64) + np.uint64(1), used.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + used[:, :, r])
    return key


def order_probability(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set is the larger one, from the share of the union that only this set has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray, steps: int = 40) -> np.ndarray:
    """Most likely Jaccard similarity given how many registers are larger, smaller and equal, and the set sizes.

    The log likelihood is concave in the similarity, so its top is found by golden section.
    """
    u, v = n / (n + m), m / (n + m)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j):
        p, q = order_probability(np.maximum(u - v * j, 0)), order_probability(np.maximum(v - u * j, 0))
        return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    ratio = (5**0.5 - 1) / 2
    for _ in range(steps):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(a) > likelihood(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2
