"""Scaled forward and backward recursions of a hidden Markov model over many sequences at once.

Sequences lie side by side, the longest first; step ``t`` works on all that are still running. Every sequence is
evaluated whole, so likelihoods and expected counts are exact.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Places of the symbols of several sequences, ordered by step and then by sequence."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        steps = int(n[0]) if len(n) else 0
        self.running = np.searchsorted(-n, -np.arange(steps), "left")  # sequences longer than t
        self.begin = np.r_[0, np.cumsum(self.running)]
        self.sequence = np.repeat(np.arange(len(n)), n)
        self.step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.place = self.begin[self.step] + self.sequence

    def arrange(self, symbols: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(self.place), np.int64)
        out[self.place] = np.concatenate([symbols[i] for i in self.order]) if len(self.order) else 0
        return out


def forward(layout: Layout, emitted: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State shares at each place, and the scale of each place: the chance of its symbol given those before."""
    share, scale = np.empty_like(emitted), np.empty(len(emitted))
    for t, n in enumerate(layout.running):
        a = layout.begin[t]
        if t:
            before = layout.begin[t - 1]
            now = share[before : before + n] @ move
            now *= emitted[a : a + n]
        else:
            now = start * emitted[:n]
        total = now.sum(axis=1)
        now /= total[:, None]
        share[a : a + n], scale[a : a + n] = now, total
    return share, scale


def log10_likelihood(layout: Layout, scale: np.ndarray) -> np.ndarray:
    """Per sequence, in the order given."""
    out = np.empty(len(layout.order))
    out[layout.order] = np.bincount(layout.sequence, np.log10(scale[layout.place]), len(layout.order))
    return out


def expected(layout: Layout, symbols: np.ndarray, emission: np.ndarray, start: np.ndarray, move: np.ndarray):
    """Expected starts, moves and emissions (symbols x states) of the sequences."""
    follow = emission[symbols]
    share, scale = forward(layout, follow, start, move)
    follow /= scale[:, None]
    ahead = np.ones_like(share)  # backward values, scaled
    steps, moves = len(layout.running), np.zeros_like(move)
    for t in range(steps - 2, -1, -1):
        a, b, n = layout.begin[t], layout.begin[t + 1], layout.running[t + 1]
        later = follow[b : b + n] * ahead[b : b + n]
        moves += share[a : a + n].T @ later
        ahead[a : a + n] = later @ move.T
    share *= ahead  # now the posterior
    size, states = emission.shape
    emissions = np.stack([np.bincount(symbols, share[:, s], size) for s in range(states)], axis=1)
    return share[: layout.running[0]].sum(axis=0) if steps else np.zeros(states), moves * move, emissions
