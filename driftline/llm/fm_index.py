"""FM-index over the words of one shard of texts.

The text is a sequence of symbols: each text's words, then a separator. Separators differ from each other, ordered by
position, so suffixes of different texts never tie beyond their text and the order is total. Symbol 0 stands for every
separator, words are 1..V.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def order_of(key: np.ndarray, bits: int) -> np.ndarray:
    """Sorting order of keys of at most ``bits`` bits; where key and place fit into 63 bits, by a plain sort of both."""
    place = len(key).bit_length()
    if bits + place > 63:
        return np.argsort(key)
    return np.sort(key << place | np.arange(len(key))) & ((1 << place) - 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling that sorts again only the suffixes that still tie."""
    n = len(symbols)
    width = n.bit_length()
    breaks = symbols == 0
    first = symbols.astype(np.int64) + int(breaks.sum())
    first[breaks] = np.arange(int(breaks.sum()))
    sa = order_of(first, int(first.max()).bit_length())
    ordered = first[sa]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, np.diff(np.r_[head, n]))
    sizes = np.diff(np.r_[head, n])
    open_slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    step = 1
    while len(open_slots):
        suffix = sa[open_slots]
        group = rank[suffix]
        key = group << width | rank[suffix + step]  # tied suffixes share `step` words, so suffix + step is inside
        order = order_of(key, 2 * width)
        suffix, key = suffix[order], key[order]
        sa[open_slots] = suffix
        new = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.r_[heads, len(key)])
        rank[suffix] = np.repeat(open_slots[heads], sizes)
        open_slots = open_slots[np.repeat(sizes > 1, sizes)]
        step *= 2
    return sa


class Bits:
    """Bit vector with ranks: 64-bit blocks and the ones before each block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)[:-1]]
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Wavelet tree, level by level from the highest bit, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = (symbols & (1 << bit)).astype(bool)
            self.levels.append((bit, Bits(one), len(symbols) - int(one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``i``."""
        lo = np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its occurrences before ``i``."""
        symbol, lo = np.zeros_like(i), np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = bits[i]
            a, b = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
            symbol |= one.astype(symbol.dtype) << bit
        return symbol, i - lo


class FMIndex:
    """Backward search through wavelet-tree ranks; positions from a suffix-array sample."""

    def __init__(self, words: np.ndarray, first: np.ndarray, sample: int = SAMPLE):
        """``words``: hashes of all words of the shard; ``first``: number of each text's first word, and the total."""
        texts, n = len(first) - 1, len(words)
        self.alphabet, symbol = np.unique(words, return_inverse=True)
        self.place = np.arange(n) + np.repeat(np.arange(texts), np.diff(first))  # of a word in the sequence
        symbols = np.zeros(n + texts, np.int64)
        symbols[self.place] = symbol + 1
        sa = suffix_array(symbols)
        counts = np.bincount(symbols, minlength=len(self.alphabet) + 1)
        self.before = np.cumsum(counts) - counts
        self.tree = WaveletTree(symbols[sa - 1].astype(np.int32), max(1, int(len(self.alphabet)).bit_length()))
        kept = sa % sample == 0
        kept |= symbols[sa - 1] == 0  # the first word of each text, so that no walk passes a separator
        self.sampled, self.samples, self.size = Bits(kept), sa[kept], len(symbols)
        self.word_at = np.full(len(symbols), -1, np.int64)
        self.word_at[self.place] = np.arange(n)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the phrases (rows of word hashes) that occur, and which phrases those are.

        The shard must have words.
        """
        which = np.searchsorted(self.alphabet, phrases)
        known = self.alphabet[np.minimum(which, len(self.alphabet) - 1)] == phrases
        alive = np.flatnonzero(known.all(axis=1))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = which[alive, column] + 1
            ranks = self.tree.rank(np.r_[c, c], np.r_[lo, hi])
            lo, hi = self.before[c] + ranks[: len(c)], self.before[c] + ranks[len(c) :]
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word numbers of suffixes, by walking back to a sampled one."""
        out, steps, open_ = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            hit = self.sampled[at]
            done = open_[hit]
            out[done] = self.samples[self.sampled.rank(rows[done])] + steps[done]
            open_ = open_[~hit]
            symbol, rank = self.tree.access(rows[open_])
            rows[open_] = self.before[symbol] + rank
            steps[open_] += 1
        return self.word_at[out]

    def occurrences(self, phrases: np.ndarray, block: int = 1 << 18):
        """(phrase number, first word) of every occurrence, in blocks."""
        alive, lo, hi = self.search(phrases)
        sizes = hi - lo
        ends = np.cumsum(sizes)
        for a in range(0, int(ends[-1]) if len(ends) else 0, block):
            flat = np.arange(a, min(a + block, int(ends[-1])))
            of = np.searchsorted(ends, flat, "right")
            yield alive[of], self.locate(lo[of] + flat - (ends[of] - sizes[of]))
