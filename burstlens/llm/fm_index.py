"""An FM-index over word numbers, for counting and locating many phrases at once.

The texts of a shard lie end to end as word numbers, each followed by a border that
equals no other. The index has the Burrows-Wheeler transform as a wavelet tree over the
bits of the word numbers, the count of smaller symbols for each symbol, and the
positions of every ``SAMPLE``-th word and of first words of texts. A phrase is matched from
its last word to its first by two ranks per word; an occurrence is located by stepping
back through the transform to a sampled position. All phrases, and all occurrences,
take each step together.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16
_BLOCK = 512  # bits between stored counts


class _Bits:
    """A bit vector with the number of set bits before any position."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // _BLOCK + 1) * _BLOCK, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        per_word = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(per_word, out=self.before[1:], dtype=np.int32)
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class _Wavelet:
    """Ranks of symbols in a sequence: one bit vector per bit, zeros first on each level."""

    def __init__(self, symbols: np.ndarray, n_bits: int) -> None:
        self.levels, self.zeros = [], []
        for b in range(n_bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            level = _Bits(bit)
            self.levels.append(level)
            self.zeros.append(len(symbols) - level.ones)
            ones = bit.astype(bool)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` stands before position ``at[i]``."""
        lo, hi = np.zeros(len(at), np.int64), at
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (len(self.levels) - 1 - depth)) & 1).astype(bool)
            a, b = level.rank(lo), level.rank(hi)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        lo = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(at).astype(bool)
            symbol = (symbol << 1) | one
            a, b = level.rank(lo), level.rank(at)
            lo = np.where(one, zeros + a, lo - a)
            at = np.where(one, zeros + b, at - b)
        return symbol, at - lo


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that begin there.

    Ranks by 1, 2, 4, ... symbols; only suffixes that are still tied are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    # A suffix's rank is the place of the first of its ties.
    heads = np.flatnonzero(new)
    group = np.repeat(heads, np.diff(np.append(heads, n)))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = group
    alone = new & np.append(new[1:], True)
    tied = np.flatnonzero(~alone)
    width = 1
    while len(tied):
        at = order[tied]
        behind = rank[np.minimum(at + width, n)]
        own = group[tied]
        # Both are below 2^31; ties of one group stay on its places.
        key = (own << 32) | (behind + 1)
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[tied] = at
        fresh = np.empty(len(tied), bool)
        fresh[:1] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        first = np.flatnonzero(fresh)
        head = np.repeat(tied[first], np.diff(np.append(first, len(tied))))
        group[tied] = head
        rank[at] = head
        single = fresh & np.append(fresh[1:], True)
        tied = tied[~single]
        width *= 2
    return order


class FMIndex:
    """Index of texts given as word numbers from 1 on, end to end.

    ``first`` has the place of each text's first word, and the number of all words at
    its end. Texts of no words are allowed.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, n_symbols: int) -> None:
        n_texts = len(first) - 1
        n = len(words) + n_texts
        sizes = np.diff(first)
        text = np.repeat(np.arange(n_texts), sizes)
        self.place = np.arange(len(words)) + text  # of words, borders counted
        border = first[1:] + np.arange(n_texts)
        # Borders are less than words and differ from each other.
        symbols = np.empty(n, np.int64)
        symbols[self.place] = words + (n_texts - 1)
        symbols[border] = np.arange(n_texts)
        order = suffix_order(symbols)
        symbols[self.place] = words
        symbols[border] = 0
        n_bits = max(1, int(n_symbols).bit_length())
        self.transform = _Wavelet(symbols[order - 1], n_bits)
        counts = np.bincount(symbols, minlength=n_symbols + 2)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        marked = np.zeros(n, bool)
        marked[::SAMPLE] = True
        marked[np.append(0, border[:-1] + 1)[:n_texts]] = True
        in_order = marked[order]
        self.marked = _Bits(in_order)
        self.sampled = order[in_order]
        self.n = n
        # From a place to the number of the word there.
        self.word_at = np.full(n, -1, np.int64)
        self.word_at[self.place] = np.arange(len(words))

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges in the suffix order of phrases (rows, left-aligned; 0 matches nothing)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            at = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(at):
                break
            symbol = phrases[at, lengths[at] - 1 - step]
            known = symbol > 0
            base = self.smaller[symbol]
            a = base + self.transform.rank(symbol, lo[at])
            b = base + self.transform.rank(symbol, hi[at])
            lo[at], hi[at] = a, np.where(known, b, a)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The number of the word at which each suffix begins."""
        found = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked.get(at).astype(bool)
            found[todo[hit]] = self.sampled[self.marked.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            symbol, before = self.transform.access_rank(at)
            at = self.smaller[symbol] + before
            steps += 1
        return self.word_at[found]
