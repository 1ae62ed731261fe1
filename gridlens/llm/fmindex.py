"""An FM-index over runs of small integers, vectorised: many phrases are searched, and many rows located, at once.

The text is one array of symbols; 0 ends a run, words are 1 and more. Each end is a symbol of its own, the earlier the
smaller, and phrases hold words only, so no match crosses an end. The Burrows-Wheeler transform lies in a wavelet tree
without pointers (one bit array a level, zeros before ones); positions are kept for each `step`-th place of the text and
for the start of every run, and all others are reached by walking back from row to row.
"""

from __future__ import annotations

import numpy as np

#: Three places of the text fit one 64-bit key of the suffix sort.
PLACE_BITS = 21
LIMIT = (1 << PLACE_BITS) - 1


class Bits:
    """A bit array with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Ranks of all symbols of a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[Bits, int]] = []
        self.shifts = list(range(bits - 1, -1, -1))
        for shift in self.shifts:
            one = (symbols >> shift) & 1 != 0
            level = Bits(one)
            self.levels.append((level, len(symbols) - level.ones))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        every = np.arange(1 << bits)
        #: Where the places of each symbol begin on the last level.
        self.start = self._down(every, np.zeros(len(every), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for (level, zeros), shift in zip(self.levels, self.shifts, strict=True):
            ones = level.rank(at)
            at = np.where((symbol >> shift) & 1 != 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, how often it stands before)."""
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in self.levels:
            one, ones = level.get(at), level.rank(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at - self.start[symbol]


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """The places of all suffixes in order, by doubling: only suffixes that are still alike are sorted again."""
    n, mask = len(symbols), LIMIT
    if n > LIMIT + 1 or symbols[-1] != 0:
        raise ValueError("a text ends with 0 and has 2^21 symbols at most")
    width = min(n, max(1, (63 - PLACE_BITS) // bits))
    symbol = symbols.astype(np.int64)
    key, last = symbol.copy(), symbol
    for k in range(1, width):
        follow = np.zeros(n, np.int64)
        follow[: n - k] = symbol[k:]
        last = np.where(last != 0, follow, 0)
        key = key << bits | last
    # The place is part of the key: suffixes that end alike stand in order of their ends.
    key = np.sort(key << PLACE_BITS | np.arange(n))
    order, key = key & mask, key >> PLACE_BITS
    head = np.ones(n, bool)
    head[1:] = (key[1:] != key[:-1]) | (key[1:] & ((1 << bits) - 1) == 0)
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    tied = np.flatnonzero(~head | np.append(~head[1:], False))
    while len(tied):
        places = order[tied]
        key = np.sort(rank[places] << 2 * PLACE_BITS | rank[places + width] << PLACE_BITS | places)
        places, pair = key & mask, key >> PLACE_BITS
        order[tied] = places
        head = np.ones(len(tied), bool)
        head[1:] = pair[1:] != pair[:-1]
        rank[places] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~head | np.append(~head[1:], False)]
        width *= 2
    return order


class FMIndex:
    """The index of one text of words below `size`."""

    def __init__(self, symbols: np.ndarray, size: int, step: int = 8):
        bits = max(1, int(size - 1).bit_length())
        order = suffix_order(symbols, bits)
        before = symbols[order - 1]  # the text ends with 0, which stands before its first place too
        self.n, self.tree = len(symbols), WaveletTree(before, bits)
        self.smaller = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=1 << bits), out=self.smaller[1:])
        kept = (order % step == 0) | (before == 0)
        self.sampled, self.samples = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of each phrase, a row of `length` words; backwards from its last word."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for k in range(length - 1, -1, -1):
            symbol = phrases[live, k]
            base = self.smaller[symbol]
            low[live] = base + self.tree.rank(symbol, low[live])
            high[live] = base + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row."""
        place = np.empty(len(rows), np.int64)
        live, row, steps = np.arange(len(rows)), rows, 0
        while len(live):
            known = self.sampled.get(row)
            place[live[known]] = self.samples[self.sampled.rank(row[known])] + steps
            live, row = live[~known], row[~known]
            symbol, before = self.tree.access(row)
            row, steps = self.smaller[symbol] + before, steps + 1
        return place
