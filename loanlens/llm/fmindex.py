"""FM-index over the words of one training shard: suffix order by prefix
doubling, wavelet matrix over the Burrows-Wheeler transform, backward search
and location by sampled suffix positions. Arrays of phrases are searched
together."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


class BitRank:
    """Bits in 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over a sequence of small integers, a bit a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for k in range(bits - 1, -1, -1):
            ones = (values >> k & 1).astype(bool)
            zeros = len(values) - int(np.count_nonzero(ones))
            self.levels.append((k, BitRank(ones), zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        """For each symbol its occurrences among the first low, high values."""
        low, high, start = low.copy(), high.copy(), np.zeros_like(low)
        for k, bits, zeros in self.levels:
            one = (symbol >> k & 1).astype(bool)
            for at in (low, high, start):
                up = bits.rank(at)
                at[:] = np.where(one, zeros + up, at - up)
        return low - start, high - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at i and its occurrences among the first i values."""
        at, start = i.copy(), np.zeros_like(i)
        symbol = np.zeros_like(i)
        for k, bits, zeros in self.levels:
            one = bits.bit(at).astype(bool)
            symbol |= one.astype(symbol.dtype) << k
            for x in (at, start):
                up = bits.rank(x)
                x[:] = np.where(one, zeros + up, x - up)
        return symbol, at - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (0 is a separator; each one is a symbol of its
    own, ordered by position, so no common prefix goes past it). Prefix
    doubling; a round sorts only suffixes that still tie."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = text[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    group = np.repeat(first, np.diff(np.r_[first, n]))
    separators = int(np.searchsorted(ordered, 1))
    group[:separators] = np.arange(separators)
    rank[order] = group
    # Slots of the order whose rank is shared.
    tied = np.flatnonzero(np.r_[group[1:] == group[:-1], False] | np.r_[False, group[1:] == group[:-1]])
    step = 1
    while len(tied):
        here = order[tied]
        # A tied suffix never reaches past the closing separator.
        key = group[tied] * n + rank[here + step]
        by = np.argsort(key, kind="stable")
        key, here = key[by], here[by]
        order[tied] = here
        new = np.r_[True, key[1:] != key[:-1]]
        group_now = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        group[tied] = group_now
        rank[here] = group_now
        same = ~new[1:]
        still = np.r_[same, False] | np.r_[False, same]
        tied = tied[still]
        step *= 2
    return order


class FMIndex:
    """Index of ``text``: symbols 1..alphabet-1, 0 separates; it must begin and
    end with 0."""

    def __init__(self, text: np.ndarray, alphabet: int, sample_every: int = SAMPLE_EVERY):
        self.order_length = n = len(text)
        order = suffix_order(text)
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet))]
        before = text[order - 1]  # the suffix at 0 wraps to the closing separator
        self.matrix = WaveletMatrix(before.astype(np.int32), max(1, int(alphabet - 1).bit_length()))
        # Sampled: every k-th position, and those after a separator, through
        # which no walk goes back.
        sampled = (order % sample_every == 0) | (before == 0)
        self.sampled = BitRank(sampled)
        self.positions = order[sampled].astype(np.int32)
        assert n < 2 ** 31

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: for each phrase (a row of symbols, filled up with
        0) the interval of the suffix order that begins with it."""
        m = len(phrases)
        low, high = np.zeros(m, np.int64), np.full(m, self.order_length, np.int64)
        live = np.arange(m)
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            a, b = self.matrix.rank(symbol, low[live], high[live])
            low[live], high[live] = self.less[symbol] + a, self.less[symbol] + b
        return low, high

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Text positions of slots of the suffix order: walk back to a sample."""
        out = np.empty(len(slots), np.int64)
        at, todo, walked = slots.astype(np.int64), np.arange(len(slots)), 0
        while len(todo):
            known = self.sampled.bit(at).astype(bool)
            out[todo[known]] = self.positions[self.sampled.rank(at[known])] + walked
            todo, at = todo[~known], at[~known]
            if len(todo):
                symbol, rank = self.matrix.access_rank(at)
                at = self.less[symbol] + rank
            walked += 1
        return out
