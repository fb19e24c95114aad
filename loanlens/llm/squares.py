"""Online dyadic square catching over a growing sequence of numbers.

A square is a stretch that repeats itself ``period`` numbers later. Level k is
in charge of the periods from 2b-1 to 4b-2, b = 2^k: a repeated stretch as long
as such a period holds a whole block of b numbers that begins at a multiple of
b. Each completed block is a catcher. Every appended number ends one suffix of b
numbers a level, and the periods of the level leave exactly two catchers that
this suffix may equal, so an appended number makes two suffix comparisons a
level (of fingerprints from prefix sums). Catches of neighbouring blocks by the
same period are one square moving on; as a run of exponent e spans at least
``chain`` such blocks, only chains as long are looked at. They are compared
number by number and extended to the left and, as numbers arrive, to the right,
until the run is maximal.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, start: int, n: int) -> np.ndarray:
    """base^start, ..., base^(start+n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = pow(base, start, 1 << 64)
    return np.cumprod(out, dtype=np.uint64)


class Grown:
    """An array with room to append to."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(256, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.n + len(more)), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[:self.n]


class SquareCatcher:
    """``append`` any number of ids at a time; ``runs`` gives the maximal runs
    of the sequence so far with length >= max(min_length, min_exponent x
    period), as rows (start, length, period) by start, then period. The result
    does not depend on how the ids are dealt to ``append``. No run is longer
    than ``longest`` if that is given (fewer levels are kept then)."""

    def __init__(self, min_exponent: int = 4, min_length: int = 6, longest: int | None = None):
        if min_exponent < 2:
            raise ValueError("a run has an exponent of 2 at least")
        self.exponent, self.least, self.longest = min_exponent, min_length, longest
        self.ids, self.sums, self.inverse = Grown(np.int64), Grown(np.uint64), Grown(np.uint64)
        self.sums.extend(np.zeros(1, np.uint64))
        self.covers = Grown(np.int32)  # a run that holds this place, -1 if none is known
        self.hits: list[tuple[Grown, Grown]] = []  # by level, catcher: does the suffix that begins here equal it
        self.found: list[list[int]] = []  # [start, end, period]
        self.open: list[int] = []  # runs that reach the end of the sequence

    def append(self, ids: np.ndarray) -> None:
        n = self.ids.n
        self.ids.extend(ids)
        values = mixed(ids) * powers(_BASE, n, len(ids))
        self.sums.extend(self.sums.all[-1] + np.cumsum(values, dtype=np.uint64))
        self.inverse.extend(powers(_INVERSE, n, len(ids)))
        self.covers.extend(np.full(len(ids), -1, np.int32))
        still, self.open = self.open, []
        for run in still:
            self._extend(run)
        longest = self.ids.n if self.longest is None else min(self.longest, self.ids.n)
        level = 0
        while self.exponent * ((2 << level) - 1) <= longest:
            self._advance(level)
            level += 1

    def _advance(self, level: int) -> None:
        """Compare the suffixes that the new numbers complete with the level's
        two catchers, and take up the chains that become long enough."""
        b = 1 << level
        if level == len(self.hits):
            self.hits.append((Grown(bool), Grown(bool)))
        first = self.hits[level][0].n
        starts = np.arange(first, self.ids.n - b + 1)
        if not len(starts):
            return
        sums, inverse = self.sums.all, self.inverse.all
        prints = (sums[first + b:] - sums[first:-b]) * inverse[first:first + len(starts)]
        block = (starts - (2 * b - 1)) >> level  # the nearer catcher's number
        low = max(0, (first - 4 * b + 2) >> level)
        at = np.arange(low, max(low, int(block[-1])) + 1) << level
        catchers = (sums[at + b] - sums[at]) * inverse[at]
        chain = ((self.exponent - 1) * (2 * b - 1) - (b - 1)) // b
        for nearer in (0, 1):
            k = block - nearer
            caught = np.zeros(len(starts), bool)
            some = np.searchsorted(k, 0)  # no catcher before the sequence begins
            caught[some:] = prints[some:] == catchers[k[some:] - low]
            hits = self.hits[level][nearer]
            hits.extend(caught)
            if caught.any():
                while not self._take(hits.all, first, b, chain, nearer):
                    pass

    def _take(self, hits: np.ndarray, first: int, b: int, chain: int, nearer: int) -> bool:
        """Whether all chains that reach their length at ``first`` or later
        stood the comparison number by number; false catches are cleared."""
        def back(steps: int) -> np.ndarray:
            at = first - steps * b
            part = hits[max(0, at):len(hits) - steps * b] if len(hits) > steps * b else hits[:0]
            return np.concatenate([np.zeros(len(hits) - first - len(part), bool), part])

        long = hits[first:].copy()
        for steps in range(1, chain):
            long &= back(steps)
        if not long.any():
            return True
        long &= ~back(chain)
        ids = self.ids.all
        for at in (np.flatnonzero(long) + first).tolist():
            block = (((at - (2 * b - 1)) // b) - nearer) * b
            period, begin = at - block, block - (chain - 1) * b
            run = self.covers.all[begin]
            if run >= 0:
                _, end, p = self.found[run]
                if end >= at + b and period % p == 0:
                    continue  # the same run, by a multiple of its period
            if not np.array_equal(ids[begin:block + b], ids[begin + period:at + b]):
                for k in range(chain):
                    x = block - k * b
                    if not np.array_equal(ids[x:x + b], ids[x + period:x + period + b]):
                        hits[x + period] = False
                return False
            self._add(begin, at + b, period)
        return True

    def _add(self, begin: int, end: int, period: int) -> None:
        ids, step = self.ids.all, 32
        while begin:
            width = min(step, begin)
            same = ids[begin - width:begin] == ids[begin - width + period:begin + period]
            if same.all():
                begin -= width
                step *= 2
                continue
            begin -= int(np.argmin(same[::-1]))
            break
        self.found.append([begin, end, period])
        self.covers.all[begin:end] = len(self.found) - 1
        self._extend(len(self.found) - 1)

    def _extend(self, run: int) -> None:
        """To the right, as far as there are numbers."""
        begin, end, period = self.found[run]
        ids, step, old = self.ids.all, 32, end
        while end < len(ids):
            same = ids[end:end + step] == ids[end - period:min(end + step, len(ids)) - period]
            if same.all():
                end += len(same)
                step *= 2
                continue
            end += int(np.argmin(same))
            break
        else:
            self.open.append(run)
        self.found[run][1] = end
        self.covers.all[old:end] = run

    def runs(self) -> np.ndarray:
        smallest: dict[tuple[int, int], int] = {}
        for begin, end, period in self.found:
            key = (begin, end)
            smallest[key] = min(period, smallest.get(key, period))
        rows = sorted((begin, end - begin, p) for (begin, end), p in smallest.items()
                      if end - begin >= max(self.least, self.exponent * p))
        rows.sort(key=lambda r: (r[0], r[2]))
        return np.array(rows, np.int64).reshape(-1, 3)
