"""Orchard's search for the nearest entry of a list (Orchard, "A fast
nearest-neighbor search algorithm", 1991), for many vectors at once.

Every entry has a list of all entries by distance from it. A vector's search
goes down the list of its current entry, passes over entries it has visited,
jumps to the list of an entry that is nearer, and stops where the list's entries
are beyond twice the current distance: by the triangle inequality none there can
be nearer. Entries at exactly twice the distance may be as near, so they are
still looked at, and of equally near entries the one of lower index is kept.

The vectors that are at the same place of the same list take their next
``BLOCK`` neighbours together, by one matrix product. All arithmetic is exact.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32


def exact_type(most: int, width: int) -> type:
    """The number type in which squared distances between vectors of ``width``
    integers of at most ``most`` in size, and their parts, are exact."""
    bound = 4 * width * most * most * 2
    if bound < 1 << 53:
        return np.float64  # products by the BLAS library
    if bound < 1 << 63:
        return np.int64
    raise ValueError(f"components up to {most} have squared distances beyond 64 bits")


class Orchard:
    """The entries of one codebook with their lists of neighbours."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.norms = (entries * entries).sum(1)
        between = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        self.lists = np.argsort(between, axis=1, kind="stable")
        self.gaps = np.take_along_axis(between, self.lists, 1)

    def distances(self, points: np.ndarray, norms: np.ndarray, entries) -> np.ndarray:
        return norms[:, None] + self.norms[entries] - 2 * (points @ self.entries[entries].T)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry and the squared distance."""
        n, k = len(points), len(self.entries)
        norms = (points * points).sum(1)
        current, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = self.distances(points, norms, np.zeros(1, np.int64))[:, 0]
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        active = np.arange(n)
        while len(active):
            spots = current[active] * k + place[active]
            order = np.argsort(spots, kind="stable")
            active, spots = active[order], spots[order]
            cuts = np.flatnonzero(np.diff(spots)) + 1
            for rows in np.split(active, cuts):
                entry, at = int(current[rows[0]]), int(place[rows[0]])
                near = self.lists[entry, at:at + BLOCK]
                gaps = self.gaps[entry, at:at + BLOCK]
                skip = visited[np.ix_(rows, near)] | (gaps > 4 * best[rows, None])
                visited[np.ix_(rows, near)] = True
                place[rows] = at + len(near)
                rows, skip = rows[~skip.all(1)], skip[~skip.all(1)]
                if not len(rows):
                    continue
                found = self.distances(points[rows], norms[rows], near)
                found = np.where(skip, best[rows, None] + 1, found)
                least = found.min(1)
                index = np.where(found == least[:, None], near, k).min(1)
                better = (least < best[rows]) | ((least == best[rows]) & (index < current[rows]))
                rows = rows[better]
                current[rows], best[rows], place[rows] = index[better], least[better], 0
            ends = place[active] >= k
            gap = self.gaps[current[active], np.minimum(place[active], k - 1)]
            active = active[~(ends | (gap > 4 * best[active]))]
        return current, best
