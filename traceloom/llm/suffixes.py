"""Suffix sorting by prefix hashes: a common extension is found by binary search, so a comparison takes a logarithmic number of hash look-ups."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0xD6E8FEB86659FD93
VALUES = np.random.default_rng(101).integers(1, 2**63, 256, dtype=np.uint64)


class Suffixes:
    """Suffixes of the rows of a byte matrix, each read for `reach` bytes; a suffix is (row, first byte)."""

    def __init__(self, data: np.ndarray, reach: int):
        self.data, self.reach, width = data, reach, data.shape[1]
        power = np.multiply.accumulate(np.append(U(1), np.full(width, U(BASE))))
        self.down = np.multiply.accumulate(np.append(U(1), np.full(width, U(pow(BASE, -1, 2**64)))))
        self.sums = np.zeros((len(data), width + 1), U)
        np.cumsum(VALUES[data] * power[None, :width], axis=1, out=self.sums[:, 1:])
        self.sums = self.sums.ravel()
        self.width = width + 1

    def common(self, row: np.ndarray, at: np.ndarray, row2: np.ndarray, at2: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of each pair, `reach` at most: the longest prefixes of equal hash."""
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.reach)
        one, two = row * self.width + at, row2 * self.width + at2
        base, base2 = self.sums[one], self.sums[two]
        down, down2 = self.down[at], self.down[at2]
        for _ in range(self.reach.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.sums[one + mid] - base) * down == (self.sums[two + mid] - base2) * down2
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, row: np.ndarray, at: np.ndarray, row2: np.ndarray, at2: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether each suffix comes before its partner; equal ones by `ties`."""
        n = self.common(row, at, row2, at2)
        last = np.minimum(n, self.reach - 1)
        a, b = self.data[row, at + last], self.data[row2, at2 + last]
        return np.where(n == self.reach, ties, a < b)

    def sort(self, row: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes inside each group (a run of equal numbers), stable: a merge sort from runs of one, all
        groups at a time. An element's place in a merge is its own plus that found by binary search in the other run."""
        order = np.arange(len(row))
        start = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        size = np.diff(np.append(start, len(row)))
        first, n = np.repeat(start, size), np.repeat(size, size)
        width = 1
        while (live := np.flatnonzero(n > width)).size:
            local = live - first[live]
            run = local // width
            right = (run & 1).astype(bool)
            lo = first[live] + np.where(right, run - 1, run + 1) * width
            end = first[live] + n[live]
            hi = np.minimum(np.where(right, lo + width, lo + width), end)
            lo = np.minimum(lo, end)
            base = lo.copy()
            me = order[live]
            while (some := np.flatnonzero(lo < hi)).size:
                mid = (lo[some] + hi[some]) >> 1
                x, y = me[some], order[mid]
                # of equal ones, those of the left run come first
                up = self.before(row[y], at[y], row[x], at[x], right[some])
                lo[some], hi[some] = np.where(up, mid + 1, lo[some]), np.where(up, hi[some], mid)
            place = first[live] + (run & ~1) * width + (local - run * width) + lo - base
            merged = order.copy()
            merged[place] = me
            order, width = merged, width * 2
        return order

    def extensions(self, row: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): sorted suffixes, and how many first bytes each has in common with the one before it; -1 for
        the first of a group. Lengths that the hashes tell are verified on the bytes; a group in which one is wrong
        is sorted by its bytes."""
        order, span = self.sort(row, at, group), np.arange(self.reach)
        common = np.full(len(order), -1)
        pair = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        a, b = order[pair - 1], order[pair]
        common[pair] = self.common(row[a], at[a], row[b], at[b])
        wrong = []
        for lo in range(0, len(pair), 4096):
            p, x, y = pair[lo : lo + 4096], a[lo : lo + 4096], b[lo : lo + 4096]
            same = self.data[row[x, None], at[x, None] + span] == self.data[row[y, None], at[y, None] + span]
            true = np.where(same.all(axis=1), self.reach, same.argmin(axis=1))
            wrong.append(group[order[p[true != common[p]]]])
        for g in np.unique(np.concatenate(wrong)) if wrong else []:  # a collision
            own = np.flatnonzero(group == g)
            text = [self.data[r, p : p + self.reach].tobytes() for r, p in zip(row[own], at[own], strict=True)]
            by = sorted(range(len(own)), key=text.__getitem__)
            order[own] = own[by]
            common[own[1:]] = [next((n for n, (c, d) in enumerate(zip(text[i], text[j], strict=True)) if c != d), self.reach) for i, j in zip(by, by[1:], strict=False)]
        return order, common
