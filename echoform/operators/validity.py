"""Cluster validity indices of a table of rows, kept up to date while single rows change their cluster.

All rows start in cluster 0. moved() gives the index if a row changed its cluster, move()
lets it. The values are those of compound.validity() on all rows: 0 below two clusters or
where every row is its own.
"""

from __future__ import annotations

import numpy as np

from echoform.operators.learners import CalinskiHarabasz


class _Index:
    def __init__(self, data: np.ndarray):
        self.data, self.labels = data, np.zeros(len(data), np.int64)
        self.count: dict[int, int] = {0: len(data)} if len(data) else {}
        self.value = 0.0

    def _counts(self, i: int, c: int) -> dict[int, int]:
        out = dict(self.count)
        out[int(self.labels[i])] -= 1
        out[c] = out.get(c, 0) + 1
        return {k: n for k, n in out.items() if n}

    def _plain(self, count: dict[int, int]) -> bool:
        return not 2 <= len(count) < len(self.data)

    def moved(self, i: int, c: int) -> float:
        """The index with row i in cluster c."""
        if c == self.labels[i]:
            return self.value
        count = self._counts(i, c)
        return 0.0 if self._plain(count) else self._value(i, c, count)

    def move(self, i: int, c: int) -> None:
        if c == self.labels[i]:
            return
        value, count = self.moved(i, c), self._counts(i, c)
        self._change(i, c)
        self.value, self.count, self.labels[i] = value, count, c


class Scatter(_Index):
    """Calinski-Harabasz: a count, a mean and a scatter for each cluster."""

    def __init__(self, data: np.ndarray):
        super().__init__(data)
        self.index = CalinskiHarabasz()
        for x in data:
            self.index.add(x, 0)

    def _value(self, i, c, count):
        return self.index.moved(self.data[i], int(self.labels[i]), c)

    def _change(self, i, c):
        self.index.move(self.data[i], int(self.labels[i]), c)


class Separation(_Index):
    """Davies-Bouldin: a mean and a mean distance from it for each cluster; only the two clusters that a row leaves and joins are looked at again."""

    def __init__(self, data: np.ndarray):
        super().__init__(data)
        self.parts = {0: self._part(np.arange(len(data)))} if len(data) else {}

    def _part(self, members: np.ndarray) -> tuple[np.ndarray, float]:
        own = self.data[members]
        mean = own.mean(0)
        return mean, float(np.sqrt(((own - mean) ** 2).sum(1)).mean())

    def _after(self, i: int, c: int) -> dict:
        parts, old = dict(self.parts), int(self.labels[i])
        left = np.flatnonzero(self.labels == old)
        left = left[left != i]
        if len(left):
            parts[old] = self._part(left)
        else:
            del parts[old]
        parts[c] = self._part(np.union1d(np.flatnonzero(self.labels == c), [i]))
        return parts

    def _value(self, i, c, count):
        parts = self._after(i, c)
        names = sorted(parts)
        mean, spread = np.stack([parts[k][0] for k in names]), np.array([parts[k][1] for k in names])
        far = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
        ratio = np.divide(spread[:, None] + spread[None], far, out=np.zeros_like(far), where=far > 0)
        return float(ratio.max(1).mean())

    def _change(self, i, c):
        self.parts = self._after(i, c)


class Silhouette(_Index):
    """Mean silhouette: the sum of distances from each row to each cluster, of which a move changes two columns."""

    def __init__(self, data: np.ndarray):
        super().__init__(data)
        self.sums = {0: np.array([np.sqrt(((data - x) ** 2).sum(1)).sum() for x in data])} if len(data) else {}
        self._row, self._far = -1, np.zeros(0)

    def _distances(self, i: int) -> np.ndarray:
        if i != self._row:
            self._row, self._far = i, np.sqrt(((self.data - self.data[i]) ** 2).sum(1))
        return self._far

    def _after(self, i: int, c: int) -> dict:
        sums, old, far = dict(self.sums), int(self.labels[i]), self._distances(i)
        sums[old] = sums[old] - far
        sums[c] = sums.get(c, 0.0) + far
        return sums

    def _value(self, i, c, count):
        sums, n, labels = self._after(i, c), len(self.data), self.labels.copy()
        labels[i] = c
        names = sorted(count)
        which = np.searchsorted(names, labels)
        table, many = np.stack([sums[k] for k in names], 1), np.array([count[k] for k in names], float)
        own = np.maximum(table[np.arange(n), which], 0) / np.maximum(many[which] - 1, 1)
        other = table / many
        other[np.arange(n), which] = np.inf
        b = other.min(1)
        s = np.where((many[which] > 1) & (np.maximum(own, b) > 0), (b - own) / np.where(np.maximum(own, b) > 0, np.maximum(own, b), 1), 0.0)
        return float(s.mean())

    def _change(self, i, c):
        old = int(self.labels[i])
        self.sums = self._after(i, c)
        if self.count[old] == 1:
            del self.sums[old]


INDICES = {"ch": Scatter, "db": Separation, "silhouette": Silhouette}
