"""Categories that are points still, apart from those that have grown to boxes: what a search needs of each.

In complement code a category that has learnt one row, or copies of it, is that row: its
weight adds up to the number of dimensions, as does every other point's. So of two points
the nearer one is more active and matches better, and a search can only reach the nearest
ones. Where a box is taken before, it is enough that no point is as near as the box is active.
"""

from __future__ import annotations

import numpy as np

#: Steps of a distance that cannot be.
FAR = 65_535
#: Points from which on a first look takes some places only, and how many these may be.
MANY, LOOKS = 500, (8, 16, 24, 32, 48)


class Points:
    """A module's points, by columns in order of their sums, new ones after them; and a sketch of its boxes."""

    def __init__(self, kernel, cats):
        self.kernel, self.cats, self.late = kernel, cats, list(range(cats.size))
        #: Of each category: its column, or -2 less its number among the boxes, or -1.
        self.at = np.zeros(0, np.int64)
        self.ids, self.places, self.sums, self.size, self.sorted = np.zeros(0, np.int64), None, np.zeros(0, np.int64), 0, 0
        self.gone: list[int] = []  # columns of former points
        #: Sums of each point in its first places, as many as LOOKS says and all.
        self.heads = np.zeros((len(LOOKS) + 1, 0), np.uint16)
        #: What nearly all points are apart in each of LOOKS.
        self.usual = [0.0] * len(LOOKS)
        self.boxes, self.many, self.sketch = np.zeros(0, np.int64), 0, {}

    def read(self) -> dict[str, np.ndarray]:
        """The sketch of the boxes, once what is new or has changed is in its place."""
        if self.late:
            late = np.unique(np.array(self.late, np.int64))
            self.late.clear()
            if len(self.at) < self.cats.size:
                self.at = np.concatenate([self.at, np.full(max(1024, 2 * self.cats.size) - len(self.at), -1, np.int64)])
            single = self.kernel.single(self.cats.w[late]) & (self.at[late] == -1)
            self._put(late[single])
            grown = late[~single]
            for j in grown[self.at[grown] >= 0].tolist():
                self.drop(j)
            self._grow(grown)
            if self.size - self.sorted > max(512, self.sorted // 16) or 16 * len(self.gone) > self.size:
                self._sort()
        return {k: v[..., : self.many] for k, v in self.sketch.items()}

    def _put(self, ids: np.ndarray) -> None:
        n, places = self.size + len(ids), self.kernel.places(self.cats.w[ids])
        if self.places is None or n > len(self.ids):
            room = 2 * n // 2048 * 2048 + 2144  # lines that do not fall on the same places of a core's cache
            old = self.places if self.places is not None else places[:, :0]
            self.places = np.zeros((len(places), room), places.dtype)
            self.places[:, : self.size] = old[:, : self.size]
            self.ids, self.sums = (np.concatenate([v[: self.size], np.zeros(room - self.size, np.int64)]) for v in (self.ids, self.sums))
            self.heads = np.concatenate([self.heads[:, : self.size], np.zeros((len(LOOKS) + 1, room - self.size), np.uint16)], 1)
        new = slice(self.size, n)
        self.ids[new], self.places[:, new], self.sums[new] = ids, places, self.kernel.place_sums(places)
        for head, k in zip(self.heads, (*LOOKS, len(places)), strict=True):
            np.add.reduce(places[:k], 0, dtype=np.uint16, out=head[new])
        self.at[ids] = np.arange(self.size, n)
        self.size = n

    def _grow(self, ids: np.ndarray) -> None:
        """Boxes that are new or have changed."""
        new = ids[self.at[ids] == -1]
        n = self.many + len(new)
        if n > len(self.boxes):
            self.boxes = np.concatenate([self.boxes[: self.many], np.zeros(max(1024, 2 * n) - self.many, np.int64)])
        self.boxes[self.many : n] = new
        self.at[new] = -2 - np.arange(self.many, n)
        self.many = n
        if not len(ids):
            return
        for name, v in self.kernel.sketch(self.cats.w[ids]).items():
            old = self.sketch.get(name)
            if old is None or old.shape[-1] < len(self.boxes):
                wide = np.zeros((*v.shape[:-1], len(self.boxes)), v.dtype)
                if old is not None:
                    wide[..., : old.shape[-1]] = old
                self.sketch[name] = old = wide
            old[..., -2 - self.at[ids]] = v

    def _sort(self) -> None:
        stay = np.ones(self.size, bool)
        stay[self.gone] = False
        keep = np.flatnonzero(stay)
        keep = keep[np.argsort(self.sums[keep], kind="stable")]
        n = len(keep)
        self.ids[:n], self.places[:, :n], self.sums[:n], self.heads[:, :n] = self.ids[keep], self.places[:, keep], self.sums[keep], self.heads[:, keep]
        self.at[self.ids[:n]] = np.arange(n)
        self.size = self.sorted = n
        self.gone = []
        some = self.places[:, : n : 1 + n // 256]
        for i, k in enumerate(LOOKS):
            if n and k < len(some):
                apart = np.concatenate([self.kernel.place_gaps(some[:k], v[:k]) for v in some[:, ::8].T])
                self.usual[i] = float(np.quantile(apart, 0.03))

    def column(self, j: int) -> int:
        """The number among the boxes of a category that is one by now, else -1."""
        return int(-2 - self.at[j]) if j < len(self.at) and self.at[j] < -1 else -1

    def drop(self, j: int) -> None:
        """Category j is no point any more."""
        if j < len(self.at) and self.at[j] >= 0:
            self.gone.append(int(self.at[j]))
            self.at[j] = -1

    def nearest(self, own: np.ndarray, margin: int) -> np.ndarray:
        """The points that are at most a margin farther from a row than the nearest one, in steps."""
        gap = self.kernel.place_gaps(self.places[:, : self.size], own, self.heads[-1]) if self.size else np.zeros(0, np.uint16)
        gap[self.gone] = FAR
        least = int(gap.min(initial=FAR))
        return self.ids[: len(gap)][gap <= least + margin] if least + margin < FAR else self.ids[: len(gap)][gap < FAR]

    def within(self, own: np.ndarray, most: int) -> bool:
        """Whether a point is at most so many steps away from a row."""
        if most >= FAR:
            return True
        spread = self.kernel.place_sums(own[:, None])[0]
        a, b = np.searchsorted(self.sums[: self.sorted], (spread - most, spread + most + 1))
        for first, last in ((int(a), int(b)), (self.sorted, self.size)):
            if first == last:
                continue
            part = self.places[:, first:last]
            look, head = len(own), -1
            if last - first > MANY:  # the fewest places in which most points are too far away
                look, head = next(((k, i) for i, (k, far) in enumerate(zip(LOOKS, self.usual, strict=True)) if k < look and far > most), (look, head))
            near = np.flatnonzero(self.kernel.place_gaps(part[:look], own[:look], self.heads[head, first:last]) <= most)
            if look < len(own) and len(near):
                near = near[self.kernel.place_gaps(part[:, near], own) <= most]
            if len(near) and not set((near + first).tolist()).issubset(self.gone):
                return True
        return False
