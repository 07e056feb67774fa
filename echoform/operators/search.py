"""Growing category tables and the resonance search with its tracking rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from echoform.operators.points import FAR, Points

METHODS = ("MT+", "MT-", "MT0", "MT1", "MT~")
#: Which categories may take the row: a test, or flags of all categories.
Allowed = Callable[[int], bool] | np.ndarray


#: Weights of fewer numbers than this lie by columns, so that sums over a weight run along all categories; the order of their terms is the same.
NARROW = 7


class Categories:
    """Weights of one module, one row each, with the number of rows learnt."""

    def __init__(self) -> None:
        self._w, self._n, self.size = np.zeros((0, 0)), np.zeros(0, np.int64), 0
        self.touched: list[int] | None = None  # where a list: numbers of categories that are new or have learnt
        self.outline: Outline | None = None  # where many categories are searched by rough scores
        self.cover: Cover | None = None  # where they are searched by the levels that their boxes cover
        self.bare = 0  # categories up to which that does not pay
        self.points: Points | None = None  # where points are searched apart from boxes
        self.grown = 0  # categories up to which that does not pay

    @property
    def w(self) -> np.ndarray:
        return self._w[: self.size]

    @property
    def n(self) -> np.ndarray:
        return self._n[: self.size]

    def add(self, w: np.ndarray) -> int:
        if self.size == len(self._w):
            room = max(16, 2 * self.size)
            grown = np.zeros((room, len(w)), order="F" if len(w) < NARROW else "C")
            counts = np.zeros(room, np.int64)
            if self.size:
                grown[: self.size], counts[: self.size] = self.w, self.n
            self._w, self._n = grown, counts
        self._w[self.size], self._n[self.size] = w, 1
        if self.touched is not None:
            self.touched.append(self.size)
        for known in (self.outline, self.cover, self.points):
            if known is not None:
                known.late.append(self.size)
        self.size += 1
        return self.size - 1

    def set(self, j: int, w: np.ndarray) -> None:
        self._w[j] = w
        self._n[j] += 1
        if self.touched is not None:
            self.touched.append(j)
        for known in (self.outline, self.cover, self.points):
            if known is not None:
                known.late.append(j)

    def keep(self, mask: np.ndarray) -> None:
        self._w, self._n = self.w[mask].copy("F" if self._w.shape[1] < NARROW else "C"), self.n[mask].copy()
        self.size, self.outline, self.cover, self.points = len(self._w), None, None, None

    @classmethod
    def of(cls, weights: list, counts: list | None = None) -> Categories:
        out = cls()
        for w in weights:
            out.add(np.asarray(w, float))
        if counts is not None and len(weights):
            out._n[: out.size] = counts
        return out


def check_method(method: str) -> bool:
    """Whether the comparison with the vigilance is strict."""
    if method not in METHODS:
        raise ValueError(f"match tracking must be one of {METHODS}, not {method!r}")
    return method in ("MT0", "MT~")


def by_activation(t: np.ndarray) -> np.ndarray:
    """Categories from the most active on, the older first on ties; NaN is left out."""
    order = np.argsort(-t, kind="stable")
    return order[~np.isnan(t[order])]


def most_active(t: np.ndarray, among: np.ndarray | None = None) -> int:
    """First of by_activation(t) (among some), or -1."""
    if among is not None:
        k = np.flatnonzero(among)
        if not len(k):
            return -1
        j = most_active(t[k])
        return int(k[j]) if j >= 0 else -1
    j = int(t.argmax())
    if t[j] == t[j]:
        return j
    order = by_activation(t)  # NaN comes out of argmax first
    return int(order[0]) if len(order) else -1


def resonant(kernel, cats: Categories, x: np.ndarray, allowed: Allowed | None = None, method: str = "MT+", epsilon: float = 0.0) -> tuple[int, dict]:
    """(category that takes the row, or -1 for none; cache of its activation).

    Without a predicate the first category that passes the vigilance wins. With one, a
    category that passes but is refused moves the vigilance by the tracking method, or
    ends the search. MT~ asks the predicate first and never moves the vigilance.
    """
    strict = check_method(method)
    if not cats.size:
        return -1, {}
    t, cache = kernel.activate(cats.w, x, cats.n)
    if not kernel.inverted:
        return choose(kernel, t, kernel.matches(cats.w, x, cache), allowed, method, epsilon), cache
    order = by_activation(t)
    if allowed is not None and method == "MT~":
        order, allowed = _among(order, allowed), None
    return _one_by_one(kernel, order, lambda j: kernel.match(cats.w, x, cache, j), allowed, method, epsilon, strict), cache


def _among(order: np.ndarray, allowed: Allowed) -> np.ndarray:
    return order[allowed[order]] if isinstance(allowed, np.ndarray) else np.array([j for j in order.tolist() if allowed(j)], int)


def choose(kernel, t: np.ndarray, match: np.ndarray, allowed: Allowed | None = None, method: str = "MT+", epsilon: float = 0.0) -> int:
    """The search over known activations and matches of all categories; for kernels whose vigilance bounds from below."""
    strict, rho = check_method(method), kernel.rho
    passes = match > rho if strict else match >= rho
    if allowed is None:  # the most active of those that pass; nothing needs an order
        return most_active(t, passes)
    if method == "MT~":
        return most_active(t, _flags(passes, allowed))
    # The most active of those left is looked at; once it is refused, those that fall below the vigilance it leaves go.
    left = np.flatnonzero(passes & ~np.isnan(t))
    own_t, own_match = t[left], match[left]
    while len(left):
        k = int(own_t.argmax())
        j = int(left[k])
        if allowed[j] if isinstance(allowed, np.ndarray) else allowed(j):
            return j
        lower = rho
        rho, go_on = kernel.track(float(own_match[k]), rho, epsilon, method)
        if not go_on:
            break
        if rho < lower:  # categories that failed before may pass now
            order = by_activation(t)
            after = order[int(np.flatnonzero(order == j)[0]) + 1 :]
            return _one_by_one(kernel, after, lambda j: match[j], allowed, method, epsilon, strict, rho)
        stay = own_match > rho if strict else own_match >= rho
        stay[k] = False
        left, own_t, own_match = left[stay], own_t[stay], own_match[stay]
    return -1


def _flags(passes: np.ndarray, allowed: Allowed) -> np.ndarray:
    """Those that pass and are allowed."""
    if isinstance(allowed, np.ndarray):
        return passes & allowed
    out = passes.copy()
    out[[j for j in np.flatnonzero(passes).tolist() if not allowed(j)]] = False
    return out


def _one_by_one(kernel, order: np.ndarray, match: Callable[[int], float], allowed, method: str, epsilon: float, strict: bool, rho: float | None = None) -> int:
    """The search for kernels whose match is costly, or once the vigilance has fallen."""
    rho = kernel.rho if rho is None else rho
    for j in order.tolist():
        m = match(j)
        if not kernel.resonates(m, rho, strict):
            continue
        if allowed is None or (allowed[j] if isinstance(allowed, np.ndarray) else allowed(j)):
            return j
        rho, go_on = kernel.track(m, rho, epsilon, method)
        if not go_on:
            break
    return -1


def learn(kernel, cats: Categories, x: np.ndarray, allowed: Allowed | None = None, method: str = "MT+", epsilon: float = 0.0) -> int:
    """Let the row's category learn it, or add one; returns its number."""
    j, cache = resonant(kernel, cats, x, allowed, method, epsilon)
    if j < 0:
        return cats.add(kernel.new(x))
    cats.set(j, kernel.update(cats.w[j], x, cache, j))
    return j


def nearest(kernel, cats: Categories, x: np.ndarray, vigilant: bool = False) -> int:
    """Most active category; if vigilant, of those that pass the vigilance (0 where none does)."""
    if not cats.size:
        return -1
    t, cache = kernel.activate(cats.w, x, cats.n)
    if vigilant and kernel.inverted:
        return next((j for j in by_activation(t).tolist() if kernel.resonates(kernel.match(cats.w, x, cache, j), kernel.rho, False)), 0)
    return max(0, most_active(t, kernel.matches(cats.w, x, cache) >= kernel.rho if vigilant else None))


#: Numbers that the scoring of a tile may hold, and the rows of a tile.
TILE_NUMBERS, TILE_ROWS = 2_000_000, 256
#: Rows that are learnt one by one before a look whether a tile pays; the choice changes no result.
ROW_RUN = 32


class Tile:
    """Scores of a block of rows against all categories of a module, kept right as categories change.

    Only the column of a category that changed is computed anew, for the rows that are
    left, so a row costs what its own change costs. Scores are the same numbers that one
    row at a time gives: each is a reduction over the same vector.
    """

    def __init__(self, kernel, cats: Categories, x: np.ndarray):
        self.kernel, self.cats, self.x = kernel, cats, x
        room = cats.size + 16
        self._t, self._m = np.full((len(x), room), -np.inf), np.full((len(x), room), -np.inf)
        if cats.size:
            self._t[:, : cats.size], self._m[:, : cats.size] = kernel.score_rows(cats.w, x)

    @staticmethod
    def rows(kernel, cats: Categories, width: int) -> int:
        """How many rows a tile takes at the categories there are."""
        return max(1, min(TILE_ROWS, TILE_NUMBERS // (max(1, cats.size) * max(1, width))))

    def scores(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Activations and matches of rows a to b."""
        t, m, n = self._t[a:b, : self.cats.size], self._m[a:b, : self.cats.size], self.kernel.norm(self.cats.w)
        return (t if n is None else t / n), m

    def changed(self, j: int, row: int) -> None:
        """Category j is new or has changed: its scores for the rows after a row."""
        if j >= self._t.shape[1]:
            more = np.full((len(self.x), max(16, j)), -np.inf)
            self._t, self._m = np.concatenate([self._t, more], 1), np.concatenate([self._m, more.copy()], 1)
        if row + 1 < len(self.x):
            t, m = self.kernel.score_rows(self.cats.w[j : j + 1], self.x[row + 1 :])
            self._t[row + 1 :, j], self._m[row + 1 :, j] = t[:, 0], m[:, 0]

    def winners(self, a: int, b: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
        """The most active category that passes, for rows a to b (-1 for none), and their masked activations."""
        t, m = self.scores(a, b)
        held = np.where((m > self.kernel.rho if strict else m >= self.kernel.rho) & ~np.isnan(t), t, -np.inf)
        j = held.argmax(1)
        return np.where(held[np.arange(len(j)), j] > -np.inf, j, -1), held

    def learn(self, row: int, j: int) -> int:
        """Let category j (or a new one, at -1) learn a row; returns its number."""
        kernel, cats, x = self.kernel, self.cats, self.x[row]
        if j < 0:
            j = cats.add(kernel.new(x))
        else:
            one = cats.w[j : j + 1]
            cats.set(j, kernel.update(cats.w[j], x, kernel.activate(one, x, cats.n[j : j + 1])[1], 0))
        self.changed(j, row)
        return j


def still(kernel, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row, whether learning it leaves its category's weight (the same line of w) as it is."""
    new = kernel.update_rows(w, x)
    return np.zeros(len(x), bool) if new is None else (new == w).all(1)


#: Rows of a tile that is searched by rough scores, and the rough scores that it may hold.
ROUGH_ROWS, ROUGH_NUMBERS = 64, 4_000_000
#: Pairs of a row and a category whose scores are computed at once.
PAIRS = 16_384


class Outline:
    """A kernel's sketch of all categories of a module; those that are new or have changed are sketched when it is next read."""

    def __init__(self, kernel, cats: Categories):
        self.kernel, self.cats, self.arrays, self.late = kernel, cats, {}, list(range(cats.size))
        self.rows = ROUGH_ROWS  # rows of the next tile

    def read(self) -> dict[str, np.ndarray]:
        """The sketch: arrays whose last axis is the categories."""
        size = self.cats.size
        if self.late:
            late = np.unique(np.array(self.late, np.int64))
            self.late.clear()
            for name, v in self.kernel.sketch(self.cats.w[late]).items():
                old = self.arrays.get(name)
                if old is None or old.shape[-1] < size:
                    grown = np.zeros((*v.shape[:-1], max(1024, 2 * size)), v.dtype)
                    if old is not None:
                        grown[..., : old.shape[-1]] = old
                    self.arrays[name] = old = grown
                old[..., late] = v
        return {k: v[..., :size] for k, v in self.arrays.items()}


def outlined(kernel, cats: Categories, stairs: bool = False, method: str = "MT1", epsilon: float = 0.0) -> bool:
    """Whether rough scores pay: a kernel that has them, many categories, and a search that lets no category in again that has failed. stairs: whether it goes on after a refusal."""
    return 0 < kernel.many[stairs] <= cats.size and method in ("MT+", "MT0", "MT1") and epsilon >= 0


class Shortlist:
    """For a block of rows, the categories that a search can reach, told by rough scores with a bound on their errors.

    A search by activation never reaches a category if another one is surely more active,
    surely passes the vigilance and surely matches better: it is either taken before, or
    raises the vigilance beyond it. Where the first one that passes ends the search, being
    surely more active is enough. Scores of the others are then the kernel's own.
    """

    def __init__(self, kernel, cats: Categories, x: np.ndarray, stairs: bool, blind: bool = False):
        self.kernel, self.cats, self.x, self.stairs, self.again = kernel, cats, x, stairs, 0
        if cats.outline is None or cats.outline.kernel != kernel:
            cats.outline = Outline(kernel, cats)
        got = kernel.rough(cats.outline.read(), x, blind)
        self.known = got is not None
        if self.known:
            self.t, self.m, self.t_off, self.m_off, self.floor = got
            if self.floor > -np.inf:
                np.copyto(self.t, -np.inf, where=self.m < self.floor - self.m_off)
            self.rows, self.at, self.ahead = self._reached(self.t, self.m)
            self.ends = np.searchsorted(self.rows, np.arange(len(x) + 1))
            self.own_t, self.own_m = self._scores(self.rows, self.at)

    def _reached(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, category) pairs that can be reached, in order, and whether the category keeps others of its row from being reached."""
        line, sure = np.arange(len(t)), t
        if self.floor > -np.inf:
            sure = np.where(m >= self.floor + self.m_off, t, -np.inf)
        first = sure.argmax(1)
        # Where nothing passes surely, -inf leaves all that may pass.
        keep = t >= (sure[line, first] - 2 * self.t_off)[:, None]
        if self.stairs:
            there = sure[line, first] > -np.inf
            keep |= m >= np.where(there, m[line, first] - 2 * self.m_off, -np.inf)[:, None]
            best = (m if sure is t and self.floor == -np.inf else np.where(sure > -np.inf, m, -np.inf)).argmax(1)
            keep &= (t >= (sure[line, best] - 2 * self.t_off)[:, None]) | (m >= np.where(there, m[line, best] - 2 * self.m_off, -np.inf)[:, None])
        keep &= t > -np.inf
        rows, at = np.nonzero(keep)
        ahead = at == first[rows]
        if not self.stairs:
            return rows, at, ahead
        ahead |= at == best[rows]
        if len(rows) < 64 * len(t):
            return rows, at, ahead
        good, ends = np.ones(len(rows), bool), np.searchsorted(rows, np.arange(len(t) + 1))
        for r in range(len(t)):
            a, b = ends[r], ends[r + 1]
            own_t, own_m, own_sure = t[r, at[a:b]], m[r, at[a:b]], sure[r, at[a:b]] > -np.inf
            order = np.argsort(-own_t, kind="stable")
            down = -own_t[order]
            high = np.maximum.accumulate(np.where(own_sure[order], own_m[order], -np.inf))
            before = np.searchsorted(down, down - 2 * self.t_off, "left")  # how many are surely more active
            good[a + order] = (before == 0) | (own_m[order] >= high[before - 1] - 2 * self.m_off)
            ahead[a + order[1:]] |= high[1:] > high[:-1]
            ahead[a + order[0]] = True
        return rows[good], at[good], ahead[good]

    def _scores(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.kernel.score_pairs(self.cats.w[at[a : a + PAIRS]], self.x[rows[a : a + PAIRS]]) for a in range(0, max(1, len(at)), PAIRS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def row(self, r: int, changed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(categories, activations before norm(), matches) of a row, without the categories that have changed (flags of all) since."""
        a, b = self.ends[r], self.ends[r + 1]
        at = self.at[a:b]
        lost = None if changed is None else changed[at]
        if lost is None or not lost.any():
            return at, self.own_t[a:b], self.own_m[a:b]
        if not (lost & self.ahead[a:b]).any():
            return at[~lost], self.own_t[a:b][~lost], self.own_m[a:b][~lost]
        t = self.t[r : r + 1].copy()
        t[0, changed[: t.shape[1]]] = -np.inf
        self.again += 1
        rows, at, _ = self._reached(t, self.m[r : r + 1])
        return at, *self._scores(rows + r, at)


def learn_outlined(kernel, cats: Categories, x: np.ndarray, method: str, epsilon: float, classes: tuple[np.ndarray, np.ndarray] | None, at: int, founded: Callable[[int, int], np.ndarray] | None, out: np.ndarray) -> tuple[int, tuple | None]:
    """learn_rows() from row at on for a tile of rows by rough scores: (rows learnt, classes); 0 where there are no rough scores."""
    rows = ROUGH_ROWS if cats.outline is None else cats.outline.rows
    x = x[at : at + max(4, min(rows, ROUGH_NUMBERS // cats.size))]
    found = Shortlist(kernel, cats, x, classes is not None and method != "MT1")
    if not found.known:
        return 0, classes
    # Categories that are new or have changed since: their scores for all later rows, a line each.
    line, numbers, changed = {}, [], np.zeros(cats.size + len(x), bool)
    more_t, more_m = np.empty((len(x), len(x))), np.empty((len(x), len(x)))
    for r in range(len(x)):
        j, t, m = found.row(r, changed if numbers else None)
        if numbers:
            k = len(numbers)
            j = np.concatenate([j, np.array(numbers, np.int64)])
            order = np.argsort(j)
            j, t, m = j[order], np.concatenate([t, more_t[:k, r]])[order], np.concatenate([m, more_m[:k, r]])[order]
        n = kernel.norm(cats.w)
        own = None if classes is None else classes[0][j] == classes[1][at + r]
        k = choose(kernel, t if n is None else t / n, m, own, method, epsilon) if len(j) else -1
        new = k < 0
        if new:
            j = cats.add(kernel.new(x[r]))
            if founded is not None:
                classes = (founded(j, at + r), classes[1])
        else:
            j = int(j[k])
            one = cats.w[j : j + 1].copy()
            w = kernel.update(one[0], x[r], kernel.activate(one, x[r], cats.n[j : j + 1])[1], 0)
            if (w == one[0]).all():
                cats.n[j] += 1
                if cats.touched is not None:
                    cats.touched.append(j)
                out[at + r] = j
                continue
            cats.set(j, w)
        out[at + r] = j
        if j not in line:
            line[j] = len(numbers)
            numbers.append(j)
            changed[j] = True
        if r + 1 < len(x):
            t, m = kernel.score_rows(cats.w[j : j + 1], x[r + 1 :])
            more_t[line[j], r + 1 :], more_m[line[j], r + 1 :] = t[:, 0], m[:, 0]
    # Short tiles where changes often let categories in again.
    cats.outline.rows = max(8, rows // 2) if 4 * found.again > len(x) else min(ROUGH_ROWS, 2 * rows) if 10 * found.again < len(x) else rows
    return len(x), classes


#: Steps of [0, 1] in a cover, and the categories of a block of it, whose flags for a step are one line of a core's cache.
LEVELS, COVER_BLOCK = 64, 512
#: Categories from which on a cover is tried, and the share of them that may be left for it to pay.
COVERED, COVER_SHARE = 256, 1 / 8


class Cover:
    """For each number of a row and each step of [0, 1], flags of the categories that can pass the vigilance with the number in that step.

    kernel.spans() tells the range that a category leaves to each number. The flags of a
    row's steps, joined by and, are those of all categories that pass, and of few others.
    """

    def __init__(self, kernel, cats: Categories):
        self.kernel, self.cats, self.late = kernel, cats, list(range(cats.size))
        self.flags = np.zeros((0, 0, LEVELS, COVER_BLOCK // 8), np.uint8)

    @staticmethod
    def steps(v: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(v * LEVELS), 0, LEVELS - 1).astype(np.int64)

    def _update(self) -> None:
        late = sorted(set(self.late))
        self.late.clear()
        low, high = map(self.steps, self.kernel.spans(self.cats.w[late]))
        blocks, step = -(-self.cats.size // COVER_BLOCK), np.arange(LEVELS)
        if blocks > len(self.flags):
            grown = np.zeros((2 * blocks, low.shape[1], *self.flags.shape[2:]), np.uint8)
            if len(self.flags):
                grown[: len(self.flags)] = self.flags
            self.flags = grown
        for j, a, z in zip(late, low, high, strict=True):
            column, bit = self.flags[j // COVER_BLOCK, :, :, j % COVER_BLOCK // 8], np.uint8(128 >> j % 8)
            column &= ~bit
            column |= ((step >= a[:, None]) & (step <= z[:, None])) * bit

    def among(self, steps: np.ndarray) -> np.ndarray:
        """Categories that a row with these steps may pass."""
        if self.late:
            self._update()
        blocks = -(-self.cats.size // COVER_BLOCK)
        words = self.flags.view(np.uint64)[:blocks, np.arange(len(steps)), steps]
        return np.flatnonzero(np.unpackbits(np.bitwise_and.reduce(words, 1).reshape(-1).view(np.uint8)))


def covered(kernel, cats: Categories, x: np.ndarray, method: str, epsilon: float) -> bool:
    """Whether a cover is worth a try: a kernel that has one for these rows, many categories, and a search that lets no category in again that has failed."""
    return cats.size >= max(COVERED, cats.bare + 1) and method in ("MT+", "MT0", "MT1") and epsilon >= 0 and kernel.covers(x)


def learn_covered(kernel, cats: Categories, x: np.ndarray, method: str, epsilon: float, classes: tuple[np.ndarray, np.ndarray] | None, at: int, founded: Callable[[int, int], np.ndarray] | None, out: np.ndarray) -> tuple[int, tuple | None]:
    """learn_rows() from row at on for some rows by a cover: (rows learnt, classes); 0 where it does not pay."""
    x = x[at : at + TILE_ROWS]
    half = x[:, : x.shape[1] // 2]
    if cats.cover is None or cats.cover.kernel != kernel:
        # A look at some rows and categories first.
        low, high = kernel.spans(cats.w[:: -(-cats.size // COVERED)])
        if ((half[:8, None] >= low) & (half[:8, None] <= high)).all(2).mean() > COVER_SHARE:
            cats.cover, cats.bare = None, 2 * cats.size
            return 0, classes
        cats.cover = Cover(kernel, cats)
    steps, left = Cover.steps(half), 0
    for r in range(len(x)):
        among = cats.cover.among(steps[r])
        left += len(among)
        j = -1
        if len(among):
            t, m = kernel.score_pairs(cats.w[among], x[r : r + 1])
            k = choose(kernel, t, m, None if classes is None else classes[0][among] == classes[1][at + r], method, epsilon)
            j = int(among[k]) if k >= 0 else -1
        out[at + r], classes = _settle(kernel, cats, x[r], j, classes, at + r, founded)[:2]
        if r == 15 and left > COVER_SHARE * 16 * cats.size:
            cats.cover, cats.bare = None, 2 * cats.size
            return r + 1, classes
    return len(x), classes


def _settle(kernel, cats: Categories, x: np.ndarray, j: int, classes: tuple | None, row: int, founded: Callable[[int, int], np.ndarray] | None) -> tuple[int, tuple | None, bool]:
    """Let category j (or a new one, at -1) learn a row: (its number, classes, whether its weight has changed)."""
    if j < 0:
        j = cats.add(kernel.new(x))
        return j, classes if founded is None else (founded(j, row), classes[1]), True
    one = cats.w[j : j + 1].copy()
    w = kernel.update(one[0], x, kernel.activate(one, x, cats.n[j : j + 1])[1], 0)
    if (w != one[0]).any():
        cats.set(j, w)
        return j, classes, True
    cats.n[j] += 1
    if cats.touched is not None:
        cats.touched.append(j)
    return j, classes, False


def _slack(method: str, epsilon: float, size: int) -> float:
    """How far below the best match so far the vigilance of a search can be, and more; MT- lowers it by epsilon at each refusal."""
    return 1e-9 + (2 * epsilon if method != "MT-" else epsilon * (size + 2))


def _walk(kernel, ids: np.ndarray, match: np.ndarray, own, method: str, epsilon: float, slack: float, strict: bool, rho: float, best: float = -np.inf) -> tuple[int, float, float, bool]:
    """The search over categories in order: (the one that is taken or -1, vigilance, best match, whether to go on). best: the best match before."""
    # Only those that match about as well as all before can be taken, or move the vigilance.
    high = np.maximum.accumulate(np.concatenate([[best], match]))
    look = np.flatnonzero(match >= np.maximum(high[:-1], rho) - slack)
    for j, m in zip(ids[look].tolist(), match[look].tolist(), strict=True):
        if m < rho or (strict and m == rho):
            continue
        if own is None or (own[j] if isinstance(own, np.ndarray) else own(j)):
            return j, rho, best, False
        rho, go_on = kernel.track(m, rho, epsilon, method)
        if not go_on:
            return -1, rho, best, False
    return -1, rho, float(high[-1]), True


#: Categories that a climb scores in full at first, and a number below all activations.
CLIMBED, LEAST = 16, -1e30


def climb(kernel, x: np.ndarray, weights: np.ndarray, t: np.ndarray, m: np.ndarray, t_off: float, m_off: float, own: np.ndarray | Callable[[int], bool] | None, method: str, epsilon: float, ids: np.ndarray | None = None) -> int:
    """choose() among all categories by a row's rough scores; full ones only of those that the search looks at, and of those about as active.

    For kernels whose rough matches are on the scale of the vigilance. ids: the categories
    that the scores are of, if not all in order.
    """
    strict, rho = check_method(method), kernel.rho
    slack = _slack(method, epsilon, len(t))
    cut = top = np.inf  # those from the cut on are scored in full; none of the rest is more active than top, by rough scores
    near, near_t, near_m, best, many = np.empty(0, np.int64), np.empty(0), np.empty(0), -np.inf, CLIMBED
    while True:
        past = int(np.searchsorted(-near_t, -(top + t_off), "left"))
        if past:
            j, rho, best, go_on = _walk(kernel, near[:past], near_m[:past], own, method, epsilon, slack, strict, rho, best)
            if j >= 0 or not go_on:
                return j
        if top == -np.inf:
            return -1
        rest = np.where((t < cut) & (m >= rho - m_off), t, -np.inf)
        top = float(rest.max())
        near, near_t, near_m = near[past:], near_t[past:], near_m[past:]
        if top > -np.inf:
            # About as many as are wanted, told by some, and no fewer than those about as active as the first.
            some = rest[:: 1 + len(rest) // 512]
            k = min(len(some), 1 + many * len(some) // len(rest))
            cut = top = min(top - 2 * t_off, max(float(np.partition(some, len(some) - k)[len(some) - k]), LEAST))
            many *= 4
            more = np.flatnonzero(rest >= cut) if ids is None else ids[np.flatnonzero(rest >= cut)]
            more_t, more_m = kernel.score_pairs(weights[more], x[None])
            near, near_t, near_m = (np.concatenate([v, w]) for v, w in ((near, more), (near_t, more_t), (near_m, more_m)))
            order = np.lexsort((near, -near_t))  # the older first on ties
            near, near_t, near_m = near[order], near_t[order], near_m[order]


def learn_climbing(kernel, cats: Categories, x: np.ndarray, method: str, epsilon: float, classes: tuple[np.ndarray, np.ndarray] | None, at: int, founded: Callable[[int, int], np.ndarray] | None, out: np.ndarray) -> tuple[int, tuple | None]:
    """learn_rows() from row at on for a tile of rows by climb(): (rows learnt, classes); 0 where there are no rough scores."""
    if cats.outline is None or cats.outline.kernel != kernel:
        cats.outline = Outline(kernel, cats)
    x, size = x[at : at + max(16, min(ROUGH_ROWS, ROUGH_NUMBERS // cats.size))], cats.size
    got = kernel.rough(cats.outline.read(), x, False)
    if got is None:
        return 0, classes
    t, m, t_off, m_off, _ = got
    t, m = (np.concatenate([v, np.full((len(x), len(x)), -np.inf, v.dtype)], 1) for v in (t, m))
    for r in range(len(x)):
        own = None if classes is None else classes[0][: cats.size] == classes[1][at + r]
        j = climb(kernel, x[r], cats.w, t[r, : cats.size], m[r, : cats.size], t_off, m_off, own, method, epsilon)
        out[at + r], classes, changed = _settle(kernel, cats, x[r], j, classes, at + r, founded)
        if changed and r + 1 < len(x):
            j = int(out[at + r])
            own_t, own_m = kernel.score_rows(cats.w[j : j + 1], x[r + 1 :])
            t[r + 1 :, j], m[r + 1 :, j] = own_t[:, 0], own_m[:, 0]
    return len(x), classes


#: Categories from which on points are searched apart from boxes, and the share of them that must be points.
POINTED, POINT_SHARE = 2048, 1 / 2
#: The most active boxes that are scored in full at first, and of those left after that, to tell what cannot be reached.
LEADERS = (32, 64)


def pointed(kernel, cats: Categories, x: np.ndarray, method: str = "MT1", epsilon: float = 0.0) -> bool:
    """Whether points and boxes are told apart: a kernel and rows where that can be, many categories, and a search whose vigilance never falls by more than epsilon at a refusal."""
    return cats.size >= max(POINTED, cats.grown + 1) and method != "MT~" and epsilon >= 0 and kernel.pointed(x)


def _points(kernel, cats: Categories) -> Points | None:
    """Points and boxes of a module as they are now; none where too few are points."""
    if cats.points is None or cats.points.kernel != kernel:
        cats.points = Points(kernel, cats)
    cats.points.read()
    if cats.points.size - len(cats.points.gone) < POINT_SHARE * cats.size:
        cats.points, cats.grown = None, 2 * cats.size
    return cats.points


class Pointed:
    """Search for a block of rows among boxes by rough scores, and among points by distances.

    Of the points, a search reaches none that is surely farther away than the nearest one,
    and none at all where no point is as near as the box that would be taken is active. Of
    the boxes it reaches none that surely follows another one which surely matches better.
    """

    def __init__(self, kernel, points: Points, x: np.ndarray, method: str, epsilon: float):
        self.kernel, self.points, self.x, self.method, self.epsilon = kernel, points, x, method, epsilon
        cats, b, n = points.cats, points.many, len(x)
        self.cats, self.d, self.known, self.strict = cats, x.shape[1] / 2, True, check_method(method)
        # A lowered vigilance may let in matches that are worse by this.
        self.slack = _slack(method, epsilon, cats.size + n)
        got = kernel.rough(points.read(), x, False) if b else (np.empty((n, 0), np.float32), np.empty((n, 0), np.float32), 0.0, 0.0)
        self.known = got is not None
        if not self.known:
            return
        self.t, self.m, self.t_off, self.m_off = got[:4]
        self.places = kernel.places(x).T.copy()
        self.scale, self.off = kernel.place_unit(x.shape[1])
        self.margin = int(min(2 * self.off + self.slack * self.d * self.scale + 1, FAR))
        self.moved = np.zeros(b, bool)
        # Categories that are new or have changed since: their scores for all later rows, a line each.
        self.line, self.late, self.late_t, self.late_m = {}, [], np.empty((n, n)), np.empty((n, n))
        self._reach()

    def _reach(self) -> None:
        """Of each row, the boxes that can be reached with their full scores, and the leaders that keep others from it."""
        n, b = self.t.shape
        left, found, self.leaders = self.m >= self.kernel.rho - self.m_off - self.slack, [], []
        line = np.arange(n)
        for k in LEADERS:
            if np.count_nonzero(left) <= 2 * k * n or b <= k:
                break
            held = np.where(left, self.t, -np.inf)
            at = np.argpartition(held, b - k, axis=1)[:, b - k :]
            own = np.take_along_axis(held, at, 1)
            rows, place = np.nonzero(own > -np.inf)
            j = at[rows, place]
            t, m = self._scores(rows, j)
            found.append((rows, j, t, m))
            left[rows, j] = False
            # No other one is as active as those of this line and above.
            sure = np.full((n, k), -np.inf)
            ahead = t >= own.min(1)[rows] + self.t_off
            sure[rows[ahead], place[ahead]] = m[ahead]
            first = sure.argmax(1)
            best = sure[line, first]
            self.leaders.append(np.where(best > -np.inf, at[line, first], -1))
            left &= self.m >= (best - self.m_off - self.slack)[:, None]
        rows, j = np.nonzero(left)
        found.append((rows, j, *self._scores(rows, j)))
        rows, j, t, m = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(rows, kind="stable")
        self.ends, self.at, self.own_t, self.own_m = np.searchsorted(rows[order], np.arange(n + 1)), j[order], t[order], m[order]

    def _scores(self, rows: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.points.boxes[boxes]
        parts = [self.kernel.score_pairs(self.cats.w[ids[a : a + 2048]], self.x[rows[a : a + 2048]]) for a in range(0, max(1, len(ids)), 2048)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _taken(self, r: int, near: np.ndarray, own) -> tuple[int, float]:
        """(category that takes row r among its boxes as they are now and some points, or -1; its activation)."""
        kernel, a, b, k = self.kernel, self.ends[r], self.ends[r + 1], len(self.late)
        near_t, near_m = kernel.score_pairs(self.cats.w[near], self.x[r : r + 1]) if len(near) else (np.empty(0), np.empty(0))
        more = np.concatenate([np.array(self.late, np.int64), near])
        more_t, more_m = np.concatenate([self.late_t[:k, r], near_t]), np.concatenate([self.late_m[:k, r], near_m])
        if any(v[r] >= 0 and self.moved[v[r]] for v in self.leaders):
            # Without its leader a row may reach others.
            t, m = np.where(self.moved, -np.inf, self.t[r]), self.m[r]
            t, m, ids = np.concatenate([t, more_t]), np.concatenate([m, more_m]), np.concatenate([self.points.boxes[: len(t)], more])
            j = climb(kernel, self.x[r], self.cats.w, t, m, self.t_off, self.m_off + self.slack, own, self.method, self.epsilon, ids)
            return j, float(kernel.score_pairs(self.cats.w[j : j + 1], self.x[r : r + 1])[0][0]) if j >= 0 else 0.0
        stay = ~self.moved[self.at[a:b]]
        ids = np.concatenate([self.points.boxes[self.at[a:b][stay]], more])
        t, m = np.concatenate([self.own_t[a:b][stay], more_t]), np.concatenate([self.own_m[a:b][stay], more_m])
        order = np.lexsort((ids, -t))  # the older first on ties
        j = _walk(kernel, ids[order], m[order], own, self.method, self.epsilon, self.slack, self.strict, kernel.rho)[0]
        return j, float(t[ids == j][0]) if j >= 0 else 0.0

    def find(self, r: int, own: Callable[[int], bool] | None) -> int:
        """The category that takes row r, or -1."""
        j, active = self._taken(r, np.empty(0, np.int64), own)
        if j >= 0:
            # Points as active as the box are so near.
            most = (self.d - active * (self.kernel.alpha + self.d) + 1e-6) * self.scale + self.off
            if most < 0 or not self.points.within(self.places[r], int(min(most, FAR))):
                return j
        near = self.points.nearest(self.places[r], self.margin)
        return self._taken(r, near, own)[0] if len(near) else j

    def changed(self, j: int, r: int) -> None:
        """Category j is new or has changed: its scores for the rows after a row."""
        k = self.line.get(j)
        if k is None:
            box = self.points.column(j)
            if box >= 0:
                self.moved[box] = True
            else:
                self.points.drop(j)
            k = self.line[j] = len(self.late)
            self.late.append(j)
        if r + 1 < len(self.x):
            t, m = self.kernel.score_rows(self.cats.w[j : j + 1], self.x[r + 1 :])
            self.late_t[k, r + 1 :], self.late_m[k, r + 1 :] = t[:, 0], m[:, 0]


def learn_pointed(kernel, cats: Categories, x: np.ndarray, method: str, epsilon: float, classes: tuple[np.ndarray, np.ndarray] | None, at: int, founded: Callable[[int, int], np.ndarray] | None, out: np.ndarray) -> tuple[int, tuple | None]:
    """learn_rows() from row at on for a tile of rows, points apart from boxes: (rows learnt, classes); 0 where that does not pay."""
    points = _points(kernel, cats)
    if points is None:
        return 0, classes
    x = x[at : at + max(16, min(ROUGH_ROWS, ROUGH_NUMBERS // max(1, points.many)))]
    found = Pointed(kernel, points, x, method, epsilon)
    if not found.known:
        return 0, classes
    for r in range(len(x)):
        own = None if classes is None else lambda j, r=r: classes[0][j] == classes[1][at + r]
        out[at + r], classes, changed = _settle(kernel, cats, x[r], found.find(r, own), classes, at + r, founded)
        if changed:
            found.changed(int(out[at + r]), r)
    return len(x), classes


def learn_rows(kernel, cats: Categories, x: np.ndarray, method: str = "MT+", epsilon: float = 0.0, classes: tuple[np.ndarray, np.ndarray] | None = None, founded: Callable[[int, int], np.ndarray] | None = None) -> np.ndarray:
    """learn() for a matrix of rows in order, by tiles; the categories' numbers.

    Rows up to the first that changes a category are learnt at once. classes: the class of
    each category (room for all) and of each row, a row being refused by categories of
    other classes; founded(j, row) then gives the classes with those of a new category.
    """
    strict, out, at, busy = check_method(method), np.empty(len(x), np.int64), 0, True
    while at < len(x):
        if covered(kernel, cats, x[at : at + TILE_ROWS], method, epsilon):
            n, classes = learn_covered(kernel, cats, x, method, epsilon, classes, at, founded, out)
            at += n
            if n:
                continue
        if pointed(kernel, cats, x[at : at + ROUGH_ROWS], method, epsilon):
            n, classes = learn_pointed(kernel, cats, x, method, epsilon, classes, at, founded, out)
            at += n
            if n:
                continue
        stairs = classes is not None and method != "MT1"
        if outlined(kernel, cats, stairs, method, epsilon):
            n, classes = (learn_climbing if stairs and kernel.direct else learn_outlined)(kernel, cats, x, method, epsilon, classes, at, founded, out)
            at += n
            if n:
                continue
            busy = True
        if busy:  # while most rows change something, a tile saves nothing
            n, changes = min(ROW_RUN, len(x) - at), 0
            for r in range(at, at + n):
                size, own = cats.size, None if classes is None else classes[0][: cats.size] == classes[1][r]
                j, cache = resonant(kernel, cats, x[r], own, method, epsilon)
                if j < 0:
                    j = cats.add(kernel.new(x[r]))
                    if founded is not None:
                        classes = (founded(j, r), classes[1])
                else:
                    w = kernel.update(cats.w[j], x[r], cache, j)
                    changes += int((w != cats.w[j]).any())
                    cats.set(j, w)
                changes += cats.size - size
                out[r] = j
            at += n
            busy = 4 * changes > n
            continue
        tile = Tile(kernel, cats, x[at : at + Tile.rows(kernel, cats, x.shape[1])])
        n, r, ahead, changed = len(tile.x), 0, 8, 0
        while r < n:
            end = min(n, r + ahead)
            fine = 0
            if cats.size:
                j, _ = tile.winners(r, end, strict)
                good = j >= 0
                if classes is not None:
                    good = good & (classes[0][j] == classes[1][at + r : at + end])
                k = np.flatnonzero(good)
                good[k] = still(kernel, cats.w[j[k]], tile.x[r:end][k]) if len(k) else False
                fine = int(np.argmin(good)) if not good.all() else len(good)
                out[at + r : at + r + fine] = j[:fine]
                np.add.at(cats.n, j[:fine], 1)
            if r + fine == end:
                r, ahead = end, min(TILE_ROWS, 2 * ahead)
                continue
            r += fine
            if classes is None:
                j = int(j[fine]) if cats.size else -1
            elif cats.size:
                t, m = tile.scores(r, r + 1)
                j = choose(kernel, t[0], m[0], classes[0][: cats.size] == classes[1][at + r], method, epsilon)
            else:
                j = -1
            found = j < 0
            out[at + r] = j = tile.learn(r, j)
            if found and founded is not None:
                classes = (founded(j, at + r), classes[1])
            ahead = max(1, min(ahead, 2 * (fine + 1)))
            changed += 1
            r += 1
        at += n
        busy = 4 * changed > n
    return out


def nearest_rows(kernel, cats: Categories, x: np.ndarray, vigilant: bool = False) -> np.ndarray:
    """nearest() for a matrix of rows, by tiles of rows and blocks of categories whose maxima are combined."""
    if not cats.size:
        return np.full(len(x), -1, np.int64)
    out, n = np.zeros(len(x), np.int64), kernel.norm(cats.w)
    if cats.size >= kernel.alone and pointed(kernel, cats, x) and (points := _points(kernel, cats)) is not None:
        any_ = kernel if vigilant else kernel.with_params(rho=0.0)
        rows = max(16, min(ROUGH_ROWS, ROUGH_NUMBERS // max(1, points.many)))
        for a in range(0, len(x), rows):
            found = Pointed(any_, points, x[a : a + rows], "MT+", 0.0)
            if not found.known:
                break
            for r in range(len(found.x)):
                out[a + r] = max(0, found.find(r, None))
        else:
            return out
    rows = max(1, min(len(x), TILE_NUMBERS // (x.shape[1] * min(cats.size, 1024))))
    if outlined(kernel, cats):
        rows = max(4, min(ROUGH_ROWS, ROUGH_NUMBERS // cats.size))
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        found = Shortlist(kernel, cats, part, False, not vigilant) if outlined(kernel, cats) else None
        if found is not None and found.known:
            t, good = found.own_t if n is None else found.own_t / n, ~np.isnan(found.own_t)
            if vigilant:
                good &= found.own_m >= kernel.rho
            for r in range(len(part)):
                b, c = found.ends[r], found.ends[r + 1]
                k = most_active(t[b:c], good[b:c])
                out[a + r] = found.at[b + k] if k >= 0 else 0
            continue
        best, top = np.full(len(part), -np.inf), np.zeros(len(part), np.int64)
        for c in range(0, cats.size, 1024):
            t, m = kernel.score_rows(cats.w[c : c + 1024], part)
            t = t if n is None else t / n
            held = np.where(~np.isnan(t) & (m >= kernel.rho), t, -np.inf) if vigilant else np.where(np.isnan(t), -np.inf, t)
            j = held.argmax(1)
            value = held[np.arange(len(j)), j]
            better = value > best
            best[better], top[better] = value[better], j[better] + c
        out[a : a + rows] = top
    return out
