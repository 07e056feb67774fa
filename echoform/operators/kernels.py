"""Elementary resonance models as NumPy kernels that work on all categories at once.

A kernel gives the activation of every category for a row, the match of one category,
the updated and the new weight, and descriptions of a weight. Weights are rows of a
matrix; `n` holds how many rows each category has learnt. The formulas are those of the
published models; where a ratio is 0/0 the kernel states what it takes instead.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace
from typing import ClassVar

import numpy as np

Cache = dict
#: Weights that meet a row at once, and numbers of points that do.
BLOCK, COLUMNS = 512, 64_000
#: Rows whose least numbers tell what any of them can lack of a weight.
STRIP = 16


@dataclass(frozen=True)
class Kernel:
    """Base of all kernels. rho is the vigilance; a category resonates if its match is rho or more."""

    rho: float = 0.5
    inverted: ClassVar[bool] = False
    complement: ClassVar[bool] = False

    def _need(self, good: bool, what: str) -> None:
        if not good:
            raise ValueError(f"{type(self).__name__}: {what}")

    def with_params(self, **changes) -> Kernel:
        return replace(self, **changes)

    def prepare(self, x: np.ndarray) -> np.ndarray:
        """Model input from rows scaled to [0, 1]."""
        return np.concatenate([x, 1 - x], axis=-1) if self.complement else x

    def validate(self, x: np.ndarray) -> None:
        self._need(bool(np.isfinite(x).all()) and bool((x >= 0).all() and (x <= 1).all()), "rows must lie in [0, 1]")

    def resonates(self, match: float, rho: float, strict: bool) -> bool:
        return match > rho if strict else match >= rho

    def matches(self, w: np.ndarray, x: np.ndarray, cache: Cache) -> np.ndarray:
        """Matches of all categories."""
        return np.array([self.match(w, x, cache, j) for j in range(len(w))])

    #: Whether score_rows() is there: a row's scores against a category depend on no other category, but for a divisor norm().
    tiled: ClassVar[bool] = False

    def score_rows(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(activations before norm(), matches) of every row of a matrix against every category."""
        raise NotImplementedError

    def norm(self, w: np.ndarray) -> float | None:
        """What all activations are divided by."""
        return None

    #: Categories from which on a search looks at rough scores first: one that ends at the first category that passes, and any; 0 where the kernel has none.
    many: ClassVar[tuple[int, int]] = (0, 0)

    #: Whether rough matches are on the scale of the vigilance, and activations are divided by no norm().
    direct: ClassVar[bool] = False

    def covers(self, x: np.ndarray) -> bool:
        """Whether spans() is there for such rows."""
        return False

    def spans(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) number in each place of the first half of a row that can pass the vigilance of each weight, or a wider range."""
        raise NotImplementedError

    #: Categories from which on predictions search points apart from boxes.
    alone: ClassVar[int] = 0

    def pointed(self, x: np.ndarray) -> bool:
        """Whether such rows are points, and single(), places(), place_sums() and place_gaps() are there (points.py)."""
        return False

    def sketch(self, w: np.ndarray) -> dict[str, np.ndarray]:
        """What rough() needs to know of weights: arrays whose last axis is the weights."""
        raise NotImplementedError

    def rough(self, sketch: dict[str, np.ndarray], x: np.ndarray, blind: bool) -> tuple[np.ndarray, np.ndarray, float, float, float] | None:
        """(activations before norm(), matches, the most that either is off, the vigilance) of every row and weight, each on a scale of its own that rises with it; none if not known for these numbers. blind: the vigilance does not count (-inf)."""
        raise NotImplementedError

    def score_pairs(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score_rows() of each row and the weight in the same line."""
        raise NotImplementedError

    def reach(self, w: np.ndarray) -> np.ndarray | None:
        """The largest match that any row can have with each weight, for kernels where it never rises again and may be too small; else none."""
        return None

    def update_rows(self, w: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        """Updated weights, line by line, for kernels whose rows often change nothing; else none."""
        return None

    def track(self, match: float, rho: float, epsilon: float, method: str) -> tuple[float, bool]:
        """(vigilance, whether to go on) after a category that resonates was refused."""
        new = {"MT+": match + epsilon, "MT-": match - epsilon, "MT0": match, "MT1": math.inf, "MT~": rho}[method]
        return new, method != "MT1" and new <= 1

    def centre(self, w: np.ndarray) -> np.ndarray:
        return w

    def geometry(self, w: np.ndarray) -> dict:
        return {"centre": self.centre(w)}


@dataclass(frozen=True)
class Fuzzy(Kernel):
    """Boxes in complement code: weight [lower corner, 1 - upper corner]."""

    alpha: float = 1e-10
    beta: float = 1.0
    complement: ClassVar[bool] = True
    tiled: ClassVar[bool] = True

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and self.alpha >= 0 and 0 < self.beta <= 1, "rho in [0, 1], alpha >= 0, beta in (0, 1]")

    def validate(self, x: np.ndarray) -> None:
        super().validate(x)
        self._need(x.shape[-1] % 2 == 0 and bool((np.abs(x.sum(-1) - x.shape[-1] / 2) <= 0.01).all()), "rows must be complement coded")

    def activate(self, w, x, n):
        both = self._overlaps(w, x)
        below = self.alpha + w.sum(1)
        return both / below if below.all() else np.divide(both, below, out=np.zeros(len(w)), where=below != 0), {"both": both, "d": len(x) / 2}

    def match(self, w, x, cache, j):
        return cache["both"][j] / cache["d"]

    def matches(self, w, x, cache):
        return cache["both"] / cache["d"]

    def update(self, w, x, cache, j, beta=None):
        beta = self.beta if beta is None else beta
        return beta * np.minimum(x, w) + (1 - beta) * w

    def score_rows(self, w, x):
        both = np.minimum(w[None], x[:, None]).sum(2)
        below = np.broadcast_to(self.alpha + w.sum(1), both.shape)
        return np.divide(both, below, out=np.zeros(both.shape), where=below != 0), both / (x.shape[1] / 2)

    many: ClassVar[tuple[int, int]] = (768, 1500)
    direct: ClassVar[bool] = True

    def covers(self, x):
        d = x.shape[1] // 2
        return self.rho > 0 and d >= 16 and bool((np.abs(x[:, :d] + x[:, d:] - 1) <= 1e-9).all())

    def pointed(self, x):
        return bool(self.single(x).all())

    def single(self, w: np.ndarray) -> np.ndarray:
        """Which weights are points: complement code without a width."""
        d = w.shape[1] // 2
        return (np.abs(w[:, :d] + w[:, d:] - 1) <= 1e-9).all(1) & ((w >= 0) & (w <= 1)).all(1)

    def places(self, w: np.ndarray) -> np.ndarray:
        """Points by columns: steps of their first halves."""
        d = w.shape[1] // 2
        return np.ascontiguousarray(np.floor(w[:, :d] * self._scale(2 * d)).astype(np.uint16).T)

    def place_sums(self, places: np.ndarray) -> np.ndarray:
        """A number of each point that is no farther from another one's than they are apart."""
        return places.sum(0, dtype=np.int64)

    def place_gaps(self, places: np.ndarray, own: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Distances in steps of points to a row, in the places given. below: the points' sums there. Sums wrap at 16 bits, the differences do not."""
        n, block, out = places.shape[1], max(1, COLUMNS // len(own)), np.empty(places.shape[1], np.uint16)
        all_, wide = np.uint16(int(own.sum(dtype=np.int64)) % 65_536), own[:, None]
        if n > 4 * block:
            wide = np.repeat(wide, block, 1)
        least = np.empty((len(own), min(n, block)), np.uint16)
        for a in range(0, n, block):
            part = places[:, a : a + block]
            m = part.shape[1]
            np.minimum(part, wide[:, :m] if wide.shape[1] > 1 else wide, out=least[:, :m])
            both = np.add.reduce(least[:, :m], 0, dtype=np.uint16)
            out[a : a + m] = (np.add.reduce(part, 0, dtype=np.uint16) if below is None else below[a : a + m]) + all_ - both - both
        return out

    def place_unit(self, width: int) -> tuple[float, int]:
        """(steps of a distance of 1, the most steps that a distance is off)."""
        return self._scale(width), width // 2 + 1

    def spans(self, w):
        # A match is |w| less what the row lacks of w, which in no place is more than |w| may lose.
        d = w.shape[1] // 2
        spare = np.maximum(w.sum(1) - self.rho * d, 0)[:, None] + 1e-8
        return w[:, :d] - spare, 1 - w[:, d:] + spare

    @staticmethod
    def _overlaps(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """np.minimum(w, x).sum(1), by blocks that stay in a core's cache."""
        if len(w) <= BLOCK or not w.flags.c_contiguous:
            return np.minimum(w, x).sum(1)
        out, least = np.empty(len(w)), np.empty((BLOCK, w.shape[1]))
        for a in range(0, len(w), BLOCK):
            part = least[: len(w) - a]
            np.minimum(w[a : a + BLOCK], x, out=part)
            np.add.reduce(part, 1, out=out[a : a + BLOCK])
        return out

    @staticmethod
    def _scale(width: int) -> float:
        """Steps of a sketch in one: the steps of an overlap, width / 2 at most, are 16-bit numbers."""
        return 65_000 / (width / 2 + 1)

    def _share(self, w: np.ndarray) -> np.ndarray:
        """One over what an overlap is divided by; NaN where rough scores would not hold."""
        below = self.alpha + w.sum(1)
        return np.divide(1, below, out=np.full(len(w), np.nan), where=(below > 0) & ((w >= 0) & (w <= 1)).all(1)).astype(np.float32)

    def _fine(self, width: int) -> float:
        """Steps of a sketch in one, finer than _scale(): sums of these wrap at 16 bits."""
        return min(4 * self._scale(width), 65_000.0)

    def sketch(self, w):
        steps = np.floor(w * self._fine(w.shape[1])).astype(np.uint16).T
        return {"steps": steps, "sums": steps.sum(0, dtype=np.int64), "share": self._share(w)}

    def rough(self, sketch, x, blind):
        width, fine, steps, sums, share = x.shape[1], self._fine(x.shape[1]), sketch["steps"], sketch["sums"], sketch["share"]
        if not (x.min() >= 0 and x.max() <= 1 and x.sum(1).max() <= width / 2 + 0.5 and np.isfinite(share).all()):
            return None
        own = np.floor(x * fine).astype(np.uint16)
        # What rows lack of a weight is less than 2^16 steps, so it is known from sums that wrap; else sums are of coarser steps, and do not.
        wraps = all(int(np.maximum(steps[:, a : a + 2000], low).sum(0, dtype=np.uint32).max()) - int(low.sum(dtype=np.int64)) < 65_536 for low in (own[r : r + STRIP].min(0)[:, None] for r in range(0, len(x), STRIP)) for a in range(0, len(share), 2000))
        cut = 0 if wraps else math.ceil(math.log2(fine / self._scale(width)))
        own = np.ascontiguousarray((own >> cut).T)[:, :, None]
        both = np.empty((len(x), len(share)), np.float32)
        for a in range(0, len(share), 2000):  # blocks that stay in a core's cache
            block = steps[:, a : a + 2000] >> np.uint16(cut) if cut else steps[:, a : a + 2000]
            total = np.minimum(block[0], own[0])
            least = np.empty_like(total)
            for k in range(1, width):
                np.minimum(block[k], own[k], out=least)
                np.add(total, least, out=total)
            if wraps:
                all_ = sums[a : a + 2000]
                np.subtract((all_ % 65_536).astype(np.uint16), total, out=total)
                np.subtract(all_.astype(np.float32), total, out=both[:, a : a + 2000])
            else:
                both[:, a : a + 2000] = total
        # Each of the terms was cut by less than a step.
        scale = fine / 2**cut
        both += width / 2
        both /= scale
        off = width / 2 / scale + 1e-4
        return both * share, both / np.float32(width / 2), float(off * share.max() + 1e-5), float(off / (width / 2) + 1e-5), -math.inf if blind else self.rho

    def score_pairs(self, w, x):
        both, below = np.minimum(w, x).sum(1), self.alpha + w.sum(1)
        return np.divide(both, below, out=np.zeros(len(w)), where=below != 0), both / (x.shape[1] / 2)

    def update_rows(self, w, x):
        return self.beta * np.minimum(x, w) + (1 - self.beta) * w

    def new(self, x):
        return x.copy()

    def centre(self, w):
        d = len(w) // 2
        return (w[:d] + 1 - w[d:]) / 2

    def box(self, w: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(lower corner, widths) of a category's box, in its first n dimensions."""
        d = len(w) // 2
        n = d if n is None else n
        return w[:n], 1 - w[d : d + n] - w[:n]

    def shrink(self, w: np.ndarray, ratio: float) -> np.ndarray:
        """The box drawn in by ratio of its width on each side."""
        low, width = self.box(w)
        return w + ratio * np.concatenate([width, width])

    def geometry(self, w):
        low, width = self.box(w)
        return {"centre": self.centre(w), "low": low, "width": width}


@dataclass(frozen=True)
class BinaryFuzzy(Fuzzy):
    """Fuzzy on 0/1 rows; learning is an intersection, beta is 1.

    Blocks of rows are scored on bits packed into 64-bit words: the overlap of a row and a
    category is the number of bits of an AND, and vigilance and choice follow from counts.
    """

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and self.alpha >= 0 and self.beta == 1, "rho in [0, 1], alpha >= 0, beta 1")

    @staticmethod
    def packed(v: np.ndarray) -> np.ndarray:
        """Lines of 0/1 numbers as lines of 64-bit words."""
        bits = np.packbits(v != 0, axis=1)
        return (np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))) if bits.shape[1] % 8 else bits).view(np.uint64)

    def score_rows(self, w, x):
        both = np.bitwise_count(self.packed(w)[None] & self.packed(x)[:, None]).sum(2, dtype=np.int64).astype(float)
        below = np.broadcast_to(self.alpha + w.sum(1), both.shape)
        return np.divide(both, below, out=np.zeros(both.shape), where=below != 0), both / (x.shape[1] / 2)

    many: ClassVar[tuple[int, int]] = (768, 768)
    direct: ClassVar[bool] = False
    alone: ClassVar[int] = 50_000

    def covers(self, x):
        return False  # 0 and 1 tell few categories apart

    def pointed(self, x):
        return bool(((x == 0) | (x == 1)).all()) and super().pointed(x)

    def places(self, w):
        return np.ascontiguousarray(self.packed(w[:, : w.shape[1] // 2]).T)

    def place_sums(self, places):
        return np.bitwise_count(places).sum(0, dtype=np.int64)

    def place_gaps(self, places, own, below=None):
        out = np.bitwise_count(places[0] ^ own[0]).astype(np.uint16)
        for part, word in zip(places[1:], own[1:], strict=True):
            out += np.bitwise_count(part ^ word)
        return out

    def place_unit(self, width):
        return 1.0, 0

    def sketch(self, w):
        return {"bits": self.packed(w).T, "share": self._share(w)}

    def rough(self, sketch, x, blind):
        bits, share, own = sketch["bits"], sketch["share"], self.packed(x)
        if not (np.isfinite(share).all() and ((x == 0) | (x == 1)).all()):
            return None
        both = np.empty((len(x), len(share)), np.float32)
        for a in range(0, len(share), 4000):
            total = np.bitwise_count(bits[0, a : a + 4000] & own[:, :1]).astype(np.uint16)
            for k in range(1, len(bits)):
                total += np.bitwise_count(bits[k, a : a + 4000] & own[:, k : k + 1])
            both[:, a : a + 4000] = total
        return both * share, both / np.float32(x.shape[1] / 2), float(1e-6 * x.shape[1] * share.max()), 1e-5, -math.inf if blind else self.rho

    def prepare(self, x):
        return np.trunc(super().prepare(x))

    def validate(self, x):
        self._need(bool(np.isin(x, (0, 1)).all()), "rows must be 0/1")
        super().validate(x)


@dataclass(frozen=True)
class ART1(Kernel):
    """Binary patterns: weight [bottom-up (d), top-down (d)]. Updated weights have float precision."""

    L: float = 2.0

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and self.L >= 1, "rho in [0, 1], L >= 1")

    def validate(self, x):
        self._need(bool(np.isin(x, (0, 1)).all()), "rows must be 0/1")

    def activate(self, w, x, n):
        return w[:, : len(x)] @ x, {}

    def match(self, w, x, cache, j):
        d = len(x)
        return np.count_nonzero((x != 0) & (w[j, d:] != 0)) / d

    def matches(self, w, x, cache):
        return np.count_nonzero((x != 0) & (w[:, len(x) :] != 0), axis=1) / len(x)

    def reach(self, w):
        d = w.shape[1] // 2
        return np.count_nonzero(w[:, d:], axis=1) / d

    def update(self, w, x, cache, j, beta=None):
        top = x * (w[len(x) :] != 0) if len(x) else x
        below = self.L - 1 + top.sum()
        scale = np.float32(self.L / below) if below else np.float32(0)
        return np.concatenate([(scale * top.astype(np.float32)).astype(np.float32), top.astype(np.float32)]).astype(float)

    def new(self, x):
        return np.concatenate([self.L / (self.L - 1 + len(x)) * x, x])

    def centre(self, w):
        return w[len(w) // 2 :]


@dataclass(frozen=True)
class ART2A(Kernel):
    """Dot products with a floor alpha on the match. Kept for completeness: published reports find it unreliable."""

    alpha: float = 0.0
    beta: float = 1.0

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and 0 <= self.alpha <= 1 and 0 <= self.beta <= 1, "rho, alpha, beta in [0, 1]")
        warnings.warn("ART2A is known to work poorly", stacklevel=2)

    def validate(self, x):
        super().validate(x)
        self._need(self.alpha <= 1 / math.sqrt(x.shape[-1]), "alpha must be at most 1 / sqrt(d)")

    def activate(self, w, x, n):
        dot = np.ascontiguousarray(w) @ x
        return dot, {"dot": dot, "floor": self.alpha * x.sum()}

    def match(self, w, x, cache, j):
        return cache["dot"][j] if cache["dot"][j] >= cache["floor"] else -1.0

    def matches(self, w, x, cache):
        return np.where(cache["dot"] >= cache["floor"], cache["dot"], -1.0)

    def update(self, w, x, cache, j, beta=None):
        beta = self.beta if beta is None else beta
        return beta * x + (1 - beta) * w

    def new(self, x):
        return x.copy()


@dataclass(frozen=True)
class Hypersphere(Kernel):
    """Balls: weight [centre (d), radius]. A row on the centre with alpha 0 leaves the centre where it is."""

    alpha: float = 1e-10
    beta: float = 1.0
    r_hat: float = 1.0
    tiled: ClassVar[bool] = True

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and self.alpha >= 0 and 0 <= self.beta <= 1 and self.r_hat > 0, "rho, beta in [0, 1], alpha >= 0, r_hat > 0")

    def activate(self, w, x, n):
        r = np.sqrt(((w[:, :-1] - x) ** 2).sum(1))
        most = np.maximum(w[:, -1], r)
        below = self.r_hat - w[:, -1] + self.alpha
        return np.divide(self.r_hat - most, below, out=np.full(len(w), np.nan), where=below != 0), {"r": r, "most": most}

    def match(self, w, x, cache, j):
        return 1 - cache["most"][j] / self.r_hat

    def matches(self, w, x, cache):
        return 1 - cache["most"] / self.r_hat

    def score_rows(self, w, x):
        most = np.maximum(w[:, -1], np.sqrt(((w[None, :, :-1] - x[:, None]) ** 2).sum(2)))
        below = np.broadcast_to(self.r_hat - w[:, -1] + self.alpha, most.shape)
        return np.divide(self.r_hat - most, below, out=np.full(most.shape, np.nan), where=below != 0), 1 - most / self.r_hat

    many: ClassVar[tuple[int, int]] = (256, 256)

    def sketch(self, w):
        below = self.r_hat - w[:, -1] + self.alpha
        share = np.divide(1, below, out=np.full(len(w), np.nan), where=(below > 0) & (np.abs(w) <= 2).all(1))
        return {"centre": w[:, :-1].T, "square": (w[:, :-1] ** 2).sum(1), "radius": w[:, -1], "share": share}

    def rough(self, sketch, x, blind):
        share = sketch["share"]
        if not (np.isfinite(share).all() and np.abs(x).max() <= 2):
            return None
        square = (x * x).sum(1)[:, None] + sketch["square"] - 2 * (x @ sketch["centre"])
        off = math.sqrt(1e-13 * x.shape[1])  # of a distance, whose square is off by some roundings
        most = np.maximum(sketch["radius"], np.sqrt(np.maximum(square, 0, out=square), out=square))
        return (self.r_hat - most) * share, 1 - most / self.r_hat, float(off * share.max() + 1e-12), off / self.r_hat + 1e-12, -math.inf if blind else self.rho

    def score_pairs(self, w, x):
        most = np.maximum(w[:, -1], np.sqrt(((w[:, :-1] - x) ** 2).sum(1)))
        below = self.r_hat - w[:, -1] + self.alpha
        return np.divide(self.r_hat - most, below, out=np.full(len(w), np.nan), where=below != 0), 1 - most / self.r_hat

    def update(self, w, x, cache, j, beta=None):
        beta, radius, r = self.beta if beta is None else beta, w[-1], cache["r"][j]
        ratio = min(radius, r) / (r + self.alpha) if r + self.alpha else 1.0
        return np.append(w[:-1] + beta / 2 * (x - w[:-1]) * (1 - ratio), radius + beta / 2 * (max(radius, r) - radius))

    def new(self, x):
        return np.append(x, 0.0)

    def centre(self, w):
        return w[:-1]

    def geometry(self, w):
        return {"centre": w[:-1], "radius": float(w[-1])}


@dataclass(frozen=True)
class Ellipsoid(Kernel):
    """Ellipsoids: weight [centre (d), direction of the major axis (d), radius]. A row on the centre leaves it where it is."""

    alpha: float = 1e-10
    beta: float = 1.0
    mu: float = 0.8
    r_hat: float = 1.0
    tiled: ClassVar[bool] = True

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and 0 <= self.alpha <= 1 and 0 <= self.beta <= 1 and 0 < self.mu <= 1 and self.r_hat > 0, "rho, alpha, beta in [0, 1], mu in (0, 1], r_hat > 0")

    def activate(self, w, x, n):
        d = len(x)
        gap, axis, radius = x - w[:, :d], w[:, d : 2 * d], w[:, -1]
        square = (gap * gap).sum(1)
        along = (axis * gap).sum(1)
        stretched = np.sqrt(np.maximum(square - (1 - self.mu**2) * along**2, 0)) / self.mu
        r = np.where((axis != 0).any(1), stretched, np.sqrt(square))
        most = np.maximum(radius, r)
        below = self.r_hat - 2 * radius + self.alpha
        return np.divide(self.r_hat - radius - most, below, out=np.full(len(w), np.nan), where=below != 0), {"r": r, "most": most}

    def match(self, w, x, cache, j):
        return 1 - (w[j, -1] + cache["most"][j]) / self.r_hat

    def matches(self, w, x, cache):
        return 1 - (w[:, -1] + cache["most"]) / self.r_hat

    def score_rows(self, w, x):
        d = x.shape[1]
        gap, axis, radius = x[:, None] - w[None, :, :d], w[:, d : 2 * d], w[:, -1]
        square, along = (gap * gap).sum(2), (axis[None] * gap).sum(2)
        stretched = np.sqrt(np.maximum(square - (1 - self.mu**2) * along**2, 0)) / self.mu
        most = np.maximum(radius, np.where((axis != 0).any(1), stretched, np.sqrt(square)))
        below = np.broadcast_to(self.r_hat - 2 * radius + self.alpha, most.shape)
        return np.divide(self.r_hat - radius - most, below, out=np.full(most.shape, np.nan), where=below != 0), 1 - (radius + most) / self.r_hat

    def update(self, w, x, cache, j, beta=None):
        beta, d, radius, r = self.beta if beta is None else beta, len(x), w[-1], cache["r"][j]
        ratio = min(radius, r) / r if r else 1.0
        centre = w[:d] + beta / 2 * (x - w[:d]) * (1 - ratio)
        axis = w[d : 2 * d]
        if radius != 0:
            gap = x - centre
            size = np.sqrt(gap @ gap)
            axis = gap / size if size else axis
        return np.concatenate([centre, axis, [radius + beta / 2 * (max(radius, r) - radius)]])

    def new(self, x):
        return np.concatenate([x, np.zeros(len(x) + 1)])

    def centre(self, w):
        return w[: (len(w) - 1) // 2]

    def geometry(self, w):
        d = (len(w) - 1) // 2
        return {"centre": w[:2], "minor": float(2 * self.mu * w[-1]), "major": float(2 * w[-1]), "angle": math.degrees(math.atan2(w[d + 1], w[d])) if d > 1 else 0.0}


@dataclass(frozen=True)
class Gaussian(Kernel):
    """Gaussians with diagonal covariance: weight [mean, sigma, 1/sigma^2, sqrt(det), count]."""

    alpha: float = 1e-10
    sigma: tuple[float, ...] = (0.5,)
    tiled: ClassVar[bool] = True

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and self.alpha > 0 and all(s > 0 for s in self.sigma), "rho in [0, 1], alpha > 0, sigma > 0")

    def _sigma(self, d: int) -> np.ndarray:
        s = np.array(self.sigma, float)
        return np.repeat(s, d) if len(s) == 1 else s

    def validate(self, x):
        super().validate(x)
        self._need(len(self.sigma) in (1, x.shape[-1]), "sigma must have one value or one for each column")

    def activate(self, w, x, n):
        d = len(x)
        e = np.exp(-0.5 * ((w[:, :d] - x) ** 2 * w[:, 2 * d : 3 * d]).sum(1))
        return e / (self.alpha + w[:, -2]) * w[:, -1] / w[:, -1].sum(), {"e": e}

    def match(self, w, x, cache, j):
        return cache["e"][j]

    def matches(self, w, x, cache):
        return cache["e"]

    def score_rows(self, w, x):
        d = x.shape[1]
        e = np.exp(-0.5 * ((w[None, :, :d] - x[:, None]) ** 2 * w[None, :, 2 * d : 3 * d]).sum(2))
        return e / (self.alpha + w[:, -2]) * w[:, -1], e

    many: ClassVar[tuple[int, int]] = (256, 256)

    def sketch(self, w):
        d = (w.shape[1] - 2) // 3
        inverse = w[:, 2 * d : 3 * d]
        scaled = w[:, :d] * inverse
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.log(w[:, -1] / (self.alpha + w[:, -2]))
        return {"inverse": inverse.T, "scaled": scaled.T, "square": (w[:, :d] * scaled).sum(1), "gain": gain, "size": inverse.sum(1)}

    def rough(self, sketch, x, blind):
        gain, size = sketch["gain"], sketch["size"]
        if not (np.isfinite(gain).all() and np.isfinite(size).all() and np.isfinite(sketch["square"]).all() and np.abs(x).max() <= 2):
            return None
        floor = -math.inf if blind or self.rho == 0 else math.log(self.rho)
        m = -0.5 * ((x * x) @ sketch["inverse"] - 2 * (x @ sketch["scaled"]) + sketch["square"])
        if floor == -math.inf and m.max(1).min() < -600:  # what exp() makes 0 has no order
            return None
        # Terms are at most 4 times the inverse variances and means.
        off = 1e-15 * x.shape[1] * float(9 * size.max() + np.abs(sketch["square"]).max()) + 1e-11
        return m + gain, m, off, off, floor

    def score_pairs(self, w, x):
        d = x.shape[1]
        e = np.exp(-0.5 * ((w[:, :d] - x) ** 2 * w[:, 2 * d : 3 * d]).sum(1))
        return e / (self.alpha + w[:, -2]) * w[:, -1], e

    def norm(self, w):
        return w[:, -1].sum()

    def update(self, w, x, cache, j, beta=None):
        d, count = len(x), w[-1] + 1
        mean = (1 - 1 / count) * w[:d] + x / count
        square = (1 - 1 / count) * w[d : 2 * d] ** 2 + (mean - x) ** 2 / count
        sigma = np.sqrt(square)
        return np.concatenate([mean, sigma, 1 / square, [math.sqrt(float(np.prod(square))), count]])

    def new(self, x):
        s = self._sigma(len(x))
        return np.concatenate([x, s, 1 / s**2, [math.sqrt(float(np.prod(s**2))), 1]])

    def centre(self, w):
        return w[: (len(w) - 2) // 3]

    def geometry(self, w):
        d = (len(w) - 2) // 3
        return {"centre": w[:d], "sigma": w[d : 2 * d]}


@dataclass(frozen=True)
class Bayesian(Kernel):
    """Gaussians with full covariance: weight [mean, covariance by rows, count]. Vigilance bounds the determinant from above."""

    rho: float = 1e-4
    covariance: tuple[tuple[float, ...], ...] = ((1e-2,),)
    inverted: ClassVar[bool] = True

    def __post_init__(self) -> None:
        self._need(self.rho > 0, "rho > 0")

    def _covariance(self, d: int) -> np.ndarray:
        c = np.array(self.covariance, float)
        return np.eye(d) * c[0, 0] if c.shape == (1, 1) else c

    def validate(self, x):
        super().validate(x)
        self._need(self._covariance(x.shape[-1]).shape == (x.shape[-1],) * 2, "covariance must be d x d")

    def activate(self, w, x, n):
        d = len(x)
        cov = w[:, d : d + d * d].reshape(-1, d, d)
        gap = x - w[:, :d]
        power = np.einsum("ki,ki->k", gap, np.linalg.solve(cov, gap[:, :, None])[:, :, 0])
        density = np.exp(-0.5 * power) / np.sqrt((2 * np.pi) ** d * np.linalg.det(cov))
        return density * w[:, -1] / w[:, -1].sum(), {}

    def match(self, w, x, cache, j):
        d = len(x)
        return float(np.linalg.det(self.update(w[j], x, cache, j)[d : d + d * d].reshape(d, d)))

    def resonates(self, match, rho, strict):
        return rho > match if strict else rho >= match

    def track(self, match, rho, epsilon, method):
        new = {"MT+": match - epsilon, "MT-": match + epsilon, "MT0": match, "MT1": -math.inf, "MT~": rho}[method]
        return new, method != "MT1"

    def update(self, w, x, cache, j, beta=None):
        d, n = len(x), w[-1]
        mean = (1 - 1 / (n + 1)) * w[:d] + x / (n + 1)
        gap = x - mean
        return np.concatenate([mean, (n / (n + 1) * w[d : d + d * d].reshape(d, d) + np.outer(gap, gap) / (n + 1)).ravel(), [n + 1]])

    def new(self, x):
        return np.concatenate([x, self._covariance(len(x)).ravel(), [1]])

    @staticmethod
    def _d(w: np.ndarray) -> int:
        return (math.isqrt(1 + 4 * (len(w) - 1)) - 1) // 2

    def centre(self, w):
        return w[: self._d(w)]

    def geometry(self, w):
        d = self._d(w)
        values, axes = np.linalg.eigh(w[d : d + d * d].reshape(d, d))
        return {"centre": w[:d], "variances": values, "axes": axes.ravel()}


@dataclass(frozen=True)
class QuadraticNeuron(Kernel):
    """Quadratic neurons: weight [A by rows, b, s], activation exp(-s^2 |Ax - b|^2), learnt by gradient steps."""

    s: float = 0.5
    lr_b: float = 0.1
    lr_w: float = 0.1
    lr_s: float = 0.1

    def __post_init__(self) -> None:
        self._need(0 <= self.rho <= 1 and 0 < self.lr_b <= 1 and 0 <= self.lr_w <= 1 and 0 <= self.lr_s <= 1, "rho, lr_w, lr_s in [0, 1], lr_b in (0, 1]")

    def activate(self, w, x, n):
        d = len(x)
        z = w[:, : d * d].reshape(-1, d, d) @ x
        gap = z - w[:, d * d : -1]
        far = (gap * gap).sum(1)
        t = np.exp(-(w[:, -1] ** 2) * far)
        return t, {"t": t, "gap": gap, "far": far}

    def match(self, w, x, cache, j):
        return cache["t"][j]

    def matches(self, w, x, cache):
        return cache["t"]

    def update(self, w, x, cache, j, beta=None):
        d, t, gap, s = len(x), cache["t"][j], cache["gap"][j], w[-1]
        pull = 2 * s * s * t * gap
        return np.concatenate([w[: d * d] - self.lr_w * np.outer(pull, x).ravel(), w[d * d : -1] + self.lr_b * pull, [s - self.lr_s * 2 * s * t * cache["far"][j]]])

    def new(self, x):
        return np.concatenate([np.eye(len(x)).ravel(), x, [self.s]])

    @staticmethod
    def _d(w: np.ndarray) -> int:
        return (math.isqrt(1 + 4 * (len(w) - 1)) - 1) // 2

    def centre(self, w):
        d = self._d(w)
        return w[d * d : -1]

    def geometry(self, w):
        d = self._d(w)
        return {"centre": self.centre(w), "matrix": w[: d * d], "width": float(w[-1])}


KERNELS = {k.__name__: k for k in (Fuzzy, BinaryFuzzy, ART1, ART2A, Hypersphere, Ellipsoid, Gaussian, Bayesian, QuadraticNeuron)}
