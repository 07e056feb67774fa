"""Learners: the order-dependent folds behind every model, one row at a time.

A learner takes rows in order (`step`) and labels rows (`predict`). Its state can be
read as rows of a weights table (`export`) and put back (`load`), so that fits go on
where they stopped. Learners hold NumPy data only and travel to executors as they are.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np

from echoform.operators.kernels import Kernel
from echoform.operators.search import NARROW, ROW_RUN, TILE_ROWS, Categories, Tile, by_activation, check_method, choose, learn, learn_rows, most_active, nearest, nearest_rows, resonant, still

#: (module, cluster_id, w, n, mapped, links) of the weights table.
State = tuple[str, int, list[float], int, int | None, list[int] | None]


class Learner:
    """Base: inputs are named columns of a row; outputs is how many labels a row gets."""

    inputs: tuple[str, ...] = ("x",)
    outputs = 1
    #: A number beside each label of the last step_rows(), kept with the labels; or none.
    aside: np.ndarray | None = None

    def fresh(self) -> Learner:
        return copy.deepcopy(self)

    @property
    def input_kernels(self) -> tuple[Kernel | None, ...]:
        """The kernel whose rules each input must keep, or none."""
        return (getattr(self, "kernel", None),)

    #: Names of the constructor's settings; kernels, modules and lists of them are reached by paths.
    settings: tuple[str, ...] = ("kernel", "method", "epsilon")

    def params(self) -> dict[str, object]:
        """Every setting by its path, such as method, kernel__rho, kernels__1__beta or module__kernel__rho."""
        out: dict[str, object] = {}
        for name in self.settings:
            value = getattr(self, name)
            out[name] = value
            for k, part in enumerate(value) if isinstance(value, tuple) else ((None, value),):
                path = name if k is None else f"{name}__{k}"
                if isinstance(part, Learner):
                    out |= {f"{path}__{p}": v for p, v in part.params().items()}
                elif isinstance(part, Kernel):
                    out |= {f"{path}__{f.name}": getattr(part, f.name) for f in fields(part)}
        return out

    def with_params(self, **changes) -> Learner:
        """A new, empty learner with settings changed by path; all rules of learners and kernels are checked again."""
        unknown = set(changes) - set(self.params())
        if unknown:
            raise ValueError(f"{type(self).__name__} has no {', '.join(sorted(unknown))}")

        def changed(value, inner: dict):
            if not inner:
                return value
            if "" in inner:
                value = inner.pop("")
            return value.with_params(**inner) if inner else value

        own = {}
        for name in self.settings:
            inner = {k.removeprefix(name).removeprefix("__"): v for k, v in changes.items() if k == name or k.startswith(f"{name}__")}
            value = inner.pop("") if "" in inner else getattr(self, name)
            if isinstance(value, tuple) and inner:
                value = tuple(changed(v, {p.partition("__")[2]: x for p, x in inner.items() if p.partition("__")[0] == str(k)}) for k, v in enumerate(value))
            else:
                value = changed(value, inner)
            own[name] = value
        return type(self)(**own)

    def step(self, *row) -> tuple[int, ...]:
        raise NotImplementedError

    def step_rows(self, columns: list) -> np.ndarray:
        """step() for rows given as columns, one line of labels for each row."""
        return np.array([self.step(*row) for row in zip(*columns, strict=True)], np.int64).reshape(-1, self.outputs)

    def modules(self) -> dict[str, Categories]:
        """Category tables by the names that export() gives them."""
        return {"a": self.cats}

    def finish(self) -> None:
        """Called once after the last row."""

    def predict(self, *row) -> tuple[int, ...]:
        raise NotImplementedError

    def predict_rows(self, columns: list) -> np.ndarray:
        """Labels of rows given as columns, one line for each row."""
        out = np.array([self.predict(*row) for row in zip(*columns, strict=True)], np.int64)
        return out.reshape(-1, self.outputs)

    def export(self) -> Iterator[State]:
        raise NotImplementedError

    def load(self, rows: list[State]) -> None:
        raise NotImplementedError


def _matrix(kernel: Kernel, x) -> bool:
    """Whether rows can be worked on by tiles: a kernel that allows it, and a column of equally long rows."""
    return kernel.tiled and isinstance(x, np.ndarray) and x.ndim == 2


def _export(module: str, cats: Categories, mapped: dict | None = None) -> Iterator[State]:
    for j in range(cats.size):
        yield module, j, cats.w[j].tolist(), int(cats.n[j]), None if mapped is None else mapped.get(j), None


def _load(rows: list[State], module: str) -> tuple[Categories, dict[int, int]]:
    own = sorted((r for r in rows if r[0] == module), key=lambda r: r[1])
    return Categories.of([r[2] for r in own], [r[3] for r in own]), {r[1]: r[4] for r in own if r[4] is not None}


@dataclass
class Clusterer(Learner):
    """An elementary model: rows join the category that resonates, or found a new one."""

    kernel: Kernel
    method: str = "MT+"
    epsilon: float = 0.0
    cats: Categories = field(default_factory=Categories)
    #: Of kernels with a reach: numbers of the categories that a row can still join; none where not known.
    live: np.ndarray | None = field(default=None, repr=False)

    def step(self, x, allowed=None):
        if allowed is None:
            return (self._learn(x),)
        self.live = None
        return (learn(self.kernel, self.cats, x, allowed, self.method, self.epsilon),)

    def _learn(self, x: np.ndarray) -> int:
        """learn() among the categories that can pass: others, in whatever number, are not looked at."""
        k, cats = self.kernel, self.cats
        can = lambda w: k.resonates(k.reach(w), k.rho, check_method(self.method))
        if self.live is None:
            if k.inverted or k.reach(cats.w) is None:
                return learn(k, cats, x, None, self.method, self.epsilon)
            self.live = np.flatnonzero(can(cats.w))
        at = -1
        if len(self.live):
            t, cache = k.activate(cats.w[self.live], x, cats.n[self.live])
            at = choose(k, t, k.matches(cats.w[self.live], x, cache), None, self.method, self.epsilon)
        if at < 0:
            j = cats.add(k.new(x))
            if can(cats.w[j : j + 1])[0]:
                self.live = np.append(self.live, j)
            return j
        j = int(self.live[at])
        cats.set(j, k.update(cats.w[j], x, cache, at))
        if not can(cats.w[j : j + 1])[0]:
            self.live = np.delete(self.live, at)
        return j

    def step_rows(self, columns):
        if not _matrix(self.kernel, columns[0]):
            return super().step_rows(columns)
        return learn_rows(self.kernel, self.cats, columns[0], self.method, self.epsilon)[:, None]

    def predict(self, x):
        return (nearest(self.kernel, self.cats, x),)

    def predict_rows(self, columns):
        if not _matrix(self.kernel, columns[0]):
            return super().predict_rows(columns)
        return nearest_rows(self.kernel, self.cats, columns[0])[:, None]

    def export(self):
        return _export("a", self.cats)

    def load(self, rows):
        self.cats, _ = _load(rows, "a")
        self.live = None


@dataclass
class MapClassifier(Learner):
    """Simple ARTMAP: categories belong to one class each; a row of another class is refused and moves the vigilance."""

    kernel: Kernel
    method: str = "MT+"
    epsilon: float = 1e-10
    vigilant: bool = False
    cats: Categories = field(default_factory=Categories)
    classes: dict[int, int] = field(default_factory=dict)
    _class: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64), repr=False)
    settings = ("kernel", "method", "epsilon", "vigilant")
    inputs = ("x", "y")
    outputs = 2

    def step(self, x, y, allowed=None):
        y = int(y)
        while len(self._class) < self.cats.size + 1:
            room = np.zeros(max(16, 2 * len(self._class)), np.int64)
            room[: len(self._class)] = self._class
            self._class = room
        own = self._class[: self.cats.size] == y
        j = learn(self.kernel, self.cats, x, own if allowed is None else lambda j: own[j] and allowed(j), self.method, self.epsilon)
        self.classes[j] = self._class[j] = y
        return j, y

    def step_rows(self, columns):
        x, y = columns
        if not _matrix(self.kernel, x):
            return super().step_rows(columns)
        y = np.asarray(y).astype(np.int64)

        def founded(j: int, row: int) -> np.ndarray:
            if j >= len(self._class):
                self._class = np.concatenate([self._class, np.full(max(16, j + 1), -1, np.int64)])
            self.classes[j] = self._class[j] = int(y[row])
            return self._class

        if len(self._class) < self.cats.size + 1:
            self._class = np.concatenate([self._class, np.full(16, -1, np.int64)])
        return np.stack([learn_rows(self.kernel, self.cats, x, self.method, self.epsilon, (self._class, y), founded), y], 1)

    def predict(self, x, y=None):
        j = nearest(self.kernel, self.cats, x, self.vigilant)
        return j, self.classes.get(j, -1)

    def predict_rows(self, columns):
        if not _matrix(self.kernel, columns[0]):
            return super().predict_rows(columns)
        j = nearest_rows(self.kernel, self.cats, columns[0], self.vigilant)
        known = np.array([self.classes.get(k, -1) for k in range(-1, self.cats.size)], np.int64)
        return np.stack([j, known[j + 1]], 1)

    def export(self):
        return _export("a", self.cats, self.classes)

    def load(self, rows):
        self.load_module(rows, "a")

    def load_module(self, rows, module):
        self.cats, self.classes = _load(rows, module)
        self._class = np.array([self.classes.get(j, -1) for j in range(self.cats.size)], np.int64)


@dataclass
class TwoSided(Learner):
    """ARTMAP: module b clusters the targets, module a is mapped onto its clusters."""

    kernel_a: Kernel
    kernel_b: Kernel
    method: str = "MT+"
    epsilon: float = 1e-10
    settings = ("kernel_a", "kernel_b", "method", "epsilon")
    inputs = ("x", "y")
    outputs = 2

    def __post_init__(self) -> None:
        self.a = MapClassifier(self.kernel_a, self.method, self.epsilon)
        self.b = Clusterer(self.kernel_b, self.method, self.epsilon)

    @property
    def input_kernels(self):
        return self.kernel_a, self.kernel_b

    def step(self, x, y):
        return self.a.step(x, self.b.step(y)[0])

    def step_rows(self, columns):
        return self.a.step_rows([columns[0], self.b.step_rows(columns[1:])[:, 0]])

    def predict(self, x, y=None):
        return self.a.predict(x)

    def predict_rows(self, columns):
        return self.a.predict_rows([columns[0], np.zeros(len(columns[0]), np.int64)])

    def modules(self):
        return {"a": self.a.cats, "b": self.b.cats}

    def centres(self) -> np.ndarray:
        """Centre of each cluster of b, for regression."""
        return np.array([self.kernel_b.centre(w) for w in self.b.cats.w])

    def export(self):
        yield from self.a.export()
        yield from _export("b", self.b.cats)

    def load(self, rows):
        self.a.load(rows)
        self.b.cats, _ = _load(rows, "b")


@dataclass
class DualVigilance(Learner):
    """Two vigilances: below the upper and above the lower one a row founds a sub-category of the same cluster."""

    kernel: Kernel
    rho_lower: float = 0.0
    method: str = "MT+"
    epsilon: float = 0.0
    cats: Categories = field(default_factory=Categories)
    clusters: dict[int, int] = field(default_factory=dict)

    settings = ("kernel", "rho_lower", "method", "epsilon")

    def __post_init__(self) -> None:
        if self.kernel.inverted:
            raise ValueError("dual vigilance needs a kernel whose vigilance bounds the match from below")
        if not 0 <= self.rho_lower < self.kernel.rho:
            raise ValueError("0 <= rho_lower < rho is needed")

    def step(self, x, allowed=None):
        strict, k, cats, rho = check_method(self.method), self.kernel, self.cats, self.kernel.rho
        if not cats.size:
            cats.add(k.new(x))
            self.clusters[0] = 0
            return (0,)
        t, cache = k.activate(cats.w, x, cats.n)
        for j in by_activation(t).tolist():
            if not t[j] > 0:
                break
            m = k.match(cats.w, x, cache, j)
            if allowed is None or allowed(self.clusters[j]):
                if k.resonates(m, rho, strict):
                    cats.set(j, k.update(cats.w[j], x, cache, j))
                    return (self.clusters[j],)
                if k.resonates(m, self.rho_lower, strict):
                    self.clusters[cats.add(k.new(x))] = self.clusters[j]
                    return (self.clusters[j],)
            else:
                # Any refusal moves the vigilance here, and it may pass 1.
                rho, _ = k.track(m, rho, self.epsilon, self.method)
                if self.method == "MT1":
                    break
        label = max(self.clusters.values()) + 1
        self.clusters[cats.add(k.new(x))] = label
        return (label,)

    def predict(self, x):
        return (self.clusters.get(nearest(self.kernel, self.cats, x), -1),)

    def export(self):
        return _export("a", self.cats, self.clusters)

    def load(self, rows):
        self.cats, self.clusters = _load(rows, "a")


@dataclass
class Topology(Learner):
    """Topological clustering: the first resonant category learns at beta, the second at beta_lower, and an edge joins them.

    Every tau rows, categories with fewer than phi rows go unless they are permanent.
    step() gives the label in the numbering at its time, before a prune that it brings
    about; aside has the number of prunes before each row of the last step_rows(). The
    prune log, part of the state, tells what became of each number; compound.relabel()
    composes it, so that labels are those of the categories left.
    """

    kernel: Kernel
    beta_lower: float = 0.5
    tau: int = 100
    phi: int = 5
    method: str = "MT+"
    epsilon: float = 0.0
    cats: Categories = field(default_factory=Categories)
    edges: dict[tuple[int, int], int] = field(default_factory=dict)
    permanent: list[bool] = field(default_factory=list)
    seen: int = 0
    prunes: int = 0
    log: list[dict[int, int]] = field(default_factory=list)
    #: Rows that changed a weight since the choice between rows and tiles.
    changes: int = field(default=0, repr=False)

    settings = ("kernel", "beta_lower", "tau", "phi", "method", "epsilon")

    def __post_init__(self) -> None:
        if not hasattr(self.kernel, "beta") or self.kernel.beta < self.beta_lower:
            raise ValueError("the kernel needs a beta of at least beta_lower")
        if not self.phi <= self.tau:
            raise ValueError("phi <= tau is needed")

    def step(self, x, allowed=None):
        self.seen += 1
        label = self._learn(x, allowed)
        if self.seen % self.tau == 0:
            self.prune()
        return (label,)

    def step_rows(self, columns):
        x = columns[0]
        self.aside = self.prunes + (self.seen % self.tau + np.arange(len(x))) // self.tau
        if not _matrix(self.kernel, x):
            return super().step_rows(columns)
        out, at, busy = np.empty((len(x), 1), np.int64), 0, True
        while at < len(x):
            n, self.changes = min(self.tau - self.seen % self.tau, len(x) - at), 0
            if busy:  # while many rows change something, a tile saves nothing
                n = min(n, ROW_RUN)
                for r in range(at, at + n):
                    out[r, 0] = self._learn(x[r], None)
            else:
                n = min(n, Tile.rows(self.kernel, self.cats, x.shape[1]))
                out[at : at + n, 0] = self._learn_tile(x[at : at + n])
            busy = 10 * self.changes > n
            self.seen += n
            at += n
            if self.seen % self.tau == 0:
                self.prune()
        return out

    def _learn_tile(self, x: np.ndarray) -> np.ndarray:
        """Rows between two prunes, by a tile: those that change neither of their two categories are learnt at once."""
        k, cats, strict, out = self.kernel, self.cats, check_method(self.method), np.empty(len(x), np.int64)
        tile, r, ahead = Tile(k, cats, x), 0, 8
        while r < len(x):
            end, fine, first = min(len(x), r + ahead), 0, None
            if cats.size:
                first, held = tile.winners(r, end, strict)
                held[np.arange(len(first)), np.maximum(first, 0)] = -np.inf
                second = held.argmax(1)
                second = np.where(held[np.arange(len(first)), second] > -np.inf, second, -1)
                same = (first >= 0) & still(k, cats.w[np.maximum(first, 0)], x[r:end]) & ((second < 0) | still(k, cats.w[np.maximum(second, 0)], x[r:end]))
                fine = int(np.argmin(same)) if not same.all() else len(same)
                out[r : r + fine] = first[:fine]
                both = second[:fine] >= 0
                np.add.at(cats.n, first[:fine], 1)
                np.add.at(cats.n, second[:fine][both], 1)
                for a, b in zip(first[:fine][both].tolist(), second[:fine][both].tolist(), strict=True):
                    self.edges[a, b] = self.edges.get((a, b), 0) + 1
            if r + fine == end:
                r, ahead = end, min(TILE_ROWS, 2 * ahead)
                continue
            r, row = r + fine, fine
            a, b = (int(first[row]), int(second[row])) if cats.size else (-1, -1)
            if a < 0:
                self.permanent.append(False)
            out[r] = tile.learn(r, a)
            if a >= 0 and b >= 0:
                one = cats.w[b : b + 1]
                cats.set(b, k.update(cats.w[b], x[r], k.activate(one, x[r], cats.n[b : b + 1])[1], 0, self.beta_lower))
                tile.changed(b, r)
                self.edges[a, b] = self.edges.get((a, b), 0) + 1
            ahead = max(1, min(ahead, 2 * (fine + 1)))
            self.changes += 1
            r += 1
        return out

    def _take(self, j: int, x, cache, beta=None) -> bool:
        """Let a category learn a row; whether its weight changes."""
        w = self.kernel.update(self.cats.w[j], x, cache, j, beta)
        changed = bool((w != self.cats.w[j]).any())
        self.cats.set(j, w)
        return changed

    def _learn(self, x, allowed):
        strict, k, cats, rho, first = check_method(self.method), self.kernel, self.cats, self.kernel.rho, -1
        if cats.size and allowed is None and not k.inverted:
            # Both categories are known before either changes: the two most active ones that pass.
            t, cache = k.activate(cats.w, x, cats.n)
            match = k.matches(cats.w, x, cache)
            passes = match > rho if strict else match >= rho
            first = most_active(t, passes)
            if first >= 0:
                passes[first] = False
                second = most_active(t, passes)
                changed = self._take(first, x, cache)
                if second >= 0:
                    changed |= self._take(second, x, cache, self.beta_lower)
                    self.edges[first, second] = self.edges.get((first, second), 0) + 1
                self.changes += changed
                return first
        elif cats.size:
            # A category changes only once its own match is known, so nothing is copied.
            t, cache = k.activate(cats.w, x, cats.n)
            for j in by_activation(t).tolist():
                fine = allowed is None or allowed(j)
                m = k.match(cats.w, x, cache, j)
                if fine and k.resonates(m, rho, strict):
                    cats.set(j, k.update(cats.w[j], x, cache, j, None if first < 0 else self.beta_lower))
                    if first >= 0:
                        self.edges[first, j] = self.edges.get((first, j), 0) + 1
                        return first
                    first = j
                elif not fine:
                    rho, _ = k.track(m, rho, self.epsilon, self.method)
                    if self.method == "MT1":
                        break
        if first < 0:
            self.permanent.append(False)
            self.changes += 1
            return cats.add(k.new(x))
        return first

    def prune(self) -> dict[int, int]:
        """Drop weak categories; returns new numbers by old."""
        keep = np.array([p or n >= self.phi for p, n in zip(self.permanent, self.cats.n, strict=True)], bool)
        number = {int(old): new for new, old in enumerate(np.flatnonzero(keep))}
        self.cats.keep(keep)
        self.permanent = [True] * len(number)
        self.edges = {(number[a], number[b]): n for (a, b), n in self.edges.items() if a in number and b in number}
        self.prunes += 1
        self.log.append(number)
        return number

    def predict(self, x):
        return (nearest(self.kernel, self.cats, x),)

    def predict_rows(self, columns):
        if not _matrix(self.kernel, columns[0]):
            return super().predict_rows(columns)
        return nearest_rows(self.kernel, self.cats, columns[0])[:, None]

    def modules(self):
        raise ValueError("a topology renumbers its categories, so there is no history of them by number")

    def export(self):
        links: dict[int, list[int]] = {}
        for (a, b), c in sorted(self.edges.items()):
            links.setdefault(a, []).extend((b, c))
        for module, j, w, n, _, _ in _export("a", self.cats):
            yield module, j, w, n, int(self.permanent[j]), links.get(j, [])
        yield "seen", 0, [], self.seen, self.prunes, None
        for k, number in enumerate(self.log):
            yield "pruned", k, [], k + 1, None, [v for pair in sorted(number.items()) for v in pair]

    def load(self, rows):
        self.cats, permanent = _load(rows, "a")
        self.permanent = [bool(permanent.get(j)) for j in range(self.cats.size)]
        self.edges = {(r[1], b): c for r in rows if r[0] == "a" and r[5] for b, c in zip(r[5][::2], r[5][1::2], strict=True)}
        self.seen, self.prunes = next(((int(r[3]), int(r[4])) for r in rows if r[0] == "seen"), (0, 0))
        known = sorted((int(r[1]), r[5] or []) for r in rows if r[0] == "pruned")
        self.log = [dict(zip(v[::2], v[1::2], strict=True)) for _, v in known]


@dataclass
class Deep(Learner):
    """A hierarchy of maps: each layer's clusters are the next one's classes, from coarse to fine.

    Supervised: layer i maps kernel i's clusters of channel i. Unsupervised: the first
    layer maps kernel 1's clusters of channel 1 onto kernel 0's of channel 0, and layer i
    kernel i + 1's of channel i + 1. Labels are given from the coarsest level on.
    """

    kernels: tuple[Kernel, ...]
    supervised: bool = True
    method: str = "MT+"
    epsilon: float = 0.0

    settings = ("kernels", "supervised", "method", "epsilon")

    def __post_init__(self) -> None:
        ks = self.kernels
        if len(ks) < (1 if self.supervised else 2):
            raise ValueError("too few kernels")
        self.base = None if self.supervised else Clusterer(ks[0], self.method, self.epsilon)
        self.layers = [MapClassifier(k, self.method, self.epsilon) for k in (ks if self.supervised else ks[1:])]
        self.inputs = tuple(f"x{i}" for i in range(len(ks))) + (("y",) if self.supervised else ())
        self.outputs = len(self.layers) + 1

    @property
    def input_kernels(self):
        return self.kernels

    def step(self, *row):
        if self.supervised:
            xs, label = row[:-1], int(row[-1])
        else:
            xs, label = row[1:], self.base.step(row[0])[0]
        out = [label]
        for layer, x in zip(self.layers, xs, strict=True):
            label = layer.step(x, label)[0]
            out.append(label)
        return tuple(out)

    def step_rows(self, columns):
        if self.supervised:
            xs, label = columns[:-1], np.asarray(columns[-1]).astype(np.int64)
        else:
            xs, label = columns[1:], self.base.step_rows(columns[:1])[:, 0]
        out = [label]
        for layer, x in zip(self.layers, xs, strict=True):
            label = layer.step_rows([x, label])[:, 0]
            out.append(label)
        return np.stack(out, 1)

    def predict_rows(self, columns):
        x = columns[len(self.kernels) - 1]
        label = self.layers[-1].predict_rows([x, np.zeros(len(x), np.int64)])[:, 0]
        out = [label]
        for layer in reversed(self.layers):
            label = np.array([layer.classes.get(k, -1) for k in label.tolist()], np.int64)
            out.append(label)
        return np.stack(out[::-1], 1)

    def predict(self, *row):
        x = row[len(self.kernels) - 1]
        label = self.layers[-1].predict(x)[0]
        out = [label]
        for layer in reversed(self.layers):
            label = layer.classes.get(label, -1)
            out.append(label)
        return tuple(reversed(out))

    def modules(self):
        return ({} if self.base is None else {"base": self.base.cats}) | {f"layer{i}": layer.cats for i, layer in enumerate(self.layers)}

    def export(self):
        if self.base is not None:
            yield from _export("base", self.base.cats)
        for i, layer in enumerate(self.layers):
            yield from _export(f"layer{i}", layer.cats, layer.classes)

    def load(self, rows):
        if self.base is not None:
            self.base.cats, _ = _load(rows, "base")
        for i, layer in enumerate(self.layers):
            layer.load_module(rows, f"layer{i}")


class Smart(Deep):
    """The same rows at vigilances that rise from level to level (fall, where the vigilance bounds from above)."""

    settings = ("kernel", "rhos", "method", "epsilon")

    def __init__(self, kernel: Kernel, rhos: tuple[float, ...], method: str = "MT+", epsilon: float = 0.0):
        down = kernel.inverted
        if any((b >= a) if down else (b <= a) for a, b in zip(rhos, rhos[1:], strict=False)):
            raise ValueError("vigilances must " + ("fall" if down else "rise"))
        super().__init__(tuple(kernel.with_params(rho=r) for r in rhos), False, method, epsilon)
        self.inputs, self.kernel, self.rhos = ("x",), kernel, rhos

    def step(self, x):
        return super().step(*[x] * len(self.kernels))

    def step_rows(self, columns):
        return super().step_rows([columns[0]] * len(self.kernels))

    def predict(self, x):
        return super().predict(*[x] * len(self.kernels))

    def predict_rows(self, columns):
        return super().predict_rows([columns[0]] * len(self.kernels))


@dataclass
class Fusion(Learner):
    """Several channels with a kernel each: activations add up by gamma, every channel must resonate.

    Vigilance moves on every failure, in the channels that passed. Channels may be
    skipped when predicting; a skipped one adds its gamma.
    """

    kernels: tuple[Kernel, ...]
    gamma: tuple[float, ...]
    method: str = "MT+"
    epsilon: float = 0.0
    cats: list[Categories] = field(default_factory=list)

    settings = ("kernels", "gamma", "method", "epsilon")

    def __post_init__(self) -> None:
        if len(self.gamma) != len(self.kernels) or not all(0 <= g <= 1 for g in self.gamma) or abs(sum(self.gamma) - 1) > 1e-12:
            raise ValueError("gamma needs a share in [0, 1] for each kernel, 1 in all")
        self.cats = self.cats or [Categories() for _ in self.kernels]
        self.inputs = tuple(f"x{i}" for i in range(len(self.kernels)))

    @property
    def input_kernels(self):
        return self.kernels

    def _activate(self, xs, skip=()):
        total, caches = np.zeros(self.cats[0].size), []
        for i, (k, g, c) in enumerate(zip(self.kernels, self.gamma, self.cats, strict=True)):
            if i in skip:
                total += g
                caches.append(None)
            else:
                t, cache = k.activate(c.w, xs[i], c.n)
                total = total + g * t
                caches.append(cache)
        return total, caches

    def step_rows(self, columns):
        """By tiles, one for each channel: a row whose most active category passes in all channels and stays as it is needs no search."""
        if not all(_matrix(k, x) for k, x in zip(self.kernels, columns, strict=True)):
            return super().step_rows(columns)
        strict, out, at, n, busy = check_method(self.method), np.empty((len(columns[0]), 1), np.int64), 0, len(columns[0]), True
        while at < n:
            if busy:
                rows, changed = min(ROW_RUN, n - at), 0
                for r in range(at, at + rows):
                    size, own = self.cats[0].size, [x[r] for x in columns]
                    held = [c.w.copy() for c in self.cats]
                    j = out[r, 0] = self.step(*own)[0]
                    changed += self.cats[0].size > size or any((c.w[j] != w[j]).any() for c, w in zip(self.cats, held, strict=True))
                at, busy = at + rows, 4 * changed > rows
                continue
            changed = 0
            rows = min(Tile.rows(k, c, x.shape[1]) for k, c, x in zip(self.kernels, self.cats, columns, strict=True))
            tiles = [Tile(k, c, x[at : at + rows]) for k, c, x in zip(self.kernels, self.cats, columns, strict=True)]
            rows, r, ahead = len(tiles[0].x), 0, 8
            while r < rows:
                end, fine, t, ms = min(rows, r + ahead), 0, None, None
                if self.cats[0].size:
                    t, ms = np.zeros((end - r, self.cats[0].size)), []
                    for g, tile in zip(self.gamma, tiles, strict=True):
                        part, m = tile.scores(r, end)
                        t, ms = t + g * part, [*ms, m]
                    j = np.where(np.isnan(t), -np.inf, t).argmax(1)
                    line = np.arange(end - r)
                    same = ~np.isnan(t[line, j])
                    for k, c, tile, m in zip(self.kernels, self.cats, tiles, ms, strict=True):
                        same &= (m[line, j] > k.rho if strict else m[line, j] >= k.rho) & still(k, c.w[j], tile.x[r:end])
                    fine = int(np.argmin(same)) if not same.all() else len(same)
                    out[at + r : at + r + fine, 0] = j[:fine]
                    for c in self.cats:
                        np.add.at(c.n, j[:fine], 1)
                if r + fine == end:
                    r, ahead = end, min(TILE_ROWS, 2 * ahead)
                    continue
                r += fine
                best = self._search(t[fine], [m[fine] for m in ms]) if self.cats[0].size else -1
                for tile in tiles:
                    out[at + r, 0] = tile.learn(r, best)
                ahead = max(1, min(ahead, 2 * (fine + 1)))
                changed += 1
                r += 1
            at += rows
            busy = 4 * changed > rows
        return out

    def _search(self, t: np.ndarray, matches: list[np.ndarray]) -> int:
        """The category that resonates in all channels, or -1.

        Where tracking moves a vigilance to the match of the category that failed, the bar
        of a channel is the running maximum of the matches before, so nothing needs a loop.
        """
        strict, order = check_method(self.method), by_activation(t)
        if self.method in ("MT0", "MT~") or (self.method == "MT+" and self.epsilon == 0):
            fine, ended = np.ones(len(order), bool), np.zeros(len(order), bool)
            for k, m in zip(self.kernels, matches, strict=True):
                m = m[order]
                bar = np.full(len(m), k.rho) if self.method == "MT~" else np.maximum.accumulate(np.concatenate([[k.rho], m[:-1]]))
                passed = m > bar if strict else m >= bar
                fine &= passed
                ended |= passed & (m > 1) & (self.method != "MT~")
            found = int(fine.argmax()) if fine.any() else -1
            return -1 if found < 0 or ended[:found].any() else int(order[found])
        rhos = [k.rho for k in self.kernels]
        for j in order.tolist():
            passed = [k.resonates(m[j], r, strict) for k, m, r in zip(self.kernels, matches, rhos, strict=True)]
            if all(passed):
                return j
            go_on = True
            for i, k in enumerate(self.kernels):
                if passed[i]:
                    rhos[i], more = k.track(matches[i][j], rhos[i], self.epsilon, self.method)
                    go_on = go_on and more
            if not go_on:
                break
        return -1

    def step(self, *xs, allowed=None):
        strict, size = check_method(self.method), self.cats[0].size
        if size:
            t, caches = self._activate(xs)
            if allowed is None and not any(k.inverted for k in self.kernels):
                j = self._search(t, [k.matches(c.w, x, cache) for k, c, x, cache in zip(self.kernels, self.cats, xs, caches, strict=True)])
                for k, c, x, cache in zip(self.kernels, self.cats, xs, caches, strict=True):
                    c.add(k.new(x)) if j < 0 else c.set(j, k.update(c.w[j], x, cache, j))
                return (size if j < 0 else j,)
            rhos = [k.rho for k in self.kernels]
            for j in by_activation(t).tolist():
                if allowed is not None and self.method == "MT~" and not allowed(j):
                    continue
                matches = [k.match(c.w, x, cache, j) for k, c, x, cache in zip(self.kernels, self.cats, xs, caches, strict=True)]
                passed = [k.resonates(m, r, strict) for k, m, r in zip(self.kernels, matches, rhos, strict=True)]
                if all(passed) and (allowed is None or self.method == "MT~" or allowed(j)):
                    for k, c, x, cache in zip(self.kernels, self.cats, xs, caches, strict=True):
                        c.set(j, k.update(c.w[j], x, cache, j))
                    return (j,)
                go_on = True
                for i, k in enumerate(self.kernels):
                    if passed[i]:
                        rhos[i], more = k.track(matches[i], rhos[i], self.epsilon, self.method)
                        go_on = go_on and more
                if not go_on:
                    break
        for k, c, x in zip(self.kernels, self.cats, xs, strict=True):
            c.add(k.new(x))
        return (size,)

    def predict(self, *xs, skip=()):
        if not self.cats[0].size:
            return (-1,)
        t, _ = self._activate(xs, skip)
        order = by_activation(t)
        return (int(order[0]) if len(order) else 0,)

    def predict_rows(self, columns, skip=()):
        used = [i for i in range(len(self.kernels)) if i not in skip]
        size, n = self.cats[0].size, len(columns[used[0]])
        if not size or not all(_matrix(self.kernels[i], columns[i]) for i in used):
            return super().predict_rows(columns) if not skip else np.array([self.predict(*row, skip=skip) for row in zip(*[c if c is not None else [None] * n for c in columns], strict=True)], np.int64).reshape(-1, 1)
        out, norms = np.empty((n, 1), np.int64), {i: self.kernels[i].norm(self.cats[i].w) for i in used}
        rows = max(1, min(n, min(2_000_000 // (size * columns[i].shape[1]) for i in used)))
        for a in range(0, n, rows):
            total = 0.0
            for i, g in enumerate(self.gamma):
                if i in skip:
                    total = total + g
                else:
                    t, _ = self.kernels[i].score_rows(self.cats[i].w, columns[i][a : a + rows])
                    total = total + g * (t if norms[i] is None else t / norms[i])
            out[a : a + rows, 0] = np.where(np.isnan(total), -np.inf, total).argmax(1)
        return out

    def centres(self, channel: int) -> np.ndarray:
        return np.array([self.kernels[channel].centre(w) for w in self.cats[channel].w])

    def regress(self, *xs, targets: tuple[int, ...] = (-1,)) -> list[np.ndarray]:
        """Centres, in the target channels, of the category that the other channels choose."""
        targets = tuple(t % len(self.kernels) for t in targets)
        j = self.predict(*xs, skip=targets)[0]
        return [self.kernels[t].centre(self.cats[t].w[j]) for t in targets]

    def modules(self):
        return {f"channel{i}": c for i, c in enumerate(self.cats)}

    def export(self):
        for i, c in enumerate(self.cats):
            yield from _export(f"channel{i}", c)

    def load(self, rows):
        self.cats = [_load(rows, f"channel{i}")[0] for i in range(len(self.kernels))]


@dataclass
class Bicluster(Learner):
    """Rows cluster under a correlation test that is decided per row beforehand (see compound.bicluster): an input of 0/1."""

    kernel: Kernel
    cats: Categories = field(default_factory=Categories)
    inputs = ("x", "fits")

    def step(self, x, fits):
        return (learn(self.kernel, self.cats, x, lambda _: bool(fits)),)

    def predict(self, x, fits=None):
        return (nearest(self.kernel, self.cats, x),)

    def export(self):
        return _export("a", self.cats)

    def load(self, rows):
        self.cats, _ = _load(rows, "a")


def _under(path: str, rows: Iterator[State]) -> Iterator[State]:
    """State rows of a module, named by the path to it."""
    return ((f"{path}/{r[0]}", *r[1:]) for r in rows)


def _of(path: str, rows: list[State]) -> list[State]:
    return [(r[0].removeprefix(f"{path}/"), *r[1:]) for r in rows if r[0].startswith(f"{path}/")]


class Nested(Learner):
    """A learner around another one, its module; state rows of the module carry its path, so that trees of any depth are saved and continued."""

    settings = ("module",)

    def __init__(self, module: Learner):
        self.module, self.inputs, self.outputs = module, module.inputs, module.outputs

    @property
    def input_kernels(self):
        return self.module.input_kernels

    def modules(self):
        return {f"module/{m}": c for m, c in self.module.modules().items()}

    @property
    def prunes(self) -> int:
        return getattr(self.module, "prunes", 0)

    @property
    def log(self) -> list[dict[int, int]]:
        return getattr(self.module, "log", [])

    def finish(self):
        self.module.finish()

    def predict(self, *row):
        return self.module.predict(*row)

    def predict_rows(self, columns):
        return self.module.predict_rows(columns)

    def export(self):
        return _under("module", self.module.export())

    def load(self, rows):
        self.module.load(_of("module", rows))


class Mapped(Nested):
    """Simple ARTMAP over any learner that takes a predicate: clusterers, fused channels, topologies, double vigilance, or one of those guarded.

    A row of class y is refused by the module's categories of other classes, under the
    module's own tracking rule. A topology's prunes renumber the classes as well. Labels:
    the module's category and its class; the last input is the class.
    """

    def __init__(self, module: Learner, classes: dict[int, int] | None = None):
        super().__init__(module)
        self.inputs, self.outputs, self.classes = (*module.inputs, "y"), 2, classes or {}

    def step(self, *row, allowed=None):
        y, before = int(row[-1]), self.prunes
        known = self.classes
        label = self.module.step(*row[:-1], allowed=lambda j: known.get(j, y) == y and (allowed is None or allowed(j)))[0]
        if self.prunes != before:
            number = self.log[-1]
            self.classes = {number[j]: c for j, c in known.items() if j in number}
            taken, label = label, number.get(label, -1)
            return taken, y if label < 0 else self.classes.setdefault(label, y)
        return label, self.classes.setdefault(label, y)

    def predict(self, *row):
        j = self.module.predict(*row[: len(self.module.inputs)])[0]
        return j, self.classes.get(j, -1)

    def predict_rows(self, columns):
        j = self.module.predict_rows(columns[: len(self.module.inputs)])[:, 0]
        return np.stack([j, np.array([self.classes.get(k, -1) for k in j.tolist()], np.int64)], 1)

    def export(self):
        yield from super().export()
        for j, c in sorted(self.classes.items()):
            yield "classes", j, [], 0, c, None

    def load(self, rows):
        super().load(rows)
        self.classes = {int(r[1]): int(r[4]) for r in rows if r[0] == "classes"}


class Guarded(Nested):
    """Any learner with a predicate on its categories and hooks around its steps.

    allowed(row, category, module, memory) tells whether a category may take a row; one
    that passes the vigilance and is refused moves it by the module's tracking rule.
    before(row, module, memory) and after(row, labels, module, memory) run around a step.
    memory is a dict of numbers or lists of numbers, part of the exported state, so that a
    fit goes on with it. The functions travel to the executors with the learner.
    """

    settings = ("module", "allowed", "before", "after")

    def __init__(self, module: Learner, allowed=None, before=None, after=None, memory: dict | None = None):
        super().__init__(module)
        self.allowed, self.before, self.after, self.memory = allowed, before, after, memory or {}

    def step(self, *row, allowed=None):
        if self.before:
            self.before(row, self.module, self.memory)
        mine = self.allowed and (lambda j: bool(self.allowed(row, j, self.module, self.memory)))
        test = mine if allowed is None else allowed if not mine else (lambda j: allowed(j) and mine(j))
        labels = self.module.step(*row, allowed=test) if test else self.module.step(*row)
        if self.after:
            self.after(row, labels, self.module, self.memory)
        return labels

    def export(self):
        yield from super().export()
        for name, value in sorted(self.memory.items()):
            yield f"memory:{name}", int(np.ndim(value)), [float(v) for v in np.atleast_1d(value)], 0, None, None

    def load(self, rows):
        super().load(rows)
        for module, many, w, *_ in rows:
            if module.startswith("memory:"):
                self.memory[module.removeprefix("memory:")] = list(w) if many else w[0]


class CalinskiHarabasz:
    """The index kept up to date: per cluster its count, mean and scatter; rows may be added, removed or moved.

    A cluster's scatter changes by n / (n + 1) |x - mean|^2 as a row comes, and back by
    the same as it goes. The value is 0 below two clusters or without scatter. Clusters are
    lines of arrays, so that a value, or all values that a row may bring, are a few sums.
    """

    def __init__(self) -> None:
        self.n, self.mean = 0, None
        #: Line of each label.
        self.place: dict[int, int] = {}
        #: Lines in order of labels; none where they are to be told anew.
        self._lines: np.ndarray | None = None
        self._count, self._means, self._scatter = np.zeros(0), np.zeros((0, 0)), np.zeros(0)

    @property
    def clusters(self) -> dict[int, tuple[int, np.ndarray, float]]:
        """(rows, mean, scatter) by label."""
        return {c: (int(self._count[k]), self._means[k].copy(), float(self._scatter[k])) for c, k in self.place.items()}

    def put(self, label: int, n: int, mean: np.ndarray, scatter: float) -> None:
        """A cluster as it is now; without rows it is gone, and the last line takes its place."""
        if label not in self.place or not n:
            self._lines = None
        k = self.place.setdefault(label, len(self.place))
        if n:
            if k == len(self._count):
                room = max(16, k)
                # Narrow means lie by columns, so that sums over a mean run along all clusters; the order of their terms is the same.
                grown = np.zeros((k + room, len(mean)), order="F" if len(mean) < NARROW else "C")
                grown[:k] = self._means if k else 0.0
                self._means = grown
                self._count, self._scatter = (np.concatenate([v, np.zeros(room)]) for v in (self._count, self._scatter))
            self._count[k], self._means[k], self._scatter[k] = n, mean, scatter
            return
        last = len(self.place) - 1
        for v in (self._count, self._means, self._scatter):
            v[k] = v[last]
        self.place[next(c for c, at in self.place.items() if at == last)] = k
        del self.place[label]

    def _with(self, x: np.ndarray, label: int, sign: int, last: bool = False) -> tuple[int, np.ndarray, float]:
        """A cluster with a row more or less. last: whether its last row may go."""
        k = self.place.get(label)
        n, mean, scatter = (0, np.zeros_like(x, float), 0.0) if k is None else (int(self._count[k]), self._means[k], float(self._scatter[k]))
        if sign > 0:
            gap = x - mean
            return n + 1, mean + gap / (n + 1), scatter + n / (n + 1) * float(gap @ gap)
        if n <= 1:
            if not last:
                raise ValueError("the last row of a cluster cannot be removed")
            return 0, mean, 0.0
        before = mean - (x - mean) / (n - 1)
        gap = x - before
        return n - 1, before, scatter - (n - 1) / n * float(gap @ gap)

    def _all(self, x: np.ndarray, sign: int) -> tuple[int, np.ndarray]:
        if sign > 0:
            mean = np.zeros_like(x, float) if self.mean is None else self.mean
            return self.n + 1, mean + (x - mean) / (self.n + 1)
        return self.n - 1, self.mean - (x - self.mean) / (self.n - 1)

    def value(self, n: int, mean: np.ndarray, changed: dict[int, tuple[int, np.ndarray, float]] | None = None) -> float:
        """The index of n rows with a mean, some clusters being changed."""
        size = len(self.place)
        count, means, scatter = self._count[:size], self._means[:size], self._scatter[:size]
        if changed:
            new = [c for c in changed if c not in self.place]
            count, means, scatter = np.append(count, np.zeros(len(new))), np.concatenate([means.reshape(size, len(mean)), np.zeros((len(new), len(mean)))]), np.append(scatter, np.zeros(len(new)))
            for c, part in changed.items():
                k = self.place[c] if c in self.place else size + new.index(c)
                count[k], means[k], scatter[k] = part
        clusters = int(np.count_nonzero(count))
        if clusters < 2:
            return 0.0
        gap = means - mean
        within, between = float(scatter.sum()), float((count * (gap * gap).sum(1)).sum())
        return between / within * (n - clusters) / (clusters - 1) if within > 0 else 0.0

    @property
    def criterion(self) -> float:
        return self.value(self.n, self.mean)

    def added(self, x, label) -> float:
        return self.value(*self._all(x, 1), {label: self._with(x, label, 1)})

    def added_each(self, x: np.ndarray) -> np.ndarray:
        """added() for every cluster, in order of labels, by one look at each."""
        size = len(self.place)
        if size < 2:
            return np.zeros(size)
        count, means, scatter = self._count[:size], self._means[:size], self._scatter[:size]
        n, mean = self._all(x, 1)
        gap = x - means
        far = count * ((means - mean) ** 2).sum(1)
        joined = (count + 1) * ((means + gap / (count + 1)[:, None] - mean) ** 2).sum(1)
        within, between = scatter.sum() + count / (count + 1) * (gap * gap).sum(1), far.sum() - far + joined
        out = np.divide(between, within, out=np.zeros(size), where=within > 0) * (n - size) / (size - 1)
        if self._lines is None:
            self._lines = np.array([k for _, k in sorted(self.place.items())], np.int64)
        return out[self._lines]

    def add(self, x, label) -> None:
        self.put(label, *self._with(x, label, 1))
        self.n, self.mean = self._all(x, 1)

    def remove(self, x, label) -> None:
        self.put(label, *self._with(x, label, -1))
        self.n, self.mean = self._all(x, -1)

    def _moved(self, x, old, new) -> dict[int, tuple[int, np.ndarray, float]]:
        """The two clusters after a move; one that its last row leaves is gone."""
        return {} if old == new else {old: self._with(x, old, -1, last=True), new: self._with(x, new, 1)}

    def moved(self, x, old, new) -> float:
        return self.value(self.n, self.mean, self._moved(x, old, new))

    def move(self, x, old, new) -> None:
        for c, part in self._moved(x, old, new).items():
            self.put(c, *part)


@dataclass
class OnlineValidity(Learner):
    """Fuzzy clustering that accepts a category only if the incremental index grows by it.

    offline: all rows start in cluster 0 and move to their clusters in turn; the rows
    are then held in memory, so use it per key of bounded size.
    """

    kernel: Kernel
    offline: bool = False
    method: str = "MT+"
    epsilon: float = 0.0
    cats: Categories = field(default_factory=Categories)
    index: CalinskiHarabasz = field(default_factory=CalinskiHarabasz)

    settings = ("kernel", "offline", "method", "epsilon")

    def step(self, x):
        index, now = self.index, self.index.criterion
        grows = (lambda c: index.moved(x, 0, c) > now) if self.offline else index.added_each(x) > now
        label = learn(self.kernel, self.cats, x, grows, self.method, self.epsilon)
        if not self.offline:
            index.add(x, label)
        elif label:
            index.move(x, 0, label)
        return (label,)

    def start(self, rows: list[np.ndarray]) -> None:
        for x in rows:
            self.index.add(x, 0)

    def predict(self, x):
        return (nearest(self.kernel, self.cats, x),)

    def export(self):
        yield from _export("a", self.cats)
        index = self.index
        if index.n:
            yield "all", 0, index.mean.tolist(), index.n, None, None
        for j, (n, mean, scatter) in sorted(index.clusters.items()):
            yield "index", j, [scatter, *mean.tolist()], n, None, None

    def load(self, rows):
        self.cats, _ = _load(rows, "a")
        self.index = CalinskiHarabasz()
        for module, j, w, n, _, _ in rows:
            if module == "all":
                self.index.n, self.index.mean = int(n), np.asarray(w, float)
            elif module == "index":
                self.index.put(int(j), int(n), np.asarray(w[1:], float), float(w[0]))
