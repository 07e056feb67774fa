"""Search of points apart from boxes against one row at a time: the same labels and weights, and few pairs that are scored."""

import numpy as np
import pytest

from echoform.operators import search
from echoform.operators.kernels import BinaryFuzzy, Fuzzy
from echoform.operators.learners import Clusterer, MapClassifier

METHODS = [("MT+", 1e-10), ("MT+", 0.0), ("MT+", 1e-3), ("MT-", 1e-10), ("MT-", 1e-3), ("MT0", 0.0), ("MT1", 1e-10)]


def vectors(kernel, n=1600, d=64):
    rng = np.random.default_rng(7)
    x = np.clip(rng.normal(0.5, 0.0625, (n, d)), 0, 1)
    x[1::10] = x[::10]  # ties
    x[5::40] = np.nextafter(x[::40], 1)
    x[7], x[8] = 0, 1
    x = (x > 0.5).astype(float) if isinstance(kernel, BinaryFuzzy) else x
    return np.concatenate([x, 1 - x], 1), rng.integers(0, 5, n)


def same(learner, columns, ends=(0, 500, 501)):
    one, many = learner.fresh(), learner.fresh()
    want = [list(one.step(*row)) for row in zip(*columns, strict=True)]
    cuts = [*ends, len(columns[0])]
    assert np.concatenate([many.step_rows([c[a:b] for c in columns]) for a, b in zip(cuts, cuts[1:])]).tolist() == want
    assert repr(list(many.export())) == repr(list(one.export()))
    return one, many


@pytest.fixture
def soon(monkeypatch):
    """Points are told apart from a few categories on."""
    monkeypatch.setattr(search, "POINTED", 40, raising=False)
    monkeypatch.setattr(search, "COVERED", 10**9)
    monkeypatch.setattr(BinaryFuzzy, "alone", 0, raising=False)
    monkeypatch.setattr("echoform.operators.points.MANY", 20, raising=False)


@pytest.mark.parametrize("kernel", [Fuzzy(0.7, 1e-10), Fuzzy(0.5, 0.01, 0.5), Fuzzy(0.0, 0.0), BinaryFuzzy(0.55, 1e-10)], ids=repr)
@pytest.mark.parametrize("method,epsilon", METHODS)
def test_points_apart_give_what_one_row_at_a_time_gives(kernel, method, epsilon, soon):
    x, y = vectors(kernel)
    learner = MapClassifier(kernel, method, epsilon)
    one, many = same(learner, [x, y])
    for vigilant in (False, True):
        one.vigilant = many.vigilant = vigilant
        seen = vectors(kernel, 1700)[0][1500:]
        assert many.predict_rows([seen, np.zeros(len(seen))]).tolist() == [list(one.predict(v)) for v in seen]


@pytest.mark.parametrize("kernel", [Fuzzy(0.93, 1e-10), Fuzzy(0.9, 0.01, 0.5), BinaryFuzzy(0.7, 1e-10)], ids=repr)
def test_points_apart_without_classes(kernel, soon):
    same(Clusterer(kernel), [vectors(kernel)[0]])


@pytest.mark.parametrize("method", ["MT+", "MT-"])
def test_rows_are_scored_with_few_of_the_categories(method, soon, monkeypatch):
    x, y = vectors(Fuzzy(0.7), 4000)[0], np.random.default_rng(8).integers(0, 20, 4000)
    pairs = []
    for name in ("activate", "score_rows", "score_pairs", "rough"):

        def counted(self, a, b, *more, own=getattr(Fuzzy, name), name=name):
            many = a["share"].shape[0] if name == "rough" else len(a)
            pairs.append(many * (len(b) if name in ("score_rows", "rough") else 1))
            return own(self, a, b, *more)

        monkeypatch.setattr(Fuzzy, name, counted)
    many = MapClassifier(Fuzzy(0.7, 1e-10), method)
    many.step_rows([x, y])
    # Rows that met all categories that there are would be half of rows times categories.
    assert many.cats.size > 300 and sum(pairs) < 0.3 * len(x) * many.cats.size


def test_points_know_which_are_near():
    from echoform.operators.points import Points

    rng, kernel = np.random.default_rng(3), Fuzzy(0.7, 1e-10)
    x = vectors(kernel, 900)[0][9:]
    points = Points(kernel, search.Categories.of(list(x)))
    points.read()
    (scale, off), own = kernel.place_unit(128), kernel.places(x).T
    for r in rng.integers(0, len(x), 20).tolist():
        v = np.clip(x[r, :64] + rng.normal(0, 0.002, 64), 0, 1)
        place = kernel.places(np.concatenate([v, 1 - v])[None])[:, 0]
        far = np.abs(x[:, :64] - v).sum(1)
        near = points.nearest(place, 2 * off)
        assert int(far.argmin()) in near.tolist() and len(near) < 200
        assert points.within(place, int(far.min() * scale + off + 1)) and not points.within(place, int(far.min() * scale - off - 1))
    points.drop(0)
    assert 0 not in points.nearest(own[0], 0).tolist()
