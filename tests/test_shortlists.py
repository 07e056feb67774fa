"""Search by rough scores against one row at a time: the same labels and weights, and few scores that are computed in full."""

import numpy as np
import pytest

from echoform.operators import search
from echoform.operators.kernels import BinaryFuzzy, Fuzzy, Gaussian, Hypersphere
from echoform.operators.learners import Clusterer, MapClassifier

KERNELS = [Gaussian(0.05, 1e-10, (0.2,)), Hypersphere(0.8, 1e-10, 1.0, 3.0), BinaryFuzzy(0.7, 1e-10), Fuzzy(0.85, 1e-10), Fuzzy(0.85, 0.01, 0.5)]


def vectors(kernel, n=1500, d=24):
    rng = np.random.default_rng(11)
    x = np.clip(rng.normal(0.5, 0.15, (n, d)), 0, 1)
    x[1::10] = x[::10]  # ties
    x = x.round() if isinstance(kernel, BinaryFuzzy) else x
    return np.concatenate([x, 1 - x], 1) if kernel.complement else x, rng.integers(0, 5, n)


@pytest.mark.parametrize("kernel", KERNELS, ids=repr)
def test_many_categories_cost_few_full_scores(kernel, monkeypatch):
    x, y = vectors(kernel)
    monkeypatch.setattr(type(kernel), "many", (64, 64))
    full, pairs = [], type(kernel).score_pairs
    monkeypatch.setattr(type(kernel), "score_pairs", lambda self, w, x: (full.append(len(w)), pairs(self, w, x))[1])
    for learner, columns in [(MapClassifier(kernel, m, e, vigilant=v), [x, y]) for m, e, v in (("MT1", 1e-10, True), ("MT+", 1e-10, False), ("MT+", 0.0, True), ("MT0", 0.0, False))] + [(Clusterer(kernel), [x])]:
        one, many = learner.fresh(), learner.fresh()
        want = np.array([one.step(*row) for row in zip(*columns, strict=True)])
        full.clear()
        got = np.concatenate([many.step_rows([c[a:b] for c in columns]) for a, b in ((0, 700), (700, 701), (701, len(x)))])
        assert got.tolist() == want.tolist()
        assert repr(list(many.export())) == repr(list(one.export()))
        if many.cats.size > 300:
            assert 0 < sum(full) < 0.4 * len(x) * many.cats.size
        assert many.predict_rows(list(columns)).tolist() == [list(one.predict(*row)) for row in zip(*columns, strict=True)]


def test_numbers_without_rough_scores_go_the_plain_way(monkeypatch):
    monkeypatch.setattr(Gaussian, "many", (16, 16))
    far = np.linspace(0, 2, 60)[:, None].repeat(3, 1)  # farther from all others than exp() tells
    own = Clusterer(Gaussian(0.5, 1e-10, (1e-4,)))
    own.step_rows([far])
    assert own.cats.size == 60
    away = far + 0.017
    assert search.nearest_rows(own.kernel, own.cats, away).tolist() == [search.nearest(own.kernel, own.cats, v) for v in away]


def boxes(n=2500, d=64):
    rng = np.random.default_rng(5)
    x = np.clip(rng.normal(0.5, 0.0625, (n, d)), 0, 1)
    x[1::10] = x[::10]  # ties
    x[7] = 0
    x[8] = 1
    return np.concatenate([x, 1 - x], 1), rng.integers(0, 5, n)


def met(monkeypatch):
    """Pairs of a row and a category that are scored, roughly or in full."""
    pairs = []
    for name in ("activate", "score_rows", "score_pairs", "rough"):
        own = getattr(Fuzzy, name)

        def counted(self, a, b, *more, own=own, name=name):
            many = a["share"].shape[0] if name == "rough" else len(a)
            pairs.append(many * (len(b) if name in ("score_rows", "rough") else 1))
            return own(self, a, b, *more)

        monkeypatch.setattr(Fuzzy, name, counted)
    return pairs


@pytest.mark.parametrize("kernel", [Fuzzy(0.8, 0.01), Fuzzy(0.84, 0.01, 0.5), Fuzzy(0.8, 0.0)], ids=repr)
def test_rows_meet_few_of_the_categories_that_vigilance_keeps_small(kernel, monkeypatch):
    x, y = boxes()
    monkeypatch.setattr(search, "COVERED", 64, raising=False)
    for learner, columns in [(Clusterer(kernel), [x])] + [(MapClassifier(kernel, m, e), [x, y]) for m, e in (("MT1", 1e-10), ("MT+", 1e-10), ("MT0", 0.0))]:
        one, many = learner.fresh(), learner.fresh()
        want = [one.step(*row) for row in zip(*columns, strict=True)]
        with monkeypatch.context() as m:
            pairs = met(m)
            got = np.concatenate([many.step_rows([c[a:b] for c in columns]) for a, b in ((0, 700), (700, 701), (701, len(x)))])
        assert got.tolist() == np.array(want).reshape(got.shape).tolist()
        assert repr(list(many.export())) == repr(list(one.export()))
        if isinstance(learner, Clusterer) and kernel.beta == 1:
            assert many.cats.size > 150 and sum(pairs) < 0.35 * len(x) * many.cats.size  # 0.51 if each row met all there are


def test_a_cover_is_left_where_it_leaves_most_categories():
    x, _ = boxes(900)
    own = Clusterer(Fuzzy(0.99, 0.01))
    own.step_rows([x[:600]])
    own.kernel = Fuzzy(0.3, 0.01)
    one = Clusterer(own.kernel)
    one.load(list(own.export()))
    assert own.step_rows([x[600:]])[:, 0].tolist() == [one.step(v)[0] for v in x[600:]]
    assert own.cats.size > search.COVERED and own.cats.cover is None


@pytest.mark.parametrize("method,epsilon", [("MT+", 1e-10), ("MT+", 0.0), ("MT+", 1e-3), ("MT0", 0.0)])
def test_a_climb_looks_at_few_categories_in_full(method, epsilon, monkeypatch):
    x, y = boxes(2000)
    monkeypatch.setattr(Fuzzy, "many", (100, 100))
    monkeypatch.setattr(search, "COVERED", 10**9, raising=False)
    learner = MapClassifier(Fuzzy(0.5, 1e-10), method, epsilon)
    one, many = learner.fresh(), learner.fresh()
    want = [list(one.step(*row)) for row in zip(x, y, strict=True)]
    again = []
    reached = search.Shortlist._reached
    monkeypatch.setattr(search.Shortlist, "_reached", lambda self, *a: (again.append(1), reached(self, *a))[1])
    assert many.step_rows([x, y]).tolist() == want
    assert repr(list(many.export())) == repr(list(one.export()))
    assert many.cats.size > 150 and not again  # one look at a row, however many categories its tile has changed
