"""Tiled search against one row at a time: the same labels and the same weights, bit by bit."""

import numpy as np
import pytest

from echoform.operators import search
from echoform.operators.kernels import ART1, ART2A, Bayesian, BinaryFuzzy, Ellipsoid, Fuzzy, Gaussian, Hypersphere, QuadraticNeuron
from echoform.operators.learners import Clusterer, Deep, DualVigilance, Fusion, MapClassifier, OnlineValidity, Smart, Topology, TwoSided


def rows(kernel, n=700, d=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.random((n // 2, d)), np.repeat(rng.random((n // 10, d)), 5, 0)])  # repeated rows change nothing
    rng.shuffle(x)
    if isinstance(kernel, (ART1, BinaryFuzzy)):
        x = np.concatenate([x, 1 - x], 1).round()
        return np.concatenate([x, 1 - x], 1)
    return np.concatenate([x, 1 - x], 1) if kernel.complement else x


KERNELS = [
    Fuzzy(0.7, 0.01), Fuzzy(0.9, 0.0, 0.4), Fuzzy(0.0, 0.01), BinaryFuzzy(0.6, 0.01), ART1(0.5), ART2A(0.3, 0.1, 0.5), Hypersphere(0.8, 1e-10, 1.0, 1.5), Hypersphere(0.9, 0.0, 1.0, 0.9),
    Ellipsoid(0.6, 0.01, 1.0, 0.8, 1.5), Gaussian(0.3, 1e-10, (0.2,)), Bayesian(5e-4, ((0.01,),)), QuadraticNeuron(0.9, 0.9),
]


def same(learner, columns, monkeypatch, parts=(0, 3, 200, 201, 10_000)):
    one, many = learner.fresh(), learner.fresh()
    want = np.array([one.step(*row) for row in zip(*columns, strict=True)])
    for numbers in (search.TILE_NUMBERS, 50):
        monkeypatch.setattr(search, "TILE_NUMBERS", numbers)  # tiles of one row, too
        many = learner.fresh()
        got = np.concatenate([many.step_rows([c[a:b] for c in columns]) for a, b in zip(parts, parts[1:], strict=False) if a < len(columns[0])])
        assert got.tolist() == want.reshape(got.shape).tolist()
        assert repr(list(many.export())) == repr(list(one.export()))
        assert many.predict_rows(list(columns)).tolist() == [list(one.predict(*row)) for row in zip(*columns, strict=True)]
    return len(set(want.reshape(len(want), -1)[:, 0].tolist()))


@pytest.mark.parametrize("kernel", KERNELS, ids=repr)
def test_clusterers(kernel, monkeypatch):
    assert same(Clusterer(kernel), [rows(kernel)], monkeypatch) >= 1


@pytest.mark.parametrize("method", search.METHODS)
@pytest.mark.parametrize("kernel", [k for k in KERNELS if k.tiled], ids=repr)
def test_classifiers(kernel, method, monkeypatch):
    x = rows(kernel, 300)
    y = np.random.default_rng(2).integers(0, 3, len(x)) % (1 + np.arange(len(x)) // 100)
    same(MapClassifier(kernel, method, 1e-3, vigilant=method == "MT+"), [x, y], monkeypatch)


@pytest.mark.parametrize("learner", [Topology(Fuzzy(0.8, 0.01), 0.5, tau=40, phi=3), Topology(Fuzzy(0.9, 0.01, 0.7), 0.5, tau=300, phi=2), DualVigilance(Fuzzy(0.85, 0.01), 0.6), OnlineValidity(Fuzzy(0.6, 0.01)), Smart(Fuzzy(0.5, 0.01), (0.5, 0.7, 0.9))], ids=repr)
def test_others(learner, monkeypatch):
    same(learner, [rows(Fuzzy(0.5))], monkeypatch)


def test_two_sided_deep_and_fused(monkeypatch):
    x = rows(Fuzzy(0.5))
    y = np.random.default_rng(4).integers(0, 3, len(x))
    same(TwoSided(Fuzzy(0.7, 0.01), Fuzzy(0.8, 0.01)), [x, x[:, [0, 3]]], monkeypatch)
    same(Deep((Fuzzy(0.6), Fuzzy(0.75))), [x, x, y], monkeypatch)
    for method in search.METHODS:
        same(Fusion((Fuzzy(0.7, 0.01), Hypersphere(0.8, 1e-10, 1.0, 1.5)), (0.5, 0.5), method), [x, x[:, :2]], monkeypatch)
    fused = Fusion((Fuzzy(0.7, 0.01), Gaussian(0.3, 1e-10, (0.2,))), (0.5, 0.5))
    same(fused, [x, x[:, :2]], monkeypatch)
    fused.step_rows([x, x[:, :2]])
    assert fused.predict_rows([x, None], skip=(1,))[:, 0].tolist() == [fused.predict(v, None, skip=(1,))[0] for v in x]


def test_nearest_by_blocks_of_categories(monkeypatch):
    kernel, x = Fuzzy(0.99, 0.01), rows(Fuzzy(0.5), 4000)
    own = Clusterer(kernel)
    own.step_rows([x])
    assert own.cats.size > 1100  # two blocks
    assert search.nearest_rows(kernel, own.cats, x).tolist() == [search.nearest(kernel, own.cats, v) for v in x]
