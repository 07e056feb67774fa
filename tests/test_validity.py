"""Indices kept up to date against indices of all rows, and biclusters against pairs of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoform.functions import prep
from echoform.operators import compound
from echoform.operators.kernels import Fuzzy
from echoform.operators.search import Categories, learn
from echoform.operators.validity import INDICES


def frame(spark, xs):
    return spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(xs)], "sample_id long, x array<double>").repartition(3)


@pytest.mark.parametrize("index", ["ch", "db", "silhouette"])
def test_kept_index_equals_the_whole(index):
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.random((40, 3)), rng.random((5, 3)).repeat(3, 0)])
    kept, labels = INDICES[index](data), np.zeros(len(data), np.int64)
    for _ in range(300):
        i, c = int(rng.integers(len(data))), int(rng.integers(6))
        new = labels.copy()
        new[i] = c
        assert np.isclose(kept.moved(i, c), compound.validity(data, new, index), rtol=1e-7, atol=1e-9)
        if rng.random() < 0.6:
            kept.move(i, c)
            labels = new
        assert np.isclose(kept.value, compound.validity(data, labels, index), rtol=1e-7, atol=1e-9) and (kept.labels == labels).all()


@pytest.mark.parametrize("index", ["ch", "db", "silhouette"])
def test_guided_fit_equals_a_loop_over_whole_indices(spark, index):
    xs = np.random.default_rng(11).random((60, 2))
    xs = np.concatenate([xs, 1 - xs], 1)
    labels, cats, kernel = np.zeros(len(xs), np.int64), Categories(), Fuzzy(0.4, 0.01)
    for i, x in enumerate(xs):

        def better(c, i=i):
            new = labels.copy()
            new[i] = c
            a, b = compound.validity(xs, labels, index), compound.validity(xs, new, index)
            return cats.size < 2 or (b < a if index == "db" else b > a)

        labels[i] = learn(kernel, cats, x, better)
    got = {r["sample_id"]: r["cluster_id"] for r in compound.validity_guided(frame(spark, xs), kernel, index).collect()}
    assert [got[i] for i in range(len(xs))] == labels.tolist() and len(set(got.values())) > 2


@pytest.mark.parametrize("paper", [False, True])
def test_biclusters_equal_a_loop_over_pairs(spark, paper):
    m = np.random.default_rng(12).random((12, 12)).round(3)
    m[4] = 0.5  # a constant row correlates with nothing
    rows, columns = (frame(spark, v).withColumn("raw", F.col("x")).withColumn("x", prep.complement_code(F.col("x"))) for v in (m, m.T))
    kernel, eta = Fuzzy(0.55, 0.01), 0.1
    by_row, by_column, masks = compound.bicluster(rows, columns, kernel, kernel, eta, paper=paper)
    code = lambda v: np.concatenate([v, 1 - v])
    cb, ca, cats_b, cats_a = [], [], Categories(), Categories()
    for v in m.T:
        cb.append(learn(kernel, cats_b, code(v)))
    for v in m:
        good = False
        for c in set(cb):
            cols = [i for i, b in enumerate(cb) if b == c]
            with np.errstate(invalid="ignore"):
                r = [np.corrcoef(v[cols], m[k][cols])[0, 1] for k in (range(12) if paper else cols) if np.ptp(m[k][cols]) > 0 and np.ptp(v[cols]) > 0]
            good = good or bool(r) and np.mean(r) >= eta
        ca.append(learn(kernel, cats_a, code(v), lambda _, good=good: good))
    got = {r["sample_id"]: r["labels"][0] for r in by_row.labels.collect()}
    assert [got[i] for i in range(12)] == ca
    assert masks.count() == cats_a.size * cats_b.size and len(set(cb)) > 1
