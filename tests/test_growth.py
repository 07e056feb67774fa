"""Folds whose cost must grow with the rows: the same results by fewer looks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoform.operators import search
from echoform.operators.kernels import ART1, Fuzzy
from echoform.operators.learners import CalinskiHarabasz, Clusterer, OnlineValidity
from echoform.operators.train import fold


def test_index_of_each_cluster_by_one_look():
    rng, index = np.random.default_rng(1), CalinskiHarabasz()
    xs, ys = rng.random((80, 3)), rng.integers(0, 7, 80)
    for x, y in zip(xs, ys, strict=True):
        index.add(x, int(y))
    index.move(xs[0], int(ys[0]), 9)
    labels = sorted(index.clusters)
    assert np.allclose(index.added_each(xs[5]), [index.added(xs[5], c) for c in labels], rtol=1e-12, atol=0)


def test_online_validity_asks_no_cluster_by_itself(monkeypatch):
    monkeypatch.setattr(CalinskiHarabasz, "added", None)  # a look at one cluster costs a pass over all
    x = np.random.default_rng(2).random((400, 2))
    own = OnlineValidity(Fuzzy(0.5, 0.01))
    assert len(np.unique(own.step_rows([np.concatenate([x, 1 - x], 1)]))) > 3


@pytest.mark.parametrize("method", search.METHODS)
@pytest.mark.parametrize("epsilon", [0.0, 1e-3])
def test_search_without_an_order_equals_a_walk_in_order(method, epsilon, monkeypatch):
    rng, kernel = np.random.default_rng(3), Fuzzy(0.4)
    strict = search.check_method(method)
    for _ in range(300):
        t, match = rng.random(30).round(1), rng.random(30).round(2)
        t[rng.random(30) < 0.1] = np.nan
        own = rng.random(30) < 0.2
        order, rho, want = search.by_activation(t), kernel.rho, -1
        for j in order[own[order]].tolist() if method == "MT~" else order.tolist():
            if not kernel.resonates(match[j], rho, strict):
                continue
            if own[j]:
                want = j
                break
            rho, go_on = kernel.track(match[j], rho, epsilon, method)
            if not go_on:
                break
        asked = []
        assert search.choose(kernel, t, match, own, method, epsilon) == want
        assert search.choose(kernel, t, match, lambda j: asked.append(j) or bool(own[j]), method, epsilon) == want
        if method in ("MT+", "MT0", "MT1"):  # a search that only rises needs no order of all
            with monkeypatch.context() as m:
                m.setattr(search, "by_activation", None)
                assert search.choose(kernel, t, match, own, method, epsilon) == want


@pytest.mark.parametrize("width", range(1, search.NARROW))
def test_narrow_weights_lie_by_columns_and_add_up_alike(width):
    rng, cats = np.random.default_rng(width), search.Categories()
    lines = rng.random((100, width))
    for w in lines:
        cats.add(w)
    cats.keep(np.arange(100) % 3 > 0)
    for w in lines:
        cats.add(w)
    held = np.concatenate([lines[np.arange(100) % 3 > 0], lines])
    assert cats.w.flags.f_contiguous or cats.w[:, 0].strides == (8,)
    assert (cats.w == held).all() and (cats.w.sum(1) == np.ascontiguousarray(held).sum(1)).all()


@pytest.mark.parametrize("method", search.METHODS)
def test_categories_that_no_row_can_join_are_not_looked_at(method, monkeypatch):
    """Rows with few bits found categories without end; a row must be scored against those only that can pass."""
    x = (np.random.default_rng(4).random((600, 8)) < 0.45).astype(float)
    kernel, cats, looked, plain = ART1(0.5, 2.0), search.Categories(), [], ART1.activate
    want = [search.learn(kernel, cats, v, None, method) for v in x]
    own = Clusterer(kernel, method)
    monkeypatch.setattr(ART1, "activate", lambda self, w, *a: looked.append(len(w)) or plain(self, w, *a))
    got = [own.step(v)[0] for v in x[:300]]
    held = Clusterer(kernel, method)
    held.load(list(own.export()))  # a fit that goes on
    got += [held.step(v)[0] for v in x[300:]]
    assert got == want and (held.cats.w == cats.w).all() and (held.cats.n == cats.n).all()
    assert cats.size > 250 and max(looked) < cats.size / 2


def test_packed_rows_give_the_same_fit_and_the_model_sorts_blocks(spark):
    """Models of many rows, with ties of the order column that only the inputs break."""
    x = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 999 for k in range(2)])
    rows = spark.range(30_000).select((F.col("id") / 3).cast("long").alias("sample_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("g"), x.alias("p"))
    rows = rows.select("sample_id", "g", F.concat("p", F.transform("p", lambda v: 1 - v)).alias("x")).repartition(5)
    plain, packed = (fold(rows, Clusterer(Fuzzy(0.9, 0.01)), "sample_id", ["x"], by=["g"], epochs=2, packed=p) for p in (False, True))
    for a, b in ((plain.labels, packed.labels), (plain.weights, packed.weights)):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == b.count() > 0
    with pytest.raises(ValueError, match="unpacked"):
        fold(rows, Clusterer(Fuzzy(0.9, 0.01)), "sample_id", ["x"], by=["g"], start=plain.weights, packed=True)


def test_means_of_few_numbers_lie_by_columns_and_give_the_same():
    rng, index, other = np.random.default_rng(4), CalinskiHarabasz(), CalinskiHarabasz()
    for x, y in zip(rng.random((300, 4)), rng.integers(0, 40, 300).tolist(), strict=True):
        index.add(x, y)
        other.add(x, y)
        other._means = np.ascontiguousarray(other._means)
    assert index._means.flags.f_contiguous and not index._means.flags.c_contiguous
    x = rng.random(4)
    assert index.added_each(x).tolist() == other.added_each(x).tolist() and index.criterion == other.criterion
    lines = index._lines
    index.add(x, 3)
    assert lines is not None and index._lines is lines  # no order of clusters is told anew for a row of a known one
    index.add(x, 99)
    assert np.allclose(index.added_each(x), [index.added(x, c) for c in sorted(index.clusters)], rtol=1e-12, atol=0)


def test_each_nation_of_online_validity_has_a_task(spark, tmp_path, monkeypatch):
    from echoform.plans import fits
    from echoform.plans.catalogue import QUERIES

    rows = [(i, i % 25, float(i * 37 % 1000)) for i in range(250)] + [(250 + i, None, float(i)) for i in range(3)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    tasks, own = [], fits.fold

    def fold_(data, *a, task=None, **more):
        tasks.append(data.where("c_nationkey IS NOT NULL").select("c_nationkey", task.alias("t")).distinct().collect())
        return own(data, *a, task=task, **more)

    monkeypatch.setattr(fits, "fold", fold_)
    assert QUERIES["online_validity"](spark, str(tmp_path)).count() == 253
    assert len(tasks[0]) == 25 == len({r["t"] for r in tasks[0]})
