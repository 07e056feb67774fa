"""What large tables rely on: how often models are built and copied, and quadratic steps that are gone."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from echoform.functions import kernels as native
from echoform.operators import compound, metrics, train
from echoform.operators.kernels import Fuzzy
from echoform.operators.learners import Clusterer, Topology
from echoform.operators.merging import merge_close, merge_objects
from echoform.operators.train import Fitted, apply, fold
from echoform.plans.native import native_fit

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def coded(spark, xs, **columns):
    xs = np.asarray(xs, float)
    rows = [(i, [*map(float, x), *map(float, 1 - x)], *(int(c[i]) for c in columns.values())) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, ["sample_id", "x", *columns])


class Counting:
    """A fitted clusterer that counts how often it is built from its weights."""

    outputs, input_kernels = 1, (None,)

    def __init__(self, inner, loads):
        self.inner, self.loads = inner, loads

    def fresh(self):
        return Counting(self.inner.fresh(), self.loads)

    def load(self, rows):
        self.loads.add(1)
        self.inner.load(rows)

    def predict_rows(self, columns):
        return self.inner.predict_rows(columns)


@pytest.mark.parametrize(("hot", "most"), [(1_000, 1), (10, 4)])
def test_weights_are_copied_by_the_rows_of_a_model(spark, monkeypatch, hot, most):
    xs = np.random.default_rng(1).random((40, 2))
    rows = coded(spark, xs)
    fitted = fold(rows, Clusterer(Fuzzy(0.8, 0.01)), "sample_id", ["x"])
    want = sorted((r["sample_id"], r["labels"][0]) for r in apply(rows, fitted, ["x"]).collect())
    monkeypatch.setattr(train, "BROADCAST_DOUBLES", 1)
    monkeypatch.setattr(train, "HOT_ROWS", hot, raising=False)
    loads = spark.sparkContext.accumulator(0)
    got = apply(rows, Fitted(Counting(fitted.learner, loads), fitted.table), ["x"]).collect()
    assert sorted((r["sample_id"], r["labels"][0]) for r in got) == want
    assert 1 <= loads.value <= most


@pytest.mark.parametrize("pairs", [10**9, 100])
def test_long_models_share_no_task(spark, monkeypatch, pairs):
    xs = np.random.default_rng(6).random((320, 2))
    rows = coded(spark, xs, k=np.arange(320) % 8)
    plain = fold(rows, Clusterer(Fuzzy(0.8, 0.01)), "sample_id", ["x"], by=["k"])
    fitted = fold(rows, Clusterer(Fuzzy(0.8, 0.01)), "sample_id", ["x"], by=["k"], task=F.col("k"), tasks=8)
    result = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert result(fitted.labels) == result(plain.labels) and result(fitted.weights) == result(plain.weights)
    files = fitted.table.groupBy(F.input_file_name()).agg(F.count_distinct("model").alias("n"), F.count("*").alias("rows"))
    assert [r["n"] for r in files.where("rows > 0").collect()] == [1] * 8
    want = result(apply(rows, fitted, ["x"], by=["k"]))
    monkeypatch.setattr(train, "BROADCAST_DOUBLES", 1)
    monkeypatch.setattr(train, "HOT_PAIRS", pairs, raising=False)
    got = apply(rows, fitted, ["x"], by=["k"])
    assert result(got) == want
    if pairs == 100:  # a model's rows are dealt to several tasks
        met = got.groupBy(F.spark_partition_id()).agg(F.count_distinct("model").alias("n"))
        assert met.count() > 8 and met.where("n > 1").count() == 0


def test_many_models_are_built_once_each(spark):
    xs = np.random.default_rng(2).random((900, 2))
    rows = coded(spark, xs, k=np.arange(900) % 300).repartition(4)
    fitted = fold(rows, Clusterer(Fuzzy(0.8, 0.01)), "sample_id", ["x"], by=["k"])
    loads = spark.sparkContext.accumulator(0)
    got = apply(rows, Fitted(Counting(fitted.learner, loads), fitted.table), ["x"], by=["k"]).collect()
    assert len(got) == 900 and loads.value == 300


def test_relabel_of_a_carried_fit_joins_nothing(spark):
    xs = np.random.default_rng(3).random((300, 2))
    rows = coded(spark, xs, k=np.arange(300) % 3)
    learner = Topology(Fuzzy(0.8, 0.01, 1.0), 0.5, tau=20, phi=3)
    plain, carried = (fold(rows, learner, "sample_id", ["x"], by=["k"], carry=c) for c in (False, True))
    result = lambda df: sorted(tuple(r) for r in df.select("model", "sample_id", "cluster_id").collect())
    alone = compound.relabel(rows, carried, by=["k"])
    assert result(alone) == result(compound.relabel(rows, plain, by=["k"]))
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_close_values_merge_as_pairs_do(spark):
    rng = np.random.default_rng(4)
    values = [*np.round(rng.random(60) * 40, 2).tolist(), *np.arange(-50, -20, 1.0).tolist(), 1e300, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.permutation(np.array(values, object)).tolist())], "k long, v double")
    want = {r["k"]: r["component"] for r in merge_objects(rows.where("v < 1e9 or v is null"), "k", "v", lambda a, b: F.abs(a - b) <= 1).collect()}
    plan = merge_close(rows, "k", "v", 1.0)
    got = {r["k"]: r["component"] for r in plan.collect()}
    assert {k: c for k, c in got.items() if k in want} == want and all(c == k for k, c in got.items() if k not in want)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString() and len(got) == len(values)


def test_chains_of_any_length_merge(spark):
    rows = spark.createDataFrame([(k, float(v)) for v, k in enumerate([*range(0, 40, 2), *range(39, 0, -2)])], "k long, v double")
    got = {tuple(r)[1] for r in merge_objects(rows, "k", "v", lambda a, b: F.abs(a - b) <= 1).collect()}
    assert got == {0}


def test_correlation_of_long_groups(spark):
    xs = np.random.default_rng(5).random((3_000, 2))
    rows = spark.createDataFrame([(float(a), float(a + b)) for a, b in xs], "a double, b double")
    want = np.corrcoef(xs[:, 0], xs.sum(1))[0, 1]
    assert rows.agg(metrics.correlation("a", "b")).first()[0] == pytest.approx(want)
    lists = rows.agg(F.collect_list(F.struct("a", "b")).alias("v")).select(metrics.pearson(F.transform("v", lambda s: s["a"]), F.transform("v", lambda s: s["b"])))
    assert lists.first()[0] == pytest.approx(want)
    assert rows.withColumn("b", F.lit(1.0)).agg(metrics.correlation("a", "b")).first()[0] is None


def test_orders_and_distances_without_pairs(spark):
    xs = np.random.default_rng(6).integers(0, 6, (150, 2))  # many ties
    rows = spark.createDataFrame([(i, i % 3, float(a), float(b), [float(a), float(b)]) for i, (a, b) in enumerate(xs.tolist())], "sample_id long, g long, u double, v double, x array<double>")
    ordered = lambda df: sorted(tuple(r) for r in df.collect())
    assert ordered(metrics.vat_rows(rows, by=["g"])) == ordered(metrics.vat_order(metrics.pairwise(rows, by=["g"])))
    few = rows.where("sample_id < 40")
    assert ordered(metrics.pairwise_columns(few, ["u", "v"])) == ordered(metrics.pairwise(few))
    want = few.select(F.round(F.lit(None).cast("double"), 2)).first()[0]
    odd = spark.createDataFrame([(v,) for v in (0.125, 2.675, 1e12, float("nan"), float("inf"), None)], "d double")
    got = [tuple(r) for r in odd.select(metrics.rounded(F.col("d"), 2), F.round("d", 2)).collect()]
    assert want is None and all(a == b or (a != a and b != b) for a, b in got[:1] + got[2:])


def test_silhouette_meets_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    xs, ys = rng.random((120, 2)), rng.integers(0, 3, 120)
    rows = coded(spark, xs, cluster=ys)
    want = compound.validity(np.concatenate([xs, 1 - xs], 1), ys, "silhouette")
    monkeypatch.setattr(metrics, "BLOCK_ROWS", 3)
    assert metrics.silhouette(rows).first()[0] == pytest.approx(want, rel=1e-9)
    alone = rows.withColumn("cluster", F.when(F.col("sample_id") < 60, F.col("cluster")))  # the others count 0
    want = compound.validity(np.concatenate([xs, 1 - xs], 1)[:60], ys[:60], "silhouette") / 2
    assert metrics.silhouette(alone).first()[0] == pytest.approx(want, rel=1e-9)


def test_native_fit_takes_any_number_of_rows(spark):
    xs = np.random.default_rng(8).random((5_200, 2))
    rows = coded(spark, xs)
    got = [r[1] for r in sorted(native_fit(rows, native.fuzzy(2, 0.01), 0.6).collect())]
    want = {r["sample_id"]: r["labels"][0] for r in fold(rows, Clusterer(Fuzzy(0.6, 0.01)), "sample_id", ["x"]).labels.collect()}
    assert got == [want[i] for i in range(5_200)]


@pytest.mark.parametrize("name", ["simple_artmap", "simple_artmap_mt_minus", "fuzzy_artmap", "binary_fuzzy_artmap"])
def test_maps_learn_all_vectors_in_one_model(spark, tmp_path, name):
    from echoform.plans.catalogue import QUERIES

    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.uniform(-1, 1, 64)], int(rng.integers(0, 3))) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r["model"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {""}


@pytest.mark.parametrize(("kernel", "width", "most"), [(native.ellipsoid(3, 0.01, 0.5, 0.8, 2.0), 7, 12_000), (native.quadratic(3, 0.5, 0.1, 0.2, 0.3), 13, 12_000)])
def test_native_updates_compute_their_steps_once(spark, kernel, width, most):
    rows = spark.createDataFrame([([0.1] * 3, [0.2] * width)], "x array<double>, w array<double>")
    plan = rows.select(kernel.update(F.col("x"), F.col("w")))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < most


def test_alignments_are_remembered():
    from echoform.operators.sequences import needleman_wunsch

    first = needleman_wunsch("small brass ring", "brass rod")
    hits = needleman_wunsch.cache_info().hits
    assert needleman_wunsch("small brass ring", "brass rod") == first and needleman_wunsch.cache_info().hits == hits + 1
