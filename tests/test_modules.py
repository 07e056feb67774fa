"""Fitted preparation, predicates and hooks, nested modules, prune logs: small cases, continued fits, refused rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoform.functions.preparation import Preparation, PreparationModel, falcon_channels
from echoform.operators import compound
from echoform.operators.kernels import Fuzzy, Hypersphere
from echoform.operators.learners import Clusterer, DualVigilance, Fusion, Guarded, MapClassifier, Mapped, Topology
from echoform.operators.train import apply, first_label, fold


def frame(spark, xs, **more):
    rows = [(i, list(map(float, x)), *[v[i] for v in more.values()]) for i, x in enumerate(xs)]
    kinds = {int: "long", list: "array<double>"}
    return spark.createDataFrame(rows, "sample_id long, x array<double>" + "".join(f", {k} {kinds[type(v[0])]}" for k, v in more.items())).repartition(3)


def coded(n, d=2, seed=0):
    x = np.random.default_rng(seed).random((n, d))
    return np.concatenate([x, 1 - x], 1)


# Preparation


def test_preparation_is_kept_and_restored(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.0, 10.0, 5), (1, 5.0, 20.0, 5), (2, 3.0, 12.0, 5)], "k long, a double, b double, c int")
    model = Preparation.of({"one": ["a"], "two": ["b", "c"]}).fit(rows)
    assert model.widths == {"one": 2, "two": 4} and model.column_bounds() == {"a": (1.0, 5.0), "b": (10.0, 20.0), "c": (5.0, 5.0)}
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PreparationModel.load(str(tmp_path / "m"))
    got = {r["k"]: r for r in again.transform(rows).withColumn("joined", again.joined(skip=["one"])).collect()}
    assert got[2]["one"] == [0.5, 0.5] and got[2]["two"] == [0.2, 0.0, 0.8, 1.0]  # a constant column is 0
    assert got[1]["joined"] == [0.5, 0.5, 1.0, 0.0, 0.0, 1.0]
    back = again.restore(again.restore(again.transform(rows), "one"), "two").orderBy("k").collect()
    assert [(r["a"], r["b"], r["c"]) for r in back] == [(1.0, 10.0, 5.0), (5.0, 20.0, 5.0), (3.0, 12.0, 5.0)]
    assert again.restore(spark.createDataFrame([([0.0, 0.5],)], "one array<double>"), "one").first()["a"] == 2.0  # the middle of a box
    assert falcon_channels(["a"], ["b"], ["c"]).fit(rows).widths == {"state": 2, "action": 2, "reward": 2}


def test_rows_out_of_frozen_bounds(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 5.0)], "k long, a double")
    other = spark.createDataFrame([(2, 7.0), (3, None), (4, float("nan"))], "k long, a double")
    model = Preparation.of({"x": ["a"]}, complement=False).fit(rows)
    with pytest.raises(Exception, match="channel x: a is not within 1.0 to 5.0: 7.0"):
        model.transform(other.where("k = 2")).collect()
    assert model.clipping().transform(other.where("k = 2")).first()["x"] == [1.0]
    for k in (3, 4):  # clipping does not make up for holes
        with pytest.raises(Exception, match="channel x"):
            model.clipping().transform(other.where(f"k = {k}")).collect()
    assert [r["refused"] for r in model.refused(rows.unionByName(other)).orderBy("k").collect()] == [[], [], ["x"], ["x"], ["x"]]
    wider = model.widened(other.where("k = 2"))
    assert wider.column_bounds()["a"] == (1.0, 7.0) and model.column_bounds()["a"] == (1.0, 5.0)
    with pytest.raises(ValueError):
        Preparation.of({"x": ["a"]}).fit(rows.limit(0))


@pytest.mark.parametrize("x, what", [([7.0, -3.0, -6.0, 4.0], "lie in"), ([0.5, 0.5, 0.9, 0.9], "complement"), ([0.5, 0.5], "2 numbers, not 4"), ([0.5, 0.5, 0.5], "3 numbers, not 4")])
def test_fit_and_predict_refuse_rows_that_break_the_rules(spark, x, what):
    good = [v.tolist() for v in coded(20)]
    fitted = fold(frame(spark, good), Clusterer(Fuzzy(0.7, 0.01)), "sample_id", ["x"])
    with pytest.raises(Exception, match=f"row 20 of model .*{what}"):
        fold(frame(spark, [*good, x]), Clusterer(Fuzzy(0.7, 0.01)), "sample_id", ["x"])
    with pytest.raises(Exception, match="row 20 of model" if what != "lie in" else what):
        apply(frame(spark, [*good, x]), fitted, ["x"]).collect()
    unchecked = fold(frame(spark, [v[:2] for v in good]), Clusterer(Hypersphere(0.7, 1e-10, 1.0, 2.0)), "sample_id", ["x"], check=False)
    assert unchecked.labels.count() == 20


# Predicates and hooks


def plain_guard(xs, kernel, most):
    """Categories of at most `most` rows, by a loop: a full category that passes raises the bar to its match."""
    ws, ns, out = [], [], []
    for x in xs:
        t = [np.minimum(w, x).sum() / (kernel.alpha + w.sum()) for w in ws]
        rho, taken = kernel.rho, -1
        for j in sorted(range(len(ws)), key=lambda j: (-t[j], j)):
            m = np.minimum(ws[j], x).sum() / (len(x) / 2)
            if m >= rho:
                if ns[j] < most:
                    taken = j
                    break
                rho = m
        if taken < 0:
            ws.append(x)
            ns.append(1)
            taken = len(ws) - 1
        else:
            ws[taken] = np.minimum(ws[taken], x)
            ns[taken] += 1
        out.append(taken)
    return out


def test_predicate_and_hooks_in_a_fit(spark):
    xs, kernel = coded(120), Fuzzy(0.6, 0.01)
    full = lambda row, j, own, memory: own.cats.n[j] < 5

    def before(row, own, memory):
        memory["seen"] = memory.get("seen", 0) + 1

    def after(row, labels, own, memory):
        memory["last"] = [float(labels[0]), float(row[0][0])]

    fitted = fold(frame(spark, xs), Clusterer(kernel), "sample_id", ["x"], allowed=full, hooks=(before, after))
    got = [r[0] for r in fitted.labels.orderBy("sample_id").select(first_label()).collect()]
    assert got == plain_guard(xs, kernel, 5) and max(np.bincount(got)) == 5
    memory = {r["module"]: r["w"] for r in fitted.weights.where("module like 'memory:%'").collect()}
    assert memory["memory:seen"] == [120.0] and memory["memory:last"] == [float(got[-1]), xs[-1][0]]
    # Going on from the saved state gives what one fit gives, memory and all.
    first = fold(frame(spark, xs).where("sample_id < 50"), Clusterer(kernel), "sample_id", ["x"], allowed=full, hooks=(before, after))
    second = fold(frame(spark, xs).where("sample_id >= 50"), Clusterer(kernel), "sample_id", ["x"], start=first.weights, allowed=full, hooks=(before, after))
    assert sorted(map(str, second.weights.collect())) == sorted(map(str, fitted.weights.collect()))
    assert apply(frame(spark, xs), fitted, ["x"]).count() == 120


# Modules


MODULES = [
    Mapped(Clusterer(Fuzzy(0.6, 0.01))), Mapped(DualVigilance(Fuzzy(0.85, 0.01), 0.6)), Mapped(Topology(Fuzzy(0.6, 0.01), 0.5, tau=30, phi=3)), Mapped(Fusion((Fuzzy(0.6, 0.01), Fuzzy(0.5, 0.01)), (0.5, 0.5))),
    Mapped(Guarded(Topology(Fuzzy(0.7, 0.01), 0.5, tau=30, phi=2), lambda row, j, own, memory: own.cats.n[j] < 40)), Guarded(Mapped(Clusterer(Fuzzy(0.6, 0.01))), None, None, lambda row, labels, own, memory: memory.update(n=memory.get("n", 0) + 1)),
]


@pytest.mark.parametrize("learner", MODULES, ids=["clusterer", "dual", "topology", "fusion", "guarded", "outside"])
def test_any_model_as_a_module_goes_on(spark, learner):
    xs = coded(150, seed=3)
    ys = [int(4 * x[0]) % 2 for x in xs]
    rows = frame(spark, xs, y=ys, z=[x[[1, 3]].tolist() for x in xs])
    inputs = ["x", "z", "y"] if learner.inputs[:2] == ("x0", "x1") else ["x", "y"]
    whole = fold(rows, learner, "sample_id", inputs)
    start = None
    for a, b in ((0, 40), (40, 95), (95, 150)):
        part = fold(rows.where(f"sample_id >= {a} and sample_id < {b}"), learner, "sample_id", inputs, start=start)
        start = part.weights
    assert sorted(map(str, start.collect())) == sorted(map(str, whole.weights.collect()))
    got = {r["sample_id"]: r["labels"] for r in apply(rows, whole, inputs[:-1]).collect()}
    right = sum(got[i][1] == y for i, y in enumerate(ys))
    assert right > 100, right


def test_mapped_clusterer_is_the_map_classifier(spark):
    xs = coded(200, seed=4)
    ys = [int(v) for v in np.random.default_rng(5).integers(0, 3, 200)]
    rows = frame(spark, xs, y=ys)
    a = fold(rows, MapClassifier(Fuzzy(0.6, 1e-10), epsilon=1e-10), "sample_id", ["x", "y"])
    b = fold(rows, Mapped(Clusterer(Fuzzy(0.6, 1e-10), epsilon=1e-10)), "sample_id", ["x", "y"])
    assert sorted(map(tuple, a.labels.select("sample_id", F.col("labels")).rdd.map(lambda r: (r[0], *r[1])).collect())) == sorted(map(tuple, b.labels.select("sample_id", F.col("labels")).rdd.map(lambda r: (r[0], *r[1])).collect()))


# Prunes


def test_relabelled_topology(spark):
    xs = coded(230, seed=6)
    learner = Topology(Fuzzy(0.8, 0.01), 0.5, tau=50, phi=4)
    rows = frame(spark, xs)
    fitted = fold(rows, learner, "sample_id", ["x"])
    plain, names, gone = learner.fresh(), {}, 0
    for i, x in enumerate(xs):
        names[i] = plain.step(x)[0]
        if plain.seen % 50 == 0:
            names = {k: plain.log[-1].get(v, -1) if v >= 0 else -1 for k, v in names.items()}
    for i, v in names.items():
        if v < 0:
            gone += 1
            names[i] = plain.predict(xs[i])[0]
    assert {r['n'] for r in fitted.table.where("kind = 'row'").collect()} == set(range(5))
    got = dict(tuple(r) for r in compound.relabel(rows, fitted).select("sample_id", "cluster_id").collect())
    assert got == names and gone > 5 and plain.prunes == 4
    left = {r["cluster_id"] for r in fitted.weights.where("module = 'a'").collect()}
    assert set(got.values()) <= left


def test_temporal_differences_use_the_next_value(spark):
    rows = [(i, i // 10, i % 10, [float(i % 10) / 10, 1 - float(i % 10) / 10], [1.0, 0.0], 1.0 if i % 10 == 8 else 0.0) for i in range(60)]
    steps = spark.createDataFrame(rows, "sample_id long, episode_id long, t long, state array<double>, action array<double>, reward double")
    agent = compound.Falcon((Fuzzy(0.9, 0.01), Fuzzy(0.9, 0.01), Fuzzy(0.0, 0.01)), td_alpha=0.5, td_lambda=0.9)
    agent.td(steps)
    first = {r["sample_id"]: r["reward"] for r in agent.rewards(steps).collect()}
    agent.td(steps, rounds=3)
    later = {r["sample_id"]: r["reward"] for r in agent.rewards(steps).collect()}
    assert first[7] <= later[7] and later[7] > 0.02  # the reward of step 8 reaches step 7 through the next value
    best = agent.best_action(steps, spark.createDataFrame([(0, [1.0, 0.0])], "action_id long, action array<double>")).collect()
    assert len(best) == 60 and {r["action_id"] for r in best} == {0}
    pairs = {r["sample_id"]: r["reward"] for r in agent.action_rewards(steps.drop("action"), spark.createDataFrame([(0, [1.0, 0.0])], "action_id long, action array<double>")).collect()}
    assert pairs == {r["sample_id"]: r["reward"] for r in best}


# History


@pytest.mark.parametrize("learner", [Clusterer(Fuzzy(0.8, 0.01)), Fusion((Fuzzy(0.8, 0.01), Fuzzy(0.7, 0.01)), (0.5, 0.5)), Mapped(Clusterer(Fuzzy(0.7, 0.01)))], ids=["clusterer", "fusion", "mapped"])
def test_history_gives_the_model_after_any_step(spark, learner):
    xs = coded(90, seed=8)
    rows = frame(spark, xs, y=[i % 3 for i in range(90)], z=[x[[1, 3]].tolist() for x in xs])
    inputs = {"x": ["x"], "x0": ["x", "z"]}[learner.inputs[0]] + (["y"] if "y" in learner.inputs else [])
    whole = fold(rows, learner, "sample_id", inputs, history=True)
    cut = lambda df: sorted((r["module"], r["cluster_id"], tuple(r["w"]), r["n"]) for r in df.collect() if r["w"])
    for step in (1, 30, 71, 90):
        assert cut(whole.at(step)) == cut(fold(rows.where(f"sample_id < {step}"), learner, "sample_id", inputs).weights), step
    assert whole.at(0).count() == 0 and sorted(r["labels"] for r in whole.labels.collect()) == sorted(r["labels"] for r in fold(rows, learner, "sample_id", inputs).labels.collect())


def test_no_history_of_a_topology(spark):
    with pytest.raises(Exception, match="renumbers"):
        fold(frame(spark, coded(20)), Topology(Fuzzy(0.8, 0.01), 0.5, tau=10, phi=2), "sample_id", ["x"], history=True)


# Settings by path


def test_settings_by_path():
    from echoform.operators.learners import Deep, Smart, TwoSided

    nested = Guarded(Mapped(Topology(Fuzzy(0.6, 0.01), 0.5, tau=30, phi=3)), allowed=len)
    changed = nested.with_params(module__module__kernel__rho=0.7, module__module__tau=40)
    assert changed.module.module.kernel == Fuzzy(0.7, 0.01) and changed.module.module.tau == 40 and changed.allowed is len and nested.module.module.tau == 30
    assert nested.params()["module__module__kernel__beta"] == 1.0
    fused = Fusion((Fuzzy(0.6), Hypersphere(0.5)), (0.5, 0.5)).with_params(kernels__1__r_hat=2.0, method="MT0", kernels__0__rho=0.1)
    assert fused.kernels == (Fuzzy(0.1), Hypersphere(0.5, r_hat=2.0)) and fused.method == "MT0"
    assert TwoSided(Fuzzy(0.5), Fuzzy(0.6)).with_params(kernel_b__rho=0.9).b.kernel.rho == 0.9
    assert Deep((Fuzzy(0.5), Fuzzy(0.6))).with_params(kernels__0__rho=0.2).layers[0].kernel.rho == 0.2
    assert [k.rho for k in Smart(Fuzzy(), (0.1, 0.5)).with_params(rhos=(0.2, 0.6, 0.7)).kernels] == [0.2, 0.6, 0.7]
    assert Clusterer(Fuzzy()).with_params(kernel=Hypersphere(0.3), kernel__rho=0.4).kernel == Hypersphere(0.4)
    for bad in ({"kernel__nothing": 1}, {"kernel__rho": 2.0}, {"module__kernel__rho": 0.5}):
        with pytest.raises(ValueError):
            Clusterer(Fuzzy()).with_params(**bad)


def test_cross_validation_equals_single_fits(spark):
    xs = coded(60, seed=9)
    ys = [int(3 * x[0]) for x in xs]
    rows = frame(spark, xs, y=ys)
    got = {(r["params"], r["fold"]): (r["n"], r["right"]) for r in compound.cross_validate(rows, Mapped(Clusterer(Fuzzy(0.5, 0.01))), {"module__kernel__rho": [0.3, 0.8], "module__method": ["MT+", "MT~"]}, folds=2).collect()}
    assert len(got) == 8
    for rho in (0.3, 0.8):
        for method in ("MT+", "MT~"):
            for k in range(2):
                own = Mapped(Clusterer(Fuzzy(rho, 0.01), method))
                for i in range(60):
                    if i % 2 != k:
                        own.step(xs[i], ys[i])
                right = sum(own.predict(xs[i])[1] == ys[i] for i in range(60) if i % 2 == k)
                assert got[str({"module__kernel__rho": rho, "module__method": method}), k] == (30, right)
