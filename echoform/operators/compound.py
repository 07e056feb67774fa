"""Whole models over DataFrames: regression, fused channels, reinforcement learning, biclustering, validity-guided fits, sweeps."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoform.functions.prep import complement_code
from echoform.functions.vectors import bind
from echoform.operators.kernels import Kernel
from echoform.operators.learners import Bicluster, Clusterer, Fusion, Learner, MapClassifier, OnlineValidity, Topology, TwoSided
from echoform.operators.search import Categories, learn
from echoform.operators.train import Fitted, apply, first_label, fold, model_key
from echoform.operators.validity import INDICES


def centres(fitted: Fitted, module: str = "a", kernel: Kernel | None = None) -> DataFrame:
    """(model, cluster_id, centre) of a module's categories."""
    kernel = kernel or getattr(fitted.learner, "kernel", None) or getattr(fitted.learner, "kernel_a", None)

    @F.pandas_udf("array<double>")
    def of(w: pd.Series) -> pd.Series:
        return w.map(lambda v: kernel.centre(np.asarray(v)).tolist())

    return fitted.weights.where(F.col("module") == module).select("model", "cluster_id", of("w").alias("centre"))


def geometry(fitted: Fitted, module: str = "a", kernel: Kernel | None = None) -> DataFrame:
    """(model, cluster_id, name, numbers): what a plot of the categories would draw."""
    kernel = kernel or fitted.learner.kernel

    def run(batches):
        for pdf in batches:
            rows = [(m, c, k, np.atleast_1d(v).astype(float).tolist()) for m, c, w in zip(pdf["model"], pdf["cluster_id"], pdf["w"], strict=True) for k, v in kernel.geometry(np.asarray(w)).items()]
            yield pd.DataFrame(rows, columns=["model", "cluster_id", "name", "numbers"])

    return fitted.weights.where(F.col("module") == module).select("model", "cluster_id", "w").mapInPandas(run, "model string, cluster_id int, name string, numbers array<double>")


def shrink(weights: DataFrame, ratio: float) -> DataFrame:
    """Fuzzy categories drawn in by ratio of their width on each side; natively."""
    w, d = F.col("w"), (F.size("w") / 2).cast("int")
    width = F.zip_with(F.slice(w, F.lit(1), d), F.slice(w, d + 1, d), lambda a, b: 1 - b - a)
    return weights.withColumn("w", F.zip_with(w, F.concat(width, width), lambda v, s: v + F.lit(ratio) * s))


def regress(rows: DataFrame, fitted: Fitted, inputs: Sequence[str] = ("x",), sample: str = "sample_id", by: Sequence[str] = ()) -> DataFrame:
    """(model, sample_id, cluster_b, value): the centre of the target cluster that ARTMAP predicts."""
    learner: TwoSided = fitted.learner
    got = apply(rows, fitted, inputs, sample, by).select("model", "sample_id", F.get("labels", F.lit(1)).alias("cluster_b"))
    known = centres(fitted, "b", learner.kernel_b).select("model", F.col("cluster_id").cast("long").alias("cluster_b"), F.col("centre").alias("value"))
    return got.join(known, ["model", "cluster_b"], "left")


def relabel(rows: DataFrame, fitted: Fitted, inputs: Sequence[str] = ("x",), sample: str = "sample_id", by: Sequence[str] = ()) -> DataFrame:
    """(model, sample_id, cluster_id) of a topology's rows under the categories that its prunes have left.

    A row's label is of the numbering at its time. The prune log comes with the model, its
    maps are composed from the last one back, and each row meets the one of its round. Only
    rows whose category is gone are looked at again: they go to the most active category
    left (-1 where none is). A fit that carries its input is all there is to read; with
    others rows are joined for it, and sample ids have to be unique in a model.
    """
    labels = fitted.table.where("kind = 'row'").select("model", "sample_id", first_label().alias("old"), F.col("n").alias("round"), F.col("w").alias("_x"))
    if not fitted.carried:
        own = rows.select(model_key(by).alias("model"), F.col(sample).cast("long").alias("sample_id"), F.col(inputs[0]).alias("_x"))
        labels = labels.drop("_x").join(own, ["model", "sample_id"])
    got = apply(labels, Fitted(_Settled(fitted.learner), fitted.table), ["_x", "old", "round"], by=["model"])
    return got.select("model", "sample_id", first_label().alias("cluster_id"))


class _Settled:
    """A topology that is given rows with their labels and rounds, and gives their labels under its last numbering."""

    outputs = 1

    def __init__(self, inner: Topology):
        self.inner = inner

    @property
    def input_kernels(self):
        return (*self.inner.input_kernels, None, None)

    def fresh(self) -> _Settled:
        return _Settled(self.inner.fresh())

    def load(self, rows) -> None:
        self.inner.load(rows)
        self.number, now = {}, None
        for k in range(len(self.inner.log) - 1, -1, -1):
            prune = self.inner.log[k]
            now = prune if now is None else {old: now[new] for old, new in prune.items() if new in now}
            self.number[k] = now

    def predict_rows(self, columns):
        x, old, rounds = columns
        out = np.array([self.number[r].get(j, -1) if r in self.number else j for j, r in zip(np.asarray(old).tolist(), np.asarray(rounds).tolist(), strict=True)], np.int64)
        gone = np.flatnonzero(out < 0)
        if len(gone):
            out[gone] = self.inner.predict_rows([x[gone] if isinstance(x, np.ndarray) else [x[r] for r in gone]])[:, 0]
        return out[:, None]


def fusion_predict(rows: DataFrame, fitted: Fitted, inputs: Sequence[str | None], sample: str = "sample_id", by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Labels with some channels skipped (None)."""
    learner: Fusion = fitted.learner
    skip = tuple(i for i, c in enumerate(inputs) if c is None)
    return apply(rows, Fitted(_Skipping(learner, skip), fitted.table), [c for c in inputs if c is not None], sample, by, keep)


class _Skipping:
    """A fusion learner that is given the channels it does not skip."""

    outputs = 1

    def __init__(self, inner: Fusion, skip: tuple[int, ...]):
        self.inner, self.skip = inner, skip

    @property
    def input_kernels(self):
        return tuple(k for i, k in enumerate(self.inner.kernels) if i not in self.skip)

    def fresh(self) -> _Skipping:
        return _Skipping(self.inner.fresh(), self.skip)

    def load(self, rows) -> None:
        self.inner.load(rows)

    def predict_rows(self, columns):
        it = iter(columns)
        return self.inner.predict_rows([None if i in self.skip else next(it) for i in range(len(self.inner.kernels))], skip=self.skip)


def fusion_regress(rows: DataFrame, fitted: Fitted, inputs: Sequence[str | None], targets: Sequence[int], sample: str = "sample_id", by: Sequence[str] = ()) -> DataFrame:
    """(model, sample_id, cluster_id, values): centres in the target channels of the category the others choose."""
    learner: Fusion = fitted.learner
    got = fusion_predict(rows, fitted, [None if i in targets else c for i, c in enumerate(inputs)], sample, by).select("model", "sample_id", first_label().cast("int").alias("cluster_id"))
    for t in targets:
        got = got.join(centres(fitted, f"channel{t}", learner.kernels[t]).withColumnRenamed("centre", f"value{t}"), ["model", "cluster_id"], "left")
    return got.select("model", "sample_id", "cluster_id", F.array(*[F.col(f"value{t}") for t in targets]).alias("values"))


def sarsa(steps: DataFrame, value: str, reward: str, alpha: float = 1.0, discount: float = 1.0, episode: str = "episode_id", time: str = "t") -> DataFrame:
    """steps with target: value + alpha * (reward + discount * next value - value), held to [0, 1].

    The last step of an episode has no next and goes; an episode of one step keeps its reward.
    One window over episodes; an episode is one sequence, so its steps stay together.
    """
    w = Window.partitionBy(episode).orderBy(time)
    rows = steps.withColumn("_next", F.lead(value).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(episode)))
    target = F.col(value) + F.lit(alpha) * (F.col(reward) + F.lit(discount) * F.col("_next") - F.col(value))
    return rows.where(F.col("_next").isNotNull() | (F.col("_n") == 1)).withColumn("target", F.when(F.col("_n") == 1, F.col(reward)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), target)))).drop("_next", "_n")


#: Actions that are broadcast or read by the driver.
MOST_ACTIONS = 10_000


class Falcon:
    """Fusion of state, action and reward channels, an agent for each key. fit() is for plain rewards, td() learns from SARSA targets in rounds."""

    def __init__(self, kernels: tuple[Kernel, Kernel, Kernel], gamma: tuple[float, float, float] = (0.33, 0.33, 0.34), td_alpha: float = 1.0, td_lambda: float = 1.0, by: Sequence[str] = ()):
        self.learner, self.td_alpha, self.td_lambda, self.by, self.fitted = Fusion(kernels, gamma), td_alpha, td_lambda, tuple(by), None

    def fit(self, rows: DataFrame, order: str = "sample_id", state: str = "state", action: str = "action", reward: str = "reward", more: bool = False) -> Fitted:
        self.fitted = fold(rows, self.learner, order, [state, action, reward], self.by, start=self.fitted.weights if more and self.fitted else None)
        return self.fitted

    def _centres(self) -> DataFrame:
        """(model, cluster_id, reward): the reward that each category stands for."""
        return centres(self.fitted, "channel2", self.learner.kernels[2]).select("model", F.col("cluster_id").cast("long").alias("cluster_id"), F.get("centre", F.lit(0)).alias("reward"))

    def rewards(self, rows: DataFrame, state: str = "state", action: str = "action", sample: str = "sample_id", keep: Sequence[str] = (), name: str = "reward") -> DataFrame:
        """(model, sample_id, reward) and the columns to keep: centre of the reward channel of the category that state and action choose."""
        got = fusion_predict(rows, self.fitted, [state, action, None], sample, self.by, keep).withColumn("cluster_id", first_label())
        return got.join(self._centres().withColumnRenamed("reward", name), ["model", "cluster_id"], "left").select("model", "sample_id", name, *keep)

    def td(self, steps: DataFrame, rounds: int = 1, order: str = "sample_id", episode: str = "episode_id", time: str = "t", state: str = "state", action: str = "action", reward: str = "reward") -> Fitted:
        """Rounds of temporal-difference learning on steps; the value of each step is what the agent holds it to be worth before the round (0 for a new agent)."""
        names = list(dict.fromkeys([*self.by, episode, time, state, action, reward]))
        for _ in range(rounds):
            if self.fitted:
                now = self.rewards(steps, state, action, order, names, "q").withColumnRenamed("sample_id", order)
            else:
                now = steps.withColumn("q", F.lit(0.0))
            targets = sarsa(now, "q", reward, self.td_alpha, self.td_lambda, episode, time)
            self.fit(targets.withColumn("_goal", complement_code(F.array("target"))), order, state, action, "_goal", more=True)
        return self.fitted

    def action_rewards(self, states: DataFrame, actions: DataFrame, state: str = "state", action: str = "action") -> DataFrame:
        """(model, sample_id, action_id, reward) of every state with every action of an action space, which is broadcast where it has at most MOST_ACTIONS rows."""
        space = actions.select("action_id", action)
        pairs = states.crossJoin(F.broadcast(space) if space.count() <= MOST_ACTIONS else space)
        return self.rewards(pairs, state, action, keep=["action_id"])

    def best_action(self, states: DataFrame, actions: DataFrame, optimality: str = "max", state: str = "state", action: str = "action") -> DataFrame:
        """(model, sample_id, action_id, reward): the best action of every state, the first of equal ones.

        A map: each state is scored with all actions where it lies. actions (action_id and
        vector) is read by the driver, and refused beyond MOST_ACTIONS rows.
        """
        if actions.count() > MOST_ACTIONS:
            raise ValueError(f"an action space of more than {MOST_ACTIONS} actions")
        space = sorted((r["action_id"], np.asarray(r[action], float)) for r in actions.select("action_id", action).collect())
        worker = _Acting(self.learner, [a for a, _ in space], [v for _, v in space], 1.0 if optimality == "max" else -1.0)
        got = apply(states, Fitted(worker, self.fitted.table), [state], by=self.by)
        found = got.select("model", "sample_id", F.get("labels", F.lit(0)).alias("action_id"), F.get("labels", F.lit(1)).alias("cluster_id"))
        return found.join(self._centres(), ["model", "cluster_id"], "left").select("model", "sample_id", "action_id", "reward")


class _Acting:
    """A fusion learner that gives each state its best action and the category that state and action choose."""

    outputs = 2

    def __init__(self, inner: Fusion, ids: list[int], actions: list[np.ndarray], sign: float):
        self.inner, self.ids, self.actions, self.sign = inner, ids, actions, sign

    @property
    def input_kernels(self):
        return self.inner.kernels[:1]

    def fresh(self) -> _Acting:
        return _Acting(self.inner.fresh(), self.ids, self.actions, self.sign)

    def load(self, rows) -> None:
        self.inner.load(rows)
        self.worth = np.array([c[0] for c in self.inner.centres(2)])

    def predict_rows(self, columns):
        x = columns[0]
        chosen = np.stack([self.inner.predict_rows([x, np.broadcast_to(v, (len(x), len(v))), None], skip=(2,))[:, 0] for v in self.actions], 1)
        best = (self.sign * self.worth[chosen]).argmax(1)
        return np.stack([np.array(self.ids, np.int64)[best], chosen[np.arange(len(x)), best]], 1)


def best_action(rewards: DataFrame, optimality: str = "max") -> DataFrame:
    """(sample_id, action_id, reward): the best action of rewards by sample, the first of equal ones."""
    sign = 1 if optimality == "max" else -1
    best = rewards.groupBy("sample_id").agg(F.max(F.struct((sign * F.col("reward")).alias("r"), (-F.col("action_id")).alias("a"))).alias("m"))
    return best.select("sample_id", (-F.col("m.a")).alias("action_id"), (sign * F.col("m.r")).alias("reward"))


def probabilistic_action(rewards: DataFrame, offset: float = 0.1, optimality: str = "max", seed: int = 0) -> DataFrame:
    """(sample_id, action_id): an action drawn by its share of reward, shares held to [0.0001, offset]; repeatable for a seed."""
    every = Window.partitionBy("sample_id")
    share = F.col("reward") / F.sum("reward").over(every)
    share = 1 - share if optimality == "min" else share
    rows = rewards.withColumn("p", F.greatest(F.lit(0.0001), F.least(F.lit(offset), share)))
    rows = rows.withColumn("p", F.col("p") / F.sum("p").over(every)).withColumn("c", F.sum("p").over(every.orderBy("action_id")))
    # 52 bits of an MD5: the same number in any engine.
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("sample_id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return rows.groupBy("sample_id").agg(F.coalesce(F.min(F.when(F.col("c") > u, F.col("action_id"))), F.max("action_id")).alias("action_id"))


def transpose(rows: DataFrame, sample: str = "sample_id", x: str = "x") -> DataFrame:
    """(sample_id, x) of the transposed matrix."""
    long = rows.select(F.col(sample).alias("r"), F.posexplode(x).alias("c", "v"))
    return long.groupBy(F.col("c").cast("long").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("x"))


def _standard(v: Column) -> Column:
    """A vector less its mean, scaled to length 1; null where it is constant."""
    n = F.size(v)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, q: s + q)
    centred = bind(total(v) / n, lambda m: F.transform(v, lambda q: q - m))
    return bind(centred, lambda c: bind(F.sqrt(total(F.transform(c, lambda q: q * q))), lambda size: F.when(size > 0, F.transform(c, lambda q: q / size))))


def bicluster(rows: DataFrame, columns: DataFrame, kernel_a: Kernel, kernel_b: Kernel, eta: float, raw: str = "raw", x: str = "x", paper: bool = False, by: Sequence[str] = ()) -> tuple[Fitted, Fitted, DataFrame]:
    """BARTMAP over a square matrix for each key: (rows' fit, columns' fit, biclusters).

    Columns are clustered first. A row may join categories if, for some column cluster,
    its mean correlation with the rows that this cluster's numbers select, over its
    columns, is eta or more (paper: with all rows). The test does not depend on the
    category, so it comes before the fold. A correlation is the dot product of the rows
    standardised over the columns, so the mean over members is one dot product with the
    members' mean vector, and no two rows are paired. Constant rows have no correlation.
    """
    by_column = fold(columns, Clusterer(kernel_b), "sample_id", [x], by)
    label = by_column.labels.select("model", F.col("sample_id").alias("k"), first_label().alias("cb"))
    groups = label.groupBy("model", "cb").agg(F.array_sort(F.collect_list("k")).alias("cols"))
    pick = _standard(F.transform(F.col("cols"), lambda c: F.get(F.col("v"), c.cast("int"))))
    own = rows.select(model_key(by).alias("model"), F.col("sample_id").alias("k"), F.col(raw).alias("v"))
    members = own.join(groups, "model") if paper else own.join(label, ["model", "k"]).join(groups, ["model", "cb"])
    means = members.select("model", "cb", F.posexplode(pick)).groupBy("model", "cb", "pos").agg(F.avg("col").alias("mean"))
    means = means.groupBy("model", "cb").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"))
    met = own.join(groups.join(means, ["model", "cb"]), "model")
    r = F.aggregate(F.zip_with(pick, F.col("mean"), lambda a, b: a * b), F.lit(0.0), lambda s, q: s + q)
    fits = met.groupBy("model", "k").agg(F.max(F.coalesce(r >= eta, F.lit(False)).cast("int")).alias("fits"))
    tested = rows.withColumn("_model", model_key(by)).join(fits.select(F.col("model").alias("_model"), F.col("k").alias("sample_id"), "fits"), ["_model", "sample_id"], "left").withColumn("fits", F.coalesce("fits", F.lit(0)))
    by_row = fold(tested, Bicluster(kernel_a), "sample_id", [x, "fits"], by)
    masks = by_row.labels.select("model", "sample_id", first_label().alias("ca")).groupBy("model", "ca").agg(F.array_sort(F.collect_list("sample_id")).alias("rows"))
    return by_row, by_column, masks.join(groups, "model").select("model", F.col("ca").alias("row_cluster"), F.col("cb").alias("column_cluster"), "rows", F.col("cols").alias("columns"))


def validity_guided(rows: DataFrame, kernel: Kernel, index: str = "ch", by: Sequence[str] = (), order: str = "sample_id", x: str = "x", epochs: int = 1) -> DataFrame:
    """(model, sample_id, cluster_id): a category is accepted only if the validity index improves by it.

    index: ch and silhouette are to grow, db to fall. It is kept up to date from row to row
    (validity.py): a candidate costs its two clusters for ch and db, one pass over the
    model's rows for the silhouette. The rows of a model are held in one task, so keys
    should be of bounded size.
    """
    if index not in ("ch", "db", "silhouette"):
        raise ValueError("index must be ch, db or silhouette")

    def run(key, pdf):
        pdf = pdf.sort_values(order)
        data = np.stack(pdf[x].to_numpy()).astype(float)
        kept, cats = INDICES[index](data), Categories()
        for _ in range(epochs):
            for i, row in enumerate(data):

                def better(c, i=i):
                    if cats.size < 2:
                        return True
                    return kept.moved(i, c) < kept.value if index == "db" else kept.moved(i, c) > kept.value

                kept.move(i, learn(kernel, cats, row, better))
        labels = kept.labels
        return pd.DataFrame({"model": key[0], "sample_id": pdf[order].to_numpy(), "cluster_id": labels})

    return rows.select(model_key(by).alias("_g"), order, x).groupBy("_g").applyInPandas(run, "model string, sample_id long, cluster_id long")


def validity_offline(rows: DataFrame, kernel: Kernel, by: Sequence[str] = (), order: str = "sample_id", x: str = "x") -> DataFrame:
    """(model, sample_id, cluster_id): fuzzy clustering under the incremental index, all rows starting in cluster 0.

    The start needs all rows of a model before the first is learnt, so a model is one task and keys should be of bounded size.
    """

    def run(key, pdf):
        pdf = pdf.sort_values(order)
        data = [np.asarray(v, float) for v in pdf[x]]
        learner = OnlineValidity(kernel, offline=True)
        learner.start(data)
        return pd.DataFrame({"model": key[0], "sample_id": pdf[order].to_numpy(), "cluster_id": [learner.step(v)[0] for v in data]})

    return rows.select(model_key(by).alias("_g"), order, x).groupBy("_g").applyInPandas(run, "model string, sample_id long, cluster_id long")


def validity(data: np.ndarray, labels: np.ndarray, index: str) -> float:
    """Calinski-Harabasz, Davies-Bouldin or mean silhouette of one labelling; 0 below two clusters."""
    names, which = np.unique(labels, return_inverse=True)
    k, n = len(names), len(data)
    if k < 2 or k >= n:
        return 0.0
    count = np.bincount(which).astype(float)
    mean = np.stack([np.bincount(which, data[:, j]) for j in range(data.shape[1])], 1) / count[:, None]
    gap = data - mean[which]
    if index == "ch":
        within = float((gap * gap).sum())
        between = float((count[:, None] * (mean - data.mean(0)) ** 2).sum())
        return between / within * (n - k) / (k - 1) if within else 0.0
    if index == "db":
        spread = np.bincount(which, np.sqrt((gap * gap).sum(1))) / count
        far = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
        ratio = np.divide(spread[:, None] + spread[None], far, out=np.zeros_like(far), where=far > 0)
        return float(ratio.max(1).mean())
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    sums = np.stack([d[:, which == c].sum(1) for c in range(k)], 1)
    own = sums[np.arange(n), which] / np.maximum(count[which] - 1, 1)
    other = sums / count
    other[np.arange(n), which] = np.inf
    b = other.min(1)
    s = np.where((count[which] > 1) & (np.maximum(own, b) > 0), (b - own) / np.maximum(own, b), 0.0)
    return float(s.mean())


def sweep(rows: DataFrame, base: Kernel, grid: Mapping[str, Sequence], truth: str = "y", order: str = "sample_id", x: str = "x", supervised: bool = False) -> DataFrame:
    """(params, clusters, ari) for every combination of parameters: one model per combination, fitted in parallel."""
    names = list(grid)
    points = [dict(zip(names, v, strict=True)) for v in itertools.product(*grid.values())]
    learners = [(MapClassifier if supervised else Clusterer)(base.with_params(**p)) for p in points]
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, str(p)) for i, p in enumerate(points)], "point long, params string")
    inputs = [x, truth] if supervised else [x]
    keyed = rows.crossJoin(F.broadcast(table.select("point")))
    got = fold(keyed, _Choice(learners), order, ["point", *inputs], by=["point"], task=F.col("point"), tasks=len(points))
    labels = got.labels.select(F.col("model").cast("long").alias("point"), "sample_id", first_label().alias("cluster"))
    met = labels.join(rows.select(F.col(order).alias("sample_id"), F.col(truth).alias("truth")), "sample_id")
    pairs = lambda n: n * (n - 1) / 2
    cells = met.groupBy("point", "cluster", "truth").agg(F.count("*").cast("double").alias("n"))
    joint = cells.groupBy("point").agg(F.sum(pairs(F.col("n"))).alias("joint"), F.sum("n").alias("all"), F.countDistinct("cluster").alias("clusters"))
    left = cells.groupBy("point", "cluster").agg(F.sum("n").alias("n")).groupBy("point").agg(F.sum(pairs(F.col("n"))).alias("left"))
    right = cells.groupBy("point", "truth").agg(F.sum("n").alias("n")).groupBy("point").agg(F.sum(pairs(F.col("n"))).alias("right"))
    expected, best = F.col("left") * F.col("right") / pairs(F.col("all")), (F.col("left") + F.col("right")) / 2
    ari = F.when(best == expected, F.lit(1.0)).otherwise((F.col("joint") - expected) / (best - expected))
    return joint.join(left, "point").join(right, "point").join(table, "point").select("params", "clusters", ari.alias("ari"))


def cross_validate(rows: DataFrame, learner: Learner, grid: Mapping[str, Sequence], folds: int = 3, inputs: Sequence[str] = ("x", "y"), order: str = "sample_id", fold_of: Column | None = None) -> DataFrame:
    """(params, fold, n, right) for every combination of settings, by path, and every fold: a classifier learnt from the other folds, and how many of the fold's rows it gets right.

    The last input is the class. All combinations and folds are models of one fit, keyed by
    both, and of one application. A row's fold is its order modulo folds, unless given.
    """
    names = list(grid)
    points = [dict(zip(names, v, strict=True)) for v in itertools.product(*grid.values())]
    worker = _Choice([learner.with_params(**p) for p in points])
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, str(p)) for i, p in enumerate(points)], "point long, params string")
    own = F.pmod(F.col(order), F.lit(folds)).cast("long") if fold_of is None else fold_of.cast("long")
    numbered = rows.select(F.col(order).alias("sample_id"), *inputs, own.alias("_own"))
    keyed = numbered.crossJoin(F.broadcast(table.select("point"))).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    fitted = fold(keyed.where("fold <> _own"), worker, "sample_id", ["point", *inputs], by=["point", "fold"], task=F.col("point") * folds + F.col("fold"), tasks=len(points) * folds)
    tested = apply(keyed.where("fold = _own"), fitted, ["point", *inputs[:-1]], by=["point", "fold"], keep=["point", "fold", inputs[-1]])
    found = tested.groupBy("point", "fold").agg(F.count("*").alias("n"), F.sum((F.get("labels", F.lit(1)) == F.col(inputs[-1])).cast("long")).alias("right"))
    return found.join(F.broadcast(table), "point").select("params", "fold", "n", "right")


class _Choice:
    """The learner that a row's first input names."""

    outputs = 2
    input_kernels = (None,)

    def __init__(self, learners: list, chosen=None):
        self.learners, self.chosen = learners, chosen

    def fresh(self) -> _Choice:
        return _Choice(self.learners)

    aside = None

    def step_rows(self, columns):
        if self.chosen is None:
            self.point = int(columns[0][0])
            self.chosen = self.learners[self.point].fresh()
        return self.chosen.step_rows(columns[1:])

    def finish(self) -> None:
        pass

    def predict_rows(self, columns):
        return self.chosen.predict_rows(columns[1:])

    def export(self):
        yield "choice", 0, [], 0, self.point, None
        yield from self.chosen.export()

    def load(self, rows) -> None:
        self.point = next(int(r[4]) for r in rows if r[0] == "choice")
        self.chosen = self.learners[self.point].fresh()
        self.chosen.load([r for r in rows if r[0] != "choice"])
