"""Fits and predictions as one Catalyst plan: an ordered fold inside aggregate(), argmax over literal weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoform.functions.kernels import NativeKernel
from echoform.functions.vectors import bind, vector
from echoform.operators.train import model_key

#: Rows whose labels are one state of the native fold: a step copies its state, so labels of earlier rows are kept beside it.
CHUNK_ROWS = 256


def native_fit(rows: DataFrame, kernel: NativeKernel, rho: float, order: str = "sample_id", x: str = "x", inverted: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(sample_id, cluster_id), with model if by is given, of elementary models, without Python. The rows of a model are held in one task.

    A category resonates if its match is rho or more (at most rho, if inverted). Of those,
    the most active one takes the row, the oldest on ties: the search without a predicate
    comes to that, as categories that fail change nothing.
    """
    keyed = rows.select(model_key(by).alias("model"), F.col(order).alias("i"), F.col(x).alias("x"))
    # A number of partitions of our own: rows are few bytes and much work, and would be put together in one task.
    keyed = keyed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model")
    held = keyed.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("rows"))
    weights, ints = F.array().cast("array<array<double>>"), F.array().cast("array<int>")
    empty = F.array().cast("array<array<int>>")

    def step(state: Column, row: Column) -> Column:
        v = row["x"]
        scored = F.transform(state["w"], lambda w, k: F.struct(kernel.choice(v, w).alias("t"), (-k).alias("k"), kernel.match(v, w).alias("m")))
        best = F.array_max(F.filter(scored, lambda s: ((s["m"] <= rho) if inverted else (s["m"] >= rho)) & s["t"].isNotNull() & ~F.isnan(s["t"])))
        label = F.coalesce(-best["k"], F.size(state["w"]))
        return bind(
            label,
            lambda c: F.struct(
                F.when(c == F.size(state["w"]), F.concat(state["w"], F.array(kernel.new(v)))).otherwise(F.transform(state["w"], lambda w, k: F.when(k == c, kernel.update(v, w)).otherwise(w))).alias("w"),
                F.concat(state["labels"], F.array(c)).alias("labels"),
            ),
        )

    def chunk(state: Column, first: Column) -> Column:
        # Rows first to first + CHUNK_ROWS - 1, from the weights there are.
        inner = F.aggregate(F.slice("rows", first, F.lit(CHUNK_ROWS)), F.struct(state["w"].alias("w"), ints.alias("labels")), step)
        return bind(inner, lambda s: F.struct(s["w"].alias("w"), F.concat(state["labels"], F.array(s["labels"])).alias("labels")))

    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(CHUNK_ROWS))
    done = held.select("model", F.transform("rows", lambda r: r["i"]).alias("ids"), F.flatten(F.aggregate(starts, F.struct(weights.alias("w"), empty.alias("labels")), chunk, lambda s: s["labels"])).alias("labels"))
    out = done.select("model", F.explode(F.arrays_zip("ids", "labels")).alias("z")).select("model", F.col("z.ids").alias("sample_id"), F.col("z.labels").cast("long").alias("cluster_id"))
    return out if by else out.drop("model")


def native_predict(rows: DataFrame, weights: Sequence[Sequence[float]], kernel: NativeKernel, rho: float | None = None, x: str = "x", keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """rows' columns, cluster_id and activation: a map over literal weights. With rho, of the categories that pass it (0 where none does)."""
    table = F.array(*[vector(w) for w in weights])
    scored = F.transform(table, lambda w, k: F.struct(kernel.choice(F.col(x), w).alias("t"), (-k).alias("k"), kernel.match(F.col(x), w).alias("m")))
    best = F.array_max(scored if rho is None else F.filter(scored, lambda s: s["m"] >= rho))
    return rows.select(*keep, best.alias("_b")).select(*keep, F.coalesce(-F.col("_b.k"), F.lit(0)).cast("long").alias("cluster_id"), F.col("_b.t").alias("activation"))


def predict_joined(rows: DataFrame, weights: DataFrame, kernel: NativeKernel, x: str = "x", sample: str = "sample_id") -> DataFrame:
    """(sample_id, cluster_id) against a weights table (cluster_id, w) of any size: rows meet blocks of it, maxima combine before the shuffle."""
    met = rows.select(F.col(sample).alias("sample_id"), F.col(x).alias("_x")).crossJoin(weights.select("cluster_id", "w"))
    best = met.groupBy("sample_id").agg(F.max(F.struct(kernel.choice(F.col("_x"), F.col("w")).alias("t"), (-F.col("cluster_id")).alias("k"))).alias("b"))
    return best.select("sample_id", (-F.col("b.k")).cast("long").alias("cluster_id"))
