"""Structured Streaming against batch fits."""

import numpy as np

from echoform.operators.kernels import Fuzzy
from echoform.operators.learners import Clusterer
from echoform.operators.train import fold
from echoform.streaming.partial import keyed_partial_fit, latest_weights, partial_fit


def frame(spark, n, seed=0):
    xs = np.random.default_rng(seed).random((n, 2))
    return spark.createDataFrame([(i, f"k{i % 2}", [*map(float, x), *map(float, 1 - x)]) for i, x in enumerate(xs)], "sample_id long, k string, x array<double>")


def test_micro_batches_equal_one_fit(spark, tmp_path):
    rows, learner = frame(spark, 60), Clusterer(Fuzzy(0.75, 0.01))
    whole = fold(rows, learner, "sample_id", ["x"])
    for n in range(3):  # one trigger for each file, in order
        rows.where(f"sample_id between {20 * n} and {20 * n + 19}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("sample_id long, k string, x array<double>").parquet(str(tmp_path / "in"))
        partial_fit(stream, str(tmp_path / "m"), str(tmp_path / "c"), learner, "sample_id", ["x"], availableNow=True).awaitTermination()
    cut = lambda df: sorted((r["cluster_id"], tuple(np.round(r["w"], 9)), r["n"]) for r in df.collect())
    assert cut(latest_weights(spark, str(tmp_path / "m"))) == cut(whole.weights)


def test_a_model_per_key_in_the_state_store(spark, tmp_path):
    rows, learner = frame(spark, 40, 1), Clusterer(Fuzzy(0.75, 0.01))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_id long, k string, x array<double>").parquet(str(tmp_path / "in"))
    got = keyed_partial_fit(stream, learner, "k", "sample_id", "x")
    got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    have = {(r["key"], r["sample_id"]): r["cluster_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["model"], r["sample_id"]): r["labels"][0] for r in fold(rows, learner, "sample_id", ["x"], by=["k"]).labels.collect()}
    assert have == want and len(have) == 40
