"""Incremental learning on Structured Streaming.

partial_fit() learns from micro-batches: each batch is sorted by its order column, the
stored weights are the start, and the new weights are written under the batch's number,
so that a batch that is run again replaces its own result and nothing else. As a fold
goes on where it stopped, many batches give what one batch of all rows would.

keyed_partial_fit() keeps a model per key in the stream's own state store.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echoform.operators.learners import Learner
from echoform.operators.train import fold
from echoform.session import ship


def batch_path(root: str, batch: int) -> str:
    return f"{root}/batch={batch:012d}"


def latest_weights(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Weights after the last batch (before a given one)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(place) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/weights/_SUCCESS"))]
    known = sorted(int(n.split("=")[1]) for n in done if n.startswith("batch=") and (before is None or int(n.split("=")[1]) < before))
    return spark.read.parquet(f"{batch_path(root, known[-1])}/weights") if known else None


def learn_batch(rows: DataFrame, batch: int, root: str, learner: Learner, order: str, inputs: Sequence[str], by: Sequence[str] = ()) -> None:
    """One micro-batch: labels and weights under its number."""
    fitted = fold(rows, learner, order, inputs, by, start=latest_weights(rows.sparkSession, root, batch))
    fitted.labels.write.mode("overwrite").parquet(f"{batch_path(root, batch)}/labels")
    fitted.weights.write.mode("overwrite").parquet(f"{batch_path(root, batch)}/weights")


def partial_fit(stream: DataFrame, root: str, checkpoint: str, learner: Learner, order: str, inputs: Sequence[str], by: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Start learning from a stream; trigger as in writeStream.trigger."""
    writer = stream.writeStream.foreachBatch(lambda rows, n: learn_batch(rows, n, root, learner, order, inputs, by)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def keyed_partial_fit(stream: DataFrame, learner: Learner, key: str, order: str, x: str) -> DataFrame:
    """(key, sample_id, cluster_id) of a stream, with a model per key in the state store.

    Rows are put in order inside a micro-batch, for which a worker holds a key's rows of
    that batch; the stream's own limits (maxFilesPerTrigger and the like) bound them.
    """
    ship(stream.sparkSession)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else learner.fresh()
        rows = pd.concat(list(frames)).sort_values(order)
        labels = [own.step(np.asarray(v, float))[0] for v in rows[x]]
        state.update((pickle.dumps(own),))
        yield pd.DataFrame({"key": [str(group[0])] * len(rows), "sample_id": rows[order].astype("int64"), "cluster_id": labels})

    return stream.groupBy(key).applyInPandasWithState(run, "key string, sample_id long, cluster_id long", "model binary", "append", GroupStateTimeout.NoTimeout)
