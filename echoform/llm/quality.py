"""Quality classifier: a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators tell which byte n-grams (1 to 4 bytes, hashed to 2**18 places) a text has.
Each is scaled by r, the log of the ratio of its smoothed share in good and in bad
documents, rows are brought to length 1, and a linear model with hinge loss is fitted
by dual coordinate descent. Its weights are drawn towards their mean size, signs
kept (the interpolation that naive Bayes support vector machines use), multiplied by r, and its
margins are mapped to scores by a logistic curve fitted on a fifth of the sample that
the machine has not seen, weighted back to the share of each class.

The sample is bounded by PER_CLASS and MOST_BYTES; every whole text is scored, batch
by batch, without a shuffle. Nulls and empty texts have no indicators and score as
the curve's value at margin 0 of the bias alone; a sample without both classes gives
every document the share of class 1 (0 without labels). Texts of any length are scored
whole. Repeated rows give repeated results, equal margins equal scores. Places of the
hash table are shared by n-grams that collide, which blurs the model a little and is
the same for training and scoring. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm._labels import fold, labelled_sample, logistic
from echoform.llm._text import bytes_of

PER_CLASS, MOST_BYTES = 1500, 1 << 15
PLACES, LONGEST = 18, 4
SMOOTH, COST, MIX, ROUNDS = 1.0, 1.0, 0.25, 12


class Indicators:
    """Distinct hashed n-grams of a text. The scratch table makes distinctness a scatter and a gather."""

    def __init__(self) -> None:
        self.table = np.zeros(1 << PLACES, np.int32)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        ids, packed = [], np.zeros(len(raw), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(raw) < n:
                break
            packed = (packed[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
            ids.append(((packed + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - PLACES))
        if not ids:
            return np.zeros(0, np.int32)
        every = np.concatenate(ids).astype(np.int32)
        at = np.arange(len(every), dtype=np.int32)
        self.table[every] = at
        return every[self.table[every] == at]


@dataclass
class Model:
    prior: float
    weights: np.ndarray | None = None
    bias: float = 0.0
    curve: tuple[float, float] = (0.0, 1.0)

    def margin(self, ids: np.ndarray, norm: np.ndarray) -> float:
        length = float(np.sqrt(norm[ids].sum())) if len(ids) else 0.0
        return (float(self.weights[ids].sum()) / length if length else 0.0) + self.bias


def descend(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weights, bias) of the hinge-loss machine by dual coordinate descent; a row's values are r[ids] / length."""
    w, bias, alpha, rng = np.zeros(len(r)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    values = []
    for ids in rows:
        v = r[ids]
        length = np.sqrt((v * v).sum())
        values.append(v / length if length else v)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i], values[i]
            gradient = y[i] * (w[ids] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / ((v @ v) + 1.0), 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[ids] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def train(rows: list[np.ndarray], labels: np.ndarray, counts: dict[int, int]) -> tuple[Model, np.ndarray]:
    """(model, squares of r) from the indicators and labels of a sample."""
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    check = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~check].tolist())) < 2:
        return Model(prior), np.zeros(1 << PLACES)
    seen = np.full((2, 1 << PLACES), SMOOTH)
    for ids, label in zip((rows[i] for i in np.flatnonzero(~check)), labels[~check], strict=True):
        seen[int(label), ids] += 1
    r = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    inside = np.flatnonzero(~check)
    w, bias = descend([rows[i] for i in inside], r, np.where(labels[inside] > 0, 1.0, -1.0))
    used = np.flatnonzero(w)
    w[used] = (1 - MIX) * np.abs(w[used]).mean() * np.sign(w[used]) + MIX * w[used]
    model, norm = Model(prior, (w * r).astype(np.float32), bias), (r * r).astype(np.float32)
    on = np.flatnonzero(check) if len(set(labels[check].tolist())) == 2 else np.arange(len(rows))
    m = np.array([model.margin(rows[i], norm) for i in on])
    y = labels[on].astype(float)
    share = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.curve = tuple(logistic(np.stack([np.ones(len(m)), m], axis=1), y, share, ridge=1e-3).tolist())
    return model, norm


def fit(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, label: str = "quality", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> tuple[Model, np.ndarray]:
    sample, counts = labelled_sample(documents, labels, label, fold(F.col("_id"), folds) != held, per_class, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Indicators()
        for batch in batches:
            raw, offsets = bytes_of(batch.column(1))
            ids = [make(raw[offsets[k] : offsets[k + 1]]).tobytes() for k in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary())], ["_id", "label", "ids"])

    got = sample.mapInArrow(run, "_id long, label int, ids binary").toArrow().sort_by("_id")
    return train([np.frombuffer(b, np.int32) for b in got.column("ids").to_pylist()], got.column("label").to_numpy(), counts)


def score(documents: DataFrame, model: Model, norm: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((model, norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, (model, norm) = Indicators(), shared.value
        for batch in batches:
            raw, offsets = bytes_of(batch.column(1))
            if model.weights is None:
                out = np.full(len(offsets) - 1, model.prior)
            else:
                m = np.array([model.margin(make(raw[offsets[k] : offsets[k + 1]]), norm) for k in range(len(offsets) - 1)])
                out = 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * m, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, norm = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(documents, model, norm)
    return got.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
