"""Bounded samples of labelled documents, and the fold that an id belongs to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, most_bytes: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most per_class documents of each class, and how many labelled rows each class has.

    Documents are chosen by a hash of their ids. Only the ids chosen are broadcast, so
    that texts are read where they lie and no other text moves. Texts of more than
    most_bytes bytes are left out of the sample, which bounds it in bytes. An id with
    several labels counts once, with the largest, and one with several rows with one of
    them, so that the bound holds for rows; null ids and labels are ignored.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_label")).where(keep)
    counts = {int(r[0]): int(r[1]) for r in known.where(F.col("_label").isin(0, 1)).groupBy("_label").count().collect()}
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("_label") == c).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = documents.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("text")).where(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "_id")
    one = found.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_one"))
    return one.select("_id", F.col("_one.text").alias("text"), F.col("_label").alias("label")), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column of x is the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
