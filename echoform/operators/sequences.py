"""Sequence clustering: global alignment, agreement strings, and a learner over strings."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from echoform.operators.learners import Learner
from echoform.operators.search import by_activation

Metric = Callable[[str, str], tuple[str, float]]


#: Alignments that a worker remembers.
REMEMBERED = 65_536


@lru_cache(REMEMBERED)
def needleman_wunsch(a: str, b: str, same: int = 1, other: int = -1, gap: int = -1) -> tuple[str, float]:
    """(agreement, score): the aligned characters, '-' where they differ, and the score over the longer length.

    On the way back a diagonal step is preferred to one up (a gap in b) and that to one left.
    """
    if not a and not b:
        return "", 0.0
    table = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    table[:, 0], table[0, :] = gap * np.arange(len(a) + 1), gap * np.arange(len(b) + 1)
    other_row = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = gap * np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        diagonal = table[i - 1, :-1] + np.where(other_row == ord(c), same, other)
        best = np.concatenate([table[i, :1], np.maximum(diagonal, table[i - 1, 1:] + gap)])
        table[i] = np.maximum.accumulate(best - steps) + steps  # gaps along the row are a running maximum
    out, i, j = [], len(a), len(b)
    while i and j:
        here = table[i, j]
        if here == table[i - 1, j - 1] + (same if a[i - 1] == b[j - 1] else other):
            out.append(a[i - 1] if a[i - 1] == b[j - 1] else "-")
            i, j = i - 1, j - 1
        else:
            up = here == table[i - 1, j] + gap
            out.append("-")
            i, j = (i - 1, j) if up else (i, j - 1)
    out.extend("-" * (i + j))
    return "".join(reversed(out)), float(table[-1, -1]) / max(len(a), len(b))


def compress_dashes(text: Column) -> Column:
    return F.regexp_replace(text, "-+", "-")


def joined_digits(x: Column) -> Column:
    """An array of integers as one string."""
    return F.array_join(F.transform(x, lambda v: v.cast("long").cast("string")), "")


def align(a: Column, b: Column) -> Column:
    """needleman_wunsch of two string columns as struct(agreement, score); null where either is null."""

    @F.pandas_udf("struct<agreement:string,score:double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [needleman_wunsch(x, y) if isinstance(x, str) and isinstance(y, str) else (None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(got, columns=["agreement", "score"])

    return run(a, b)


@dataclass
class SequenceClusterer(Learner):
    """Strings cluster by alignment score; a cluster's string keeps what its members agree on.

    metric gives (agreement, score) of two strings. Weights are strings, exported as code points.
    """

    rho: float = 0.0
    metric: Metric = needleman_wunsch
    weights: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    def step(self, x):
        got = [self.metric(x, w) for w in self.weights]
        for j in by_activation(np.array([s for _, s in got], float)).tolist() if got else ():
            if got[j][1] >= self.rho:
                self.weights[j] = re.sub("-+", "-", got[j][0])
                self.counts[j] += 1
                return (j,)
        self.weights.append(x)
        self.counts.append(1)
        return (len(self.weights) - 1,)

    def predict(self, x):
        return (int(by_activation(np.array([self.metric(x, w)[1] for w in self.weights], float))[0]),) if self.weights else (-1,)

    def export(self):
        for j, (w, n) in enumerate(zip(self.weights, self.counts, strict=True)):
            yield "a", j, [float(ord(c)) for c in w], n, None, None

    def load(self, rows):
        own = sorted(rows, key=lambda r: r[1])
        self.weights, self.counts = ["".join(chr(int(c)) for c in r[2]) for r in own], [r[3] for r in own]
