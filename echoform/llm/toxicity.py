"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, from a
bounded sample of labelled documents with as many documents of each class. A window is
a word, with a fixed frame after it that all samples of both dictionaries have too
(zstandard looks for no matches in the last bytes of its input, and stores what it
can't shorten as it is). A document gives each of its distinct words to its dictionary
once. The window is compressed with both dictionaries; where the toxic one gives fewer
bytes, the window resembles toxic text more than ordinary text.

A document's score comes from the number and share of its windows at several
thresholds of the bytes saved, by a logistic regression fitted on a quarter of the
sample that no dictionary has seen, weighted back to the share of each class among
labelled rows.

Every whole text is scored, batch by batch, without a shuffle. Each distinct word of
a batch is compressed once, and a worker keeps the savings of words it has met in a
bounded cache. Nulls and empty texts have no windows and get the score of such; a
sample without two documents of both classes in each part gives every document the
share of class 1 (0 without labels). Texts of any length are scored whole (in the
sample, longer ones than MOST_BYTES are left out). Repeated rows give repeated
results; scores that tie are equal. An id with several texts counts in the sample with one of them.
Extra columns are ignored by score() and kept by drop_toxic().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm._labels import fold, labelled_sample, logistic
from echoform.llm._text import ALNUM, LOWER, bytes_of, chunks, token_hashes

#: Documents of each class in the training sample at most, and bytes of each.
PER_CLASS, MOST_BYTES = 2000, 1 << 15
#: Of the sample, every so many documents calibrate; the others train dictionaries.
CALIBRATE = 4
FRAME = bytes(range(1, 9)) + bytes(range(14, 26))
LEVEL, DICTIONARY = 19, 1 << 18
#: Thresholds: bytes saved, share of the word's bytes saved, bytes lost.
SAVINGS, SHARES, LOSSES = (1, 2, 3, 4, 5, 6), (0.3, 0.45, 0.6), (1, 2, 4)
CACHE = 150_000


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    prior: float
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    _tools: tuple | None = field(default=None, repr=False)
    _cache: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None, "_cache": {}}

    def saving(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on a word over the ordinary one."""
        if self._tools is None:
            tools = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content)
                d.precompute_compress(level=LEVEL)
                tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
            self._tools = tuple(tools)
        framed = window(word)
        return len(self._tools[0](framed)) - len(self._tools[1](framed))

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text: counts and shares of windows by saving."""
        n = len(offsets) - 1
        hashes, rows, start, end = token_hashes(raw, offsets, ALNUM)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        low, savings = LOWER[raw].tobytes(), np.zeros(len(distinct), np.int64)
        if len(self._cache) > CACHE:
            self._cache.clear()
        for k, (a, b) in enumerate(zip(start[first].tolist(), end[first].tolist(), strict=True)):
            word = low[a:b]
            got = self._cache.get(word)
            if got is None:
                got = self._cache[word] = self.saving(word)
            savings[k] = got
        saved, size = savings[which], end - start
        total = np.bincount(rows, minlength=n).astype(float)
        out = [np.ones(n), np.log1p(total)]
        for hit in [*(saved >= k for k in SAVINGS), *((saved >= s * size) & (saved > 1) for s in SHARES), *(saved <= -k for k in LOSSES)]:
            count = np.bincount(rows[hit], minlength=n).astype(float)
            out += [np.log1p(count), np.sqrt(count / np.maximum(total, 1)), (count > 0).astype(float), (count > 2).astype(float)]
        return np.stack([*out, np.bincount(rows, saved, n) / np.maximum(total, 1)], axis=1)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.prior)
        x = (self.features(raw, offsets) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def window(word: bytes) -> bytes:
    return b" " + word + b" " + FRAME


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their content itself
        return b"".join(dict.fromkeys(samples))[-DICTIONARY:]


def train(sample: list[tuple[bytes, int]], counts: dict[int, int]) -> Model:
    """Model from (words with spaces between, label) rows, of which every CALIBRATE-th of each class calibrates; counts: labelled rows of each class."""
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    parts = {}
    for c in (0, 1):
        own = [words for words, label in sample if label == c]
        parts[c] = [w for k, w in enumerate(own) if k % CALIBRATE != CALIBRATE - 1], own[CALIBRATE - 1 :: CALIBRATE]
    if any(len(p) < 2 for both in parts.values() for p in both):
        return Model(b"", b"", prior)
    ordinary, toxic = (_dictionary([window(w) for words in parts[c][0] for w in dict.fromkeys(words.split(b" ")) if w]) for c in (0, 1))
    model = Model(toxic, ordinary, prior)
    y = np.repeat([0.0, 1.0], [len(parts[0][1]), len(parts[1][1])])
    raw, offsets = bytes_of(pa.array(parts[0][1] + parts[1][1], pa.large_binary()))
    x = np.concatenate([model.features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 1 << 20)])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    mean[0], spread[0] = 0, 1
    share = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.weights, model.mean, model.spread = logistic((x - mean) / spread, y, share), mean, spread
    model._cache.clear()
    return model


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, label: str = "toxic", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    """Model from labelled documents outside the held-out fold; the driver gets their words."""
    sample, counts = labelled_sample(documents, labels, label, fold(F.col("_id"), folds) != held, per_class, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column(1))
            words = []
            for i, j in chunks(offsets):
                part = raw[offsets[i] : offsets[j]]
                clean = np.where(ALNUM[part], LOWER[part], np.uint8(32)).tobytes()
                words += [clean[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]] for k in range(i, j)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.binary())], ["_id", "label", "words"])

    got = sample.mapInArrow(run, "_id long, label int, words binary").toArrow().sort_by("_id")
    return train(list(zip(got.column("words").to_pylist(), got.column("label").to_pylist(), strict=True)), counts)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def scores(model: Model, column: pa.Array) -> np.ndarray:
    raw, offsets = bytes_of(column)
    got = [model.score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, 1 << 19)]
    return np.concatenate(got) if got else np.zeros(0)


def drop_toxic(documents: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """documents whose score is below the threshold, unchanged."""
    shared, column = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(shared.value, batch.column(column)) < threshold, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(documents, model)
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
