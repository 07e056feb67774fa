"""Session helpers: the shared scratch folder, written stages, blob exchanges and membership filters."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.sources.tables import shared_folder

#: Scratch tables by the run that made them; those of no run are never deleted.
_made: dict[str | None, list[str]] = {}
_run: list[str | None] = [None]


@contextmanager
def owned(spark: SparkSession, run: str) -> Iterator[None]:
    """Tables made inside belong to a run; those that the run made before are deleted first.

    For steps whose earlier results are already written elsewhere, such as the stages of a
    pipeline: results of other runs and of stand-alone queries stay.
    """
    for path in _made.pop(run, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _run.append(run)
    try:
        yield
    finally:
        _run.pop()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _run[-1] is not None:
        _made.setdefault(_run[-1], []).append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a written table: later readers neither recompute it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, name: str, most: int = 200_000) -> DataFrame:
    """df as a written table that is broadcast where its rows, once counted, are few; else joined by a shuffle."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= most else table


def bucket_bits(spark: SparkSession, size: int) -> int:
    """Bits of a hash that choose its bucket: sixteen buckets for each shuffle partition or more, and one for each 8 MB of input or more."""
    return min(22, max(4, math.ceil(math.log2(max(16 * shuffle_partitions(spark), size / 8e6)))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_bucket(df: DataFrame, work: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the (bucket int, blob binary) rows of a bucket together and run work on each bucket's blobs.

    Many buckets share a shuffle partition and are worked on one after the other,
    so a worker holds one bucket at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if held:
                        yield from work(now, held)
                    now, held = bucket, []
                held.append(blob.as_py())
        if held:
            yield from work(now, held)

    dealt = df.repartition(shuffle_partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, schema)


class Membership:
    """Bloom filter over a long column, built by Spark and broadcast.

    Sized by the number of ids, ten bits for each or more, from 1 to 64 MB; beyond some 50
    million ids it fills up. The driver gets its words only. A wrong yes costs
    some shuffled rows that the following join drops, so a filled filter slows the
    query down and changes nothing else. mixed: the column holds hashes already, and
    has() tells of them without positions().
    """

    def __init__(self, ids: DataFrame, hashes: int = 3, mixed: bool = False):
        spark, column = ids.sparkSession, ids.columns[0]
        bits = min(29, max(23, (10 * ids.count()).bit_length()))
        if mixed:
            at = F.array(*[F.shiftrightunsigned(F.col(column), 17 * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(hashes)])
        else:
            at = F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(1 << bits)) for k in range(hashes)])
        word = ids.select(F.explode(at).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w"))
        got = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), np.int64)
        words[got.column("w").to_numpy()] = got.column("b").to_numpy()
        self.bits, self.hashes = bits, hashes
        self.words = spark.sparkContext.broadcast(words)

    def positions(self, df: DataFrame, column: str, name: str = "__at") -> DataFrame:
        """df with the positions of a column's values in the filter, for contains()."""
        return df.withColumn(name, F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(1 << self.bits)) for k in range(self.hashes)]))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        words, out = self.words.value, np.ones(len(hashes), bool)
        for k in range(self.hashes):
            at = ((hashes.view(np.uint64) >> np.uint64(17 * k)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            out &= ((words[at >> 6] >> (at & 63)) & 1).astype(bool)
        return out

    def contains(self, at: np.ndarray) -> np.ndarray:
        words = self.words.value
        return ((words[at >> 6] >> (at & 63)) & 1).all(axis=1)


def split(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the ids, rows whose key is not): only the first need a join, so only their texts move.

    Rows are packed while they are told apart, so columns of any name are safe.
    """
    filter_ = Membership(ids)
    packed = filter_.positions(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").cast(ids.schema[0].dataType).alias("key")), "key", "at").select("row", "at")

    def side(want: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
                yield batch.filter(pa.array(filter_.contains(places) == want, pa.bool_())).select([0])

        return packed.mapInArrow(run, packed.select("row").schema).select("row.*")

    return side(True), side(False)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: count, lengths in bytes, contents."""
    parts = [a.tobytes() for a in arrays]
    return b"".join([np.array([len(parts), *map(len, parts)], np.int64).tobytes(), *parts])


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds) + 1)
    out, at = [], 8 * (len(kinds) + 1)
    for kind, size in zip(kinds, sizes[1:].tolist(), strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out
