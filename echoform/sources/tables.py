"""Sources and sinks: feature rows from tables, models on disk, toy data, written stages."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoform.functions.prep import features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_head(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of a total order with sample_id 0, 1, ...; for small fits that SQL repeats.

    The limit runs before the numbering, as a top-n that each task cuts first.
    """
    return rows.orderBy(*order).limit(n).withColumn("sample_id", F.row_number().over(Window.orderBy(*order)) - 1)


def feature_rows(rows: DataFrame, columns: Sequence[str], sample: str = "sample_id", out: str = "x") -> DataFrame:
    return rows.select(sample, features(*columns).alias(out))


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="echoform-")
        atexit.register(shutil.rmtree, place, True)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_model(fitted, path: str) -> None:
    """Weights as Parquet, with the kernel's parameters as JSON text beside them."""
    fitted.weights.write.mode("overwrite").parquet(f"{path}/weights")
    kernels = getattr(fitted.learner, "kernels", None) or (fitted.learner.kernel,)
    rows = [(i, type(k).__name__, json.dumps(asdict(k))) for i, k in enumerate(kernels)]
    fitted.weights.sparkSession.createDataFrame(rows, "position int, kernel string, params string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_kernels(spark: SparkSession, path: str) -> tuple:
    from echoform.operators.kernels import KERNELS

    rows = sorted(spark.read.parquet(f"{path}/params").collect(), key=lambda r: r["position"])
    listed = lambda v: tuple(listed(x) for x in v) if isinstance(v, list) else v
    return tuple(KERNELS[r["kernel"]](**{k: listed(v) for k, v in json.loads(r["params"]).items()}) for r in rows)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/weights")


def blobs(spark: SparkSession, n: int, centres: Sequence[Sequence[float]], spread: float = 0.5, seed: int = 0) -> DataFrame:
    """Toy clusters: (sample_id, x, y), classes in blocks, the same on every run."""
    k = len(centres)
    points = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    normal = lambda salt: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1)))) * F.cos(2 * F.pi() * F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    label = F.floor(F.col("id") * k / n).cast("int")
    rows = spark.range(n).withColumn("y", label)
    return rows.select(F.col("id").alias("sample_id"), F.array(*[F.get(F.get(points, F.col("y")), F.lit(i)) + spread * normal(100 * i) for i in range(len(centres[0]))]).alias("x"), "y")


def rings(spark: SparkSession, n: int, moons: bool = False, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """Two circles, one inside the other, or two half moons that interlock: (sample_id, x, y)."""
    y = F.col("id") % 2
    turn = F.floor(F.col("id") / 2) / F.lit(n / 2) * (F.pi() if moons else 2 * F.pi())
    shake = lambda salt: noise * (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40)) - 0.5)
    if moons:
        point = [F.when(y == 0, F.cos(turn)).otherwise(1 - F.cos(turn)), F.when(y == 0, F.sin(turn)).otherwise(0.5 - F.sin(turn))]
    else:
        radius = F.when(y == 0, F.lit(1.0)).otherwise(F.lit(0.5))
        point = [radius * F.cos(turn), radius * F.sin(turn)]
    return spark.range(n).select(F.col("id").alias("sample_id"), F.array(*[p + shake(k) for k, p in enumerate(point)]).alias("x"), y.cast("int").alias("y"))
