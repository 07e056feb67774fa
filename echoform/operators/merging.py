"""Merging objects that may be merged: connected components of a pair predicate."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoform.sources.tables import written


def merge_objects(objects: DataFrame, key: str, value: str, can_merge: Callable[[Column, Column], Column], rounds: int | None = None) -> DataFrame:
    """(key, component): objects tied by can_merge(a, b) over pairs a < b, directly or through others."""
    a = objects.select(F.col(key).alias("a"), F.col(value).alias("_a"))
    b = objects.select(F.col(key).alias("b"), F.col(value).alias("_b"))
    edges = a.join(b, (F.col("a") < F.col("b")) & can_merge(F.col("_a"), F.col("_b"))).select("a", "b")
    return label_components(objects.select(F.col(key).alias("node")), edges, rounds).withColumnRenamed("node", key)


#: Cells whose breaks are counted in one window.
CELL_RUN = 4_096
#: Cells on either side of 0: whole numbers that a double tells apart.
CELLS = float(1 << 52)


def merge_close(objects: DataFrame, key: str, value: str, distance: float) -> DataFrame:
    """(key, component): what merge_objects gives for abs(a - b) <= distance, without pairs.

    On a line, components end where two neighbouring values are further apart. Values go to
    cells of half the distance, so that a cell never breaks; each cell meets the three
    before it, and the breaks up to it are counted in runs of cells. Nulls, NaN and infinite
    values are alone; values beyond CELLS cells, which no double tells apart by less, merge
    if they are equal. Keys have to be unique.
    """
    v = F.col(value).cast("double")
    usual, far = F.abs(v) < CELLS * distance / 2, (F.abs(v) >= CELLS * distance / 2) & (F.abs(v) < float("inf"))
    rows = objects.select(F.col(key), F.when(usual, v).alias("_v"), F.when(far, v).alias("_far")).withColumn("_cell", F.floor(F.col("_v") / F.lit(distance / 2)))
    cells = rows.where("_cell is not null").groupBy("_cell").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = cells.select(F.explode(F.array(*[F.col("_cell") + k for k in (1, 2, 3)])).alias("_cell"), "_high").groupBy("_cell").agg(F.max("_high").alias("_last"))
    met = cells.join(before, "_cell", "left").select("_cell", F.when(F.col("_low") - F.col("_last") <= distance, F.lit(0)).otherwise(F.lit(1)).alias("_break"))
    met = met.withColumn("_run", F.floor(F.col("_cell") / CELL_RUN))
    sums = met.groupBy("_run").agg(F.sum("_break").alias("_n"))
    sums = sums.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_base"))
    islands = met.withColumn("_own", F.sum("_break").over(Window.partitionBy("_run").orderBy("_cell"))).join(sums, "_run").select("_cell", (F.col("_base") + F.col("_own")).alias("_island"))
    placed = rows.join(islands, "_cell", "left")
    least = placed.where("_island is not null").groupBy("_island").agg(F.min(key).alias("component"))
    same = rows.where("_far is not null").groupBy("_far").agg(F.min(key).alias("_same"))
    return placed.join(least, "_island", "left").join(same, "_far", "left").select(key, F.coalesce("component", "_same", key).alias("component"))


def label_components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) by passing least labels along edges, with shortcuts through the label's own label; until nothing changes, or an error after a number of rounds."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    for _ in itertools.count() if rounds is None else range(rounds):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        new = labels.join(near, labels["node"] == near["u"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = written(new.join(jump, new["component"] == jump["n2"]).select("node", F.least("component", "c2").alias("component"), "old"), "labels")
        if not new.where("component <> old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"no fixed point after {rounds} rounds")
