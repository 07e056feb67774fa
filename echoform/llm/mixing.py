"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / weight, with u from a hash of its
id, so that small keys are a weighted sample without replacement and reruns agree.
A source's target first buys complete epochs of all its documents; the rest is a
fractional selection: documents in key order, sizes prefix-summed up to the budget,
the last one cut at it, so that what a source gives meets its target.

Targets: weights share the total budget, a source stops at cap times its size, and
the excess goes to the others by weight until none is above its cap.

Prefix sums never gather a source in one task: rows are dealt by ranges of
(source, key), each range is summed, and ranges start from the sums before them.
Only the table of sources (a row each) is ordered as a whole.

Nulls: a null text has size 0 and takes 0; a null source is a source of its own,
last in order; a null weight counts as the least weight. Rows with the same id keep
apart, and are ordered by their texts where keys and ids tie. An empty table gives no
rows. Texts of any length count whole. The order of sources and their levels is one
window over the table of sources, which suits thousands of sources, not one for each
document. mix() ignores extra columns, take() keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoform.llm._spark import checked, shuffle_partitions, written

LEAST_WEIGHT = 0.05


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than ASCII space and \\x09-\\x0D."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    edge = F.when(text == "", 1).otherwise(F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0))
    return (F.size(parts) - edge).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of a text's bytes that are no ASCII digits or symbols, at least LEAST_WEIGHT."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(text, r"[!-&*+/-9<-@\[-`{-~]+", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.when(F.length(text) > 0, plain / F.length(text)).otherwise(F.lit(1.0)))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target from (source, source_size).

    With level L a source gets min(cap * size, L * weight); L is where the sum meets
    the budget. Sources in order of cap * size / weight reach their caps one after
    the other, so L follows from sums over that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", cycle[(F.row_number().over(order) - 1) % len(weights)]).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    rise = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, every = rise.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # The first source that its level doesn't fill sets the level for itself and all after it.
    s = s.withColumn("_open", F.col("_level") < F.col("_cap") / F.col("_w"))
    s = s.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), "source", "_level"))).over(every)["_level"])
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("_w")))
    return s.select("source", "source_size", target.alias("target"))


def _keyed(documents: DataFrame, weight: Column | None, key: str, text: str, source: str, seed: int) -> DataFrame:
    """doc_id, source, size, _key and _tie of every row: small keys come first in a source."""
    weight = quality_weight(F.col(text)) if weight is None else F.coalesce(weight.cast("double"), F.lit(LEAST_WEIGHT))
    return documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _key(weight, F.col(key), seed).alias("_key"), F.xxhash64(text).alias("_tie"))


def _key(weight: Column, key: Column, seed: int) -> Column:
    # 52 bits of an MD5, moved off zero: the same number in any engine.
    u = (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / F.greatest(weight, F.lit(LEAST_WEIGHT))


def mix(documents: DataFrame, weight: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    taken // size whole copies of a document are in the mix, and then its first taken % size words.
    """
    return _selected(documents, weight, weights, share, cap, key, text, source, seed).select("doc_id", "source", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long").alias("taken"))


def _selected(documents: DataFrame, weight: Column | None, weights: Sequence[float], share: float, cap: float, key: str, text: str, source: str, seed: int) -> DataFrame:
    spark: SparkSession = documents.sparkSession
    by = [F.col("source").asc_nulls_last(), "_key", "doc_id", "_tie"]
    # Written first: dealing by ranges reads its input twice, and texts should be read once.
    keys = written(_keyed(documents, weight, key, text, source, seed), "keys")
    dealt = written(keys.repartitionByRange(shuffle_partitions(spark), *by).withColumn("_range", F.spark_partition_id()), "mix")
    ranges = dealt.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aims = targets(dealt.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    ranges = ranges.withColumn("_start", start).drop("_sum")
    ranges = ranges.join(aims, ranges["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    met = dealt.join(ranges.withColumnRenamed("source", "_source").withColumnRenamed("_range", "_r"), dealt["source"].eqNullSafe(F.col("_source")) & (dealt["_range"] == F.col("_r"))).drop("_source", "_r")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("_before"))).cast("long")
    return met.withColumn("_epochs", epochs).withColumn("_part", part)


def take(documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """documents with what the mix takes of them: size, source_size, target, taken, copies (whole ones) and part (the words taken beyond them, as text).

    Of a source only the document at which its selection ends is needed to tell what it
    takes of each, so texts stay where they are and the sources' table meets them. Rows
    with the same key, id and text at that end share what is left to them evenly,
    rounded down. A column named like one of the six is replaced.
    """
    added = ("size", "source_size", "target", "taken", "copies", "part")
    selected = _selected(documents, None, weights, share, cap, key, text, source, seed)
    place = F.struct(F.col("_key").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.col("_tie").alias("t"))
    ends = selected.groupBy("source", place.alias("at"), "source_size", "target", "_epochs").agg(F.sum("_part").alias("p"), F.count("*").alias("n"))
    ends = ends.groupBy("source", "source_size", "target", "_epochs").agg(F.max(F.when(F.col("p") > 0, F.struct("at", "p", "n"))).alias("_end"))
    ends = checked(ends.withColumnRenamed("source", "_source"), "ends")
    own = F.struct(_key(quality_weight(F.col(f"`{text}`")), F.col(f"`{key}`"), seed).alias("k"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("t"))
    keep = [c for c in documents.columns if c.lower() not in added]
    # The row is packed, so that columns of any name are safe.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), own.alias("own"))
    met = rows.join(ends, rows["source"].eqNullSafe(F.col("_source")))
    part = F.when(F.col("own") < F.col("_end.at"), F.col("size")).when(F.col("own") == F.col("_end.at"), F.floor(F.col("_end.p") / F.col("_end.n"))).otherwise(F.lit(0)).cast("long")
    met = met.withColumn("_part", F.coalesce(part, F.lit(0).cast("long")))
    found = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    words = F.when(F.col("_part") == 0, "").when(F.col("_part") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(found, 1, F.col("_part").cast("int")), " "))
    taken = (F.col("_epochs") * F.col("size") + F.col("_part")).alias("taken")
    copies = F.when(F.col("size") > 0, F.col("_epochs")).otherwise(F.lit(0)).alias("copies")
    return met.select(*[F.col("row").getField(c).alias(c) for c in keep], "size", "source_size", "target", taken, copies, words.alias("part"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('7/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / greatest(0.05, CASE WHEN length(coalesce(text, '')) > 0 THEN length(regexp_replace(text, '[!-&*+/-9<-@\[-`{-~]+', '', 'g')) / length(text) ELSE 1.0 END) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level
      FROM o WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT level FROM l AS x WHERE level < cap / w ORDER BY cap / w, source NULLS LAST LIMIT 1) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM f),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM c
"""
