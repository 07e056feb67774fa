"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL expands into the expressions that a rule could have: every host suffix
with as many labels as some rule, followed by every path prefix as long as some
rule's path. Expressions meet the rules by an equi-join on the first four bytes of
their SHA-256; the full digest then confirms, and of the rules that fit, the longest
wins. A page that no rule fits gets the default verdict.

Nulls: a null url, or one without "://", has empty host and path, fits no rule and
gets the default. Repeated rows give repeated results. Extra columns pass through
under their names; a column named like a result column, in whatever case, is replaced by it.
Ties: of rules that fit and are equally long, the greatest text wins, and of one rule with
several verdicts the greatest verdict ("block" over "allow"). URLs of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many are broadcast; more are left to an ordinary shuffle join.
BROADCAST_RULES = 50_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict."""
    spark: SparkSession = pages.sparkSession
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    own = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("none"))
    base = pages.select(F.monotonically_increasing_id().alias("_row"), own.alias("_own"), host_of(F.col(f"`{url}`")).alias("_host"), path_of(F.col(f"`{url}`")).alias("_path"))
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    table = spark.createDataFrame([(r.text, r.verdict, len(r.text)) for r in dict.fromkeys(rules)], "rule string, verdict string, size int")
    table = table.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, 8))
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    dots = F.split("_host", r"\.")
    suffixes = F.array_distinct(F.array(*[F.when(F.size(dots) >= n, F.concat_ws(".", F.slice(dots, F.greatest(F.size(dots) - n + 1, F.lit(1)), n))) for n in labels])) if labels else F.array(F.lit(""))
    prefixes = F.array_distinct(F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths])) if lengths else F.array(F.lit(""))
    pairs = F.flatten(F.transform(F.array_compact(suffixes), lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, p))))
    expressions = base.withColumn("_expr", F.explode_outer(pairs)).withColumn("_digest", F.sha2("_expr", 256)).withColumn("_short", F.substring("_digest", 1, 8))
    met = expressions.join(table, F.col("_short") == F.col("short"), "left")
    fits = F.col("_digest") == F.col("digest")
    best = met.groupBy("_row").agg(
        F.first("_own").alias("_own"), F.first("_host").alias("host"), F.first("_path").alias("path"), F.max(F.when(fits, F.struct("size", F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))).alias("_best")
    )
    return best.select(*[F.col("_own")[c].alias(c) for c in keep], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).drop("url")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT p.*, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
