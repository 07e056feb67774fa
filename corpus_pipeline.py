"""A training-data pipeline over the documents table, in five written stages.

Each stage takes (spark, documents, sf_dir) and returns a DataFrame, which the caller
writes as Parquet and rereads as the next stage's documents. Every stage works on all
that the stage before kept:

1. toxicity: documents whose score is 0.5 or more go (model fitted on all labels).
2. near_duplicates: of each component of texts with a Jaccard similarity of 0.8 or more
   over five-word shingles, the document with the least id stays; documents without
   words stay.
3. repeated_passages: bytes of 50-byte strings that also start in a document with a
   smaller id are cut from the texts; characters are cut whole, n_chars follows.
4. benchmark: documents of whose words a twentieth or more are benchmark windows go.
5. mix: the documents with the copies and words that the mix takes from each (see mixing.take()).

Stages 1 to 4 return the columns of documents, unchanged but for stage 3's text and
n_chars. Nulls are treated as the operators state; rows with a null id are kept by
stage 2 as they have no id to be told by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm import decontam, mixing, ngram_join, suffix_dedup, toxicity
from echoform.llm._spark import owned, split, written
from echoform.session import ship


def stage(f):
    """A stage: ships the package, and owns its scratch tables until the next stage of the same tables begins, when its result has been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with owned(ship(spark), f"pipeline {sf_dir}"):
            return f(spark, docs, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, held=-1))


@stage
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.link_sets(docs, words=5, per_cent=80)
    # Rows whose id is not their component's least go, told by id and shingles: another text of the same id may stay, as do rows whose id is null or repeats a kept id.
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()
    gone = written(gone, "gone")
    maybe, never = split(docs, "doc_id", gone.select("id"))
    named = ngram_join.with_set_name(maybe, 5).withColumn("id", F.col("row.doc_id").cast("long"))
    return named.join(gone, ["id", "a", "b"], "left_anti").select("row.*").unionByName(never)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.strip(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark", remove_contaminated),
    ("mix", mix_sources),
]

#: Neither the classifier nor the keys of stage 2 and 3's searches can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
