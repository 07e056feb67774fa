"""Scratch tables of runs, columns with clashing names, filters by size, and independent fingerprint lanes."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from echoform.llm import decontam, fingerprints, mixing, suffix_dedup
from echoform.llm._spark import Membership, owned, split, written

NAMES = ("row", "key", "at", "a", "b", "id", "_id", "_own", "_part", "_end", "_source", "_sha", "_hits", "own", "size_", "sha", "hits", "_name_a", "_name_b", "__at")


def clashing(spark, rows):
    """Documents with a string column for each name that is used somewhere inside."""
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    for n in NAMES:
        out = out.withColumn(n, F.lit(f"own {n}"))
    return out


def some_rows():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{int(v)}" for v in rng.integers(0, 500, 60)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    return [*rows, (20, texts[0], "en", "s0", 1), (21, texts[1] + " more", "en", "s1", 1), (None, None, "en", None, None), (22, "", "en", "s0", 0)]


def test_tables_of_other_runs_stay(spark):
    kept = written(spark.range(5).toDF("x"), "alone")
    with owned(spark, "one"):
        first = written(spark.range(6).toDF("x"), "one")
    with owned(spark, "two"):
        second = written(spark.range(7).toDF("x"), "two")
    assert (kept.count(), first.count(), second.count()) == (5, 6, 7)
    with owned(spark, "one"):
        pass
    assert (kept.count(), second.count()) == (5, 7)
    gone = spark.read.schema("x long").parquet
    path = first.inputFiles()[0] if first.inputFiles() else ""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) and gone


def test_stages_and_operators_take_any_column_names(spark, tmp_path):
    import corpus_pipeline

    rows = some_rows()
    docs = clashing(spark, rows)
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, step in corpus_pipeline.STAGES[1:]:
        got = written(step(spark, docs, str(tmp_path)), name)
        assert got.count() > 0 and set(NAMES) <= set(got.columns), name
        assert all(r[n] == f"own {n}" for r in got.collect() for n in NAMES), name
        if name != "mix":
            assert got.columns == docs.columns
            docs = got
    ids = {r["doc_id"] for r in docs.collect()}
    assert 20 not in ids and 21 not in ids and 3 not in ids and {0, 1, 2, None, 22} <= ids
    # A benchmark too large to broadcast meets the documents by a join.
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    for mode in ("documents", "spans"):
        small, large = (sorted(map(str, decontam.decontaminate(clashing(spark, rows), bench, mode=mode, max_bytes=m).collect())) for m in (1 << 20, 0))
        assert small == large
    assert mixing.take(clashing(spark, rows)).count() == len(rows) and suffix_dedup.strip(clashing(spark, rows)).count() == len(rows)


def test_filters_grow_with_their_ids(spark):
    few, many = Membership(spark.range(10).toDF("x")), Membership(spark.range(1_500_000).toDF("x"))
    assert few.bits == 23 and many.bits == 24
    maybe, never = split(spark.range(0, 4000).select("id", F.lit("v").alias("key"), F.lit(1).alias("at")), "id", spark.range(10).toDF("x"))
    assert maybe.count() + never.count() == 4000 and {r["id"] for r in maybe.collect()} >= set(range(10)) and maybe.count() < 100 and never.columns == ["id", "key", "at"]


def test_exact_lanes_are_as_wide_as_they_look():
    lines = ["", "a", "a b c", "ü" * 50, "a"]
    got = np.frombuffer(fingerprints.fingerprint("\n".join(lines)), np.uint64, fingerprints.EXACT)
    want = np.zeros(fingerprints.EXACT, np.uint64)
    for line in lines:
        want += np.frombuffer(hashlib.blake2b(line.encode(), digest_size=64).digest(), "<u8")
    assert (got == want).all()
    raw = "\n".join(f"line {k}" for k in range(4000)).encode()
    cuts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    exact, _ = fingerprints.vectors(np.frombuffer(raw.replace(b"\n", b""), np.uint8), np.concatenate([[0], cuts - np.arange(len(cuts)), [len(raw) - len(cuts)]]))
    bits = np.unpackbits(exact.view(np.uint8), axis=1).astype(float)
    assert np.abs(np.corrcoef(bits.T) - np.eye(512)).max() < 0.12  # no lane tells another
