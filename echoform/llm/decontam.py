"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Benchmark items are normalised (A-Z lower-cased; words are runs of ASCII digits,
letters and non-ASCII characters), cut into windows of n words (an item of fewer
words is one window) and hashed, by Spark. Documents are scanned window by window; a
hit is confirmed by comparing the words themselves, and every word inside a confirmed
window is hit. decontaminate() then drops documents, or cuts the hit spans out of them.

Windows of at most max_bytes bytes, once counted, go to every executor as sorted
hashes with their words, and documents are scanned where they lie. A larger benchmark
is broadcast as a filter of fixed size only; the windows of documents that pass it meet
the benchmark's by a join on their hashes, and the hits of each text are joined back by
its SHA-256. So any benchmark is used whole, documents are tokenised once, and nothing
of the benchmark but a bounded set passes through the driver.

Nulls and empty texts have no words and no hits; an item without words is ignored, and
so is an empty benchmark. Items with the same id count as one id (a null id as the
empty one), repeated documents give repeated rows. Texts of any length are used whole.
Extra columns of documents are kept by decontaminate() and ignored by scan().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoform.llm._spark import Membership, checked, written
from echoform.llm._text import ALNUM, LOWER, bytes_of, chunks, ngram_hashes, token_hashes

WORDS = 13
#: Bytes of windows that are broadcast at most.
MAX_BYTES = 32 << 20
_PLACES = np.uint64((1 << 20) - 1)


def words(low: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, size: int) -> bytes:
    return b" ".join(low[start[j] : end[j]].tobytes() for j in range(k, k + size))


def window_table(benchmark: DataFrame, n: int, item: str, text: str, step: int = 20_000) -> DataFrame:
    """(size, hash, words, item): the distinct windows of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, offsets = bytes_of(pa.array([body.as_py()], pa.large_string()))
                tokens, rows, start, end = token_hashes(raw, offsets, ALNUM)
                size, low = min(n, len(tokens)), LOWER[raw]
                hashes, first = ngram_hashes(tokens, rows, size) if size else (tokens, start)
                for c in range(0, len(hashes), step):
                    h, at = hashes[c : c + step].view(np.int64), first[c : c + step].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(h), pa.int32()), pa.array(h), pa.array([words(low, start, end, k, size) for k in at], pa.binary()), pa.array([name] * len(h), pa.string())], ["size", "hash", "words", "item"])

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "size int, hash long, words binary, item string").distinct()


class Windows:
    """Windows as arrays sorted by hash, for each number of words; maps tell most other hashes apart at once."""

    def __init__(self, table: pa.Table):
        self.by_size = {}
        sizes, hashes = table.column("size").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            own = own[np.argsort(hashes[own], kind="stable")]
            seen = np.zeros(1 << 20, bool)
            seen[hashes[own] & _PLACES] = True
            part = table.take(pa.array(own)).combine_chunks()
            self.by_size[size] = hashes[own], part.column("words"), part.column("item"), seen

    def items(self, size: int, h: int, found: bytes) -> list[str]:
        """Items that have a window of these words."""
        hashes, body, item, _ = self.by_size[size]
        i = int(np.searchsorted(hashes, np.uint64(h)))
        out = []
        while i < len(hashes) and int(hashes[i]) == h:
            if body[i].as_py() == found:
                out.append(item[i].as_py())
            i += 1
        return out


def scan_chunk(raw: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]], np.ndarray, np.ndarray, np.ndarray]:
    """(words per row, hit flag per word, items per row, row, start and end of each word)."""
    tokens, rows, start, end = token_hashes(raw, offsets, ALNUM)
    hit = np.zeros(len(tokens), bool)
    items: dict[int, set[str]] = {}
    low = None
    for size, (hashes, _, _, seen) in windows.by_size.items():
        grams, first = ngram_hashes(tokens, rows, size)
        maybe = np.flatnonzero(seen[grams & _PLACES])
        at = np.minimum(np.searchsorted(hashes, grams[maybe]), len(hashes) - 1)
        for j in maybe[hashes[at] == grams[maybe]].tolist():
            low = LOWER[raw] if low is None else low
            k = int(first[j])
            got = windows.items(size, int(grams[j]), words(low, start, end, k, size))
            if got:
                hit[k : k + size] = True
                items.setdefault(int(rows[k]), set()).update(got)
    return np.bincount(rows, minlength=len(offsets) - 1), hit, items, rows, start, end


def _small(benchmark: DataFrame, n: int, item: str, text: str, max_bytes: int) -> tuple[DataFrame, Windows | None]:
    """The benchmark's windows as a written table, and as arrays if they have at most max_bytes bytes."""
    table = written(window_table(benchmark, n, item, text), "windows")
    size = table.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 16)).first()[0] or 0
    return table, Windows(table.toArrow()) if size <= max_bytes else None


def scan(documents: DataFrame, benchmark: DataFrame, n: int = WORDS, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, hits (start and end, in words, of the hit runs) and items (ids of items with occurring windows)."""
    table, small = _small(benchmark, n, item, item_text, max_bytes)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if small is None:
        found = found_by_text(documents, table, text)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = bytes_of(batch.column(1))
                counts = [np.bincount(token_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)[1], minlength=j - i) for i, j in chunks(offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), batch.column(2)], ["doc_id", "n_words", "sha"])

        counted = rows.select("*", sha_of("text").alias("sha")).mapInArrow(count, "doc_id long, n_words long, sha string")
        return counted.join(found, "sha", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<long>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    shared = documents.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column(1))
            counts, hits, found = [], [], []
            for i, j in chunks(offsets):
                n_words, hit, items, _, _, _ = scan_chunk(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value)
                at = np.concatenate([[0], np.cumsum(n_words)])
                counts += n_words.tolist()
                for r in range(j - i):
                    hits.append(runs(hit[at[r] : at[r + 1]]) if r in items else [])
                    found.append(sorted(items.get(r, ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

    return rows.mapInArrow(run, "doc_id long, n_words long, hits array<long>, items array<string>")


def runs(hit: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).tolist()


def sha_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)


def found_by_text(documents: DataFrame, table: DataFrame, text: str) -> DataFrame:
    """(sha, hits, items) of the texts with hits, by a join of windows on their hashes."""
    sizes = [r[0] for r in table.select("size").distinct().orderBy("size").collect()]  # at most as many as a window's words
    known = Membership(table.select("hash"), mixed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column(0))
            for i, j in chunks(offsets):
                part = raw[offsets[i] : offsets[j]]
                tokens, rows, start, end = token_hashes(part, offsets[i : j + 1] - offsets[i], ALNUM)
                at, low = np.searchsorted(rows, np.arange(j - i + 1)), LOWER[part]
                for size in sizes:
                    grams, first = ngram_hashes(tokens, rows, size)
                    keep = np.flatnonzero(known.has(grams.view(np.int64)))
                    if len(keep):
                        k, h = first[keep], grams[keep].view(np.int64)
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows[k] + i)), pa.array(k - at[rows[k]]), pa.array([size] * len(k), pa.int32()), pa.array(h), pa.array([words(low, start, end, x, size) for x in k.tolist()], pa.binary())], ["sha", "at", "size", "hash", "words"])

    texts = documents.select(F.col(text).cast("string").alias("text"), sha_of(text).alias("sha"))
    met = texts.mapInArrow(run, "sha string, at long, size int, hash long, words binary").distinct().join(table, ["size", "hash", "words"])
    spans = met.select("sha", "at", "size").distinct().groupBy("sha").agg(merged(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e")))).alias("hits"))
    items = met.select("sha", "item").distinct().groupBy("sha").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return spans.join(items, "sha")


def merged(spans: Column) -> Column:
    """Union of spans (s, e) as [start, end, start, end, ...]; spans that touch are one run."""
    empty = F.array().cast("array<struct<s:long,e:long>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        F.array_sort(spans), empty, lambda acc, r: F.when((F.size(acc) > 0) & (r["s"] <= last(acc)["e"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], r["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(r)))
    )
    return F.flatten(F.transform(joined, lambda r: F.array(r["s"], r["e"])))


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(F.transform(hits, lambda v, k: F.when(k % 2 == 0, -v).otherwise(v)), F.lit(0).cast("long"), lambda a, v: a + v)


def report(scanned: DataFrame) -> DataFrame:
    """The hits of scan() as counts; contaminated: a twentieth of the words or more are hit."""
    out = scanned.withColumn("n_hit", n_hit())
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _cut(part: np.ndarray, start: np.ndarray, end: np.ndarray, edges: list[int]) -> str:
    """A text without the bytes of its hit words' runs; edges as runs() has them."""
    out = np.ones(len(part), bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out[start[a] : end[b - 1]] = False
    return part[out].tobytes().decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WORDS, text: str = "text", item: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """documents without the contaminated ones (mode "documents"), or with their hit spans cut out (mode "spans").

    A document is contaminated if a twentieth of its words or more are hit; others stay as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    table, small = _small(benchmark, n, item, item_text, max_bytes)
    column = documents.columns.index(text)
    if small is None:
        return _decontaminate_by_text(documents, table, mode, text, column)
    shared = documents.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column(column))
            keep, texts = [], {}
            for i, j in chunks(offsets):
                part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n_words, hit, _, rows, start, end = scan_chunk(part, own, shared.value)
                hits = np.bincount(rows[hit], minlength=j - i)
                bad = (hits > 0) & (20 * hits >= n_words)
                keep += (~bad).tolist()
                if mode == "spans":
                    for r in np.flatnonzero(bad).tolist():
                        mine = np.flatnonzero(rows == r)
                        texts[i + r] = _cut(part[own[r] : own[r + 1]], start[mine] - own[r], end[mine] - own[r], runs(hit[mine]))
            if mode == "documents":
                yield batch.filter(pa.array(keep, pa.bool_()))
            elif texts:
                new = [texts.get(k, v.as_py()) for k, v in enumerate(batch.column(column))]
                yield batch.set_column(column, batch.schema.field(column), pa.array(new, batch.schema.field(column).type))
            else:
                yield batch

    return documents.mapInArrow(run, documents.schema)


def _decontaminate_by_text(documents: DataFrame, table: DataFrame, mode: str, text: str, column: int) -> DataFrame:
    """decontaminate() for a large benchmark: the texts with hits meet the documents by SHA-256."""
    found = checked(found_by_text(documents, table, text).select("sha", "hits"), "hits", 20_000)
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), sha_of(text).alias("sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, new = [], []
            for body, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if edges:
                    raw = np.frombuffer(body.encode(), np.uint8)
                    _, _, start, end = token_hashes(raw, np.array([0, len(raw)]), ALNUM)
                    bad = 20 * (sum(edges[1::2]) - sum(edges[::2])) >= len(start)
                    body = _cut(raw, start, end, edges) if bad and mode == "spans" else body
                    keep.append(mode == "spans" or not bad)
                else:
                    keep.append(True)
                new.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column(2)], ["text", "row"]).filter(pa.array(keep, pa.bool_()))

    met = packed.join(found, "sha", "left").select(F.col("row").getField(text).cast("string").alias("body"), "hits", "row")
    done = met.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), packed.schema["row"]]))
    return done.select(*[(F.col("text").cast(documents.schema[c].dataType) if k == column else F.col("row").getField(c)).alias(c) for k, c in enumerate(documents.columns)])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dw.n, k FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
