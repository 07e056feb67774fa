"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (the pieces between line feeds, empty ones
too). Each paragraph hashes to a wide vector, and a fingerprint is the sum of these
vectors, lane by lane, modulo powers of two. So the order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts:
- EXACT lanes of 64 bits, a BLAKE2b digest of the paragraph's bytes as wide as all of
  them, added modulo 2**64, that tell multisets apart;
- LIKE lanes added modulo 2**32, in which each run of three words of the paragraph
  (or all its words, if fewer) counts +1 or -1 in a lane chosen by its hash. Inner
  products of these lanes estimate how many such runs two texts share, from which
  likeness() takes the Dice coefficient, held to 0..1.

Equal texts have equal fingerprints and likeness 1. A null text is empty; the empty
text is one empty paragraph. Texts of any length are used whole. Repeated rows give
repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm._spark import shuffle_partitions
from echoform.llm._text import SPACE, bytes_of, chunks, ngram_hashes, row_of, token_hashes

EXACT, LIKE, RUN = 8, 512, 3
WIDTH = EXACT * 8 + LIKE * 4
#: Bytes of text in a part, about. Workers stream a part, so that memory does not bound it.
PART_BYTES = 64 << 20
LEAST_ID = -(1 << 63)
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True


def vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact lanes, like lanes) of every row."""
    n = len(offsets) - 1
    exact, like = np.zeros((n, EXACT), np.uint64), np.zeros((n, LIKE), np.uint32)
    feeds = np.flatnonzero(_LINE[raw])
    start = np.concatenate([offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(n), row_of(feeds, offsets)])
    order = np.lexsort((start, owner))  # a text's last paragraph may be empty and start where the next text does
    end = np.concatenate([offsets[1:], feeds])
    start, end, owner = start[order], end[np.lexsort((end, owner))], owner[order]
    body = raw.tobytes()
    wide = b"".join([hashlib.blake2b(body[a:b], digest_size=8 * EXACT).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    lanes = np.frombuffer(wide, "<u8").reshape(len(start), EXACT)
    at = np.searchsorted(owner, np.arange(n + 1))
    total = np.zeros((len(start) + 1, EXACT), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(lanes, axis=0, out=total[1:])
        exact[:] = total[at[1:]] - total[at[:-1]]
    tokens, _, begin, _ = token_hashes(raw, offsets, ~SPACE, lower=False)
    line = np.searchsorted(start, begin, "right") - 1
    grams, first = ngram_hashes(tokens, line, RUN)
    lines = line[first]
    # Lines of fewer words than a run count as one run.
    size = np.bincount(line, minlength=len(start))
    token_at = np.concatenate([[0], np.cumsum(size)])
    for m in range(1, RUN):
        few = np.flatnonzero(size == m)
        if len(few):
            own = np.concatenate([tokens[token_at[few] + k] for k in range(m)]).reshape(m, -1).T.ravel()
            grams = np.concatenate([grams, ngram_hashes(own, np.repeat(np.arange(len(few)), m), m)[0]])
            lines = np.concatenate([lines, few])
    lane = owner[lines] * LIKE + (grams % np.uint64(LIKE)).astype(np.int64)
    sign = (grams >> np.uint64(63)).astype(np.int64) * 2 - 1
    like += np.bincount(lane, sign, n * LIKE).astype(np.int64).astype(np.uint32).reshape(n, LIKE)
    return exact, like


def fingerprint(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _bytes(*vectors(raw, np.array([0, len(raw)])))[0]


def _bytes(exact: np.ndarray, like: np.ndarray) -> list[bytes]:
    both = np.concatenate([exact.view(np.uint8).reshape(len(exact), -1), like.view(np.uint8).reshape(len(like), -1)], axis=1)
    return [row.tobytes() for row in both]


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """a with b's paragraphs inserted (sign 1) or deleted (sign -1)."""
    cut = EXACT * 8
    x, y = np.frombuffer(a, np.uint64, EXACT), np.frombuffer(b, np.uint64, EXACT)
    p, q = np.frombuffer(a, np.uint32, LIKE, cut), np.frombuffer(b, np.uint32, LIKE, cut)
    with np.errstate(over="ignore"):
        return (x + y).tobytes() + (p + q).tobytes() if sign > 0 else (x - y).tobytes() + (p - q).tobytes()


def likeness(exact_a: np.ndarray, like_a: np.ndarray, exact_b: np.ndarray, like_b: np.ndarray) -> np.ndarray:
    """Row by row: 1 for equal fingerprints, else twice the inner product over the sum of squares, held to 0..1."""
    a, b = like_a.view(np.int32).astype(np.float64), like_b.view(np.int32).astype(np.float64)
    both = (a * a).sum(1) + (b * b).sum(1)
    out = np.clip(2 * (a * b).sum(1) / np.where(both > 0, both, 1), 0, 1)
    return np.where((exact_a == exact_b).all(1) & (like_a == like_b).all(1), 1.0, out)


def with_next(documents: DataFrame, key: str, text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (part, doc_id, text, ahead), sorted, so that each document's next one follows it in its part.

    Parts are ranges of ids with about part_bytes bytes of text. The first document of
    each part is also sent to the part before it, as its last row (ahead); the very
    first one to the last part. Only two numbers for each part go to the driver and
    back. Rows that share an id, or have none, are ordered by text and lie in one part.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), size // part_bytes)
    cuts = np.array(sorted(set(rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) or [])), np.int64)
    known = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known.value, ids.to_numpy(np.int64), "right").astype(np.int32))

    ids = F.coalesce("doc_id", F.lit(LEAST_ID))
    least = rows.select(ids.alias("id")).groupBy(part_of("id").alias("part")).agg(F.min("id").alias("id")).toArrow().sort_by("part")
    order, first = least.column("part").to_numpy(), least.column("id").to_numpy()
    firsts = spark.sparkContext.broadcast((first, np.roll(order, 1)))

    @F.pandas_udf("int")
    def before(ids: pd.Series) -> pd.Series:
        """The part before the one that this id is the least of."""
        starts, into = firsts.value
        at = np.minimum(np.searchsorted(starts, ids.to_numpy(np.int64)), len(starts) - 1)
        return pd.Series(np.where(starts[at] == ids.to_numpy(np.int64), into[at], -1).astype(np.int32))

    dealt = rows.select("*", part_of(ids).alias("_part"), before(ids).alias("_before"))
    copies = F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("ahead")), F.when(F.col("_before") >= 0, F.struct(F.col("_before").alias("part"), F.lit(True).alias("ahead"))))
    sent = dealt.select("doc_id", "text", F.explode(F.array_compact(copies)).alias("_to"))
    sent = sent.select(F.col("_to.part").alias("part"), F.col("_to.ahead").alias("ahead"), "doc_id", "text")
    return sent.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(documents: DataFrame, key: str = "doc_id", text: str = "text", quarter: int = 4, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses.

    The edited text has its last n_chars // quarter code points replaced by the first
    as many of the next document (in order of id, after the last the first; ids that
    are null come first, equal ids are ordered by text). A single document is its own next.
    """

    def flush(held: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in held]
        after = [*texts[1:], following]
        edited = [t[: len(t) - len(t) // quarter] + s[: len(t) // quarter] for t, s in zip(texts, after, strict=True)]
        exact, like = _batched([*texts, following])
        exact_e, like_e = _batched(edited)
        code = lambda x, y: [base64.b64encode(f).decode() for f in _bytes(x, y)]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([d for d, _ in held], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": code(exact[:-1], like[:-1]), "edited_fingerprint": code(exact_e, like_e),
            "near_edited": likeness(exact[:-1], like[:-1], exact_e, like_e), "near_next": likeness(exact[:-1], like[:-1], exact[1:], like[1:]),
        })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, done = None, [], 0, False
        for batch in batches:
            for p, a, d, t in zip(*(batch.column(k) for k in range(4)), strict=True):
                p, a, d, t = p.as_py(), a.as_py(), d.as_py(), t.as_py()
                if p != part:
                    part, held, size, done = p, [], 0, False
                if done:
                    continue
                if held and (a or size > 1 << 22):
                    yield flush(held, t)
                    held, size = [], 0
                if a:
                    done = True  # only the first of the rows ahead follows
                else:
                    held.append((d, t))
                    size += len(t)

    return with_next(documents, key, text, part_bytes).select("part", "ahead", "doc_id", "text").mapInArrow(work, RESULT)


def _batched(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = bytes_of(pa.array(texts, pa.large_string()))
    got = [vectors(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
    return np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
