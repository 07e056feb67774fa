"""Alignment of two tokenizers over a corpus: which ids of A and B cover the same bytes, and in how many documents.

A text with a space before it is encoded by A (byte-level BPE) and B (pieces with byte
fallback). Where tokens of both end at the same byte the text is cut into groups; every
A token and every B token of a group are linked. A pair's count is the number of
documents (rows) that hold it linked.

Identity-map fast path: an array gives for each A id the B id with the same bytes. Pairs
of that map are nearly all one-to-one groups, and are counted in a vector as long as
A's vocabulary, in each task; only the pairs of irregular groups enter the shuffle, once
for each Arrow batch and pair. A pair of the map that an irregular group links as well
counts once in a document.

Texts are encoded once, word by word with a memory of words met before where the
vocabularies allow it (Pair.by_words). Ids are written as two or four bytes each, and both
passes, that which counts and that which looks counts up, cut the groups anew from the
lengths of the tokens. The look-up has the map's counts as a vector, and the counts of the most frequent
other pairs as a broadcast of at most MOST_PAIRS pairs; rarer ones, each in few documents,
meet their documents in a join by pair, so no frequent pair gathers in a task.

Nulls and empty texts have no tokens: zeros, and '' as their digest; so have texts that a
tokenizer does not give back byte by byte (U+2581 in the text, for B). Special tokens'
strings are plain text. Rows with the same or null ids keep apart. A long text counts
whole: a worker holds its tokens and its distinct pairs. Pairs of a group are made from
its distinct ids, so long runs that never meet stay small. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm._spark import written

FOLDER = "/opt/tokenizers"
#: Pairs whose counts are broadcast, 16 bytes each.
MOST_PAIRS = 1_000_000
#: Tokens of A that are worked on together, one document at least.
TOKENS = 200_000
#: Short words whose ids a worker keeps, twice.
WORDS = 150_000
_WORDS = re.compile(r"(?<=\S) ")
_ID = np.int64(1) << np.int64(32)


def byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible Latin-1 characters are themselves, other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, a: bytes, b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        table, vocabulary = byte_level(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        by_bytes = {t: i for i, t in enumerate(self.b_bytes) if self.b.is_byte(i)}
        by_bytes |= {t: i for i, t in enumerate(self.b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([by_bytes.get(t, -1) for t in self.a_bytes], np.int64)
        self.a_length, self.b_length = (np.array([len(t) for t in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_kind, self.b_kind = (np.uint16 if len(v) <= 1 << 16 else np.uint32 for v in (self.a_bytes, self.b_bytes))
        self._known: dict[str, tuple[bytes, bytes] | None] = {}
        self._by_words: bool | None = None
        self._space = self.b.piece_to_id("▁")
        self._older: dict[str, tuple[bytes, bytes] | None] = {}

    @property
    def words(self) -> tuple[np.ndarray, ...]:
        """Ids as text after each separator: A's after `,` and `;`, B's after `,` and `|`."""
        if not hasattr(self, "_words"):
            self._words = tuple(np.array([f"{s}{i}" for i in range(len(v))], object) for v, s in ((self.a_bytes, ","), (self.a_bytes, ";"), (self.b_bytes, ","), (self.b_bytes, "|")))
        return self._words

    @property
    def by_words(self) -> bool:
        """Whether both tokenizers cut a text between a character that is no white space and a space, whatever is around.

        A does if it splits by its byte-level expression, whose tokens have a space in
        front only; B does if no piece has a space after another character, as then no
        merge crosses such a place.
        """
        if self._by_words is None:
            told = json.loads(self.a.to_str())
            split = told["pre_tokenizer"] or {}
            a = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            self._by_words = bool(a) and not any(b" " in t.lstrip(b" ") for t in self.b_bytes)
        return self._by_words

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of A and B for each text with a space before it; None where it doesn't come back."""
        wholes = [(" " + t).encode() for t in texts]
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = [ids or [self._space] for ids in self.b.encode(texts, num_threads=1)]  # no text is no token for B, but a space here
        whole, fine = b"".join(wholes), [True] * len(texts)
        packed = []
        for ids, table, kind in ((a, self.a_bytes, self.a_kind), (b, self.b_bytes, self.b_kind)):
            flat = list(chain.from_iterable(ids))
            if b"".join(map(table.__getitem__, flat)) != whole:
                fine = [f and b"".join(map(table.__getitem__, x)) == w for f, x, w in zip(fine, ids, wholes, strict=True)]
            data, size, at, own = np.array(flat, kind).tobytes(), kind().itemsize, 0, []
            for x in ids:
                own.append(data[at : (at := at + size * len(x))])
            packed.append(own)
        return [v if f else None for f, v in zip(fine, zip(*packed, strict=True), strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of A and B for each text; empty where there is no text or it doesn't come back.

        Where by_words holds, words are looked up among those met before in this worker:
        those since the memory was last full, and those before that.
        """
        if not self.by_words:
            return [(v if t and v else (b"", b"")) for t, v in zip(texts, self._encoded(texts), strict=True)]
        if len(self._known) > WORDS:
            self._known, self._older = {}, self._known
        known, older, out = self._known, self._older, []
        parts = [_WORDS.split(t) if t else [] for t in texts]
        new = set().union(*parts).difference(known)
        known.update((w, older[w]) for w in new & older.keys())
        new = list(new.difference(known))
        known.update(zip(new, self._encoded(new), strict=True))
        for own in parts:
            ids = [known[w] for w in own]
            out.append((b"", b"") if None in ids else (b"".join([x for x, _ in ids]), b"".join([y for _, y in ids])))
        for w in new:
            if len(w) > 32:
                del known[w]
        return out


@lru_cache(maxsize=2)
def _pair(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


def loaded(shared: Broadcast) -> Pair:
    """The tokenizers of a broadcast, made once in each worker."""
    return _pair(*shared.value)


@dataclass
class Cut:
    """Documents cut into groups. Tokens and groups of all of them follow each other; ids, groups and documents are arrays."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_many: np.ndarray  # tokens of A in each group
    b_many: np.ndarray
    document: np.ndarray  # of each group
    count: int  # documents

    @classmethod
    def of(cls, pair: Pair, a: list[bytes], b: list[bytes]) -> Cut:
        x, y = (np.frombuffer(b"".join(v), kind).astype(np.int64) for v, kind in ((a, pair.a_kind), (b, pair.b_kind)))
        # Both sides have the same bytes in each document, so the ends of all documents line up.
        a_end, b_end = np.cumsum(pair.a_length[x]), np.cumsum(pair.b_length[y])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        at = np.cumsum([len(v) // pair.a_kind().itemsize for v in a])
        last = np.concatenate([[0], a_end])[at]
        return cls(x, y, a_group, b_group, np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends)), np.searchsorted(last, ends), len(a))

    def links(self, pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, a, b, times): the distinct linked pairs of each document and their token pairs."""
        one = (self.a_many == 1) & (self.b_many == 1)
        a_one, b_one = self.a[one[self.a_group]], self.b[one[self.b_group]]
        # Irregular groups: distinct ids of each side with their numbers, then every one of A with every one of B.
        sides = []
        for ids, group in ((self.a, self.a_group), (self.b, self.b_group)):
            odd = ~one[group]
            key, times = np.unique(group[odd] * _ID + ids[odd], return_counts=True)
            sides.append((key >> 32, key & (_ID - 1), times))
        (ga, ia, ta), (gb, ib, tb) = sides
        first, many = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right") - np.searchsorted(gb, ga, "left")
        left = np.repeat(np.arange(len(ga)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        # One number for document, a and b: rows of a batch and ids of vocabularies leave bits to spare.
        bits_b = len(pair.b_bytes).bit_length()
        bits = bits_b + len(pair.a_bytes).bit_length()
        key = np.concatenate([(self.document[one] << bits) + (a_one << bits_b) + b_one, (self.document[ga[left]] << bits) + (ia[left] << bits_b) + ib[right]])
        times = np.concatenate([np.ones(len(a_one), np.int64), ta[left] * tb[right]])
        order = np.argsort(key)
        key, times = key[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key = key[new]
        return key >> bits, (key & ((1 << bits) - 1)) >> bits_b, key & ((1 << bits_b) - 1), np.add.reduceat(times, new) if len(new) else times

    def texts(self, pair: Pair) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document."""
        a_comma, a_next, b_comma, b_next = pair.words
        out = np.empty(len(self.a) + len(self.b), object)
        a_before, b_before = (np.cumsum(v) - v for v in (self.a_many, self.b_many))
        starts = lambda group: np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
        for ids, group, place, comma, other in (
            (self.a, self.a_group, np.arange(len(self.a)) + b_before[self.a_group], a_comma, a_next),
            (self.b, self.b_group, np.arange(len(self.b)) + (a_before + self.a_many)[self.b_group], b_comma, b_next),
        ):
            out[place] = np.where(starts(group), other[ids], comma[ids])
        many = np.bincount(self.document, self.a_many + self.b_many, self.count).astype(np.int64) if len(self.document) else np.zeros(self.count, np.int64)
        ends = np.cumsum(many)
        return ["".join(out[e - m : e])[1:] for e, m in zip(ends.tolist(), many.tolist(), strict=True)]


def _chunks(pair: Pair, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Cut]]:
    """(first row, row after the last, their cut) of a batch whose first two columns are the ids of A and B."""
    a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    i = 0
    while i < len(a):
        j, held = i, 0
        while j < len(a) and (j == i or held + len(a[j]) <= TOKENS * pair.a_kind().itemsize):
            held += len(a[j])
            j += 1
        yield i, j, Cut.of(pair, a[i:j], b[i:j])
        i = j


@dataclass
class Alignment:
    """documents: the counts of each row; pairs: a_id, b_id, documents (its count), best (whether no pair of its a_id has more)."""

    documents: DataFrame
    pairs: DataFrame


def _best(counts: DataFrame, size: int) -> np.ndarray:
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[top.column("a").to_numpy()] = top.column("n").to_numpy()
    return out


def _heavy(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs have so large a count."""
    rise = counts.where("not fast").groupBy(F.floor(F.log2("n") + 1e-12).alias("k")).count().collect()
    held, floor = 0, 0
    for r in sorted(rise, key=lambda r: -r["k"]):
        held += r["count"]
        if held > most:
            floor = r["k"] + 1
            break
    return 1 << floor if floor else 0


def align(documents: DataFrame, a_file: str = f"{FOLDER}/byte_bpe_50k.json", b_file: str = f"{FOLDER}/piece_bpe_32k.model", key: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS) -> Alignment:
    """Align the tokenizers of two vocabulary files (read by the driver and broadcast, some MB) over documents."""
    spark = documents.sparkSession
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    own = loaded(shared)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(shared)
        for batch in batches:
            texts, ids, i = batch.column(2), [], 0
            lengths = np.cumsum(texts.cast(pa.large_binary()).fill_null(b"").to_pandas().map(len).to_numpy()) if len(texts) else []
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(lengths, (lengths[i - 1] if i else 0) + (1 << 20), "right")))
                ids += pair.encode(["" if t is None else t for t in texts[i:j].to_pylist()])
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([v[k] for v in ids], pa.binary()) for k in (0, 1)]], ["row", "key", "a", "b"])

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    tokens = written(rows.mapInArrow(encode, "row long, key long, a binary, b binary"), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(shared)
        vector = np.zeros(len(pair.same), np.int64)
        rows = lambda keys, n, fast: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(np.full(len(keys), fast))], ["pair", "n", "fast"])
        for batch in batches:
            for _, _, cut in _chunks(pair, batch):
                _, a, b, _ = cut.links(pair)
                fast = pair.same[a] == b
                vector += np.bincount(a[fast], minlength=len(vector))
                yield rows(*np.unique(a[~fast] * _ID + b[~fast], return_counts=True), False)
        seen = np.flatnonzero(vector)
        yield rows(seen * _ID + pair.same[seen], vector[seen], True)

    partial = tokens.select("a", "b").mapInArrow(count, "pair long, n long, fast boolean")
    counts = written(partial.groupBy("pair", "fast").agg(F.sum("n").alias("n")), "pairs")
    best = _best(counts, len(own.same))
    identity = np.zeros(len(own.same), np.int64)
    found = counts.where("fast").toArrow()  # at most a row for each id of A
    identity[found.column("pair").to_numpy() >> 32] = found.column("n").to_numpy()
    floor = _heavy(counts, most_pairs)
    frequent = counts.where(~F.col("fast") & (F.col("n") >= floor)).select("pair", "n").toArrow()
    order = np.argsort(frequent.column("pair").to_numpy())
    known = spark.sparkContext.broadcast((best, identity, frequent.column("pair").to_numpy()[order], frequent.column("n").to_numpy()[order]))

    fields = [("row", pa.int64()), ("key", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(shared)
        best, identity, keys, counted = known.value
        for batch in batches:
            for i, j, cut in _chunks(pair, batch):
                document, a, b, times = cut.links(pair)
                key, n, m = a * _ID + b, np.zeros(len(a), np.int64), j - i
                fast = pair.same[a] == b
                n[fast] = identity[a[fast]]
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = (keys[at] == key) & ~fast if len(keys) else np.zeros(len(key), bool)
                n[hit] = counted[at[hit]]
                rare = ~(fast | hit)
                sums = lambda rows, weight: np.array([0] * m) if not len(rows) else _sums(rows, weight, m)
                texts = cut.texts(pair)
                n_a = np.array([len(v) for v in batch.column(0)[i:j].to_pylist()], np.int64) // pair.a_kind().itemsize
                n_b = np.array([len(v) for v in batch.column(1)[i:j].to_pylist()], np.int64) // pair.b_kind().itemsize
                offsets = pa.array(np.searchsorted(document[rare], np.arange(m + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[rare])) for v in (key, times)]
                columns = [
                    batch.column(2)[i:j], batch.column(3)[i:j], pa.array(n_a), pa.array(n_b), pa.array(np.bincount(cut.document, minlength=m).astype(np.int64)), pa.array(sums(cut.document, cut.a_many * cut.b_many)),
                    pa.array(sums(document, times * (n == best[a]))), pa.array(sums(document, times * n)), pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]), *lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = tokens.select("a", "b", "row", "key").mapInArrow(look_up, "row long, key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>, times array<long>")
    tops = spark.createDataFrame(pa.table({"a_id": np.flatnonzero(best), "most": best[best > 0]})).select(F.col("a_id").cast("long"), F.col("most").cast("long")) if best.any() else spark.createDataFrame([], "a_id long, most long")
    judged = counts.withColumn("a_id", F.shiftright("pair", 32)).join(F.broadcast(tops), "a_id")  # a row for each id of A
    if floor:
        out = _with_rare(written(out, "aligned"), judged.where(~F.col("fast") & (F.col("n") < floor)))
    pairs = judged.select("a_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), F.col("n").alias("documents"), (F.col("n") == F.col("most")).alias("best"))
    return Alignment(out.select(F.col("key").alias(key), *[c for c, _ in fields[2:9]]), pairs)


def _sums(rows: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """Sums of whole numbers by row (rows ascend), exact beyond 2 ** 53."""
    total = np.concatenate([[0], np.cumsum(weight)])
    at = np.searchsorted(rows, np.arange(m + 1))
    return total[at[1:]] - total[at[:-1]]


def _with_rare(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """Rows with the counts of their rare pairs added, by a join on the pair."""
    met = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("l")).select("row", F.col("l.rare").alias("pair"), F.col("l.times").alias("times")).join(rare, "pair")
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("_best"))
    joined = rows.join(more, "row", "left")
    return joined.withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0))).withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents
