"""Removal of passages that repeat across documents, by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with
a smaller id; strings are judged on the input. Sorting all suffixes of all texts is out
of reach, so the sort is brought down to the suffixes that can matter, without loss:

1. Copies. Equal texts are found by SHA-256; those after the first go whole, and the
   first stands for all of them.
2. Anchors. Of the GRAM-byte strings in each window of LENGTH bytes the one with the
   least hash is its anchor. Equal windows have equal anchors, so only windows whose
   anchor occurs in two distinct texts or more can repeat. Anchor hashes go to buckets
   as packed arrays, once for each distinct text of a partition, and come back only
   if shared. (Common passages give one row for each text that has them; nothing is
   paired.)
3. Suffix sort. Each shared anchor brings the few bytes that its windows span. Equal
   pieces become one, with the least id that has it. Where an anchor has several
   distinct pieces, the suffixes at its windows are sorted by merging: ranks in the
   other run by binary search, all elements at once, and each comparison of two
   suffixes by a binary search for their common extension over prefix polynomial
   hashes, so that it takes a logarithm of LENGTH steps. Neighbours that agree in
   LENGTH bytes are compared byte by byte, so a collision of hashes is found, and the
   suffixes concerned are then sorted by their bytes.
4. Spans. Windows whose class has a smaller id give spans, which are merged per
   document and cut from its bytes.

Texts move only where they have shared anchors. A null text is empty, a null id counts
as larger than all others, and rows that share an id don't remove each other's bytes.
Texts of fewer than LENGTH bytes lose nothing. Extra columns are ignored by report()
and kept by strip().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoform.llm._spark import Membership, bucket_bits, pack, per_bucket, split, unpack, written
from echoform.llm._text import BYTE, bytes_of, chunks, powers, prefix_hash, row_of, splitmix

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # places of a GRAM in a window
_TOP = np.uint64((1 << 64) - 1)
LAST = (1 << 63) - 1


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every width neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(raw: np.ndarray, offsets: np.ndarray, windows: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of the anchors; windows are given by their first bytes."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none
    prefix = prefix_hash(BYTE[raw])
    _, down = powers(n)
    with np.errstate(over="ignore"):
        value = splitmix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    ends = offsets[1:]
    good = np.ones(n - LENGTH + 1, bool)  # windows inside one text
    for e in ends[:-1].tolist():
        good[max(0, e - LENGTH + 1) : e] = False
    least = _sliding(value, SPAN, np.minimum)
    # An anchor of some good window: the most of the least values of the windows around it is its own.
    padded = np.zeros(len(value) + SPAN - 1, np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(least)] = np.where(good, least, np.uint64(0))
    at = np.flatnonzero((_sliding(padded, SPAN, np.maximum) == value) & (value > 0))
    if not windows:
        return value[at], at, none, none
    # Its windows: good ones near it whose least value is its own; they lie side by side.
    mine = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[at] == value[at][:, None]
    first = at - SPAN + 1 + mine.argmax(1)
    last = at - mine[:, ::-1].argmax(1)
    return value[at], at, first, last


def text_table(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_bytes, sha) of every row."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return documents.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))


def _short(sha) -> int:
    """The first 60 bits of a digest."""
    return int(sha.hexdigest()[:15], 16)


def _text_id(body: bytes) -> int:
    return _short(hashlib.sha256(body))


TEXT_ID = "cast(conv(substring(sha, 1, 15), 16, 10) as long)"


def anchor_blobs(documents: DataFrame, bits: int, text: str) -> DataFrame:
    """(bucket, blob) with the distinct anchors of the distinct texts of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            raw, offsets = bytes_of(batch.column(0))
            data = memoryview(np.ascontiguousarray(raw))
            ids, fresh = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                sha = hashlib.sha256(data[a:b])
                ids.append(_short(sha))
                fresh.append(b - a >= LENGTH and sha.digest() not in seen)
                seen.add(sha.digest())
            ids, fresh = np.array(ids, np.int64), np.array(fresh, bool)
            held, owner, total = [], [], 0
            for i, j in chunks(offsets):
                h, at, _, _ = anchors(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], windows=False)
                own = row_of(at, offsets[i : j + 1] - offsets[i]) + i
                keep = fresh[own]
                held.append(h[keep])
                owner.append(own[keep])
                total += len(held[-1])
                if total > 1 << 21:
                    yield _anchor_batch(np.concatenate(held), np.concatenate(owner), ids, bits)
                    held, owner, total = [], [], 0
            if total:
                yield _anchor_batch(np.concatenate(held), np.concatenate(owner), ids, bits)

    return documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, blob binary")


def _anchor_batch(hashes: np.ndarray, owner: np.ndarray, ids: np.ndarray, bits: int) -> pa.RecordBatch:
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    hashes, owner = hashes[~again], owner[~again]
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(hashes)], strict=True):
        who, local = np.unique(owner[a:b], return_inverse=True)
        rest = hashes[a:b] << np.uint64(bits)
        blobs.append(pack(ids[who], local.astype(np.uint16 if len(who) <= 65535 else np.uint32), (rest >> np.uint64(32)).astype(np.uint32), (rest >> np.uint64(24)).astype(np.uint8), np.array([len(who)])))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def shared_anchors(blobs: DataFrame) -> DataFrame:
    """(text_id, anchor) of the anchors that two distinct texts or more have. anchor: the first bits of the hash."""

    def work(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, marks = [], []
        for blob in held:
            count = int(np.frombuffer(blob[-8:], np.int64)[0])
            who, local, high, low, _ = unpack(blob, np.int64, np.uint16 if count <= 65535 else np.uint32, np.uint32, np.uint8, np.int64)
            ids.append(who[local])
            marks.append(bucket << 40 | high.astype(np.int64) << 8 | low)
        i, m = np.concatenate(ids), np.concatenate(marks)
        order = np.argsort(m, kind="stable")
        i, m = i[order], m[order]
        start = np.flatnonzero(np.diff(m, prepend=-1))
        size = np.diff(np.append(start, len(m)))
        more = np.repeat(np.minimum.reduceat(i, start) != np.maximum.reduceat(i, start), size)
        yield pa.RecordBatch.from_arrays([pa.array(i[more]), pa.array(m[more])], ["text_id", "anchor"])

    return per_bucket(blobs, work, "text_id long, anchor long")


class Suffixes:
    """Suffixes of pieces that lie side by side in a buffer, compared over LENGTH bytes by prefix polynomial hashes.

    Powers count from the start of each piece, so that tables of powers stay as short as pieces are.
    """

    def __init__(self, raw: np.ndarray, size: np.ndarray):
        self.raw, self.local = raw, places(size)
        self.up, self.down = powers(int(size.max()) + 1 if len(size) else 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(BYTE[raw] * self.up[self.local], out=self.prefix[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, LENGTH at most, by binary search."""
        out = np.full(len(a), LENGTH, np.int64)
        with np.errstate(over="ignore"):
            shift, p, q = self.down[self.local[a]] * self.up[self.local[b]], self.prefix[a], self.prefix[b]
            k = np.flatnonzero((self.prefix[a + LENGTH] - p) * shift != self.prefix[b + LENGTH] - q)
            a, b, shift, p, q = a[k], b[k], shift[k], p[k], q[k]
            low, high = np.zeros(len(k), np.int64), np.full(len(k), LENGTH - 1, np.int64)
            for _ in range(LENGTH.bit_length()):
                mid = (low + high + 1) >> 1
                same = (self.prefix[a + mid] - p) * shift == self.prefix[b + mid] - q
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[k] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b; ties where they agree."""
        k = self.common(a, b)
        end = k >= LENGTH
        k = np.where(end, 0, k)
        return np.where(end, ties, self.raw[a + k] < self.raw[b + k])

    def sort(self, at: np.ndarray, segment: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Order of the suffixes at the given places, inside segments (runs of equal numbers), by mergesort.

        Each level merges neighbouring runs: an element's new place is its place in its
        own run plus its rank in the other, found by binary search for all at once.
        """
        n = len(at)
        order = np.arange(n)
        start = np.flatnonzero(np.diff(segment, prepend=segment[0] - 1 if n else 0))
        size = np.diff(np.append(start, n))
        begin, length = np.repeat(start, size), np.repeat(size, size)
        run = 1
        while n and run < size.max():
            new = order.copy()
            active = np.flatnonzero(length > run)
            for c in range(0, len(active), step):
                e = active[c : c + step]
                local = e - begin[e]
                own = local // run
                right = (own & 1).astype(bool)
                other = (own ^ 1) * run
                lo, hi = np.minimum(other, length[e]), np.minimum(other + run, length[e])
                first = lo.copy()
                mine = at[order[e]]
                while True:
                    k = np.flatnonzero(lo < hi)
                    if not len(k):
                        break
                    mid = (lo[k] + hi[k]) >> 1
                    before = self.less(at[order[begin[e[k]] + mid]], mine[k], right[k])
                    lo[k], hi[k] = np.where(before, mid + 1, lo[k]), np.where(before, hi[k], mid)
                place = np.minimum(own, own ^ 1) * run + (local - own * run) + (lo - first)
                new[begin[e] + place] = order[e]
            order, run = new, run * 2
        return order

    def agree(self, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Whether the LENGTH bytes at a and b are the same, byte by byte."""
        out, place = np.zeros(len(a), bool), np.arange(LENGTH)
        for c in range(0, len(a), step):
            out[c : c + step] = (self.raw[a[c : c + step, None] + place] == self.raw[b[c : c + step, None] + place]).all(1)
        return out


def classes(suffixes: Suffixes, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Number of the class of each suffix: same segment and same LENGTH bytes, as verified."""
    order = suffixes.sort(at, segment)
    a, b = order[:-1], order[1:]
    near = segment[a] == segment[b]
    equal = np.zeros(len(a), bool)
    equal[near] = suffixes.common(at[a[near]], at[b[near]]) >= LENGTH
    false = equal.copy()
    false[equal] = ~suffixes.agree(at[a[equal]], at[b[equal]])
    if false.any():  # a collision: these segments again, by their bytes
        bad = np.isin(segment, segment[a[false]])
        keys = [(int(segment[k]), suffixes.raw[at[k] : at[k] + LENGTH].tobytes()) for k in np.flatnonzero(bad)]
        number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        out = _numbers(order, equal)
        out[bad] = out.max() + 1 + np.array([number[key] for key in keys])
        return out
    return _numbers(order, equal)


def _numbers(order: np.ndarray, equal: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~equal)]) if len(order) else []
    return out


def piece_blobs(texts: DataFrame, bits: int) -> DataFrame:
    """(bucket, blob) with the pieces around the shared anchors of (doc_id, text_id, text, own anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = bytes_of(batch.column(2))
            docs, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = batch.column(3)
            for i, j in chunks(offsets, 1 << 22):
                parts = []
                for p, q in chunks(offsets[i : j + 1] - offsets[i]):
                    p, q = p + i, q + i
                    base = offsets[p]
                    h, at, first, last = anchors(raw[base : offsets[q]], offsets[p : q + 1] - base)
                    if not len(h):
                        continue
                    mark = (h >> np.uint64(64 - bits - 40)).astype(np.int64)
                    row = row_of(at, offsets[p : q + 1] - base)
                    wanted = np.concatenate([own[k].values.to_numpy() for k in range(p, q)])
                    row_wanted = np.repeat(np.arange(q - p), [len(own[k]) for k in range(p, q)])
                    keep = _pairs_in(mark, row, wanted, row_wanted)
                    parts.append((mark[keep], at[keep] + base, first[keep] + base, last[keep] + base, row[keep] + p))
                if not parts:
                    continue
                mark, at, first, last, row = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(mark, kind="stable")
                mark, at, first, last, row = mark[order], at[order], first[order], last[order], row[order]
                bucket = mark >> 40
                cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                blobs = []
                for a, b in zip(cut, [*cut[1:], len(mark)], strict=True):
                    who, local = np.unique(row[a:b], return_inverse=True)
                    size = last[a:b] - first[a:b] + LENGTH
                    body = raw[np.repeat(first[a:b] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                    blobs.append(pack(docs[who], ids[who], local.astype(np.uint32), mark[a:b], (first[a:b] - offsets[row[a:b]]), (at[a:b] - first[a:b]).astype(np.uint8), size.astype(np.uint8), body))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in blobs], pa.binary())], ["bucket", "blob"])

    return texts.mapInArrow(run, "bucket int, blob binary")


def _pairs_in(mark: np.ndarray, row: np.ndarray, wanted: np.ndarray, row_wanted: np.ndarray) -> np.ndarray:
    """Which (row, mark) pairs are among the wanted ones."""
    mix = lambda m, r: splitmix(m.astype(np.uint64) ^ splitmix(r.astype(np.uint64) + np.uint64(1)))
    return np.isin(mix(mark, row), mix(wanted, row_wanted))


def repeats(blobs: DataFrame, step: int = 1 << 16) -> DataFrame:
    """(doc_id, text_id, start, stop): spans of bytes covered by strings that start in a document with a smaller id too."""

    def work(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [[] for _ in range(7)]
        for blob in held:
            blob = zstandard.ZstdDecompressor().decompress(blob)
            who, ids, local, mark, first, before, size, body = unpack(blob, np.int64, np.int64, np.uint32, np.int64, np.int64, np.uint8, np.uint8, np.uint8)
            for c, x in zip(columns, (who[local], ids[local], mark, first, before, size, body), strict=True):
                c.append(x)
        doc, text, mark, first, before, size, raw = (np.concatenate(c) for c in columns)
        size, before = size.astype(np.int64), before.astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        # Equal pieces become one. They are told by anchor, shape and hash, and then compared byte by byte.
        h = piece_hashes(raw, begin, size)
        order = np.lexsort((doc, h, mark))
        fresh = np.ones(len(order), bool)
        a, b = order[:-1], order[1:]
        same = (mark[a] == mark[b]) & (h[a] == h[b]) & (size[a] == size[b]) & (before[a] == before[b])
        k = np.flatnonzero(same)
        same[k] = _same_bytes(raw, begin[a[k]], begin[b[k]], size[a[k]])
        fresh[1:] = ~same
        piece = np.empty(len(order), np.int64)
        piece[order] = np.cumsum(fresh) - 1
        kept = order[fresh]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(fresh))
        # Windows of the distinct pieces. Where an anchor has several, (anchor, place of the anchor in the window) is a segment.
        windows = size[kept] - LENGTH + 1
        smallest = np.repeat(least, windows)
        _, group, members = np.unique(mark[kept], return_inverse=True, return_counts=True)
        several = np.flatnonzero(members[group] > 1)
        if len(several):
            own, shape = kept[several], windows[several]
            taken = size[own]
            suffixes = Suffixes(raw[np.repeat(begin[own], taken) + places(taken)], taken)
            shift = places(shape).astype(np.int64)
            segment = group[several].repeat(shape) * 64 + before[own].repeat(shape) - shift
            at = (np.cumsum(taken) - taken).repeat(shape) + shift
            w = (np.cumsum(windows) - windows)[several].repeat(shape) + shift
            arranged = np.argsort(segment, kind="stable")
            w = w[arranged]
            number = classes(suffixes, at[arranged], segment[arranged])
            low = np.full(number.max() + 1, LAST, np.int64)
            np.minimum.at(low, number, smallest[w])
            smallest[w] = low[number]
        # Every occurrence of a piece: its windows whose class has a smaller id, as runs. Some occurrences at a time, as an anchor of a common passage has very many.
        place_of = np.cumsum(windows) - windows
        for c in range(0, len(piece), step):
            own = piece[c : c + step]
            total = windows[own]
            occurrence = np.repeat(np.arange(len(own)), total)
            offset = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            hit = np.flatnonzero(smallest[np.repeat(place_of[own], total) + offset] < doc[c : c + step][occurrence])
            if not len(hit):
                continue
            o, t = occurrence[hit], offset[hit]
            edge = np.ones(len(hit), bool)
            edge[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1] + 1)
            s = np.flatnonzero(edge)
            e = np.append(s[1:], len(hit)) - 1
            who = o[s] + c
            yield pa.RecordBatch.from_arrays([pa.array(doc[who]), pa.array(text[who]), pa.array((first[who] + t[s]).astype(np.int32)), pa.array((first[who] + t[e] + LENGTH).astype(np.int32))], ["doc_id", "text_id", "start", "stop"])

    return per_bucket(blobs, work, "doc_id long, text_id long, start int, stop int")


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    out = np.zeros(len(a), bool)
    place = np.arange(2 * LENGTH)
    for c in range(0, len(a), step):
        k = np.minimum(place, size[c : c + step, None] - 1)
        out[c : c + step] = (raw[a[c : c + step, None] + k] == raw[b[c : c + step, None] + k]).all(1)
    return out


def places(size: np.ndarray) -> np.ndarray:
    """Position of each byte in its piece."""
    return (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint16 if not len(size) or size.max() < 1 << 16 else np.int64)


def piece_hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """A hash of each piece's bytes, some pieces at a time."""
    out = np.zeros(len(size), np.uint64)
    for i, j in chunks(np.append(begin, len(raw)), limit):
        part = Suffixes(raw[begin[i] : begin[i] + size[i:j].sum()], size[i:j])
        at = begin[i:j] - begin[i]
        with np.errstate(over="ignore"):
            out[i:j] = splitmix(part.prefix[at + size[i:j]] - part.prefix[at])
    return out


def merge_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs, in order; spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


def _merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return merge_spans(*(spans.values.field(k).to_numpy().astype(np.int64) for k in ("start", "stop")))


class Found:
    """What the passes over documents gave: table (all rows), hits (texts with their spans)."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text"):
        spark = documents.sparkSession
        table = text_table(documents, key, text)
        first = table.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
        self.table = written(table.join(first, "sha").select("doc_id", "n_bytes", "sha", F.expr(TEXT_ID).alias("text_id"), (F.col("doc_id") > F.col("first_id")).alias("copy")), "texts")
        bits = bucket_bits(spark, self.table.agg(F.sum("n_bytes")).first()[0] or 0)
        shared = shared_anchors(anchor_blobs(documents, bits, text)).groupBy("text_id").agg(F.collect_list("anchor").alias("own"))
        owners = self.table.where("not copy").select("doc_id", "text_id").distinct()
        shared = written(owners.join(shared, "text_id"), "anchors")
        wanted = Membership(shared.select("doc_id"))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
                batch = batch.filter(pa.array(wanted.contains(at), pa.bool_())).select([0, 1])
                ids = [_text_id(x.as_py() or b"") for x in batch.column(1)]
                yield batch.append_column("text_id", pa.array(ids, pa.int64()))

        rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
        found = wanted.positions(rows, "doc_id").mapInArrow(pick, "doc_id long, text binary, text_id long")
        texts = written(found.join(shared, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "own"), "shared")
        spans = repeats(piece_blobs(texts, bits)).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        self.hits = texts.drop("own").join(spans, ["doc_id", "text_id"])


def report(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = Found(documents, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests = [], [], []
            for body, spans in zip(batch.column(2), batch.column(3), strict=True):
                start, stop = _merged(spans)
                removed.append(int((stop - start).sum()))
                runs.append(len(start))
                digests.append(hashlib.sha256(_without(body.as_py(), start, stop)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "text_id", "n_removed", "n_spans", "kept_sha256"])

    parts = found.hits.mapInArrow(cut, "doc_id long, text_id long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "text_id"])
    whole = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    rows = found.table.join(parts, ["doc_id", "text_id"], "left")
    return rows.select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _without(body: bytes, start: np.ndarray, stop: np.ndarray) -> bytes:
    edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def strip(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with the repeated bytes cut from their texts; characters that are cut in part stay whole."""
    found = Found(documents, key, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(2), batch.column(3), strict=True):
                body = body.as_py()
                start, stop = _merged(spans)
                head = np.append((np.frombuffer(body, np.uint8) & 0xC0) != 0x80, True)  # first bytes of characters, and the end
                edge = np.flatnonzero(head)
                start, stop = edge[np.searchsorted(edge, start)], edge[np.searchsorted(edge, stop, "right") - 1]
                good = start < stop
                out.append(_without(body, start[good], stop[good]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["_id", "_text_id", "_kept"])

    parts = found.hits.mapInArrow(cut, "_id long, _text_id long, _kept string").groupBy("_id", "_text_id").agg(F.first("_kept").alias("_kept"))
    # Rows that lose something are told by id and text; only their texts are put in place.
    sha = F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_id"), sha.alias("sha"))
    rows = rows.select("row", "_id", F.expr(TEXT_ID).alias("_text_id"))
    copies = found.table.where(F.col("copy") & (F.col("n_bytes") >= LENGTH)).select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), F.lit("").alias("_kept")).distinct()
    changed = written(parts.unionByName(copies), "changed")
    maybe, never = split(rows, "_id", changed.select("_id"))
    kept = maybe.join(changed, ["_id", "_text_id"], "left").select(*[F.coalesce("_kept", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns])
    return kept.unionByName(never.select(*[F.col("row")[c].alias(c) for c in documents.columns]))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
