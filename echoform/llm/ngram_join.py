"""N-gram Jaccard join over prefix trees.

Every text is its set of n-word shingles (see _text.shingle_sets); two texts link when
the Jaccard similarity of their sets is at least the threshold. Results are links'
components, so equal sets are collapsed first and no group is spread into pairs.

1. Sets. Each text gives its size and a 128-bit name of its set; equal sets become one,
   with the least id as its representative and a number of its own.
2. Shared shingles. With o the least overlap a set of n shingles needs with any
   partner, partners share at least l of the first n - o + l shingles in a common
   order, here that of the hashes. Only those go to their buckets, as packed arrays,
   once for each distinct set of a partition. A bucket returns the shingles that two
   sets or more hold, with the number of sets. A set with fewer than l of them has no
   partner, which settles most texts. Of the others, partners also meet in a prefix of
   what remains, rarest first: two linked sets hold the first shingle that both have.
3. First round. Each set goes to the bucket of its least shared shingle, where near
   copies mostly meet. A bucket of more than TASK_TOKENS shingles is cut into parts,
   each of which also gets the bucket's first set. Links give components.
4. Second round. A prefix shingle whose sets are by now one component has nothing left
   to tell. The sets of every other one meet again. Each such bucket goes to the one of
   its sets that is in most of them, so that sets which share many shingles meet there
   once. Where the sets around such a centre are too many for a task, they are cut into
   classes by length, as sets link only with those of their own class or the next, and
   by whether they belong to the centre's component; classes are cut into parts. Any
   two parts that can have a link between two components meet in a task, so none is
   lost, and the parts of one large component don't meet each other.
5. Prefix trees. The sets of a task are ordered by the frequencies among them, most
   frequent first, and stored in a trie, so that similar sets share long paths. Each
   set walks the tree with its overlap so far, leaves a subtree when the sizes and
   lengths that remain cannot reach the threshold, and passes by subtrees that are in
   its own component already. Overlaps at the ends of paths are exact.

Nulls and texts without words have empty sets: component_id is their own id, whatever
else is equal, and a null id stays null. Rows that share an id and have different texts
are told apart by their sets. Texts of any length are used whole. Extra columns are
ignored. Ties don't arise: a component's least id names it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from echoform.llm._spark import Membership, bucket_bits, checked, pack, per_bucket, shuffle_partitions, unpack, written
from echoform.llm._text import bytes_of, chunks, shingle_sets
from echoform.llm.components import components

#: Shingles of the sets that one task joins at most, about (apart from a single set of more).
TASK_TOKENS = 200_000
SPARE = 0.1
#: Stands for a null id among ids, as the largest.
LAST = (1 << 63) - 1


def overlap(n: int, per_cent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-per_cent * n // 100)


def spare(n: int) -> int:
    return max(1, int(n * SPARE))


def head(n: int, per_cent: int) -> int:
    """Shingles of a set of n, in order, of which a partner shares at least needed(n)."""
    return n - overlap(n, per_cent) + spare(n)


def needed(n: int, per_cent: int) -> int:
    return spare(overlap(n, per_cent))


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    raw, offsets = bytes_of(column)
    for i, j in chunks(offsets):
        yield from shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)


def _name(tokens: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name, as two signed numbers."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist()
    return a, b


def _names(column: pa.Array, words: int) -> tuple[list[int], pa.Array, pa.Array]:
    """(sizes, both halves of the names) of the texts' sets; an empty set has no name."""
    sizes, halves = [], []
    for tokens in _sets(column, words):
        sizes.append(len(tokens))
        halves.append(_name(tokens) if len(tokens) else (None, None))
    return sizes, pa.array([a for a, _ in halves], pa.int64()), pa.array([b for _, b in halves], pa.int64())


def set_table(documents: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(doc_id, n, name_a, name_b) for each row; the name is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b = _names(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), a, b], ["doc_id", "n", "name_a", "name_b"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, name_a long, name_b long")


def with_set_name(documents: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(row, a, b): each row of documents packed, and the name of its set as link_sets() has it."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a, b = _names(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), a, b], ["row", "a", "b"])

    return packed.mapInArrow(run, StructType([packed.schema["row"], StructField("a", LongType()), StructField("b", LongType())]))


def heads(documents: DataFrame, words: int, per_cent: int, bits: int, text: str) -> DataFrame:
    """(bucket, blob) with the heads of the distinct sets of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names, held, total = [], [], 0

        def sent() -> pa.RecordBatch:
            tokens, own = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), [len(t) for t in held])
            order = np.argsort(tokens, kind="stable")
            tokens, own = tokens[order], own[order]
            bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs, name = [], np.array(names, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(tokens)], strict=True):
                who, local = np.unique(own[a:b], return_inverse=True)
                rest = tokens[a:b] << np.uint64(bits)
                blobs.append(pack(name[who], local.astype(np.uint32 if len(who) > 65535 else np.uint16), (rest >> np.uint64(32)).astype(np.uint32), (rest >> np.uint64(24)).astype(np.uint8)))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for tokens in _sets(batch.column(0), words):
                name = _name(tokens) if len(tokens) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                names.append(name)
                held.append(tokens[: head(len(tokens), per_cent)].copy())
                total += len(held[-1])
                if total > 500_000:
                    yield sent()
                    names, held, total = [], [], 0
        if held:
            yield sent()

    return documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, blob binary")


def shared_tokens(heads: DataFrame) -> DataFrame:
    """(name_a, name_b, token, sets): the shingles of heads that two sets or more hold. token: the first bits of the hash."""

    def work(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        names, tokens = [], []
        for blob in blobs:
            count = int(np.frombuffer(blob, np.int64, 2)[1]) // 16
            name, local, high, low = unpack(blob, np.int64, np.uint32 if count > 65535 else np.uint16, np.uint32, np.uint8)
            names.append(name.reshape(-1, 2)[local])
            tokens.append(bucket << 40 | high.astype(np.int64) << 8 | low)
        (a, b), t = np.concatenate(names).T, np.concatenate(tokens)
        order = np.argsort(t, kind="stable")
        again = t[order[1:]] == t[order[:-1]]
        order = order[np.append(again, False) | np.insert(again, 0, False)]  # most shingles are met once
        order = order[np.lexsort((b[order], a[order], t[order]))]
        a, b, t = a[order], b[order], t[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, t = a[fresh], b[fresh], t[fresh]
        start = np.flatnonzero(np.diff(t, prepend=-1))
        count = np.diff(np.append(start, len(t)))
        sets = np.repeat(count, count)
        more = sets > 1
        yield pa.RecordBatch.from_arrays([pa.array(a[more]), pa.array(b[more]), pa.array(t[more]), pa.array(sets[more].astype(np.int32))], ["name_a", "name_b", "token", "sets"])

    return per_bucket(heads, work, "name_a long, name_b long, token long, sets int")


class Node:
    """A subtree: the sets from lo to hi in order, which share `tokens` after their parents' paths.

    Of its sets that have walked the tree so far, those from lo to `same` are known to be one component.
    """

    __slots__ = ("children", "hi", "least", "lo", "most", "same", "tokens")


class Trie:
    """Prefix tree over sorted distinct sets of ranks, walked by each set in turn for those before it."""

    def __init__(self, sets: list[np.ndarray], per_cent: int):
        self.per_cent, self.sets = per_cent, sets
        self.sizes = [len(s) for s in sets]
        self.steps = 0
        self.root = self._build()

    def _build(self) -> Node:
        root, sizes = Node(), np.array(self.sizes, np.int64)
        todo = [(root, 0, len(self.sets), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            first, last = self.sets[lo], self.sets[hi - 1]  # in order, so what these share all between them share
            k = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:k] != last[depth:k]) if hi - lo > 1 else ()
            end = depth + int(differ[0]) if len(differ) else k
            node.lo, node.hi, node.same, node.tokens, node.children = lo, hi, lo, first[depth:end], []
            node.least, node.most = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
            if hi - lo == 1:
                continue
            at = lo
            while at < hi:
                stop = at + 1 if len(self.sets[at]) == end else self._until(at, hi, end)
                child = Node()
                node.children.append(child)
                todo.append((child, at, stop, end))
                at = stop
        return root

    def _until(self, at: int, hi: int, depth: int) -> int:
        """First set after at that differs from it at depth, by binary search."""
        token = self.sets[at][depth]
        while at < hi - 1:
            mid = (at + hi) // 2
            at, hi = (mid, hi) if self.sets[mid][depth] == token else (at, mid)
        return hi

    def links(self, n: int, m: int, both: int) -> bool:
        return 100 * both >= self.per_cent * (n + m - both)

    def walk(self, x: int, mark: np.ndarray, groups: Groups) -> None:
        """Join set x with the sets before it that it links with. mark: scratch flags for all ranks.

        The child nearest to x comes first, so that a set among many near copies finds its
        component at once and passes by the rest of it.
        """
        ranks, n = self.sets[x], self.sizes[x]
        mark[ranks] = True
        stack = [(self.root, 0, 0, n)]
        while stack:
            node, depth, both, left = stack.pop()
            if node.lo >= x:
                continue
            m = min(max(depth + left, node.least), node.most)  # as below, by sizes alone
            if not self.links(n, m, both + min(m - depth, left)):
                continue
            top = min(node.hi, x)
            one = groups.find(node.lo)
            while node.same < top and groups.find(node.same) == one:
                node.same += 1
            if node.same >= top and one == groups.find(x):
                continue
            self.steps += 1
            size = len(node.tokens)
            if size:
                depth += size
                both += int(np.count_nonzero(mark[node.tokens]))
                left = n - int(ranks.searchsorted(node.tokens[-1], "right"))
            # Most that a set of m below can overlap: both + min(m - depth, left). It is best, against what is needed, at m = depth + left.
            m = min(max(depth + left, node.least), node.most)
            if not self.links(n, m, both + min(m - depth, left)):
                continue
            if node.children:
                stack.extend((child, depth, both, left) for child in node.children)
            elif self.links(n, node.most, both):
                groups.join(node.lo, x)
        mark[ranks] = False


class Groups:
    """Components of numbers, each named by its least."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def join_sets(sets: list[np.ndarray], per_cent: int, known: list[int] | None = None) -> list[int]:
    """For each of some distinct sets of hashes, the index of the first set of its component. known: components so far."""
    every = np.concatenate(sets)
    _, which, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    ranks, at = rank[which], np.cumsum([0, *map(len, sets)])
    own = [np.sort(ranks[at[k] : at[k + 1]]) for k in range(len(sets))]
    order = sorted(range(len(sets)), key=lambda k: own[k].astype(">i8").tobytes())
    trie, mark, groups = Trie([own[k] for k in order], per_cent), np.zeros(len(count), bool), Groups(len(sets))
    if known is not None:
        first: dict[int, int] = {}
        for x, k in enumerate(order):
            groups.join(first.setdefault(known[k], x), x)
    for x in range(1, len(sets)):
        trie.walk(x, mark, groups)
    least: dict[int, int] = {}
    for x, k in enumerate(order):
        r = groups.find(x)
        least[r] = min(least.get(r, k), k)
    out = [0] * len(sets)
    for x, k in enumerate(order):
        out[k] = least[groups.find(x)]
    return out


def link(documents: DataFrame, words: int = 5, per_cent: int = 80, key: str = "doc_id", text: str = "text", task_tokens: int = TASK_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return link_sets(documents, words, per_cent, key, text, task_tokens).drop("name_a", "name_b")


def link_sets(documents: DataFrame, words: int = 5, per_cent: int = 80, key: str = "doc_id", text: str = "text", task_tokens: int = TASK_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id, name_a and name_b of every document: rows that share an id are told apart by their sets."""
    spark = documents.sparkSession
    name = ["name_a", "name_b"]
    sets = written(set_table(documents, words, key, text), "sets")
    named = sets.where("name_a is not null").groupBy(*name).agg(F.coalesce(F.min("doc_id"), F.lit(LAST)).alias("first_id"), F.first("n").alias("n"))
    named = written(named.withColumn("node", F.monotonically_increasing_id()), "named")

    shared = shared_tokens(heads(documents, words, per_cent, bucket_bits(spark, 8 * (sets.agg(F.sum("n")).first()[0] or 0)), text))
    own = shared.groupBy(*name).agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("own"))
    kept = own.join(named, name)
    l = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * per_cent / 100) * SPARE)).cast("int")  # noqa: E741
    kept = written(kept.where(F.size("own") >= l).select("node", "first_id", *name, "n", F.transform("own", lambda t: t["token"]).alias("own"), l.alias("l")), "kept")
    prefix = kept.select("node", "n", F.explode(F.slice("own", 1, F.size("own") - F.col("l") + 1)).alias("token"))

    tokens = written(_tokens(documents, written(_first_round(kept, task_tokens), "first"), words, key, text), "tokens")
    once = components(_trees(tokens.select("task", F.explode("parts").alias("part"), "node", F.col("node").alias("component"), "tokens"), per_cent))
    again = checked(_second_round(prefix, once, task_tokens, per_cent), "again")
    merged = components(once.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_trees(tokens.select("node", "tokens").join(again, "node"), per_cent)))

    least = merged.join(named, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = named.join(merged.join(least, "component").select("node", "component_id"), "node", "left")
    by_set = by_set.select(*name, F.coalesce("component_id", "first_id").alias("component_id"))
    out = sets.join(by_set, name, "left")
    found = F.when(F.col("component_id") != LAST, F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(found, "doc_id").alias("component_id"), *name)


def _tokens(documents: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """wanted with the shingles of each set, read from its first document; only texts that may be wanted move."""
    filter_ = Membership(wanted.select("first_id"))
    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("first_id"), F.col(text).cast("string").alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(blobs, pa.binary())], ["first_id", "name_a", "name_b", "tokens"])

        for batch in batches:
            at = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            batch = batch.filter(pa.array(filter_.contains(at), pa.bool_()))
            ids, names, blobs, size = [], [], [], 0
            for d, tokens in zip(batch.column(0).to_pylist(), _sets(batch.column(1), words), strict=True):
                if len(tokens):
                    ids.append(d)
                    names.append(_name(tokens))
                    blobs.append(tokens.tobytes())
                    size += len(blobs[-1])
                if size > 1 << 24:
                    yield sent()
                    ids, names, blobs, size = [], [], [], 0
            if ids:
                yield sent()

    texts = filter_.positions(rows, "first_id").mapInArrow(pick, "first_id long, name_a long, name_b long, tokens binary")
    return texts.join(wanted, ["first_id", "name_a", "name_b"]).select("node", "task", "parts", "tokens")


def _first_round(kept: DataFrame, task_tokens: int) -> DataFrame:
    """(node, first_id, name_a, name_b, task, parts): every set under its bucket; buckets of many shingles in parts that share their first set."""
    rows = kept.select("node", "first_id", "name_a", "name_b", "n", F.array_min("own").alias("task"))
    large = rows.groupBy("task").agg(F.sum("n").alias("_all"), F.min("node").alias("_first")).where(F.col("_all") > task_tokens)
    large = checked(large.select("task", "_first", F.ceil(F.col("_all") / task_tokens).cast("int").alias("_parts")), "large")
    rows = rows.join(large, "task", "left")
    own = F.array(F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("_parts", F.lit(1))).cast("int"))
    parts = F.when(F.col("node") == F.col("_first"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(own)
    return rows.select("node", "first_id", "name_a", "name_b", "task", parts.alias("parts"))


def _second_round(prefix: DataFrame, once: DataFrame, task_tokens: int, per_cent: int) -> DataFrame:
    """(task, part, node, component): the sets of prefix shingles that are not one component yet."""
    rows = prefix.join(once, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.sum("n").alias("all")).where("_low < _high").select("token", "all")
    own = rows.join(mixed, "token").groupBy("node", "component", "n").agg(F.collect_list(F.struct("token", "all")).alias("buckets"))
    own = written(own, "own").select("node", "component", "n", F.size("buckets").alias("degree"), F.explode("buckets").alias("b"))
    centre = own.groupBy("b.token").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.xxhash64("node").alias("h"), F.col("node").alias("node"), F.col("component").alias("component"))).alias("c"))
    met = own.select("node", "component", "n", "b.*").join(centre.select("token", F.col("c.node").alias("centre"), F.col("c.component").alias("first")), "token")
    met = written(met, "met")

    # A neighbourhood that is too large for a task is given up for its buckets where these are less work.
    work = lambda size: F.col(size) * F.ceil(F.col(size) / task_tokens)
    whole = met.select("centre", "node", "n").distinct().groupBy("centre").agg(F.sum("n").alias("whole")).where(F.col("whole") > task_tokens)
    apart = met.select("centre", "token", "all").distinct().groupBy("centre").agg(F.sum(work("all")).alias("apart"))
    given_up = whole.join(apart, "centre").where(work("whole") > F.col("apart")).select("centre", F.lit(True).alias("by_bucket"))
    met = met.join(checked(given_up, "apart"), "centre", "left")
    met = met.select(F.when(F.col("by_bucket"), F.xxhash64("token", F.lit(1))).otherwise(F.xxhash64("centre", F.lit(0))).alias("task"), "node", "component", "n", (F.col("component") != F.col("first")).cast("int").alias("other")).distinct()
    met = written(met, "tasks")
    large = met.groupBy("task").agg(F.sum("n").alias("all")).where(F.col("all") > task_tokens).select("task", F.lit(True).alias("large"))
    met = met.join(checked(large, "large"), "task", "left")
    small = met.where("large is null").select("task", F.lit(0).cast("long").alias("part"), "node", "component")

    # Sets that link differ by a class of lengths at most.
    length = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / per_cent) + 1e-9).cast("int")
    met = met.where("large").select("task", "node", "component", "n", "other", length.alias("length"))
    classes = met.groupBy("task", "other", "length").agg(F.ceil(F.sum("n") / (task_tokens / 2)).cast("int").alias("parts"))
    by_task = classes.groupBy("task").agg(F.collect_list(F.struct("other", "length", "parts")).alias("classes"))
    met = met.join(classes, ["task", "other", "length"]).join(by_task, "task")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    near = F.filter("classes", lambda c: (F.abs(c["length"] - F.col("length")) <= 1) & ((c["other"] == 1) | (F.col("other") == 1)))
    theirs = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda k: F.struct(c["other"].alias("other"), c["length"].alias("length"), k.alias("k")))))
    met = met.withColumn("_own", F.struct("other", "length", mine.alias("k"))).withColumn("_their", F.explode(theirs))
    pair = F.xxhash64(F.least("_own", "_their"), F.greatest("_own", "_their"))
    return small.unionByName(met.select("task", pair.alias("part"), "node", "component"))


def _trees(rows: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): ties between sets of the same component, from a tree for each (task, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def close() -> pa.RecordBatch:
            ids = list(held)
            first = join_sets([t for _, t in held.values()], per_cent, [c for c, _ in held.values()])
            ties = [(ids[k], ids[f]) for k, f in enumerate(first) if f != k]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ties], pa.int64()), pa.array([b for _, b in ties], pa.int64())], ["a", "b"])

        for batch in batches:
            for t, p, node, c, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                if (t, p) != now:
                    if len(held) > 1:
                        yield close()
                    now, held = (t, p), {}
                held[node] = c, np.frombuffer(tokens.as_py(), np.uint64)
        if len(held) > 1:
            yield close()

    dealt = rows.select("task", F.col("part").cast("long").alias("part"), "node", "component", "tokens").repartition(shuffle_partitions(rows.sparkSession), "task", "part").sortWithinPartitions("task", "part")
    return dealt.mapInArrow(run, "a long, b long")


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, per_cent=85)
