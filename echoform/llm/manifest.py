"""A Merkle manifest of a table: leaves, a tree for each group of rows, a root, proofs, and folding of changed leaves.

A leaf is the digest of a row's fields. Leaves of a group ascend by key; every WIDTH
consecutive nodes become a parent until one is left, and the groups' roots, ordered by
group, are put together likewise. A parent hashes its children's hex digests one after
the other and retains a copy of the hash state before each child slot. A changed
leaf is folded by resuming the state of its slot with the replacement and the siblings
to its right only, level by level up to the root.

Digests are made by Spark, so texts never leave the scan. Rows get their rank in the
group by ranges and prefix sums of counts (no group in one task), and meet in blocks of
WIDTH ** DEPTH leaves, a row each. A block's levels and states live in the worker that
holds it; the blocks' tops are the leaves of the next round, so a table of 10^10 rows
takes four rounds. Paths come back to the blocks by a join, one row for each block.

Nulls: a null field is `-` in its leaf; a null group is a group of its own, first in
order; null keys come first in a group and are not tampered with. Rows with the same key
are ordered by their digests; equal rows are interchangeable. A group of one leaf is its
own subroot, and a table of one group has its subroot as root. An empty table gives no
rows. Other columns are ignored, also those with names used here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoform.llm._spark import checked, shuffle_partitions, written

WIDTH, DEPTH = 8, 3
#: What a path adds for a level: hex digests of the siblings before and after, each concatenated.
PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, each `-` if null, else byte count, `:` and value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows (with a column tree, not null) with rank (from 0, in the tree, by order) and n, the size of the tree."""
    spark = rows.sparkSession
    # Written first, as dealing by ranges reads its input twice; the number tells equal rows apart, so that they share no range.
    once = written(rows.withColumn("_nth", F.monotonically_increasing_id()), name)
    by = ["tree", *order, "_nth"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = once.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()).withColumn("_place", place)
    dealt = written(dealt.drop("_nth"), name)
    ranges = dealt.groupBy("tree", "_range").agg(F.count("*").alias("_count"), F.min("_place").alias("_least"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_count").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = checked(ranges.select("tree", "_range", (before - F.col("_least")).alias("_shift"), F.sum("_count").over(tree).alias("n")), name)
    return dealt.join(ranges, ["tree", "_range"]).withColumn("rank", F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")


def climb(nodes: list[bytes], n: int, depth: int = DEPTH) -> tuple[list[list[bytes]], list[list]]:
    """(levels, states) of a block of nodes (hex) in a level of n nodes; states[k][i] is the hash before node i of level k."""
    levels, states = [nodes], []
    while n > 1 and len(states) < depth:
        parents, before = [], []
        for i in range(0, len(levels[-1]), WIDTH):
            h = hashlib.sha256()
            for child in levels[-1][i : i + WIDTH]:
                before.append(h.copy())
                h.update(child)
            parents.append(h.hexdigest().encode())
        levels.append(parents)
        states.append(before)
        n = -(-n // WIDTH)
    return levels, states


def siblings(levels: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """For each level that the block folds, the digests left and right of node i's ancestor in its run."""
    out = []
    for level in levels[:-1]:
        first = i - i % WIDTH
        out.append((b"".join(level[first:i]), b"".join(level[i + 1 : first + WIDTH])))
        i //= WIDTH
    return out


def fold(states: list[list], path: list[tuple[bytes, bytes]], i: int, node: bytes) -> bytes:
    """The block's top once node i is replaced: each parent's retained state goes on with the replacement and what is right of it."""
    for before, (_, right) in zip(states, path, strict=False):
        h = before[i].copy()
        h.update(node)
        h.update(right)
        node = h.hexdigest().encode()
        i //= WIDTH
    return node


def _blocks(nodes: DataFrame, depth: int, name: str, *carried: str) -> DataFrame:
    """tree, block, n and items (rank, digest, carried columns) in order: groups of at most WIDTH ** depth rows."""
    items = F.sort_array(F.collect_list(F.struct("rank", "digest", *carried)))
    return written(nodes.groupBy("tree", F.expr(f"rank div {WIDTH**depth}").alias("block")).agg(F.max("n").alias("n"), items.alias("items")), name)


def _hexed(item: pa.StructArray, k: int = 1) -> list[bytes | None]:
    return [None if d is None else d.hex().encode() for d in item.field(k).to_pylist()]


def _tops(blocks: DataFrame, depth: int, name: str) -> DataFrame:
    """tree, rank, n, digest of the level of the blocks' tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(3)
            n = batch.column(2).to_pylist()
            tops = [bytes.fromhex(climb(_hexed(items[r].values), n[r], depth)[0][-1][0].decode()) for r in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-k // WIDTH**depth) for k in n], pa.int64()), pa.array(tops, pa.binary())], ["tree", "rank", "n", "digest"])

    return written(blocks.mapInArrow(run, "tree string, rank long, n long, digest binary"), name)


def _paths(nodes: DataFrame, depth: int, name: str) -> tuple[DataFrame, DataFrame]:
    """((tree, rank, path up to the tree's root), (tree, root)) of nodes (tree, rank, n, digest)."""
    blocks = _blocks(nodes, depth, name)
    tops = _tops(blocks, depth, name)
    if (tops.agg(F.max("n")).first()[0] or 1) > 1:
        above, roots = _paths(tops, depth, name)
        blocks = blocks.join(above.select("tree", F.col("rank").alias("block"), F.col("path").alias("above")), ["tree", "block"])
    else:
        roots = tops.select("tree", F.col("digest").alias("root"))
        blocks = blocks.withColumn("above", F.array().cast(PATH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                item, tree = batch.column(3)[r].values, batch.column(0)[r].as_py()
                levels, _ = climb(_hexed(item), batch.column(2)[r].as_py(), depth)
                above = batch.column(4)[r].as_py()
                paths = [[{"left": a.decode(), "right": b.decode()} for a, b in siblings(levels, i)] + above for i in range(len(item))]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(item)), item.field(0), pa.array(paths, _PATH)], ["tree", "rank", "path"])

    return written(blocks.select("tree", "block", "n", "items", "above").mapInArrow(run, f"tree string, rank long, path {PATH}"), name), roots


def manifest(rows: DataFrame, group: str, key: str, leaf: str, changed: str, proofs: bool = False, depth: int = DEPTH) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified (and proof, if proofs) of every row.

    leaf and changed are columns of hex digests; changed is null where a row is as it was.
    proof holds, for each level from the leaf to the root, the siblings' digests left and
    right of the path, and proof_sha256 the digest of all of them in order.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(key).cast("long").alias("key"), F.unhex(F.col(leaf)).alias("digest"), F.unhex(F.col(changed)).alias("changed"))
    blocks = _blocks(ranked(leaves, "leaves", "key", "digest"), depth, "leaves", "key", "changed")
    paths, subroots = _paths(_tops(blocks, depth, "tops"), depth, "trees")
    # The groups' roots are one more tree, whose path is the end of every path.
    groups = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest")), "groups", "group")
    ends, root = _paths(groups.select("tree", "rank", "n", "digest"), depth, "groups")
    ends = groups.join(ends.select("rank", "path"), "rank").crossJoin(F.broadcast(root.select("root")))  # one row: the root of all
    ends = checked(ends.select(F.col("group").alias("tree"), F.col("path").alias("end"), F.hex("digest").alias("subroot"), F.hex("root").alias("root")), "groups")
    met = blocks.join(paths.select("tree", F.col("rank").alias("block"), F.col("path").alias("above")), ["tree", "block"]).join(ends, "tree")
    met = met.select("n", "items", F.concat("above", "end").alias("above"), F.lower("subroot").alias("subroot"), F.lower("root").alias("root"))
    fields = [("key", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
    out = pa.schema(fields + [("proof", _PATH)] * proofs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                item = batch.column(1)[r].values
                levels, states = climb(_hexed(item), batch.column(0)[r].as_py(), depth)
                above = [(p["left"].encode(), p["right"].encode()) for p in batch.column(2)[r].as_py()]
                upper = [hashlib.sha256(left) for left, _ in above]  # the states of the block's slots
                rest = b"".join(left + right for left, right in above)
                subroot, root = (batch.column(k)[r].as_py() for k in (3, 4))
                proof_sha, folded, whole = [], [], []
                for i, (old, new) in enumerate(zip(levels[0], _hexed(item, 3), strict=True)):
                    path = siblings(levels, i)
                    node = fold(states, path, i, new or old)
                    for before, (_, right) in zip(upper, above, strict=True):
                        h = before.copy()
                        h.update(node)
                        h.update(right)
                        node = h.hexdigest().encode()
                    folded.append(node.decode())
                    proof_sha.append(hashlib.sha256(b"".join(left + right for left, right in path) + rest).hexdigest())
                    if proofs:
                        whole.append([{"left": a.decode(), "right": b.decode()} for a, b in path + above])
                m = len(item)
                columns = [item.field(2), pa.array([d.decode() for d in levels[0]]), pa.array([subroot] * m), pa.array([root] * m), pa.array(proof_sha), pa.array(folded), pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(whole, _PATH)] if proofs else []), schema=out)

    schema = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", proof {PATH}" if proofs else "")
    return met.mapInArrow(run, schema)


def tampered(key: Column) -> Column:
    """Whether 3 divides the crc32 of the decimal key; never for nulls."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def documents_manifest(documents: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", proofs: bool = False, depth: int = DEPTH) -> DataFrame:
    """The manifest of documents by lang, with the texts of every tampered() row put in lower case (A-Z)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    column = {f: F.col(f"`{f}`") for f in fields}
    changed = digest(*[F.translate(c, upper, lower) if f == text else c for f, c in column.items()])
    rows = documents.select(column["lang"].alias("group"), column["doc_id"].alias("key"), digest(*column.values()).alias("leaf"), F.when(tampered(column["doc_id"]), changed).alias("changed"))
    return manifest(rows, "group", "key", "leaf", "changed", proofs, depth).withColumnRenamed("key", "doc_id")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(levels: int = 8, forest: int = 4) -> str:
    """The manifest in SQL for groups of up to 8 ** levels leaves and 8 ** forest groups."""
    item = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(item(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce(range(8), lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END, xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT), lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"
    ctes = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN coalesce({crc} % 3 = 0, false) THEN {leaf(lower)} ELSE {leaf('text')} END AS changed FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS uid FROM d)",
        "a0 AS (SELECT lang AS tree, pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS d FROM l)",
        "f0 AS (SELECT uid, lang AS tree, pos, changed AS f, '' AS p FROM l)",
    ]

    def level(nodes: str, folds: str, k: int) -> None:
        ctes.append(f"{nodes}{k + 1} AS (SELECT tree, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {nodes}{k} GROUP BY tree, pos // 8)")
        run = "string_agg(CASE WHEN s.pos = t.pos THEN t.f ELSE s.d END, '' ORDER BY s.pos)"
        others = "coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos <> t.pos), '')"
        ctes.append(f"{folds}{k + 1} AS (SELECT uid, t.tree, t.pos // 8 AS pos, CASE WHEN max(s.n) > 1 THEN sha256({run}) ELSE t.f END AS f, t.p || {others} AS p FROM {folds}{k} t JOIN {nodes}{k} s ON s.tree IS NOT DISTINCT FROM t.tree AND s.pos // 8 = t.pos // 8 GROUP BY uid, t.tree, t.pos, t.f, t.p)")

    for k in range(levels):
        level("a", "f", k)
    ctes.append(f"r AS (SELECT tree AS lang, d AS subroot, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos FROM a{levels})")
    ctes.append("b0 AS (SELECT '' AS tree, pos, count(*) OVER () AS n, subroot AS d FROM r)")
    ctes.append(f"g0 AS (SELECT uid, '' AS tree, r.pos, f, p FROM f{levels} JOIN r ON r.lang IS NOT DISTINCT FROM tree)")
    for k in range(forest):
        level("b", "g", k)
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, b{forest}.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b{forest}.d AS verified "
        f"FROM l JOIN r ON r.lang IS NOT DISTINCT FROM l.lang JOIN g{forest} USING (uid), b{forest}"
    )
