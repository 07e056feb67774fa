"""The Merkle manifest against a plain tree that is built again for every row."""

import hashlib
import zlib

import pytest

from echoform.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, key string, _range int, n long"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names are those used inside."""
    return spark.createDataFrame([(d, t, lang, s, None if t is None else len(t), "t", 5, "k", 1, 9) for d, t, lang, s in rows], DOCS).repartition(parts)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    d, _, lang, s, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, text)])


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climbed(levels, i, node):
    """(root, siblings) with node i replaced."""
    found = []
    for level in levels[:-1]:
        first = i - i % 8
        run = level[first : first + 8]
        found += run[: i - first] + run[i - first + 1 :]
        run[i - first] = node
        node, i = h(*run), i // 8
    return node, found


def plain(rows):
    rows = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: build([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    forest = build([trees[g][-1][0] for g in order])
    out = []
    for g in order:
        for i, (_, _, old, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            top, near = climbed(trees[g], i, leaf(r, lower(r[1])) if tampered else old)
            root, far = climbed(forest, order.index(g), top)
            out.append((r[0], old, trees[g][-1][0], forest[-1][0], h(*near, *far), root, root == forest[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_equals_a_plain_tree(spark, depth):
    rows = [(i, f"Text {i} É", "en" if i % 3 else "fr", "S") for i in range(700)]
    rows += [(5, "Again", "en", None), (5, "Again", "en", None), (None, "No Id", "en", "s"), (None, None, None, None), (900, "", "", "s"), (901, "ONE", "zz", "s"), (902, "Long " * 40_000, "é", "s"), (903, None, "en", "s")]
    rows += [(7, "Copy", "en", "s")] * 90  # equal rows
    got = manifest.documents_manifest(docs(spark, rows), proofs=True, depth=depth).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(plain(rows), key=key)
    assert {r["verified"] for r in got} == {True, False}
    for r in got[:50]:
        assert h(*[p["left"] + p["right"] for p in r["proof"]]) == r["proof_sha256"]


@pytest.mark.parametrize("n", [1, 8, 65, 513])
def test_manifest_at_the_edges_of_blocks(spark, n):
    rows = [(i, f"T{i}", "en", "s") for i in range(n)]
    got = manifest.documents_manifest(docs(spark, rows)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(plain(rows))
    if n == 1:
        assert got[0]["leaf"] == got[0]["root"] and got[0]["proof_sha256"] == h("")


def test_folding_resumes_retained_states():
    nodes = [h(str(i)).encode() for i in range(70)]
    levels, states = manifest.climb(nodes, 70)
    for i in (0, 7, 8, 63, 64, 69):
        path = manifest.siblings(levels, i)
        assert manifest.fold(states, path, i, nodes[i]) == levels[-1][0]
        assert manifest.fold(states, path, i, b"x" * 64).decode() == climbed([[n.decode() for n in level] for level in levels], i, "x" * 64)[0]
    assert manifest.fold(states, manifest.siblings(levels, 3), 3, nodes[3]) == levels[-1][0]  # a fold leaves the states as they were


def test_manifest_of_an_empty_table(spark):
    assert manifest.documents_manifest(docs(spark, [])).collect() == []
