"""The corpus operators against brute force, SQL, exact round trips and held-out labels; nulls, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echoform.llm import decontam, fingerprints, licences, mixing, ngram_join, quality, suffix_dedup, toxicity, urls, warc
from echoform.llm._text import LOWER, ngram_hashes
from echoform.llm.components import components

DATA = "/root/testdata/sf0.001"
need_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, items string, n int, component string, start int"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those that operators use inside."""
    full = [(d, t, "en", s, None if t is None else len(t), "h", "i", 1, "c", 7) for d, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def words_of(rng, n, pool=400):
    return " ".join(f"w{int(v)}" for v in rng.integers(0, pool, n))


def odd_documents():
    """Copies, near copies, shared passages, nulls, empties, repeats, non-ASCII text and a long document."""
    rng = np.random.default_rng(0)
    base = [words_of(rng, int(n)) for n in rng.integers(5, 120, 25)]
    passage = "Ünïcode " + words_of(rng, 30)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for k, i in enumerate((3, 3, 7, 9, 9)):
        rows.append((40 + k, base[i], "s0"))
    for k in range(12):
        w = base[11].split(" ") + words_of(rng, 60).split(" ")
        w = (base[11] + " " + base[12] + " " + base[13]).split(" ")
        w[int(rng.integers(len(w)))] = f"new{k}"
        rows.append((60 + k, " ".join(w), "s1"))
    for k in range(6):
        rows.append((80 + k, base[k] + " " + passage + " " + words_of(rng, 20), None))
    rows += [(100, None, "s0"), (101, "", None), (102, " \t\n ", "s2"), (103, "one", "s2"), (104, "ONE", "s2"), (105, "two words", "s1"), (None, "null id " + passage, "s1"), (106, " ".join([base[0]] * 40), "s2"), (107, "x" * 49, "s0"), (108, "x" * 50, "s0"), (109, "x" * 60, "s0"), (8, base[8], "s2")]
    return rows


# 1. WARC


def test_warc_round_trip(spark, tmp_path):
    big = "b" * 1000
    noise = "".join(chr(32 + b % 90) for b in np.random.default_rng(1).integers(0, 90, 17 << 20))  # a record of more than 16 MiB
    rows = [(1, "http://a/ x", big), (2, None, big), (3, "http://c", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "http://é", noise), (None, "n", big), (3, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_id", F.lit(1)).withColumn("value", F.lit("x"))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    kinds = Counter((r["id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter([(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (None, "response", None)])
    for r in got:
        want = next((h or "").encode() for p, u, h in rows if p == r["id"] and (r["id"] != 3 or h))
        assert r["payload_bytes"] == len(want) and r["payload_digest"] == hashlib.sha1(want).hexdigest()
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == want
    assert {r["uri"] for r in got if r["id"] in (1, 8, 2)} == {"http://a/%20x", "http://é", None}
    import gzip

    for p in (tmp_path / "w").rglob("part-*"):
        assert gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1")  # ordinary tools read the archives


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FEW", 1)  # revisits by a join
    rng = np.random.default_rng(5)
    texts = ["".join(chr(33 + int(b)) for b in rng.integers(0, 90, 3000)) for _ in range(20)]
    pages = spark.createDataFrame([(k, "u", texts[k % 20]) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=10_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert len(sizes) > 4 and max(sizes) < 15_000
    got = {r["id"]: (r["record_type"], r["refers_to"], r["verified"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {k: ("revisit", k + 20, True) if k < 20 else ("response", None, True) for k in range(40)}


def test_warc_notices_damage(spark):
    data = warc.record(1, "u", b"payload", None)
    assert warc.parse(data)["verified"] and not warc.parse(data.replace(b"payload", b"pAyload"))["verified"]
    with pytest.raises(ValueError):
        warc.parse(data[:-6] + b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.members(memoryview(warc.member(data, 6)[:-3])))


def test_warc_of_an_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


# 2. Mixing


def test_mix_meets_its_targets(spark):
    rows = odd_documents()
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, size(t)) for d, t, _ in rows)
    sources = {}
    for d, t, s in rows:
        sources[s] = sources.get(s, 0) + size(t)
    weight = dict(zip(sorted(sources, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9, strict=False))
    # Water filling by small steps of reasoning: share, cap, share the rest.
    target, free, left = {}, set(sources), 1.5 * sum(sources.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sources[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sources[s] for s in full}
        left -= sum(2 * sources[s] for s in full)
        free -= full
    taken = {}
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sources[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    again = mixing.mix(docs(spark, rows, 5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_prefers_heavy_documents(spark):
    rows = [(i, "a b c d e f g h", "s") for i in range(400)]
    got = mixing.mix(docs(spark, rows), weight=F.when(F.col("doc_id") < 200, 1.0).otherwise(0.1), weights=(1,), share=0.3).collect()
    heavy = sum(r["taken"] for r in got if r["doc_id"] < 200)
    assert heavy > 3 * sum(r["taken"] for r in got if r["doc_id"] >= 200)


def test_take_keeps_documents(spark):
    rows = [*odd_documents(), (3, odd_documents()[3][1], "s0")]
    given = docs(spark, rows).withColumn("Size", F.lit("s"))
    got = mixing.take(given).collect()
    mixed = Counter((r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(given).collect())
    mine = Counter((r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got)
    assert len(got) == len(rows) and sum((mixed - mine).values()) <= 2  # equal rows at an end share
    assert set(got[0].asDict()) == {*given.columns, "size", "source_size", "target", "taken", "copies", "part"} - {"Size"}
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        more = r["taken"] - r["copies"] * r["size"]
        assert re.findall(r"[^\x20\x09-\x0D]+", r["part"] or "") == words[:more] and r["lang"] == "en" and r["hits"] == "h"
    assert mixing.take(docs(spark, [], 1)).count() == 0


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [], 1)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None, "s"), (2, "", None)])).collect()] == [0, 0]


# 3 and 10. Classifiers


def test_toxicity_of_planted_words(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        w = words_of(rng, int(rng.integers(20, 80)), 3000).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for k in rng.integers(0, len(w), 3):
                w[int(k)] = ("grobian", "schuft", "lump")[int(k) % 3]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "s"), (901, "", "s")]
    table = spark.createDataFrame([*labels, (5, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), table)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), model).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(truth[i]) for i in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs(spark, rows), model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}


def test_toxicity_scores_by_a_plain_loop():
    """Scores of a model against words compressed one by one, with counts kept in Python."""
    import math

    import zstandard

    rng = np.random.default_rng(6)
    texts = [words_of(rng, int(rng.integers(5, 60)), 2000) + (" bad%d awful%d" % (k % 7, k % 5) if k % 2 else "") for k in range(200)]
    sample = [(t.encode(), k % 2) for k, t in enumerate(texts)]
    model = toxicity.train(sample, {0: 900, 1: 100})
    assert model.toxic != model.ordinary and all(len(d) > 1000 for d in (model.toxic, model.ordinary))
    trained = [zstandard.ZstdCompressionDict(d) for d in (model.ordinary, model.toxic)]
    assert all(d.dict_id() for d in trained)  # whole dictionaries, not raw content
    plain = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False) for d in trained]
    odd = [*texts[:40], "", None, "BAD1 bad1; é-bad3", "x" * 5000, " ".join(["bad2"] * 3000)]
    for text, got in zip(odd, toxicity.scores(model, pa.array(odd, pa.string())), strict=True):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        saved = [len(plain[0].compress(b" " + w + b" " + toxicity.FRAME)) - len(plain[1].compress(b" " + w + b" " + toxicity.FRAME)) for w in words]
        tests = [*(lambda s, w, k=k: s >= k for k in toxicity.SAVINGS), *(lambda s, w, q=q: s >= q * len(w) and s > 1 for q in toxicity.SHARES), *(lambda s, w, k=k: s <= -k for k in toxicity.LOSSES)]
        x = [1.0, math.log1p(len(words))]
        for test in tests:
            n = sum(test(s, w) for s, w in zip(saved, words, strict=True))
            x += [math.log1p(n), math.sqrt(n / max(1, len(words))), float(n > 0), float(n > 2)]
        x.append(sum(saved) / max(1, len(words)))
        margin = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.spread, model.weights, strict=True))
        assert math.isclose(got, 1 / (1 + math.exp(-max(-30, min(30, margin)))), rel_tol=1e-6)


@need_data
def test_toxicity_on_held_out_labels(spark):
    """With some 350 toxic documents to learn from, few clean documents are accused and half of the toxic ones are found."""
    big = Path("/root/testdata/sf0.1")
    if not big.exists():
        pytest.skip("no larger tables here")
    got = toxicity.op3_toxicity(spark, str(big)).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("toxic is not null").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r["score"] for r in got if r["toxic"] == c] for c in (1, 0))
    assert sum(s >= 0.5 for s in clean) <= 0.03 * len(clean) and sum(s >= 0.5 for s in toxic) >= 0.4 * len(toxic)
    assert np.mean([[(t > c) + (t == c) / 2 for c in clean] for t in toxic]) > 0.85


def test_samples_are_bounded_by_rows(spark):
    from echoform.llm._labels import labelled_sample

    rows = [(1, f"text {k % 50}", "s") for k in range(3000)] + [(k, f"other {k}", "s") for k in range(2, 40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, toxic int")
    sample, counts = labelled_sample(docs(spark, rows), labels, "toxic", F.lit(True), 10, 1000)
    assert sample.count() <= 20 and counts == {0: 19, 1: 20}


def test_quality_scores_by_a_plain_loop(spark):
    """A model's scores against indicators, ratios and margins in plain Python."""
    import math

    rng = np.random.default_rng(14)
    texts = [words_of(rng, 30) + ("!" * (k % 9) if k % 3 else " fine words") for k in range(120)]
    table = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int")
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    model, norm = quality.fit(docs(spark, rows), table)
    odd = [*rows[:30], (200, "", "s"), (201, None, "s"), (202, "é!" * 4000, "s"), (203, "a", "s")]
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, odd), model, norm).collect()}
    for d, t, _ in odd:
        raw, ids = (t or "").encode(), set()
        for n in range(1, quality.LONGEST + 1):
            for i in range(len(raw) - n + 1):
                packed = int.from_bytes(raw[i : i + n], "big")
                ids.add((packed + (n * 0x3C6EF372 & 0xFFFFFFFF)) * 2654435761 % (1 << 32) >> (32 - quality.PLACES))
        length = math.sqrt(sum(float(norm[k]) for k in ids))
        margin = (sum(float(model.weights[k]) for k in ids) / length if length else 0.0) + model.bias
        assert math.isclose(got[d], 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * margin))), rel_tol=1e-3)


def test_descent_reaches_the_least_loss():
    """Dual coordinate descent against a fine search by subgradient steps."""
    rng = np.random.default_rng(3)
    r, y = rng.normal(size=12), np.where(rng.random(40) < 0.5, 1.0, -1.0)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in y]
    w, b = quality.descend(rows, r, y, rounds=2000)
    x = np.zeros((40, 13))
    for k, ids in enumerate(rows):
        v = r[ids]
        x[k, ids] = v / np.sqrt((v * v).sum()) if len(ids) else v
    x[:, 12] = 1
    loss = lambda u: u @ u / 2 + quality.COST * np.maximum(0, 1 - y * (x @ u)).sum()
    best, u = np.inf, np.zeros(13)
    for t in range(1, 20000):
        u = u - (u - quality.COST * (x * y[:, None])[y * (x @ u) < 1].sum(0)) / (t + 10)
        best = min(best, loss(u))
    assert loss(np.append(w, b)) <= best * 1.002


def test_classifiers_without_labels(spark):
    d, none = docs(spark, [(1, "a b", "s"), (2, None, "s")]), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r["score"] for r in toxicity.score(d, toxicity.fit(d, none)).collect()} == {0.0}
    assert {r["score"] for r in quality.score(d, *quality.fit(d, none)).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(5)], "doc_id long, toxic int, quality int")
    assert toxicity.score(d, toxicity.fit(d, one)).count() == 2 and quality.score(d, *quality.fit(d, one)).count() == 2


def test_quality_of_planted_symbols(spark):
    rng = np.random.default_rng(4)
    rows = [(i, words_of(rng, 40) if i % 5 else " ".join(w + "***" for w in words_of(rng, 40).split(" ")), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, [*rows, (900, None, "s")]), *quality.fit(docs(spark, rows), labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == (i % 5 > 0) for i in held) >= 0.97 * len(held) and 0 <= got[900] <= 1


def test_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    w, b = quality.descend(rows, np.ones(4), np.array([1.0, 1, -1, -1]))
    assert w[0] + b > 0 > w[1] + b and abs(w[2]) < 0.2


# 4. N-gram join


def brute_components(rows, words, per_cent):
    sets = []
    for d, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append((d, frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min((v for v in (least.get(r), d) if v is not None), default=None)
    return Counter((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("words, per_cent, tokens", [(4, 85, 3_000_000), (5, 80, 300), (2, 60, 3_000_000)])
def test_join_against_brute_force(spark, words, per_cent, tokens):
    rows = odd_documents()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs(spark, rows), words, per_cent, task_tokens=tokens).collect())
    assert got == brute_components(rows, words, per_cent)


def test_join_of_nothing(spark):
    assert ngram_join.link(docs(spark, [], 1)).count() == 0
    assert [tuple(r) for r in ngram_join.link(docs(spark, [(5, None, "s")])).collect()] == [(5, 0, 5)]


def plain_join(sets, per_cent):
    """The first set of each set's component, by the overlaps of all pairs."""
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), which.max() + 1), np.float32)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), which] = 1
    both, n = has @ has.T, has.sum(1)
    near = 100 * both >= per_cent * (n[:, None] + n[None] - both)
    groups = ngram_join.Groups(len(sets))
    for i, j in zip(*np.nonzero(near), strict=True):
        groups.join(int(i), int(j))
    return [groups.find(i) for i in range(len(sets))]


def distinct(sets):
    return list({s.tobytes(): s for s in sets}.values())


def test_tree_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.integers(0, 60, 25)
        sets = distinct(np.unique(np.where(rng.random(25) < 0.12, rng.integers(0, 60, 25), base)).astype(np.uint64) for _ in range(25))
        want = plain_join(sets, 70)
        assert ngram_join.join_sets(sets, 70) == want
        known = [w if k % 3 else k for k, w in enumerate(want)]
        assert ngram_join.join_sets(sets, 70, known) == want


@pytest.mark.parametrize("per_cent, change", [(85, 0.05), (80, 0.1), (70, 0.1)])
def test_tree_of_thousands(per_cent, change):
    """Bases of which each has copies that differ a little, long stretches that all share, and sets inside others."""
    rng = np.random.default_rng(int(per_cent))
    shared, sets = rng.integers(0, 1 << 40, 40), []
    for k in range(46):
        base = np.concatenate([shared[: 8 * (k % 6)], rng.integers(0, 1 << 40, int(rng.integers(20, 90)))])
        for _ in range(50):
            own = np.where(rng.random(len(base)) < change * rng.random() * 2, rng.integers(0, 1 << 40, len(base)), base)
            sets.append(np.unique(own[: int(rng.integers(len(own) * 3 // 4, len(own) + 1))]).astype(np.uint64))
    sets = distinct(sets)
    assert len(sets) > 2000 and ngram_join.join_sets(sets, per_cent) == plain_join(sets, per_cent)


def test_tree_prunes(monkeypatch):
    """The walks leave most of the tree unvisited, by the bounds among strangers and by components among near copies."""
    rng, steps = np.random.default_rng(7), []
    walk = ngram_join.Trie.walk

    def counted(trie, *args):
        before = trie.steps
        walk(trie, *args)
        steps.append(trie.steps - before)

    monkeypatch.setattr(ngram_join.Trie, "walk", counted)
    common = np.arange(30, dtype=np.uint64)
    for copies in (1, 300):
        bases = [np.concatenate([common, rng.integers(100, 1 << 40, 100)]) for _ in range(600 // copies)]
        sets = distinct(np.unique(np.where(rng.random(130) < 0.02, rng.integers(100, 1 << 40, 130), b)).astype(np.uint64) for b in bases for _ in range(copies))
        steps.clear()
        ngram_join.join_sets(sets, 85)
        assert sum(steps) < len(sets) ** 2 / (1.5 if copies == 1 else 5)


def test_join_of_many_rows(spark):
    """Groups that need both rounds, and buckets cut into parts and classes, at several limits of a task."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(12):
        base = words_of(rng, int(rng.integers(20, 120)), 5000).split(" ")
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[int(at)] = f"x{int(rng.integers(1 << 30))}"
            rows.append((len(rows), " ".join(w[int(rng.integers(0, 4)) :]), "s"))
    want = brute_components(rows, 4, 85)
    for most in (200_000, 150):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs(spark, rows), 4, 85, task_tokens=most).collect())
        assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7)] + [(5000, k) for k in range(5001, 8000)] + [(5000, 4000), (5000, 4000)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(51)} == {0} and got[100] == got[95] == got[90] == 90 and {got[k] for k in range(5000, 8000)} == {4000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5. URL filters


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x?q"), (2, "http://example.org/en/12"), (3, "http://example.org"), (4, None), (5, "nothing"), (6, "x://b.com/de/#f"), (7, "x://notexample.org/es/"), (8, "x://com/fr/"), (8, "x://com/fr/"), (None, "a://org/://b")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("size", F.lit(3)).withColumn("digest", F.lit("d")), urls.RULES)
    have = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect())
    assert have == Counter([
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "example.org", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "b.com", "/de/", "com/de/", "block"), (7, "notexample.org", "/es/", "org/", "allow"), (8, "com", "/fr/", "com/fr/", "allow"), (8, "com", "/fr/", "com/fr/", "allow"), (None, "org", "/://b", "org/", "allow"),
    ])
    clash = urls.filter_urls(spark.createDataFrame([(1, "http://a.org/" + "p" * 50000, "x", "y")], "page_id long, url string, Host string, PATH string"), [urls.Rule("a.org", "/p", "allow"), urls.Rule("a.org", "/p", "block")])
    assert clash.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and clash.first()["verdict"] == "block"
    assert urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [], default="block").where("verdict = 'block'").count() == len(rows)


# 6. Suffix sort


def brute_spans(rows, length=50):
    """(id, bytes, kept) of each row, by a table of all strings."""
    last = suffix_dedup.LAST
    first = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, last), last if d is None else d)
    out = []
    for d, t, _ in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (last if d is None else d):
                mask[i : i + length] = b"\1" * length
        out.append((d, b, mask))
    return out


def test_spans_against_brute_force(spark):
    rows = odd_documents()
    want = Counter((d, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(x for x, k in zip(b, m, strict=True) if not k)).hexdigest()) for d, b, m in brute_spans(rows))
    assert Counter(tuple(r) for r in suffix_dedup.report(docs(spark, rows)).collect()) == want
    texts = {r["doc_id"]: r["text"] for r in suffix_dedup.strip(docs(spark, rows)).collect()}
    for d, b, m in brute_spans(rows):
        if d not in (None, 8) and not any(c & 0x80 for c in b):
            assert (texts[d] or "") == bytes(x for x, k in zip(b, m, strict=True) if not k).decode()
    assert suffix_dedup.report(docs(spark, [], 1)).count() == 0 and suffix_dedup.strip(docs(spark, [], 1)).count() == 0


def test_suffix_sort_and_collisions(monkeypatch):
    raw = np.frombuffer(("abracadabra " * 40 + "abracadabrb" * 20).encode(), np.uint8)
    at = np.arange(0, len(raw) - 50, 3)
    segment = np.sort(np.arange(len(at)) % 3)
    s = suffix_dedup.Suffixes(raw, np.array([len(raw)]))
    order = s.sort(at, segment)
    key = lambda k: (int(segment[k]), raw[at[k] : at[k] + 50].tobytes())
    assert [key(k) for k in order] == sorted(key(k) for k in range(len(at)))
    numbers = lambda c: {(c[i], key(i)) for i in range(len(at))}
    good = suffix_dedup.classes(s, at, segment)
    assert len(numbers(good)) == len({n for n, _ in numbers(good)}) == len({k for _, k in numbers(good)})
    s.prefix = np.zeros_like(s.prefix)  # every hash collides
    bad = suffix_dedup.classes(s, at, segment)
    assert len(numbers(bad)) == len({n for n, _ in numbers(bad)}) == len({k for _, k in numbers(bad)})


# 7. Decontamination


def brute_hits(rows, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = Counter()
    for d, t, _ in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i : i + size]))
                if got:
                    hit |= set(range(i, i + size))
                    found |= got
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("most", [decontam.MAX_BYTES, 10])
def test_hits_against_brute_force(spark, most):
    rows = odd_documents()
    items = [(1, rows[0][1]), (2, rows[5][1].upper()), (3, "two words"), (4, None), (5, ""), (10, rows[0][1]), (11, rows[31][1][:90]), (12, "one"), (13, "-".join(rows[7][1].split(" ")))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontam.report(decontam.scan(docs(spark, rows), bench, max_bytes=most)).collect())
    assert got == brute_hits(rows, items)
    bad = {k[0] for k in got if k[5]}
    kept = decontam.decontaminate(docs(spark, rows), bench, max_bytes=most).collect()
    assert {r["doc_id"] for r in kept} == {d for d, *_ in rows} - bad
    assert all(r["hits"] == "h" and r["items"] == "i" for r in kept)
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs(spark, rows), bench, "spans", max_bytes=most).collect()}
    assert cut[103] == "" and cut[105] == "" and cut[1] == rows[1][1]
    assert decontam.report(decontam.scan(docs(spark, [], 1), bench)).count() == 0
    assert decontam.report(decontam.scan(docs(spark, rows), bench.limit(0))).where("contaminated").count() == 0


# 8. Fingerprints


def plain_fingerprint(text):
    """Lanes of a text, word by word and paragraph by paragraph, in Python numbers."""
    from echoform.llm._text import BASE, BYTE

    top = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & top
        return x ^ x >> 31

    def span(raw):
        return mix((sum(int(BYTE[b]) * pow(int(BASE), k, 1 << 64) for k, b in enumerate(raw)) + len(raw) * 0xD6E8FEB86659FD93) & top)

    exact, like = [0] * fingerprints.EXACT, [0] * fingerprints.LIKE
    for line in text.encode().split(b"\n"):
        wide = hashlib.blake2b(line, digest_size=64).digest()
        for k in range(fingerprints.EXACT):
            exact[k] = (exact[k] + int.from_bytes(wide[8 * k : 8 * k + 8], "little")) & top
        words = [span(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", line)]
        n = min(fingerprints.RUN, len(words))
        for i in range(len(words) - n + 1) if n else ():
            g = 0
            for w in words[i : i + n]:
                g = (g * int(BASE) + w) & top
            g = mix((g + n) & top)
            like[g % fingerprints.LIKE] += 1 if g >> 63 else -1
    return exact, like


def plain_likeness(a, b):
    if a == b:
        return 1.0
    both = sum(v * v for v in a[1]) + sum(v * v for v in b[1])
    return max(0.0, min(1.0, 2 * sum(x * y for x, y in zip(a[1], b[1], strict=True)) / (both or 1)))


@pytest.mark.parametrize("part_bytes", [1 << 26, 700])
def test_fingerprints(spark, part_bytes):
    """Every column against plain Python, null ids, repeated ids, nulls, empty and long texts included."""
    import base64

    rows = [*odd_documents(), (None, "a second null id\nwith lines", "s"), (200, "\n\n", "s"), (201, "one two\nthree\n" * 300, "s"), (201, "x " * 30000, "s")]
    got = fingerprints.compare_with_next(docs(spark, rows), part_bytes=part_bytes).collect()
    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    known, want = {}, Counter()

    def lanes(t):
        if t not in known:
            known[t] = plain_fingerprint(t)
        return known[t]

    code = lambda f: base64.b64encode(np.array(f[0], np.uint64).tobytes() + np.array(f[1], np.int64).astype(np.uint32).tobytes()).decode()
    for k, (d, t) in enumerate(order):
        s = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + s[:q]
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), code(lanes(t)), code(lanes(e)), round(plain_likeness(lanes(t), lanes(e)), 6), round(plain_likeness(lanes(t), lanes(s)), 6)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 6), round(r["near_next"], 6)) for r in got) == want
    assert fingerprints.compare_with_next(docs(spark, [], 1)).count() == 0
    one = fingerprints.compare_with_next(docs(spark, [(1, "abcdefgh", "s")])).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 8


def test_fingerprints_add_up():
    a, b = "first paragraph of words", "second one\nand a third, here"
    f = fingerprints.fingerprint
    assert fingerprints.combine(f(a), f(b)) == f(a + "\n" + b) == f(b + "\n" + a)
    assert fingerprints.combine(f(a + "\n" + b), f(b), -1) == f(a)
    assert f("a\n\nb") != f("a\nb") and f("ab") != f("ba")
    rng = np.random.default_rng(6)
    w = words_of(rng, 400).split(" ")
    x, y, z = " ".join(w), " ".join(w[:300]) + " " + words_of(rng, 100), words_of(rng, 400)
    like = lambda s, t: fingerprints.likeness(*(np.stack([v]) for v in (*lanes(s), *lanes(t))))[0]
    lanes = lambda s: (np.frombuffer(f(s), np.uint64, fingerprints.EXACT), np.frombuffer(f(s), np.uint32, fingerprints.LIKE, fingerprints.EXACT * 8))
    assert like(x, x) == 1 and 0.6 < like(x, y) < 0.9 and like(x, z) < 0.2


def test_fingerprints_of_long_repeats(spark):
    rows = [(1, "word " * 40000, "s"), (2, words_of(np.random.default_rng(2), 20000), "s")]
    got = {r["doc_id"]: r["near_edited"] for r in fingerprints.compare_with_next(docs(spark, rows)).collect()}
    assert 0.7 < got[1] <= 1 and 0 <= got[2] <= 1


# 9. Licences


def test_licences(spark):
    rows = [(1, "Released under the MIT License.", "s"), (2, "some text\nLICENSED under the Apache License, version 2.0\nmore", "s"), (3, "Released under the terms of nothing", "s"), (4, None, "s"), (5, "", "s"), (6, "This work is\nlicensed under the GNU General Public License,\nversion 3.", "s"), (6, "no", "s"), (7, "a license for software released to the domain", "s")]
    got = Counter((r["doc_id"], r["licence"], round(r["dice"], 3), r["n_matches"]) for r in licences.scan(docs(spark, rows)).collect())
    assert got == Counter([(1, "MIT", 1.0, 1), (2, "Apache-2.0", 1.0, 2), (3, None, 0.0, 0), (4, None, 0.0, 0), (5, None, 0.0, 0), (6, "GPL-3.0", 1.0, 1), (6, None, 0.0, 0), (7, None, 0.0, 0)])
    assert licences.scan(docs(spark, rows), {}).where("n_matches > 0").count() == 0
    plain = spark.range(3).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    plan = licences.scan(plain)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_licences_in_windows(spark):
    rows = [
        (1, "Our library is fast. Released under the MIT License.", "s"), (2, "Head of it\nThis work is licensed under the GNU General Public License,\nversion 3.\nfoo bar", "s"),
        (3, "x\nReleased under the\nMIT License. And this: Licensed under CC BY 4.0. " + "word " * 30, "s"), (4, "a b c\n\nReleased under the\n\nBSD 3-Clause License.\n" * 3 + "end of it all " * 9, "s"), (5, "Released under no\nLicense. MIT", "s"),
    ]
    got = {r["doc_id"]: (r["licence"], round(r["dice"], 3), r["licences"], r["n_matches"]) for r in licences.scan(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", 1.0, "MIT", 1), 2: ("GPL-3.0", 1.0, "GPL-3.0", 1), 3: ("CC-BY-4.0", 1.0, "CC-BY-4.0,MIT", 2), 4: ("BSD-3-Clause", 1.0, "BSD-3-Clause", 3), 5: (None, 0.0, "", 0)}


def test_whole_licences(spark):
    prose = words_of(np.random.default_rng(9), 300)
    rows, want = [], {}
    for k, p in enumerate(sorted(licences.TEXTS.glob("*.txt"))):
        whole = p.read_text()
        rows += [(3 * k, whole, "s"), (3 * k + 1, prose + "\n * " + "\n * ".join(whole.split("\n")) + "\n" + prose, "s"), (3 * k + 2, prose + " Copyright 2020 A. Person. " + " ".join(whole.split()), "s")]
        want |= {3 * k + i: p.stem for i in range(3)}
    mit = (licences.TEXTS / "MIT-text.txt").read_text().replace("AUTHORS OR COPYRIGHT HOLDERS", "PEOPLE OF EXAMPLE CORPORATION").replace("included in all", "kept in all")
    rows += [(900, prose + "\n" + mit + prose, "s"), (901, prose + " copyright software warranty license merchantability. " + prose, "s")]
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, rows)).collect()}
    assert {"MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "GPL-2.0-text", "GPL-3.0-text", "GPL-3.0-notice"} <= set(want.values())
    for d, name in want.items():
        assert name in got[d]["licences"].split(",") and got[d]["dice"] > 0.97, (d, name, got[d])
    assert got[900]["licence"] == "MIT-text" and 0.8 < got[900]["dice"] < 1
    assert got[901]["licence"] is None


def test_licence_sql_reads_all_paragraphs(spark):
    import duckdb

    rows = [(1, "Released under the MIT", "s"), (2, "a text\nunder CC BY 4.0", "s"), (3, "no word of it", "s")]
    values = ", ".join(f"({d}, '{t}')" for d, t, _ in rows)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM (VALUES {values}) AS v(doc_id, text)")
    want = sorted((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in con.execute(licences.oracle()).fetchall())
    assert sorted((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in licences.scan(docs(spark, rows)).collect()) == want
    assert [w[1] for w in want] == ["MIT", "CC-BY-4.0", None]


# All of them


@need_data
def test_queries_match_their_sql(spark):
    import duckdb

    from echoform.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, DATA), c.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        norm = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(str([norm(r[k]) for k in cols]) for r in got.collect()) == sorted(str([norm(dict(zip(want.columns, r, strict=True))[k]) for k in cols]) for r in want.fetchall()), name


@need_data
def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    start = spark.read.parquet(f"{DATA}/documents.parquet")
    inputs, outputs = [], []
    read = start
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(read.collect())
        out = stage(spark, read, DATA)
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        read = spark.read.parquet(path)
        outputs.append(read.collect())
        assert set(start.columns) <= set(read.columns)
        if name != "mix":
            assert read.columns == start.columns and [f.dataType for f in read.schema] == [f.dataType for f in start.schema]
    rows = lambda k: [(r["doc_id"], r["text"], r["source"]) for r in k]
    linked = brute_components(rows(inputs[1]), 5, 80)
    assert {r["doc_id"] for r in outputs[1]} == {c for _, _, c in linked}
    kept = {d: bytes(x for x, k in zip(b, m, strict=True) if not k) for d, b, m in brute_spans(rows(inputs[2]))}
    for r in outputs[2]:
        assert r["n_chars"] == len(r["text"]) and abs(len(r["text"].encode()) - len(kept[r["doc_id"]])) <= 8 * (1 + len(r["text"]) // 500)
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k[0] for k in brute_hits(rows(inputs[3]), bench) if k[5]}
    assert {r["doc_id"] for r in outputs[3]} == {r["doc_id"] for r in inputs[3]} - bad
    assert {r["doc_id"] for r in outputs[4]} == {r["doc_id"] for r in outputs[3]}
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(str, whole)) == sorted(map(str, outputs[4]))


def test_pipeline_tells_rows_of_one_id_apart(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    same, other = words_of(rng, 60), words_of(rng, 60)
    rows = [(1, same, "s"), (2, same + " more", "s"), (2, other, "s"), (2, None, "s"), (3, "", "s"), (None, same, "s")]
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs(spark, rows), DATA).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, same), (2, other), (2, None), (3, ""), (None, same)])


def test_ngrams_are_told_apart():
    tokens = np.array([1, 2, 3, 1, 2], np.uint64)
    h, at = ngram_hashes(tokens, np.array([0, 0, 0, 1, 1]), 2)
    assert at.tolist() == [0, 1, 3] and h[0] == h[2] != h[1] and LOWER[65] == 97
