"""Personal data: rules against plain regular expressions, candidates and trees against plain loops, planted cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoform.llm import pii

DOCS = "doc_id long, text string, key string, base array<int>, found string, spans int, h0 string, c0 int, held string"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names are those used inside."""
    return spark.createDataFrame([(d, t, "k", [1], "f", 2, "h", 3, "x") for d, t in rows], DOCS).repartition(parts)


def checksum(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def rules(text):
    """(start, kind, end) of the rules' spans, as the contract words them."""
    out = []
    for k, (kind, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(d) <= 19 and checksum(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def some_documents():
    rng = np.random.default_rng(3)
    pick = lambda v: v[int(rng.integers(len(v)))]
    words = "the order of naïve 東京 house version at and mail call 12 7 x9 Straße 🙂 dot".split(" ")
    prose = lambda n: " ".join(pick(words) for _ in range(n))

    def card(valid):
        d = "4" + "".join(str(int(i)) for i in rng.integers(0, 10, 14))
        last = next(c for c in "0123456789" if checksum(d + c))
        return d + (last if valid else str((int(last) + 3) % 10))

    makers = (
        lambda: f"{pick('abc')}.{int(rng.integers(90))}@mail{int(rng.integers(9))}.example.com",
        lambda: ".".join(str(int(i)) for i in rng.integers(0, 256, 4)),
        lambda: ".".join(str(int(i)) for i in rng.integers(200, 400, 4)),
        lambda: f"+1 ({int(rng.integers(200, 999))}) 555-{int(rng.integers(1000, 9999))}",
        lambda: card(True),
        lambda: card(False),
        lambda: "-".join(re.findall("....", card(True))),
        lambda: f"20{int(rng.integers(10, 99))}-0{int(rng.integers(1, 9))}-1{int(rng.integers(9))}",
        lambda: f"version {int(rng.integers(9))}.{int(rng.integers(99))}.3.1",
        lambda: f"{pick('abc')}{int(rng.integers(99))} (at) host.org",
    )
    texts = [" ".join(x for _ in range(int(rng.integers(1, 6))) for x in (prose(int(rng.integers(0, 6))), pick(makers)())) for _ in range(500)]
    odd = [
        None, "", "x", "@", "a@b", "a@b.c_d@e.f", "a@b.c@d.e", "..@-.-", "1.2.3.4.5.6.7.8", "1.2.3.256", "000001.2.3.4", "999.1.1.1.1.1.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+1+22222222222+", "+123 (45) 67.8-9 0 x +1234567890123456",
        "🙂 a@b.cd 🙂 +1 (743) 555-3824", "a" * 5000, "1" * 5000, "1-" * 3000, "+" + "1 " * 3000, "9." * 3000, "x@y." * 2000, "a@b.cd " * 3000, "+1 " * 2000, " ".join(["4111111111111111"] * 700),
    ]
    return [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(odd)), (None, texts[0]), (3, texts[5])]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = pii.written(pii.candidates(docs(spark, some_documents())), "personal")
    return rows, pii.fit(rows)


def test_rules_equal_plain_expressions(spark, fitted):
    rows = pii.select(fitted[0], fitted[1]).select("key", pii.joined(F.col("base")).alias("b")).collect()
    text = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert Counter((r["key"], r["b"]) for r in rows) == Counter((d, text(rules(t))) for d, t in some_documents())


def near(c):
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c in "0123456789" else 3


def described(kind, v, before, after):
    """The features and the label of a candidate, said again."""
    d = re.sub("[^0-9]", "", v)
    groups = [g for g in re.split("[^0-9]+", v) if g]
    many = sum(len(d) >= n for n in (7, 10, 13, 16, 17, 20))
    bracket, ends = bool(re.search(r"[(\[{<]", v)), lambda g: min(len(g), 4)
    octets = bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v)) and all(int(p) <= 255 for p in v.split("."))
    if kind == "email":
        style = 4 if bracket else 0 if " " not in v else 2 if " dot " in v.lower() else 3 if "@" in v else 1
        check = bool(re.search(r"[^A-Za-z0-9-][A-Za-z]{2,10}$", v))
    else:
        style = 4 if bracket else 1 if " " in v else 2 if "-" in v else 3 if "." in v else 0
        check = {"ip": octets or bool(re.fullmatch("([0-9a-fA-F]*:){7}[0-9a-fA-F]*", v)), "card": checksum(d), "phone": v.startswith(("+", "(", "00"))}[kind]
    cues = re.findall(pii._CUE.replace(r"[\p{L}]", r"[^\W\d_]"), before)
    cue = next((i + 1 for i, listed in enumerate(pii.CUES) if cues and cues[-1].lower() in listed), 0)
    f = [pii.KINDS.index(kind), many, min(len(groups), 5), style, int(check), near(before[-1:]), near(after), cue, ends(groups[0]) if groups else 0, ends(groups[-1]) if groups else 0]
    apart, label = f[5] not in (1, 2) and f[6] not in (1, 2), None
    if kind == "email":
        label = 0 if not check else 1 if style in (0, 2, 4) else 0 if style == 1 and re.match("(?i)[a-z]+ at ", v) else None
    elif kind == "ip":
        label = 0 if (not check and re.fullmatch("[0-9.]+", v)) or not apart or cue == 5 else 1 if check else None
    elif kind == "card":
        label = int(check and apart and 14 <= len(d) <= 19)
    elif not apart or not 7 <= len(d) <= 15 or cue in (5, 3):
        label = 0
    elif v[0] == "+" and 10 <= len(d) <= 15 or cue == 4 and len(d) in (10, 11) and style > 0:
        label = 1
    return f, label


def plain_candidates(text):
    out = []
    for k, pattern in pii.GENERATORS:
        pattern = pattern.replace(pii._START, "")  # found from the left without it
        found = list(re.finditer(pattern, text or ""))
        for i, m in enumerate(found):
            last = found[i - 1].end() if i else 0
            following = found[i + 1].start() if i + 1 < len(found) else len(text)
            f, label = described(pii.KINDS[k], m.group(), text[last : m.start()][-pii.BEFORE :], text[m.end() : following][:1])
            out.append((m.start(), k, m.end(), label, f))
    return out


def evaluated(printed, weights, f):
    """The trees' probability by walking the printed lines."""
    total, tree = 0.0, -1
    lines = printed.split("\n")
    at = 0
    while at < len(lines):
        if lines[at].strip().startswith("Tree "):
            tree, at = tree + 1, at + 1
            while not lines[at].strip().startswith("Predict"):
                m = re.search(r"feature (\d+) <= ([-\d.E]+)", lines[at])
                indent = len(lines[at]) - len(lines[at].lstrip())
                if f[int(m[1])] <= float(m[2]):
                    at += 1
                else:
                    at = 1 + next(i for i in range(at + 1, len(lines)) if lines[i].startswith(" " * indent + "Else"))
            total += weights[tree] * float(lines[at].split(":")[1])
            at = next((i for i in range(at, len(lines)) if lines[i].strip().startswith("Tree ")), len(lines))
        else:
            at += 1
    return 1 / (1 + math.exp(-2 * total))


def test_candidates_trees_and_choice_equal_plain_loops(spark, fitted):
    rows, model = fitted
    got = {(r["key"], len(r["found"]), i): r for i, r in enumerate(rows.collect())}
    want = Counter((d, repr(sorted(plain_candidates(t), key=repr))) for d, t in some_documents())
    assert Counter((r["key"], repr(sorted(((c["s"], c["k"], c["e"], c["label"], list(c["f"])) for c in r["found"]), key=repr))) for r in got.values()) == want
    assert set(model.thresholds) == {pii.EMAIL, pii.IP, pii.CARD, pii.PHONE}
    out = []
    for d, t in some_documents():
        base, kept, seen = rules(t), [], {}
        for s, k, e, label, f in plain_candidates(t):
            score = seen.setdefault(tuple(f), evaluated(model.printed, model.weights, f))
            if label != 0 and score >= model.thresholds[k] and not any(a < e and s < b for a, _, b in base):
                kept.append((s, -e, k, e))
        last = 0
        added = []
        for s, _, k, e in sorted(set(kept)):
            if s >= last:
                added.append((s, k, e))
                last = e
        out.append((d, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + added))))
    spans = pii.select(rows, model).select("key", pii.joined(F.col("spans")).alias("s")).collect()
    assert Counter((r["key"], r["s"]) for r in spans) == Counter(out)


def test_planted_spans_are_added_and_decoys_left(spark):
    planted = [
        (9001, "paid with 12 4111111111111111 on it", (13, "card", 29)),
        (9002, "write to jane77 (at) host.org now", (9, "email", 29)),
        (9003, "the +1 (743) 555-3824 12345 of it", (4, "phone", 21)),
    ]
    decoys = [(9100, "see 4111111111111112 and 2020-01-15 10:30"), (9101, "look at example.com at once"), (9102, "version 1.2.3.400 of it"), (9103, "12 345 678 things")]
    rows = [*some_documents(), *((d, t) for d, t, _ in planted), *decoys]
    got = {r["key"]: r["s"] for r in pii.find(docs(spark, rows)).select("key", pii.joined(F.col("spans")).alias("s")).collect()}
    for d, t, (s, kind, e) in planted:
        assert f"{kind}:{s}:{e}" in got[d].split(","), (t, got[d])
    assert all(got[d] == "" for d, _ in decoys)


def test_held_out_candidates(spark, fitted):
    rows, model = fitted
    held = rows.where("held").select(F.explode("found").alias("c")).where("c.label is not null").select("c.label", model.reaches(F.col("c.k"), F.col("c.f")).alias("p")).collect()
    hit = sum(r["label"] and r["p"] for r in held)
    assert hit / sum(r["label"] for r in held) > 0.9 and hit / sum(r["p"] for r in held) >= 0.97


def test_redaction(spark):
    rows = [*some_documents(), (9000, "to a@b.cd, 4111111111111111!"), (9001, None)]
    got = {r["doc_id"]: r for r in pii.redact(docs(spark, rows)).collect()}
    assert got[9000]["text"] == "to [email], [card]!" and got[9001]["text"] is None and got[9000]["h0"] == "h" and got[9000]["spans"] == 2
    assert got[1015]["text"] == "🙂 [email] 🙂 [phone]"


def test_nothing_to_learn_from(spark):
    found = pii.find(docs(spark, [(1, "a@b.cd"), (2, None), (None, "4111111111111111")])).select(pii.joined(F.col("spans")).alias("s")).collect()
    assert Counter(r["s"] for r in found) == Counter(["email:0:6", "", "card:0:16"])
    assert pii.find(docs(spark, [])).collect() == []


def test_query_columns(spark, tmp_path):
    rows = [(i, t) for i, t in some_documents() if i is not None and i < 60]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op11_pii(spark, str(tmp_path)).collect():
        want = [x for d, t in rows if d == r["doc_id"] for x in [rules(t)] if hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in x).encode()).hexdigest() == r["base_sha256"]]
        assert want and [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want[0]) for i in range(4)]


def test_held_fold():
    assert sum(zlib.crc32(str(i).encode()) % pii.FOLDS == 0 for i in range(1000)) > 100
