"""Tokenizer alignment against plain loops over tokens and byte offsets."""

import hashlib
import json
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from echoform.llm import alignment

pytestmark = pytest.mark.skipif(not Path(alignment.FOLDER).exists(), reason="no vocabulary files here")
A, B = f"{alignment.FOLDER}/byte_bpe_50k.json", f"{alignment.FOLDER}/piece_bpe_32k.model"
DOCS = "doc_id long, text string, row long, key string, rare array<long>, pair long, a string, n int"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names are those used inside."""
    return spark.createDataFrame([(d, t, 3, "k", [1], 2, "a", 1) for d, t in rows], DOCS).repartition(parts)


def some_texts():
    rng = np.random.default_rng(0)
    words = "the of internationalisation straße naïve Ελλάδα 東京都 don't 3.14159 ______ ======== foo_bar() <|endoftext|> </s> <0x41> <unk> 🙂🙂 a\tb c\n\nd  e   f".split(" ")
    texts = [" ".join(words[int(i)] for i in rng.integers(0, len(words), n)) for n in rng.integers(1, 60, 60)]
    return [*texts, *texts[:20], None, "", " ", "x", "a ▁ b", "\x00\x01", "=" * 3000, "ab " * 20_000, "  lead", "trail  ", "é" * 50]


def plain(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = {c: c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255}
    byte = {chr(visible[c]): c for c in visible} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in visible)}
    groups = []
    for t in texts:
        own = []
        if t:
            x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            whole = (" " + t).encode()
            if b"".join(s for _, s in x) == whole == b"".join(s for _, s in y):
                at_a = at_b = 0
                now = ([], [])
                while x or y:
                    if at_a <= at_b:
                        i, s = x.pop(0)
                        now[0].append(i)
                        at_a += len(s)
                    else:
                        i, s = y.pop(0)
                        now[1].append(i)
                        at_b += len(s)
                    if at_a == at_b:
                        own.append(now)
                        now = ([], [])
        groups.append(own)
    count = Counter(pair for own in groups for pair in {(i, j) for g in own for i in g[0] for j in g[1]})
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for own in groups:
        links = [(i, j) for g in own for i in g[0] for j in g[1]] if len(own) < 10_000 else None
        if links is None:
            many = Counter()
            for g in own:
                many.update((i, j) for i in g[0] for j in g[1])
            links = list(many.elements())
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in own)
        digest = hashlib.sha256(text.encode()).hexdigest() if own else ""
        out.append((sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out, count, best


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 20, 0])
def test_alignment_equals_plain_loops(spark, most):
    texts = some_texts()
    ids = [None if i == 7 else 3 if i == 4 else i for i in range(len(texts))]
    found = alignment.align(docs(spark, list(zip(ids, texts, strict=True))), most_pairs=most)
    rows, count, best = plain(texts)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found.documents.collect()), key=key)
    assert got == sorted(((i, *r) for i, r in zip(ids, rows, strict=True)), key=key)
    pairs = {(r["a_id"], r["b_id"]): (r["documents"], r["best"]) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_most_groups_are_of_the_identity_map():
    pair = alignment.Pair(Path(A).read_bytes(), Path(B).read_bytes())
    same = np.flatnonzero(pair.same >= 0)
    assert len(same) > 10_000 and all(pair.a_bytes[i] == pair.b_bytes[pair.same[i]] for i in same.tolist())
    vocabulary = json.loads(Path(A).read_text())["model"]["vocab"]
    assert len(pair.a_bytes) == len(vocabulary) + 1 and sorted({t[0] for t in pair.a_bytes if len(t) == 1}) == list(range(256))


def test_words_give_what_whole_texts_give():
    pair, whole = (alignment.Pair(Path(A).read_bytes(), Path(B).read_bytes()) for _ in range(2))
    whole._by_words = False
    assert pair.by_words
    rng, pool = np.random.default_rng(1), list("ab'sZ.1é東 \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u180e\u200b\u2028🙂_<>|=▁\x00") + [" ", " ", "  ", " the", "'ll", " </s>", "<|endoftext|>", "<0x0A>", "\n "]
    texts = ["".join(pool[int(i)] for i in rng.integers(0, len(pool), int(n))) for n in rng.integers(0, 40, 4000)]
    got = pair.encode(texts)
    assert got == whole.encode(texts) and got == pair.encode(texts) and sum(bool(a) for a, _ in got) > 1000


def test_runs_that_never_meet_stay_small():
    pair = alignment.Pair(Path(A).read_bytes(), Path(B).read_bytes())
    a, b = np.argmax(pair.a_length == 3), np.argmax(pair.b_length == 2)
    odd = np.argmax(pair.b_length == 1)  # one byte first, so that ends meet only at the end
    n = 60_000
    cut = alignment.Cut.of(pair, [np.full(2 * n // 3 + 1, a, pair.a_kind).tobytes()], [np.array([odd, *[b] * (n + 1)], pair.b_kind).tobytes()])
    *_, times = cut.links(pair)
    assert len(cut.document) < n and len(times) <= 2 * len(cut.document) + 2


def test_alignment_of_an_empty_table(spark):
    found = alignment.align(docs(spark, []))
    assert found.documents.collect() == [] and found.pairs.collect() == []
