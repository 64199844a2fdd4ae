import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tarnhelm.llm import substring_dedup as m
from tarnhelm.llm import suffix_array as sa


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 80)
        x = np.array([rng.choice([0, 1, 2, 255][: rng.randint(1, 4)]) for _ in range(n)], np.uint8)
        w = np.array([rng.random() < 0.6 for _ in range(n)])
        raw = x.tobytes()
        order = sa.two_stage(x, w, 1000)
        assert order.tolist() == sorted(np.flatnonzero(w).tolist(), key=lambda p: raw[p:])
        for k, (a, b) in zip(sa.common_prefixes(x, order, 5), zip(order, order[1:])):
            s, t = raw[a : a + 5].ljust(5, b"\0"), raw[b : b + 5].ljust(5, b"\0")
            assert k == next((i for i in range(5) if s[i] != t[i]), 5)


def brute(docs, length):
    count = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), len(m.runs(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    base = "".join(rng.choice("abcd ") for _ in range(300))
    docs = []
    for i in range(60):
        k = rng.random()
        a = rng.randint(0, 200)
        if k < 0.3:
            s = base[a : a + rng.randint(5, 90)] + "".join(rng.choice("abé") for _ in range(30)) + base[a : a + 40]
        elif k < 0.45:
            s = "a" * rng.randint(0, 150)
        elif k < 0.55:
            s = "xyz" * rng.randint(0, 50) + "q"
        elif k < 0.65 and docs:
            s = rng.choice(docs)[1]
        else:
            s = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 150)))
        docs.append((i if i % 17 else None, s if i % 13 else None))
    return [*docs, docs[5]]


@pytest.mark.parametrize("hot", [1 << 20, 200])
def test_against_brute_force(documents, hot):
    docs = corpus()
    got = m.substring_dedup(documents(docs), length=24, gram=8, hot_bytes=hot, block=2000).drop("spans").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, 24)


def test_long_periodic_text_and_empty_table(documents):
    docs = [(1, "ab" * 40_000), (2, "x" * 399), (3, "y" * 400), (4, "z" * 401)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in m.substring_dedup(documents(docs)).collect()}
    assert got == {1: (80_000, 1), 2: (0, 0), 3: (0, 0), 4: (401, 1)}
    assert m.substring_dedup(documents(docs).limit(0)).count() == 0


def brute_words(docs, words):
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in docs]
    count = collections.Counter(tuple(w[p : p + words]) for w in split for p in range(len(w) - words + 1))
    out = []
    for (d, _), w in zip(docs, split):
        covered = np.zeros(len(w), bool)
        for p in range(len(w) - words + 1):
            if count[tuple(w[p : p + words])] > 1:
                covered[p : p + words] = True
        out.append((d, int(covered.sum()), ",".join(f"{a}:{b + 1}" for a, b in m.runs(covered))))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1 << 20, 200])
def test_words_against_brute_force(documents, hot):
    rng = random.Random(7)
    docs = corpus()
    base = [rng.choice("ab é x the of".split(" ")) for _ in range(90)]
    for i in range(60):
        a = rng.randint(0, 70)
        own = [rng.choice("abcdefgh") + rng.choice("stuv") for _ in range(rng.randint(0, 12))]
        docs.append((100 + i, rng.choice([" ", "\n", " \t"]).join(own + base[a : a + rng.randint(0, 20)] + own[:3] + ["z"] * rng.randint(0, 14))))
    got = m.substring_dedup(documents(docs), length=24, gram=8, hot_bytes=hot, block=2000, words=6, word_gram=2)
    rows = got.collect()
    assert sorted([(r.doc_id, r.n_repeat_words, r.word_spans) for r in rows], key=str) == brute_words(docs, 6)
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute(docs, 24)


def test_repeated_passage_of_under_400_bytes(spark, tmp_path):
    passage = " ".join(f"w{i:03}" for i in range(52))
    assert len(passage) < m.LENGTH
    rng = random.Random(3)
    rest = [" ".join(str(rng.random()) for _ in range(80)) for _ in range(4)]
    texts = [f"{rest[0]} {passage} {rest[1]}", passage.replace(" ", "\n"), rest[2], rest[3] + " " + passage[: len(passage) // 2], None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in m.op4_substring_dedup(spark, str(tmp_path)).collect()}
    assert {d: (r.n_removed, r.n_repeat_words, r.has_repeated_passage) for d, r in got.items()} == {
        0: (0, 52, True), 1: (0, 52, True), 2: (0, 0, False), 3: (0, 0, False), 4: (0, 0, False)
    }
