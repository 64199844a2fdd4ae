import random

import numpy as np

from tarnhelm.llm import near_dedup as m
from tarnhelm.llm.components import components


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_alignment_is_edit_distance_within_the_band():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.6 else [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 4))
        x, y, d = np.array(a, np.int64), np.array(b, np.int64), distance(a, b)
        for most in (0, 3, 12, 40):
            want = d if d <= most else None
            assert m.edits_within(x, y, most) == m.edits_within(y, x, most) == want


def test_sketches_heed_order_and_occurrences():
    w = np.arange(60, dtype=np.uint64)
    k = m.labelled_kmers(w)
    turned = m.labelled_kmers(np.concatenate([w[30:], w[:30]]))
    same = (m.sketches(k) == m.sketches(k.copy())).all()
    assert same and (m.sketches(k) != m.sketches(turned)).any()
    twice = m.labelled_kmers(np.tile(np.arange(5, dtype=np.uint64), 4))
    assert len(set(twice.tolist())) == len(twice)


def test_components(spark):
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(70)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == {f"n{i:04}" for i in range(71)} | {"x", "y"}
    assert all(got[f"n{i:04}"] == "n0000" for i in range(71)) and got["y"] == "x"


def test_classes_against_brute_force(documents):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    boiler = [rng.choice(words) for _ in range(30)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(120)] = rng.choice(words)
        docs.append((i, " ".join(w)))
    docs += [(i, " ".join(boiler + [rng.choice(words) for _ in range(25)])) for i in range(120, 200)]
    docs += [(500, docs[150][1].upper() + "!"), (501, docs[150][1] + " more"), (502, None), (503, ""), (504, "a b"), (504, "a b"), (None, docs[160][1])]
    table = documents(docs)
    got = m.classes(table, block=20).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r.class_id for r in got}
    codes = {i: c for (i, _), c in zip(docs, m.codes([t or "" for _, t in docs]))}
    parent = {i: i for i, _ in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(parent)
    for a in range(len(ids)):
        for b in range(a):
            x, y = codes[ids[a]], codes[ids[b]]
            if len(x) and len(y) and m.linked(x, y):
                parent[top(ids[a])] = top(ids[b])
    groups, want = {}, {}
    for i, _ in docs:
        groups.setdefault(by_id[i], set()).add(i)
        want.setdefault(top(i), set()).add(i)
    assert sorted(map(str, map(sorted, (map(str, g) for g in groups.values())))) == sorted(map(str, map(sorted, (map(str, g) for g in want.values()))))
    kept = m.deduplicate(table)
    assert kept.columns == table.columns and kept.count() == len(groups)


def test_star_of_a_hot_sketch(documents):
    """Copies near the base alone: each link is one pair of a hot key."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(140)]
    docs = [(0, " ".join(base))]
    for i in range(1, 260):
        w = list(base)
        for at in rng.sample(range(40, 140), 18):
            w[at] = f"n{i}x{at}"
        docs.append((i, " ".join(w)))
    codes = m.codes([t for _, t in docs])
    kmers = [set(m.sketches(m.labelled_kmers(c)).tolist()) for c in codes]
    near = {i for i in range(1, len(docs)) if kmers[0] & kmers[i] and m.linked(codes[0], codes[i])}
    got = {r.doc_id: r.class_id for r in m.classes(documents(docs), block=12).collect()}
    assert len(near) > 200 and all(got[i] == 0 for i in near)


def test_recall_at_the_threshold():
    """Of texts with a fifth of their words replaced anywhere, nearly all are linked and share a sketch."""
    rng = random.Random(6)
    met = 0
    for n in range(200):
        a = np.array([rng.randrange(1 << 63) for _ in range(200)], np.uint64)
        b = a.copy()
        b[rng.sample(range(200), 40)] ^= np.uint64(0x5A5A5A5A)
        assert m.linked(a, b)
        x, y = (m.sketches(m.labelled_kmers(c)) for c in (a, b))
        met += bool((x == y).any())
    assert met >= 180
    longer = np.arange(120)
    assert m.linked(longer[:100], longer)


def test_odd_rows(odd):
    got = m.classes(odd).collect()
    assert len(got) == odd.count() and {r.class_size for r in got if r.doc_id == 4} == {2}
    assert m.classes(odd.limit(0)).count() == 0


def test_words_are_runs_of_letters_and_digits():
    import re

    texts = ["", "One two_three, ONE!", "a\nb\n\nc", "Straße İx ½ ² 漢字 é1", " _ ", "x" * 9000 + " y"]
    for t, got in zip(texts, m.codes(texts)):
        words = re.findall(r"[^\W_]+", t.lower())
        assert len(got) == len(words)
        alike = {}
        for w, c in zip(words, got.tolist()):
            assert alike.setdefault(w, c) == c
        assert len(set(alike.values())) == len(alike)


def test_clashing_names_and_repeated_rows(documents):
    from pyspark.sql import functions as F

    docs = documents([(1, "a b c d"), (1, "a b c d"), (2, "a B c d"), (3, "x")]).withColumns({n: F.lit(7) for n in ("_k", "rkey", "node", "doc", "root", "n")})
    got = m.deduplicate(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r["_k"]) for r in got.collect()) == [(1, 7), (3, 7)]
