import random

import numpy as np

from tarnhelm.llm import pseudo_likelihood as m


def corpus(n=300):
    """Every word is followed by its own successor nearly always, so neighbours tell it."""
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = []
    for i in range(n):
        k, out = rng.randrange(60), []
        for _ in range(rng.randint(30, 80)):
            out.append(words[k])
            k = (k + 1) % 60 if rng.random() < 0.95 else rng.randrange(60)
        docs.append((i, " ".join(out)))
    return docs


def test_gradient():
    rng = np.random.default_rng(0)
    net = m.Network(rng.integers(1, 50, m.SYMBOLS))
    ids = np.concatenate([[m.PAD] * 2, rng.integers(0, m.SYMBOLS, 400), [m.PAD] * 2])
    at = np.arange(2, 402)
    before = net.log_probs(ids, at).mean()
    trainer = m.Trainer(net, 0.1)
    for _ in range(40):
        trainer.step(ids, at)
    assert net.log_probs(ids, at).mean() > before + 0.5
    assert m.Network.unpack(net.pack()).pack() == net.pack()


def test_log_probabilities_sum_to_one():
    net = m.Network(np.arange(m.SYMBOLS))
    ids = np.full((m.SYMBOLS, 5), 7)
    ids[:, 2] = np.arange(m.SYMBOLS)
    total = sum(np.exp(net.log_probs(row, np.array([2]))[0]) for row in ids)
    assert abs(total - 1) < 1e-3


def test_gradient_is_the_slope():
    """Each parameter's step direction against differences of the loss."""
    rng = np.random.default_rng(2)
    net = m.Network(rng.integers(1, 50, m.SYMBOLS))
    ids = np.concatenate([[m.PAD] * 2, rng.integers(0, m.SYMBOLS, 60), [m.PAD] * 2])
    at = np.arange(2, 62)
    for name in m.Network.NAMES:
        setattr(net, name, getattr(net, name).astype(float))
    start = {n: getattr(net, n).copy() for n in m.Network.NAMES}
    trainer = m.Trainer(net, 1.0)
    trainer.sums = {n: np.full(start[n].shape, 1e-30) for n in start}
    trainer.step(ids, at)
    grad = {n: np.sign(start[n] - getattr(net, n)) * np.sqrt(trainer.sums[n]) for n in start}
    for n, v in start.items():
        setattr(net, n, v)
    for n in start:
        flat = np.abs(grad[n]).ravel()
        for i in [int(flat.argmax()), *rng.integers(0, flat.size, 4).tolist()]:
            p = getattr(net, n)
            place, h = np.unravel_index(i, p.shape), 1e-5
            p[place] += h
            up = -net.log_probs(ids, at).astype(float).mean()
            p[place] -= 2 * h
            down = -net.log_probs(ids, at).astype(float).mean()
            p[place] += h
            assert abs((up - down) / (2 * h) - grad[n][place]) < 5e-3 * max(1, np.abs(flat).max())


def vocabulary_of(texts):
    from collections import Counter

    n = Counter(w for c in m.codes(texts) for w in c.astype(np.uint32).tolist())
    some = np.array([w for w, _ in n.most_common(5)], np.uint32)
    slots, words = np.zeros(1 << m.SLOT_BITS), np.zeros(1 << m.SLOT_BITS)
    for w, k in n.items():
        if w not in some:
            slots[w >> 32 - m.SLOT_BITS] += k
            words[w >> 32 - m.SLOT_BITS] += 1
    return m.Vocabulary(some, np.array([n[int(w)] for w in some], float), slots, words), n


def test_words_within_symbols():
    """A word's share of its symbol follows the counts, and the symbols' counts add up to all words."""
    texts = [t for _, t in corpus(50)]
    v, n = vocabulary_of(texts)
    assert v.counts.sum() == sum(n.values())
    words = np.array(sorted(n), np.uint32)
    ids, within = v.ids(words.tobytes())
    share = {}
    for w, k, p in zip(words.tolist(), ids[m.REACH : -m.REACH].tolist(), within.tolist()):
        assert (p == 0) == (k < m.FREQUENT)
        share[k] = share.get(k, 0) + np.exp(p)
    assert all(s <= 1 + 1e-6 for s in share.values())
    unseen = next(t for t in ("zzq", "qqzz", "xxyyzz") if v.ids(m.codes([t])[0].astype(np.uint32).tobytes())[0][m.REACH] >= m.FREQUENT)
    seen = [i for i, k in enumerate(ids[m.REACH : -m.REACH]) if k >= m.FREQUENT]
    assert v.ids(m.codes([unseen])[0].astype(np.uint32).tobytes())[1][0] < within[seen].max()


def test_every_word_is_a_target_once():
    texts = [t for _, t in corpus(20)] + ["one", "one two", ""]
    data = [c.astype(np.uint32).tobytes() for c in m.codes(texts)]
    start, got = m.Network().pack(), 0
    for turn in range(m.ROUNDS):
        task = m._Train(vocabulary_of(texts)[0], start, 0.1, turn, m.ROUNDS)
        task.rows({"codes": data})
        task._step()
        got += task.seen
    assert got == sum(len(t.split()) for t in texts)
    for n in range(1, 12):
        places = [p for turn in range(3) for p in m.targets(b"abcd" * n, turn, 3).tolist()]
        assert sorted(places) == list(range(n))


def test_scores(spark, documents, odd):
    rows = corpus()
    docs = m.coded(documents(rows))
    words = m.vocabulary(docs)
    assert words.counts.sum() == sum(len(t.split()) for _, t in rows) and (words.counts >= 0).all()
    net = m.train(docs, words, rounds=4)
    rng = random.Random(1)
    mixed = m.coded(documents([(i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows]))
    mean = lambda d: np.mean([r.mean_log_prob for r in m.score(d, words, net).collect()])
    assert mean(docs) > mean(mixed) + 0.2
    assert net.pack() == m.train(docs, words, rounds=4).pack()
    got = {r.doc_id: r for r in m.score(m.coded(odd), words, net).collect()}
    assert got[1].n_words == 0 and got[1].log_prob == 0 and got[1].mean_log_prob is None
    none = m.coded(documents(rows).limit(0))
    assert m.score(m.coded(odd.limit(0)), words, net).count() == 0
    assert m.score(docs, m.vocabulary(none), m.train(none, words)).count() == len(rows)
