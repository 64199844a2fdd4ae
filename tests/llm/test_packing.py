import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tarnhelm.llm import packing as m

TEXTS = ["", " ", "a  \n\n b\t\tc x", "日本語 テスト ½ ² _x_ don't I'll\x1c a\x85b 　c\xa0 d  \n", "<|endoftext|> in a text", "Ünïcode😀 words, and-punctuation!!  ", "x" * 5000]


def whole(text):
    t = Tokenizer.from_file(m.default_tokenizer())
    return t.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab .,'\n\té  1") for _ in range(200)) for _ in range(100)]
    encoder = m.Encoder(m.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [whole(t) for t in texts]


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    p = m.Packer(0, width=32)
    for _ in range(300):
        r = int(rng.integers(1, 32))
        best = None
        for h in range(0, 32 - r + 1):
            if h and not p.count[h]:
                continue
            n = p.count.copy()
            n[h] -= h > 0
            n[h + r] += h + r < 32
            s = int((n[1:32] ** 2).sum())
            if best is None or s < best:
                best = s
        h = p.level(r)
        n = p.count.copy()
        n[h] -= h > 0
        n[h + r] += h + r < 32
        assert int((n[1:32] ** 2).sum()) == best
        p.add(0, np.arange(r))


def check(rows, texts):
    """Every id once, offsets without gaps, sequences whole or a power of two."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == m.WIDTH or at & (at - 1) == 0 and at < m.WIDTH
    for doc, text in texts.items():
        ids = np.array(whole(text or "") + [0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return by_seq


def test_pieces(spark, documents):
    rng = random.Random(5)
    texts = dict(enumerate(TEXTS + [" ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randint(1, 3000))) for _ in range(60)] + [None]))
    rows = m.pack(documents(list(texts.items())).repartition(3), m.default_tokenizer()).collect()
    seqs = check(rows, texts)
    assert len({r.sequence_id for r in rows}) == len(seqs)
    assert sum(1 for rs in seqs.values() if sum(r.length for r in rs) < m.WIDTH) <= 3 * 10


def test_many_windows_that_do_not_fit_each_other():
    p = m.Packer(0, width=32, most_open=8)
    for i in range(100):
        p.add(i, np.arange(20))
    assert p.count[1:32].sum() <= 9
    p.pour(last=True)
    rows = p.take()
    assert sum(r[2] for r in rows) == 2000 and not p.count[1:32].any()


def test_repeated_rows_and_empty_table(documents):
    rows = m.pack(documents([(1, "a b c"), (1, "a b c")]), m.default_tokenizer()).collect()
    assert sum(r.length for r in rows) == 2 * 4
    assert m.pack(documents([(1, "a")]).limit(0), m.default_tokenizer()).count() == 0
