import random
import zlib

import numpy as np

from tarnhelm.llm import quality_rank, quality_rules, samples, stats


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for ps in places.values() if len(ps) > 1 for i in ps for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_brute_force():
    rng = random.Random(6)
    texts = ["", " \n\n ", "a b\na b\n\n\na b", "x " * 40, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"]
    texts += ["".join(rng.choice("ab  \n#*\x0bé  ") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(50)]
    for t in texts:
        assert stats.rule_counts(t)[1:] == brute_counts(t), t


def corpus(n=400):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        bad = i % 6 == 0
        if bad:
            w = [x + rng.choice(("***", "&&&", "$$$")) for x in w] if i % 12 else [y for x in w for y in (x.upper() + "!!", "|")]
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_forest_and_base_rules(spark, documents, odd, labels):
    rows, marks = corpus()
    docs, marked = documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    forest = quality_rules.fit(docs, marked)
    got = quality_rules.judge(docs, forest).collect()
    for r in got:
        text = rows[r.doc_id][1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    good = [r.kept for r in got if r.doc_id % 6]
    bad = [r.kept for r in got if r.doc_id % 6 == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)
    kept = quality_rules.keep_good(docs, forest)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.fit(odd, labels) is None
    assert [r.kept for r in quality_rules.judge(odd, None).collect() if r.doc_id in (1, 2, 3, 4)] == [False] * 5
    assert quality_rules.judge(odd.limit(0), forest).count() == 0 and quality_rules.judge(odd, forest).count() == odd.count()


def test_path_lengths_fall_for_outliers():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]]).astype(np.float32)
    path = quality_rules.IsolationForest(x).mean_path(x)
    assert path[-1] == path.min()


def test_ranking(spark, documents, odd, labels):
    rows, marks = corpus()
    docs, marked = documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    ranker = quality_rank.fit(docs, marked)
    got = quality_rank.rank(docs, ranker).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    right = [r.predicted == int(r.doc_id % 6 != 0) for r in got if r.held_out]
    assert sum(right) >= 0.95 * len(right)
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in marks], "doc_id long, quality int, toxic int")
    assert sorted(map(str, quality_rank.rank(docs, quality_rank.fit(docs, other)).collect())) == sorted(map(str, got))  # held-out labels aren't seen
    assert {r.score for r in quality_rank.rank(odd, quality_rank.fit(odd, labels)).collect()} == {0.5}
    assert quality_rank.rank(odd, ranker).count() == odd.count() and quality_rank.rank(odd.limit(0), ranker).count() == 0


def test_sample_is_bounded(spark, documents):
    rows, marks = corpus(100)
    marked = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    assert samples.labelled(documents(rows), marked, "quality", 10).count() == 10


def many():
    """More labelled rows that aren't held out than the former bound of 12 000."""
    rows, marks = corpus(1500)
    rows = [(i, rows[i % 1500][1] + " more" * (i // 1500)) for i in range(19_500)]
    return rows, [(i, marks[i % 1500][1], 0) for i in range(19_500)]


def test_all_labelled_rows_count(spark, documents):
    rows, marks = many()
    docs, marked = documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    forest = quality_rules.fit(docs, marked, clean_loss=0.05)
    x, good = [], []
    for i, text in rows:
        counts = stats.rule_counts(text)
        if zlib.crc32(str(i).encode()) % 3 != 1 and not quality_rules.failed(counts[1], counts[5]):
            x.append(stats.shape(text, counts))
            good.append(marks[i][1] == 1)
    path, good = forest.forest.mean_path(np.array(x)[:, quality_rules._AT].astype(np.float32)), np.array(good)
    assert len(path) > 12_000
    ok, bad = np.sort(path[good]), path[~good]
    highest = ok[int(len(ok) * 0.05)]
    assert forest.cut == min(highest, np.nextafter(bad[bad < highest].max(), np.inf))
    again = quality_rules.fit(docs.repartition(7), marked, clean_loss=0.05)
    assert again.cut == forest.cut and (again.forest.cut == forest.forest.cut).all()


def test_ranking_from_all_rows_and_pairs(spark, documents):
    rows, marks = many()
    docs, marked = documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    ranker = quality_rank.fit(docs, marked)
    assert ranker.rows == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows) > 12_000
    got = quality_rank.rank(docs, ranker).collect()
    assert np.mean([r.predicted == marks[r.doc_id][1] for r in got if r.held_out]) >= 0.95
    # The gradient over all pairs of a few rows vanishes at the fitted weights.
    few, labels = docs.where("doc_id < 120"), marked.where("doc_id < 120")
    ranker = quality_rank.fit(few, labels)
    learnt = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 != 1]
    f = ranker.features(np.array([quality_rank.measure(rows[i][1]) for i in learnt]))
    good = np.array([marks[i][1] == 1 for i in learnt])
    d = (f[good][:, None] - f[~good][None]).reshape(-1, f.shape[1])
    g = -(d / (1 + np.exp(d @ ranker.w))[:, None]).mean(0) + quality_rank.L2 * ranker.w
    assert np.abs(g).max() < 2e-3
