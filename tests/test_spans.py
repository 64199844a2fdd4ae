"""Plans against plain sequential statements of the same rules, on random input."""

import random

from pyspark.sql import functions as F

from tarnhelm.operators import contextual as C
from tarnhelm.operators import spans as S

SCHEMA = "doc_id long, ord int, start int, end int, category string, confidence double, source string"


def random_findings(n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        for o in range(rng.randint(0, 9)):
            s = rng.randint(0, 30)
            rows.append((d, o, s, s + rng.randint(1, 15), rng.choice(["A", "B"]), rng.choice([0.5, 0.7, 0.9]), rng.choice(["recognizer", "model"])))
    return rows


def sequential_coalesce(rows):
    out = []
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        last = out[-1] if out else None
        if last and last[2] == r[4] and last[4] == r[6] and r[2] < last[1]:
            last[1], last[3] = max(last[1], r[3]), max(last[3], r[5])
        else:
            out.append([r[2], r[3], r[4], r[5], r[6]])
    return [tuple(x) for x in out]


def sequential_suppress(rows):
    kept = []
    for s, e, c, p, src in sorted(rows, key=lambda r: (r[4] != "recognizer", -r[3], r[0])):
        if not any(max(0, min(e, k[1]) - max(s, k[0])) / max(1, min(e - s, k[1] - k[0])) >= 0.65 for k in kept):
            kept.append((s, e, c, p, src))
    return sorted(kept)


def test_coalesce_and_suppress(spark):
    rows = random_findings()
    df = spark.createDataFrame(rows, SCHEMA)
    per = {}
    for r in rows:
        per.setdefault(r[0], []).append(r)
    want = {d: sequential_coalesce(rs) for d, rs in per.items()}
    got = {}
    for r in S.coalesce(df, "doc_id").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.category, r.confidence, r.source))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    arrays = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "ord", "end", "category", "confidence", "source")).alias("fs"))
    for r in arrays.select("doc_id", S.coalesce_array(F.col("fs")).alias("c"), S.merge_array(F.col("fs")).alias("m")).collect():
        assert sorted(map(tuple, r.c)) == sorted(want[r.doc_id])
        assert sorted(map(tuple, r.m)) == sequential_suppress(want[r.doc_id])
        for a in r.m:
            for b in r.m:
                if a is not b:
                    assert max(0, min(a.end, b.end) - max(a.start, b.start)) / max(1, min(a.end - a.start, b.end - b.start)) < 0.65


def test_propagation(spark):
    text = "Ira Low met Bo. xIra Low, Ira Lows and Bo. (Ira Low)"
    f = F.expr("array(named_struct('start', 0, 'end', 7, 'category', 'PERSON', 'confidence', 0.9D, 'source', 'model'), named_struct('start', 12, 'end', 14, 'category', 'PERSON', 'confidence', 0.9D, 'source', 'model'))")
    row = spark.createDataFrame([(text,)], "text string").select(S.propagate(F.col("text"), f).alias("x")).first()
    again = text.index("(Ira Low)") + 1
    assert sorted((x.start, x.end) for x in row.x) == [(0, 7), (12, 14), (again, again + 7)]


def test_chunks_tile_the_text(spark):
    rng = random.Random(1)
    texts = ["ab cde " * 200 + "end", "x" * 2000, "", "a\nb " * 300] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 1500))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("text", C.chunks(F.col("text")).alias("c")).collect():
        want, at, n = [], 0, len(r.text)
        while n:
            hard = min(n, at + 420)
            soft = max(r.text[: hard + 1].rfind("\n"), r.text[: hard + 1].rfind(" "))
            end = soft if hard < n and soft > at + 210 else hard
            want.append((at, r.text[at:end]))
            if end >= n:
                break
            at = max(at + 1, end - 60)
        assert [(c.offset, c.text) for c in r.c] == want


def test_tokens_without_offsets():
    tag = lambda e, w, p=0.9, **more: {"entity": e, "word": w, "score": p, **more}
    spans = C.merge_placed("In Oslo Kari Nordmann sang.", [tag("B-LOCATION", "oslo"), tag("B-person", "▁kari"), tag("I-Person", "##nordmann", 0.7)])
    assert [(s["category"], s["start"], s["end"], s["score"]) for s in spans] == [("LOCATION", 3, 7, 0.9), ("PERSON", 8, 21, 0.7)]
    assert [(s["start"], s["end"]) for s in C.merge_placed("İİ ole", [tag("B-PERSON", "ole")])] == [(3, 6)]
    assert C.merge_placed("Kari", [tag("B-PERSON", "[UNK]"), tag("B-PERSON", "per"), tag("B-PERSON", "##")]) == []


def test_the_search_goes_on_behind_every_token():
    tokens = [{"entity": "B-PERSON", "word": "moe", "score": 0.9, "start": 4, "end": 7}, {"entity": "B-PERSON", "word": "ada", "score": 0.9}]
    assert [(s["start"], s["end"]) for s in C.merge_placed("ada moe ada", tokens)] == [(4, 7), (8, 11)]
    both = [{"entity": "B-LOCATION", "entity_group": "PERSON", "word": "ada", "score": 0.9}]
    assert C.merge_placed("ada", both)[0]["category"] == "PERSON"
    inside = [{"entity": "B-PERSON", "score": 0.9, "start": 0, "end": 9}, {"entity": "I-PERSON", "score": 0.9, "start": 2, "end": 5}]
    assert [(s["start"], s["end"]) for s in C.merge_placed("adamantine", inside)] == [(0, 5)]


def test_recognizer_beats_model_and_chunk_overlap(spark):
    rows = [(7, 0, 5, 30, "PERSON", 0.97, "model"), (7, 1, 5, 30, "IBAN_CODE", 0.5, "recognizer"), (8, 0, 40, 55, "LOCATION", 0.85, "model"), (8, 1, 50, 61, "LOCATION", 0.84, "model")]
    got = S.suppress(S.coalesce(spark.createDataFrame(rows, SCHEMA), "doc_id"), "doc_id").collect()
    assert sorted((r.doc_id, r.start, r.end, r.category, r.confidence) for r in got) == [(7, 5, 30, "IBAN_CODE", 0.5), (8, 40, 61, "LOCATION", 0.85)]


def test_failing_classifier_degrades_the_scan(spark):
    def fails(texts):
        raise RuntimeError("no memory")

    def unloadable():
        raise OSError("no weights")

    docs = spark.createDataFrame([(1, "met Jane Doe there"), (2, None)], "doc_id long, text string")
    for make, error in ((lambda: fails, "RuntimeError: no memory"), (unloadable, "OSError: no weights")):
        assert C.classify(docs, make).count() == 0
        assert [tuple(r) for r in C.failures(docs, make).collect()] == [(1, error)]


def test_classifier_and_degraded_scan(spark):
    from tarnhelm.plans.contextual import gazetteer

    docs = spark.createDataFrame([(1, "met Jane Doe there"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in C.classify(docs, lambda: gazetteer).collect()] == [(1, 4, 12, "PERSON", 0.85, "model")]
    assert C.classify(docs, None).count() == 0
