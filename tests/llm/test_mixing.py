import duckdb

from tarnhelm.llm import mixing as m


def fixture():
    rows = []
    for s, n, w in (("b", 40, 30), ("a", 60, 50), (None, 30, 20), ("c", 3, 400), ("d", 2, 0)):
        rows += [(len(rows) + i, "word " * (w + i % 7 * (w > 0)), s) for i in range(n)]
    return rows + [(None, None, "a"), (7, "x y", "a"), (7, "x y", "a")]


def test_against_sql(spark, documents):
    docs = documents(fixture())
    got = m.plan_copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies").toPandas()
    con = duckdb.connect()
    con.register("frame", docs.toPandas())
    con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, n_chars FROM frame")
    want = con.sql(m.SQL).df()
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].itertuples(index=False, name=None)))
    got["doc_id"] = got["doc_id"].astype("Int64")
    want["doc_id"] = want["doc_id"].astype("Int64")
    assert rows(got) == rows(want)


def test_targets_and_copies(documents):
    docs = documents(fixture())
    got = m.plan_copies(docs).collect()
    per = {}
    for r in got:
        assert r.taken <= 2 * r.size
        per.setdefault(r.source, [r.source_size, r.target, 0, 0])
        per[r.source][2] += r.taken
        per[r.source][3] = max(per[r.source][3], r.size)
    assert abs(sum(p[1] for p in per.values()) - 1.5 * sum(p[0] for p in per.values())) < 1e-6 * sum(p[0] for p in per.values())
    for size, target, taken, largest in per.values():
        assert target <= 2 * size and abs(taken - target) <= largest + 1e-9
    assert per["d"][1] == 0
    mixed = m.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert m.mix(docs.limit(0)).count() == 0
    again = m.plan_copies(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_weights_by_code_point(documents):
    docs = documents([(i, "w " * 1000, s) for i, s in enumerate(("é", "z", "A", None))])
    t = {r.source: r.target for r in m.source_targets(m.plan_copies(docs).select("source", "size")).collect()}
    # A, z, é, null weigh 3, 1, 2, 3; 6000 words to share, 2000 at most each.
    assert t["A"] == 2000 and t[None] == 2000 and abs(t["é"] - 2 * t["z"]) < 1e-6 and abs(sum(t.values()) - 6000) < 1e-6


def test_many_sources_take_the_salted_join(documents, monkeypatch):
    docs = documents(fixture())
    want = sorted(map(str, m.plan_copies(docs).collect()))
    monkeypatch.setattr(m, "MOST_BROADCAST", 0)
    assert sorted(map(str, m.plan_copies(docs).collect())) == want


def test_clashing_names_and_draws(documents):
    docs = documents(fixture())
    for name in ("doc", "h", "size", "copies", "seed", "target"):
        docs = docs.withColumnRenamed("lang", name) if name == "doc" else docs.withColumn(name, docs["doc_id"])
    mixed = m.mix(docs)
    assert mixed.columns == docs.columns
    per = {}
    for r in m.plan_copies(docs).collect():
        per.setdefault(r.doc_id, set()).add((r.source, r.copies))
    assert len(per[7]) == len({s for s, _ in per[7]})
