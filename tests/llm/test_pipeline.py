import corpus_pipeline
from tarnhelm.llm import mixing, near_dedup, packing, quality_rules, secrets


def test_stages_take_effect(spark, sf, tmp_path):
    """Each stage, written and read again, against its operator's verdict on the same input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = seen[name][1]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before, after = seen["quality_rules"]
    verdict = quality_rules.judge(before, quality_rules.fit(before, labels)).where("kept").select("doc_id").collect()
    assert {r.doc_id for r in verdict} == {r.doc_id for r in after.select("doc_id").collect()} and 0 < after.count() < before.count()
    before, after = seen["near_dedup"]
    classes = near_dedup.classes(before).collect()
    assert after.count() == len({r.class_id for r in classes}) < before.count()
    before, after = seen["secret_scan"]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert after.count() == before.count()
    for r in before.collect():
        if spans := secrets.base_spans(r.text):
            assert not secrets.base_spans(texts[r.doc_id]) and all(r.text[s:e] not in texts[r.doc_id] for s, _, e in spans)
    before, after = seen["source_mix"]
    copies = {r.doc_id: r.copies for r in mixing.plan_copies(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == copies
    before, after = seen["packing"]
    encoder = packing.encoder(packing.default_tokenizer())
    want = sum(len(x) + 1 for x in encoder.encode([r.text for r in before.collect()]))
    assert sum(r.length for r in after.collect()) == want


def test_run_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[0] == "doc_id" and rows.count() > 0
