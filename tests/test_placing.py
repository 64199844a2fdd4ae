import math

from pyspark.sql import functions as F

from tarnhelm.operators import blocks as B
from tarnhelm.operators import geometry as G
from tarnhelm.operators import overlay as O
from tarnhelm.operators import pages as P
from tarnhelm.operators import validation as V
from tarnhelm.streaming import history as H


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_preview(spark):
    scale = lambda w, h, r: one(spark, G.preview_scale(F.lit(w), F.lit(h), F.lit(r)))[0]
    assert scale(300.0, 500.0, 1.5) == 1.5 and scale(300.0, 500.0, 7.0) == 2
    for w, h in ((9000.0, 200.0), (3000.0, 3000.0), (200.0, 50_000.0)):
        s = scale(w, h, 2.0)
        assert max(w, h) * s <= 4096 + 1e-6 and w * h * s * s <= 4_000_001
    code, detail = G.failure_class(F.lit("Error"), F.lit("the canvas area exceeds a limit"))
    assert tuple(one(spark, code, detail)) == ("PREVIEW_CANVAS_LIMIT", "Error: the canvas area exceeds a limit")
    assert one(spark, G.failure_class(F.lit("TypeError"), F.lit("no such font"))[0])[0] == "PREVIEW_RENDER"


def test_rotated_text_is_tall(spark):
    turned = F.array(*map(F.lit, (0.0, 9.0, -9.0, 0.0, 40.0, 300.0)))
    r = one(spark, G.range_rect(turned, F.lit(180.0), F.lit(9.0), F.lit("ltr"), F.lit(0.25), F.lit(0.75)).alias("r")).r
    assert r.y1 - r.y0 > 90 > 3 * (r.x1 - r.x0)


def test_measured_fraction(spark):
    widths = F.create_map(F.lit("m"), F.lit(9.0), F.lit("l"), F.lit(3.0))
    fractions = [one(spark, G.measured_fraction(F.lit("mllm"), F.lit(i), widths))[0] for i in range(5)]
    assert all(math.isclose(f, w / 24) for f, w in zip(fractions, (0, 9, 12, 15, 24)))


def test_page_text(spark):
    items = spark.createDataFrame([(1, 0, "a", False), (1, 1, "", True), (1, 2, "b ", False), (1, 3, "c", True), (1, 4, "d", False), (1, 5, " e", False)], "doc_id long, item_idx int, str string, has_eol boolean")
    got = P.assemble(items, "doc_id")
    assert P.page_text(got, "doc_id").first().text == "a b c\nd e"
    assert [(r.start, r.end) for r in got.orderBy("item_idx").collect()] == [(0, 1), (2, 4), (4, 5), (6, 7), (7, 9)]


def test_suggestions(spark):
    rows = [(4, 0, True, "kept", 2, 30.0), (4, 1, False, "new", 2, 300.0), (4, 2, False, "nearly the same", 2, 305.0), (4, 3, False, "elsewhere", 3, 300.0)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, existing boolean, id string, page_index int, x double")
    df = df.withColumn("rects", F.array(F.struct(F.col("x").alias("x0"), F.lit(5.0).alias("y0"), (F.col("x") + 80).alias("x1"), F.lit(25.0).alias("y1"))))
    assert sorted((r.id, r.added) for r in B.merge_suggestions(df, "doc_id").collect()) == [("elsewhere", True), ("kept", False), ("new", True)]
    assert B.merge_suggestions(df, "doc_id", cap=2).count() == 2


def test_rules(spark):
    df = spark.createDataFrame([(1, "", 100, 1.0), (1, "ok", 0, float("nan"))], "doc_id long, id string, page_index int, x1 double")
    df = df.select("*", F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), "x1", F.lit(1.0).alias("y1"))).alias("rects"), F.lit(0).alias("label_rect_index"), F.lit(None).cast("double").alias("source_font_size"), F.lit("REDACTED").alias("replacement"), F.lit("text-replacement").alias("appearance"))
    got = sorted(r.v for r in df.select(V.block_violations(df).alias("v")).collect())
    assert got == [["id", "page_index"], ["rects"]]
    assert [r.valid for r in V.manifest_valid(df, "doc_id").collect()] == [False]


def test_overlay(spark):
    df = spark.createDataFrame([(1, 0, 0, 5, None), (1, 0, 1, 0, 7.0)], "doc_id long, page_index int, block_seq int, label_rect_index int, source_font_size double")
    df = df.withColumn("rects", F.array(F.struct(F.lit(10.5).alias("x0"), F.lit(20.0).alias("y0"), F.lit(110.0).alias("x1"), F.lit(32.25).alias("y1"))))
    lines = O.overlay(df, "doc_id", "page_index").first().overlay.split("\n")
    assert lines[:6] == ["q", "1 g", "10.5 20 99.5 12.25 re f", "10.5 20 99.5 12.25 re f", "Q", "0 g"]
    assert sum("REDACTED" in x for x in lines) == 2 and lines[6].startswith("BT /Label1 8.82 Tf 1 0 0 1 ") and lines[7].startswith("BT /Label1 7 Tf")
    nums = spark.createDataFrame([(0.00000001,), (-2.0,), (1.23456,), (100.0,), (-0.00001,)], "v double")
    assert [r[0] for r in nums.select(O.number(F.col("v"))).collect()] == ["0", "-2", "1.2346", "100", "0"]


EVENTS = [("add", "a"), ("add", "b"), ("undo", None), ("redo", None), ("redo", None), ("remove", "a"), ("undo", None), ("add", "c"), ("redo", None), ("clear", None), ("undo", None)]


def test_history(spark, tmp_path):
    events = spark.createDataFrame([(d, i, a, b) for d in (1, 2) for i, (a, b) in enumerate(EVENTS)], "doc_id long, seq long, action string, block string")
    got = H.fold(events).collect()
    assert {(r.doc_id, r.blocks, r.n_past, r.n_future) for r in got} == {(1, "a,b,c", 3, 1), (2, "a,b,c", 3, 1)}
    h = H.History()
    for i in range(260):
        h.apply("add", f"b{i}")
    assert len(h.blocks) == 200 and len(h.past) == 50
    from tarnhelm.streaming.scan import run_once

    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    assert {(r.doc_id, r.blocks) for r in run_once(H.fold_stream(stream), spark, "history_test", "update").collect()} == {(1, "a,b,c"), (2, "a,b,c")}


def test_streamed_scan(spark, tmp_path):
    from tarnhelm.streaming import scan

    docs = spark.createDataFrame([(1, "mail a@b.org"), (2, None), (3, "none")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    stream = scan.read_documents(spark, str(tmp_path / "docs"), "doc_id long, text string")
    assert [(r.doc_id, r.category) for r in scan.run_once(scan.findings(stream), spark, "scan_test").collect()] == [(1, "EMAIL_ADDRESS")]
    assert sorted((r.doc_id, r.text) for r in scan.run_once(scan.redacted(stream), spark, "redact_test").collect()) == [(1, "mail REDACTED"), (2, None), (3, "none")]
