import io
import zipfile

import duckdb
from pyspark.sql import functions as F

from tarnhelm.sources import importers as I
from tarnhelm.sources import layout as L


def test_markup():
    html = "<h1> A &amp; B </h1>loose<div>lost<p>one <b>two</b><p></p><ul><li>x<ul><li>y</li></ul></li><li> </li></ul><table><tr><th>h</th><td>1</td></tr><tr><td></td></tr></table><img src=a><h3>t</h3></div>"
    assert I.markup_blocks(html) == [
        ("title", "A & B"), ("body", "one two"), ("space", ""), ("list", "xy"), ("table", "h | 1"), ("space", ""), ("body", I.IMAGE_NOTE), ("heading", "t"),
    ]
    assert I.markup_blocks("") == [] and I.markup_blocks(None) == []


def test_cut_references_stay_as_in_the_sql(spark, tmp_path):
    from tarnhelm.plans import all_plans

    heads = ["x &amp; y&amp;&amp", "a&lt", "a &lt;b&gt; &amp;amp; &#x27;&#x2", "&quot", "&nbsp;&eacute;", "<b>c</b> &am"]
    html = "".join(f"<h1>{h}</h1><ul><li>{h}</li></ul>" for h in heads)
    spark.createDataFrame([(1, html)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    plans = all_plans()
    for name in ("html_headings", "html_list_items"):
        got = [tuple(r) for r in plans.queries[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(con.execute(plans.oracles[name]).fetchall()) and len(got) == len(heads)
    assert I.markup_blocks("<h1>a&amp</h1>") == [("title", "a&")]


def _docx(xml):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    return data.getvalue()


def test_word_files(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Top", '<w:pStyle w:val="Heading1"/>') + p("plain") + p("item", "<w:numPr/>") + p("") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(_docx(f"<w:document {ns}><w:body>{body}</w:body></w:document>"))
    (tmp_path / "b.docx").write_bytes(b"PK but no zip")
    (tmp_path / "c.txt").write_bytes(b"text")
    files = I.read_files(spark, str(tmp_path))
    kinds = {r.path.split("/")[-1]: (r.kind, r.error, r.working_name) for r in I.import_documents(files).collect()}
    assert kinds == {"a.docx": ("docx", None, "a-working.pdf"), "b.docx": ("docx", None, "b-working.pdf"), "c.txt": ("text", None, "c-working.pdf")}
    rows = I.import_docx(I.read_files(spark, str(tmp_path), "*.docx")).collect()
    assert [(r.kind, r.text) for r in rows if r.path.endswith("a.docx")] == [("title", "Top"), ("body", "plain"), ("list", "item"), ("space", ""), ("table", "a | b"), ("space", "")]
    assert [r.error for r in rows if r.path.endswith("b.docx")] == ["malformed Word document: BadZipFile"]


def test_text_blocks(spark):
    row = spark.createDataFrame([("a \r\nb\n\n\n c\n\t",)], "t string").select(I.text_blocks(F.col("t")).alias("b")).first()
    assert [(b.kind, b.text) for b in row.b] == [("body", "a"), ("body", "b"), ("space", ""), ("body", "c"), ("space", "")]


def test_recognised_words(spark):
    tree = '[{"paragraphs":[{"lines":[{"words":[{"text":"ok","confidence":90,"bbox":{"x0":0,"y0":0,"x1":1,"y1":1}},{"text":null,"confidence":1},{"text":"nobox","confidence":5}]},{"words":null}]},null]},null,{"paragraphs":null}]'
    df = spark.createDataFrame([(1, tree), (2, "{}"), (3, None)], "i long, j string").select("i", F.from_json("j", I.OCR_TREE).alias("t"))
    got = df.select("i", I.ocr_words(F.col("t")).alias("w")).collect()
    assert {r.i: [w.text for w in r.w or []] for r in got} == {1: ["ok"], 2: [], 3: []}


def test_encodable_and_wrap(spark):
    df = spark.createDataFrame([("ﬁn – “x”\t…",), ("日本",), (None,)], "t string")
    assert [r[0] for r in df.select(L.encodable(F.col("t"))).collect()] == ['fin - "x"    ...', "??", None]
    lines = df.limit(1).select(L.wrap(F.lit("alpha beta gammadeltaepsilon x"), F.lit(1.0), 10.0, 1.0).alias("l")).first().l
    assert lines == ["alpha beta", "gammadelta", "epsilon x"]
    assert df.limit(1).select(L.text_width(F.lit("Wi "))).first()[0] == (944 + 222 + 278) / 1000
