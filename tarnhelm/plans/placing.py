"""Pages, rectangles, blocks, validation, redaction output and edit histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnhelm.operators import blocks as B
from tarnhelm.operators import geometry as G
from tarnhelm.operators import overlay as O
from tarnhelm.operators import pages as P
from tarnhelm.operators import validation as V
from tarnhelm.plans.made import made
from tarnhelm.plans.registry import query, table
from tarnhelm.streaming import history as H

# ---- pages: turns of a conversation as text items ----

_ITEMS = """SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INT) AS item_idx, CASE WHEN turn % 7 = 5 THEN '' WHEN turn % 3 = 1 THEN concat(' ', text) WHEN turn % 4 = 2 THEN concat(text, ' ') ELSE text END AS str,
  turn % 5 = 3 AS has_eol FROM conversations WHERE text IS NOT NULL"""
_ASSEMBLED = f"""
i AS (SELECT *, lag(str) OVER w AS ps, lag(has_eol) OVER w AS pe FROM ({_ITEMS}) WHERE length(str) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY item_idx)),
s AS (SELECT *, CASE WHEN ps IS NULL THEN '' WHEN pe THEN chr(10) WHEN regexp_matches(ps, '\\s$') OR regexp_matches(str, '^\\s') THEN '' ELSE ' ' END AS sep FROM i),
o AS (SELECT *, sum(length(sep) + length(str)) OVER (PARTITION BY doc_id ORDER BY item_idx ROWS UNBOUNDED PRECEDING) AS e FROM s)"""


def items(spark, sf_dir):
    return made(spark, sf_dir, _ITEMS, "conversations")


@query("page_text_offsets", f'WITH {_ASSEMBLED} SELECT doc_id, item_idx, (e - length(str))::INT AS "start", e::INT AS "end" FROM o')
def page_text_offsets(spark, sf_dir):
    return P.assemble(items(spark, sf_dir), "doc_id").select("doc_id", "item_idx", "start", "end")


@query("page_text", f"WITH {_ASSEMBLED} SELECT doc_id, md5(string_agg(sep || str, '' ORDER BY item_idx)) AS text_md5 FROM o GROUP BY doc_id")
def page_text(spark, sf_dir):
    return P.page_text(P.assemble(items(spark, sf_dir), "doc_id"), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("searchable_gate", f"SELECT doc_id, sum(length(regexp_replace(str, '\\s', '', 'g')))::BIGINT AS n_searchable, sum(length(regexp_replace(str, '\\s', '', 'g'))) < 200 AS scan FROM ({_ITEMS}) GROUP BY doc_id")
def searchable_gate(spark, sf_dir):
    return P.needs_recognition(items(spark, sf_dir), "doc_id", least=200).select("doc_id", "n_searchable", "scan")


@query("pages_without_text", f"SELECT count(*) FILTER (WHERE trim(str) = '')::BIGINT AS n_blank, count(*) AS n_items, bool_or(trim(str) <> '') AS selectable FROM ({_ITEMS})")
def pages_without_text(spark, sf_dir):
    blank = F.trim("str") == ""
    return items(spark, sf_dir).agg(F.count_if(blank).alias("n_blank"), F.count(F.lit(1)).alias("n_items"), F.bool_or(~blank).alias("selectable"))


# ---- segments and findings on made pages ----

_UNIQUE = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS qty, min(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey, l_linenumber"
_SEGMENTS = f"""SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(0 AS INT) AS page_index, CAST(l_linenumber AS INT) AS seg_idx, CAST(l_linenumber * 20 AS INT) AS start_at, CAST(l_linenumber * 20 + 5 + pk % 15 AS INT) AS end_at,
  CASE WHEN pk % 11 = 0 THEN 'rtl' ELSE 'ltr' END AS dir, CAST(sk % 5 AS DOUBLE) AS ta, CAST(pk % 3 AS DOUBLE) * 4 AS tb, CAST(10 + pk % 500 AS DOUBLE) AS tx, CAST(20 + sk % 700 AS DOUBLE) AS ty,
  CAST(20 + pk % 100 AS DOUBLE) AS width, CAST(sk % 14 AS DOUBLE) AS height FROM ({_UNIQUE})"""
_FOUND = f"""SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(0 AS INT) AS page_index, CAST(l_linenumber * 17 AS INT) AS start_at, CAST(l_linenumber * 17 + 8 + sk % 30 AS INT) AS end_at,
  CASE WHEN pk % 2 = 0 THEN 'PERSON' ELSE 'US_SSN' END AS category, CAST(0.5 AS DOUBLE) AS confidence, 'model' AS source FROM ({_UNIQUE})"""
_RECT = """least(fx1, fx2, fx3, fx4) - pad AS x0, least(fy1, fy2, fy3, fy4) - pad AS y0, greatest(fx1, fx2, fx3, fx4) + pad AS x1, greatest(fy1, fy2, fy3, fy4) + pad AS y1"""
_POINTS = """SELECT *, tx + ux * width * f - uy * h * -0.22 AS fx1, tx + ux * width * f - uy * h * 0.9 AS fx2, tx + ux * width * t - uy * h * -0.22 AS fx3, tx + ux * width * t - uy * h * 0.9 AS fx4,
  ty + uy * width * f + ux * h * -0.22 AS fy1, ty + uy * width * f + ux * h * 0.9 AS fy2, ty + uy * width * t + ux * h * -0.22 AS fy3, ty + uy * width * t + ux * h * 0.9 AS fy4, greatest(0.5, h * 0.12) AS pad
FROM (SELECT *, ta / m AS ux, tb / m AS uy, greatest(height, m) AS h, CASE WHEN dir = 'rtl' THEN 1 - t0 ELSE f0 END AS f, CASE WHEN dir = 'rtl' THEN 1 - f0 ELSE t0 END AS t
  FROM (SELECT *, CASE WHEN sqrt(ta * ta + tb * tb) = 0 THEN 1.0 ELSE sqrt(ta * ta + tb * tb) END AS m FROM ({})))"""


def segments(spark, sf_dir):
    s = made(spark, sf_dir, _SEGMENTS, "lineitem").withColumnsRenamed({"start_at": "start", "end_at": "end"})
    return s.withColumn("transform", F.array("ta", "tb", F.lit(0.0), F.lit(0.0), "tx", "ty"))


def found(spark, sf_dir):
    return made(spark, sf_dir, _FOUND, "lineitem").withColumnsRenamed({"start_at": "start", "end_at": "end"})


def _rounded(c, *names):
    return [F.round(c[n], 4).alias(n) for n in names]


_R4 = "round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1"


@query("range_rects", f"SELECT doc_id, seg_idx, {_R4} FROM (SELECT doc_id, seg_idx, {_RECT} FROM ({_POINTS.format(f'SELECT *, 0.25::DOUBLE AS f0, 0.75::DOUBLE AS t0 FROM ({_SEGMENTS})')}))")
def range_rects(spark, sf_dir):
    s = segments(spark, sf_dir)
    r = G.range_rect(F.col("transform"), F.col("width"), F.col("height"), F.col("dir"), F.lit(0.25), F.lit(0.75))
    return s.select("doc_id", "seg_idx", r.alias("r")).select("doc_id", "seg_idx", *_rounded(F.col("r"), "x0", "y0", "x1", "y1"))


_JOINED = f"""SELECT s.*, f.start_at AS fs, f.end_at AS fe, f.category,
  CASE WHEN greatest(0, greatest(s.start_at, f.start_at) - s.start_at) <= 0 THEN 0.0::DOUBLE ELSE (greatest(s.start_at, f.start_at) - s.start_at) / (s.end_at - s.start_at)::DOUBLE END AS f0,
  CASE WHEN least(s.end_at, f.end_at) >= s.end_at THEN 1.0::DOUBLE ELSE (least(s.end_at, f.end_at) - s.start_at) / (s.end_at - s.start_at)::DOUBLE END AS t0
FROM ({_FOUND}) f JOIN ({_SEGMENTS}) s ON f.doc_id = s.doc_id AND f.page_index = s.page_index AND s.end_at > f.start_at AND s.start_at < f.end_at"""
_RECTS = f"SELECT doc_id, fs, fe, category, seg_idx, height, {_RECT} FROM ({_POINTS.format(_JOINED)})"


@query("finding_blocks", f"""SELECT doc_id, fs AS "start", fe AS "end", category, count(*)::INT AS n_rects, round(sum((x1 - x0) * (y1 - y0)), 3) AS area FROM ({_RECTS}) GROUP BY doc_id, fs, fe, category""")
def finding_blocks(spark, sf_dir):
    b = B.finding_blocks(found(spark, sf_dir), segments(spark, sf_dir), "doc_id", "page_index")
    total = F.aggregate("rects", F.lit(0.0), lambda a, r: a + G.area(r))
    return b.select("doc_id", "start", "end", F.col("suggestion.category").alias("category"), F.size("rects").alias("n_rects"), F.round(total, 3).alias("area"))


@query("label_rect", f"""SELECT doc_id, fs AS "start", label_rect_index, CASE WHEN height > 0 THEN height END AS source_font_size FROM (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, fs, fe, category ORDER BY seg_idx) - 1)::INT AS label_rect_index, row_number() OVER (PARTITION BY doc_id, fs, fe, category ORDER BY (x1 - x0) * (y1 - y0) DESC, seg_idx) AS best FROM ({_RECTS})) WHERE best = 1""")
def label_rect(spark, sf_dir):
    return B.finding_blocks(found(spark, sf_dir), segments(spark, sf_dir), "doc_id", "page_index").select("doc_id", "start", "label_rect_index", "source_font_size")


@query("block_ids", f"SELECT doc_id, fs AS \"start\", sha256(concat_ws(':', doc_id::VARCHAR, '0', fs::VARCHAR, fe::VARCHAR, category)) AS id FROM (SELECT DISTINCT doc_id, fs, fe, category FROM ({_RECTS}))")
def block_ids(spark, sf_dir):
    return B.finding_blocks(found(spark, sf_dir), segments(spark, sf_dir), "doc_id", "page_index").select("doc_id", "start", "id")


# ---- made blocks ----

_BLOCKS = f"""SELECT CAST(sk AS BIGINT) AS doc_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq, CAST(l_orderkey % 4 AS INT) AS page_index, CAST(pk % 60 * 10 AS DOUBLE) AS x0, CAST(l_orderkey % 70 * 10 AS DOUBLE) AS y0,
  CAST(pk % 60 * 10 + qty AS DOUBLE) AS x1, CAST(l_orderkey % 70 * 10 + pk % 20 AS DOUBLE) AS y1, l_linenumber = 1 AND pk % 50 = 0 AS existing, CAST(pk % 3 AS INT) AS label_rect_index,
  CASE WHEN pk % 5 = 0 THEN NULL ELSE CAST(pk % 600 AS DOUBLE) END AS source_font_size FROM ({_UNIQUE})"""


def blocks(spark, sf_dir):
    b = made(spark, sf_dir, _BLOCKS, "lineitem")
    return b.withColumn("rects", F.array(F.struct("x0", "y0", "x1", "y1"))).withColumn("id", F.concat(F.lit("b"), F.col("seq").cast("string")))


@query("suggestion_merge", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT existing, seq) AS k FROM ({_BLOCKS})),
l AS (SELECT doc_id, list({{'seq': seq, 'new': NOT existing, 'p': page_index, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY k) AS bs FROM r GROUP BY doc_id),
s AS (SELECT doc_id, bs, 0 AS i, bs[1:0] AS acc FROM l UNION ALL
  SELECT doc_id, bs, i + 1, CASE WHEN bs[i + 1].new AND (len(acc) >= 40 OR len(list_filter(acc, lambda k: k.p = bs[i + 1].p AND greatest(0, least(k.x1, bs[i + 1].x1) - greatest(k.x0, bs[i + 1].x0)) * greatest(0, least(k.y1, bs[i + 1].y1) - greatest(k.y0, bs[i + 1].y0))
    / greatest(1, (bs[i + 1].x1 - bs[i + 1].x0) * (bs[i + 1].y1 - bs[i + 1].y0)) > 0.6)) > 0) THEN acc ELSE list_append(acc, bs[i + 1]) END FROM s WHERE i < len(bs))
SELECT doc_id, 'b' || b.seq::VARCHAR AS id, b.new AS added FROM (SELECT doc_id, unnest(acc) AS b FROM s WHERE i = len(bs))""")
def suggestion_merge(spark, sf_dir):
    return B.merge_suggestions(blocks(spark, sf_dir), "doc_id", cap=40)


@query("page_cutoff", f"""SELECT doc_id, page_index FROM (SELECT doc_id, page_index, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 AS before
  FROM (SELECT doc_id, page_index, count(*) AS n FROM ({_BLOCKS}) GROUP BY doc_id, page_index)) WHERE before < 30""")
def page_cutoff(spark, sf_dir):
    pages = blocks(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))
    return B.page_cutoff(pages, "doc_id", "page_index", "n", existing=3, cap=30).select("doc_id", "page_index")


@query("scan_notice", f"""SELECT doc_id, concat(CASE WHEN n > 1 THEN concat(n::VARCHAR, ' suggestions added to the review queue.') WHEN n = 1 THEN '1 suggestion added to the review queue.' ELSE 'No new sensitive-data suggestions were found.' END,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' The contextual model was unavailable, so only structured patterns were used.' END,
  CASE WHEN blank = 0 THEN '' WHEN blank = 1 THEN ' 1 page needs manual area review because no searchable text was found.' ELSE concat(' ', blank::VARCHAR, ' pages need manual area review because no searchable text was found.') END) AS notice
  FROM (SELECT doc_id, count(*) FILTER (WHERE NOT existing AND page_index = 0) % 3 AS n, count(*) % 3 AS blank FROM ({_BLOCKS}) GROUP BY doc_id)""")
def scan_notice(spark, sf_dir):
    per = blocks(spark, sf_dir).groupBy("doc_id").agg((F.count_if(~F.col("existing") & (F.col("page_index") == 0)) % 3).alias("n"), (F.count(F.lit(1)) % 3).alias("blank"))
    return per.select("doc_id", B.scan_notice(F.col("n"), F.col("doc_id") % 2 == 0, F.col("blank")).alias("notice"))


_LINES = f"SELECT CAST(l_orderkey AS BIGINT) AS sel, CAST(l_linenumber AS INT) AS i, CAST(l_linenumber * 12 + pk % 4 AS DOUBLE) AS l, CAST(sk % 3 * 11 AS DOUBLE) AS t, CAST(l_linenumber * 12 + 9 + pk % 4 AS DOUBLE) AS r, CAST(sk % 3 * 11 + 10 + pk % 2 AS DOUBLE) AS b FROM ({_UNIQUE})"


@query("line_rect_merge", f"""WITH RECURSIVE o AS (SELECT sel, list({{'l': l, 't': t, 'r': r, 'b': b}} ORDER BY t, l, r, b) AS rs FROM ({_LINES}) GROUP BY sel),
s AS (SELECT sel, rs, 1 AS i, rs[1:0] AS acc, rs[1] AS p FROM o UNION ALL
  SELECT sel, rs, i + 1, CASE WHEN j THEN acc ELSE list_append(acc, p) END, CASE WHEN j THEN {{'l': least(p.l, n.l), 't': least(p.t, n.t), 'r': greatest(p.r, n.r), 'b': greatest(p.b, n.b)}} ELSE n END
  FROM (SELECT *, rs[i + 1] AS n, least(p.b - p.t, rs[i + 1].b - rs[i + 1].t) > 0 AND least(p.b, rs[i + 1].b) - greatest(p.t, rs[i + 1].t) >= 0.7 * least(p.b - p.t, rs[i + 1].b - rs[i + 1].t) AND rs[i + 1].l - p.r <= 5 AS j FROM s WHERE i < len(rs)))
SELECT sel, x.l AS "left", x.t AS "top", x.r AS "right", x.b AS "bottom" FROM (SELECT sel, unnest(list_append(acc, p)) AS x FROM s WHERE i = len(rs))""")
def line_rect_merge(spark, sf_dir):
    d = made(spark, sf_dir, _LINES, "lineitem")
    r = F.struct(F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"))
    return d.groupBy("sel").agg(F.collect_list(r).alias("rs")).select("sel", F.explode(G.merge_lines(F.col("rs"))).alias("x")).select("sel", "x.*")


@query("font_size_vote", f"""WITH s AS (SELECT sel, i, l, t, r, b FROM ({_LINES})),
v AS (SELECT a.sel, round((a.i % 3 + 1) * 4.1235, 3) AS size, sum(greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t))) AS score FROM s a JOIN s b ON a.sel = b.sel AND b.i % 2 = 0 GROUP BY 1, 2),
m AS (SELECT sel, arg_max(least(r - l, b - t), {{'a': (r - l) * (b - t), 'i': -i}}) AS room FROM s WHERE i % 2 = 0 GROUP BY sel)
SELECT sel, size FROM (SELECT v.sel, v.size, row_number() OVER (PARTITION BY v.sel ORDER BY score DESC, size) AS n FROM v JOIN m ON v.sel = m.sel WHERE score > 0 AND size <= room) WHERE n = 1""")
def font_size_vote(spark, sf_dir):
    d = made(spark, sf_dir, _LINES, "lineitem").select("sel", F.col("i").alias("rect_idx"), F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"))
    spans = d.withColumn("font_size", (F.col("rect_idx") % 3 + 1) * 4.1235)
    return B.font_size_vote(spans, d.where("rect_idx % 2 = 0"), "sel")


@query("rect_normalize", f"SELECT doc_id, seq, least(x0, x1) * 1.5 AS \"left\", (800 - greatest(y0, y1)) * 1.5 AS \"top\", abs(x1 - x0) * 1.5 AS width, abs(y1 - y0) * 1.5 AS height FROM ({_BLOCKS})")
def rect_normalize(spark, sf_dir):
    s = G.to_screen(F.struct("x0", "y0", "x1", "y1"), F.lit(1.5), F.lit(800))
    return blocks(spark, sf_dir).select("doc_id", "seq", s.alias("s")).select("doc_id", "seq", "s.*")


@query("bounding_rect", f"SELECT doc_id, page_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_BLOCKS}) GROUP BY doc_id, page_index")
def bounding_rect(spark, sf_dir):
    per = blocks(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("rs"))
    return per.select("doc_id", "page_index", G.bounding(F.col("rs")).alias("r")).select("doc_id", "page_index", "r.*")


@query("manual_filter", f"SELECT doc_id, seq, (x1 - x0) >= 8 AND (y1 - y0) >= 8 AS area_ok, x0 < 500 AND y0 < 600 AND x1 - x0 > 1 AND y1 - y0 > 1 AS selection_ok FROM ({_BLOCKS}) WHERE x1 - x0 > 0.5 AND y1 - y0 > 0.5")
def manual_filter(spark, sf_dir):
    """Hand-drawn blocks: half a point a side at least; drags of eight pixels, selections inside the page."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return blocks(spark, sf_dir).where((w > 0.5) & (h > 0.5)).select(
        "doc_id", "seq", ((w >= 8) & (h >= 8)).alias("area_ok"), ((F.col("x0") < 500) & (F.col("y0") < 600) & (w > 1) & (h > 1)).alias("selection_ok")
    )


_LABELED = f"SELECT doc_id, seq, x1 - x0 AS w, y1 - y0 AS h, source_font_size AS fs FROM ({_BLOCKS}) WHERE source_font_size IS NULL OR source_font_size > 0"


@query("label_style", f"""SELECT doc_id, seq, round(size, 4) AS font_size, vertical, round(CASE WHEN fs IS NULL THEN 1.0 ELSE least(1.0, greatest(0.05, a * 0.9 / (size * 5.2))) END, 6) AS squeeze FROM (
  SELECT *, h > w AS vertical, greatest(w, h) AS a, CASE WHEN fs IS NULL THEN greatest(4.0, least(10.0, greatest(w, h) * 0.9 / 6, least(w, h) / 1.25)) ELSE fs * 1.25 END AS size FROM ({_LABELED}))""")
def label_style(spark, sf_dir):
    d = made(spark, sf_dir, _LABELED, "lineitem")
    size, vertical, squeeze = G.label_style(F.col("w"), F.col("h"), F.col("fs"), F.lit(1.25), 5.2)
    return d.select("doc_id", "seq", F.round(size, 4).alias("font_size"), vertical.alias("vertical"), F.round(squeeze, 6).alias("squeeze"))


_SIZES = "SELECT CAST(p_partkey AS BIGINT) AS page_id, CAST((p_partkey * 37) % 9000 - 20 AS DOUBLE) AS width, CAST((p_partkey * 91) % 9000 AS DOUBLE) AS height, CAST(p_partkey % 5 AS DOUBLE) AS ratio FROM part"


@query("preview_scale", f"""SELECT page_id, round(CASE WHEN width > 0 AND height > 0 THEN least(CASE WHEN ratio > 0 THEN least(ratio, 2.0) ELSE 1.0 END, 4096.0 / nullif(width, 0), 4096.0 / nullif(height, 0), sqrt(4000000.0 / nullif(abs(width * height), 0))) ELSE 1.0 END, 6) AS scale FROM ({_SIZES})""")
def preview_scale(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    good = F.when((w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))
    return made(spark, sf_dir, _SIZES, "part").withColumn("g", good).select("page_id", F.round(F.coalesce(G.preview_scale(F.col("g.w"), F.col("g.h"), F.col("ratio")), F.lit(1.0)), 6).alias("scale"))


_FAILURES = """SELECT CAST(p_partkey AS BIGINT) AS id, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'RangeError' WHEN 1 THEN 'AbortException' WHEN 2 THEN 'Error' ELSE 'TypeError' END AS name,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'Canvas area exceeds  the maximum limit' WHEN 1 THEN 'Invalid PDF operator' WHEN 2 THEN '' WHEN 3 THEN 'was cancelled by user' WHEN 4 THEN concat('out of memory ', repeat('x', 200)) ELSE p_name END AS message FROM part"""


@query("render_failure_class", f"""SELECT id, CASE WHEN regexp_matches(name || ' ' || m, '(?i)canvas|memory|allocation|surface|dimension|size|area|context') THEN 'PREVIEW_CANVAS_LIMIT' ELSE 'PREVIEW_RENDER' END AS code,
  CASE WHEN m <> '' THEN name || ': ' || m ELSE name END AS detail, name IN ('RenderingCancelledException', 'AbortException') OR regexp_matches(message, '(?i)cancel(?:led|ed|lation)') AS cancelled
  FROM (SELECT *, substr(trim(regexp_replace(message, '\\s+', ' ', 'g')), 1, 180) AS m FROM ({_FAILURES}))""")
def render_failure_class(spark, sf_dir):
    code, detail = G.failure_class(F.col("name"), F.col("message"))
    return made(spark, sf_dir, _FAILURES, "part").select("id", code.alias("code"), detail.alias("detail"), G.is_cancellation(F.col("name"), F.col("message")).alias("cancelled"))


# ---- validation ----


@query("rect_schema", f"SELECT doc_id, seq, x1 > x0 AND y1 > y0 AS valid FROM ({_BLOCKS})")
def rect_schema(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "seq", V.rect_valid(F.col("rects")[0]).alias("valid"))


@query("rect_on_page", f"""SELECT doc_id, seq, CASE WHEN NOT (x1 > x0 AND y1 > y0) THEN 'invalid' WHEN greatest(0, least(x1, 300) - greatest(x0, 0)) * greatest(0, least(y1, 400) - greatest(y0, 0)) <= 0 THEN 'outside its page' END AS error FROM ({_BLOCKS})""")
def rect_on_page(spark, sf_dir):
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(400.0).alias("y1"))
    return blocks(spark, sf_dir).select("doc_id", "seq", V.rect_error(F.col("rects")[0], page).alias("error"))


_MANIFEST = f"""SELECT doc_id, seq, page_index, x0, y0, x1, y1, label_rect_index, source_font_size, CASE WHEN seq % 13 = 0 THEN '' ELSE concat('b', CAST(seq AS STRING)) END AS id,
  CASE WHEN seq % 17 = 0 THEN 'HIDDEN' ELSE 'REDACTED' END AS replacement, 'text-replacement' AS appearance FROM ({_BLOCKS})"""


def manifest(spark, sf_dir):
    return made(spark, sf_dir, _MANIFEST, "lineitem").withColumn("rects", F.array(F.struct("x0", "y0", "x1", "y1")))


_RULES = """concat_ws(',', CASE WHEN length(id) BETWEEN 1 AND 80 THEN NULL ELSE 'id' END, CASE WHEN x1 > x0 AND y1 > y0 THEN NULL ELSE 'rects' END,
  CASE WHEN source_font_size IS NULL OR (source_font_size > 0 AND source_font_size <= 512) THEN NULL ELSE 'source_font_size' END, CASE WHEN replacement = 'REDACTED' THEN NULL ELSE 'replacement' END)"""


@query("block_schema", f"SELECT doc_id, seq, {_RULES} AS violations FROM ({_MANIFEST})")
def block_schema(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return m.select("doc_id", "seq", F.array_join(V.block_violations(m), ",").alias("violations"))


@query("manifest_schema", f"""SELECT doc_id, count(*) AS n_blocks, sum(CASE WHEN {_RULES} <> '' THEN 1 ELSE 0 END)::BIGINT AS n_bad, count(*) BETWEEN 1 AND 50 AND sum(CASE WHEN {_RULES} <> '' THEN 1 ELSE 0 END) = 0 AS valid FROM ({_MANIFEST}) GROUP BY doc_id""")
def manifest_schema(spark, sf_dir):
    return V.manifest_valid(manifest(spark, sf_dir), "doc_id", 50)


@query("missing_pages", f"SELECT doc_id, seq FROM ({_BLOCKS}) b WHERE page_index >= 1 + doc_id % 4")
def missing_pages(spark, sf_dir):
    b = blocks(spark, sf_dir)
    pages = b.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("page_index"))
    return V.missing_pages(b, pages).select("doc_id", "seq")


# ---- redaction output ----

_NUM = "CASE WHEN abs({0}) < 0.000001 THEN '0' ELSE regexp_replace(format('{{:.4f}}', {0}), '\\.?0+$', '') END"
_OVERLAY = f"""o AS (SELECT doc_id, page_index, seq, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h, source_font_size AS fs FROM ({_BLOCKS}) WHERE x1 > x0 AND y1 > y0),
z AS (SELECT *, greatest(0.5, least(coalesce(fs, h * 0.72), h * 0.72, greatest(0.5, w - 2) / 5.56)) AS size FROM o),
q AS (SELECT *, x0 + greatest(1.0, (w - size * 5.56) / 2) AS tx, y0 + greatest(0.0, (h - size) / 2) + size * 0.16 AS ty FROM z)"""


@query("overlay_commands", f"""WITH {_OVERLAY} SELECT doc_id, page_index, count(*)::INT AS n_labels, (count(*) * 2 + 4)::INT AS n_lines,
  string_agg(concat({_NUM.format('x0')}, ' ', {_NUM.format('y0')}, ' ', {_NUM.format('w')}, ' ', {_NUM.format('h')}, ' re f'), chr(10) ORDER BY seq) AS fills FROM q GROUP BY doc_id, page_index""")
def overlay_commands(spark, sf_dir):
    b = blocks(spark, sf_dir).where("x1 > x0 AND y1 > y0").withColumnRenamed("seq", "block_seq")
    o = O.overlay(b, "doc_id", "page_index")
    lines = F.filter(F.split("overlay", "\n"), lambda x: x != "")
    fills, labels = F.filter(lines, lambda x: x.endswith(" re f")), F.filter(lines, lambda x: x.startswith("BT "))
    return o.select("doc_id", "page_index", F.size(labels).alias("n_labels"), F.size(lines).alias("n_lines"), F.array_join(fills, "\n").alias("fills"))


@query("overlay_labels", f"WITH {_OVERLAY} SELECT doc_id, seq, round(size, 3) AS size, round(tx, 3) AS x, round(ty, 3) AS y FROM q")
def overlay_labels(spark, sf_dir):
    size, x, y = O.label_geometry(F.struct("x0", "y0", "x1", "y1"), F.col("source_font_size"), 5.56)
    b = blocks(spark, sf_dir).where("x1 > x0 AND y1 > y0")
    return b.select("doc_id", "seq", F.round(size, 3).alias("size"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("free_resource_name", f"""SELECT doc_id, 'Label' || min(n)::VARCHAR AS free FROM (SELECT DISTINCT doc_id FROM ({_BLOCKS})) d, range(1, 100) r(n) WHERE NOT EXISTS (SELECT 1 FROM ({_BLOCKS}) b WHERE b.doc_id = d.doc_id AND b.seq % 9 = n) GROUP BY doc_id""")
def free_resource_name(spark, sf_dir):
    used = blocks(spark, sf_dir).select("doc_id", F.concat(F.lit("Label"), (F.col("seq") % 9).cast("string")).alias("name"))
    return O.free_name(used, "doc_id", F.col("name"))


@query("text_removed", f"""WITH s AS (SELECT doc_id, seg_idx, tx AS x0, ty AS y0, tx + width AS x1, ty + height AS y1 FROM ({_SEGMENTS}))
SELECT doc_id, seg_idx FROM s WHERE NOT EXISTS (SELECT 1 FROM ({_BLOCKS}) b WHERE b.doc_id = s.doc_id % 100 + 1 AND b.x1 > b.x0 AND greatest(0, least(s.x1, b.x1) - greatest(s.x0, b.x0)) * greatest(0, least(s.y1, b.y1) - greatest(s.y0, b.y0)) > 0)""")
def text_removed(spark, sf_dir):
    rect = F.struct(F.col("tx").alias("x0"), F.col("ty").alias("y0"), (F.col("tx") + F.col("width")).alias("x1"), (F.col("ty") + F.col("height")).alias("y1"))
    s = segments(spark, sf_dir).select((F.col("doc_id") % 100 + 1).alias("page_of"), "doc_id", "seg_idx", rect.alias("rect"))
    b = blocks(spark, sf_dir).where("x1 > x0").select(F.col("doc_id").alias("page_of"), "rects")
    return O.remove_text(s, b, "page_of").select("doc_id", "seg_idx")


_IMAGES = f"""SELECT CAST(sk AS BIGINT) AS doc_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS image_idx, CAST(l_orderkey % 500 AS BIGINT) AS object_number, CASE CAST(pk % 3 AS INT) WHEN 0 THEN 'DCTDecode' ELSE 'FlateDecode' END AS filter,
  pk % 7 = 0 AS has_mask, pk % 11 = 0 AS has_alpha, CAST(pk AS BIGINT) AS width, CAST(500 + pk % 1000 AS BIGINT) AS height FROM ({_UNIQUE})"""


@query("image_recompress_eligible", f"SELECT doc_id, object_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, object_number ORDER BY image_idx) AS n FROM ({_IMAGES})) WHERE n = 1 AND filter = 'FlateDecode' AND NOT has_mask AND NOT has_alpha AND width * height >= 750000")
def image_recompress_eligible(spark, sf_dir):
    return O.recompressible(made(spark, sf_dir, _IMAGES, "lineitem").withColumn("filters", F.array("filter"))).select("doc_id", "object_number")


@query("page_space", f"SELECT doc_id, seq, x0 * 2 + 5 AS x0, 800 - y1 * 2 AS y0, x1 * 2 + 5 AS x1, 800 - y0 * 2 AS y1 FROM ({_BLOCKS}) WHERE y1 >= y0 AND x1 >= x0")
def page_space(spark, sf_dir):
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 0, -2, 5, 800)])
    b = blocks(spark, sf_dir).where("y1 >= y0 AND x1 >= x0").select("doc_id", "seq", F.struct("x0", "y0", "x1", "y1").alias("r"))
    for step in (m, O.inverse(m), m):  # there, back and there again; a column each, so that no step is inlined twice
        b = b.withColumn("m", step).withColumn("r", O.to_page_space(F.col("r"), F.col("m")))
    return b.select("doc_id", "seq", "r.*")


@query("export_columns", "SELECT doc_id, (doc_id % 100)::INT AS page_index, md5(text) AS text, lang AS overlay FROM documents")
def export_columns(spark, sf_dir):
    """An allow-list of columns: annotations and metadata aren't named, so they don't leave."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100).cast("int").alias("page_index"), F.md5("text").alias("text"), F.col("lang").alias("overlay"), "source", "n_chars")
    return O.export(d)


# ---- histories ----

_EVENTS = """SELECT CAST(user_id AS BIGINT) AS doc_id, CAST(event_id AS BIGINT) AS seq, CASE CAST(event_id % 9 AS INT) WHEN 5 THEN 'undo' WHEN 6 THEN 'redo' WHEN 7 THEN 'remove' ELSE 'add' END AS action, concat('b', CAST(event_id % 20 AS STRING)) AS block FROM events"""


@query("edit_history")
def edit_history(spark, sf_dir):
    return H.fold(made(spark, sf_dir, _EVENTS, "events"))


@query("latest_generation", "SELECT doc_id, generation, value FROM (SELECT user_id::BIGINT AS doc_id, event_id::BIGINT AS generation, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_generation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("doc_id"), F.col("event_id").cast("long").alias("generation"), F.col("event_type").alias("value"))
    return H.latest(e, "doc_id", "generation", "value")


@query("review_queue", f"SELECT doc_id, seq, CASE WHEN n < 10 THEN '0' || n::VARCHAR ELSE left(n::VARCHAR, 2) END AS queue_no FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM ({_BLOCKS}))")
def review_queue(spark, sf_dir):
    return H.queue_numbers(blocks(spark, sf_dir), "doc_id", "seq").select("doc_id", "seq", "queue_no")


@query("stream_findings")
def stream_findings(spark, sf_dir):
    """The document scan as a stream over the table's folder, run until its input is used up."""
    from tarnhelm.streaming import scan

    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    return scan.run_once(scan.findings(stream), spark, "stream_findings")
