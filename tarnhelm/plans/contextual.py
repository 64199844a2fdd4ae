"""Contextual detection: chunks, token spans, thresholds, propagation, degradation; span algebra on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnhelm.operators import contextual as C
from tarnhelm.operators import spans as S
from tarnhelm.plans.made import made
from tarnhelm.plans.registry import query, spread, table

#: Made findings: overlapping spans of three categories and two sources on the orders' keys.
FINDINGS = """
SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS ord, CAST(l_suppkey % 40 + l_linenumber AS INT) AS start_at,
  CAST(l_suppkey % 40 + l_linenumber + 3 + l_partkey % 17 AS INT) AS end_at,
  CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' ELSE 'EMAIL_ADDRESS' END AS category,
  CAST(50 + l_partkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE CAST(l_suppkey % 2 AS INT) WHEN 0 THEN 'model' ELSE 'recognizer' END AS source
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""


def findings(spark, sf_dir):
    return made(spark, sf_dir, FINDINGS, "lineitem").withColumnsRenamed({"start_at": "start", "end_at": "end"})


_COALESCED = f"""
f AS (SELECT doc_id, ord, start_at AS s, end_at AS e, category, confidence, source FROM ({FINDINGS})),
a AS (SELECT *, CASE WHEN lag(category) OVER w = category AND lag(source) OVER w = source THEN 0 ELSE 1 END AS brk FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY s, e, ord)),
b AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, max(e) OVER (PARTITION BY doc_id, run ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS isl FROM c),
m AS (SELECT doc_id, min(s) AS s, max(e) AS e, min(category) AS category, min(source) AS source, max(confidence) AS confidence, min(ord) AS ord FROM g GROUP BY doc_id, run, isl)"""


@query("coalesce_findings", f'WITH {_COALESCED} SELECT doc_id, s AS "start", e AS "end", category, source, confidence FROM m')
def coalesce_findings(spark, sf_dir):
    return S.coalesce(findings(spark, sf_dir), "doc_id").select("doc_id", "start", "end", "category", "source", "confidence")


@query("nms_findings", f"""WITH RECURSIVE {_COALESCED},
r AS (SELECT doc_id, list({{'s': s, 'e': e, 'category': category, 'source': source, 'confidence': confidence}} ORDER BY source <> 'recognizer', confidence DESC, s, ord) AS fs FROM m GROUP BY doc_id),
k AS (SELECT doc_id, fs, 1 AS i, [fs[1]] AS acc FROM r UNION ALL
  SELECT doc_id, fs, i + 1, CASE WHEN len(list_filter(acc, lambda k: greatest(0, least(k.e, fs[i + 1].e) - greatest(k.s, fs[i + 1].s))
    / greatest(1, least(k.e - k.s, fs[i + 1].e - fs[i + 1].s)) >= 0.65)) > 0 THEN acc ELSE list_append(acc, fs[i + 1]) END FROM k WHERE i < len(fs)),
z AS (SELECT doc_id, unnest(acc) AS f FROM k WHERE i = len(fs))
SELECT doc_id, f.s AS "start", f.e AS "end", f.category AS category, f.source AS source, f.confidence AS confidence FROM z""")
def nms_findings(spark, sf_dir):
    return S.suppress(S.coalesce(findings(spark, sf_dir), "doc_id"), "doc_id").select("doc_id", "start", "end", "category", "source", "confidence")


@query("overlap_ratio", f"""WITH f AS (SELECT doc_id, ord, start_at AS s, end_at AS e FROM ({FINDINGS}))
SELECT a.doc_id, a.ord AS ord_a, b.ord AS ord_b, round(greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / greatest(1, least(a.e - a.s, b.e - b.s)), 6) AS ratio
FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.ord < b.ord AND a.e > b.s AND a.s < b.e""")
def overlap_ratio(spark, sf_dir):
    f = findings(spark, sf_dir).select("doc_id", "ord", "start", "end")
    a, b = f.alias("a"), f.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.ord") < F.col("b.ord")) & (F.col("a.end") > F.col("b.start")) & (F.col("a.start") < F.col("b.end"))
    ratio = F.round(S.overlap_ratio(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")), 6)
    return a.join(b, on).select("a.doc_id", F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), ratio.alias("ratio"))


@query("text_chunks", r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, text, n, 0 AS i, 0 AS o FROM d UNION ALL
  SELECT doc_id, text, n, i + 1, greatest(o + 1, e - 60) FROM (
    SELECT *, CASE WHEN h < n AND soft > o + 210 THEN soft ELSE h END AS e FROM (
      SELECT *, o + length(regexp_extract(substr(text, o + 1, h - o + 1), '(?s)^(.*)[ \n]', 1)) AS soft FROM (SELECT *, least(n, o + 420) AS h FROM k))) WHERE e < n)
SELECT doc_id, i::INT AS chunk_idx, o::INT AS "offset", CASE WHEN h < n AND soft > o + 210 THEN soft ELSE h END::INT - o::INT AS n_chars FROM (
  SELECT *, o + length(regexp_extract(substr(text, o + 1, h - o + 1), '(?s)^(.*)[ \n]', 1)) AS soft FROM (SELECT *, least(n, o + 420) AS h FROM k))""")
def text_chunks(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    c = docs.select("doc_id", F.posexplode(C.chunks(F.col("text"))).alias("chunk_idx", "c"))
    return c.select("doc_id", "chunk_idx", "c.offset", F.length("c.text").alias("n_chars"))


#: Made tokens over a made text: words of five letters with a space or comma between.
TOKENS = """
SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS tok_idx, CAST(6 * l_linenumber AS INT) AS start_at, CAST(6 * l_linenumber + 5 AS INT) AS end_at,
  concat(CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'B-' ELSE 'I-' END, CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'LOCATION' WHEN 3 THEN 'DATE' ELSE 'PERSON' END) AS entity,
  CAST(70 + l_partkey % 30 AS DOUBLE) / CAST(100 AS DOUBLE) AS score,
  concat('      ', 'aaaaa bbbbb-ccccc,ddddd eeeee ', 'fffff''ggggg ', 'hhhhh iiiii ', 'jjjjj') AS text
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
_BIO = f"""
t AS (SELECT *, regexp_replace(entity, '^[BI]-', '') AS category FROM ({TOKENS})),
l AS (SELECT *, lag(category) OVER w AS pc, lag(end_at) OVER w AS pe FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)),
j AS (SELECT *, CASE WHEN entity LIKE 'I-%' AND pc = category AND regexp_matches(CASE WHEN start_at > pe THEN substr(text, pe + 1, start_at - pe) ELSE '' END, '^[\\s''’-]*$') THEN 0 ELSE 1 END AS brk FROM l),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY tok_idx ROWS UNBOUNDED PRECEDING) AS isl FROM j),
s AS (SELECT doc_id, min(category) AS category, min(score) AS score, min(start_at) AS s, max(end_at) AS e FROM i GROUP BY doc_id, isl)"""


def _merged(spark, sf_dir):
    tokens = made(spark, sf_dir, TOKENS, "lineitem").withColumnsRenamed({"start_at": "start", "end_at": "end"})
    return C.merge_tokens(tokens, "text", "doc_id")


@query("bio_merge", f'WITH {_BIO} SELECT doc_id, category, score, s AS "start", e AS "end" FROM s')
def bio_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select("doc_id", "category", "score", "start", "end")


@query("model_threshold", f"""WITH {_BIO} SELECT doc_id, category, score, s AS "start", e AS "end" FROM s
WHERE (category = 'PERSON' AND score >= 0.78) OR (category = 'LOCATION' AND score >= 0.82)""")
def model_threshold(spark, sf_dir):
    return C.above_threshold(_merged(spark, sf_dir)).select("doc_id", "category", "score", "start", "end")


_WORDS = """SELECT CAST(p_partkey AS BIGINT) AS part, concat(CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '##' WHEN 1 THEN '▁' WHEN 2 THEN 'Ġ ' ELSE ' ' END, p_brand, ' ') AS word FROM part"""


@query("normalized_tokens", f"SELECT part, trim(regexp_replace(regexp_replace(word, '^##', ''), '^[▁Ġ]+', '')) AS token FROM ({_WORDS})")
def normalized_tokens(spark, sf_dir):
    return made(spark, sf_dir, _WORDS, "part").select("part", C.clean_word(F.col("word")).alias("token"))


@query("propagate_repeats", r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{5,}') AS v FROM documents WHERE regexp_matches(text, '[A-Za-z]{5,}')),
p AS (SELECT doc_id, text, v, unnest(range(1, length(text) - length(v) + 2)) AS p FROM d)
SELECT doc_id, (p - 1)::INT AS "start", (p - 1 + length(v))::INT AS "end" FROM p
WHERE substr(text, p, length(v)) = v AND NOT regexp_matches(CASE WHEN p = 1 THEN '' ELSE substr(text, p - 1, 1) END, '^[\p{L}\p{N}]') AND NOT regexp_matches(substr(text, p + length(v), 1), '^[\p{L}\p{N}]')
UNION SELECT doc_id, strpos(text, v)::INT - 1, strpos(text, v)::INT - 1 + length(v)::INT FROM d""")
def propagate_repeats(spark, sf_dir):
    """Each document's first run of five or more ASCII letters, found wherever it stands alone."""
    docs = spread(table(spark, sf_dir, "documents")).where(F.col("text").rlike("[A-Za-z]{5,}"))
    v = F.regexp_extract("text", "[A-Za-z]{5,}", 0)
    first = F.struct((F.instr("text", v) - 1).alias("start"), (F.instr("text", v) - 1 + F.length(v)).alias("end"), F.lit("PERSON").alias("category"), F.lit(0.9).alias("confidence"), F.lit("model").alias("source"))
    return docs.select("doc_id", F.explode(S.propagate(F.col("text"), F.array(first))).alias("f")).select("doc_id", "f.start", "f.end")


@query("degraded_scan", "SELECT doc_id, false AS model_available, 'no classifier' AS model_error, 0::BIGINT AS n_model FROM documents")
def degraded_scan(spark, sf_dir):
    """A scan without a classifier: no model findings, and the status says why."""
    docs = spread(table(spark, sf_dir, "documents"))
    found = C.classify(docs, None).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    return C.model_status(docs, False, "no classifier").join(found, "doc_id", "left").select("doc_id", "model_available", "model_error", F.coalesce("k", F.lit(0)).cast("long").alias("n_model"))


@query("gazetteer_scan")
def gazetteer_scan(spark, sf_dir):
    """A scan with an injected classifier (a word list), structured findings beside it, merged."""
    from tarnhelm.operators import recognizers as R

    docs = spread(table(spark, sf_dir, "documents"))
    model = C.classify(docs, lambda: gazetteer).withColumn("ord", F.lit(99))
    both = R.scan(docs, "doc_id").select("doc_id", "start", "end", "category", "confidence", "source", "ord").unionByName(model)
    return S.suppress(S.coalesce(both, "doc_id"), "doc_id")


def gazetteer(texts: list[str]) -> list[list[dict]]:
    """A stand-in for a token classifier: capitalised two-word runs are persons."""
    import re

    out = []
    for t in texts:
        tokens = []
        for m in re.finditer(r"\b([A-Z][a-z]+) ([A-Z][a-z]+)\b", t):
            tokens += [{"entity": "B-PERSON", "score": 0.9, "word": m[1], "start": m.start(1), "end": m.end(1)}, {"entity": "I-PERSON", "score": 0.85, "word": m[2], "start": m.start(2), "end": m.end(2)}]
        out.append(tokens)
    return out
