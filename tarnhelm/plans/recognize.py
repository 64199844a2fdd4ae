"""Structured recognisers: each alone, and all together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnhelm.functions import checks
from tarnhelm.operators import recognizers as R
from tarnhelm.operators import spans as S
from tarnhelm.plans.made import PII_TEXT, pii_text
from tarnhelm.plans.registry import query, spread, table

#: Fixed values in the SQL's own spelling (its engine's regex dialect, whose word edges are ASCII).
_STREET = "STREET|ST|AVENUE|AVE|ROAD|RD|BOULEVARD|BLVD|LANE|LN|DRIVE|DR|COURT|CT|PLACE|PL|PARKWAY|PKWY|HIGHWAY|HWY"
_STATES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
)
SQL_PATTERNS = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "ssn": r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b",
    "ssn_masked": r"(?i)\b(?:X{2,3}|\*{2,3})[- ]?(?:X{2}|\*{2})[- ]?\d{3,4}\b",
    "street": rf"(?i)\b\d{{1,6}}\s+(?:[A-Z0-9][A-Z0-9.''-]*\s+){{1,5}}(?:{_STREET})\b",
    "unit": r"(?i)\b(?:APT|APARTMENT|UNIT|SUITE|STE)\s+[#A-Z0-9-]{1,10}\b",
    "city": rf"\b[A-Z][A-Z.''-]{{1,20}}(?:\s+[A-Z][A-Z.''-]{{1,20}}){{0,2}},?\s+(?:{_STATES})\s+\d{{5}}(?:-\d{{4}})?\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b",
    "account": r"(?i)\b(?:account|acct|routing)\s*(?:number|no\.?|#)?\s*[:#-]?\s*([0-9][0-9 -]{3,20}[0-9])\b",
}


def spans_sql(source: str, pattern: str, group: int = 0) -> str:
    """(doc_id, start, end, m0, value) of a pattern without look-around, from (doc_id, text)."""
    return f"""
  SELECT doc_id, (s + length(m0) - length(value))::INT AS "start", (s + length(m0))::INT AS "end", m0, value FROM (
    SELECT doc_id, ms[i] AS m0, vs[i] AS value,
      list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, ms, gs, vs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs,
        regexp_extract_all(text, '{pattern}', {group}) AS vs FROM ({source}))))"""


DOCS = "SELECT doc_id, text FROM documents"
PAGES = "SELECT page_id AS doc_id, html AS text FROM pages"

#: Look-around patterns: every position is tried on its own.
CARDS = """
  SELECT doc_id, (min(p) - 1)::INT AS "start", e::INT AS "end", arg_min(run, p) AS value FROM (
    SELECT doc_id, p, run, p - 1 + length(run) AS e FROM (
      SELECT doc_id, p, substr(text, p, 1) AS c, substr(text, p - 1, 1) AS b, text, regexp_extract(substr(text, p, 80), '^[0-9](?:[ -]?[0-9])*') AS run
      FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM ({source})) WHERE substr(text, p, 1) BETWEEN '0' AND '9')
    WHERE run <> '' AND (p = 1 OR NOT regexp_matches(b, '[0-9]')) AND length(regexp_replace(run, '[^0-9]', '', 'g')) BETWEEN 13 AND 19)
  GROUP BY doc_id, e"""
PHONES = r"""
  SELECT doc_id, (p - 1)::INT AS "start", (p - 1 + length(run))::INT AS "end", run AS value FROM (
    SELECT *, max(p + length(run)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (
      SELECT doc_id, p, text, substr(text, p - 1, 1) AS b,
        regexp_extract(substr(text, p, 60), '^(?:(?:\+?1[\s.-]?)?(?:\(\d{{3}}\)|\d{{3}})[\s.-]\d{{3}}[\s.-]\d{{4}}|\+(?:\d[\s().-]?){{7,14}}\d)') AS run
      FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM ({source}) WHERE regexp_matches(text, '[0-9]')))
    WHERE run <> '' AND (p = 1 OR NOT regexp_matches(b, '[0-9+]')) AND NOT regexp_matches(substr(text, p + length(run), 2), '^[\s().-]?\d'))
  WHERE reached IS NULL OR p >= reached"""

LUHN = """(length(d) BETWEEN 13 AND 19 AND d <> repeat(left(d, 1), length(d)) AND list_sum(list_transform(range(0, length(d)),
  lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(d, length(d) - i, 1) AS INT) WHEN CAST(substr(d, length(d) - i, 1) AS INT) > 4
  THEN CAST(substr(d, length(d) - i, 1) AS INT) * 2 - 9 ELSE CAST(substr(d, length(d) - i, 1) AS INT) * 2 END)) % 10 = 0)"""
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
SSN = "(length(d) = 9 AND d[1:3] NOT IN ('000', '666') AND d[1:3] < '900' AND d[4:5] <> '00' AND d[6:9] <> '0000')"
ABA = "(length(d) = 9 AND list_sum(list_transform(range(1, 10), lambda i: CAST(substr(d, i, 1) AS INT) * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0)"
LENGTHS = ", ".join(f"('{c}', {n})" for c, n in checks.IBAN_LENGTHS.items())
IBAN = """(EXISTS (SELECT 1 FROM iban_lengths WHERE country = v[1:2] AND n = length(v)) AND list_reduce(list_transform(
  list_filter(regexp_extract_all(v[5:] || v[1:4], '.'), lambda c: c <> ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END),
  lambda r, c: CAST((CAST(r AS HUGEINT) * CASE WHEN length(c) = 1 THEN 10 ELSE 100 END + CAST(c AS INT)) % 97 AS VARCHAR), '0') = '1')"""


def _spans(df, key, text, name, raw=False):
    made = R.candidates(F.col(text), name) if raw else R.findings_of(F.col(text), name)
    return df.select(F.col(key).alias("doc_id"), F.explode(made).alias("f")).select("doc_id", "f.start", "f.end", "f.value")


def _register(name: str, recognizer: str, source: str, sql: str, raw: bool = False) -> None:
    def run(spark, sf_dir):
        if source == "made":
            return _spans(pii_text(spark, sf_dir), "doc_id", "text", recognizer, raw)
        key, text = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}[source]
        return _spans(spread(table(spark, sf_dir, source)), key, text, recognizer, raw)

    query(name, sql)(run)


_PLAIN = 'SELECT doc_id, "start", "end", value FROM ({})'
_register("email_findings", "email", "documents", _PLAIN.format(spans_sql(DOCS, SQL_PATTERNS["email"])))
_register("email_findings_pages", "email", "pages", _PLAIN.format(spans_sql(PAGES, SQL_PATTERNS["email"])))
_register("phone_findings", "phone", "documents", PHONES.format(source=DOCS))
_register("phone_findings_made", "phone", "made", PHONES.format(source=PII_TEXT))
_register("card_candidates", "card", "documents", CARDS.format(source=DOCS), raw=True)
_register("card_luhn_valid", "card", "documents", f'SELECT doc_id, "start", "end", value FROM (SELECT *, {DIGITS} AS d FROM ({CARDS.format(source=DOCS)})) WHERE {LUHN}')
_register("card_luhn_pages", "card", "pages", f'SELECT doc_id, "start", "end", value FROM (SELECT *, {DIGITS} AS d FROM ({CARDS.format(source=PAGES)})) WHERE {LUHN}')
_register("ssn_valid", "ssn", "made", f'SELECT doc_id, "start", "end", value FROM (SELECT *, {DIGITS} AS d FROM ({spans_sql(PII_TEXT, SQL_PATTERNS["ssn"])})) WHERE {SSN}')
for _name, _key in (("ssn_masked", "ssn_masked"), ("street_address", "street"), ("address_unit", "unit"), ("city_state_zip", "city")):
    _register(_name, _key, "made", _PLAIN.format(spans_sql(PII_TEXT, SQL_PATTERNS[_key])))
_register(
    "tax_id", "tax_id", "made",
    rf"""SELECT doc_id, (p - 1)::INT AS "start", (p + 9)::INT AS "end", substr(text, p, 10) AS value
    FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM ({PII_TEXT}))
    WHERE regexp_matches(substr(text, p, 10), '^\d{{2}}-\d{{7}}$') AND NOT regexp_matches(substr(text, p + 10, 1), '\d') AND (p = 1 OR NOT regexp_matches(substr(text, p - 1, 1), '\d'))""",
)
_register(
    "iban_valid", "iban", "made",
    f"""WITH iban_lengths(country, n) AS (VALUES {LENGTHS})
    SELECT doc_id, "start", "end", value FROM (SELECT *, upper(regexp_replace(value, '\\s', '', 'g')) AS v FROM ({spans_sql(PII_TEXT, SQL_PATTERNS["iban"])})) WHERE {IBAN}""",
)

_ACCOUNTS = f"""SELECT doc_id, "start", "end", CASE WHEN routing THEN 'US_BANK_NUMBER' ELSE 'ACCOUNT_NUMBER' END AS category, value
    FROM (SELECT *, {DIGITS} AS d, regexp_matches(m0, '(?i)routing') AS routing FROM ({spans_sql(PII_TEXT, SQL_PATTERNS["account"], 1)}))
    WHERE length(d) BETWEEN 4 AND 17 AND (NOT routing OR {ABA})"""


@query("account_numbers", _ACCOUNTS)
def account_numbers(spark, sf_dir):
    df = pii_text(spark, sf_dir)
    return df.select("doc_id", F.explode(R.findings_of(F.col("text"), "account")).alias("f")).select("doc_id", "f.start", "f.end", "f.category", "f.value")


@query("aba_routing", f"SELECT doc_id, value FROM ({_ACCOUNTS}) WHERE category = 'US_BANK_NUMBER'")
def aba_routing(spark, sf_dir):
    return account_numbers(spark, sf_dir).where("category = 'US_BANK_NUMBER'").select("doc_id", "value")


@query("iban_length_dim", f"SELECT country, n::INT AS iban_length FROM (VALUES {LENGTHS}) t(country, n)")
def iban_length_dim(spark, sf_dir):
    """The registered lengths as a dimension, from the same map that the check uses."""
    pairs = F.array(*[F.struct(F.lit(c).alias("country"), F.lit(n).alias("iban_length")) for c, n in checks.IBAN_LENGTHS.items()])
    return spark.range(1).select(F.explode(pairs).alias("x")).select("x.*")


@query("email_counts_by_lang", f"""SELECT lang, count(*) AS n FROM ({spans_sql(DOCS, SQL_PATTERNS["email"])}) JOIN documents USING (doc_id) GROUP BY lang""")
def email_counts_by_lang(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("lang", F.size(R.findings_of(F.col("text"), "email")).alias("k")).where("k > 0").groupBy("lang").agg(F.sum("k").alias("n"))


def structured_sql(source: str) -> str:
    """All recognisers' findings, written independently of the Spark plan."""
    own = f"SELECT doc_id, text FROM ({source})"
    parts = []
    for name, category, confidence, place, where, kind in (
        ("email", "EMAIL_ADDRESS", 0.99, 1, None, None), ("ssn", "US_SSN", 0.99, 2, SSN, "d"), ("ssn_masked", "US_SSN", 0.96, 3, None, None),
        ("street", "STREET_ADDRESS", 0.97, 5, None, None), ("unit", "ADDRESS_UNIT", 0.96, 6, None, None), ("city", "CITY_STATE_ZIP", 0.97, 7, None, None),
        ("iban", "IBAN_CODE", 0.98, 10, IBAN, "v"),
    ):
        extra = {"d": f", {DIGITS} AS d", "v": ", upper(regexp_replace(value, '\\s', '', 'g')) AS v", None: ""}[kind]
        inner = f"SELECT *{extra} FROM ({spans_sql(own, SQL_PATTERNS[name])})"
        parts.append(f"""SELECT doc_id, "start", "end", '{category}' AS category, {confidence}::DOUBLE AS confidence, {place} AS ord, value FROM ({inner}) WHERE {where or 'true'}""")
    parts.append(f"""SELECT doc_id, "start", "end", CASE WHEN routing THEN 'US_BANK_NUMBER' ELSE 'ACCOUNT_NUMBER' END, 0.96::DOUBLE, 0, value
      FROM (SELECT *, {DIGITS} AS d, regexp_matches(m0, '(?i)routing') AS routing FROM ({spans_sql(own, SQL_PATTERNS["account"], 1)}))
      WHERE length(d) BETWEEN 4 AND 17 AND (NOT routing OR {ABA})""")
    parts.append(f"""SELECT doc_id, "start", "end", 'PHONE_NUMBER', 0.97::DOUBLE, 8, value FROM ({PHONES.format(source=own)}) WHERE length({DIGITS}) BETWEEN 10 AND 15""")
    parts.append(f"""SELECT doc_id, "start", "end", 'CREDIT_CARD', 0.99::DOUBLE, 9, value FROM (SELECT *, {DIGITS} AS d FROM ({CARDS.format(source=own)})) WHERE {LUHN}""")
    parts.append(rf"""SELECT doc_id, (p - 1)::INT, (p + 9)::INT, 'US_TAX_ID', 0.98::DOUBLE, 4, substr(text, p, 10)
      FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM ({own}) WHERE regexp_matches(text, '-\d{{7}}'))
      WHERE regexp_matches(substr(text, p, 10), '^\d{{2}}-\d{{7}}$') AND NOT regexp_matches(substr(text, p + 10, 1), '\d') AND (p = 1 OR NOT regexp_matches(substr(text, p - 1, 1), '\d'))""")
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ")"


LENGTHS_CTE = f"iban_lengths(country, n) AS (VALUES {LENGTHS})"
COALESCE = """
a AS (SELECT *, CASE WHEN lag(category) OVER w = category THEN 0 ELSE 1 END AS brk FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end", ord)),
b AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY "start", "end", ord ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, max("end") OVER (PARTITION BY doc_id, run ORDER BY "start", "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR "start" >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY "start", "end", ord ROWS UNBOUNDED PRECEDING) AS isl FROM c),
merged AS (SELECT doc_id, min("start") AS s, max("end") AS e, min(category) AS category, max(confidence) AS confidence FROM g GROUP BY doc_id, run, isl),
ranked AS (SELECT doc_id, list({'s': s, 'e': e, 'category': category, 'confidence': confidence} ORDER BY confidence DESC, s, e) AS fs FROM merged GROUP BY doc_id)
"""
#: Suppression as a recursion over the ranked findings of each text.
MERGE = (
    COALESCE
    + """,
steps AS (
  SELECT doc_id, fs, 1 AS i, [fs[1]] AS acc FROM ranked
  UNION ALL
  SELECT doc_id, fs, i + 1, CASE WHEN len(list_filter(acc, lambda k: greatest(0, least(k.e, fs[i + 1].e) - greatest(k.s, fs[i + 1].s))
      / greatest(1, least(k.e - k.s, fs[i + 1].e - fs[i + 1].s)) >= 0.65)) > 0 THEN acc ELSE list_append(acc, fs[i + 1]) END
  FROM steps WHERE i < len(fs)),
final AS (SELECT doc_id, unnest(acc) AS f FROM steps WHERE i = len(fs))
"""
)


@query("structured_findings", f"""WITH {LENGTHS_CTE} SELECT doc_id, "start", "end", category, confidence, ord::INT AS ord, value FROM ({structured_sql(PII_TEXT)})""")
def structured_findings(spark, sf_dir):
    return R.scan(pii_text(spark, sf_dir), "doc_id").select("doc_id", "start", "end", "category", "confidence", "ord", "value")


@query("structured_counts_documents", f"""WITH {LENGTHS_CTE} SELECT category, count(*) AS n FROM ({structured_sql(DOCS)}) GROUP BY category""")
def structured_counts_documents(spark, sf_dir):
    return R.scan(spread(table(spark, sf_dir, "documents")), "doc_id").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("detect_pii", f"""WITH RECURSIVE {LENGTHS_CTE}, found AS ({structured_sql(PII_TEXT)}), {MERGE}
SELECT doc_id, f.s::INT AS "start", f.e::INT AS "end", f.category AS category, f.confidence AS confidence FROM final""")
def detect_pii(spark, sf_dir):
    """Structured findings coalesced and suppressed within each row: no shuffle."""
    merged = S.merge_array(R.structured(F.col("text")))
    return pii_text(spark, sf_dir).select("doc_id", F.explode(merged).alias("f")).select("doc_id", "f.start", "f.end", "f.category", "f.confidence")


@query("detect_counts", f"""WITH RECURSIVE {LENGTHS_CTE}, found AS ({structured_sql(DOCS)}), {MERGE}
SELECT f.category AS category, count(*) AS n FROM final GROUP BY f.category""")
def detect_counts(spark, sf_dir):
    """The flagship scan: all recognisers over all documents, merged, by category."""
    merged = S.merge_array(R.structured(F.col("text")))
    return spread(table(spark, sf_dir, "documents")).select(F.explode(merged).alias("f")).groupBy("f.category").agg(F.count(F.lit(1)).alias("n"))


@query("redact_email_text", f"""SELECT doc_id, md5(regexp_replace(text, '{SQL_PATTERNS["email"]}', 'REDACTED', 'g')) AS redacted_md5 FROM documents WHERE text LIKE '%@%'""")
def redact_email_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).where("text LIKE '%@%'")
    return docs.select("doc_id", F.md5(S.redact(F.col("text"), R.findings_of(F.col("text"), "email"))).alias("redacted_md5"))


@query("redacted_stats", f"""WITH RECURSIVE {LENGTHS_CTE}, found AS ({structured_sql(DOCS)}), {MERGE},
u AS (SELECT doc_id, f.s AS s, f.e AS e FROM final),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM u),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
x AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, isl)
SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_spans, sum(e - s)::BIGINT AS n_chars_removed FROM x JOIN documents USING (doc_id) GROUP BY lang""")
def redacted_stats(spark, sf_dir):
    """What redaction removes, by language."""
    docs = spread(table(spark, sf_dir, "documents"))
    spans = docs.select("lang", S.union_spans(S.merge_array(R.structured(F.col("text")))).alias("u"))
    removed = F.aggregate("u", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    # The generator keeps the filter from being pushed into the projection, where the scan would run twice.
    spans = spans.select("lang", F.explode(F.array("u")).alias("u")).where(F.size("u") > 0)
    return spans.select("lang", F.size("u").alias("k"), removed.alias("r")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("k").alias("n_spans"), F.sum("r").alias("n_chars_removed")
    )
