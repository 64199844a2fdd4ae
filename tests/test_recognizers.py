"""Expected findings on short texts."""

import pytest
from pyspark.sql import functions as F

from tarnhelm.operators import recognizers as R
from tarnhelm.operators import spans as S

CASES = [
    ("Write to ana_b+x@mail.test.org or ring 415-555-0132; her number is 234 56 7891.", [("EMAIL_ADDRESS", "ana_b+x@mail.test.org"), ("PHONE_NUMBER", "415-555-0132"), ("US_SSN", "234 56 7891")]),
    ("Paid by 5555-5555-5555-4444 twice, never by 5555-5555-5555-4445.", [("CREDIT_CARD", "5555-5555-5555-4444")]),
    ("Not numbers of a person: 000-45-6789, 666-45-6789, 912-45-6789, 123-00-6789.", []),
    ("Deliver to 14 Old Mill Road, unit 7B, AUSTIN, TX 78701 please.", [("STREET_ADDRESS", "14 Old Mill Road"), ("ADDRESS_UNIT", "unit 7B"), ("CITY_STATE_ZIP", "AUSTIN, TX 78701")]),
    ("Employer 12-3456789 keeps Q***-**-4321 on file, ***-**-4321 without a letter before it isn't.", [("US_TAX_ID", "12-3456789"), ("US_SSN", "***-**-4321")]),
    ("Chapter 12, 1999-2003, sums 12.50 and 3,400, code 90210.", []),
    ("Routing 011000015 is good, routing 011000016 isn't.", [("US_BANK_NUMBER", "011000015")]),
    ("Overseas: +49 30 1234 5678 but not +12 3456 7890 1234 5678.", [("PHONE_NUMBER", "+49 30 1234 5678")]),
    ("DE89370400440532013000 is one, DE88370400440532013000 and QQ89370400440532013000 are none.", [("IBAN_CODE", "DE89370400440532013000")]),
    ("acct no: 1200 3400 5600, ticket 77889.", [("ACCOUNT_NUMBER", "1200 3400 5600")]),
    ("ñrosa@y.net xx-xx-777 Z***-**-1234", [("EMAIL_ADDRESS", "rosa@y.net"), ("US_SSN", "xx-xx-777"), ("US_SSN", "***-**-1234")]),
    ("", []),
    (None, []),
]


def test_findings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {i: [] for i in range(len(CASES))}
    for r in R.scan(df, "doc_id").collect():
        assert CASES[r.doc_id][0][r.start : r.end] == r.value
        got[r.doc_id].append((r.category, r.value))
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_redacted_text_has_no_finding_left(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    clean = df.select("doc_id", S.redact(F.col("text"), S.merge_array(R.structured(F.col("text")))).alias("text"))
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert rows[0] == "Write to REDACTED or ring REDACTED; her number is REDACTED." and rows[11] == "" and rows[12] is None
    assert R.scan(clean, "doc_id").count() == 0


@pytest.mark.parametrize("name", list(R.RECOGNIZERS))
def test_needs_is_necessary(spark, name):
    """The cheap pattern never hides a match."""
    r = R.RECOGNIZERS[name]
    texts = [t for t, _ in CASES if t]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(F.col("text").rlike(r.pattern) & ~F.col("text").rlike(r.needs or "")).count() == 0
