"""Deterministic recognisers: one text column in, an array of findings out, in one projection.

A finding is (start, ord, end, category, confidence, source, value); ``ord`` is the recogniser's place, so
natural order is by start and then by declaration.  A value that fails its check is dropped
and the text it covered isn't searched again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnhelm.functions import checks
from tarnhelm.functions.regexes import LETTER_I, WORD_I, WS, WS_CHARS, any_case, any_of, edge
from tarnhelm.functions.spans import match_spans

#: Street suffixes and USPS codes of the states and DC.
STREET_SUFFIXES = "STREET ST AVENUE AVE ROAD RD BOULEVARD BLVD LANE LN DRIVE DR COURT CT PLACE PL PARKWAY PKWY HIGHWAY HWY".split()
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT "
    "VA WA WV WI WY DC"
).split()

FINDING = "array<struct<start:int,ord:int,end:int,category:string,confidence:double,source:string,value:string>>"

_B, _BI = edge(), edge(WORD_I)
#: The same before and after a word character, where half of the test is enough.
_BEFORE, _AFTER = f"(?<![{WORD_I}])", f"(?![{WORD_I}])"
_SEP = f"[{WS_CHARS}.-]"
_PHONE_SEP = f"[{WS_CHARS}().-]"
_CITY = "[A-Z][A-Z.'-]{1,20}"
_ACCOUNT = (
    f"{_BEFORE}{any_of(['account', 'acct', 'routing'])}{WS}*(?:{any_case('number')}|{any_case('no')}\\.?|#)?{WS}*[:#-]?{WS}*([0-9][0-9 -]{{3,20}}[0-9]){_AFTER}"
)
_UNIT_WORD = any_of(["APT", "APARTMENT", "UNIT", "SUITE", "STE"])
_UNIT = f"{_BEFORE}{_UNIT_WORD}{WS}+[#{LETTER_I}0-9-]{{1,10}}{_BI}"


@dataclass(frozen=True)
class Recognizer:
    category: str
    confidence: float
    pattern: str
    valid: Callable[[Column], Column] | None = None
    #: Without a match of this there can be none of ``pattern``.
    needs: str | None = None
    group: int = 0
    #: Chosen by the whole match instead of ``category``: (pattern of the match, category, check).
    special: tuple[str, str, Callable[[Column], Column]] | None = None


RECOGNIZERS: dict[str, Recognizer] = {
    "account": Recognizer("ACCOUNT_NUMBER", 0.96, _ACCOUNT, lambda v: checks.digit_count_between(v, 4, 17), "[0-9][0-9 -]{3,20}[0-9]", 1),
    "email": Recognizer("EMAIL_ADDRESS", 0.99, f"{_BI}[{LETTER_I}0-9._%+-]+@[{LETTER_I}0-9.-]+\\.[{LETTER_I}]{{2,}}{_BI}", needs="@"),
    "ssn": Recognizer("US_SSN", 0.99, f"{_B}[0-9]{{3}}[- ]?[0-9]{{2}}[- ]?[0-9]{{4}}{_B}", checks.ssn_valid, "[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}"),
    "ssn_masked": Recognizer("US_SSN", 0.96, f"{_BI}(?:[Xx]{{2,3}}|\\*{{2,3}})[- ]?(?:[Xx]{{2}}|\\*{{2}})[- ]?[0-9]{{3,4}}{_BI}", needs="[Xx*]{2}[- ]?[0-9]{3}"),
    "tax_id": Recognizer("US_TAX_ID", 0.98, "(?<![0-9])[0-9]{2}-[0-9]{7}(?![0-9])", needs="-[0-9]{7}"),
    "street": Recognizer(
        "STREET_ADDRESS", 0.97, f"{_BI}[0-9]{{1,6}}{WS}+(?:[{LETTER_I}0-9][{LETTER_I}0-9.'-]*{WS}+){{1,5}}{any_of(STREET_SUFFIXES)}{_BI}", needs=f"[0-9]{WS}+[{LETTER_I}0-9]",
    ),
    "unit": Recognizer("ADDRESS_UNIT", 0.96, _UNIT, needs=f"{_UNIT_WORD}{WS}"),
    "city": Recognizer(
        "CITY_STATE_ZIP", 0.97, f"{_B}{_CITY}(?:{WS}+{_CITY}){{0,2}},?{WS}+{any_of(STATES, False)}{WS}+[0-9]{{5}}(?:-[0-9]{{4}})?{_B}", needs=f"[A-Z]{{2}}{WS}+[0-9]{{5}}",
    ),
    "phone": Recognizer(
        "PHONE_NUMBER", 0.97,
        f"(?<![0-9+])(?:(?:\\+?1{_SEP}?)?(?:\\([0-9]{{3}}\\)|[0-9]{{3}}){_SEP}[0-9]{{3}}{_SEP}[0-9]{{4}}|\\+(?:[0-9]{_PHONE_SEP}?){{7,14}}[0-9])(?!{_PHONE_SEP}?[0-9])",
        lambda v: checks.digit_count_between(v, 10, 15), "[0-9]{2}",
    ),
    "card": Recognizer("CREDIT_CARD", 0.99, "(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", checks.luhn_valid, "[0-9](?:[ -]?[0-9]){12}"),
    "iban": Recognizer("IBAN_CODE", 0.98, f"{_B}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}{_B}", checks.iban_valid, "[A-Z]{2}[0-9]{2}"),
}


def candidates(text: Column, name: str) -> Column:
    """Matches before any check."""
    r = RECOGNIZERS[name]
    return match_spans(text, r.pattern, r.group, r.needs)


def findings_of(text: Column, name: str) -> Column:
    """One recogniser's findings."""
    r, place = RECOGNIZERS[name], list(RECOGNIZERS).index(name)

    def finding(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.lit(place).alias("ord"), s["end"].alias("end"), F.lit(r.category).alias("category"),
            F.lit(r.confidence).alias("confidence"), F.lit("recognizer").alias("source"), s["value"].alias("value"),
        )

    spans = candidates(text, name)
    if name == "account":
        return _account_findings(text, place, r)
    return F.transform(F.filter(spans, lambda s: r.valid(s["value"])) if r.valid else spans, finding)


def _account_findings(text: Column, place: int, r: Recognizer) -> Column:
    """Account numbers; after the word ``routing`` only valid routing numbers, under their own category."""
    plain = match_spans(text, r.pattern, 1, r.needs)
    whole = F.when(text.rlike(r.needs), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    routing = F.transform(whole, lambda m: m.rlike("(?iu)routing"))
    both = F.zip_with(plain, routing, lambda s, k: F.struct(s.alias("s"), k.alias("routing")))
    ok = F.filter(both, lambda x: r.valid(x["s"]["value"]) & (~x["routing"] | checks.aba_valid(x["s"]["value"])))
    return F.transform(ok, lambda x: F.struct(
        x["s"]["start"].alias("start"), F.lit(place).alias("ord"), x["s"]["end"].alias("end"),
        F.when(x["routing"], F.lit("US_BANK_NUMBER")).otherwise(F.lit(r.category)).alias("category"),
        F.lit(r.confidence).alias("confidence"), F.lit("recognizer").alias("source"), x["s"]["value"].alias("value"),
    ))


def structured(text: Column, names: list[str] | None = None) -> Column:
    """All findings of a text, by start and then by recogniser."""
    parts = [findings_of(text, n).cast(FINDING) for n in names or RECOGNIZERS]
    return F.when(text.isNull(), F.array().cast(FINDING)).otherwise(F.array_sort(F.flatten(F.array(*parts))))


def scan(docs: DataFrame, *keys: str, names: list[str] | None = None) -> DataFrame:
    """``keys`` and one row per structured finding; a projection and a generator, no shuffle."""
    return docs.select(*keys, F.explode(structured(F.col("text"), names)).alias("f")).select(*keys, "f.*")
