"""Validity of matched values: digits, checksums, registered lengths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnhelm.functions.regexes import WS

#: Registered IBAN lengths by country.
IBAN_LENGTHS = dict(
    (x[:2], int(x[2:]))
    for x in """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27
    GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
    MK19 MN20 MR27 MT31 MU30 NI32 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28
    TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30
    """.split()
)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def digit_count_between(c: Column, low: int, high: int) -> Column:
    return F.length(digits(c)).between(low, high)


def ssn_valid(c: Column) -> Column:
    """Nine digits; area not 000, 666 or 900 and up; group not 00; serial not 0000."""
    d = digits(c)
    area = F.substring(d, 1, 3)
    return (
        (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    )


def luhn_valid(c: Column) -> Column:
    """13 to 19 digits, not all the same, whose Luhn sum is a multiple of ten."""
    d = digits(c)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, 1, 19).substr(n - i, F.lit(1)).cast("int")
        twice = v * 2
        return total + F.when(i % 2 == 0, v).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return F.when(n.between(13, 19) & ~d.rlike("^([0-9])\\1+$"), total % 10 == 0).otherwise(F.lit(False))


def iban_valid(c: Column) -> Column:
    """The country's registered length, and remainder 1 of the rearranged number modulo 97."""
    v = F.upper(F.regexp_replace(c, WS, ""))
    lengths = F.create_map(*[F.lit(x) for x in chain.from_iterable(IBAN_LENGTHS.items())])
    turned = F.concat(v.substr(5, 1000), v.substr(1, 4))

    def add(r: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), (r * 10 + ch.cast("int")) % 97).when(ch == "", r).otherwise((r * 100 + F.ascii(ch) - 55) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), add)
    return F.when(F.try_element_at(lengths, F.substring(v, 1, 2)) == F.length(v), rest == 1).otherwise(F.lit(False))


def aba_valid(c: Column) -> Column:
    """Nine digits whose sum with weights 3, 7, 1 is a multiple of ten."""
    d = digits(c)
    total = sum((F.substring(d, i + 1, 1).cast("int") * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0))
    return F.when(F.length(d) == 9, total % 10 == 0).otherwise(F.lit(False))
