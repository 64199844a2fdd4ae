"""Matches with offsets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def match_spans(text: Column, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches: (start, end, value) of the given group, which must end its match.

    ``split`` and ``regexp_extract_all`` cut the text into alternating gaps and matches; one fold
    carries the offset.  Offsets are code points.  ``needs`` is a cheap pattern without which
    there can be no match, so most texts skip the two passes.
    """
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matched
    pairs = F.zip_with(matched, values, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    pieces = F.zip_with(F.split(text, pattern, -1), pairs, lambda g, p: F.struct(F.length(g).alias("g"), F.length(p["m"]).alias("n"), p["v"].alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = (a["at"] + x["g"] + x["n"]).cast("int")
        span = F.struct((end - F.length(x["v"])).cast("int").alias("start"), end.alias("end"), x["v"].alias("value"))
        return F.when(x["v"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    found = F.aggregate(pieces, start, step, lambda a: a["out"])
    none = F.array().cast(SPAN)
    return F.when(text.rlike(needs) if needs else text.isNotNull(), found).otherwise(none)
