"""Typesetting text blocks: encodable text, word wrap by glyph widths, lines on pages."""

from __future__ import annotations

import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_WIDTH, PAGE_HEIGHT, MARGIN = 612.0, 792.0, 54.0

#: Style of each kind of block (font size, line height, space before, space after).
STYLES = {
    "title": (20.0, 25.0, 8.0, 10.0), "heading": (14.0, 18.0, 9.0, 5.0), "list": (10.5, 14.0, 1.0, 3.0),
    "table": (9.5, 13.0, 2.0, 4.0), "space": (10.5, 14.0, 0.0, 9.0), "body": (10.5, 14.0, 1.0, 6.0),
}

#: Helvetica advance widths, in thousandths of the font size, by width.
_HELVETICA = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jckvxyzs",
    556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
WIDTHS = {c: w for w, chars in _HELVETICA.items() for c in chars}
DEFAULT_WIDTH = 556


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function does."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain_characters(c: Column) -> Column:
    """Dashes, quotes, ellipses, bullets and no-break spaces as plain characters; tabs as four spaces."""
    c = F.translate(c, "‐‑‒–—―‘’‚‛“”„‟•◦▪ ", "------''''\"\"\"\"*** ")
    return F.regexp_replace(F.regexp_replace(c, "…", "..."), "\t", "    ")


def encodable(c: Column, compose: bool = True) -> Column:
    """Text that a Latin standard font can show; anything else becomes a question mark."""
    return F.regexp_replace(plain_characters(nfkc(c) if compose else c), "[^\\x20-\\x7E\\u00A1-\\u00FF]", "?")


def text_width(c: Column) -> Column:
    """Width at font size 1: the sum of advance widths."""
    widths = F.create_map(*[F.lit(x) for x in chain.from_iterable(WIDTHS.items())])
    each = F.transform(F.split(c, ""), lambda ch: F.when(ch == "", 0).otherwise(F.coalesce(F.try_element_at(widths, ch), F.lit(DEFAULT_WIDTH))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) / F.lit(1000.0)


def wrap(text: Column, size: Column, width: float = PAGE_WIDTH - 2 * MARGIN, char: float | None = None) -> Column:
    """Lines of at most ``width``: words are taken greedily, words wider than a line are cut by characters.

    Widths add up, so a line's width is carried instead of measured again.  ``char`` is a fixed advance
    instead of the font's.
    """
    measure = (lambda c: F.length(c) * F.lit(char)) if char is not None else text_width
    most = F.lit(width) / size

    def cut(token: Column) -> Column:
        start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, ch: Column) -> Column:
            longer = F.concat(a["cur"], ch)
            over = (a["cur"] != "") & (measure(longer) > most)
            return F.when(over, F.struct(ch.alias("cur"), F.concat(a["out"], F.array(a["cur"])).alias("out"))).otherwise(F.struct(longer.alias("cur"), a["out"].alias("out")))

        chars = F.filter(F.split(token, ""), lambda ch: ch != "")
        return F.aggregate(chars, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))

    words = F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != "")
    tokens = F.flatten(F.transform(words, lambda w: F.when(measure(w) <= most, F.array(w)).otherwise(cut(w))))
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        longer = F.when(a["cur"] == "", t).otherwise(F.concat_ws(" ", a["cur"], t))
        over = (a["cur"] != "") & (measure(longer) > most)
        return F.when(over, F.struct(t.alias("cur"), F.concat(a["out"], F.array(a["cur"])).alias("out"))).otherwise(F.struct(longer.alias("cur"), a["out"].alias("out")))

    return F.aggregate(tokens, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def style(kind: Column, i: int) -> Column:
    out = F.lit(STYLES["body"][i])
    for name, values in STYLES.items():
        out = F.when(kind == name, F.lit(values[i])).otherwise(out)
    return out


def page_layout(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """(key, block order, page, y) of each non-empty block from (key, order, kind, n_lines).

    One fold per document over its blocks: a block that doesn't fit starts a new page; a
    blank one only moves down.  ``y`` is where its first line's top stands.
    """
    kind = F.col("kind")
    b = F.struct(F.col(order).alias("i"), F.when(kind == "space", 0).otherwise(F.col("n_lines")).alias("n"), style(kind, 1).alias("line"), style(kind, 2).alias("before"), style(kind, 3).alias("after"))
    per = blocks.groupBy(key).agg(F.array_sort(F.collect_list(b)).alias("bs"))
    out_kind = "array<struct<i:int,page:int,y:double>>"
    start = F.struct(F.lit(1).alias("page"), F.lit(PAGE_HEIGHT - MARGIN).alias("y"), F.array().cast(out_kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        turn = a["y"] - (x["before"] + x["n"] * x["line"] + x["after"]) < MARGIN
        page = F.when(turn, a["page"] + 1).otherwise(a["page"])
        top = F.when(turn, F.lit(PAGE_HEIGHT - MARGIN)).otherwise(a["y"]) - x["before"]
        placed = F.struct(x["i"].cast("int").alias("i"), page.cast("int").alias("page"), top.alias("y"))
        down = F.struct(page.cast("int").alias("page"), (top - x["n"] * x["line"] - x["after"]).alias("y"), F.concat(a["out"], F.array(placed)).cast(out_kind).alias("out"))
        blank = F.struct(a["page"].alias("page"), (a["y"] - x["after"]).alias("y"), a["out"].alias("out"))
        return F.when(x["n"] == 0, blank).otherwise(down)

    return per.select(key, F.explode(F.aggregate("bs", start, step, lambda a: a["out"])).alias("o")).select(key, F.col("o.i").alias(order), "o.page", "o.y")
