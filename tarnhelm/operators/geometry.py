"""Rectangles of text spans, and of what is drawn over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(index: Column, length: Column) -> Column:
    """How far along a text a character stands, with even widths."""
    return F.when(index <= 0, 0.0).when(index >= length, 1.0).otherwise(index / length)


def measured_fraction(text: Column, index: Column, widths: Column) -> Column:
    """The same by a map of glyph widths (1 where the map has none)."""
    each = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0.0).otherwise(F.coalesce(F.try_element_at(widths, c), F.lit(1.0))))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    part = F.aggregate(F.slice(each, 1, F.greatest(index, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(index <= 0, 0.0).when(index >= F.length(text), 1.0).when(total <= 0, index / F.length(text)).otherwise(part / total)


def range_rect(transform: Column, width: Column, height: Column, direction: Column, start: Column, end: Column) -> Column:
    """Axis-parallel bound of a stretch of a text item, ``start`` and ``end`` as fractions of its width.

    The baseline follows the transform's first column; the stretch is padded and reaches from a
    descent of .22 to an ascent of .9 of the larger of height and scale.
    """
    a, b, x, y = transform[0], transform[1], transform[4], transform[5]
    size = F.hypot(a, b)
    scale = F.when(size == 0, 1.0).otherwise(size)
    ux, uy = a / scale, b / scale
    h = F.greatest(height, scale)
    rtl = direction == "rtl"
    f, t = F.when(rtl, 1 - end).otherwise(start), F.when(rtl, 1 - start).otherwise(end)
    pad = F.greatest(F.lit(0.5), h * 0.12)
    xs = [x + ux * width * k - uy * h * v for k in (f, t) for v in (-0.22, 0.9)]
    ys = [y + uy * width * k + ux * h * v for k in (f, t) for v in (-0.22, 0.9)]
    return F.struct(
        (F.least(*xs) - pad).alias("x0"), (F.least(*ys) - pad).alias("y0"), (F.greatest(*xs) + pad).alias("x1"), (F.greatest(*ys) + pad).alias("y1")
    )


def area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def bounding(rects: Column) -> Column:
    """The least rectangle around all of an array."""
    low = lambda n: F.array_min(F.transform(rects, lambda r: r[n]))
    high = lambda n: F.array_max(F.transform(rects, lambda r: r[n]))
    return F.struct(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))


def to_screen(r: Column, scale: Column, page_height: Column) -> Column:
    """Page points (y up) to screen pixels (y down) as left, top, width, height."""
    return F.struct(
        (F.least(r["x0"], r["x1"]) * scale).alias("left"), ((page_height - F.greatest(r["y0"], r["y1"])) * scale).alias("top"),
        (F.abs(r["x1"] - r["x0"]) * scale).alias("width"), (F.abs(r["y1"] - r["y0"]) * scale).alias("height"),
    )


def merge_lines(rects: Column) -> Column:
    """Rectangles (left, top, right, bottom) of one selection, joined along lines: by top and left, each with the
    last merged one if they share .7 of the lower one's height and the gap is 5 or less."""
    kind = "array<struct<left:double,top:double,right:double,bottom:double>>"
    order = F.array_sort(F.transform(rects, lambda r: F.struct(r["top"].alias("top"), r["left"].alias("left"), r["right"].alias("right"), r["bottom"].alias("bottom"))))

    def step(acc: Column, r: Column) -> Column:
        p = F.try_element_at(acc, F.lit(-1))
        least = F.least(p["bottom"] - p["top"], r["bottom"] - r["top"])
        shared = F.least(p["bottom"], r["bottom"]) - F.greatest(p["top"], r["top"])
        joins = (least > 0) & (shared >= 0.7 * least) & (r["left"] - p["right"] <= 5)
        wide = F.struct(F.least(p["left"], r["left"]).alias("left"), F.least(p["top"], r["top"]).alias("top"), F.greatest(p["right"], r["right"]).alias("right"), F.greatest(p["bottom"], r["bottom"]).alias("bottom"))
        own = F.struct(r["left"].alias("left"), r["top"].alias("top"), r["right"].alias("right"), r["bottom"].alias("bottom"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide))).otherwise(F.concat(acc, F.array(own)))

    return F.aggregate(order, F.array().cast(kind), lambda a, r: step(a, r).cast(kind))


def preview_scale(width: Column, height: Column, ratio: Column) -> Column:
    """Output scale of a preview: device ratio 2, 4096 pixels a side and 4 megapixels at most; 1 for invalid sizes."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) & (c > 0)
    asked = F.when(ok(ratio), F.least(ratio, F.lit(2.0))).otherwise(1.0)
    scale = F.least(asked, F.lit(4096.0) / width, F.lit(4096.0) / height, F.sqrt(F.lit(4e6) / (width * height)))
    return F.when(ok(width) & ok(height), scale).otherwise(1.0)


def failure_class(name: Column, message: Column) -> tuple[Column, Column]:
    """(code, detail) of a rendering failure."""
    text = F.substring(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), "\\s+", " ")), 1, 180)
    limit = F.concat_ws(" ", name, text).rlike("(?i)canvas|memory|allocation|surface|dimension|size|area|context")
    return F.when(limit, "PREVIEW_CANVAS_LIMIT").otherwise("PREVIEW_RENDER"), F.when(text != "", F.concat_ws(": ", name, text)).otherwise(name)


def is_cancellation(name: Column, message: Column) -> Column:
    return name.isin("RenderingCancelledException", "AbortException") | message.rlike("(?i)cancel(?:led|ed|lation)")


def label_style(width: Column, height: Column, font_size: Column, view: Column, em: float) -> tuple[Column, Column, Column]:
    """(font size, vertical?, horizontal scale) of a replacement label in a screen rectangle."""
    vertical = height > width
    along, across = F.greatest(width, height), F.least(width, height)
    fitted = F.greatest(F.lit(4.0), F.least(F.lit(10.0), along * 0.9 / 6, across / 1.25))
    size = F.when(font_size.isNull(), fitted).otherwise(font_size * view)
    squeeze = F.when(font_size.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.05), along * 0.9 / (size * em))))
    return size, vertical, squeeze
