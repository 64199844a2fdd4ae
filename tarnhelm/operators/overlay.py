"""Carrying out redactions: what is drawn over a page, what text goes, which images shrink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.operators.validation import normalized, shared_area

LABEL = "REDACTED"


def number(c: Column) -> Column:
    """At most four decimals, without trailing zeros, never minus zero."""
    fixed = F.format_string("%.4f", F.when(F.abs(c) < 1e-6, 0.0).otherwise(c))
    trimmed = F.regexp_replace(fixed, "\\.?0+$", "")
    return F.when(trimmed == "-0", "0").otherwise(trimmed)


def label_geometry(rect: Column, font_size: Column, label_width: float) -> tuple[Column, Column, Column]:
    """(font size, x, y) of the label in its rectangle; ``label_width`` is the label's width at size 1."""
    w, h = rect["x1"] - rect["x0"], rect["y1"] - rect["y0"]
    size = F.greatest(F.lit(0.5), F.least(F.coalesce(font_size, h * 0.72), h * 0.72, F.greatest(F.lit(0.5), w - 2) / label_width))
    x = rect["x0"] + F.greatest(F.lit(1.0), (w - size * label_width) / 2)
    y = rect["y0"] + F.greatest(F.lit(0.0), (h - size) / 2) + size * 0.16
    return size, x, y


def overlay(blocks: DataFrame, *keys: str, order: str = "block_seq", font: str = "Label1", label_width: float = 5.56) -> DataFrame:
    """Per page, one command stream: white boxes over every rectangle, then one label per block.

    A label index beyond the rectangles means the first.
    """
    rects = F.transform("rects", normalized)
    fills = F.transform(rects, lambda r: F.concat_ws(" ", number(r["x0"]), number(r["y0"]), number(r["x1"] - r["x0"]), number(r["y1"] - r["y0"]), F.lit("re f")))
    label = F.coalesce(F.get(rects, F.col("label_rect_index")), F.get(rects, F.lit(0)))
    size, x, y = label_geometry(label, F.col("source_font_size"), label_width)
    text = F.concat(F.lit(f"BT /{font} "), number(size), F.lit(" Tf 1 0 0 1 "), number(x), F.lit(" "), number(y), F.lit(f" Tm ({LABEL}) Tj ET"))
    per = blocks.select(*keys, F.col(order).alias("i"), fills.alias("fills"), text.alias("label")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "fills", "label"))).alias("bs"))
    lines = F.concat(
        F.array(F.lit("q"), F.lit("1 g")), F.flatten(F.transform("bs", lambda b: b["fills"])), F.array(F.lit("Q"), F.lit("0 g")), F.transform("bs", lambda b: b["label"])
    )
    return per.select(*keys, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("overlay"))


def free_name(used: DataFrame, key: str, name: str, prefix: str = "Label") -> DataFrame:
    """Each key's first unused prefix + number."""
    n = F.regexp_extract(name, f"^{prefix}([1-9][0-9]*)$", 1)
    taken = used.groupBy(key).agg(F.collect_set(F.when(n != "", n.cast("int"))).alias("ns"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("ns") + 1), F.col("ns")))
    return taken.select(key, F.concat(F.lit(prefix), free.cast("string")).alias("free"))


def remove_text(segments: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """Segments that no block rectangle of their page touches: an anti-join with the overlap as condition."""
    r = blocks.select(*keys, F.explode("rects").alias("_r")).alias("b")
    s = segments.alias("s")
    cond = shared_area(F.col("s.rect"), normalized(F.col("b._r"))) > 0
    for k in keys:
        cond = cond & (F.col(f"s.{k}") == F.col(f"b.{k}"))
    return s.join(r, cond, "left_anti")


def recompressible(images: DataFrame, least_pixels: int = 750_000) -> DataFrame:
    """Images worth recompressing: one lossless filter, no mask, no alpha, large; each object once."""
    w = Window.partitionBy("doc_id", "object_number").orderBy("image_idx")
    ok = (F.col("filters") == F.array(F.lit("FlateDecode"))) & ~F.col("has_mask") & ~F.col("has_alpha") & (F.col("width") * F.col("height") >= least_pixels)
    return images.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & ok).drop("_n")


def to_page_space(rect: Column, matrix: Column) -> Column:
    """The bound of a rectangle under an affine matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (matrix[i] for i in range(6))
    points = [(rect[x], rect[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [a * x + c * y + e for x, y in points], [b * x + d * y + f for x, y in points]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def inverse(matrix: Column) -> Column:
    a, b, c, d, e, f = (matrix[i] for i in range(6))
    det = a * d - b * c
    return F.array(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)


#: Columns of an export; whatever else a page carries (annotations, metadata) isn't named and so isn't there.
EXPORT = ("doc_id", "page_index", "text", "overlay")


def export(pages: DataFrame) -> DataFrame:
    return pages.select(*EXPORT)
