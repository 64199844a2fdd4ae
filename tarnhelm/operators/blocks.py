"""Findings to blocks on pages, and lists of blocks without spatial doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.operators import geometry as G

BLOCK_CAP = 200
OVERLAP_AT = 0.6


def span_rects(findings: DataFrame, segments: DataFrame, *keys: str) -> DataFrame:
    """Interval join: each finding with the segments it overlaps, and the rectangle of what they share.

    Equality on the page keeps it an ordinary equi-join with the overlap as residual condition.
    """
    f, s = findings.alias("f"), segments.alias("s")
    on = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("s.end") > F.col("f.start"), F.col("s.start") < F.col("f.end")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    n = (F.col("s.end") - F.col("s.start")).cast("double")
    part = lambda p: G.fraction(F.greatest(F.lit(0), F.least(p, F.col("s.end")) - F.col("s.start")).cast("double"), n)
    joined = f.join(s, cond).select(
        "f.*", "s.seg_idx", F.col("s.height").alias("seg_height"), F.col("s.transform").alias("_m"), F.col("s.width").alias("_w"), F.col("s.dir").alias("_d"),
        part(F.greatest(F.col("f.start"), F.col("s.start"))).alias("_from"), part(F.least(F.col("f.end"), F.col("s.end"))).alias("_to"),
    )
    rect = G.range_rect(F.col("_m"), F.col("_w"), F.col("seg_height"), F.col("_d"), F.col("_from"), F.col("_to"))
    # A generator of one row: the filter below then reads the rectangle instead of computing its own four times.
    out = joined.select("*", F.explode(F.array(rect)).alias("rect")).drop("_m", "_w", "_d", "_from", "_to")
    return out.where("rect.x1 > rect.x0 AND rect.y1 > rect.y0")


def finding_blocks(findings: DataFrame, segments: DataFrame, *keys: str) -> DataFrame:
    """One block per finding: rectangles in segment order, the largest as label, its segment's height as font size."""
    rects = span_rects(findings, segments, *keys)
    own = [*keys, "start", "end", "category", "confidence", "source"]
    r = F.struct("seg_idx", "rect", "seg_height")
    per = rects.groupBy(*own).agg(F.array_sort(F.collect_list(r)).alias("rs"))
    areas = F.transform("rs", lambda x: G.area(x["rect"]))
    label = (F.array_position(areas, F.array_max(areas)) - 1).cast("int")  # the first of the largest
    per = per.withColumn("label_rect_index", label)
    size = F.element_at("rs", F.col("label_rect_index") + 1)["seg_height"]
    ident = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in (*keys, "start", "end", "category")]), 256)
    return per.select(
        *keys, ident.alias("id"), "start", "end", F.transform("rs", lambda x: x["rect"]).alias("rects"), "label_rect_index",
        F.when(size > 0, size).alias("source_font_size"), F.lit("REDACTED").alias("replacement"), F.lit("text-replacement").alias("appearance"),
        F.struct("category", "confidence", "source").alias("suggestion"),
    )


def overlaps(candidate: Column, block: Column, at: float = OVERLAP_AT) -> Column:
    """Whether any rectangle of a block covers more than ``at`` of any of the candidate's; (page_index, rects) of one page."""
    def covers(r: Column, c: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(r["x1"], c["x1"]) - F.greatest(r["x0"], c["x0"]))
        h = F.greatest(F.lit(0.0), F.least(r["y1"], c["y1"]) - F.greatest(r["y0"], c["y0"]))
        return w * h / F.greatest(F.lit(1.0), G.area(c)) > at

    return (candidate["page_index"] == block["page_index"]) & F.exists(block["rects"], lambda r: F.exists(candidate["rects"], lambda c: covers(r, c)))


def merge_suggestions(blocks: DataFrame, key: str, cap: int = BLOCK_CAP) -> DataFrame:
    """Per document, existing blocks and those suggestions that overlap none kept before, up to ``cap`` blocks.

    ``blocks``: key, seq, existing, id, page_index, rects.  The fold's list is bounded by the cap, and
    existing blocks always stay.  Output: key, id, added.
    """
    b = F.struct((~F.col("existing")).alias("new"), "seq", "id", "page_index", "rects")
    per = blocks.groupBy(key).agg(F.array_sort(F.collect_list(b)).alias("bs"))
    kind = blocks.select(F.array(b).alias("b")).schema["b"].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        drop = x["new"] & ((F.size(acc) >= cap) | F.exists(acc, lambda k: overlaps(x, k)))
        return F.when(drop, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("bs", F.array().cast(kind), lambda a, x: step(a, x).cast(kind))
    return per.select(key, F.explode(kept).alias("b")).select(key, "b.id", F.col("b.new").alias("added"))


def page_cutoff(pages: DataFrame, key: str, order: str, n: str, existing: int = 0, cap: int = BLOCK_CAP) -> DataFrame:
    """Pages that are scanned: those before which fewer than ``cap`` blocks have come up."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.where("true").withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)) + existing).where(F.col("before") < cap)


def font_size_vote(spans: DataFrame, rects: DataFrame, key: str) -> DataFrame:
    """Per selection, the font size with most overlapped area that fits the largest rectangle.

    ``spans``: key, font_size, left, top, right, bottom; ``rects``: key, rect_idx and the same box.
    """
    a, b = spans.alias("a"), rects.alias("b")
    shared = F.greatest(F.lit(0.0), F.least("a.right", "b.right") - F.greatest("a.left", "b.left")) * F.greatest(F.lit(0.0), F.least("a.bottom", "b.bottom") - F.greatest("a.top", "b.top"))
    votes = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), F.round("a.font_size", 3).alias("size"), shared.alias("score"))
    votes = votes.where("score > 0 AND size > 0").groupBy(key, "size").agg(F.sum("score").alias("score"))
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    room = rects.groupBy(key).agg(F.max_by(F.least(w, h), F.struct(w * h, -F.col("rect_idx"))).alias("room"))
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "size")
    return votes.join(room, key).where("size <= room").withColumn("_n", F.row_number().over(best)).where("_n = 1").select(key, "size")


def scan_notice(n: Column, model_available: Column, without_text: Column) -> Column:
    """The summary line of a scan."""
    plural = lambda c, one, many: F.when(c == 1, one).otherwise(many)
    tail = F.concat(
        F.when(model_available, "").otherwise(" The contextual model was unavailable, so only structured patterns were used."),
        F.when(without_text > 0, F.concat(F.lit(" "), without_text.cast("string"), plural(without_text, " page needs", " pages need"), F.lit(" manual area review because no searchable text was found."))).otherwise(""),
    )
    head = F.when(n > 0, F.concat(n.cast("string"), plural(n, " suggestion", " suggestions"), F.lit(" added to the review queue."))).otherwise("No new sensitive-data suggestions were found.")
    return F.concat(head, tail)
