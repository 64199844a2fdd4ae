"""Rules for rectangles, blocks and manifests; violations are listed, not thrown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def rect_valid(r: Column) -> Column:
    """Four finite numbers and a positive area."""
    return F.coalesce(finite(r["x0"]) & finite(r["y0"]) & finite(r["x1"]) & finite(r["y1"]) & (r["x1"] > r["x0"]) & (r["y1"] > r["y0"]), F.lit(False))


def normalized(r: Column) -> Column:
    return F.struct(F.least(r["x0"], r["x1"]).alias("x0"), F.least(r["y0"], r["y1"]).alias("y0"), F.greatest(r["x0"], r["x1"]).alias("x1"), F.greatest(r["y0"], r["y1"]).alias("y1"))


def shared_area(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def rect_error(r: Column, page: Column) -> Column:
    """Why a rectangle can't be applied to a page; null if it can."""
    n = normalized(r)
    return F.when(~rect_valid(n), "invalid").when(shared_area(n, page) <= 0, "outside its page")


def block_violations(b: DataFrame) -> Column:
    """Names of the rules that a block breaks."""
    rules = {
        "id": F.length("id").between(1, 80),
        "page_index": F.col("page_index").between(0, 99),
        "rects": F.size("rects").between(1, 100) & F.forall("rects", rect_valid),
        "label_rect_index": F.col("label_rect_index") >= 0,
        "source_font_size": F.col("source_font_size").isNull() | (finite(F.col("source_font_size")) & (F.col("source_font_size") > 0) & (F.col("source_font_size") <= 512)),
        "replacement": F.col("replacement") == "REDACTED",
        "appearance": F.col("appearance") == "text-replacement",
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]))


def manifest_valid(blocks: DataFrame, key: str, most: int = 200) -> DataFrame:
    """Each document's number of blocks and whether its manifest stands: 1 to ``most`` blocks, all valid."""
    b = blocks.withColumn("_bad", F.size(block_violations(blocks)) > 0)
    return b.groupBy(key).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.col("_bad").cast("long")).alias("n_bad")).withColumn(
        "valid", F.col("n_blocks").between(1, most) & (F.col("n_bad") == 0)
    )


def missing_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks whose page isn't there."""
    return blocks.join(pages, ["doc_id", "page_index"], "left_anti")


def integrity(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Each listed file: ok, mismatch or missing."""
    found = files.select(key, F.sha2("content", 256).alias("_own"))
    status = F.when(F.col("_own").isNull(), "missing").when(F.col("_own") == F.col("sha256"), "ok").otherwise("mismatch")
    return manifest.join(found, key, "left").select(key, status.alias("status"))
