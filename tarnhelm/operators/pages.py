"""Positioned text items to page text with offsets; gates on searchable characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.functions.regexes import WS


def assemble(items: DataFrame, *keys: str, order: str = "item_idx") -> DataFrame:
    """Each non-empty item with its separator and half-open offsets in its page's text.

    Between items stands a line end if the one before ends its line, nothing if white space is there
    already, else a space.  Empty items are out before they could end a line.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    df = items.where(F.length("str") > 0)
    before = F.lag("str").over(w)
    blank = F.coalesce(before.rlike(f"{WS}$"), F.lit(False)) | F.col("str").rlike(f"^{WS}")
    sep = F.when(before.isNull(), "").when(F.lag("has_eol").over(w), "\n").when(blank, "").otherwise(" ")
    df = df.withColumn("sep", sep)
    upto = F.sum(F.length("sep") + F.length("str")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("end", upto.cast("int")).withColumn("start", (F.col("end") - F.length("str")).cast("int"))


def page_text(assembled: DataFrame, *keys: str, order: str = "item_idx") -> DataFrame:
    piece = F.struct(F.col(order).alias("i"), F.concat("sep", "str").alias("t"))
    return assembled.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "").alias("text"))


def searchable(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(c, WS, ""))


def needs_recognition(items: DataFrame, *keys: str, least: int = 16) -> DataFrame:
    """Pages with fewer searchable characters than that are scans."""
    per = items.groupBy(*keys).agg(F.sum(searchable(F.col("str"))).cast("long").alias("n_searchable"))
    return per.withColumn("scan", F.col("n_searchable") < least)
