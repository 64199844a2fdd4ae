"""Span algebra: coalescing, suppression, propagation and redaction of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUPPRESS_AT = 0.65
LABEL = "REDACTED"

KEPT = "array<struct<start:int,end:int,category:string,confidence:double,source:string>>"


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over the shorter span's length."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return shared / F.greatest(F.lit(1), F.least(e1 - s1, e2 - s2))


def coalesce(findings: DataFrame, *keys: str) -> DataFrame:
    """Overlapping neighbours of one source and category become one; another one between them keeps them apart.

    ``ord`` breaks ties of (start, end).  Runs of one category and source are islands of ``lag``;
    within a run an island ends where the running end is reached.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end", "ord")
    same = (F.lag("category").over(w) == F.col("category")) & (F.lag("source").over(w) == F.col("source"))
    df = findings.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    r = Window.partitionBy(*keys, "_run").orderBy("start", "end", "ord")
    before = F.max("end").over(r.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(r))
    return df.groupBy(*keys, "_run", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("category").alias("category"), F.first("source").alias("source"),
        F.max("confidence").alias("confidence"), F.min("ord").alias("ord"),
    ).drop("_run", "_island")


def coalesce_array(found: Column) -> Column:
    """The same within one row's array, as a fold."""
    ordered = F.array_sort(F.transform(found, lambda f: F.struct(f["start"], f["end"], f["ord"], f["category"], f["confidence"], f["source"])))

    def step(acc: Column, f: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"), last["category"].alias("category"),
            F.greatest(last["confidence"], f["confidence"]).alias("confidence"), last["source"].alias("source"),
        )
        own = F.struct(f["start"].alias("start"), f["end"].alias("end"), f["category"].alias("category"), f["confidence"].alias("confidence"), f["source"].alias("source"))
        joins = (last["category"] == f["category"]) & (last["source"] == f["source"]) & (f["start"] < last["end"])
        return F.when(joins, _but_last(acc, merged)).otherwise(F.concat(acc, F.array(own)))

    # The array is named once: a second mention would compute it a second time.
    return F.aggregate(ordered, F.array().cast(KEPT), lambda a, f: step(a, f).cast(KEPT))


def _but_last(acc: Column, new: Column) -> Column:
    return F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(new))


def suppress_array(found: Column, at: float = SUPPRESS_AT) -> Column:
    """Greedy: recognisers first, then by falling confidence and start; whoever overlaps a kept one by ``at`` or more goes."""
    placed = F.transform(found, lambda f, i: F.struct(
        (f["source"] != "recognizer").alias("late"), (-f["confidence"]).alias("less"), f["start"].alias("start"), i.alias("i"), f.alias("f"),
    ))
    order = F.transform(F.array_sort(placed), lambda x: x["f"])

    def step(acc: Column, f: Column) -> Column:
        clash = F.exists(acc, lambda k: overlap_ratio(k["start"], k["end"], f["start"], f["end"]) >= at)
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(f)))

    return F.array_sort(F.aggregate(order, F.array().cast(KEPT), lambda a, f: step(a, f).cast(KEPT)))


def merge_array(found: Column) -> Column:
    """Coalesced and suppressed findings by start."""
    return suppress_array(coalesce_array(found))


def suppress(findings: DataFrame, *keys: str, at: float = SUPPRESS_AT) -> DataFrame:
    """Suppression of a findings table; a group is one text's findings."""
    f = F.struct("start", "end", "category", "confidence", "source")
    per = findings.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", f.alias("f")))), lambda x: x["f"]).alias("fs"))
    return per.select(*keys, F.explode(suppress_array(F.col("fs"), at)).alias("f")).select(*keys, "f.*")


def propagate(text: Column, found: Column) -> Column:
    """Every exact repetition of each finding's value: at least five characters with a letter or digit, no letter or digit beside it."""
    word = "^[\\p{L}\\p{N}]"

    def places(f: Column) -> Column:
        value = F.trim(text.substr(f["start"] + 1, f["end"] - f["start"]))
        n = F.length(value)
        # As many places as the value starts at, overlapping ones too; each is located from the one before.
        many = F.regexp_count(text, F.concat(F.lit("(?=\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)")))
        none = F.array().cast("array<int>")
        every = F.aggregate(F.sequence(F.lit(1), many), none, lambda acc, _: F.concat(
            acc, F.array(F.call_function("locate", value, text, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1))
        ))
        alone = F.filter(every, lambda i: ~text.substr(i - 1, F.when(i > 1, 1).otherwise(0)).rlike(word) & ~text.substr(i + n, F.lit(1)).rlike(word))
        starts = F.when((n >= 5) & value.rlike("[\\p{L}\\p{N}]") & (many > 0), F.transform(alone, lambda i: i - 1)).otherwise(none)
        return F.transform(starts, lambda i: F.struct(
            i.cast("int").alias("start"), (i + n).cast("int").alias("end"), f["category"].alias("category"), f["confidence"].alias("confidence"), f["source"].alias("source"),
        ))

    return F.array_distinct(F.concat(found.cast(KEPT), F.flatten(F.transform(found, places)).cast(KEPT)))


def union_spans(found: Column) -> Column:
    """Overlapping or touching spans of an array as maximal ones (start, end)."""
    ordered = F.array_sort(F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, f: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wide = F.struct(last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"))
        return F.when(f["start"] <= last["end"], _but_last(acc, wide)).otherwise(F.concat(acc, F.array(f)))

    return F.aggregate(ordered, F.array().cast(kind), lambda a, f: step(a, f).cast(kind))


def redact(text: Column, found: Column, label: str = LABEL) -> Column:
    """The text with every maximal span replaced by a label."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(label)).alias("out"))

    return F.aggregate(union_spans(found), start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
