"""Contextual findings from a token classifier: chunks, token spans, thresholds, degradation.

The classifier is injected: a function from chunk texts to token results, run batch-wise in
``mapInPandas`` with one instance a task.  Without one, or when it fails, a scan goes on with
structured findings and says so.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_CHARS = 420
OVERLAP_CHARS = 60
#: Categories taken from the model and their least scores.
THRESHOLDS = {"PERSON": 0.78, "LOCATION": 0.82}
TOKENS = "doc_id long, chunk_idx int, offset int, tok_idx int, entity string, score double, start int, end int, word string"


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """(offset, text) of overlapping chunks that end at a line or word end if one lies in their second half.

    A chunk that isn't the last moves on by more than size/2 - overlap, which bounds the fold.
    """
    kind = "array<struct<offset:int,text:string>>"
    n = F.length(text)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(kind).alias("out"))

    def step(a: Column, _: Column) -> Column:
        def cut(w: Column) -> Column:
            """``w``: what is left of the text, one character more than a chunk holds at most."""
            soft = let(F.reverse(w), lambda back: F.greatest(_last(w, back, "\n"), _last(w, back, " ")))
            end = let(soft, lambda e: F.when((F.length(w) > size) & (e > size // 2), e).otherwise(F.least(F.length(w), F.lit(size))))
            return let(end, lambda e: F.struct(
                F.greatest(a["at"] + 1, a["at"] + e - overlap).cast("int").alias("at"), (F.length(w) <= size).alias("done"),
                F.concat(a["out"], F.array(F.struct(a["at"].cast("int").alias("offset"), w.substr(F.lit(1), e).alias("text")))).alias("out"),
            ))

        return F.when(a["done"], a).otherwise(let(text.substr(a["at"] + 1, F.lit(size + 1)), cut))

    most = F.ceil(n / (size // 2 - overlap + 1)).cast("int") + 1
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["out"])).otherwise(F.array().cast(kind))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _last(window: Column, back: Column, ch: str) -> Column:
    """The last place of a character, from 0; -1 without one."""
    at = F.instr(back, ch)
    return F.when(at > 0, F.length(window) - at).otherwise(F.lit(-1))


def clean_word(word: Column) -> Column:
    """A token's text without word-piece marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(word, "^##", ""), "^[▁Ġ]+", ""))


def merge_tokens(tokens: DataFrame, text: Column | str = "text", *keys: str) -> DataFrame:
    """Tokens with offsets to entity spans: gaps and islands.

    An ``I-`` token of the same category joins the one before when only spaces, apostrophes or dashes
    lie between (or when it starts before that one ends); the span takes the least score and its last token's end.
    """
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    category = F.upper(F.regexp_replace("entity", "^[BI]-", ""))
    df = tokens.withColumn("category", category).withColumn("_inside", F.col("entity").startswith("I-"))
    df = df.withColumns({"_pc": F.lag("category").over(w), "_pe": F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    gap = F.when(F.col("start") > F.lag("end").over(w), F.col(text).substr(F.lag("end").over(w) + 1, F.col("start") - F.lag("end").over(w))).otherwise(F.lit(""))
    df = df.withColumn("_gap", gap)
    joins = F.col("_inside") & (F.col("_pc") == F.col("category")) & F.col("_gap").rlike("^[\\s'’-]*$")
    df = df.withColumn("_island", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return df.groupBy(*keys, "_island").agg(
        F.first("category").alias("category"), F.min("score").alias("score"), F.min_by("start", "tok_idx").alias("start"), F.max_by("end", "tok_idx").alias("end")
    ).drop("_island")


def above_threshold(spans: DataFrame) -> DataFrame:
    """Only the categories taken from the model, at their least score or more, and only spans with a length."""
    least = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return spans.where((F.col("score") >= F.try_element_at(least, F.col("category"))) & (F.col("end") > F.col("start")))


def fold_case(text: str) -> tuple[str, list[int]]:
    """Lower-cased text and, for each of its characters, the place it came from; with a closing mark."""
    out, at = [], []
    for i, ch in enumerate(text):
        low = ch.lower()
        out.append(low)
        at += [i] * len(low)
    return "".join(out), [*at, len(text)]


def place_tokens(text: str, tokens: list[dict]) -> list[dict]:
    """Offsets for tokens that lack them: the folded word from the last token's end on, else from the start, else none."""
    folded, at = fold_case(text)
    cursor, out = 0, []
    for t in tokens:
        start, end = t.get("start"), t.get("end")
        if start is None or end is None or not 0 <= start < end <= len(text):
            word = re.sub(r"^[▁Ġ]+", "", re.sub(r"^##", "", t.get("word") or "")).strip()
            if not word or word == "[UNK]":
                continue
            word = word.lower()
            k = folded.find(word, bisect_left(at, cursor))
            if k < 0:
                k = folded.find(word)
            if k < 0:
                continue
            start, end = at[k], at[min(k + len(word), len(at) - 1)]
        cursor = end
        out.append({**t, "start": start, "end": end})
    return out


def merge_placed(text: str, tokens: list[dict]) -> list[dict]:
    """The sequential statement of :func:`merge_tokens`, for the classifier's own task."""
    out: list[dict] = []
    for t in place_tokens(text, tokens):
        entity = t.get("entity_group")
        entity = (t.get("entity") if entity is None else entity) or ""
        category = re.sub(r"^[BI]-", "", entity).upper()
        last = out[-1] if out else None
        gap = text[last["end"] : t["start"]] if last else ""
        if last and entity.startswith("I-") and last["category"] == category and re.fullmatch(r"[\s'’-]*", gap):
            last["end"], last["score"] = t["end"], min(last["score"], t["score"])
        else:
            out.append({"category": category, "score": t["score"], "start": t["start"], "end": t["end"]})
    return out


Classifier = Callable[[list[str]], list[list[dict]]]


_FOUND = "doc_id long, start int, end int, category string, confidence double, source string, error string"


def _classified(docs: DataFrame, make: Callable[[], Classifier]) -> DataFrame:
    """The model's spans by chunks, and a row with an error for each text of a batch that the classifier failed on."""
    parts = docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_idx", "c")).select("doc_id", "c.offset", "c.text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier, broken = None, None
        try:
            classifier = make()
        except Exception as e:  # a model that can't be loaded degrades the scan
            broken = f"{type(e).__name__}: {e}"
        for frame in frames:
            rows, error = [], broken
            if error is None:
                try:
                    found = classifier(frame["text"].tolist())
                    for doc, offset, text, tokens in zip(frame["doc_id"], frame["offset"], frame["text"], found):
                        for s in merge_placed(text, tokens):
                            if s["score"] >= THRESHOLDS.get(s["category"], 2) and s["end"] > s["start"]:
                                rows.append((doc, int(offset + s["start"]), int(offset + s["end"]), s["category"], float(s["score"]), "model", None))
                except Exception as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
            if error is not None:
                rows = [(doc, None, None, None, None, None, error) for doc in frame["doc_id"].drop_duplicates()]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "end", "category", "confidence", "source", "error"])
            yield out.astype({"start": "Int32", "end": "Int32", "confidence": "float64"})

    return parts.mapInPandas(run, _FOUND)


def classify(docs: DataFrame, make: Callable[[], Classifier] | None) -> DataFrame:
    """(doc_id, start, end, category, confidence, source) of the model's spans, by chunks.

    ``make`` builds the classifier once a task.  ``None`` gives no rows (the degraded scan); a batch
    that the classifier fails on gives none either, see :func:`failures`.
    """
    if make is None:
        return docs.sparkSession.createDataFrame([], _FOUND).drop("error")
    return _classified(docs, make).where("error IS NULL").drop("error")


def failures(docs: DataFrame, make: Callable[[], Classifier]) -> DataFrame:
    """(doc_id, error) of the texts in batches that the classifier failed on; their scan is structured only."""
    return _classified(docs, make).where("error IS NOT NULL").select("doc_id", "error").distinct()


def model_status(docs: DataFrame, available: bool, error: str | None = None) -> DataFrame:
    """One row per text: whether the model took part, and why not."""
    return docs.select("doc_id", F.lit(available).alias("model_available"), F.lit(error).cast("string").alias("model_error"))
