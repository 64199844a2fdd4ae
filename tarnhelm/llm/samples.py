"""Labelled rows for fitting: bounded samples on the driver, or all of them by their measured shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documented bound of :func:`labelled`.
MOST_LABELLED = 12_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text has remainder 1 modulo 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows that aren't held out.

    The rows are those of smallest hashed id, so the sample doesn't follow any order of
    the table.  Its ids are few by construction (``most``), so they are broadcast and the
    documents' text isn't shuffled.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")


def all_labelled(measured: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``measured`` (doc_id and what was measured of each document) with the label of every labelled row that isn't held out.

    Only measurements meet the labels, so no text is shuffled and nothing is bounded.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return measured.join(ids, "doc_id")
