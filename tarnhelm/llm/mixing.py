"""Mixing sources to target weights.

Per source, words are counted; targets share a fixed multiple of all words by weight,
with a cap per source (water-filling).  A document's repetition rate is its source's
target over its source's size: it is emitted floor(rate) times plus one hash-seeded
Bernoulli copy whose probability is the fraction.

A draw is a hash of the document's id and a seed, so it needs no order among documents and no
shuffle of them.  Independent draws alone would miss the target of a small source by the
square root of its documents' number; therefore SEEDS seeds are tried at once in one aggregate, and
each source takes the seed whose drawn words come nearest to its fraction.

Defined results: a null text has size 0; a null source is a source of its own and comes
last; repeated rows are documents of their own and rows of one id share their draw, so ties can't
be told apart by order; an empty table gives an empty result; a source without words has target
0 and rate 0; texts of any length are counted whole; extra columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.llm import lineage

WORD = r"[^\x20\x09-\x0D]+"
SEEDS = 32
#: Sources up to which their lines (one row each, of some 100 bytes) are broadcast; beyond, the join is salted.
MOST_BROADCAST = 20_000
#: Each source's line is repeated so often for a salted join with its documents.
JOIN_SALTS = 32


def _hex8(c: Column) -> Column:
    """The first 32 bits of a string's md5 as a long."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def _hash() -> Column:
    return _hex8(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _factor(seed: Column | int):
    """Odd factors below 2^31, so that a 32-bit hash times one is a long."""
    return seed * 16777234 + 1540483477


def _draw(h: Column, seed: Column | int) -> Column:
    """A number from 0 to 1 for each hash and seed."""
    return (h * _factor(seed) % F.lit(4294967296)) / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    The water level is closed-form: by rising cap/weight, the saturated sources are a
    prefix, so the level is the first one that the next source's cap is not below.  The
    windows without a key run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    k = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", k)
    capped = F.col("source_size") * F.lit(cap)
    order = Window.orderBy((capped / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "left": F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(capped).over(before), F.lit(0)),
        "open": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "ratio": capped / F.col("w"),
    })
    per = per.withColumn("fits", F.col("left") / F.col("open") <= F.col("ratio"))
    level = F.min(F.when(F.col("fits"), F.struct("ratio", (F.col("left") / F.col("open")).alias("level")))).over(every)
    target = F.least(capped.cast("double"), F.coalesce(level["level"] * F.col("w"), capped.cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def _rates(sizes: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """(source, source_size, target, whole, part, seed): one row per source, from (source, size, h) rows."""
    targets = source_targets(sizes, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate).withColumns({"whole": F.floor("rate").cast("long"), "part": F.col("rate") - F.floor("rate")})
    targets = lineage.cut(targets.select("source", "source_size", "target", "whole", "part"))
    held = with_source(sizes, targets)
    drawn = [F.sum(F.when(_draw(F.col("h"), j) < F.col("part"), F.col("size")).otherwise(0)).alias(f"d{j}") for j in range(SEEDS)]
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    per = held.groupBy("source").agg(*drawn, F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("whole").alias("whole"))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"d{j}") - wanted).alias("off"), F.lit(j).alias("seed")) for j in range(SEEDS)]))["seed"]
    seeds = per.select(F.col("source").alias("s"), best.alias("seed"))
    return lineage.cut(targets.join(seeds, targets["source"].eqNullSafe(seeds["s"])).drop("s"))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns: by a broadcast of at most MOST_BROADCAST lines, else by a salted join."""
    line = sources.withColumnRenamed("source", "_source")
    if sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(line), rows["source"].eqNullSafe(line["_source"])).drop("_source")
    line = line.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    salted = rows.withColumn("_own", (F.floor(F.col("h") / 64) % JOIN_SALTS).cast("int"))
    both = salted["source"].eqNullSafe(line["_source"]) & (salted["_own"] == line["_salt"])
    return salted.join(line, both).drop("_source", "_salt", "_own")


def _copies() -> Column:
    return F.col("whole") + (_draw(F.col("h"), F.col("seed").cast("long")) < F.col("part")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h), with every text read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return lineage.cut(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _hash().alias("h")))


def plan_copies(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Shuffles: partial aggregates by source.
    """
    sizes = sized(docs)
    both = with_source(sizes, _rates(sizes, weights, share, cap)).withColumn("copies", _copies())
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mixed corpus: each input row as often as the mix takes it, columns unchanged.

    The documents themselves are read, repeated and passed on in place.
    """
    rates = _rates(sized(docs), weights, share, cap)
    plain = docs.select(F.struct("*").alias("doc"), "source", _hash().alias("h"))
    copies = with_source(plain, rates).select("doc", _copies().alias("copies")).where("copies > 0")
    return copies.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n")).select("doc.*")


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH b AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
k AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w FROM s),
r AS (SELECT *, 2 * source_size / w AS ratio FROM k),
o AS (SELECT *,
        1.5::DOUBLE * sum(source_size) OVER ()::BIGINT
          - coalesce(sum(2 * source_size) OVER p, 0)::BIGINT AS lft,
        sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER p, 0)::BIGINT AS opn
      FROM r WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT lft / opn AS level FROM o WHERE lft / opn <= ratio ORDER BY ratio, lft / opn LIMIT 1),
t AS (SELECT source, source_size,
             least((2 * source_size)::DOUBLE, coalesce((SELECT level FROM l) * w, (2 * source_size)::DOUBLE)) AS target
      FROM o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
d AS (SELECT b.*, q.source_size, q.target, floor(q.rate)::BIGINT AS whole, q.rate - floor(q.rate) AS part
      FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source),
j AS (SELECT source, seed, abs(sum(CASE WHEN (h * (seed * 16777234 + 1540483477) % 4294967296) / 4294967296.0::DOUBLE < part THEN size ELSE 0 END)::BIGINT
               - (any_value(target) - any_value(whole) * any_value(source_size))) AS off
      FROM d, (SELECT unnest(range(32)) AS seed) GROUP BY source, seed),
e AS (SELECT source, seed FROM j QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1),
c AS (SELECT d.doc_id, d.size, d.source_size, d.target,
             whole + CASE WHEN (h * (seed * 16777234 + 1540483477) % 4294967296) / 4294967296.0::DOUBLE < part THEN 1 ELSE 0 END AS copies
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
