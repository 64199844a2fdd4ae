"""Scanning a stream of texts: the batch projection as it is, stateless, so append mode needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.operators import recognizers as R
from tarnhelm.operators import spans as S


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def findings(docs: DataFrame) -> DataFrame:
    """One row per merged structured finding of each text as it arrives."""
    return docs.select("doc_id", F.explode(S.merge_array(R.structured(F.col("text")))).alias("f")).select("doc_id", "f.*")


def redacted(docs: DataFrame) -> DataFrame:
    """Each text as it arrives, redacted."""
    return docs.withColumn("text", S.redact(F.col("text"), S.merge_array(R.structured(F.col("text")))))


def run_once(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into a memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
