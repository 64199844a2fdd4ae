"""Cutting lineage in the folder that the cluster shares, and groups in sorted partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from tarnhelm.llm.batches import as_struct, to_batch

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where none is set (local sessions, tests) a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _OWN.setdefault("folder", tempfile.mkdtemp(prefix="tarnhelm-"))
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table in the shared folder and read from there from now on.

    A lost executor costs its running tasks and nothing that was cut before.
    """
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got._cut = path
    return got


def drop(*dfs: DataFrame) -> None:
    """Deletes the tables of frames made by :func:`cut` that nothing will read again."""
    for df in dfs:
        path = getattr(df, "_cut", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


class _Groups:
    """Rows of one key after another, each key's rows as one dict of columns."""

    def __init__(self, key: str, make: Callable[[], Callable[[dict], dict]], schema: pa.Schema):
        self.key, self.make, self.schema = key, make, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = self.make()
        open_: dict | None = None
        out: dict[str, list] = {f.name: [] for f in self.schema}

        def close(group: dict) -> None:
            for name, values in work(group).items():
                out[name] += values

        for batch in batches:
            rows = batch.to_pydict()
            keys = rows[self.key]
            a = 0
            for b in range(1, len(keys) + 1):
                if b < len(keys) and keys[b] == keys[a]:
                    continue
                part = {n: v[a:b] for n, v in rows.items()}
                if open_ is not None and open_[self.key][0] == keys[a]:
                    for n in open_:
                        open_[n] += part[n]
                else:
                    if open_ is not None:
                        close(open_)
                    open_ = part
                a = b
            if len(next(iter(out.values()))) > 2000:
                yield to_batch(out, self.schema)
                out = {f.name: [] for f in self.schema}
        if open_ is not None:
            close(open_)
        if len(next(iter(out.values()))):
            yield to_batch(out, self.schema)


def map_groups(df: DataFrame, key: str, make, schema: str) -> DataFrame:
    """Bounded groups of ``key`` through Python: one shuffle and sort, no frame a group."""
    kind = as_struct(schema)
    dealt = df.repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(_Groups(key, make, to_arrow_schema(kind)), kind)
