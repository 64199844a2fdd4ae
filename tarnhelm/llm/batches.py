"""Arrow batches in and out of Python, cut to bounded pieces.

Every Python-backed operator here goes through :func:`map_rows`: it selects just the
columns it needs (so extra or clashing columns never reach Python), cuts each Arrow batch
into pieces of bounded text size and keeps one worker object per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of variable-length columns that one piece holds at most (one row may exceed it).
PIECE_BYTES = 6 << 20

Columns = dict[str, list]


def as_struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, most * n // max(1, batch.nbytes))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def to_batch(columns: Columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


class _Mapper:
    """Picklable partition function: ``make()`` gives an object with ``rows`` and, if it
    has a tail to emit at the end of its partition, ``finish``."""

    def __init__(self, make: Callable[[], object], schema: pa.Schema, most: int):
        self.make, self.schema, self.most = make, schema, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = self.make()
        rows = worker if callable(worker) else worker.rows
        for batch in batches:
            for piece in pieces(batch, self.most):
                out = rows(piece.to_pydict())
                if out is not None and len(next(iter(out.values()))):
                    yield to_batch(out, self.schema)
        if hasattr(worker, "finish"):
            out = worker.finish()
            if out is not None and len(next(iter(out.values()))):
                yield to_batch(out, self.schema)


def map_rows(df: DataFrame, columns: list, make: Callable[[], object], schema: str, most: int = PIECE_BYTES) -> DataFrame:
    """``df``'s ``columns`` through a per-task worker, as rows of ``schema``."""
    schema = as_struct(schema)
    arrow = to_arrow_schema(schema)
    return df.select(*columns).mapInArrow(_Mapper(make, arrow, most), schema)


class _Appender:
    """Picklable partition function: the input's arrays as they are, and the worker's beside them."""

    def __init__(self, make: Callable[[], Callable[[list[str]], Columns]], at: int, schema: pa.Schema, most: int):
        self.make, self.at, self.schema, self.most = make, at, schema, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = self.make()
        for batch in batches:
            for piece in pieces(batch, self.most):
                got = work([t or "" for t in piece.column(self.at).to_pylist()])
                new = [pa.array(got[f.name], type=f.type) for f in self.schema]
                names = [*piece.schema.names, *self.schema.names]
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=names)


def append(df: DataFrame, make: Callable[[], Callable[[list[str]], Columns]], schema: str, text: str = "text", most: int = PIECE_BYTES) -> DataFrame:
    """``df`` with its columns named _0, _1, ... and the columns that a worker makes of its texts.

    Only the texts become Python objects; all else passes through as Arrow arrays.  The
    numbered names can't clash with the new ones, whatever the table's columns are called.
    """
    new = as_struct(schema)
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    both = T.StructType([*plain.schema.fields, *new.fields])
    return plain.mapInArrow(_Appender(make, df.columns.index(text), to_arrow_schema(new), most), both)


def own_columns(names: list[str], **replaced) -> list:
    """Columns of an appended table under their old names; ``replaced`` gives some a new value."""
    return [(replaced[n] if n in replaced else F.col(f"_{i}")).alias(n) for i, n in enumerate(names)]


def text_column(name: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).alias("text")
