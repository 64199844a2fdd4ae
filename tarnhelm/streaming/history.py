"""Edit histories: ordered events folded into block lists with undo and redo; latest generation wins.

The fold is one function, used by a batch plan (one group per document) and by a stream (state per document).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 50
CAP = 200
STATE = "doc_id long, seq long, n_blocks int, n_past int, n_future int, blocks string"


class History:
    """Blocks now, before and after; a commit forgets what was undone."""

    def __init__(self, data: str | None = None):
        self.blocks, self.past, self.future = json.loads(data) if data else ([], [], [])

    def dump(self) -> str:
        return json.dumps([self.blocks, self.past, self.future])

    def _commit(self, blocks: list) -> None:
        self.past = [*self.past[-(DEPTH - 1) :], self.blocks]
        self.blocks, self.future = blocks, []

    def apply(self, action: str, block: str | None) -> None:
        if action == "add":
            if len(self.blocks) < CAP:
                self._commit([*self.blocks, block])
        elif action == "remove":
            self._commit([b for b in self.blocks if b != block])
        elif action == "clear":
            self._commit([])
        elif action == "undo" and self.past:
            self.future = [self.blocks, *self.future][:DEPTH]
            self.blocks = self.past.pop()
        elif action == "redo" and self.future:
            self.past = [*self.past, self.blocks][-DEPTH:]
            self.blocks = self.future.pop(0)

    def row(self, doc: int, seq: int) -> tuple:
        return doc, seq, len(self.blocks), len(self.past), len(self.future), ",".join(self.blocks)


_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def fold(events: DataFrame) -> DataFrame:
    """The final state of each document from (doc_id, seq, action, block)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h = History()
        frame = frame.sort_values("seq")
        for action, block in zip(frame["action"], frame["block"]):
            h.apply(action, block)
        return pd.DataFrame([h.row(int(frame["doc_id"].iloc[0]), int(frame["seq"].iloc[-1]))], columns=_COLUMNS)

    return events.groupBy("doc_id").applyInPandas(run, STATE)


def fold_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, one updated row per document and batch."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        h = History(state.get[0] if state.exists else None)
        last = -1
        for frame in frames:
            frame = frame.sort_values("seq")
            for action, block in zip(frame["action"], frame["block"]):
                h.apply(action, block)
            last = max(last, int(frame["seq"].max()))
        state.update((h.dump(),))
        yield pd.DataFrame([h.row(int(key[0]), last)], columns=_COLUMNS)

    return events.groupBy("doc_id").applyInPandasWithState(run, STATE, "history string", "update", "NoTimeout")


def latest(results: DataFrame, key: str, generation: str, *values: str) -> DataFrame:
    """Only the newest generation's result counts."""
    return results.groupBy(key).agg(F.max(F.struct(generation, *values)).alias("_m")).select(key, "_m.*")


def queue_numbers(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """Two-digit places in the review queue."""
    w = Window.partitionBy(key).orderBy(order)
    return blocks.withColumn("queue_no", F.lpad(F.row_number().over(w).cast("string"), 2, "0"))
