"""Quality classifier: Bradley-Terry pairwise ranking.

All pairs of a better and a worse labelled document train linear document scores: the chance that
one wins is the logistic function of the difference of the scores, so the loss is logistic
on differences of features.  No pair is written down: what the loss needs of a row is its score's
place among the other class's scores, so a Newton step is a histogram of all scores and a sum over all
rows.  The cut is a quantile of all training scores (the share of rows labelled 0), and the reported
score is a logistic function around that cut.

Features are the shape ratios of :mod:`stats`, each with a one-hot of its quantile bin, over
the whole text; ids, labels, languages and sources are never among them.

Defined results: a null or empty text is scored by its (all-zero) ratios; repeated rows score
alike; without rows of both labels every score is 0.5; a null id is never held out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.llm import batches, lineage, samples, stats

BINS = 10
#: Cells of a histogram of scores, and coarse ones for the mixed part of the second derivative.
CELLS, COARSE = 1024, 64
#: Steps of a feature's values in an octave, for its quantiles.
STEPS = 512
L2 = 1e-3


class Ranker:
    """Bins, scaling and weights; ``rows`` is the number of rows they come from."""

    rows = 0
    fitted = False

    def __init__(self, edges: list[np.ndarray] | None = None, mean: np.ndarray | None = None, std: np.ndarray | None = None):
        if edges is not None:
            self.edges, self.mean, self.std = edges, mean, std
            self.w = np.zeros(len(edges) + sum(len(e) + 1 for e in edges))

    def cells(self, s: np.ndarray, n: int) -> np.ndarray:
        low, high = self.range
        return np.clip(((s - low) * (n / (high - low))).astype(np.int64), 0, n - 1)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -4, 4)
        parts = [z] + [np.eye(len(e) + 1)[np.searchsorted(e, x[:, j], side="right")] for j, e in enumerate(self.edges)]
        return np.hstack(parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((self.features(x) @ self.w - self.cut) / self.scale, -35, 35)))


def measure(text: str) -> list[float]:
    return stats.shape(text, stats.rule_counts(text)) + [0.0 + (not text.strip())]


class _Shapes:
    def __call__(self, c: dict) -> dict:
        return {"doc_id": c["doc_id"], "x": list(map(measure, c["text"]))}


class _Cells:
    """How many rows of each label have a score in each cell."""

    def __init__(self, ranker: Ranker, n: int):
        self.ranker, self.n, self.sums = ranker, n, np.zeros((2, n), np.int64)

    def rows(self, c: dict) -> None:
        s = self.ranker.features(np.array(c["x"])) @ self.ranker.w
        np.add.at(self.sums, (np.array(c["label"]), self.ranker.cells(s, self.n)), 1)

    def finish(self) -> dict:
        label, cell = np.nonzero(self.sums)
        return {"label": label.tolist(), "cell": cell.tolist(), "n": self.sums[label, cell].tolist()}


class _Range:
    """The least and the largest score of a piece of rows."""

    def __init__(self, ranker: Ranker):
        self.ranker = ranker

    def __call__(self, c: dict) -> dict:
        s = self.ranker.features(np.array(c["x"])) @ self.ranker.w
        return {"low": [float(s.min())], "high": [float(s.max())]}


class _Sums:
    """A task's part of the loss's derivatives, given each cell's weights: first, second, and the sums by label and coarse cell."""

    def __init__(self, ranker: Ranker, first: np.ndarray, second: np.ndarray):
        self.ranker, self.first, self.second = ranker, first, second
        d = len(ranker.w)
        self.g, self.h, self.by = np.zeros(d), np.zeros((d, d)), np.zeros((2 * COARSE, d))

    def rows(self, c: dict) -> None:
        x, y = np.array(c["x"]), np.array(c["label"])
        for at in range(0, len(x), 2048):
            f, label = self.ranker.features(x[at : at + 2048]), y[at : at + 2048]
            s = f @ self.ranker.w
            cell = self.ranker.cells(s, CELLS)
            self.g += self.first[label, cell] @ f
            self.h += (f * self.second[label, cell][:, None]).T @ f
            np.add.at(self.by, label * COARSE + cell // (CELLS // COARSE), f)

    def finish(self) -> dict:
        return {"sums": [np.concatenate([self.g, self.h.ravel(), self.by.ravel()]).tobytes()]}


class _Total:
    def __init__(self):
        self.sums = 0

    def rows(self, c: dict) -> None:
        for x in c["sums"]:
            self.sums = self.sums + np.frombuffer(x)

    def finish(self) -> dict | None:
        return None if isinstance(self.sums, int) else {"sums": [self.sums.tobytes()]}


def _start(rows: DataFrame, n: dict[int, int]) -> Ranker:
    """Bins by quantiles of both classes with equal say, so that a rare class has edges of its own; means and deviations."""
    values = rows.select("label", F.posexplode("x").alias("j", "v"))
    step = F.when(F.col("v") > 0, F.floor(F.log2("v") * STEPS)).cast("long").alias("step")  # null: zero
    counts = values.select("label", "j", step).groupBy("label", "j", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("label", "j").orderBy(F.asc_nulls_first("step")))
    total = F.when(F.col("label") == 1, n[1]).otherwise(n[0])
    grid = [i / BINS for i in range(1, BINS)]
    wanted = [F.floor(F.lit(q) * (total - 1)) for q in grid]
    chosen = counts.withColumn("upto", upto).where(F.exists(F.array(*wanted), lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto"))))
    edges: dict[int, set[float]] = {}
    for r in chosen.select("j", "step").distinct().collect():
        edges.setdefault(r["j"], set()).add(0.0 if r["step"] is None else 2.0 ** (r["step"] / STEPS))
    spread = values.groupBy("j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).orderBy("j").collect()
    mean, std = (np.array([round(r[name], 12) for r in spread]) for name in ("mean", "std"))
    return Ranker([np.array(sorted(edges[j])) for j in range(len(spread))], mean, std + 1e-9)


def _histogram(rows: DataFrame, ranker: Ranker, n: int) -> np.ndarray:
    """Rows by label and cell, over the range of the scores as they are now."""
    low, high = batches.map_rows(rows, ["x"], lambda: _Range(ranker), "low double, high double").agg(F.min("low"), F.max("high")).first()
    ranker.range = low - 1e-6, high + 1e-6
    out = np.zeros((2, n))
    got = batches.map_rows(rows, ["x", "label"], lambda: _Cells(ranker, n), "label int, cell int, n long")
    for r in got.groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():
        out[r["label"], r["cell"]] = r["n"]
    return out


def _middles(ranker: Ranker, n: int) -> np.ndarray:
    low, high = ranker.range
    return low + (np.arange(n) + 0.5) * (high - low) / n


def _loss(ranker: Ranker, bad: np.ndarray, good: np.ndarray) -> float:
    at = _middles(ranker, CELLS)
    return float(good @ np.logaddexp(0, at[None] - at[:, None]) @ bad / (bad.sum() * good.sum()) + L2 / 2 * ranker.w @ ranker.w)


def _step(rows: DataFrame, ranker: Ranker, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The Newton step on the mean loss of all pairs."""
    at = _middles(ranker, CELLS)
    p = 1 / (1 + np.exp(np.clip(at[:, None] - at[None], -30, 30)))  # the good one of a pair (row) loses
    q, pairs = p * (1 - p), bad.sum() * good.sum()
    first, second = np.stack([good @ p, -(p @ bad)]) / pairs, np.stack([good @ q, q @ bad]) / pairs
    parts = batches.map_rows(rows, ["x", "label"], lambda: _Sums(ranker, first, second), "sums binary")
    sums = sum(np.frombuffer(r["sums"]) for r in batches.map_rows(parts.repartition(4), ["sums"], _Total, "sums binary").collect())
    d = len(ranker.w)
    g, h, by = sums[:d], sums[d : d + d * d].reshape(d, d), sums[d + d * d :].reshape(2, COARSE, d)
    coarse = q.reshape(COARSE, CELLS // COARSE, COARSE, CELLS // COARSE).mean(axis=(1, 3))
    cross = by[1].T @ coarse @ by[0] / pairs
    h = h - cross - cross.T
    # The coarse cells' error must not turn the step around.
    values, vectors = np.linalg.eigh((h + h.T) / 2 + L2 * np.eye(d))
    return vectors @ ((vectors.T @ (g + L2 * ranker.w)) / np.maximum(values, L2))


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    """The ranker from all labelled rows that aren't held out."""
    measured = batches.map_rows(docs, ["doc_id", batches.text_column()], _Shapes, "doc_id long, x array<double>")
    rows = lineage.cut(samples.all_labelled(measured, labels, "quality").where("label IN (0, 1)").select("x", "label"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranker = Ranker()
    if len(n) == 2:
        ranker = _start(rows, n)
        best, w = np.inf, ranker.w
        for _ in range(40):
            bad, good = _histogram(rows, ranker, CELLS)
            loss = _loss(ranker, bad, good)
            if loss > best * (1 + 1e-4):  # too far: half the step
                ranker.w = (ranker.w + w) / 2
                continue
            best, w = loss, ranker.w
            step = _step(rows, ranker, bad, good)
            ranker.w = w - step
            if np.abs(step).max() < 1e-2:
                break
        ranker.fitted, ranker.rows = True, sum(n.values())
        fine = _histogram(rows, ranker, 1 << 16).sum(0)
        at = _middles(ranker, len(fine))
        mean = fine @ at / fine.sum()
        ranker.cut = float(at[min(int(np.searchsorted(np.cumsum(fine), n[0] / ranker.rows * (ranker.rows - 1), side="right")), len(fine) - 1)])
        ranker.scale = float(max(1e-6, np.sqrt(fine @ (at - mean) ** 2 / fine.sum()) / 2))
    lineage.drop(rows)
    return ranker


class _Score:
    def __init__(self, ranker: Ranker):
        self.ranker = ranker

    def __call__(self, c: dict) -> dict:
        s = self.ranker.score(np.array(list(map(measure, c["text"]))))
        return {"doc_id": c["doc_id"], "held_out": c["held_out"], "score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}


def rank(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document, without a shuffle."""
    return batches.map_rows(
        docs, ["doc_id", samples.held_out().alias("held_out"), batches.text_column()], lambda: _Score(ranker),
        "doc_id long, held_out boolean, score double, predicted int",
    )


def op5_quality_rank(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rank(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
