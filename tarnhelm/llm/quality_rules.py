"""Quality rules: an isolation forest on rule statistics behind two fixed rules.

The forest is built on shape ratios (:data:`FEATURES`) of all labelled rows, from which each tree
draws SUBSAMPLE of its own, as the method has it: random splits isolate unusual rows after
short paths.  The cut on the mean path is calibrated on all labelled rows: it is the cut that
rejects most rows labelled bad while at most ``clean_loss`` of the rows labelled good go.

Defined results: a null or empty text has no words and fails the base rules; repeated rows
are judged alike; without labelled rows no forest is built and the base rules decide alone.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnhelm.llm import batches, lineage, samples, stats, words

TREES = 200
SUBSAMPLE = 512
#: Share of rows labelled good that calibration may give up.
CLEAN_LOSS = 0.0005
#: Rows labelled bad stand for so many of each good one: enough to stretch the split ranges
#: over odd values, too few to hide each other by forming clusters.
BAD_SHARE = 0.02
FEATURES = ("symbols_a_word", "symbol", "pipe_s", "pipe", "bang", "bang_s", "word_len_s")
_AT = [stats.SHAPE.index(f) for f in FEATURES]


class IsolationForest:
    """Axis-parallel random splits, held as flat arrays, walked for all rows and trees at once."""

    @classmethod
    def of(cls, trees: list["IsolationForest"]) -> "IsolationForest":
        """Trees grown apart as one forest."""
        forest = cls.__new__(cls)
        forest.depth = max(t.depth for t in trees)
        n = 2 ** (forest.depth + 1) - 1
        forest.feature = np.full((len(trees), n), -1, np.int32)
        forest.cut, forest.length = np.zeros((len(trees), n), np.float32), np.zeros((len(trees), n), np.float32)
        for i, t in enumerate(trees):
            for name in ("feature", "cut", "length"):
                getattr(forest, name)[i, : t.feature.shape[1]] = getattr(t, name)[0]
        return forest

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(subsample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, size)))))
        n = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, n), -1, np.int32)
        self.cut = np.zeros((trees, n), np.float32)
        self.length = np.zeros((trees, n), np.float32)
        for t in range(trees):
            self._grow(t, 0, 0, x[rng.choice(len(x), size, replace=False)], rng)

    @staticmethod
    def _rest(n: int) -> float:
        """Mean path of an unbuilt tree over n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, x: np.ndarray, rng) -> None:
        low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth >= self.depth or len(x) < 2 or not len(open_):
            self.length[t, node] = depth + self._rest(len(x))
            return
        f = int(rng.choice(open_))
        cut = np.float32(rng.uniform(low[f], high[f]))
        self.feature[t, node], self.cut[t, node] = f, cut
        left = x[:, f] <= cut
        self._grow(t, 2 * node + 1, depth + 1, x[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, x[~left], rng)

    def mean_path(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), block):
            part = x[at : at + block]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                f = self.feature[trees, node]
                inner = f >= 0
                v = np.take_along_axis(part, np.maximum(f, 0), 1)
                node = np.where(inner, 2 * node + 1 + (v > self.cut[trees, node]), node)
            out[at : at + block] = self.length[trees, node].mean(1)
        return out


class Forest:
    """The fitted verdict: scaled ratios, forest and cut."""

    def __init__(self, forest: IsolationForest, cut: float = -1.0):
        self.forest, self.cut = forest, cut

    def paths(self, x: np.ndarray) -> np.ndarray:
        return self.forest.mean_path(x[:, _AT].astype(np.float32))

    def keeps(self, x: np.ndarray) -> np.ndarray:
        """``x`` has all of stats.SHAPE."""
        return self.paths(x) >= self.cut


class _Shapes:
    def __call__(self, c: dict) -> dict:
        got = [stats.rule_counts(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "x": [stats.shape(t, g) for t, g in zip(c["text"], got)], "failed": [failed(g[1], g[5]) for g in got]}


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


class _Draws:
    """Each tree's candidates: rows whose hash for that tree is small enough."""

    def __init__(self, p_good: float, p_bad: float):
        self.p_good, self.p_bad = p_good, p_bad

    def __call__(self, c: dict) -> dict:
        with np.errstate(over="ignore"):
            u = words.mix(np.array(c["h"], np.int64).view(np.uint64)[:, None] + np.arange(1, TREES + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
        u = (u >> np.uint64(11)) / 2.0**53
        row, tree = np.nonzero(u < np.where(np.array(c["label"]) == 1, self.p_good, self.p_bad)[:, None])
        x = np.array(c["x"])[:, _AT].astype(np.float32)
        return {"tree": tree.tolist(), "u": u[row, tree].tolist(), "x": x[row].tolist()}


class _Grow:
    def __call__(self, g: dict) -> dict:
        x = np.array(g["x"], np.float32)
        x = x[np.lexsort((*x.T, g["u"]))][:SUBSAMPLE]
        return {"tree": [g["tree"][0]], "grown": [pickle.dumps(IsolationForest(x, trees=1, seed=7 + g["tree"][0]))]}


class _Paths:
    def __init__(self, forest: Forest):
        self.forest = forest

    def __call__(self, c: dict) -> dict:
        return {"label": c["label"], "path": self.forest.paths(np.array(c["x"])).tolist()}


def fit(docs: DataFrame, labels: DataFrame, clean_loss: float = CLEAN_LOSS) -> Forest | None:
    """The forest from all labelled rows that pass the base rules; None without a good one."""
    measured = batches.map_rows(docs, ["doc_id", batches.text_column()], _Shapes, "doc_id long, x array<double>, failed boolean")
    rows = lineage.cut(samples.all_labelled(measured, labels, "quality").where("NOT failed").select(F.xxhash64("doc_id").alias("h"), "x", "label"))
    n = {r["good"]: r["n"] for r in rows.groupBy((F.col("label") == 1).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_good, n_bad = n.get(True, 0), n.get(False, 0)
    if not n_good:
        lineage.drop(rows)
        return None
    few = min(n_bad, max(1, int(n_good * BAD_SHARE)))
    # Some more than a tree needs; the smallest hashes are taken.
    p = min(1.0, (SUBSAMPLE + 8 * SUBSAMPLE**0.5) / (n_good + few))
    drawn = batches.map_rows(rows, ["h", "x", "label"], lambda: _Draws(p, p * few / max(1, n_bad)), "tree int, u double, x array<float>")
    grown = lineage.map_groups(drawn, "tree", _Grow, "tree int, grown binary").collect()
    forest = Forest(IsolationForest.of([pickle.loads(r["grown"]) for r in sorted(grown, key=lambda r: r["tree"])]))
    paths = lineage.cut(batches.map_rows(rows, ["x", "label"], lambda: _Paths(forest), "label int, path double"))
    # The highest cut that still keeps all but clean_loss of the good rows; lower if no bad row stands between.
    least = paths.where("label = 1").orderBy("path").limit(int(n_good * clean_loss) + 1)
    cut = float(least.agg(F.max("path")).first()[0])
    under = paths.where((F.col("label") != 1) & (F.col("path") < cut)).agg(F.max("path")).first()[0]
    forest.cut = min(cut, float(np.nextafter(under, np.inf)) if under is not None else -1.0)
    lineage.drop(rows, paths)
    return forest


class _Judge:
    def __init__(self, forest: Forest | None):
        self.forest = forest

    def __call__(self, texts: list[str]) -> dict:
        got = [stats.rule_counts(t) for t in texts]
        bad = np.array([failed(g[1], g[5]) for g in got])
        keep = ~bad
        at = np.flatnonzero(keep)
        if self.forest is not None and len(at):
            keep[at] = self.forest.keeps(np.array([stats.shape(texts[i], got[i]) for i in at]))
        out = {name: [g[k] for g in got] for k, name in ((1, "n_words"), (2, "word_chars"), (3, "n_symbols"), (4, "n_dup_lines"), (5, "n_repeat_words"))}
        return out | {"base_failed": bad.tolist(), "kept": keep.tolist()}


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id and the verdict, one row per document, without a shuffle."""
    names = [x.split()[0] for x in COUNTS.split(", ")]
    got = batches.append(docs.select("doc_id", "text"), lambda: _Judge(forest), COUNTS)
    return got.select(F.col("_0").alias("doc_id"), *names)


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that pass, with their own columns, whatever these are called."""
    return batches.append(docs, lambda: _Judge(forest), COUNTS).where("kept").select(batches.own_columns(docs.columns))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels))
