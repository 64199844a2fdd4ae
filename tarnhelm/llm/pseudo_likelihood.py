"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts each word from REACH words to either side: their embeddings, weighted by
place, are summed and squashed; a two-level softmax gives the symbol's class and the symbol
within it, and the counts give the word within its symbol.  A document's score is the sum of its words'
conditional log-probabilities.

Texts are turned into word codes once.  Words are counted over all documents; the FREQUENT most frequent are
symbols of their own, the rest share BUCKETS hashed symbols.  Within a bucket a word has its slot's share of the
bucket's count (there are 2^SLOT_BITS slots, however large the corpus) divided by the slot's different words, so a
rare or unknown word costs more than a common one of its bucket.

Training is spread: from one start, every task trains its own copy on windows of
its documents (in each round another part of every document's words, so that over the rounds every
word is a target once), the copies are averaged in SLOTS groups and then once more, and the next round
starts from the mean.  What reaches the driver is SLOTS copies and one row a slot, of fixed size.  Which
documents share a copy follows the table's splits, so scores from another split differ a little.

Defined results: a null or empty text has no words, log_prob 0 and mean_log_prob null; repeated rows
score alike; of equally frequent words the one of least code goes first; texts of any length are scored whole; an
empty table trains nothing and gives an empty result; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tarnhelm.llm import batches, lineage
from tarnhelm.llm.words import codes

FREQUENT = 1024
BUCKETS = 256
SLOT_BITS = 18
CLASS = 32
DIM = 16
REACH = 2
ROUNDS = 2
#: Targets of the first steps and of the later ones; the number doubles every EASE steps.
FIRST_BATCH, BATCH, EASE = 512, 8192, 8
SLOTS = 16
SYMBOLS = FREQUENT + BUCKETS
CLASSES = SYMBOLS // CLASS
PAD = SYMBOLS


class _Code:
    """32 bits of each word's code."""

    def __call__(self, c: dict) -> dict:
        return {"doc_id": c["doc_id"], "codes": [w.astype(np.uint32).tobytes() for w in codes(c["text"])]}


def coded(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): each text's words as 32-bit codes, written once for all that follows."""
    return lineage.cut(batches.map_rows(docs, ["doc_id", batches.text_column()], _Code, "doc_id long, codes binary", 1 << 20))


class Vocabulary:
    """Symbols of words, their counts, and the log-probability of each word within its symbol."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, slot_counts: np.ndarray, slot_words: np.ndarray):
        """``frequent`` are codes by falling count; ``counts`` theirs; the other two are the rest's counts and different words by slot."""
        size = 1 << SLOT_BITS
        slot = np.arange(size)
        self.frequent = np.zeros(FREQUENT, np.uint32)
        self.frequent[: len(frequent)] = frequent
        self.of = np.full(size, -1, np.int16)  # the frequent word that a slot may hold
        at = self.slots(frequent)
        self.of[at[::-1]] = np.arange(len(frequent))[::-1]
        lost = self.of[at] != np.arange(len(frequent))  # a more frequent word has its slot: it joins the rest
        slot_counts, slot_words = slot_counts.astype(float), slot_words.astype(float)
        np.add.at(slot_counts, at[lost], counts[lost])
        np.add.at(slot_words, at[lost], 1)
        self.bucket = (FREQUENT + slot % BUCKETS).astype(np.int16)
        total = np.bincount(slot % BUCKETS, weights=slot_counts, minlength=BUCKETS)
        share = (slot_counts + 1) / (total + size // BUCKETS)[slot % BUCKETS]
        self.within = (np.log(share) - np.log(np.maximum(1, slot_words))).astype(np.float32)
        self.counts = np.concatenate([np.zeros(FREQUENT), total])
        self.counts[: len(frequent)] = np.where(lost, 0, counts)

    @staticmethod
    def slots(words: np.ndarray) -> np.ndarray:
        return (words >> np.uint32(32 - SLOT_BITS)).astype(np.int64)

    def ids(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with REACH pads to either side, and each word's log-probability within its symbol."""
        words = np.frombuffer(data, np.uint32)
        slot = self.slots(words)
        k = self.of[slot]
        own = (k >= 0) & (self.frequent[k] == words)
        out = np.full(len(words) + 2 * REACH, PAD, np.int64)
        out[REACH : REACH + len(words)] = np.where(own, k, self.bucket[slot])
        return out, np.where(own, np.float32(0), self.within[slot])


class Network:
    """Parameters and their gradients; float32 throughout."""

    NAMES = ("e", "a", "b", "c", "cb", "o", "ob")

    def __init__(self, counts: np.ndarray | None = None, seed: int = 17):
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.e, self.a, self.b = n(SYMBOLS + 1, DIM), np.ones((2 * REACH, DIM), np.float32), np.zeros(DIM, np.float32)
        self.c, self.o = n(CLASSES, DIM), n(CLASSES, CLASS, DIM)
        p = (np.ones(SYMBOLS) if counts is None else counts.astype(float) + 0.5).reshape(CLASSES, CLASS)
        # Without context the network gives the counted frequencies.
        self.cb = np.log(p.sum(1) / p.sum()).astype(np.float32)
        self.ob = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)

    def pack(self) -> bytes:
        return b"".join(getattr(self, n).tobytes() for n in self.NAMES)

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        out, at = cls(), 0
        for n in cls.NAMES:
            old = getattr(out, n)
            setattr(out, n, np.frombuffer(data, np.float32, old.size, at).reshape(old.shape).copy())
            at += old.nbytes
        return out

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context symbols and hidden layer of the words at ``at`` of a padded sequence."""
        context = np.stack([ids[at + o] for o in (*range(-REACH, 0), *range(1, REACH + 1))], 1)
        h = np.zeros((len(at), DIM), np.float32)
        for i in range(2 * REACH):
            h += self.e[context[:, i]] * self.a[i]
        return context, np.tanh(h + self.b)

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, h = self.hidden(ids, at)
        target = ids[at]
        cls = target // CLASS
        z = h @ self.c.T + self.cb
        out = np.take_along_axis(z, cls[:, None], 1)[:, 0] - _log_sum(z)
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])
        for k in range(CLASSES):  # one product a class
            rows = order[edge[k] : edge[k + 1]]
            if len(rows):
                z = h[rows] @ self.o[k].T + self.ob[k]
                out[rows] += z[np.arange(len(rows)), target[rows] % CLASS] - _log_sum(z)
        return out


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


class Trainer:
    """Adagrad on the logistic loss of both softmax levels."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate = net, rate
        self.sums = {n: np.full(getattr(net, n).shape, 1e-3, np.float32) for n in Network.NAMES}

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        net, n = self.net, len(at)
        context, h = net.hidden(ids, at)
        target = ids[at]
        cls, member = target // CLASS, target % CLASS
        rows = np.arange(n)
        pc = _soft(h @ net.c.T + net.cb)
        pc[rows, cls] -= 1
        pc /= n
        dh = pc @ net.c
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])
        do, dob = np.zeros_like(net.o), np.zeros_like(net.ob)
        for k in range(CLASSES):  # one product a class, no copy of its matrix for each word
            r = order[edge[k] : edge[k + 1]]
            if len(r):
                po = _soft(h[r] @ net.o[k].T + net.ob[k])
                po[np.arange(len(r)), member[r]] -= 1
                po /= n
                dh[r] += po @ net.o[k]
                do[k], dob[k] = po.T @ h[r], po.sum(0)
        dh *= 1 - h * h
        de, da = np.zeros_like(net.e), np.stack([(dh * net.e[context[:, i]]).sum(0) for i in range(2 * REACH)])
        flat = context.T.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        first = np.concatenate([[0], np.flatnonzero(np.diff(flat[order])) + 1])
        each = np.concatenate([dh * net.a[i] for i in range(2 * REACH)])
        de[flat[order[first]]] = np.add.reduceat(each[order], first)
        for name, g in (("e", de), ("a", da), ("b", dh.sum(0)), ("c", pc.T @ h), ("cb", pc.sum(0)), ("o", do), ("ob", dob)):
            s, p = self.sums[name], getattr(net, name)
            s += g * g
            p -= self.rate * g / np.sqrt(s)


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class _Count:
    """Codes and their number, a task's share at a time."""

    MOST = 4 << 20

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0

    def _take(self) -> dict:
        found, n = np.unique(np.frombuffer(b"".join(self.parts), np.uint32), return_counts=True)
        self.parts, self.size = [], 0
        return {"code": found.astype(np.int64).tolist(), "n": n.tolist()}

    def rows(self, c: dict) -> dict | None:
        self.parts += c["codes"]
        self.size += sum(map(len, c["codes"]))
        return self._take() if self.size > 4 * self.MOST else None

    def finish(self) -> dict:
        return self._take()


def vocabulary(corpus: DataFrame) -> Vocabulary:
    """Symbols and counts over all documents; the driver sees FREQUENT words and one row a slot."""
    counted = batches.map_rows(corpus, ["codes"], _Count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = lineage.cut(counted)
    top = counted.orderBy(F.col("n").desc(), "code").limit(FREQUENT).toPandas()
    frequent, counts = top["code"].to_numpy(np.int64).astype(np.uint32), top["n"].to_numpy(float)
    slot = F.shiftright("code", 32 - SLOT_BITS).cast("int")
    rest = counted.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).toPandas()
    lineage.drop(counted)
    at = rest["slot"].to_numpy(np.int64)
    slot_counts, slot_words = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    slot_counts[at], slot_words[at] = rest["n"].to_numpy(float), rest["words"].to_numpy(float)
    own = Vocabulary.slots(frequent)
    np.add.at(slot_counts, own, -counts)
    np.add.at(slot_words, own, -1)
    return Vocabulary(frequent, counts, slot_counts, slot_words)


def targets(words: bytes, turn: int, rounds: int) -> np.ndarray:
    """Places of the words that a round trains; over all rounds each word once."""
    return np.arange((int.from_bytes(words[:4], "little") + turn) % rounds, len(words) // 4, rounds)


class _Train:
    def __init__(self, vocabulary: Vocabulary, start: bytes, rate: float, turn: int, rounds: int):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.part = context.partitionId() if context else 0
        self.vocabulary, self.trainer = vocabulary, Trainer(Network.unpack(start), rate)
        self.turn, self.rounds = turn, rounds
        self.ids: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.size = self.seen = self.base = self.steps = 0

    def _batch(self) -> int:
        return min(BATCH, FIRST_BATCH << min(20, self.steps // EASE))

    def rows(self, c: dict) -> None:
        for data in c["codes"]:
            if not data:
                continue
            ids, _ = self.vocabulary.ids(data)
            at = targets(data, self.turn, self.rounds) + REACH
            self.ids.append(ids)
            self.at.append(at + self.base)
            self.base += len(ids)
            self.size += len(at)
            if self.size >= self._batch():
                self._step()

    def _step(self) -> None:
        if self.size:
            ids, at = np.concatenate(self.ids), np.concatenate(self.at)
            done = 0
            while done < len(at):
                some = at[done : done + self._batch()]
                self.trainer.step(ids, some)
                done += len(some)
                self.steps += 1
            self.seen += self.size
        self.ids, self.at, self.size, self.base = [], [], 0, 0

    def finish(self) -> dict | None:
        self._step()
        if not self.seen:
            return None
        return {"slot": [self.part % SLOTS], "part": [self.part], "n": [self.seen], "net": [self.trainer.net.pack()]}


class _Mean:
    """Means of the copies of each slot, weighted by their windows; one copy in memory at a time."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema

    def __call__(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total, n = None, None, 0
        for batch in it:
            for row in batch.to_pylist():
                if row["slot"] != slot:
                    if slot is not None:
                        yield self._row(slot, total, n)
                    slot, total, n = row["slot"], 0.0, 0
                total = total + np.frombuffer(row["net"], np.float32).astype(float) * row["n"]
                n += row["n"]
        if slot is not None:
            yield self._row(slot, total, n)

    def _row(self, slot: int, total, n: int) -> pa.RecordBatch:
        return batches.to_batch({"slot": [slot], "n": [n], "net": [(total / n).astype(np.float32).tobytes()]}, self.schema)


def train(corpus: DataFrame, words: Vocabulary, rounds: int = ROUNDS, rate: float = 0.1) -> Network:
    """The network after ``rounds`` of training in every task and averaging."""
    context = corpus.sparkSession.sparkContext
    net = Network(words.counts)
    held = context.broadcast(words)  # of fixed size
    kind = batches.as_struct("slot int, n long, net binary")
    for r in range(rounds):
        start = context.broadcast(net.pack())
        step = rate / (r + 1)
        copies = batches.map_rows(corpus, ["codes"], lambda: _Train(held.value, start.value, step, r, rounds), "slot int, part int, n long, net binary")
        means = copies.repartition(SLOTS, "slot").sortWithinPartitions("slot", "part").mapInArrow(_Mean(to_arrow_schema(kind)), kind).collect()
        if not means:  # no document has a word of this turn
            continue
        total = sum(m["n"] for m in means)
        mean = sum(np.frombuffer(m["net"], np.float32).astype(float) * (m["n"] / total) for m in sorted(means, key=lambda m: m["slot"]))
        net = Network.unpack(mean.astype(np.float32).tobytes())
    return net


class _Score:
    def __init__(self, vocabulary: Vocabulary, net: Network):
        self.vocabulary, self.net = vocabulary, net

    def __call__(self, c: dict) -> dict:
        got = [self.vocabulary.ids(d) for d in c["codes"]]
        n = np.array([len(w) for _, w in got])
        flat = np.concatenate([i for i, _ in got])
        at = np.flatnonzero(flat != PAD)
        logs = np.concatenate([self.net.log_probs(flat, at[a : a + BATCH]) for a in range(0, len(at), BATCH)] or [np.zeros(0)]).astype(float)
        logs += np.concatenate([w for _, w in got])
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = [float(logs[a:b].sum()) for a, b in zip(ends, ends[1:])]
        return {"doc_id": c["doc_id"], "n_words": n.tolist(), "log_prob": sums, "mean_log_prob": [s / k if k else None for s, k in zip(sums, n.tolist())]}


def score(corpus: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob), one row per document, without a shuffle."""
    held = corpus.sparkSession.sparkContext.broadcast((words, net))  # of fixed size
    return batches.map_rows(
        corpus, ["doc_id", "codes"], lambda: _Score(*held.value), "doc_id long, n_words long, log_prob double, mean_log_prob double", 2 << 20
    )


def op7_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    corpus = coded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = vocabulary(corpus)
    return score(corpus, words, train(corpus, words))
