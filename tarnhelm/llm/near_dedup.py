"""Near-duplicate documents by order MinHash, verified by banded alignment.

Words are runs of letters and digits in lower case.  A document's three-word k-mers are labelled with
their occurrence; each of SKETCHES sketches takes the TAKE k-mers of least hash in the order
in which they stand in the text, so it is sensitive to edit similarity and not just to sets.
Documents that share a sketch are aligned word by word within a band; two are linked if
1 - edits / words of the longer one is SIMILARITY or more.  A class is what links connect.

Shape of the job: texts with equal words are one node from the start, so copies cost nothing
further.  The nodes of one sketch are a set of candidates; equal sets are one, and sets with the same
least node are verified together, so what one of them connects the others needn't align again.  Of a hot
sketch (more nodes than BLOCK) blocks are verified so first, and then, block against block, every
pair of its nodes that links don't connect yet, but for pairs whose lengths alone rule them out.
A group holds a few blocks, so no list of pairs is ever made.

Defined results: a null text counts as empty; a document without words is a class of its own;
repeated rows are copies, of which one is kept; a class id is its least doc_id (null only if all are null), and the
kept row is the one of least doc_id, of equal ids the one of least text hash; texts of any length are
compared whole; an empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnhelm.llm import batches, lineage
from tarnhelm.llm.components import components
from tarnhelm.llm.words import codes, mix

#: Words of the sketches' k-mers; fewer than a shingle's, so that spread edits leave more of them whole.
KMER = 3
SKETCHES = 24
TAKE = 2
SIMILARITY = 0.8
#: Nodes of a hot sketch that are verified as one set, about.
BLOCK = 2048
#: Nodes that a node is held against at once.
FEW = 64
#: Hash bins of the quick bound on common words.
BINS = 2048

_U = np.uint64
#: Odd factors and offsets of the sketches' orders; the k-mers' hashes are mixed already.
_ORDERS = np.random.default_rng(9).integers(1 << 31, size=(2, SKETCHES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def labelled_kmers(words: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hashes of the k-mers of word codes, each told apart from its earlier occurrences."""
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, _U)
    for j in range(min(k, len(words))):
        h = h * _U(0x9E3779B97F4A7C15) + words[j : j + n]
    h = mix(h)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return h
    order = np.argsort(h, kind="stable")
    at = np.arange(n)
    new = np.concatenate([[True], s[1:] != s[:-1]])
    occurrence = np.empty(n, _U)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(_U)
    return np.where(occurrence == 0, h, mix(h ^ mix(occurrence * _U(0xD6E8FEB86659FD93))))


def sketches(kmers: np.ndarray, m: int = SKETCHES, take: int = TAKE, cells: int = 1 << 16) -> np.ndarray:
    """One 64-bit key for each sketch: the taken k-mers in text order."""
    out = np.empty(m, _U)
    n = min(take, len(kmers))
    short = kmers.astype(np.uint32)
    block = max(1, cells // len(kmers))
    for at in range(0, m, block):
        i = np.arange(at, min(m, at + block))
        v = short[None, :] * _ORDERS[0, i, None] + _ORDERS[1, i, None]
        places = np.empty((len(i), n), np.int64)
        rows = np.arange(len(i))
        for t in range(n):
            places[:, t] = v.argmin(1)
            v[rows, places[:, t]] = np.iinfo(np.uint32).max
        places.sort(1)
        key = i.astype(_U) + _U(1)
        for t in range(n):
            key = mix(key * _U(0x9E3779B97F4A7C15) + kmers[places[:, t]])
        out[i] = key
    return out


def places(words: np.ndarray) -> dict[int, int]:
    """For each word, a number whose bits are the places where it stands."""
    order = np.argsort(words, kind="stable")
    edge = np.flatnonzero(np.diff(words[order])) + 1
    return {int(words[p[0]]): sum(1 << i for i in p.tolist()) for p in np.split(order, edge)} if len(words) else {}


def edits_within(a: np.ndarray, b: np.ndarray, most: int, at: dict[int, int] | None = None) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, in a band of that width.

    The band's vertical differences of a column are the bits of two numbers, so a column takes a
    dozen operations whatever its width; the band moves down one row a column.  ``at`` may hold a's places.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    least = min(n, m)
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    differ = np.flatnonzero(a[head:][::-1][: least - head] != b[head:][::-1][: least - head])
    tail = int(differ[0]) if len(differ) else least - head
    n, m = n - head - tail, m - head - tail
    if not n or not m:
        return n + m if n + m <= most else None
    k = min(most, max(n, m))
    at = places(a) if at is None else at
    width = 2 * k + 2
    full, bottom = (1 << width) - 1, 1 << (width - 1)
    plus, minus = ((1 << (k + 1)) - 1) << (width - 1 - k), 0  # rows that add one to or take one from the row above
    d, limit = min(k, n), 2 * k + m - n
    below, shift = max(0, n - k), k + 1 - width
    last = 1 << (width - 2 - max(0, k - n))  # the last row, once the band has reached it
    for j, w in enumerate(b[head : head + m].tolist()):
        same = at.get(w, 0) >> head
        same = (same >> shift if shift >= 0 else same << -shift) & full
        shift += 1
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & full
        right_plus, right_minus = minus | (full ^ (diagonal | plus)), diagonal & plus
        if j < below:
            d += not diagonal & bottom
        else:
            d += bool(right_plus & last) - bool(right_minus & last)
            last >>= 1
        if d > limit:
            return None
        diagonal >>= 1
        plus, minus = right_minus | (full ^ (diagonal | right_plus)), diagonal & right_plus
    return d if d <= most else None


def allowed(longest, similarity: float):
    """Edits that two texts may have whose longer one has so many words."""
    return np.int64((1 - similarity) * longest + 1e-9) if np.isscalar(longest) else ((1 - similarity) * longest + 1e-9).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, at: dict[int, int] | None = None) -> bool:
    return edits_within(a, b, int(allowed(max(len(a), len(b)), similarity)), at) is not None


class _Sketch:
    def __call__(self, c: dict) -> dict:
        out: dict[str, list] = {"rkey": c["rkey"], "doc_id": c["doc_id"], "node": [], "n_words": [], "keys": []}
        for words in codes(c["text"]):
            out["n_words"].append(len(words))
            if not len(words):
                out["node"].append(None)
                out["keys"].append([])
                continue
            out["node"].append(xxhash.xxh3_128_hexdigest(words.tobytes()))
            with np.errstate(over="ignore"):
                out["keys"].append(sketches(labelled_kmers(words)).view(np.int64).tolist())
        return out


class _Codes:
    """32 bits of each word's code: enough to align two texts."""

    def __call__(self, c: dict) -> dict:
        return {"node": c["node"], "codes": [w.astype(np.uint32).tobytes() for w in codes(c["text"])]}


class _Align:
    """Links that connect the classes of one group of nodes.

    Each node comes with the sets it is in (only nodes of one set are compared), its class so far
    and a side: nodes of sides 0 and 1 are compared across, those of side -1 with all.  What comes out is
    a star for every class: its nodes and its least node.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, g: dict) -> dict:
        order = sorted(range(len(g["node"])), key=g["node"].__getitem__)
        nodes = [g["node"][i] for i in order]
        side = np.array([g["side"][i] for i in order])
        self.of = np.unique([g["root"][i] for i in order], return_inverse=True)[1]  # the class of each node
        self.words = [np.frombuffer(g["codes"][i], np.uint32) for i in order]
        self.size = np.array([len(w) for w in self.words])
        # Words by hash bin: what two texts have in common can't exceed the sum of the lesser counts.
        self.bins = np.stack([np.bincount(w & (BINS - 1), minlength=BINS) for w in self.words]).astype(np.uint16 if self.size.max() < 1 << 16 else np.uint32)
        of_set: dict[int, list[int]] = {}
        for at, i in enumerate(order):
            for x in g["sets"][i]:
                of_set.setdefault(x, []).append(at)
        members = {x: np.array(m) for x, m in of_set.items()}
        before, met = self.of.copy(), np.zeros(len(order), bool)
        for at, i in enumerate(order):
            for x in g["sets"][i]:
                met[members[x]] = True
            self._with(at, np.flatnonzero(met[:at] & (self.of[:at] != self.of[at])), side)
            met[:] = False
        out: dict[str, list] = {"a": [], "b": []}
        least: dict[int, int] = {}
        for i, k in enumerate(self.of.tolist()):
            j = least.setdefault(k, i)
            if before[i] != before[j]:
                out["a"].append(nodes[i])
                out["b"].append(nodes[j])
        return out

    def _with(self, i: int, to: np.ndarray, side: np.ndarray) -> None:
        """Node ``i`` against the nodes ``to``."""
        of, size = self.of, self.size
        longest = np.maximum(size[to], size[i])
        most = allowed(longest, self.similarity)
        near = (np.abs(size[to] - size[i]) <= most) & ((side[to] != side[i]) | (side[to] < 0))
        to, spare = to[near], (longest - most)[near]
        own = None
        for cut in range(0, len(to), FEW):  # a few at a time: one link settles a whole class
            some, least = to[cut : cut + FEW], spare[cut : cut + FEW]
            open_ = of[some] != of[i]
            some, least = some[open_], least[open_]
            some = some[np.minimum(self.bins[some], self.bins[i]).sum(1, dtype=np.int64) >= least]
            for j in some.tolist():
                if of[j] == of[i]:
                    continue
                own = places(self.words[i]) if own is None else own
                if linked(self.words[i], self.words[j], self.similarity, own):
                    of[of == of[j]] = of[i]


def row_key():
    """A 128-bit key of a row's id and text, equal for repeated rows only."""
    part = [F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce(F.col("text"), F.lit("\x00"))]
    return F.md5(F.concat_ws("\x1f", *part)).alias("rkey")


def _runs(pairs: DataFrame, block: int) -> DataFrame:
    """(gid, node, sets): the sets of nodes of a key, or of a hot key's blocks, under their least node; equal sets are one."""
    part = F.when(F.col("n") > block, F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / block))).otherwise(F.lit(0)).alias("part")
    sets = pairs.groupBy("key", part).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    sets = sets.select("nodes").where("size(nodes) > 1").distinct()
    members = sets.select(F.col("nodes")[0].alias("gid"), F.xxhash64("nodes").alias("set"), F.explode("nodes").alias("node"))
    return members.groupBy("gid", "node").agg(F.collect_list("set").alias("sets"))


def _blocks(hot: DataFrame, similarity: float, block: int) -> DataFrame:
    """(gid, node, side): every two blocks of a hot key, and each alone, that links don't connect altogether.

    ``hot`` is (key, node, root, n_words).  Lengths are cut at powers of 1 / similarity: two similar texts are
    in one band or in neighbouring ones, and blocks of other bands never meet.
    """
    # A little wider than the powers, so that no rounding puts a similar pair two bands apart.
    hot = hot.withColumn("band", F.floor(F.log("n_words") / -np.log(similarity - 1e-3)))
    bands = hot.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = hot.join(bands, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    dealt = lineage.cut(dealt.select("key", "band", "part", "node", "root"))
    each = dealt.groupBy("key", "band", "part").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    one, two = each.alias("x"), each.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & F.expr("(x.band = y.band AND x.part <= y.part) OR x.band + 1 = y.band")
    open_ = F.least("x.low", "y.low") < F.greatest("x.high", "y.high")
    met = one.join(two, near & open_).select(
        F.md5(F.concat_ws("/", "x.key", "x.band", "x.part", "y.band", "y.part")).alias("gid"), F.col("x.key").alias("key"),
        F.col("x.band").alias("band_x"), F.col("x.part").alias("part_x"), F.col("y.band").alias("band_y"), F.col("y.part").alias("part_y"),
    )
    alone = (F.col("band_x") == F.col("band_y")) & (F.col("part_x") == F.col("part_y"))
    first = met.select("gid", "key", F.col("band_x").alias("band"), F.col("part_x").alias("part"), F.when(alone, -1).otherwise(0).alias("side"))
    second = met.where(~alone).select("gid", "key", F.col("band_y").alias("band"), F.col("part_y").alias("part"), F.lit(1).alias("side"))
    return dealt.join(first.union(second), ["key", "band", "part"]).select("gid", "node", "side")


def _linked(rows: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the verified links of groups, given as (gid, node, sets, side, root)."""
    rows = rows.join(words, "node").select("gid", "node", "sets", "side", "root", "codes")
    return lineage.cut(lineage.map_groups(rows, "gid", lambda: _Align(similarity), "a string, b string"))


def roots(docs: DataFrame, sketched: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, root) of every node that is linked to another."""
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("rkey").alias("rkey"), F.min("keys").alias("keys"), F.min("n_words").alias("n_words"))
    pairs = nodes.select("node", "rkey", "n_words", F.explode("keys").alias("key"))
    counts = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = lineage.cut(pairs.join(counts, "key"))
    texts = docs.select(row_key(), "text").join(pairs.select("node", "rkey").distinct().hint("shuffle_hash"), "rkey")
    words = lineage.cut(batches.map_rows(texts, ["node", batches.text_column()], _Codes, "node string, codes binary", 1 << 20).dropDuplicates(["node"]))
    found = _linked(_runs(pairs, block).withColumns({"side": F.lit(-1), "root": F.col("node")}), words, similarity)
    linked_ = components(found)
    hot = pairs.where(F.col("n") > block)
    if hot.isEmpty():
        lineage.drop(pairs, words)
        return linked_
    rooted = hot.join(linked_, "node", "left").select("key", "node", "n_words", F.coalesce("root", "node").alias("root"))
    blocks = _blocks(rooted, similarity, block).join(rooted.select("node", "root").distinct(), "node")
    more = _linked(blocks.withColumn("sets", F.array(F.lit(0).cast("long"))), words, similarity)
    return components(found.union(more))


def classes(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(rkey, doc_id, node, class_id, class_size, first): one row per input row.

    ``first`` marks the row of each class that a deduplication keeps (one of equal rows
    shares its rkey with the others).
    """
    kind = "rkey string, doc_id long, node string, n_words int, keys array<long>"
    sketched = lineage.cut(batches.map_rows(docs, [row_key(), "doc_id", batches.text_column()], _Sketch, kind, 1 << 20))
    linked_ = roots(docs, sketched, similarity, block)
    # One row for each node (or row without words) before classes are put together.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rkey")).alias("least")
    own = sketched.select("rkey", "doc_id", "node", F.coalesce("node", F.concat(F.lit("row "), "rkey")).alias("own"))
    per_node = own.groupBy("own").agg(F.count(F.lit(1)).alias("n"), least)
    per_node = per_node.join(linked_, per_node["own"] == linked_["node"], "left").withColumn("root", F.coalesce("root", "own"))
    per = per_node.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("class_size"))
    per_node = per_node.select("own", "root").join(per, "root").select("own", F.col("least.doc_id").alias("class_id"), F.col("least.rkey").alias("kept"), "class_size")
    return own.join(per_node, "own").select("rkey", "doc_id", "node", "class_id", "class_size", (F.col("rkey") == F.col("kept")).alias("first"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its own columns."""
    kept = lineage.cut(classes(docs, similarity).where("first").groupBy("rkey").agg(F.count(F.lit(1)).alias("n")))
    rows = docs.select(row_key(), F.struct("*").alias("doc"))
    out = rows.join(kept.where("n = 1").select("rkey").hint("shuffle_hash"), "rkey", "left_semi")
    again = kept.where("n > 1").select("rkey")
    if not again.isEmpty():  # rows that are there more than once, alike in all that is compared
        out = out.union(rows.join(again, "rkey", "left_semi").groupBy("rkey").agg(F.min_by("doc", F.to_json("doc")).alias("doc")))
    return out.select("doc.*")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", "class_id", "class_size", F.col("first").alias("kept"))
