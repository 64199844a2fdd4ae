"""Exact substring deduplication by suffix arrays over blocks that belong together.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.

Equal strings must meet before they can be sorted side by side.  For every start of LENGTH bytes
the least hash of the GRAM-byte strings inside them depends on those bytes alone, so
equal strings have equal least hashes.  Neighbouring starts with one least hash make up a segment;
its bucket is that hash.  A bucket's segments are concatenated, its suffixes sorted in
two stages (:mod:`suffix_array`), and starts whose common prefix with a neighbour is LENGTH are repeats.
Equal hashes only bring segments together; what counts is what the sort finds.

Equal segments travel once, with their number; from two on all their starts repeat.  Segments that
have a bucket to themselves, and no least gram twice, need no sort.  A bucket over HOT_BYTES (a
passage common to very many contexts) isn't gathered: its starts are told apart by a 128-bit
hash of their LENGTH bytes in an ordinary aggregate, which is exact but for collisions.

A passage of just over 50 words may have less than LENGTH bytes, so nothing of it is removed.  On demand the same sort
also runs on words, each a 64-bit code: strings of WORDS words that also start anywhere else are counted, not removed.
A bucket's lowest bit says which of the two it belongs to.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing; repeated rows
repeat each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tarnhelm.llm import batches, lineage
from tarnhelm.llm.suffix_array import common_prefixes, two_stage

LENGTH = 400
GRAM = 96
#: A repeated passage has so many words at least.
WORDS = 50
WORD_GRAM = 8
#: A bucket over so many bytes is handled by hashes of its starts.
HOT_BYTES = 1 << 20
#: Bytes of segments sorted together, at bucket borders.
BLOCK_BYTES = 1 << 20
#: Starts of a segment at most: longer runs (periodic text) are cut.
MOST_STARTS = 1 << 15
#: Starts hashed together.
SPAN = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, _BACK):
                x = np.full(size, base, _U)
                x[0] = 1
                both.append(np.cumprod(x))
        _POWERS[0] = both[0], both[1]
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of every gram-byte string."""
    n = len(data) - gram + 1
    up, back = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
        h = (sums[gram:] - sums[:n]) * back[:n]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    n, size, m = len(h) - width + 1, 1, h
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[width - size : width - size + n]) if size < width else m[:n]


class _Codes(dict):
    """64-bit codes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def coded(raw: bytes) -> bytes:
    """The codes of the words, which are what blanks (32, 9 to 13) part."""
    return np.fromiter(map(_CODES.__getitem__, raw.split()), _U).tobytes()


class Kind(NamedTuple):
    """What is compared: so many units of so many bytes, told apart by grams."""

    unit: int
    length: int
    gram: int

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8")
        return raw if self.unit == 1 else coded(raw)


def segments(raw: bytes, length: int, gram: int, unit: int = 1) -> tuple[list, list, list, list, list]:
    """Bucket, content hash, first and last start and whether the least gram is there twice, of each segment."""
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    width = length - gram + 1
    view = memoryview(raw)
    whole = np.frombuffer(raw, np.uint8 if unit == 1 else _U)
    for base in range(0, len(whole) - length + 1, SPAN):
        data = whole[base : base + SPAN + length - 1]
        h = gram_hashes(data, gram)
        m = least(h, width)
        edge = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
        long = np.flatnonzero(np.diff(edge) > MOST_STARTS)
        if len(long):
            more = [np.arange(edge[i] + MOST_STARTS, edge[i + 1], MOST_STARTS) for i in long]
            edge = np.unique(np.concatenate([edge, *more]))
        values = m[edge[:-1]]
        out[0].extend(values.view(np.int64).tolist())
        edge = edge.tolist()
        for a, b, v in zip(edge, edge[1:], values):
            out[1].append(xxhash.xxh3_64_intdigest(view[(base + a) * unit : (base + b - 1 + length) * unit]) - (1 << 63))
            out[4].append(np.count_nonzero(h[a : b - 1 + width] == v) > 1)
        out[2].extend(base + a for a in edge[:-1])
        out[3].extend(base + b - 1 for b in edge[1:])
    return out


class _Segments:
    def __init__(self, kinds: list[Kind]):
        self.kinds = kinds

    def _of(self, text: str) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for k, kind in enumerate(self.kinds):
            got = segments(kind.encode(text), kind.length, kind.gram, kind.unit)
            out[0] += [b & ~1 | k for b in got[0]]
            for all_, new in zip(out[1:], got[1:]):
                all_ += new
        return out

    def __call__(self, c: dict) -> dict:
        got = [self._of(t) for t in c["text"]]
        names = ("bucket", "content", "first", "last", "twice")
        return {"did": c["did"], "th": c["th"]} | {n: [g[i] for g in got] for i, n in enumerate(names)}


class _Cut:
    """The bytes of a document's segments."""

    def __init__(self, kinds: list[Kind]):
        self.kinds = kinds

    def __call__(self, c: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("bucket", "did", "th", "first", "n", "bytes")}
        for did, th, text, wanted in zip(c["did"], c["th"], c["text"], c["wanted"]):
            raw: dict[int, bytes] = {}
            for w in wanted:
                k = w["bucket"] & 1
                if k not in raw:
                    raw[k] = self.kinds[k].encode(text)
                out["bucket"].append(w["bucket"])
                out["did"].append(did)
                out["th"].append(th)
                out["first"].append(w["first"])
                out["n"].append(w["n"])
                out["bytes"].append(raw[k][w["first"] * self.kinds[k].unit : (w["last"] + self.kinds[k].length) * self.kinds[k].unit])
        return out


def repeated_starts(parts: list[bytes], length: int, unit: int = 1) -> list[np.ndarray]:
    """For each part, which of its starts have ``length`` units that start elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(parts), np.uint8)
    depth = length * unit
    wanted = np.zeros(len(text), bool)
    for e, s in zip(ends, sizes):
        wanted[e - s : e - depth + 1 : unit] = True
    order = two_stage(text, wanted, depth)
    full = common_prefixes(text, order, depth) >= depth
    hit = np.zeros(len(text), bool)
    hit[order[:-1][full]] = True
    hit[order[1:][full]] = True
    return [hit[e - s : e - depth + 1 : unit] for e, s in zip(ends, sizes)]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


class _Sort:
    """Blocks of whole buckets, sorted; rows come sorted by bucket."""

    def __init__(self, kinds: list[Kind], block: int, schema: pa.Schema):
        self.kinds, self.block, self.schema = kinds, block, schema

    def _block(self, all_rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in ("did", "th", "kind", "first", "last")}
        for k, kind in enumerate(self.kinds):
            rows = [r for r in all_rows if r[0] & 1 == k]
            if not rows:
                continue
            for (_, did, th, first, n, _), hit in zip(rows, repeated_starts([r[5] for r in rows], kind.length, kind.unit)):
                if n == 1:  # copies repeat anyway
                    for a, b in runs(hit):
                        for name, v in (("did", did), ("th", th), ("kind", k), ("first", first + a), ("last", first + b)):
                            out[name].append(v)
        if out["did"]:
            yield batches.to_batch(out, self.schema)

    def __call__(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, bucket_size, bucket = 0, 0, None
        done = 0  # rows of whole buckets
        for batch in it:
            for row in zip(*(batch.column(n).to_pylist() for n in ("bucket", "did", "th", "first", "n", "bytes"))):
                if row[0] != bucket:
                    if size >= self.block:
                        yield from self._block(rows)
                        rows, size = [], 0
                    bucket = row[0]
                rows.append(row)
                size += len(row[5])
        if rows:
            yield from self._block(rows)


class _Starts:
    """A 128-bit hash of each start's bytes."""

    def __init__(self, kinds: list[Kind]):
        self.kinds = kinds

    def __call__(self, c: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("hash", "did", "th", "kind", "start")}
        for bucket, did, th, first, raw in zip(c["bucket"], c["did"], c["th"], c["first"], c["bytes"]):
            unit, length, _ = self.kinds[bucket & 1]
            view = memoryview(raw)
            n = len(raw) // unit - length + 1
            out["hash"] += [xxhash.xxh3_128_digest(view[p * unit : (p + length) * unit]) for p in range(n)]
            out["did"] += [did] * n
            out["th"] += [th] * n
            out["kind"] += [bucket & 1] * n
            out["start"] += range(first, first + n)
        return out


def removed(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs that the given ranges of starts cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


class _Remove:
    def __init__(self, kinds: list[Kind], with_text: bool):
        self.kinds, self.with_text = kinds, with_text

    def __call__(self, c: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_repeat_words", "word_spans")}
        kept_bytes: list[bytes] = []
        for doc, text, ranges in zip(c["doc_id"], c["text"], c["ranges"]):
            raw = text.encode("utf-8")
            got = [removed([(r["first"], r["last"]) for r in ranges or () if r["kind"] == k], kind.length) for k, kind in enumerate(self.kinds)]
            spans, words = got if len(got) > 1 else (got[0], [])
            parts, at = [], 0
            for a, b in spans:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            kept = b"".join(parts)
            out["doc_id"].append(doc)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append(",".join(f"{a}:{b}" for a, b in spans))
            out["n_repeat_words"].append(sum(b - a for a, b in words))
            out["word_spans"].append(",".join(f"{a}:{b}" for a, b in words))
            kept_bytes.append(kept)
        return out | ({"kept": kept_bytes} if self.with_text else {})


def substring_dedup(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_bytes: int = HOT_BYTES, block: int = BLOCK_BYTES, with_text: bool = False,
    words: int | None = None, word_gram: int = WORD_GRAM,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets); with ``words``, n_repeat_words and word_spans
    (the words that repeated strings of so many cover); with ``with_text``, the kept bytes."""
    units = [Kind(1, length, gram)] + [Kind(8, words, word_gram)] * (words is not None)
    kind = F.col("bucket").bitwiseAND(F.lit(1)).cast("int").alias("kind")
    # A row is known by its id and its text's hash: rows of one id and text are alike in all that follows.
    ids = [F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")]
    source = docs.select("doc_id", *ids, batches.text_column())
    kinds = "did long, th long, bucket array<long>, content array<long>, first array<int>, last array<int>, twice array<boolean>"
    listed = lineage.cut(batches.map_rows(source, ["did", "th", "text"], lambda: _Segments(units), kinds, 2 << 20))
    each = listed.select("did", "th", F.explode(F.arrays_zip("bucket", "content", "first", "last", "twice")).alias("s")).select("did", "th", "s.*")
    # Most buckets hold one segment and no least gram twice: they go before anything wider moves.
    busy = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max("twice").alias("t")).where("m > 1 OR t").select("bucket")
    live = lineage.cut(each.join(busy, "bucket", "left_semi"))
    lineage.drop(listed)

    equal = live.groupBy("bucket", "content").agg(
        F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(F.struct("did", "th", "first", "last")).alias("one")
    )
    span = F.col("one.last") - F.col("one.first")
    size = F.when(kind == 0, span + length).otherwise((span + (words or 0)) * 8)
    per = equal.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.max("twice").alias("any_twice"), F.sum(size).alias("bytes")
    ).withColumnRenamed("bucket", "b")
    found = lineage.cut(
        equal.join(per, equal["bucket"] == per["b"]).where("n > 1 OR kinds > 1 OR twice")
        .select(
            "bucket", "content", "n", "one.*",
            ((F.col("least") == 1) & ((F.col("kinds") > 1) | F.col("any_twice"))).alias("sort"),
            (F.col("bytes") > hot_bytes).alias("hot"),
        )
    )

    copies = live.join(found.where("n > 1").select("bucket", "content"), ["bucket", "content"]).select("did", "th", kind, "first", "last")
    wanted = found.where("sort").groupBy("did", "th").agg(F.collect_list(F.struct("bucket", "first", "last", "n", "hot")).alias("wanted"))
    dealt = source.repartition("did", "th")  # the text moves once and serves both joins
    held = dealt.select("did", "th", "text").dropDuplicates(["did", "th"]).join(wanted, ["did", "th"])
    cut_kinds = "bucket long, did long, th long, first int, n long, bytes binary"
    hot_only, cold_only = (F.filter("wanted", f).alias("wanted") for f in (lambda w: w["hot"], lambda w: ~w["hot"]))

    parts = batches.map_rows(held, ["did", "th", "text", cold_only], lambda: _Cut(units), cut_kinds, 2 << 20)
    out_kinds = batches.as_struct("did long, th long, kind int, first int, last int")
    sort = _Sort(units, block, to_arrow_schema(out_kinds))
    sorted_ = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, out_kinds)
    ranges = copies.union(sorted_)
    if not found.where("sort AND hot").isEmpty():
        hot = batches.map_rows(held.where(F.exists("wanted", lambda w: w["hot"])), ["did", "th", "text", hot_only], lambda: _Cut(units), cut_kinds, 2 << 20)
        starts = batches.map_rows(
            hot, ["bucket", "did", "th", "first", "bytes"], lambda: _Starts(units), "hash binary, did long, th long, kind int, start int", 1 << 18
        )
        many = starts.groupBy("hash", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "kind")
        ranges = ranges.union(starts.join(many, ["hash", "kind"]).select("did", "th", "kind", F.col("start").alias("first"), F.col("start").alias("last")))
    per_doc = ranges.groupBy("did", "th").agg(F.collect_list(F.struct("kind", "first", "last")).alias("ranges"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    kinds += ", n_repeat_words long, word_spans string" * (words is not None) + ", kept binary" * with_text
    return batches.map_rows(
        dealt.join(per_doc, ["did", "th"], "left"), ["doc_id", "text", "ranges"], lambda: _Remove(units, with_text), kinds, 2 << 20
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    got = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=WORDS).drop("spans", "word_spans")
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(F.lit(0.0))
    return got.withColumns({"has_repeats": F.col("n_removed") > 0, "removed_share": share, "has_repeated_passage": F.col("n_repeat_words") > 0})
