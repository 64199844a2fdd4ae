"""Sum-of-squares online packing of tokenised documents.

Each task is one online packer.  A document's ids (with an end id) fill whole windows first;
the rest goes to the fill level that minimises the sum of squared counts of partly filled
windows, which a level array holds.  Too many open windows, and those left at the end of
a task, are poured together: their pieces are cut at window ends, and what is then under a
window is cut into powers of two, which need no padding.

No shuffle: text is tokenised and packed where it is read.  Sequence ids carry the
partition, so they are unique, and a task that is run again gives the same rows.

Defined results: a null or empty text is the end id alone; repeated rows are documents of
their own; an empty table has no pieces; a document of any length is cut into windows; of equally good
levels the fullest is taken; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tarnhelm.llm import batches

WIDTH = 1024
#: Open windows that a packer holds at most; beyond, it pours them together.
MOST_OPEN = 2048
#: Fixed value: how byte-level BPE cuts a text before it merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text encoded at once.
PIECE = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts, by a tokenizer file.

    A byte-level BPE file whose ids follow its merges is also a table of ranks, and the rank engine
    gives the same ids in a third of the time (the tests compare both); any other file, and a text
    with one of the file's special strings, goes to the file's own engine.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = ranks_of(json.load(f))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [self.whole(t) for t in texts]
        return [self.whole(t) if any(s in t for s in self.special) else self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts]


def ranks_of(file: dict) -> dict[bytes, int] | None:
    """Byte strings and their ids, if the file is a plain byte-level BPE whose ids follow its merges."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or file.get("normalizer") or any(before.get(k) != v for k, v in plain.items()):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None
    # Bytes that print stand for themselves in such a file, the others for the characters from 256 on.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    return {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if all(c in byte for c in w)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder, loaded once for all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


class Packer:
    """The online packer of one task."""

    def __init__(self, first: int, width: int = WIDTH, most_open: int = MOST_OPEN):
        self.next, self.width, self.most_open = first, width, most_open
        self.count = np.zeros(width + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(width)]
        self.rows: list[tuple] = []

    def _emit(self, window: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def level(self, r: int) -> int:
        """The level that a piece of r ids goes to: of least change of the sum of squares, and of those the fullest."""
        n, w = self.count, self.width
        change = 2 * (n[r:w] - n[: w - r]) + 2  # h in 0 .. w-r-1: leaves h, comes to h+r
        change[0] = 2 * n[r] + 1  # a new window
        change[1:][n[1 : w - r] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if n[w - r] and 1 - 2 * n[w - r] <= change[best]:  # fills a window up
            return w - r
        return best

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, w = len(ids), self.width
        whole = total - total % w
        for at in range(0, whole, w):
            self._emit([(doc, at, ids[at : at + w], total)])
        r = total - whole
        if not r:
            return
        h = self.level(r)
        window = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        window.append((doc, whole, ids[whole:].copy(), total))
        if h + r == w:
            self._emit(window)
            return
        self.open[h + r].append(window)
        self.count[h + r] += 1
        if self.count[1:w].sum() > self.most_open:
            self.pour()

    def pour(self, last: bool = False) -> None:
        """Open windows, fullest first, poured into whole ones; what is left stays open or is cut into powers of two."""
        pieces = [p for h in range(self.width - 1, 0, -1) for window in self.open[h] for p in window]
        self.open = [[] for _ in range(self.width)]
        self.count[:] = 0
        left = sum(len(p[2]) for p in pieces)
        window: list[Piece] = []
        fill, room = 0, self._room(left, last)
        for doc, start, ids, total in pieces:
            while len(ids):
                if room is None:  # the rest stays open
                    window.append((doc, start, ids, total))
                    fill += len(ids)
                    break
                cut = min(len(ids), room - fill)
                window.append((doc, start, ids[:cut], total))
                ids, start, fill = ids[cut:], start + cut, fill + cut
                if fill == room:
                    self._emit(window)
                    left -= room
                    window, fill, room = [], 0, self._room(left, last)
        if window:
            self.open[fill].append(window)
            self.count[fill] += 1

    def _room(self, left: int, last: bool) -> int | None:
        return self.width if left >= self.width else (1 << (left.bit_length() - 1)) if last and left else None

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class _Pack:
    def __init__(self, path: str, end_id: int, width: int):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.encoder, self.end = encoder(path), np.array([end_id], np.uint32)
        self.packer = Packer((context.partitionId() if context else 0) << 40, width)

    def _columns(self) -> dict:
        rows = self.packer.take()
        return {n.split()[0]: [r[i] for r in rows] for i, n in enumerate(SCHEMA.split(", "))}

    def __call__(self, c: dict) -> dict:
        for doc, ids in zip(c["doc_id"], self.encoder.encode(c["text"])):
            self.packer.add(doc, np.concatenate([ids, self.end]))
        return self._columns()

    rows = __call__

    def finish(self) -> dict:
        self.packer.pour(last=True)
        return self._columns()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, width: int = WIDTH) -> DataFrame:
    """One row per piece; see the module's docstring."""
    return batches.map_rows(docs, ["doc_id", batches.text_column()], lambda: _Pack(tokenizer_path, end_id, width), SCHEMA, PIECE)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
