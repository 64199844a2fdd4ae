"""Media columns: texts as payloads of baseline JPEGs, read back for thumbnails and hashes.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, become the
quantised coefficients of a JPEG (see :mod:`jpeg`), which keeps them exactly.  The stored
file is then parsed and Huffman-decoded; its dimensions and a hash of the DC-only luminance
thumbnail are its features, and its payload is taken from the decoded coefficients.

Defined results: a null or empty text is 192 spaces; equal texts give equal values; repeated
rows are stored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame

from tarnhelm.llm import batches, jpeg


def payload(text: str) -> tuple[bytes, int]:
    """The filled-up bytes, and how many were the text's."""
    raw = text.encode("utf-8")
    size = max(jpeg.UNIT, -(-len(raw) // jpeg.UNIT) * jpeg.UNIT)
    return raw + b" " * (size - len(raw)), len(raw)


class _Store:
    def __call__(self, c: dict) -> dict:
        made = [payload(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "n_bytes": [n for _, n in made], "media": jpeg.write([p for p, _ in made])}


class _Features:
    def __call__(self, c: dict) -> dict:
        out: dict[str, list] = {k.split()[0]: [] for k in FEATURES.split(", ")}
        out["doc_id"], out["n_bytes"] = c["doc_id"], c["n_bytes"]
        for data, (head, coefficients) in zip(c["media"], jpeg.read(c["media"])):
            back = jpeg.payload_of(head, coefficients)
            thumb = jpeg.thumbnail(head, coefficients)
            mark = jpeg.thumbnail_hash(thumb)
            for k, v in (
                ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-16:])),
                ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("width", head.width), ("height", head.height),
                ("thumb_hash", mark), ("feature", f"{head.width}x{head.height}:{mark}:{jpeg.digest(thumb)}"),
            ):
                out[k].append(v)
        return out


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, width int, height int, thumb_hash string"
)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a JPEG."""
    return batches.map_rows(docs, ["doc_id", batches.text_column()], _Store, "doc_id long, n_bytes long, media binary", 3 << 20)


def features(media: DataFrame) -> DataFrame:
    """Each stored file parsed and decoded: digests of its payload, dimensions, thumbnail hashes."""
    return batches.map_rows(media, ["doc_id", "n_bytes", "media"], _Features, FEATURES, 3 << 20)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
