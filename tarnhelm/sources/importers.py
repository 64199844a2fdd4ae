"""Importing: what a file is, and its text as blocks.

Bytes stay in a BINARY column; kinds and gates are column expressions.  Only formats that no
expression can read (markup trees, zipped XML) pass through Arrow batches of Python.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnhelm.functions.regexes import WS


@dataclass(frozen=True)
class Limits:
    pages: int = 100
    blocks: int = 200
    text_chars: int = 500_000
    ocr_words: int = 10_000
    ocr_confidence: float = 20.0
    searchable_chars: int = 16


LIMITS = Limits()
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
SUPPORTED = ("pdf", "docx", "txt", "png", "jpg", "jpeg")
IMAGE_NOTE = "[Embedded image omitted from searchable Word import]"
BLOCKS = "block_idx int, kind string, text string"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of every file."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)


def document_kind(content: Column, name: Column, media_type: Column) -> tuple[Column, Column]:
    """(kind, error): leading bytes outrank the extension, the extension outranks the media type."""
    head = F.hex(F.substring(content, 1, 12))
    ext = extension(name)
    media_type = F.coalesce(media_type, F.lit(""))
    word = (ext == "docx") | (media_type == DOCX_TYPE)
    zipped = head.startswith("504B")
    kind = (
        F.when(head.startswith("255044462D"), "pdf")
        .when(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF"), "image")
        .when(word & zipped, "docx")
        .when(~word & ((ext == "txt") | media_type.startswith("text/")), "text")
    )
    error = F.when(kind.isNotNull(), F.lit(None).cast("string")).when(word, "malformed Word document").otherwise("unsupported document type")
    return kind, error


def first_supported(files: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Of each drop, the first file with a supported extension, else the first file."""
    w = Window.partitionBy(key).orderBy(extension(F.col(name)).isin(*SUPPORTED).desc(), order)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def working_name(name: Column) -> Column:
    stem = F.trim(F.regexp_replace(name, r"\.[^.]+$", ""))
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit("-working.pdf"))


def redacted_name(name: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("")), F.lit("document")), F.lit("-redacted.pdf"))


def size_label(n: Column) -> Column:
    mb = n / F.lit(1048576.0)
    return F.when(n < 1048576, F.concat(F.ceil(n / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def text_blocks(text: Column) -> Column:
    """Array of (kind, text): each line a body block, or a space if blank; a space before each later paragraph."""
    plain = F.regexp_replace(text, "\\r\\n?", "\n")

    def block(line: Column) -> Column:
        t = js_trim(line)
        return F.struct(F.when(t == "", "space").otherwise("body").alias("kind"), t.alias("text"))

    space = F.array(F.struct(F.lit("space").alias("kind"), F.lit("").alias("text")))
    kind = "array<struct<kind:string,text:string>>"

    def paragraph(p: Column, i: Column) -> Column:
        lines = F.transform(F.split(p, "\n", -1), block).cast(kind)
        return F.when(i > 0, F.concat(space.cast(kind), lines)).otherwise(lines)

    return F.flatten(F.transform(F.split(plain, "\n{2,}", -1), paragraph))


def text_gate(text: Column) -> Column:
    """Why a text isn't imported; null if it is."""
    return F.when(js_trim(text) == "", "empty").when(F.length(text) > LIMITS.text_chars, "too long")


class _Tree(HTMLParser):
    """A small element tree; elements that can't hold others aren't opened."""

    VOID = set("area base br col embed hr img input link meta source track wbr".split())
    #: What a new element of this kind ends if still open.
    CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
    #: Elements that end an open paragraph.
    BLOCK = set("address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root: dict = {"tag": "main", "children": []}
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK and any(e["tag"] == "p" for e in self.stack):
            self.handle_endtag("p")
        for other in self.CLOSES.get(tag, ()):
            if self.stack[-1]["tag"] == other:
                self.stack.pop()
        node = {"tag": tag, "children": []}
        self.stack[-1]["children"].append(node)
        if tag not in self.VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1]["children"].append({"tag": tag, "children": []})

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i]["tag"] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1]["children"].append(data.replace(_AMPERSAND, "&"))


_SPACE = re.compile("[\\t-\\r    -     　﻿]+")


def _text(node) -> str:
    todo, out = [node], []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += reversed(x["children"])
    return _SPACE.sub(" ", "".join(out)).strip(" ")


def _elements(node) -> Iterator[dict]:
    return (c for c in node["children"] if not isinstance(c, str))


def _descend(node, tag: str) -> Iterator[dict]:
    for c in _elements(node):
        if c["tag"] == tag:
            yield c
        yield from _descend(c, tag)


#: Stands for an ampersand that begins no reference: no text from a table holds a lone surrogate.
_AMPERSAND = "\ud800"


def markup_blocks(html: str, references: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """Headings, paragraphs, list items, table rows and images in document order.

    Text outside of such elements has no block of its own; a nested list is part of its item.
    Character references are read as browsers do, also where a cut text lacks their semicolon;
    with ``references`` only those names are, and only with it.
    """
    html = html or ""
    if references is not None:
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references))});)", _AMPERSAND, html)
    parser = _Tree()
    parser.feed(html)
    parser.close()
    out: list[tuple[str, str]] = []
    todo = list(_elements(parser.root))[::-1]
    while todo:
        e = todo.pop()
        tag = e["tag"]
        if re.fullmatch("h[1-6]", tag) or tag == "li":
            if text := _text(e):
                out.append(("list" if tag == "li" else "title" if tag == "h1" else "heading", text))
        elif tag == "p":
            text = _text(e)
            out.append(("body" if text else "space", text))
        elif tag == "table":
            for row in _descend(e, "tr"):
                if cells := [t for c in _elements(row) if c["tag"] in ("th", "td") and (t := _text(c))]:
                    out.append(("table", " | ".join(cells)))
            out.append(("space", ""))
        elif tag == "img":
            out.append(("body", IMAGE_NOTE))
        else:
            todo += list(_elements(e))[::-1]
    return out


def html_blocks(pages: DataFrame, key: str, html: str, references: Sequence[str] | None = None) -> DataFrame:
    """One row per block of each page; ``references`` as in :func:`markup_blocks`."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, b[0], b[1]) for k, h in zip(frame[key], frame[html]) for i, b in enumerate(markup_blocks(h, references))]
            yield pd.DataFrame(rows, columns=[key, "block_idx", "kind", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, {BLOCKS}")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """Blocks of a Word file: paragraphs by style, list items, table rows, pictures."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, str]] = []

    def text_of(e) -> str:
        return _SPACE.sub(" ", "".join((n.text or "") if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" else "" for n in e.iter())).strip(" ")

    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            text = text_of(e)
            if m := re.fullmatch(r"heading\s?([1-6])", name):
                if text:
                    out.append(("title" if m[1] == "1" else "heading", text))
            elif e.find(f"{_W}pPr/{_W}numPr") is not None:
                if text:
                    out.append(("list", text))
            else:
                if any(n.tag == f"{_W}drawing" for n in e.iter()) and not text:
                    out.append(("body", IMAGE_NOTE))
                else:
                    out.append(("body" if text else "space", text))
        elif e.tag == f"{_W}tbl":
            for row in e.iter(f"{_W}tr"):
                if cells := [t for c in row.findall(f"{_W}tc") if (t := text_of(c))]:
                    out.append(("table", " | ".join(cells)))
            out.append(("space", ""))
    return out


def import_docx(files: DataFrame) -> DataFrame:
    """(path, block_idx, kind, text, error) of ``binaryFile`` rows; a bad file is one row with its error."""
    schema = f"path string, {BLOCKS}, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    blocks = docx_blocks(bytes(content))
                    n = sum(len(t) for _, t in blocks)
                    error = None if n else "no readable text"
                    error = "too much text" if n > LIMITS.text_chars else error
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as bad:
                    blocks, error = [], f"malformed Word document: {type(bad).__name__}"
                rows += [(path, None, None, None, error)] if error else [(path, i, k, t, None) for i, (k, t) in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=["path", "block_idx", "kind", "text", "error"]).astype({"block_idx": "Int32"})

    return files.select("path", "content").mapInPandas(run, schema)


WORDS = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
OCR_TREE = f"array<struct<paragraphs:array<struct<lines:array<struct<words:array<{WORDS}>>>>>>>"


def ocr_words(tree: Column) -> Column:
    """All sound words of a recognition tree of which any level may be missing."""
    def level(c: Column, name: str) -> Column:
        return F.flatten(F.filter(F.transform(F.coalesce(c, F.array()), lambda x: F.coalesce(x[name], F.array())), lambda x: x.isNotNull()))

    words = level(level(level(tree, "paragraphs"), "lines"), "words")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.filter(words, lambda w: w["text"].isNotNull() & finite(w["confidence"]) & finite(w["bbox"]["x0"]) & finite(w["bbox"]["y0"]) & finite(w["bbox"]["x1"]) & finite(w["bbox"]["y1"]))


def top_ocr_words(words: DataFrame, key: str, order: str, most: int = LIMITS.ocr_words, least: float = LIMITS.ocr_confidence) -> DataFrame:
    """Non-blank words of enough confidence, the first ``most`` of each page."""
    good = words.where((js_trim(F.col("text")) != "") & (F.col("confidence") >= least))
    w = Window.partitionBy(key).orderBy(order)
    return good.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def ocr_scale(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(2.5), F.lit(2400.0) / F.greatest(width, height), F.sqrt(F.lit(4e6) / (width * height))))


def image_fit(width: Column, height: Column) -> Column:
    """Scale of an image on a letter page."""
    return F.least(F.lit(612.0) / width, F.lit(792.0) / height)


def word_matrix(scale: Column, page_height: Column, box: Column, natural_width: Column, natural_height: Column) -> Column:
    """Text matrix that lays a word of natural size 1 over its box; y points up on the page."""
    w, h = F.greatest(F.lit(0.001), natural_width), F.greatest(F.lit(0.001), natural_height)
    x0, x1 = box["x0"] * scale, box["x1"] * scale
    y0, y1 = page_height - box["y0"] * scale, page_height - box["y1"] * scale
    return F.array((x1 - x0) / w, F.lit(0.0), F.lit(0.0), (y0 - y1) / h, x0, y1)


def import_documents(files: DataFrame) -> DataFrame:
    """(path, kind, error, working_name): each file's way in; a bad file is a row with its error, not a failed job."""
    name = F.element_at(F.split("path", "/"), -1)
    kind, error = document_kind(F.col("content"), name, F.lit(None).cast("string"))
    return files.select("path", kind.alias("kind"), error.alias("error"), working_name(name).alias("working_name"))
