"""Interleaved document sequences: HTML to ordered text and media references, payloads by digest.

``sequences`` parses a page's HTML into items in page order: text, or a reference to a medium (by the
digest in its address) with its caption; ``resolved`` joins the media table by digest and keeps
position and caption beside the payload. ``as_png`` and ``from_png`` hold any bytes without loss as
the 8-bit samples of a grey image, 192 to a row.

Defined cases: null and empty HTML has no items; references without a digest, or to one that isn't
in the media table, stay with a null payload; of media rows that share a digest one is taken; a
figure's caption goes to every medium in it, else the alternative text, else null; other columns
are left out; an empty table gives an empty one. A null text's payload is that of the empty text:
one row of blanks.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, tidied, utf8

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
DIGEST = re.compile(r"sha256[:-]([0-9a-f]{64})")
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "article", "section", "figure", "figcaption", "blockquote", "pre", "table", "tr", "td", "th", "ul", "ol", "body", "br", "hr"}


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []
        self.caption = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text and self.caption and self.figures:
            self.figures[-1]["caption"].append(text)
        elif text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BLOCKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figures.append({"caption": [], "media": []})
        elif tag == "figcaption":
            self.caption += 1
        elif tag in _MEDIA:
            named = dict(attrs)
            m = DIGEST.search(named.get("src") or "")
            self.items.append({"kind": "media", "text": None, "digest": m and m[1], "caption": named.get("alt") or None})
            if self.figures:
                self.figures[-1]["media"].append(self.items[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.caption = max(0, self.caption - 1)
        elif tag == "figure" and self.figures:
            figure = self.figures.pop()
            for item in figure["media"]:
                item["caption"] = " ".join(figure["caption"]) or item["caption"]

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def items(html: str) -> list[dict]:
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.flush()
    while parser.figures:
        parser.handle_endtag("figure")
    return parser.items


def sequences(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """doc_id, position, kind ('text' or 'media'), text, digest, caption: one row an item, positions from 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, k, x["kind"], x["text"], x["digest"], x["caption"]) for d, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if h for k, x in enumerate(items(h))]
            if rows:
                yield batch(schema, list(map(list, zip(*rows))))

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{html_col}`").alias("html")).mapInArrow(tidied(run), "doc_id long, position long, kind string, text string, digest string, caption string")


def resolved(items_table: DataFrame, media: DataFrame) -> DataFrame:
    """The items with the columns of media(digest, ...) beside each reference; one media row a digest."""
    return items_table.join(media.dropDuplicates(["digest"]), "digest", "left")


def interleaved(resolved_items: DataFrame) -> DataFrame:
    """doc_id, items: each document's items as one array of structs in page order."""
    return resolved_items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", *(c for c in resolved_items.columns if c not in ("doc_id", "position"))))).alias("items"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def as_png(text: bytes) -> bytes:
    """A grey 8-bit image of a text padded with blanks to a positive multiple of ROW; the unpadded size is in its metadata."""
    size = max(ROW, -(-len(text) // ROW) * ROW)
    rows = np.full((size // ROW, ROW + 1), 32, np.uint8)
    rows[:, 0] = 0  # each row's filter: none
    flat = np.full(size, 32, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    rows[:, 1:] = flat.reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, size // ROW, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> tuple[bytes, int]:
    """The payload and the unpadded size; every chunk's checksum is verified."""
    if not stored.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, size = len(SIGNATURE), [], 0
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            size = int(body[6:])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:].tobytes(), size


def feature(payload: bytes) -> str:
    """Mean sample, spread, and a 64-bit difference hash over an 8 x 9 grid of the image."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, ROW).astype(np.int64)
    down = np.arange(8) * len(a) // 8
    across = np.arange(9) * ROW // 9
    total = np.add.reduceat(np.add.reduceat(a, down, 0), across, 1)
    area = np.outer(np.maximum(np.diff(down, append=len(a)), 1), np.diff(across, append=ROW))
    grid = total / area
    bits = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    mean = a.sum() / a.size
    return f"{mean:.3f}:{(max(0.0, (a * a).sum() / a.size - mean * mean)) ** 0.5:.3f}:{bits}"


def stored_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, html, media: each text as an image and a page that shows it, by digest, with a caption."""
    schema = pa.schema([("doc_id", pa.int64()), ("html", pa.string()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [as_png(t) for t in utf8(b.column(1))]
            pages = [f'<article><p>Document</p><figure><img src="sha256:{hashlib.sha256(m).hexdigest()}"><figcaption>Text of the document</figcaption></figure></article>' for m in media]
            yield batch(schema, [b.column(0), pages, media])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidied(run), "doc_id long, html string, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature of media(media): decoded from the stored bytes."""
    schema = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in utf8(b.column(0)):
                payload, size = from_png(m)
                rows.append((hashlib.sha256(m).hexdigest(), size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), feature(payload)))
            if rows:
                yield batch(schema, list(map(list, zip(*rows))))

    return media.select("media").mapInArrow(tidied(run), "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")
