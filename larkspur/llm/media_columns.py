"""Interleaved document sequences: HTML to ordered text and media references, payloads resolved by digest.

``media_store`` keeps payloads by digest in a lossless image form (8-bit grey PNG, 64 samples a row).  ``interleave``
parses HTML into an ordered array of text and media structs, resolves the references in one digest join, and puts
position, caption and what the stored media yields side by side.  Payloads never move: features come from the stored
bytes where they lie, and only digests and features are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Workspace, small_batches

#: Samples in a row of the stored image.
WIDTH = 64
SCHEME = "sha256:"
_PNG = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 0 appended, up to a positive multiple of unit."""
    return raw + b"\0" * ((-len(raw)) % unit if raw else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey PNG of a payload whose length is a multiple of width; no filter, so samples are the bytes."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def read_png(media: bytes) -> np.ndarray:
    """Samples of a PNG that write_png made, height x width; checks every chunk's sum."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, shape, data = 8, (0, 0), []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def describe(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy in bits, and mean of the four quarters of the height; integers of 1/1000."""
    height, width = samples.shape
    count = np.bincount(samples.ravel(), minlength=256)
    p = count[count > 0] / samples.size
    values = np.arange(256)
    mean = int(count @ values) / samples.size
    dev = (max(int(count @ (values * values)) / samples.size - mean * mean, 0)) ** 0.5
    quarters = [int(x.sum(dtype=np.int64)) * 1000 // max(x.size, 1) for x in np.array_split(samples, 4)]
    return f"{width}x{height};mean={round(mean * 1000)};dev={round(dev * 1000)};bits={round(float(-(p * np.log2(p)).sum()) * 1000)};q=" + ",".join(map(str, quarters))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, size, media = [], [], []
        for x in batch.column("_raw").cast(pa.binary()):
            raw = x.as_py() or b""
            digest.append(hashlib.sha256(raw).hexdigest())
            size.append(len(raw))
            media.append(write_png(pad(raw)))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["_id", "digest", "n_bytes", "media"])


def media_store(docs: DataFrame, workspace: Workspace, *, id_col: str, raw_col: str) -> DataFrame:
    """Writes one image for each row: id, digest (of the raw bytes), n_bytes (unpadded), media (PNG).

    Null: as no bytes.  Equal payloads have equal images.  Ids may be null, repeated, and of any kind.  A payload of any
    length is one image, which its task holds.  Empty table: empty result.  Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession, 256)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(raw_col).alias("_raw"))
    return workspace.store(rows.mapInArrow(_encode, f"_id {kind}, digest string, n_bytes long, media binary").withColumnRenamed("_id", id_col))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, x in zip(batch.column("digest"), batch.column("media"), strict=True):
            media = x.as_py()
            samples = read_png(media)
            payload = samples.tobytes()
            rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["digest", *(f.split()[0] for f in FEATURES.split(", "))])


def media_features(store: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes read back.  Damaged media are an error.  Repeated rows give one; an
    empty table none."""
    rows = store.select("digest", "media").mapInArrow(_features, f"digest string, {FEATURES}")
    names = [f.split()[0] for f in FEATURES.split(", ")]
    return rows.groupBy("digest").agg(*(F.min(c).alias(c) for c in names))


class _Reader(HTMLParser):
    """Text and media references in document order; a figure's caption, wherever it stands in it, belongs to its media."""

    SKIP = {"script", "style", "template", "title", "noscript"}
    MEDIA = {"img", "audio", "video", "source", "embed"}
    BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "blockquote", "pre", "figure", "table", "ul", "ol", "br", "nav", "body", "html"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.held: str | None = None

    def end_figure(self) -> None:
        for i in self.figure if self.held else ():
            self.items[i]["caption"] = self.held
        self.figure, self.held = [], None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.MEDIA:
            got = dict(attrs)
            if got.get("src"):
                self.flush()
                self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": got["src"], "caption": " ".join((got.get("alt") or "").split()) or None})
        if tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.end_figure()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.held, self.caption = " ".join("".join(self.caption).split()) or self.held, None
        elif tag == "figure":
            self.end_figure()
        if tag in self.BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str) -> list[dict]:
    """Structs position, kind (text, media), text, ref, caption, in document order."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    reader.end_figure()
    return [{"position": i, **x} for i, x in enumerate(reader.items)]


ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [parse_sequence(x.as_py() or "") for x in batch.column("_html")]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(items, ITEMS)], names=["_id", "items"])


def interleave(pages: DataFrame, features: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """One row for each item of each page: id, position, kind, text, ref, caption, and the features of its media.

    References are resolved by digest (``sha256:<hex>``); others and unknown digests keep null features.  A figure's last
    caption goes to all its media, an alt text to its own.  Null or empty HTML: no items.  Repeated rows are parsed each on
    its own; ids may be null and of any kind.  A very long page is parsed whole.  Empty table: empty result.  Other columns
    of pages are ignored, whatever their names.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = (
        pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
        .mapInArrow(_parse, f"_id {kind}, items array<struct<position:int,kind:string,text:string,ref:string,caption:string>>")
        .select(F.col("_id").alias(id_col), F.explode("items").alias("item"))
        .select(id_col, "item.*")
    )
    digest = F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64))
    return rows.withColumn("_digest", digest).join(features.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def figure_html(digest: Column, caption: Column) -> Column:
    """An article of one figure that refers to its payload by digest."""
    return F.concat(F.lit(f"<article><figure><img src='{SCHEME}"), digest, F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure></article>"))
