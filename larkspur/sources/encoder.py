"""Writes table files and catalogs for tests and round trips: both word sizes and byte orders, plain, RLE and RDC."""

from __future__ import annotations

import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.functions.scalars import EPOCH_DAYS
from larkspur.sources.layout import ENCODINGS, MAGIC_CATALOG, MAGIC_TABLE

#: A column to write: name, "num" or "char", width, format, label, values.
Column = tuple[str, str, int, str, str, list]


def missing(tag: str = ".") -> float:
    """The NaN that stands for a missing value with a tag."""
    code = {"_": 0, ".": 0xD1 ^ 0xFF}.get(tag)
    code = ord(tag) - 63 if code is None else code
    return struct.unpack("<d", struct.pack("<Q", 0xFFFF << 48 | (~code & 255) << 40))[0]


#: Runs that the two compressions shorten: of 3 bytes at least, and of 17 or 18 at most; RDC's single bytes too.
RLE_RUNS, RDC_PARTS = re.compile(rb"(.)\1{2,16}", re.S), re.compile(rb"(.)\1{2,17}|.", re.S)


def _rle(row: bytes) -> bytes:
    out, i = bytearray(), 0
    for m in [*RLE_RUNS.finditer(row), None]:
        start, end = m.span() if m else (len(row), len(row))
        for j in range(i, start, 16):
            part = row[j : min(j + 16, start)]
            out.append(0x80 | len(part) - 1)
            out += part
        if m:
            mark = {0x40: 0xD0, 0x20: 0xE0, 0: 0xF0}.get(row[start])
            out += bytes([mark | end - start - 2]) if mark else bytes([0xC0 | end - start - 3, row[start]])
        i = end
    return bytes(out)


def _rdc(row: bytes) -> bytes:
    out, parts = bytearray(), [m.group() for m in RDC_PARTS.finditer(row)]
    for i in range(0, len(parts), 16):
        control, body = 0, bytearray()
        for bit, part in enumerate(parts[i : i + 16]):
            if len(part) > 1:
                control |= 0x8000 >> bit
                body += bytes([len(part) - 3, part[0]])
            else:
                body += part
        out += struct.pack(">H", control) + body
    return bytes(out)


@dataclass
class Form:
    """How a table is written; it goes to tasks, so it holds no rows.  columns: name, "num" or "char", width, format, label.

    mix: the first rows share the last meta page.  compression "raw": rows as they are, behind pointers.
    """

    columns: list[tuple[str, str, int, str, str]]
    wide: bool = True
    little: bool = True
    pad: bool = True
    compression: str = "none"
    page_size: int = 8192
    encoding: int = 20
    name: str = "TABLE"
    label: str = ""
    mix: bool = False

    def __post_init__(self):
        self.order, self.word_size = "<" if self.little else ">", 8 if self.wide else 4
        self.codec = ENCODINGS[self.encoding][1] or "utf-8"
        self.head, self.ptr = (40, 24) if self.wide else (24, 12)
        self.offsets, self.length = [0] * len(self.columns), 0
        for k in sorted(range(len(self.columns)), key=lambda k: self.columns[k][1] != "num"):  # numbers first
            self.offsets[k], self.length = self.length, self.length + self.columns[k][2]

    def rows(self, values: list) -> np.ndarray:
        """n x row_length bytes of each column's values: a list, or for numbers an array, whose NaNs are missing."""
        n = len(values[0])
        rows = np.zeros((n, self.length), np.uint8)
        for (_, kind, width, _, _), o, column in zip(self.columns, self.offsets, values, strict=True):
            if kind == "num":
                raw = np.where(np.isnan(column), missing(), column) if isinstance(column, np.ndarray) else np.array([missing() if v is None else v for v in column], np.float64)
                full = raw.astype("<f8" if self.little else ">f8").view(np.uint8).reshape(n, 8)
                rows[:, o : o + width] = full[:, 8 - width :] if self.little else full[:, :width]
            else:
                packed = b"".join((v if isinstance(v, bytes) else (v or "").encode(self.codec))[:width].ljust(width) for v in column)
                rows[:, o : o + width] = np.frombuffer(packed, np.uint8).reshape(n, width)
        return rows

    def page(self, kind: int, blocks: int, parts: list[tuple[bytes, int, int]], area: bytes = b"") -> bytes:
        """parts: payload, compression and type of each pointer."""
        buf = bytearray(self.page_size)
        buf[self.head - 8 : self.head - 2] = struct.pack(self.order + "3H", kind, blocks, len(parts))
        end = self.page_size
        for i, (raw, comp, flag) in enumerate(parts):
            end -= len(raw)
            buf[end : end + len(raw)] = raw
            at = self.head + i * self.ptr
            buf[at : at + self.ptr] = (self._word(end) + self._word(len(raw)) + bytes([comp, flag])).ljust(self.ptr, b"\0")
        start = self._area(len(parts))
        assert start + len(area) <= end, "page is too small"
        buf[start : start + len(area)] = area
        return bytes(buf)

    def _word(self, v: int) -> bytes:
        return struct.pack(self.order + ("Q" if self.wide else "I"), v)

    def _sign(self, v: int) -> bytes:
        e = self.order
        if not self.wide:
            return struct.pack(e + "I", v)
        return struct.pack(e + ("q" if v >= 0xFF000000 else "Q"), v - (1 << 32) if v >= 0xFF000000 else v) if self.little or v >= 0xFF000000 else struct.pack(e + "I", v) + b"\0\0\0\0"

    def _area(self, n_pointers: int) -> int:
        return -(-(self.head + n_pointers * self.ptr) // 8) * 8

    def _plan(self, n: int) -> list[list[bytes]]:
        """Subheaders of each meta page; the first one states n rows."""
        e, s, columns, page_size, head, ptr, word, sign = self.order, self.word_size, self.columns, self.page_size, self.head, self.ptr, self._word, self._sign

        # texts in blobs of less than 32 kB
        blobs: list[bytearray] = [bytearray(b"\0" * 16)]

        def put(text: str) -> tuple[int, int, int]:
            raw = text.encode(self.codec)
            if not raw:
                return 0, 0, 0
            if len(blobs[-1]) + len(raw) > min(30_000, page_size - head - 4 * ptr - 64):
                blobs.append(bytearray(b"\0" * 16))
            at = len(blobs[-1])
            blobs[-1] += raw.ljust(-(-len(raw) // 4) * 4)
            return len(blobs) - 1, at, len(raw)

        comp_ref = put({"none": "", "rle": "SASYZCRL", "rdc": "SASYZCR2", "raw": "SASYZCRL"}[self.compression])
        label_ref = put(self.label)
        refs = [(put(c[0]), put(c[3]), put(c[4])) for c in columns]
        ref = lambda r: struct.pack(e + "3H", *r)

        size = bytearray(808 if self.wide else 480)
        size[:s] = sign(0xF7F7F7F7)
        for at, v in ((40, self.length), (48, n), (72, len(columns))) if self.wide else ((20, self.length), (24, n), (36, len(columns))):
            size[at : at + s] = word(v)
        size[-130:-124], size[-118:-112] = ref(label_ref), ref(comp_ref)
        count = sign(0xF6F6F6F6) + word(len(columns)) + bytes(s)
        texts = []
        for b in blobs:
            b[:2] = struct.pack(e + "H", len(b))
            texts.append(sign(0xFFFFFFFD) + bytes(b))
        subs: list[bytes] = []
        room = (page_size - head) // 2
        per = max(1, (room - 2 * s - 12 - ptr) // 8)
        for i in range(0, len(columns), per):
            part = b"".join(ref(r[0]) + b"\0\0" for r in refs[i : i + per])
            subs.append(sign(0xFFFFFFFF) + struct.pack(e + "H", len(part) + 8) + bytes(6) + part + bytes(s + 4))
        per = max(1, (room - 2 * s - 12 - ptr) // (s + 8))
        for i in range(0, len(columns), per):
            part = b"".join(word(o) + struct.pack(e + "I", c[2]) + bytes([0, 0x33, 1 if c[1] == "num" else 2, 0]) for c, o in zip(columns[i : i + per], self.offsets[i : i + per], strict=True))
            subs.append(sign(0xFFFFFFFC) + struct.pack(e + "H", len(part) + 8) + bytes(6) + part + bytes(s + 4))
        for r in refs:
            at = 46 if self.wide else 34
            sub = bytearray(64 if self.wide else 52)
            sub[:s] = sign(0xFFFFFBFE)
            sub[at : at + 6], sub[at + 6 : at + 12] = ref(r[1]), ref(r[2])
            subs.append(bytes(sub))

        plan: list[list[bytes]] = [[]]
        for sub in [bytes(size), count, *texts, *subs]:
            used = head + sum(len(x) + ptr for x in plan[-1])
            if used + len(sub) + ptr + 8 > page_size:
                plan.append([])
            plan[-1].append(sub)
        return plan

    def room(self) -> int:
        """How many of the first rows the last meta page takes (mix)."""
        if not self.mix or self.compression != "none":
            return 0
        last = self._plan(0)[-1]
        return (self.page_size - self._area(len(last)) - sum(map(len, last))) // self.length

    def meta_pages(self, n: int, first: bytes = b"") -> list[bytes]:
        """Pages of metadata of a table of n rows; first: the rows on the last one."""
        plan, done = self._plan(n), len(first) // self.length
        if self.mix and self.compression == "none":
            at, size = 120 if self.wide else 60, bytearray(plan[0][0])
            size[at : at + self.word_size] = self._word(done)
            plan[0][0] = bytes(size)
        owns = [0] * (len(plan) - 1) + [done]
        return [self.page(0x200 if own else 0, own + len(parts), [(p, 0, 0) for p in parts], first if own else b"") for parts, own in zip(plan, owns, strict=True)]

    def row_pages(self, blocks: Iterable[np.ndarray]) -> Iterator[bytes]:
        """Pages of the rows of the blocks, which may be of any size."""
        if self.compression == "none":
            per = (self.page_size - self.head) // self.length
            assert per, "page is too small for a row"
            left = np.zeros((0, self.length), np.uint8)
            for rows in blocks:
                rows = np.concatenate([left, rows]) if len(left) else rows
                whole = len(rows) // per * per
                for i in range(0, whole, per):
                    yield self.page(0x100, per, [], rows[i : i + per].tobytes())
                left = rows[whole:]
            if len(left):
                yield self.page(0x100, len(left), [], left.tobytes())
            return
        pack, parts, used = {"rle": _rle, "rdc": _rdc, "raw": bytes}[self.compression], [], self.head
        for rows in blocks:
            for row in rows:
                plain = row.tobytes()
                raw = pack(plain)
                raw = raw if len(raw) < self.length else plain
                if used + len(raw) + self.ptr + 8 > self.page_size:
                    yield self.page(0, len(parts), parts)
                    parts, used = [], self.head
                parts.append((raw, 4 if len(raw) < self.length else 0, 1))
                used += len(raw) + self.ptr
        if parts:
            yield self.page(0, len(parts), parts)

    def header(self, n_pages: int) -> bytes:
        return header_bytes(MAGIC_TABLE, self.wide, self.little, self.pad, self.encoding, self.name, self.page_size, n_pages)


def write_table(path: str, columns: list[Column], **options) -> None:
    """Writes a table whose values are at hand; options: those of Form."""
    form = Form([c[:5] for c in columns], **options)
    rows = form.rows([c[5] for c in columns])
    done = min(len(rows), form.room())
    pages = form.meta_pages(len(rows), rows[:done].tobytes()) + list(form.row_pages([rows[done:]]))
    with open(path, "wb") as f:
        f.write(form.header(len(pages)) + b"".join(pages))


def write_frame(df: DataFrame, path: str, *, formats: dict[str, str] | None = None, labels: dict[str, str] | None = None, **options) -> None:
    """Writes a DataFrame's numbers, texts and datetimes (wall clock) as a table, in the order of its partitions.

    path lies in a folder that the driver and all executors share.  Tasks encode the rows and write their pages beside it;
    the driver gets counts, at most a page of rows (mix), and joins the parts to one file.
    """
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    kinds = {}
    for c, t in df.dtypes:
        kinds[c] = "time" if t.startswith("timestamp") else "char" if t == "string" else "num"
        if kinds[c] == "num" and t not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not t.startswith("decimal"):
            raise TypeError(f"column {c}: {t} can't be written")
    codec = ENCODINGS[options.get("encoding", 20)][1] or "utf-8"
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    texts = [c for c in df.columns if kinds[c] == "char"]
    if codec == "utf-8" and texts:
        widths = dict(zip(texts, df.agg(*(F.max(F.octet_length(col(c))).alias(f"w{k}") for k, c in enumerate(texts))).first(), strict=True))
    elif texts:
        raise ValueError("texts of a DataFrame are written as UTF-8")
    else:
        widths = {}
    usual = {"time": "DATETIME22.3", "num": "BEST12.", "char": "$CHAR."}
    form = Form([(c, "char" if c in widths else "num", max(1, widths[c] or 0) if c in widths else 8, (formats or {}).get(c, usual[kinds[c]]), (labels or {}).get(c, "")) for c in df.columns], **options)
    typed = df.select(*(col(c).cast({"time": "timestamp_ntz", "num": "double", "char": "string"}[kinds[c]]).alias(f"c{k}") for k, c in enumerate(df.columns)))
    parts, room, plan = f"{path}.parts", form.room(), list(kinds.values())
    os.makedirs(parts)

    def block(batch: pa.RecordBatch) -> np.ndarray:
        values = []
        for kind, array in zip(plan, batch.columns, strict=True):
            if kind == "char":
                values.append(array.to_pylist())
            elif kind == "num":
                values.append(array.to_numpy(zero_copy_only=False))
            else:
                micros = array.cast(pa.int64())
                at = np.asarray(micros.fill_null(0))
                day = at // 86_400_000_000
                seconds = (at - day * 86_400_000_000) / 1e6 + (day + EPOCH_DAYS) * 86400.0
                values.append(np.where(np.asarray(micros.is_null()), np.nan, seconds))
        return form.rows(values)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(batch.num_rows for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["p", "n"])

    # of a mixed table, the first rows are held back: how many rows come before each partition has to be known
    at_most: dict[int, int] = {}
    if room:
        left = room
        for p, n in sorted(map(tuple, typed.mapInArrow(count, "p long, n long").collect())):
            at_most[p] = min(n, left)
            left -= at_most[p]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, pages, first = TaskContext.get().partitionId(), 0, 0, []
        hold = at_most.get(number, 0)
        name = os.path.join(parts, uuid.uuid4().hex)  # each attempt has its own; those that don't return aren't used

        def blocks():
            nonlocal n, hold
            for batch in batches:
                if batch.num_rows:
                    rows = block(batch)
                    n += len(rows)
                    if hold:
                        first.append(rows[:hold].tobytes())
                        rows, hold = rows[hold:], max(0, hold - len(rows))
                    yield rows

        with open(name, "wb") as f:
            for page in form.row_pages(blocks()):
                f.write(page)
                pages += 1
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), pa.array([pages]), pa.array([n]), pa.array([b"".join(first)], pa.binary())], names=["p", "name", "pages", "n", "first"])

    done = sorted(typed.mapInArrow(write, "p long, name string, pages long, n long, first binary").collect(), key=lambda r: r["p"])
    meta = form.meta_pages(sum(r["n"] for r in done), b"".join(bytes(r["first"]) for r in done))
    with open(path, "wb") as f:
        f.write(form.header(len(meta) + sum(r["pages"] for r in done)) + b"".join(meta))
        for r in done:
            with open(r["name"], "rb") as part:
                shutil.copyfileobj(part, f, 1 << 20)
            os.remove(r["name"])
    shutil.rmtree(parts, ignore_errors=True)


def header_bytes(magic: bytes, wide: bool, little: bool, pad: bool, encoding: int, name: str, page_size: int, n_pages: int, kind: str = "DATA") -> bytes:
    e, p = "<" if little else ">", 4 if pad else 0
    buf = bytearray(8192 if wide else 1024)
    buf[:32] = magic
    buf[32], buf[35], buf[37], buf[39], buf[70] = 0x33 if wide else 0x22, 0x33 if pad else 0x22, int(little), 0x31, encoding
    buf[84:92], buf[92:156], buf[156:164] = b"SAS FILE", name.encode()[:64].ljust(64), kind.encode().ljust(8)
    stamp = 2_000_000_000.0
    buf[164 + p : 196 + p] = struct.pack(e + "4d", stamp, stamp, 0, 0)
    buf[196 + p : 204 + p] = struct.pack(e + "2I", len(buf), page_size)
    at = 204 + p
    buf[at : at + (8 if wide else 4)] = struct.pack(e + ("Q" if wide else "I"), n_pages)
    at += 16 if wide else 12
    buf[at : at + 8] = b"9.0401M5"
    return bytes(buf)


def number_key(value: float) -> bytes:
    """Eight bytes of a numeric label key: a value that isn't negative has its sign flipped, others all bits."""
    flipped = struct.pack(">d", -value)
    return flipped if value >= 0 else bytes(b ^ 255 for b in struct.pack(">d", value))


def write_catalog(path: str, sets: list[tuple[str, list[tuple]]], *, little: bool = True, page_size: int = 4096, encoding: int = 20) -> None:
    """64-bit catalog.  sets: (name, [(key, label)]); a name that begins with $ has string keys, a key ".A" is a tag."""
    e = "<" if little else ">"
    blocks = []
    for name, labels in sets:
        string = name.startswith("$")
        long_name = len(name) > 8
        buf = bytearray(106 + 32)
        buf[2:4] = struct.pack(e + "H", 0x20 if long_name else 0)
        buf[8:16] = name.encode()[:8].ljust(8)
        buf[42:58] = struct.pack(e + "2Q", len(labels), len(labels))
        if long_name:
            buf += name.encode()[:32].ljust(32)
        for i, (key, _) in enumerate(labels):
            entry = bytearray(24 + 16 if string else 30)
            entry[2:4] = struct.pack(e + "H", len(entry) - 6)
            entry[10:14] = struct.pack(e + "I", i)
            if string:
                entry[-16:] = key.encode()[:16].ljust(16)
            elif isinstance(key, str):
                tag = {".": 1, "._": 0}.get(key, ord(key[-1]) - 63)
                entry[22:30] = (tag << 40 | 0xFFFFFFFFFF).to_bytes(8, "big")
            else:
                entry[22:30] = number_key(float(key))
            buf += entry
        for _, label in labels:
            raw = label.encode()
            buf += bytes(8) + struct.pack(e + "H", len(raw)) + raw + b"\0"
        blocks.append(bytes(buf))
    # page 1 (0-based) is the index, blocks follow from page 2 in links of one page each
    pages: list[bytearray] = [bytearray(page_size), bytearray(page_size)]
    at = 856 + 144
    entries = []
    for block in blocks:
        parts = [block[i : i + page_size - 64] for i in range(0, len(block), page_size - 64)]
        first = len(pages) + 1
        for k, part in enumerate(parts):
            buf = bytearray(page_size)
            more = k + 1 < len(parts)
            buf[24 : 24 + 32] = struct.pack(e + "I", first + k + 1 if more else 0) + bytes(4) + struct.pack(e + "2H", 24 if more else 0, len(part)) + bytes(20)
            buf[56 : 56 + len(part)] = part
            pages.append(buf)
        entry = bytearray(212 + 72)
        entry[:4] = b"XLSR"
        entry[8:18] = struct.pack(e + "QH", first, 24)
        entry[50 + 24] = ord("O")
        entries.append(bytes(entry))
    area = b"".join(entries)
    assert at + len(area) <= page_size, "index page is too small"
    pages[1][at : at + len(area)] = area
    with open(path, "wb") as f:
        f.write(header_bytes(MAGIC_CATALOG, True, little, False, encoding, "FORMATS", page_size, len(pages), "CATALOG") + b"".join(pages))
