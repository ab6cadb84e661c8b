"""Label catalogs: sets of value labels, from index pages, block chains, value and label entries."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from larkspur.errors import Corrupted
from larkspur.sources.layout import Header, decode_text, parse_header


@dataclass
class Label:
    key_kind: str  # "number", "tag" or "string"
    number: float | None
    tag: str | None
    string: str | None
    label: str


@dataclass
class LabelSet:
    name: str
    numeric: bool
    labels: list[Label] = field(default_factory=list)


def numeric_key(raw: int) -> Label:
    """Key of a numeric value label from its eight big-endian bytes; the label is filled in later."""
    if raw >> 48 == 0 and raw & 0xFFFFFFFFFF == 0xFFFFFFFFFF:
        tag = raw >> 40 & 255
        return Label("tag", None, "_" if tag == 0 else chr(63 + tag) if 2 <= tag <= 27 else ".", None, "")
    value = struct.unpack(">d", raw.to_bytes(8, "big"))[0]
    if value > 0:
        value = struct.unpack(">d", (raw ^ 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big"))[0]
    else:
        value = -value
    return Label("number", value, None, None, "")


def read_catalog(read) -> list[LabelSet]:
    h = parse_header(read, catalog=True)
    stride, start, mark = 212 + h.pad, 856 + 2 * h.pad, 50 + h.pad
    if h.wide:
        stride, start, mark = stride + 72, start + 144, mark + 24
    pointers: set[tuple[int, int]] = set()
    for i in range(1, h.page_count):
        page = read(h.size + i * h.page_size, h.page_size)
        if i == 1:
            pointers |= _index(h, page[start:], stride, mark)
        elif i >= 3 and page[16:20] == b"XLSR":
            pointers |= _index(h, page[16:], stride, mark)
    sets = (_block(h, _chain(h, read, page, at)) for page, at in sorted(pointers))
    return [s for s in sets if s is not None]


def _index(h: Header, data: bytes, stride: int, mark: int) -> set[tuple[int, int]]:
    out, at = set(), 0
    while at + stride <= len(data):
        if data[at : at + 4] != b"XLSR":
            at += 8
            continue
        if data[at + mark : at + mark + 1] == b"O":
            page, pos = (h.unpack("Q", data, at + 8), h.unpack("H", data, at + 16)) if h.wide else (h.unpack("I", data, at + 4), h.unpack("H", data, at + 8))
            if page > 0 and pos > 0 and page <= h.page_count + 1:
                out.add((page, pos))
        at += stride
    return out


def _chain(h: Header, read, page: int, pos: int) -> bytes:
    head, out = 32 if h.wide else 16, bytearray()
    for _ in range(h.page_count + 1):  # more links than pages: a cycle
        if not (0 < page <= h.page_count and pos):
            break
        at = h.size + (page - 1) * h.page_size + pos
        link = read(at, head)
        if len(link) < head:
            break
        length = h.unpack("H", link, 10 if h.wide else 6)
        out += read(at + head, length)
        page, pos = h.unpack("I", link, 0), h.unpack("H", link, 8 if h.wide else 4)
    return bytes(out)


def _block(h: Header, data: bytes) -> LabelSet | None:
    if len(data) < 106:
        return None
    flags = h.unpack("H", data, 2)
    pad = 4 if flags & 8 else 0
    if h.wide:
        capacity, used, area = h.unpack("Q", data, 42 + pad), h.unpack("Q", data, 50 + pad), 106 + 32
    else:
        capacity, used, area = h.unpack("I", data, 38 + pad), h.unpack("I", data, 42 + pad), 106
    area += pad + 16 if pad else 0
    name = data[8:16]
    if flags & (0x20 if h.wide else 0x80):
        name, area = data[area : area + 32], area + 32
        if len(name) < 32:
            raise Corrupted("catalog", "long name is cut off")
    if not used:
        return None
    out = LabelSet(decode_text(name, h.codec).rstrip(), data[8:9] != b"$")
    body = data[area:]
    spots, at = [0] * used, 0
    for i in range(capacity):
        if at + 6 > len(body):
            raise Corrupted("catalog", "value entry is cut off")
        size = 6 + h.unpack("H", body, at + 2)
        if at + size > len(body):
            raise Corrupted("catalog", "value entry exceeds its block")
        if i < used:
            order = h.unpack("I", body, at + 10 + pad)
            if order >= used:
                raise Corrupted("catalog", "label index out of range")
            spots[order] = at
        at += size
        if at >= len(body):
            break
    for spot in spots:
        size = 6 + h.unpack("H", body, spot + 2)
        entry = body[spot : spot + size]
        if out.numeric:
            if size < 30:
                raise Corrupted("catalog", "numeric value entry too short")
            label = numeric_key(int.from_bytes(entry[22:30], "big"))
        else:
            if size < 16:
                raise Corrupted("catalog", "string value entry too short")
            label = Label("string", None, None, decode_text(entry[-16:], h.codec), "")
        if at + 10 > len(body):
            raise Corrupted("catalog", "label entry is cut off")
        n = min(h.unpack("H", body, at + 8), len(body) - at - 10)
        label.label = decode_text(body[at + 10 : at + 10 + n], h.codec)
        out.labels.append(label)
        at += 8 + 2 + n + 1
    return out
