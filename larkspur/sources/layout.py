"""Layout of the binary table format: header, page scan, column metadata.  Pure Python, no Spark."""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from larkspur.errors import Corrupted, InvalidMetadata, Unsupported, warn
from larkspur.functions.formats import FORMAT_KINDS

#: Fixed values of the format: magic numbers of tables and of label catalogs.
MAGIC_TABLE = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")
MAGIC_CATALOG = bytes.fromhex("000000000000000000000000c2ea8163b31411cfbd92080009c7318c181f1011")

#: Encoding byte of the header, its name, the Python codec for it (None: none; text is read as UTF-8).
ENCODINGS = {
    0: ("WINDOWS-1252", "cp1252"), 20: ("UTF-8", "utf-8"), 28: ("US-ASCII", "ascii"), 29: ("ISO-8859-1", "latin-1"),
    30: ("ISO-8859-2", "iso8859-2"), 31: ("ISO-8859-3", "iso8859-3"), 32: ("ISO-8859-4", "iso8859-4"), 33: ("ISO-8859-5", "iso8859-5"),
    34: ("ISO-8859-6", "iso8859-6"), 35: ("ISO-8859-7", "iso8859-7"), 36: ("ISO-8859-8", "iso8859-8"), 37: ("ISO-8859-9", "iso8859-9"),
    39: ("ISO-8859-11", "iso8859-11"), 40: ("ISO-8859-15", "iso8859-15"), 41: ("CP437", "cp437"), 42: ("CP850", "cp850"),
    43: ("CP852", "cp852"), 44: ("CP857", "cp857"), 45: ("CP858", "cp858"), 46: ("CP862", "cp862"), 47: ("CP864", "cp864"),
    48: ("CP865", "cp865"), 49: ("CP866", "cp866"), 50: ("CP869", "cp869"), 51: ("CP874", "cp874"), 52: ("CP921", None),
    53: ("CP922", None), 54: ("CP1129", None), 55: ("CP720", "cp720"), 56: ("CP737", "cp737"), 57: ("CP775", "cp775"),
    58: ("CP860", "cp860"), 59: ("CP863", "cp863"), 60: ("WINDOWS-1250", "cp1250"), 61: ("WINDOWS-1251", "cp1251"),
    62: ("WINDOWS-1252", "cp1252"), 63: ("WINDOWS-1253", "cp1253"), 64: ("WINDOWS-1254", "cp1254"), 65: ("WINDOWS-1255", "cp1255"),
    66: ("WINDOWS-1256", "cp1256"), 67: ("WINDOWS-1257", "cp1257"), 68: ("WINDOWS-1258", "cp1258"), 69: ("MACROMAN", "mac-roman"),
    70: ("MACARABIC", "mac-arabic"), 71: ("MACHEBREW", None), 72: ("MACGREEK", "mac-greek"), 73: ("MACTHAI", None),
    75: ("MACTURKISH", "mac-turkish"), 76: ("MACUKRAINE", "mac-cyrillic"), 118: ("CP950", "cp950"), 119: ("EUC-TW", None),
    123: ("BIG-5", "big5"), 125: ("GB18030", "gb18030"), 126: ("WINDOWS-936", "gbk"), 128: ("CP1381", None), 134: ("EUC-JP", "euc-jp"),
    136: ("CP949", "cp949"), 137: ("CP942", "cp932"), 138: ("CP932", "cp932"), 140: ("EUC-KR", "euc-kr"), 141: ("CP949", "cp949"),
    142: ("CP949", "cp949"), 163: ("MACICELAND", "mac-iceland"), 167: ("ISO-2022-JP", "iso2022-jp"), 168: ("ISO-2022-KR", "iso2022-kr"),
    169: ("ISO-2022-CN", None), 172: ("ISO-2022-CN-EXT", None), 204: ("WINDOWS-1252", "cp1252"), 205: ("GB18030", "gb18030"),
    227: ("ISO-8859-14", "iso8859-14"), 242: ("ISO-8859-13", "iso8859-13"), 245: ("MACCROATIAN", "mac-croatian"),
    246: ("MACCYRILLIC", "mac-cyrillic"), 247: ("MACROMANIA", "mac-romanian"), 248: ("SHIFT_JISX0213", "shift_jisx0213"),
}

EPOCH = dt.datetime(1960, 1, 1)
RELEASE = re.compile(r"^([1-9V])\.(\d{4})([MJ])(\d)")
MEASURES = {1: "nominal", 2: "ordinal", 3: "scale"}
ALIGNMENTS = {1: "left", 2: "center", 3: "right"}
#: Compression names in the file, and what they mean.
COMPRESSIONS = {"SASYZCRL": "row", "SASYZCR2": "binary"}
#: Subheader signatures.
ROW_SIZE, COLUMN_SIZE, TEXT, NAME, ATTRS, FORMAT, LIST, COUNTS = 0xF7F7F7F7, 0xF6F6F6F6, 0xFFFFFFFD, 0xFFFFFFFF, 0xFFFFFFFC, 0xFFFFFBFE, 0xFFFFFFFE, 0xFFFFFC00
SIGNATURES = {ROW_SIZE, COLUMN_SIZE, TEXT, NAME, ATTRS, FORMAT, LIST, COUNTS}


@dataclass
class Header:
    wide: bool
    little: bool
    pad: int
    encoding: str
    codec: str | None
    table_name: str
    created: dt.datetime | None
    modified: dt.datetime | None
    size: int
    page_size: int
    page_count: int
    release: str
    catalog: bool = False

    @property
    def order(self) -> str:
        return "<" if self.little else ">"

    @property
    def page_header(self) -> int:
        return 40 if self.wide else 24

    @property
    def pointer(self) -> int:
        return 24 if self.wide else 12

    @property
    def signature(self) -> int:
        return 8 if self.wide else 4

    @property
    def vendor(self) -> str:
        m = RELEASE.match(self.release)
        return "StatTransfer" if m and m[1] in "89" and m[2] == "0000" and m[4] == "0" else "SAS"

    def unpack(self, form: str, data: bytes, at: int) -> int:
        return struct.unpack_from(self.order + form, data, at)[0]

    def word(self, data: bytes, at: int) -> int:
        return self.unpack("Q" if self.wide else "I", data, at)


@dataclass
class Variable:
    index: int
    name: str = ""
    label: str = ""
    format: str = ""
    format_width: int | None = None
    format_decimals: int | None = None
    offset: int = 0
    width: int = 0
    numeric: bool = True
    measure: str = "unknown"
    alignment: str = "unknown"

    @property
    def kind(self) -> str:
        return infer_kind(self.format) if self.numeric else "character"


@dataclass
class Layout:
    header: Header
    row_length: int = 0
    row_count: int = 0
    mix_rows: int = 0
    compression: str = "none"
    file_label: str = ""
    variables: list[Variable] = field(default_factory=list)
    column_list: list[int] = field(default_factory=list)
    pages: list[tuple[int, int, int]] = field(default_factory=list)  # (page, rows, first row)


def infer_kind(format_name: str) -> str:
    """double, date, datetime or time, from the name of a numeric variable's format."""
    name = (format_name or "").strip().strip(".").strip().upper()
    for kind, inside, starts, ends in FORMAT_KINDS:
        if any(x in name for x in inside) or name.startswith(starts) or name.endswith(ends):
            return kind
    return "double"


#: Names of Macintosh encodings that Python spells otherwise.
MAC_NAMES = {"macroman": "mac-roman", "macarabic": "mac-arabic", "macgreek": "mac-greek", "macturkish": "mac-turkish", "macukraine": "mac-cyrillic", "maccyrillic": "mac-cyrillic", "maciceland": "mac-iceland", "maccroatian": "mac-croatian", "macromania": "mac-romanian", "macintosh": "mac-roman"}


def resolve_encoding(label: str) -> str:
    """Python codec of an encoding's name: any case, _ for -, names of Macintosh encodings; UTF-8 if there is none."""
    import codecs

    name = label.strip().lower().replace("_", "-")
    for x in (MAC_NAMES.get(name, name), name.replace("windows-", "cp")):
        try:
            return codecs.lookup(x).name
        except LookupError:
            continue
    return "utf-8"


def decode_text(raw: bytes, codec: str | None) -> str:
    """Trailing blanks and NULs go; UTF-8 if it is valid, else the declared encoding, else with replacements."""
    raw = raw.rstrip(b" \0")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(codec or "utf-8", "replace").rstrip(" \0")


def repair_mojibake(text: str) -> str:
    """UTF-8 that was decoded as Latin-1 is decoded again."""
    if not text or text.isascii() or max(text) > "ÿ":
        return text
    try:
        return text.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return text


def _swapped(value: int, size: int) -> int:
    return int.from_bytes(value.to_bytes(size, "little"), "big")


def parse_header(read, catalog: bool | None = None) -> Header:
    """read(offset, n) -> bytes.  Checks the magic number and all fields that reading depends on."""
    head = read(0, 288 + 8)
    if len(head) < 288:
        raise Corrupted("header", "file is too short")
    magic = head[:32]
    if magic not in (MAGIC_TABLE, MAGIC_CATALOG) or catalog is not None and (magic == MAGIC_CATALOG) != catalog:
        raise Corrupted("header", "magic number does not match")
    wide, pad, little = head[32] == 0x33, 4 if head[35] == 0x33 else 0, head[37] == 1
    if head[37] not in (0, 1):
        raise Corrupted("header", "unknown byte order")
    if head[70] not in ENCODINGS:
        raise Unsupported(f"encoding byte {head[70]}")
    encoding, codec = ENCODINGS[head[70]]
    e = "<" if little else ">"
    created, modified, d1, d2 = struct.unpack_from(e + "4d", head, 164 + pad)
    size, page_size = struct.unpack_from(e + "2I", head, 196 + pad)
    at = 204 + pad
    pages = struct.unpack_from(e + ("Q" if wide else "I"), head, at)[0]
    if not 1 << 10 <= page_size <= 1 << 24:
        page_size = _swapped(page_size, 4)
    if not 1 << 10 <= page_size <= 1 << 24:
        raise Corrupted("header", "page size is out of range")
    if pages > 1 << 24:
        pages = next((p for p in (_swapped(pages, 8 if wide else 4), pages & 0xFFFFFFFF) if p <= 1 << 24), None)
        if pages is None:
            raise Corrupted("header", "page count is out of range")
    release = head[at + (16 if wide else 12) :][:8].rstrip(b" \0").decode("latin-1")
    stamp = lambda t, d: _moment(t - d)
    name = decode_text(head[92:156], codec)
    return Header(wide, little, pad, encoding, codec, name, stamp(created, d1), stamp(modified, d2), size, page_size, pages, release, magic == MAGIC_CATALOG)


def _moment(seconds: float) -> dt.datetime | None:
    try:
        return EPOCH + dt.timedelta(seconds=seconds)
    except (OverflowError, ValueError):
        return None


def page_kind(kind: int) -> str:
    if kind & 0x9000 == 0x9000:
        return "comp"
    if kind & 0x8000:
        return "comp_table"
    if kind & 0x4000:
        return "meta2"
    return {0: "meta", 0x100: "data", 0x200: "mix", 0x400: "amd"}.get(kind & 0x0F00, "unknown")


@dataclass
class Pointer:
    offset: int
    length: int
    compression: int
    kind: int


def page_parts(h: Header, page: bytes) -> tuple[str, int, list[Pointer]]:
    """Kind, rows or blocks stated, and the subheader pointers that fit into the page."""
    n = h.page_header
    kind, blocks, subheaders = struct.unpack_from(h.order + "3H", page, n - 8)
    name = page_kind(kind)
    most = (h.page_size - n) // h.pointer
    if subheaders > most:
        warn(f"{subheaders} subheaders stated, {most} fit into the page")
        subheaders = most
    out = []
    for i in range(subheaders):
        at = n + i * h.pointer
        if at + h.pointer > len(page):
            break
        w = 8 if h.wide else 4
        out.append(Pointer(h.word(page, at), h.word(page, at + w), page[at + 2 * w], page[at + 2 * w + 1]))
    return name, blocks, out


def _signature(h: Header, page: bytes, at: int) -> int:
    first = h.unpack("I", page, at)
    if h.wide and not h.little and first == 0xFFFFFFFF:
        return h.unpack("I", page, at + 4)
    return h.unpack("I", page, at)


def in_page(h: Header, p: Pointer) -> bool:
    return p.length > 0 and p.offset >= h.page_header and p.offset + p.length <= h.page_size


def row_pointers(h: Header, page: bytes, pointers: list[Pointer], row_length: int) -> list[tuple[Pointer, int]]:
    """Pointers whose payload is rows, with how many.  Those that lie outside the page or in the pointer table don't count."""
    low = h.page_header + len(pointers) * h.pointer
    out = []
    for p in pointers:
        if not in_page(h, p) or p.offset < low or p.compression == 1:
            continue
        if p.compression == 4:
            out.append((p, 1))
        elif p.compression == 0:
            if p.kind and row_length and p.length >= row_length and _signature(h, page, p.offset) not in SIGNATURES:
                out.append((p, p.length // row_length))
        else:
            raise Unsupported(f"subheader compression {p.compression}")
    return out


def data_start(h: Header, n_pointers: int) -> int:
    """Where a page's data area begins: after the pointers, at a multiple of 8."""
    return -(-(h.page_header + n_pointers * h.pointer) // 8) * 8


def page_rows(layout: Layout, name: str, blocks: int, page_bytes: bytes, pointers: list[Pointer], left: int) -> tuple[str, int]:
    """("pointers" or "area", rows) of a page."""
    h = layout.header
    if name in ("comp", "comp_table", "unknown"):
        return "area", 0
    found = sum(n for _, n in row_pointers(h, page_bytes, pointers, layout.row_length))
    if found:
        return "pointers", min(found, left)
    if name not in ("data", "mix"):
        return "area", 0
    room = max(0, (h.page_size - data_start(h, len(pointers))) // layout.row_length)
    stated = blocks if name == "data" else layout.mix_rows
    return "area", min(stated if stated > 0 else room, room, left)


class _Text:
    def __init__(self, codec: str | None):
        self.blobs: list[bytes] = []
        self.codec = codec

    def get(self, ref: tuple[int, int, int]) -> str:
        index, offset, length = ref
        if not length or index >= len(self.blobs):
            return ""
        return decode_text(self.blobs[index][offset : offset + length], self.codec)


#: Fixed value: up to this page size, mode "auto" reads meta pages whole.
FULL_PAGE = 32 << 10
IO_MODES = ("auto", "full", "streaming")


def meta_page(h: Header, read, i: int, io_mode: str) -> bytes:
    """A meta page: whole, or ("streaming") only its pointers and what they point to, the rest as zeros.

    "auto" reads it whole if it is small, or if its subheaders fill half of it.
    """
    at = h.size + i * h.page_size
    if io_mode == "full" or io_mode == "auto" and h.page_size <= FULL_PAGE:
        return read(at, h.page_size)
    head = read(at, h.page_header)
    subheaders = min(struct.unpack_from(h.order + "H", head, h.page_header - 4)[0], (h.page_size - h.page_header) // h.pointer)
    table = read(at + h.page_header, subheaders * h.pointer)
    page = bytearray(h.page_size)
    page[: len(head)] = head
    page[h.page_header : h.page_header + len(table)] = table
    wanted = [p for p in page_parts(h, bytes(page))[2] if p.compression == 0 and in_page(h, p)]
    if io_mode == "auto" and 2 * sum(p.length for p in wanted) >= h.page_size:
        return read(at, h.page_size)
    for p in wanted:
        page[p.offset : p.offset + p.length] = read(at + p.offset, p.length)
    return bytes(page)


def meta_pages(h: Header, read, first: int, end: int) -> list[int]:
    """Of pages first..end: those with a subheader of metadata; pages of rows behind pointers aren't among them."""
    found = []
    for i in range(first, min(end, h.page_count)):
        head = read(h.size + i * h.page_size, h.page_header)
        if len(head) < h.page_header:
            break
        kind, _, subheaders = struct.unpack_from(h.order + "3H", head, h.page_header - 8)
        name = page_kind(kind)
        if name in ("comp", "comp_table", "unknown") or name == "data" and not subheaders:
            continue
        page = read(h.size + i * h.page_size, h.page_size)
        if any(p.compression == 0 and in_page(h, p) and p.length >= h.signature and _signature(h, page, p.offset) in SIGNATURES for p in page_parts(h, page)[2]):
            found.append(i)
    return found


def stated_rows(layout: Layout, read, pages: Iterable[int], io_mode: str = "full") -> Iterator[tuple[int, int]]:
    """(page, rows) of those pages that hold rows, as their own headers state; one page is held at a time."""
    h = layout.header
    for i in pages:
        if i >= h.page_count:
            break
        head = read(h.size + i * h.page_size, h.page_header)
        if len(head) < h.page_header:
            break
        kind, _, subheaders = struct.unpack_from(h.order + "3H", head, h.page_header - 8)
        name = page_kind(kind)
        if name in ("comp", "comp_table", "unknown"):
            continue
        page = head if name == "data" and not subheaders else meta_page(h, read, i, io_mode)
        name, blocks, pointers = page_parts(h, page)
        n = page_rows(layout, name, blocks, page, pointers, layout.row_count)[1]
        if n > 0:
            yield i, n


def read_layout(read, *, with_pages: bool = True, io_mode: str = "auto", only: list[int] | None = None) -> Layout:
    """Header, column metadata of all meta pages in file order, and (page, rows, first row) of every page with rows.

    io_mode: how meta pages are read (meta_page); it doesn't change what is found.  only: the pages with metadata, if known.
    """
    if io_mode not in IO_MODES:
        raise InvalidMetadata(f"unknown metadata mode {io_mode!r}")
    h = parse_header(read, catalog=False)
    layout, text = Layout(h), _Text(h.codec)
    row_sizes, names, attrs, formats, n_columns = [], [], [], [], 0
    s = h.signature
    places = range(h.page_count) if only is None else only
    for i in places:
        head = read(h.size + i * h.page_size, h.page_header)
        if len(head) < h.page_header:
            break
        kind = page_kind(struct.unpack_from(h.order + "H", head, h.page_header - 8)[0])
        if kind in ("comp", "comp_table", "unknown"):
            continue
        if kind == "data" and not struct.unpack_from(h.order + "H", head, h.page_header - 4)[0]:
            continue
        page = meta_page(h, read, i, io_mode)
        _, _, pointers = page_parts(h, page)
        for p in pointers:
            if p.compression not in (0,) or not in_page(h, p) or p.length < s:
                continue
            sub = page[p.offset : p.offset + p.length]
            sign = _signature(h, page, p.offset)
            ref = lambda at, sub=sub: struct.unpack_from(h.order + "3H", sub, at)
            if sign == ROW_SIZE:
                if len(sub) < (250 if h.wide else 190):
                    raise Corrupted("row size subheader", "too short")
                layout.row_length, layout.row_count = h.word(sub, 40 if h.wide else 20), h.word(sub, 48 if h.wide else 24)
                layout.mix_rows = h.word(sub, 120 if h.wide else 60)
                row_sizes.append((ref(len(sub) - 130), ref(len(sub) - 118)))
            elif sign == COLUMN_SIZE:
                n_columns = h.word(sub, s)
            elif sign == TEXT:
                text.blobs.append(sub[s:])
            elif sign == NAME:
                names += [ref(s + 8 + 8 * k) for k in range((len(sub) - 2 * s - 12) // 8)]
            elif sign == ATTRS:
                w = s + 8
                for k in range((len(sub) - 2 * s - 12) // w):
                    at = s + 8 + k * w
                    attrs.append((h.word(sub, at), h.unpack("I", sub, at + s), sub[at + s + 5], sub[at + s + 6]))
            elif sign == FORMAT:
                at = 46 if h.wide else 34
                sizes = struct.unpack_from(h.order + "2H", sub, 24) if h.wide else (None, None)
                formats.append((ref(at), ref(at + 6), *sizes))
            elif sign == LIST and not h.wide and len(sub) >= 30:
                n = h.unpack("H", sub, 18)
                layout.column_list += [h.unpack("h", sub, 30 + 2 * k) for k in range(n) if 32 + 2 * k <= len(sub)]
    if not row_sizes:
        raise InvalidMetadata("no row size subheader")
    layout.file_label = text.get(row_sizes[-1][0])
    layout.compression = COMPRESSIONS.get(text.get(row_sizes[-1][1]), "none")
    if not n_columns or not layout.row_length:
        raise InvalidMetadata("no columns or empty rows")
    if len(attrs) < n_columns or len(names) < n_columns:
        raise InvalidMetadata(f"{n_columns} columns, {len(names)} names, {len(attrs)} attributes")
    for k in range(n_columns):
        v = Variable(k, text.get(names[k]))
        v.offset, v.width, nibbles, kind = attrs[k]
        if kind not in (1, 2):
            raise Corrupted(f"column {k}", "unknown type code")
        if v.offset + v.width > layout.row_length or kind == 1 and not 3 <= v.width <= 8:
            raise Corrupted(f"column {k}", "outside the row, or of a width that no number has")
        v.numeric = kind == 1
        v.measure, v.alignment = MEASURES.get(nibbles & 15, "unknown"), ALIGNMENTS.get(nibbles >> 4, "unknown")
        if k < len(formats):
            v.format, v.label, v.format_width, v.format_decimals = text.get(formats[k][0]), text.get(formats[k][1]), formats[k][2], formats[k][3]
        layout.variables.append(v)
    if with_pages:
        first = 0
        for i, n in stated_rows(layout, read, places, io_mode):  # pages are read again, as a file may be larger than memory
            n = min(n, layout.row_count - first)
            if n > 0:
                layout.pages.append((i, n, first))
                first += n
    return layout


def resolve_name(names: list[str], name: str) -> int:
    """Exact match first, then without trailing blanks; case matters.  -1 if there is none."""
    if name in names:
        return names.index(name)
    trimmed = [n.rstrip() for n in names]
    return trimmed.index(name.rstrip()) if name.rstrip() in trimmed else -1
