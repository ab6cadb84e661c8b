"""Secrets in texts and in what texts encode: a worklist that unwraps layers until nothing new appears.

The text itself is the first layer.  Each layer is scanned; then every piece of it that decodes (URL escapes, Unicode
escapes, base64 that may go over line ends, UTF-16, and deflate or gzip data below base64 and escapes) becomes a further layer, once: layers are told apart by a
digest, so cycles and repeated pieces end.  Data are inflated to their end, all members of them, in pieces, and long
layers are scanned in windows, so that memory stays bounded.  Every layer carries, for each of its characters, the span of the original
text that it came from, and findings are mapped back through it.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, product
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import small_batches

#: The kinds, in order, with the group and length that make a match count.  Fixed values.
KINDS = (
    ("assign", re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The same matches, found faster: runs of hex digits that are long enough, entered at their true start.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/=_-])")

#: Behind a slash, how gzip and zlib data begin in base64.
PACKED_HEAD = re.compile(r"/(?=H4sI|e[AFJN])")
#: Runs of base64 over line ends; how many of their lines belong together is tried out.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
URL_DATA = re.compile(r"(?<![A-Za-z0-9_.~!*'()/+&=:;@$,?-])[A-Za-z0-9_.~!*'()/+&=:;@$,?-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~!*'()/+&=:;@$,?-]*+)++")
CHAR_DATA = re.compile(r"\x1f\x8b\x08[\x00-\xff]*")
#: UTF-16 that holds anything to find has so many ASCII characters in a row at least.
WIDE = ((re.compile(rb"(?:[\t\n\r -~]\0){12}"), "utf-16-le"), (re.compile(rb"(?:\0[\t\n\r -~]){12}"), "utf-16-be"))

#: Decompressed data comes in pieces of so many bytes; text is scanned in windows of about WINDOW characters.
CHUNK, WINDOW = 1 << 18, 1 << 20
#: A layer of up to so many bytes is held; a longer one is inflated again for each pass over it.
LONG = 1 << 24
#: Where a window may end: no finding, escape or base64 run goes over these places.
BREAK = re.compile(r"[^A-Za-z0-9%+/_.=\-\"':\s\\&#;{}~!*()$@,?]|(?<=[.,!?)])\s")
#: Without such a place in LONG characters, windows overlap, and what goes on over their ends is read as one run.
OVERLAP = 1024
_RUN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n\t "


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    layer: str


def scan(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough, by start and kind."""
    out = []
    for at, (kind, pattern, group, least) in enumerate(KINDS):
        if kind == "assign" and ":" not in text and "=" not in text or kind == "access" and "AKIA" not in text:
            continue
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), at, m.end()))
    return [(KINDS[at][0], a, b) for a, at, b in sorted(out)]


class _Origin:
    """Where the characters of a layer come from: the same span for all, or a start and an end for each."""

    def __init__(self, whole: tuple[int, int] | None = None, starts: list[int] | None = None, ends: list[int] | None = None):
        self.whole, self.starts, self.ends = whole, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.starts is None:
            return a, b
        return self.starts[a], self.ends[b - 1]


def _url(text: str, placed: bool = True) -> tuple[str, list[int], list[int]] | None:
    return _rewrite(text, URL_ESCAPES, lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), "%", placed)


def _unicode(text: str, placed: bool = True) -> tuple[str, list[int], list[int]] | None:
    def char(m: re.Match) -> str:
        code = int(m[5]) if m[5] else int(next(x for i, x in enumerate(m.groups()) if x and i != 4), 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"

    return _rewrite(text, UNICODE_ESCAPES, char, "\\&", placed)


def _rewrite(text: str, pattern: re.Pattern, decode, signs: str, placed: bool) -> tuple[str, list[int], list[int]] | None:
    """The text with its escapes decoded, and (if placed) the span each character came from; None if there are none."""
    if not any(c in text for c in signs):
        return None
    if not placed:
        return pattern.sub(decode, text), [], []
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        plain = decode(m)
        parts += [text[at : m.start()], plain]
        starts += [*range(at, m.start()), *[m.start()] * len(plain)]
        ends += [*range(at + 1, m.start() + 1), *[m.end()] * len(plain)]
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    starts += range(at, len(text))
    ends += range(at + 1, len(text) + 1)
    return "".join(parts), starts, ends


def _inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What gzip, zlib or raw deflate data holds, member after member, in pieces; nothing if it is none of them.

    Of broken or truncated data, all that comes before the break.
    """
    d, bits, head, first = None, 0, b"", True
    for data in chunks:
        data, head = head + data, b""
        while data or d is not None:
            if d is None:
                data = data if first else data.lstrip(b"\0")
                if len(data) < 2:
                    head = data
                    break
                bits = 31 if data[:2] == b"\x1f\x8b" else 15 if data[0] & 143 == 8 and int.from_bytes(data[:2]) % 31 == 0 else -15
                d = zlib.decompressobj(bits)
            before = d.copy() if bits > 0 else None
            try:
                out = d.decompress(data, CHUNK)
            except zlib.error:
                if before is not None:
                    yield from _until_broken(before, data)
                if bits == 15 and first:  # raw deflate data may begin like zlib data
                    yield from _raw(data)
                return
            if out:
                yield out
            if d.eof:
                data, d, first = d.unused_data, None, False
            else:
                data = d.unconsumed_tail
                if not data and len(out) < CHUNK:
                    break


def _until_broken(d, data: bytes) -> Iterator[bytes]:
    out = bytearray()
    try:
        for i in range(len(data)):
            out += d.decompress(data[i : i + 1])
            if len(out) >= CHUNK:
                yield bytes(out)
                out.clear()
    except zlib.error:
        pass
    if out:
        yield bytes(out)


def _raw(data: bytes) -> Iterator[bytes]:
    d = zlib.decompressobj(-15)
    try:
        while True:
            out = d.decompress(data, CHUNK)
            if out:
                yield out
            data = d.unconsumed_tail
            if d.eof or not data and len(out) < CHUNK:
                return
    except zlib.error:
        return


def _base64(token: str) -> bytes:
    """The bytes that a token stands for, as far as they are whole."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _joined(run: str) -> Iterator[tuple[int, int]]:
    """Start and end of the parts of a wrapped run that may be one piece of base64: lines of one width with the shorter
    one after them, the same after a line that begins elsewhere, and the whole run."""
    lines = [(m.start(), m.end()) for m in re.finditer(r"\S+", run)]
    wide = [b - a for a, b in lines]
    parts = {(0, len(lines))}
    for i in range(len(lines) - 1):
        if i and wide[i] == wide[i - 1]:
            continue
        for first in {i, i + 1}:
            j = first + 1
            while j < len(lines) and wide[j] == wide[first]:
                j += 1
            parts.add((i, j + (j < len(lines) and wide[j] < wide[first])))
    for i, j in sorted(parts):
        if j > i + 1 and max(wide[i:j]) >= 16:
            yield lines[i][0], lines[j - 1][1]


def _url_data(token: str) -> Iterator[bytes]:
    """The bytes of a token with URL escapes, and those from each place on at which compressed data begins."""
    for text in {token, token.replace("+", " ")}:
        data, at, starts = unquote_to_bytes(text), 0, {text.find("%")}
        for piece in re.split("(?<=[=&?])", text):
            starts.add(at)
            at += len(unquote_to_bytes(piece))
        yield data
        yield from _packed(data, starts - {0})


def _packed(data: bytes, starts: set[int] | None = None) -> Iterator[bytes]:
    """The data from each place on at which something can be inflated: starts, and where gzip data begins."""
    for start in sorted((starts or set()) | {m.start() for m in re.finditer(rb"\x1f\x8b\x08", data)}):
        if next(_inflate(iter((data[start : start + CHUNK],))), None):
            yield data[start:]


def _base64_run(parts: Iterable[str], start: int, end: int) -> Iterator[bytes]:
    """The bytes of the run from start to end of a text that comes in parts."""
    at, kept = 0, ""
    for part in parts:
        piece = part[max(start - at, 0) : max(end - at, 0)]
        at += len(part)
        kept += re.sub(r"\s", "", piece)
        done = "=" in kept
        kept = kept.partition("=")[0]
        n = len(kept) if done or at >= end else len(kept) // 4 * 4
        if n:
            yield _base64(kept[:n])
        kept = kept[n:]
        if done or at >= end:
            return
    if kept:
        yield _base64(kept)


def _text(chunks: Iterable[bytes]) -> Iterator[str]:
    """Bytes as characters.  All that is looked for is ASCII, which UTF-8 and the Latin sets share, so that other bytes
    only have to stay apart from it.  Long runs of blanks shrink: a finding may have any number of them."""
    for chunk in chunks:
        yield re.sub("   +", "  ", chunk.decode("latin-1"))


def _wide(data: bytes) -> Iterator[str]:
    """The UTF-16 readings of the data in which something can be found."""
    for pattern, code in WIDE:
        for odd in {m.start() % 2 for m in pattern.finditer(data)}:
            yield data[odd:].decode(code, "replace")


def _wide_parts(chunks: Iterable[bytes], code: str, odd: int) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(code)("replace")
    for chunk in chunks:
        yield re.sub("   +", "  ", decoder.decode(chunk[odd:]))
        odd = 0


def _windows(parts: Iterable[str], runs: list[tuple[int, int]]) -> Iterator[tuple[str, bool]]:
    """A text in windows, each of which can be read by itself, and whether base64 runs end in it.  Runs that are too long
    for a window are added to runs."""
    text, at, begun, looked = "", 0, None, 0
    for part in parts:
        if begun is not None:
            inside = len(part) - len(part.lstrip(_RUN))
            at += max(len(text) - OVERLAP, 0)
            text = text[-OVERLAP:] + part[:inside]
            yield text, False
            if inside == len(part):
                continue
            runs.append((begun, at + len(text)))
            at += max(len(text) - OVERLAP, 0)
            text, part, begun, looked = text[-OVERLAP:], part[inside:], None, 0
        text += part
        if len(text) < WINDOW:
            continue
        cut = next((m[-1] for far in (1 << 12, len(text)) if (m := [x.start() for x in BREAK.finditer(text, max(len(text) - far, looked))])), 0)
        looked = len(text)
        if cut:
            yield text[:cut], True
            text, at, looked = text[cut:], at + cut, 0
        elif len(text) >= LONG:
            start = len(text.rstrip(_RUN))
            yield text[:start], True
            at += max(start - OVERLAP, 0)
            text, looked = text[max(start - OVERLAP, 0) :], 0
            if len(text) >= LONG // 2:
                begun = at + min(start, OVERLAP)
                yield text, False
    if begun is not None:
        runs.append((begun, at + len(text)))
    elif text:
        yield text, True


def _pieces(data: bytes) -> Iterator[bytes]:
    return (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))


@dataclass(frozen=True)
class _Data:
    """Bytes that a piece of a text decodes to; open() gives them in chunks, each time anew."""

    open: Callable[[], Iterator[bytes]]
    origin: _Origin
    name: str
    #: Whether the bytes are to be read as text too; those of URL escapes have been.
    plain: bool = True


def find_all(text: str) -> tuple[list[tuple[str, int, int]], list[Span]]:
    """(matches in the text itself, all spans: those and the ones found in decoded layers)."""
    base = scan(text)
    order = {kind: i for i, (kind, *_) in enumerate(KINDS)}
    spans = {(a, order[kind], b): Span(kind, a, b, "text") for kind, a, b in base}
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}

    def new(data: bytes, origin: _Origin, sort: str) -> bool:
        mark = hashlib.blake2b(data + f"{sort}{origin.whole}".encode(), digest_size=16).digest()
        known = mark in seen
        seen.add(mark)
        return not known

    def push(work: deque, layer: str, origin: _Origin, name: str) -> None:
        if layer and new(layer.encode("utf-8", "surrogatepass"), origin, "t"):
            work.append((layer, origin, name))

    def read(layer: str, origin: _Origin, name: str, work: deque, ends: bool = True) -> None:
        if name != "text":
            for kind, a, b in scan(layer):
                start, end = origin.span(a, b)
                spans.setdefault((start, order[kind], end), Span(kind, start, end, name))
        for decoder, label in ((_url, "url"), (_unicode, "unicode")):
            got = decoder(layer, origin.whole is None)
            if got is not None and got[0] != layer:
                plain, firsts, lasts = got
                if origin.whole is not None:
                    push(work, plain, origin, f"{name}>{label}")
                elif plain:
                    both = [origin.span(a, b) for a, b in zip(firsts, lasts, strict=True)]
                    push(work, plain, _Origin(None, [a for a, _ in both], [b for _, b in both]), f"{name}>{label}")
        for m in BASE64.finditer(layer) if ends else ():
            hold(work, _base64(m[0]), _Origin(origin.span(m.start(), m.end())), f"{name}>base64")
            if "/" in m[0]:  # it may begin behind a path: in another of four steps, or where packed data has its head
                for skip in (1, 2, 3):
                    hold(work, _base64(m[0][skip:]), _Origin(origin.span(m.start(), m.end())), f"{name}>base64")
                for head in PACKED_HEAD.finditer(m[0]):
                    hold(work, _base64(m[0][head.end() :]), _Origin(origin.span(m.start() + head.end(), m.end())), f"{name}>base64")
        for m in WRAPPED.finditer(layer) if ends and "\n" in layer else ():
            for a, b in _joined(m[0]):
                token = "".join(m[0][a:b].split()).partition("=")[0]
                hold(work, _base64(token), _Origin(origin.span(m.start() + a, m.start() + b)), f"{name}>base64")
        for m in URL_DATA.finditer(layer) if "%" in layer else ():
            for data in _url_data(m[0]):
                hold(work, data, _Origin(origin.span(*m.span())), f"{name}>url", False)
        for m in CHAR_DATA.finditer(layer) if name.endswith(">unicode") else ():
            for data in _packed(m[0].encode("latin-1")):
                hold(work, data, _Origin(origin.span(*m.span())), name, False)

    def hold(work: deque, data: bytes, origin: _Origin, name: str, plain: bool = True) -> None:
        if data and new(data, origin, "b" if plain else "u"):
            work.append(_Data(lambda: _pieces(data), origin, name, plain))

    def unpack(it: _Data, work: deque) -> None:
        chunks = it.open()
        held, more = [], next(chunks, None)
        while more is not None and sum(map(len, held)) < WINDOW:
            held.append(more)
            more = next(chunks, None)
        if more is None:
            data = b"".join(held)
            if it.plain:
                push(work, data.decode("latin-1"), it.origin, it.name)
            for text in _wide(data):
                push(work, text, it.origin, f"{it.name}+utf16")
            inflated(work, it)
            return
        mark, zeros = hashlib.blake2b(digest_size=16), False

        def marked() -> Iterator[bytes]:
            nonlocal zeros
            for chunk in chain(held, (more,), chunks):
                mark.update(chunk)
                zeros = zeros or b"\0" in chunk
                yield chunk

        def walk(parts: Callable[[], Iterator[str]], first: Iterator[str], name: str) -> None:
            runs = []
            for window, ends in _windows(first, runs):
                drain(deque([(window, it.origin, name)]), ends)
            for a, b in runs:
                work.append(_Data(lambda a=a, b=b: _base64_run(parts(), a, b), it.origin, f"{name}>base64"))

        if it.plain:
            walk(lambda: _text(it.open()), _text(marked()), it.name)
        else:
            deque(marked(), 0)
        if new(mark.digest(), it.origin, "m" if it.plain else "n"):
            for code, odd in product(("utf-16-le", "utf-16-be"), (0, 1)) if zeros else ():
                wide = lambda code=code, odd=odd: _wide_parts(it.open(), code, odd)
                walk(wide, wide(), f"{it.name}+utf16")
            inflated(work, it)

    def inflated(work: deque, it: _Data) -> None:
        chunks, held, size = _inflate(it.open()), [], 0
        for chunk in chunks:
            held.append(chunk)
            size += len(chunk)
            if size > LONG:
                work.append(_Data(lambda: _inflate(it.open()), it.origin, it.name + "+deflate"))
                return
        hold(work, b"".join(held), it.origin, it.name + "+deflate")

    def drain(work: deque, ends: bool = True) -> None:
        while work:
            it = work.popleft()
            if isinstance(it, _Data):
                unpack(it, work)
            else:
                read(*it, work, ends)
                ends = True

    drain(deque([(text, _Origin(), "text")]))
    return base, [spans[k] for k in sorted(spans)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, spans = [], []
        for text in batch.column("_text"):
            own, found = find_all(text.as_py() or "")
            base.append([{"kind": k, "start": a, "end": b, "layer": "text"} for k, a, b in own])
            spans.append([vars(x) for x in found])
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(base, SPANS), pa.array(spans, SPANS)], names=["_id", "base", "spans"])


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, base (matches in the text itself) and spans (those and all found in decoded layers), both arrays of
    struct(kind, start, end, layer), offsets in code points of the text, end exclusive.

    Null text: as an empty one, no spans.  Rows are independent: repeated or null ids, ids of any kind, ties and an empty
    table need nothing special.  Very long texts and layers are scanned whole; layers beyond LONG bytes in windows, so that
    a task holds the text, its origins and LONG bytes of a layer.  Other columns of docs are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int,layer:string>>"
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .mapInArrow(_scan_batches, f"_id {kind}, base {span}, spans {span}")
        .withColumnRenamed("_id", id_col)
    )
