"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``Machine`` is compiled from a model file: the normaliser (the model's character map, whose longest rewriting wins, blanks
squeezed, dummy prefix, blanks to U+2581), an arc for each piece (input its characters, output its id, weight minus its
score), and byte-fallback arcs for characters that no piece covers.
Composing it with a text gives a lattice; the encoding is its shortest path in the tropical semiring.

Models of type BPE rank merges instead of giving pieces likelihoods, so the cheapest path over piece scores isn't what
such a model means.  For them the machine is composed with one acceptor more: two neighbouring pieces may stand together
only if merging their joined characters gives these two pieces back.  Merging a text yields exactly the path on which
all neighbours are so, which makes the path unique and the shortest one the model's own encoding.  The acceptor's states
are the pieces; its arcs are found when first needed.

A path of the BPE machine ends between two characters that stand side by side in no piece (before a U+2581 always, which
is checked at compile time): texts are cut there, CHUNK characters at once, and each distinct unit is composed once
and its path kept in a table of bounded size.  Ids of texts are then gathered from the table, and their bytes from the pieces.
Models of likelihoods have their lattice over the whole text, since weights of paths add up in single precision, and
what that rounds decides between paths of equal weight.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import keep, slices, small_batches

SPACE = "▁"
#: Paths of distinct units, ids in them, and pairs of pieces that a worker keeps.
KEPT_UNITS, KEPT_IDS, KEPT_PAIRS = 500_000, 5_000_000, 1_000_000
#: Characters that are cut, and ids that are decoded, at once.
CHUNK = 1 << 20
#: Below all scores.
NEVER = float("-inf")
#: How much worse than the worst piece a character without piece is, and what a user's piece loses.
UNKNOWN_PENALTY, USER_PENALTY = 10.0, 0.1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, i
            shift += 7

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, i = data[i : i + n], i + n
        yield key >> 3, value


#: Piece types and model types of the file format.  Fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class CharMap:
    """The rewriting part of a normaliser, as models hold it: a double-array trie over UTF-8 and the texts it leads to.

    Fixed values of the format: the bits of a unit (label, whether a value follows, offset).
    """

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        self.units = struct.unpack(f"<{size // 4}I", data[4 : 4 + size])
        self.texts = data[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes read, place of the text) of the longest rewriting that begins at a place of a text."""
        units, found = self.units, None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = step(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        return found

    def apply(self, text: str) -> str:
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            found = self.longest(data, at)
            if found:
                n, place = found
                out.append(self.texts[place : self.texts.index(b"\0", place)])
            else:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out.append(data[at : at + n])
            at += n
        return b"".join(out).decode("utf-8", "replace")


class Paths:
    """Paths of distinct units, by number, as one array of ids; made anew when it has grown beyond its bounds."""

    def __init__(self, compose: Callable[[str], list[int]]):
        self.compose = compose
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.counts, self.flat = array("q"), array("q"), array("i")

    def of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each unit's path begins, its length, and the ids of all paths."""
        if len(self.numbers) > KEPT_UNITS or len(self.flat) > KEPT_IDS:
            self._clear()
        numbers = self.numbers
        for unit in units:
            if unit not in numbers:
                path = self.compose(unit)
                numbers[unit] = len(self.starts)
                self.starts.append(len(self.flat))
                self.counts.append(len(path))
                self.flat.extend(path)
        at = np.fromiter(map(numbers.__getitem__, units), np.int64, len(units))
        return np.frombuffer(self.starts, np.int64)[at], np.frombuffer(self.counts, np.int64)[at], np.array(self.flat)


class Machine:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, norm = UNIGRAM, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
        self.map = CharMap(norm[2]) if norm.get(2) else None
        if kind not in (UNIGRAM, BPE):
            raise ValueError("models of words or characters are not supported")
        self.bpe = kind == BPE
        self.prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        self.arcs = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.scores = [s for _, s, _ in self.pieces]
        self.unknown = next((i for i, (*_, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.longest = max(map(len, self.arcs), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.arcs):
            raise ValueError("pieces that run over the end of a word are not supported")
        self.trie: dict[str, list] = {}  # the machine's input side: characters to nodes (what follows, id of the piece that ends or -1)
        for p, i in self.arcs.items():
            below, node = self.trie, [{}, -1]
            for c in p:
                node = below.setdefault(c, [{}, -1])
                below = node[0]
            node[1] = i
        self.values = {i: p.encode() for p, i in self.arcs.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        normal = [s for _, s, t in self.pieces if t == NORMAL]
        self.fallback = UNKNOWN_PENALTY - min(normal, default=0.0)
        self.weights = [len(p.encode()) * -max(normal, default=0.0) + USER_PENALTY if t == USER and not self.bpe else -s for p, s, t in self.pieces]
        if self.bpe:
            self._compile_cuts()
        self.pairs: dict[int, bool] = {}
        self.merges: dict[int, tuple] = {}
        self.paths = Paths(self._only_path)
        texts = [self.values.get(i, b"") for i in range(len(self.pieces))]
        if self.escape:
            texts = [x.replace(SPACE.encode(), b" ") for x in texts]
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.piece_sizes = np.array([len(x) for x in texts], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    def _compile_cuts(self) -> None:
        """Which two characters stand side by side in some piece: `neighbours` by their classes, 0 for all others."""
        self.inside = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        letters = {c: k for k, c in enumerate(sorted(set("".join(self.inside))), 1)}
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in letters]] = list(letters.values())
        self.neighbours = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in self.inside:
            self.neighbours[letters[a], letters[b]] = True

    # --- normaliser -------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.map is not None:
            text = self.map.apply(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    # --- composition and shortest path ------------------------------------------------------------------------

    def _own_merges(self, piece: int) -> tuple:
        """The merges that make a piece of its characters, the best-scored neighbour pair first, leftmost on ties: whether
        they do make it, and (score, last symbol, first symbol) after each."""
        text, arcs, scores = self.pieces[piece][0], self.arcs, self.scores
        symbols, done = list(text), []
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                got = arcs.get(symbols[i] + symbols[i + 1])
                if got is not None and (best is None or scores[got] > best):
                    best, at = scores[got], i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            done.append((best, symbols[-1], symbols[0]))
        done.append((NEVER, "", ""))
        found = self.merges[piece] = len(symbols) == 1, done
        return found

    def _together(self, a: int, b: int) -> bool:
        """Arc of the pair acceptor: may piece b follow piece a?  Not if merging their joined characters would ever merge
        over the seam; until then each of them merges as it does alone.  -1: what no piece is merged with."""
        arcs, scores = self.arcs, self.scores
        both, right = self.merges.get(b) or self._own_merges(b)
        if a < 0:
            ok = self.pairs[a * len(self.pieces) + b] = both or self.pieces[b][2] == USER
            return ok
        whole, left = self.merges.get(a) or self._own_merges(a)
        score = lambda text: scores[arcs[text]] if text in arcs else NEVER
        x, y = self.pieces[a][0][-1], self.pieces[b][0][0]
        over, i, j, ok = score(x + y), 0, 0, whole and both
        while ok:
            one, other = left[i][0], right[j][0]
            if over > one and over >= other:  # of equal scores the leftmost goes first
                ok = False
            elif one >= other:
                if one == NEVER:
                    break
                x, i = left[i][1], i + 1
                over = score(x + y)
            else:
                y, j = right[j][2], j + 1
                over = score(x + y)
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[a * len(self.pieces) + b] = ok
        return ok

    def _only_path(self, word: str) -> list[int]:
        """The path of the machine composed with the pair acceptor and one word.

        A prefix has one path whose neighbours all fit, so a state of the lattice is entered once, and weights have nothing
        to choose between.  Longer arcs are followed first; where none goes on, the search steps back.
        """
        n, top, known, count = len(word), self.trie, self.pairs, len(self.pieces)
        entered = bytearray(n + 1)
        ends, ids = [0], [-1]  # of the arcs followed; -1: the start, or a character without piece
        while (at := ends[-1]) < n:
            a, arcs, j = ids[-1], [], at + 1
            node = top.get(word[at])
            if node is None or node[1] < 0:
                arcs.append((j, -1))
            while node is not None:
                below, b = node
                if b >= 0:
                    arcs.append((j, b))
                if j == n or not below:
                    break
                node = below.get(word[j])
                j += 1
            for j, b in reversed(arcs):
                if entered[j]:
                    continue
                if b < 0:
                    break
                ok = known.get(a * count + b)
                if ok is None:
                    ok = self._together(a, b)
                if ok:
                    break
            else:
                ends.pop()
                ids.pop()
                continue
            entered[j] = 1
            ends.append(j)
            ids.append(b)
        return self._read(word, zip(ends[1:], ids[1:], strict=True))

    def _cheapest_path(self, word: str) -> list[int]:
        """The path of least weight (tropical semiring: weights add along a path, the minimum wins).

        Weights are added in single precision, as models are used; of paths of equal weight that found first stays, whose
        last piece begins first.
        """
        n, weights, fallback = len(word), self.weights, self.fallback
        weight = array("f", [float("inf")]) * (n + 1)
        last: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        weight[0], last[0] = 0.0, -1
        one = array("f", [0.0])
        for i in range(n):
            node = self.trie.get(word[i])
            if node is None or node[1] < 0:
                one[0] = weight[i] + fallback
                if one[0] < weight[i + 1]:
                    weight[i + 1], last[i + 1], back[i + 1] = one[0], -1, i
            j = i
            while node is not None:
                j += 1
                below, b = node
                if b >= 0:
                    one[0] = weight[i] + weights[b]
                    if one[0] < weight[j]:
                        weight[j], last[j], back[j] = one[0], b, i
                node = below.get(word[j]) if j < n else None
        at, ends = n, []
        while at:
            ends.append((at, last[at]))
            at = back[at]
        return self._read(word, ends[::-1])

    def _read(self, word: str, ends: Iterable[tuple[int, int]]) -> list[int]:
        """Ids of a path's arcs, given where each ends and its piece (-1: a character without piece)."""
        out: list[int] = []
        before = 0
        for at, b in ends:
            if b >= 0:
                out.append(b)
            elif self.bytes:
                out.extend(self.bytes[x] for x in word[before:at].encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
            before = at
        return out

    # --- texts ------------------------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and where each begins (one more entry than texts)."""
        if not self.bpe:
            found = [self._likeliest(x) for x in texts]
            offs = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) for x in found], out=offs[1:])
            return np.fromiter(chain.from_iterable(found), np.int32, offs[-1]), offs
        plain = [self.normalise(x) for x in texts]
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in plain], out=begins[1:])
        joined, offs, out, total, at = "".join(plain), np.zeros(len(texts) + 1, np.int64), [], 0, 0
        while at < len(joined):
            end = min(at + CHUNK, len(joined))
            while end < len(joined) and joined[end - 1 : end + 1] in self.inside:
                end += 1
            first, last = np.searchsorted(begins, (at, end))
            ids, before = self._gather(joined[at:end], begins[first:last] - at)
            offs[first:last] = before + total
            out.append(ids)
            total += len(ids)
            at = end
        offs[np.searchsorted(begins, at) :] = total
        return np.concatenate(out) if out else np.zeros(0, np.int32), offs

    def _gather(self, text: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a part of normalised texts, and how many lie before each text that begins in it."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        chars = np.flatnonzero((data & 0xC0) != 0x80)  # where each character's bytes begin
        kind = self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        cut = np.ones(len(text), bool)
        np.logical_not(self.neighbours[kind[:-1], kind[1:]], out=cut[1:])
        cut[begins] = True
        cut = np.flatnonzero(cut)
        sizes = pa.py_buffer(np.append(chars[cut], len(data)).astype(np.int32))
        units = pa.StringArray.from_buffers(len(cut), sizes, pa.py_buffer(data)).dictionary_encode()
        starts, counts, flat = self.paths.of(units.dictionary.to_pylist())
        codes = np.asarray(units.indices)
        n = counts[codes]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[codes] - (ends - n), n)]
        return ids, (ends - n)[np.searchsorted(cut, begins)]

    def _likeliest(self, text: str) -> list[int]:
        out = self._cheapest_path(self.normalise(text))
        if not self.bytes and self.unknown in out:  # neighbouring characters without piece are one unknown
            out = [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x]
        return out

    def decode_all(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What decode makes of each text's ids: UTF-8 bytes of all texts, joined, and where each begins."""
        if self.escape and SPACE not in self.arcs:  # its bytes are pieces of their own
            texts = [self.decode(ids[a:b].tolist()).encode() for a, b in pairwise(offs.tolist())]
            begins = np.zeros(len(offs), np.int64)
            np.cumsum([len(x) for x in texts], out=begins[1:])
            return np.frombuffer(b"".join(texts), np.uint8), begins
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.piece_sizes[ids], out=ends[1:])
        data = np.empty(ends[-1], np.uint8)
        for a in range(0, len(ids), CHUNK):
            part = ids[a : a + CHUNK]
            low, high = ends[a], ends[a + len(part)]
            shift = self.piece_starts[part] - ends[a : a + len(part)]
            data[low:high] = self.piece_bytes[np.arange(low, high) + np.repeat(shift, self.piece_sizes[part])]
        begins = ends[offs]
        if self.prefix:
            first = begins[:-1][begins[:-1] < begins[1:]]
            first = first[data[first] == 0x20]
            data = np.delete(data, first)
            begins = begins - np.searchsorted(first, begins)
        return data, begins

    def decode(self, ids: list[int]) -> str:
        """Pieces and bytes joined, U+2581 to blanks, without the dummy prefix."""
        text = b"".join(self.values.get(i, b"") for i in ids).decode("utf-8", "replace")
        text = text.replace(SPACE, " ") if self.escape else text
        return text[1:] if self.prefix and text.startswith(" ") else text


def _machine(model: bytes) -> Machine:
    """One machine, with what it has learnt about words, for all tasks of a worker that follow each other."""
    return keep(("machine", model), lambda: Machine(model))


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids, offs = machine.encode_all([x or "" for x in part.column("_text").to_pylist()])
                data, begins = machine.decode_all(ids, offs)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"),
                        pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())),
                        pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)),
                    ],
                    names=["_id", "ids", "decoded"],
                )

    return run


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, ids (array of int) and decoded (the ids turned back into text).

    Null or empty text: no ids.  decoded equals the text unless it holds U+2581, which decodes to a blank, or the model's
    normaliser rewrites or squeezes characters, or has no bytes for those without piece.  Repeated rows and null ids are
    handled each by itself; ids may be of any kind.  Of paths of equal weight the one whose last piece begins first is
    taken.  A very long text is encoded whole, CHUNK characters at once; a unit's lattice is held while its path is found.  Empty
    table: empty result.  Other columns of docs are ignored, whatever their names.  The model file (a few MB at most) is
    read by the driver and broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .mapInArrow(_code(shared), f"_id {kind}, ids array<int>, decoded string")
        .withColumnRenamed("_id", id_col)
    )
