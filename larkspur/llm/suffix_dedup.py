"""Removal of repeated byte strings by bucket-pointer refinement over a sparse suffix array.

A byte is removed if a string of `length` bytes that covers it also starts elsewhere.  All suffixes of a corpus are too
many to sort, so the suffix array is sparse: of the `length`-byte window at every position only the suffix with the
smallest q-gram hash in it (its minimizer) is kept.  Equal windows choose the same suffix at the same distance, so no
repeated window is lost.

* Initial buckets: suffixes by q-gram.  A bucket's identifier is the key under which its suffixes meet.
* Refinement: suffixes of a bucket are sorted by (identifier of their bucket, identifier of the bytes at the later and
  earlier offsets that their windows take in).  Suffixes that stay together have all these windows in common: they are
  settled, and so are buckets in which every suffix goes on differently from the others but for one.
* Recursion: only buckets that hold several continuations stay open.  Their suffixes take the bucket's identifier along
  and are refined at nearer offsets: for blocks of `BLOCK` windows the new bucket is (identifier carried, place of the
  block, identifier of the bytes that all its windows share), sorted by the identifier of all bytes they cover; blocks
  that are still open then carry their bucket's identifier on to single windows.  Of suffixes that stayed together one
  goes on for all; what is settled isn't looked at again.

Identifiers of byte ranges are 64 bits of BLAKE2b where they decide equality (together with the 64 bits of the bucket),
so no text is fetched to compare bytes.  A bucket is never gathered in a task: buckets are counted by two-step aggregation
and members learn the outcome by equi-joins on identifiers, whose other side has one row for each identifier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import RangeHash, Workspace, doc_key, id_back, id_type, mix64, signed, slices, small_batches, text_bytes

#: Bytes of the q-grams that make the initial buckets.
QGRAM = 96
#: Windows of a block.
BLOCK = 24


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Low 32 bits of the smallest key among width keys from each position (van Herk: two running minima)."""
    n = len(keys)
    blocks = -(-(n + width) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)


def identifiers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2b of each byte range."""
    raw, digest = memoryview(data), hashlib.blake2b
    return np.frombuffer(b"".join([digest(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64)


def stretches(data: np.ndarray, offs: np.ndarray, length: int, q: int) -> dict[str, np.ndarray]:
    """Windows by the suffix they choose: text number, first and last window start, the suffix, its bucket, identifier of all bytes."""
    lens = np.diff(offs)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "first", "last", "anchor", "bucket", "u")}
    if not (lens >= length).any():
        return empty
    n, width = len(data), length - q + 1
    lane = RangeHash(data)
    at = np.arange(n - q + 1)
    bucket = lane.of(at, at + q)
    order = mix64(bucket ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF00000000)
    chosen = sliding_argmin(order | at.astype(np.uint64), width).astype(np.int64)
    n_windows = np.maximum(lens - length + 1, 0)
    row = np.repeat(np.arange(len(lens)), n_windows)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + offs[:-1][row]
    pick = chosen[window]
    new = np.ones(len(row), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    a, b = window[first], window[last]
    base = offs[:-1][row[first]]
    return {
        "row": row[first], "first": a - base, "last": b - base, "anchor": pick[first] - base,
        "bucket": signed(bucket[pick[first]]), "u": identifiers(data, a, b + length),
    }


def blocks(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, carried: np.ndarray, length: int, size: int) -> dict[str, np.ndarray]:
    """Stretches cut at multiples of `size` bytes before their anchor, so that equal windows fall into equal blocks.

    carried: identifiers of the buckets that the stretches come from.
    """
    low, high = (anchor - last) // size, (anchor - first) // size
    n = high - low + 1
    of = np.repeat(np.arange(len(first)), n)
    j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
    top = anchor[of] - j * size  # last window of the whole block
    a, b = np.maximum(first[of], top - size + 1), np.minimum(last[of], top)
    shared = RangeHash(data).of(top, top - size + 1 + length)
    bucket = mix64(mix64(carried[of].view(np.uint64) ^ mix64(j.astype(np.uint64) + np.uint64(1))) ^ shared)
    return {"of": of, "first": a, "last": b, "anchor": anchor[of], "bucket": signed(bucket), "u": identifiers(data, a, b + length)}


ROWS = "_t long, first int, last int, anchor int, weight int, bucket long, u long"


def _rows(d: pa.Array, t: pa.Array, found: dict[str, np.ndarray], weight: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array(x, pa.int32()) for x in (found["first"], found["last"], found["anchor"], weight)]
    return pa.RecordBatch.from_arrays(
        [d, t, *ints, pa.array(found["bucket"], pa.int64()), pa.array(found["u"], pa.int64())], names=["_d", *(x.split()[0] for x in ROWS.split(", "))]
    )


def _find_stretches(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                data, offs = text_bytes(part.column("_text"))
                found = stretches(data, offs, length, q)
                row = pa.array(found["row"])
                yield _rows(part.column("_d").take(row), part.column("_t").take(row), found, np.ones(len(row), np.int32))

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are moved compressed."""
    for batch in batches:
        codec = pa.Codec("zstd", compression_level=3)
        packed = [codec.compress(x.as_py() or b"", asbytes=True) for x in batch.column("_text").cast(pa.binary())]
        sizes = pc.fill_null(pc.binary_length(batch.column("_text").cast(pa.binary())), 0)
        yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), sizes.cast(pa.int64()), pa.array(packed, pa.binary())], names=["_d", "_t", "_size", "_packed"])


def _unpack(batch: pa.RecordBatch) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(x.as_py(), n.as_py(), asbytes=True) if n.as_py() else b"" for x, n in zip(batch.column("_packed"), batch.column("_size"), strict=True)]


def _find_blocks(length: int, size: int):
    """Blocks of the stretches in column `open` (first, last, anchor, weight, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_unpack(batch)):
                flat = batch.column("open").slice(i, 1).flatten()
                first, last, anchor, weight, carried = (np.asarray(flat.field(k), dtype=np.int64) for k in range(5))
                found = blocks(np.frombuffer(text, np.uint8), first, last, anchor, carried, length, size)
                row = pa.array(np.full(len(found["of"]), i))
                yield _rows(batch.column("_d").take(row), batch.column("_t").take(row), found, weight[found["of"]])

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, found in zip(_unpack(batch), batch.column("found"), strict=True):
                spans = merge_spans([(x["a"], x["b"] + length) for x in found.as_py() or ()])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                kept = b"".join(kept)
                rows.append((len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], SPANS), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.string())],
                names=["_d", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
            )

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, q: int = QGRAM, workspace: Workspace | None = None) -> DataFrame:
    """Removes bytes covered by a `length`-byte string that also starts elsewhere in the table, same text included.

    Returns id, n_bytes, n_removed, spans (array of start, end in bytes, maximal), kept (binary), kept_sha256.

    Null text: as an empty one.  Texts shorter than `length` and empty tables have nothing to remove.  Rows that repeat
    id and text are repeats of each other, and all lose what repeats; there are no ties to break.  Ids are whole numbers
    or texts; a null id is kept as it is.  Of a very long text a task holds the text and some arrays of 8 bytes for each
    of its bytes.  Other columns of docs are ignored, whatever their names.
    """
    if not 0 < q <= length:
        raise ValueError("q must be between 1 and length")
    small_batches(docs.sparkSession)
    workspace = workspace or Workspace(docs.sparkSession, "suffix")
    kind = f"_d {id_type(docs, id_col)}, "
    base = docs.select(*doc_key(docs, id_col, text_col), F.col(text_col).alias("_text"))
    key = ["_d", "_t"]
    spread = base.mapInArrow(_pack, kind + "_t long, _size long, _packed binary")  # texts move compressed
    lists = lambda rows: rows.groupBy(*key).agg(F.collect_list(F.struct("first", "last", "anchor", "weight", "bucket")).alias("open"))

    found = base.filter(F.octet_length("_text") >= length).mapInArrow(_find_stretches(length, q), kind + ROWS)
    whole, opened = _settle(found, workspace)
    texts = workspace.store(spread.join(lists(opened), key))
    some, opened = _settle(texts.mapInArrow(_find_blocks(length, BLOCK), kind + ROWS), workspace)
    single, _ = _settle(texts.drop("open").join(lists(opened), key).mapInArrow(_find_blocks(length, 1), kind + ROWS), workspace)
    spans = whole.unionByName(some).unionByName(single).groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("found"))
    out = spread.join(spans, key, "left").mapInArrow(
        _cut(length), kind + "n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string"
    )
    return out.select(id_back(docs, id_col).alias(id_col), "n_bytes", "n_removed", "spans", "kept", "kept_sha256")


def _settle(rows: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """One refinement: (stretches that are repeated as a whole, one member of each stretch that is still open).

    A weight of 2 marks a member that stands for a stretch found repeated before: it counts twice, and is not reported.
    What texts yield and what is left of it are written down, so that each is computed once.
    """
    name, key = ["bucket", "u"], ["_d", "_t"]
    rows = workspace.store(rows)
    named = rows.groupBy(*name).agg(F.sum("weight").alias("n"))
    crowded = named.groupBy("bucket").agg(F.count("*").alias("stretches")).filter("stretches > 1").select("bucket", F.lit(True).alias("open"))
    state = named.join(crowded, "bucket", "left").select(*name, "n", F.coalesce("open", F.lit(False)).alias("open")).filter("n > 1 or open")
    marked = workspace.store(rows.join(state, name))
    whole = marked.filter("n > 1 and weight = 1").select(*key, F.col("first").alias("a"), F.col("last").alias("b"))
    alone = marked.filter("open and n = 1").select(*key, "first", "last", "anchor", "weight", "bucket")
    among = marked.filter("open and n > 1").groupBy(*name).agg(F.min(F.struct(*key, "first", "last", "anchor")).alias("m")).select("m.*", F.lit(2).alias("weight"), "bucket")
    return whole, alone.unionByName(among)
