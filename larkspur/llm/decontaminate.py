"""Benchmark decontamination by greedy string tiling over running Karp-Rabin matches.

A test item counts as leaked into a text if tiles (longest non-overlapping common token runs of `run` tokens or more,
each token used once) cover `coverage` of the item, in whatever order the passages stand.

* Seeds: a Karp-Rabin hash runs over the tokens of every item and every text.  Items' seeds are a table (hash, item,
  positions).  Texts are read once, where they lie, against a Bloom filter of the items' hashes, whose size is bounded
  whatever the benchmark's; of the few seeds that pass, hash and positions go on.
* Join: the two tables of seeds meet on the hash.  Each item's seeds are held `SALT` times, so that a seed that many texts
  share is dealt to as many tasks.  A pair of a text and an item goes on if its seeds can cover enough of the item.
* Tiling: one row for each such pair.  A common run of n tokens is a diagonal of n - run + 1 seed pairs, so the longest
  matches are read off the seeds, marked, and what is left of the others competes again.

Nothing of the benchmark is collected, and nothing of the texts is moved but their common seeds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import RangeHash, Workspace, doc_key, id_back, id_type, mix64, signed, small_batches

RUN, COVERAGE = 4, 0.5
#: Bits of the filter: about BITS_A_SEED for each seed, up to MOST_BITS (16 MB); beyond, more seeds pass it in vain.
BITS_A_SEED, MOST_BITS = 32, 1 << 27
#: Copies of each item's seeds.
SALT = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(0x110000, bool)


def _word_chars() -> np.ndarray:
    """Which code points are part of a token: letters, digits, underscore, as \\w has them."""
    if not _WORD.any():
        _WORD[:] = np.fromiter((c == 95 or (not 0xD800 <= c < 0xE000 and chr(c).isalnum()) for c in range(0x110000)), bool, 0x110000)
    return _WORD


def token_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased tokens of a text, in order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64)
    inside = _word_chars()[np.minimum(points, 0x10FFFF)]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return RangeHash(mix64(points.astype(np.uint64) + np.uint64(0x5851F42D)) | np.uint64(1)).of(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))


def karp_rabin(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n tokens."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * _BASE + ids[j : len(ids) - n + 1 + j]
    return mix64(h)


def tile(pairs: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (text position, item position, length), from the pairs of positions where `least` tokens agree.

    The longest match comes first; of equally long ones that with the smallest position in the text, then in the item.
    """
    starts = set(pairs)
    heap = []
    for p, t in starts:
        if (p - 1, t - 1) not in starts:  # a match begins where the pair before it is no seed
            n = 1
            while (p + n, t + n) in starts:
                n += 1
            heap.append((-(n + least - 1), p, t))
    heapq.heapify(heap)
    text_used: set[int] = set()
    item_used: set[int] = set()
    tiles = []
    while heap:
        n, p, t = heapq.heappop(heap)
        free = [p + k not in text_used and t + k not in item_used for k in range(-n)]
        if all(free):
            text_used.update(range(p, p - n))
            item_used.update(range(t, t - n))
            tiles.append((p, t, -n))
            continue
        at = 0
        while at < -n:  # what is left of it competes again
            if not free[at]:
                at += 1
                continue
            end = at
            while end < -n and free[end]:
                end += 1
            if end - at >= least:
                heapq.heappush(heap, (at - end, p + at, t + at))
            at = end
    return tiles


def _positions(h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct hashes, and the positions of each."""
    order = np.argsort(h, kind="stable")
    found, first = np.unique(h[order], return_index=True)
    return found, np.split(order, first[1:]) if len(found) else []


def _item_seeds(run: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, size, h, at = [], [], [], []
            for i, text in zip(batch.column("_i").to_pylist(), batch.column("_text"), strict=True):
                ids = token_hashes(text.as_py() or "")
                if len(ids):
                    found, places = _positions(karp_rabin(ids, min(run, len(ids))))
                    item += [i] * len(found)
                    size += [len(ids)] * len(found)
                    h += signed(found).tolist()
                    at += places
            yield pa.RecordBatch.from_arrays([pa.array(item, batch.column("_i").type), pa.array(size, pa.int32()), pa.array(h, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["_i", "size", "h", "ts"])

    return scan


def _text_seeds(shared, lengths: list[int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        most = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            row, h, at = [], [], []
            for i, text in enumerate(batch.column("_text")):
                ids = token_hashes(text.as_py() or "")
                for n in lengths:
                    found = karp_rabin(ids, n)
                    for shift in (np.uint64(0), np.uint64(29)):
                        bit = (found >> shift) & most
                        kept = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
                        if shift == 0:
                            where = np.flatnonzero(kept)
                            found = found[where]
                        else:
                            found, where = found[kept == 1], where[kept == 1]
                    seeds, places = _positions(found)
                    row += [i] * len(seeds)
                    h += signed(seeds).tolist()
                    at += [where[x] for x in places]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_d").take(take), batch.column("_t").take(take), pa.array(h, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["_d", "_t", "h", "ps"])

    return scan


def _tile_pairs(run: int, coverage: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (size, seeds) in enumerate(zip(batch.column("size").to_pylist(), batch.column("seeds").to_pylist(), strict=True)):
                tiles = tile([(p, t) for s in seeds for p in s["ps"] for t in s["ts"]], min(run, size))
                covered = sum(n for *_, n in tiles)
                if covered >= coverage * size:
                    rows.append(k)
                    found.append((covered / size, len(tiles), covered))
            cols = list(zip(*found, strict=True)) if found else [[]] * 3
            take = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(take) for c in ("_d", "_t", "_i")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int32(), pa.int32()), strict=True))], names=["_d", "_t", "_i", "coverage", "n_tiles", "n_tokens"])

    return scan


def _filter_bits(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter, two bits for each hash; made by tasks, OR by OR."""
    n = seeds.count()
    words = 1 << 4
    while words * 64 < min(n * BITS_A_SEED, MOST_BITS):
        words *= 2
    most = words * 64 - 1
    bit = F.explode(F.array(F.col("h").bitwiseAND(F.lit(most)), F.shiftrightunsigned("h", 29).bitwiseAND(F.lit(most))))
    held = seeds.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[held.column("w").to_numpy()] = held.column("m").to_numpy().view(np.uint64)
    return bits


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, run: int, coverage: float, workspace: Workspace) -> DataFrame:
    """_d, _t (as doc_key has them), _i (item), coverage, n_tiles, n_tokens; equal rows of docs share one row."""
    small_batches(docs.sparkSession)
    kinds = f"_d {id_type(docs, id_col)}, _t long"
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    base = docs.select(*doc_key(docs, id_col, text_col), F.col(text_col).alias("_text"))
    items = benchmark.select(F.col(item_col).alias("_i"), F.col(item_text).alias("_text"))
    # items that share an id are items of their own
    seeds = workspace.store(items.withColumn("_i", F.struct("_i", F.xxhash64("_text").alias("x"))).mapInArrow(_item_seeds(run), f"_i struct<_i:{item_kind},x:bigint>, size int, h long, ts array<int>"))
    seeds = seeds.dropDuplicates(["_i", "h"])
    lengths = sorted(r["n"] for r in seeds.select(F.least("size", F.lit(run)).alias("n")).distinct().collect())  # run numbers at most
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(seeds))
    own = base.mapInArrow(_text_seeds(bits, lengths), f"{kinds}, h long, ps array<int>")
    own = own.withColumn("salt", F.pmod(F.xxhash64("_d", "_t"), F.lit(SALT)).cast("int"))
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    # equal rows of docs have equal seeds: one of them is enough
    pairs = own.join(salted, ["h", "salt"]).dropDuplicates(["_d", "_t", "_i", "h"]).groupBy("_d", "_t", "_i", "size")
    reach = F.sum(F.size("ts")) * F.least(F.first("size"), F.lit(run))
    likely = pairs.agg(F.collect_list(F.struct("ps", "ts")).alias("seeds"), reach.alias("reach")).filter(F.col("reach") >= coverage * F.col("size"))
    return likely.select("_d", "_t", "_i", "size", "seeds").mapInArrow(_tile_pairs(run, coverage), f"{kinds}, _i struct<_i:{item_kind},x:bigint>, coverage double, n_tiles int, n_tokens int")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    run: int = RUN, coverage: float = COVERAGE, workspace: Workspace | None = None,
) -> DataFrame:
    """One row for each text and test item leaked into it: id, item_id, coverage, n_tiles, n_tokens.

    Null and empty texts and items leak nothing.  Items shorter than `run` tokens must occur whole.  Repeated rows are
    judged each by itself.  Matches of equal length are taken by their place in the text, then in the item.  An empty
    benchmark, or an empty table, finds nothing.  Ids are whole numbers or texts.  Of a very long text a task holds some
    arrays of 8 bytes for each of its characters; a pair of a text and an item is one row, whose size is that of their
    common seeds' positions.  Other columns are ignored, whatever their names.
    """
    workspace = workspace or Workspace(docs.sparkSession, "leaks")
    found = workspace.store(_leaks(docs, benchmark, id_col, text_col, item_col, item_text, run, coverage, workspace))
    rows = docs.select(*doc_key(docs, id_col, text_col)).join(found, ["_d", "_t"])
    return rows.select(id_back(docs, id_col).alias(id_col), F.col("_i._i").alias("item_id"), "coverage", "n_tiles", "n_tokens")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    run: int = RUN, coverage: float = COVERAGE, workspace: Workspace | None = None,
) -> DataFrame:
    """docs without the rows that leak any test item; all columns stay as they are.  Odd rows: as in find_leaks."""
    workspace = workspace or Workspace(docs.sparkSession, "leaks")
    found = workspace.store(_leaks(docs, benchmark, id_col, text_col, item_col, item_text, run, coverage, workspace).select("_d", "_t").distinct())
    d, t = doc_key(docs, id_col, text_col)
    marked = docs.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("_row"), d, t)
    return marked.join(found, ["_d", "_t"], "left_anti").select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
