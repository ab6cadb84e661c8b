"""Near-duplicates by MinHash banding, verification on full shingle sets, and large-star/small-star components.

Texts with the same shingle set are one class; only one representative of each class goes further.  Every class has
`bands` x `rows` universal hash minima; classes that agree on a whole band share a bucket.  Buckets with the same members
count once.  In each bucket signatures are compared, and those alike enough are joined (``_connect``); components of
these joins, by large-star and small-star, are clusters, within which all links lie.  Full sets are then compared within
clusters in the same way, and components of the confirmed links are the result.

``_connect`` returns a spanning forest and never pairs.  A group of up to `BLOCK` members is one task.  A larger one is
dealt in blocks, each with a copy of the group's smallest member; only strays, which their block didn't connect to that
member, are compared with the other blocks as well, in chunks.  A group of near copies thus costs in proportion to its
size; only strays x size of one group is quadratic, in tasks of bounded size.

With 32 bands of 5 rows a pair of similarity 0.8 shares no bucket with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import LOWER, UPPER, RangeHash, Workspace, hot_join, id_type, mix64, signed, slices, small_batches, text_bytes

BANDS, ROWS = 32, 5
#: Pairs whose signatures agree in so much less than the similarity are no link: five standard errors of 160 minima.
SIGNATURE_SLACK = 0.16
#: Members of a block of a cluster.
BLOCK = 256

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[np.frombuffer(UPPER.encode(), np.uint8)] = np.frombuffer(LOWER.encode(), np.uint8)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes, joined, and where each text's begin.

    Words are runs of bytes other than blank and U+0009..U+000D, A-Z lower-cased.  A text of fewer words has one
    shingle, all its words; a text without words has none.
    """
    data, offs = text_bytes(arr)
    n_docs = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    word_byte = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)  # where a text begins
    edge[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = word_byte[:-1]
    start = np.flatnonzero(word_byte & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word_byte[1:]
    end = np.flatnonzero(word_byte & (~after | edge[1:])) + 1
    word = RangeHash(_FOLD[data]).of(start, end)
    doc = np.searchsorted(offs, start, side="right") - 1
    # empty texts share offsets: searchsorted's last one that begins at or before the word holds it
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    total = len(word)
    rolled = np.zeros(total, np.uint64)
    for j in range(k):
        rolled[: total - j] = mix64(rolled[: total - j] + word[j:] + np.uint64(j + 1))
    place = np.arange(total) - first[doc]
    full = place + k <= counts[doc]
    shingle, owner = rolled[full], doc[full]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = []
        for d in short:
            x = np.zeros(1, np.uint64)
            for j, h in enumerate(word[first[d] : first[d] + counts[d]]):
                x = mix64(x + h + np.uint64(j + 1))
            extra.append(mix64(x ^ np.uint64(int(counts[d]))))
        shingle, owner = np.concatenate([shingle, *extra]), np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    keep = np.ones(len(shingle), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[keep], owner[keep]
    return shingle, np.searchsorted(owner, np.arange(n_docs + 1))


def minima(sets: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """n minima of each set that isn't empty, of the universal family ((a*x + b) mod 2**64) >> 32, a odd."""
    rng = np.random.Generator(np.random.PCG64(7))
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    starts = offs[:-1][np.diff(offs) > 0]
    out = np.empty((len(starts), n), np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(((sets * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _describe(k: int, bands: int, rows: int):
    """id, hash of the text, number of shingles, 128-bit digest of the set, band hashes, signature of one byte for each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets, offs = shingle_sets(part.column("_text"), k)
                size = np.diff(offs)
                some = np.flatnonzero(size)
                digest = np.zeros((2, len(size)), np.uint64)
                sig: list = [None] * len(size)
                band: list = [None] * len(size)
                if len(some):
                    starts = offs[:-1][some]
                    digest[0, some] = np.add.reduceat(mix64(sets), starts)
                    digest[1, some] = np.add.reduceat(mix64(sets * np.uint64(0xE7037ED1A0B428DB) + np.uint64(11)), starts)
                    low = minima(sets, offs, bands * rows)
                    h = np.zeros((len(some), bands), np.uint64)
                    for r in range(rows):
                        h = mix64(h + low[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
                    h = signed(h)
                    b8 = (mix64(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                    for j, i in enumerate(some):
                        sig[i], band[i] = b8[j].tobytes(), h[j]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_t"), pa.array(size, pa.int64()), pa.array(signed(digest[0])), pa.array(signed(digest[1])), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["_id", "_t", "n_shingles", "d1", "d2", "bands", "sig"],
                )

    return run


def spanning_links(sets: list[np.ndarray] | None, sigs: np.ndarray, side: np.ndarray, share: tuple[int, int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect what all links would connect, and the root of each member's tree.

    side: 0 or 1; pairs are of different sides if both occur.  A link has share[1] * |intersection| >= share[0] * |union|;
    without sets, signatures that agree in the similarity less SIGNATURE_SLACK.  Likely pairs come first, so that most
    others are skipped.
    """
    n, least = len(sigs), share[0] / share[1]
    size = None if sets is None else np.array([len(x) for x in sets])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    two, out, pairs = bool(side.any() and not side.all()), [], []
    for i in range(n):
        others = np.arange(i + 1, n)
        if two:
            others = others[side[others] != side[i]]
        if size is not None:
            others = others[np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i]) - 1e-9]
        if len(others):
            alike = (sigs[others] == sigs[i]).mean(axis=1)
            good = alike >= least - SIGNATURE_SLACK
            pairs.append((alike[good], np.full(int(good.sum()), i), others[good]))
    if pairs:
        alike, left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
        for k in np.argsort(-alike, kind="stable").tolist():
            i, j = int(left[k]), int(right[k])
            a, b = root(i), root(j)
            if a == b:
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if not both or share[1] * both < share[0] * (int(size[i]) + int(size[j]) - both):
                    continue
            parent[a] = b
            out.append((i, j))
    return out, [root(i) for i in range(n)]


def _task(k: int | None, share: tuple[int, int], group: list[str], kind: pa.DataType, strays: bool):
    """Of one task's members: rows (group, a, b) for links, and (group, a, d1) for strays if asked for.  k: None for signatures only."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("node").to_pylist()
        sets = None
        if k is not None:
            texts, offs = shingle_sets(rows.column("_text"), k)
            sets = [texts[offs[i] : offs[i + 1]] for i in range(len(ids))]
        sigs = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in rows.column("sig")])
        links, roots = spanning_links(sets, sigs, rows.column("side").to_numpy(), share)
        a, b = [ids[i] for i, _ in links], [ids[j] for _, j in links]
        d1, at = [None] * len(links), [0] * len(links)
        if strays:
            near = {r for r, pivot in zip(roots, rows.column("pivot").to_pylist(), strict=True) if pivot}
            lost = [i for i, r in enumerate(roots) if r not in near]
            digests = rows.column("d1").to_pylist()
            a += [ids[i] for i in lost]
            b += [None] * len(lost)
            d1 += [digests[i] for i in lost]
            at += [0] * len(lost)
        keys = [rows.column(g).combine_chunks().take(pa.array(at, pa.int64())) for g in group]
        return pa.table([*keys, pa.array(a, kind), pa.array(b, kind), pa.array(d1, pa.int64())], names=[*group, "a", "b", "d1"])

    return run


def _connect(rows: DataFrame, group: list[str], kind: str, workspace: Workspace, share: tuple[int, int], k: int | None = None) -> DataFrame:
    """Links (a, b) within groups.  rows: group columns, n (members, about), low (the smallest node), node, d1 (which tells
    members with one node apart), sig, and _text if full sets decide (k: words of a shingle)."""
    own = F.pmod(F.xxhash64("node", "d1"), F.col("blocks")).cast("int")
    placed = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("pivot", F.col("node") == F.col("low"))
    placed = placed.withColumn("own", own)
    types = dict(rows.dtypes)
    out_schema = ", ".join(f"{g} {types[g]}" for g in group) + f", a {kind}, b {kind}, d1 long"
    arrow = pa.int64() if kind == "bigint" else pa.string()
    inside = placed.withColumn("own", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))).withColumn("side", F.lit(0))
    found = workspace.store(inside.drop("n", "low").groupBy(*group, "own").applyInArrow(_task(k, share, group, arrow, True), out_schema))
    links = found.filter("b is not null").select("a", "b")
    lost = found.filter("b is null").select(*group, F.col("a").alias("node"), "d1").distinct()
    big = placed.filter("blocks > 1")
    strays = workspace.store(big.join(lost, [*group, "node", "d1"]))
    chunks = strays.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(F.lit(3), "node", "d1"), F.col("chunks")).cast("int")
    left = big.join(chunks, group).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(0))
    right = strays.join(chunks, group).withColumn("chunk", chunk).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    across = left.unionByName(right).drop("n", "low").groupBy(*group, "own", "chunk").applyInArrow(_task(k, share, group, arrow, False), out_schema)
    return links.unionByName(across.select("a", "b"))


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """node, component (its smallest node) for the nodes of undirected edges (a, b), by large-star and small-star.

    Each step is a grouped minimum and an equi-join with it: the neighbours of a node are never gathered, and those of a
    hub stay where they are.
    """
    total = 0

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        # pairs (u, v), v a neighbour that the step looks at; the smallest of u and its neighbours becomes their centre
        low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        joined = hot_join(pairs, low, ["u"], "n", total)
        if larger:
            return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))

    tidy = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = workspace.store(tidy(edges))
    was = mark(now)
    while True:
        total = 2 * was[0]
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = workspace.store(tidy(star(both, True)))
        small = tidy(star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False))
        now = workspace.store(small)
        sum_now = mark(now)
        if sum_now == was:
            break
        was = sum_now
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    bands: int = BANDS,
    rows: int = ROWS,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Links texts with similarity[1] * |A & B| >= similarity[0] * |A | B| of their sets of `shingle`-word shingles.

    Returns id, n_shingles, component_id (smallest id reachable over links, itself included), kept (id = component_id).

    A null or empty text, or one of white space only, has no shingles and no links.  Rows that repeat an id are one
    node of the graph, whatever their texts, each with a row of the result; so with one id, all of them are kept or none.
    Ids are whole numbers or texts.  A row with a null id is kept, without links, component_id null.  Ties need no rule:
    components don't depend on any order.  Of a very long text a task holds some arrays of 8 bytes for each of its bytes.
    Empty table: empty result.  Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    workspace = workspace or Workspace(spark, "minhash")
    kind = id_type(docs, id_col)
    base = docs.select(F.col(id_col).cast(kind).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"), F.col(text_col).alias("_text"))
    sets = workspace.store(
        base.mapInArrow(_describe(shingle, bands, rows), f"_id {kind}, _t long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")
    )
    filled = sets.filter("_id is not null and n_shingles > 0")
    same = ["n_shingles", "d1", "d2"]
    classes = workspace.store(
        filled.groupBy(*same).agg(F.min(F.struct("_id", "_t")).alias("m"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .select(*same, F.col("m._id").alias("node"), F.col("m._t").alias("text_hash"), "bands", "sig")
    )
    # ids that stand for several texts join their classes, and rows of theirs without shingles
    mark = F.struct(*same)
    several = sets.filter("_id is not null").groupBy("_id").agg(F.min(mark).alias("p"), F.max(mark).alias("q")).filter("p <> q").select("_id")
    by_id = workspace.store(filled.join(several, "_id").join(classes.select(*same, "node"), same).select(F.col("node").alias("a"), F.col("_id").alias("b")).distinct())

    members = classes.select("node", "d1", F.posexplode("bands").alias("band", "h"))
    buckets = members.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node", "d1")).alias("mark")).filter("low < high")
    buckets = workspace.store(buckets.groupBy("n", "low", "high", "mark").agg(F.min(F.struct("band", "h")).alias("b")).select("b.band", "b.h", "n", "low"))
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = hot_join(members, buckets, ["band", "h"], "n", total)
    shared = shared.join(classes.select("node", "d1", "sig"), ["node", "d1"])
    alike = _connect(workspace.store(shared), ["band", "h"], kind, workspace, similarity)

    clusters = components(alike, workspace).withColumnRenamed("component", "low")
    sizes = clusters.groupBy("low").agg(F.count("*").alias("n"))
    placed = hot_join(clusters, sizes, ["low"], "n", clusters.count()).join(classes.select("node", "d1", "sig", "text_hash"), "node")
    texts = base.filter("_id is not null").select(F.col("_id").alias("node"), F.col("_t").alias("text_hash"), "_text")
    held = workspace.store(placed.join(texts, ["node", "text_hash"]).dropDuplicates(["node", "text_hash"]).withColumn("cluster", F.col("low")))
    links = _connect(held, ["cluster"], kind, workspace, similarity, shingle).unionByName(by_id)

    labels = components(links, workspace).withColumnRenamed("component", "comp")
    out = sets.select("_id", *same).join(classes.select(*same, "node"), same, "left").withColumn("node", F.coalesce("node", "_id")).join(labels, "node", "left")
    component = F.coalesce("comp", "node")
    out = out.select("_id", "n_shingles", F.when(F.col("_id").isNotNull(), component).alias("component_id"))
    kind_out = docs.schema[id_col].dataType if kind == "string" else "bigint"
    return out.select(
        F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", F.col("component_id").cast(kind_out).alias("component_id"),
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
