"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` is a log-structured index.  Every batch of lines is aggregated to one row for each line key and
merge-anti-joined with the runs that exist.  Keys that no run has are new: the batch's run is their home.  Keys that have
a home get their share of this batch counted as a hit.  So every key has one home, and only keys with hits (those that
more than one batch holds) are ever added up.  The batch's rows become a sorted run; once a level holds ``fanout`` runs
they are compacted into one run of the next.

Runs are bucketed, sorted tables in the shared folder: a merge with a new batch moves the batch only, never the runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import LOWER, UPPER, WHITE, Workspace, doc_key, hot_join, id_type

#: Parts in which one table is fed to the index, runs of a level that are merged, rows of all batches for each bucket of a run.
BATCHES = 4
FANOUT = 2
BUCKET_ROWS = 1 << 18


def line_key(line: Column) -> Column:
    """The line without white space (blank, U+0009..U+000D) at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    """Lines of a text, split at newlines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets of the runs of an index that takes so many rows.

    Each bucket is a file of each run, and where Hadoop lacks its native library a file costs its writer two processes
    (chmod), which share all memory of the executor until they start.  So buckets follow the rows, not the session's
    shuffle partitions, unless the session keeps Spark from coalescing these.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true":
        return partitions
    return max(-(-rows // BUCKET_ROWS), min(partitions, spark.sparkContext.defaultParallelism))


class LineRuns:
    """Levelled sorted runs with columns h1, h2, n_docs, max_doc, fresh (this run is the key's home)."""

    KEYS = ("h1", "h2")

    def __init__(self, spark: SparkSession, workspace: Workspace, fanout: int = FANOUT, buckets: int | None = None, id_kind: str = "bigint"):
        self.spark, self.workspace, self.fanout, self.id_kind = spark, workspace, fanout, id_kind
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            df.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", f"{self.workspace.path}/{name}")
            .format("parquet")
            .saveAsTable(name)
        )
        return name

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """lines: h1, h2, doc_id, one row for each line key and document.  A document belongs to one batch."""
        batch = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        batch = batch.repartition(self.buckets, "h1", "h2")  # as the runs lie
        fresh = F.lit(True)
        for name in self._runs():  # a key has its home in one run at most
            run = self.spark.table(name).filter("fresh").select("h1", "h2", F.lit(False).alias(f"_{name}"))
            batch = batch.join(run, ["h1", "h2"], "left")
            fresh = fresh & F.coalesce(F.col(f"_{name}"), F.lit(True))
        new = batch.select("h1", "h2", "n_docs", "max_doc", fresh.alias("fresh"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(new))
        self._compact()

    def _compact(self) -> None:
        """Merges a level that is full into one run of the next."""
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                full, self.levels[at] = self.levels[at], []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._write(self._merge(full)))
                self._forget(full)
            at += 1

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """The runs leave the catalog; their files go with the workspace."""
        self._forget(self._runs())
        self.levels = []

    def _merge(self, names: list[str]) -> DataFrame:
        """Merge joins of sorted runs; neither side is moved.  Hits of a key whose home is merged join it there."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            run = self.spark.table(name).select("h1", "h2", *(F.col(c).alias(f"_{c}") for c in ("n_docs", "max_doc", "fresh")))
            rows = rows.join(run, ["h1", "h2"], "full").select(
                "h1",
                "h2",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n_docs", F.lit(0))).alias("n_docs"),
                F.greatest("max_doc", "_max_doc").alias("max_doc"),
                (F.coalesce("fresh", F.lit(False)) | F.coalesce("_fresh", F.lit(False))).alias("fresh"),
            )
        return rows

    def state(self, least: int = 1) -> DataFrame:
        """One row for each key that `least` documents hold: h1, h2, n_docs, max_doc.  Homes, with the hits elsewhere added."""
        names = self._runs()
        if not names:
            return self.spark.createDataFrame([], f"h1 long, h2 long, n_docs long, max_doc {self.id_kind}")
        out = None
        for name in names:
            home = self.spark.table(name).filter("fresh").select("h1", "h2", "n_docs", "max_doc")
            for k, other in enumerate(n for n in names if n != name):
                hits = self.spark.table(other).filter("not fresh").select("h1", "h2", F.col("n_docs").alias(f"n{k}"), F.col("max_doc").alias(f"m{k}"))
                home = home.join(hits, ["h1", "h2"], "left").select("h1", "h2", (F.col("n_docs") + F.coalesce(f"n{k}", F.lit(0))).alias("n_docs"), F.greatest("max_doc", f"m{k}").alias("max_doc"))
            found = self.workspace.store(home.filter(F.col("n_docs") >= least))  # homes share no key
            out = found if out is None else out.unionByName(found)
        return out


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = BATCHES,
    carry: list[str] | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Drops lines whose key (``line_key``) has `min_chars` code points and occurs in `min_docs` documents.

    The largest id that holds a key keeps all its lines of that key.  Returns id, n_lines, n_dropped, kept (text) and the
    columns in `carry`.  The table is fed to the index in `batches` parts, dealt by a hash of the id.

    Null or empty text: one empty line, kept.  Rows that repeat an id count as one document but each gets a row of the
    result.  Ids are whole numbers or texts (ordered as such); a null id takes part as one document that is smaller than
    all others.  Lines of a very long text are rows of their own until the end, when its task holds the whole text.
    Empty table: empty result.  Other columns of docs are ignored, whatever their names.
    """
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark, "lines")
    key = ["_d", "_t"]
    base = docs.select(F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry or []))).alias("_carry"), *doc_key(docs, id_col, text_col), F.col(text_col).alias("_text"))

    keys = F.transform(text_lines(F.col("_text")), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("at")))
    lines = workspace.store(
        base.select(*key, F.explode(F.filter(keys, lambda x: F.length(x["k"]) >= min_chars)).alias("l"))
        .select(*key, "l.at", F.xxhash64("l.k").alias("h1"), F.xxhash64(F.lit(7), "l.k").alias("h2"), F.pmod(F.xxhash64("_d"), F.lit(batches)).cast("int").alias("batch")),
        partition_by="batch",
    )
    runs = LineRuns(spark, workspace, buckets=bucket_count(spark, lines.count()), id_kind=id_type(docs, id_col))
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch).select("h1", "h2", F.col("_d").alias("doc_id")).distinct())
    common = workspace.store(runs.state(min_docs).select("h1", "h2", "n_docs", "max_doc"))
    runs.drop()
    found = hot_join(lines.select(*key, "at", "h1", "h2"), common, ["h1", "h2"], "n_docs", common.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0])
    drops = found.filter("_d <> max_doc").groupBy(*key).agg(F.collect_set("at").alias("_drop"))
    places = F.sequence(F.lit(0), F.col("n_lines") - 1)
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.transform(F.array_except(places, F.col("_drop")), lambda i: F.get("_lines", i)))
    return (
        base.join(drops, key, "left")
        .select(text_lines(F.col("_text")).alias("_lines"), "_drop", "_carry")
        .select(F.size("_lines").alias("n_lines"), "_lines", "_drop", "_carry")
        .select(kept.alias("_kept"), "n_lines", "_drop", "_carry")
        .select(
            F.col("_carry.id").alias(id_col),
            F.col("n_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
            F.array_join("_kept", "\n").alias("kept"),
            *(F.col(f"_carry.c{i}").alias(c) for i, c in enumerate(carry or [])),
        )
    )
