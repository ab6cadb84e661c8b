"""What the operators of this subpackage share: work folders, Arrow text access, byte hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: White space of the contracts: blank and U+0009..U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Texts are handled in slices of about this many bytes, so that NumPy's temporaries stay small.
SLICE_BYTES = 2 << 20
#: Stands for a null id where ids are join keys.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, size_mb: int = 16) -> None:
    """Fewer rows and bytes in an Arrow batch than Spark's default: a batch of whole texts has to fit a worker.

    Plans run later than they are made, so the session keeps the smaller limits.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size_mb}m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary one; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def release_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice which shuffle files nothing refers to any more; else they stay until its memory fills."""
    gc.collect()
    spark._jvm.System.gc()


class Workspace:
    """Written tables of one run in the shared folder; they go when the driver ends or drop() is called."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def store(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Writes df as Parquet and reads it again: the plan starts anew from files that outlive executors."""
        self._n += 1
        out = f"{self.path}/t{self._n}"
        writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(out)
        release_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone at exit; the files are in a folder that is cleaned anyway
            pass


def id_type(df: DataFrame, id_col: str) -> str:
    """bigint or string: how an id is held inside.  Other kinds of ids are an error."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "bigint"
    if kind == "string":
        return "string"
    raise TypeError(f"ids are whole numbers or texts, not {kind}")


def id_key(df: DataFrame, id_col: str) -> Column:
    """The id as a join key: never null, and a null id is smaller than all others."""
    if id_type(df, id_col) == "bigint":
        return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return F.coalesce(F.concat(F.lit("="), F.col(id_col)), F.lit(""))


def id_back(df: DataFrame, id_col: str, key: str = "_d") -> Column:
    """The id that a key stands for."""
    if id_type(df, id_col) == "bigint":
        return F.nullif(F.col(key), F.lit(NO_ID)).cast(df.schema[id_col].dataType)
    return F.when(F.col(key) != "", F.substring(F.col(key), 2, (1 << 31) - 1))


def doc_key(df: DataFrame, id_col: str, text_col: str) -> list:
    """Columns (_d, _t) that tell rows apart even if ids repeat or are null; equal rows share them."""
    return [id_key(df, id_col).alias("_d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t")]


#: At most so many keys are called hot, and their rows of the small side are broadcast.
HOT_KEYS = 256


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one row for each key.  No key's rows meet in one task.

    weight: a column of right, how many rows of left its key has; total: rows of left.  Keys that have a HOT_KEYS-th of
    all rows are at most HOT_KEYS many, whatever the data, so their rows of right are broadcast and left's stay in place.
    """
    bar = max(total // HOT_KEYS, 1) + 1
    hot = F.broadcast(right.filter(F.col(weight) >= bar))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(F.col(weight) < bar), keys)
    return left.join(hot, keys).unionByName(cold)


_KEPT: dict = {}


def keep(owner: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps for its next tasks, of one owner at a time: tables of stages that follow each other in
    the same workers don't add up."""
    if owner not in _KEPT:
        _KEPT.clear()
        gc.collect()  # a machine and its cache refer to each other
        _KEPT[owner] = make()
    return _KEPT[owner]


def text_bytes(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, joined, and where each begins (one more entry than texts). Null: empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(offs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text each, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    lens = np.asarray(pc.fill_null(pc.binary_length(col.cast(pa.large_binary())), 0), dtype=np.int64)
    first, total = 0, 0
    for i, n in enumerate(lens):
        if total and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


# --- 64-bit polynomial fingerprints of byte ranges, for whole buffers at once -------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Fingerprints of any byte range of a buffer from prefix sums; two lanes give 128 bits.

    The sum of code(byte) * base**i is taken modulo 2**64; dividing by base**start makes it independent of
    where the range lies.  Codes of bytes are random, so short ranges collide no more than random numbers do.
    """

    def __init__(self, data: np.ndarray, lane: int = 0):
        """data: bytes, or 64-bit codes of whatever the ranges are made of."""
        n = len(data)
        power, inverse = self._tables(lane, n + 1)
        self.inverse = inverse
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((BYTE_CODES[lane][data] if data.dtype == np.uint8 else data) * power[:n], out=self.prefix[1:])

    @classmethod
    def _tables(cls, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, n at least.  Those for a slice are kept; longer ones, for a text that is
        a slice of its own, are made anew and let go."""
        usual = SLICE_BYTES + (1 << 17)
        kept = keep(cls, dict)
        if n > usual:
            return cls._make(lane, n)
        if lane not in kept:
            kept[lane] = cls._make(lane, usual)
        return kept[lane]

    @staticmethod
    def _make(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        both = []
        for x in (int(BASES[lane]), pow(int(BASES[lane]), -1, 1 << 64)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64, out=steps))
        return both[0], both[1]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
