"""Writers: Parquet with row-group control, CSV and TSV with the exact text of every cell; output paths."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import SinkError
from larkspur.functions import scalars as S
from larkspur.functions.scalars import cell_kind, date_text, datetime_text, number_text, time_text
from larkspur.operators.selection import quoted

DEFAULT_ROWS, MOST_ROWS, DEFAULT_BYTES = 65_536, 262_144, 512 << 20


def row_group_rows(widths: list[int], row_count: int, target_bytes: int = DEFAULT_BYTES) -> int:
    """Rows of a row group of about target_bytes, from the columns' storage widths: 1 to 262144 and to row_count."""
    per_row = max(1, sum(widths))
    return max(1, min(max(target_bytes, 1) // per_row, MOST_ROWS, max(row_count, 1)))


def write_parquet(df: DataFrame, path: str, *, rows: int | None = None, target_bytes: int | None = None, row_count: int | None = None, single_file: bool = False, mode: str = "error", compression: str = "zstd") -> None:
    """rows or target_bytes set the row-group size; single_file: one file, for small tables."""
    if rows is None:
        widths = [f.metadata.get("storage_width", 8) for f in df.schema.fields]
        rows = row_group_rows(widths, row_count or MOST_ROWS, target_bytes) if target_bytes else DEFAULT_ROWS
    df = df.coalesce(1) if single_file else df
    df.write.mode(mode).option("compression", compression).option("parquet.block.row.count.limit", max(1, rows)).parquet(path)


def cell_text(c: Column, type_name: str) -> Column:
    """Text of a cell: missing is empty, numbers shortest, dates and times as in CSV."""
    kind = cell_kind(type_name)
    if kind == "number":
        text = number_text(c.cast("double")) if type_name in ("float", "double") or type_name.startswith("decimal") else c.cast("string")
    elif kind == "date":
        text = date_text(c)
    elif kind == "datetime":
        text = datetime_text(c)
    elif kind == "time":
        text = time_text(F.unix_micros(F.timestamp_micros(F.lit(0)) + c))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, names without trailing blanks."""
    return df.select(*(cell_text(F.col(quoted(n)), t).alias(n.rstrip()) for n, t in df.dtypes))


def write_csv(df: DataFrame, path: str, *, sep: str = ",", header: bool = True, single_file: bool = False, mode: str = "error") -> None:
    """RFC 4180: quotes only where needed, doubled inside, lines end in \\n."""
    if len(sep) != 1:
        raise ValueError("the delimiter is one character")
    out = as_text(df)
    out = out.coalesce(1) if single_file else out
    opts = {"emptyValue": "", "escape": '"', "sep": sep, "header": str(header).lower(), "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}
    out.write.mode(mode).options(**opts).csv(path)


def write_tsv(df: DataFrame, path: str, **options) -> None:
    write_csv(df, path, sep="\t", **options)


def write_table(df: DataFrame, kind: str, path: str, **options) -> None:
    """kind: parquet, csv or tsv, in any case and with blanks around it."""
    name = kind.strip().lower()
    writers = {"parquet": write_parquet, "csv": write_csv, "tsv": write_tsv}
    if name not in writers:
        raise ValueError(f"unknown kind of output: {kind!r}")
    writers[name](df, path, **options)


@dataclass(frozen=True)
class SinkContext:
    """What a sink is told at its beginning: names, types and metadata of the columns, and where the rows come from."""

    columns: list[str]
    types: list[str]
    metadata: list[dict]
    source_path: str | None = None


class RowSink:
    """Base of user sinks: begin once, write each row, finish; used by stream_into on every partition."""

    def begin(self, context: SinkContext) -> None: ...

    def write(self, row) -> None:
        raise NotImplementedError

    def finish(self) -> None: ...


class BatchSink:
    """Base of user sinks that take Arrow batches."""

    def begin(self, context: SinkContext) -> None: ...

    def write_batch(self, batch: pa.RecordBatch) -> None:
        raise NotImplementedError

    def finish(self) -> None: ...


class Guard:
    """Checks the life of a sink: begin, rows, finish; no rows outside, no second begin before finish, whole rows only."""

    def __init__(self, sink):
        self.sink, self.open, self.width = sink, False, 0

    def begin(self, context: SinkContext) -> None:
        if self.open:
            raise SinkError("the sink is in use; finish it first")
        if not len(context.columns) == len(context.types) == len(context.metadata):
            raise SinkError("names, types and metadata of the columns differ in number")
        self.open, self.width = True, len(context.columns)
        self.sink.begin(context)

    def _check(self, width: int) -> None:
        if not self.open:
            raise SinkError("rows before the sink has begun")
        if width != self.width:
            raise SinkError(f"row of {width} cells, {self.width} columns")

    def write(self, row) -> None:
        self._check(len(row))
        self.sink.write(row)

    def write_batch(self, batch: pa.RecordBatch) -> None:
        self._check(batch.num_columns)
        self.sink.write_batch(batch)

    def finish(self) -> None:
        if not self.open:
            raise SinkError("finish before the sink has begun")
        self.open = False
        self.sink.finish()


def sink_context(df: DataFrame, source_path: str | None = None) -> SinkContext:
    return SinkContext(list(df.columns), [t for _, t in df.dtypes], [dict(f.metadata) for f in df.schema.fields], source_path)


def stream_into(df: DataFrame, make_sink, source_path: str | None = None) -> None:
    """Sends each partition's rows to a sink of its own, made by make_sink() where the rows are."""
    context = sink_context(df, source_path)

    def send(rows: Iterator) -> None:
        sink = Guard(make_sink())
        sink.begin(context)
        for row in rows:
            sink.write(row)
        sink.finish()

    df.foreachPartition(send)


def stream_batches_into(df: DataFrame, make_sink, source_path: str | None = None) -> int:
    """Sends each partition's Arrow batches to a sink of its own; how many rows went."""
    context = sink_context(df, source_path)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n = Guard(make_sink()), 0
        sink.begin(context)
        for batch in batches:
            sink.write_batch(batch)
            n += batch.num_rows
        sink.finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.mapInArrow(send, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def coerce(c: Column, type_name: str, target: str) -> Column:
    """A cell as another kind of column takes it: number, date, timestamp, time (microseconds) or utf8.

    Text is trimmed and parsed, empty text is null.  Dates, datetimes and times become their days or seconds since 1960
    as numbers; numbers are read as days or seconds where a date, datetime or time is asked for.  A bigint beyond 2**53
    is no number.
    """
    kind = cell_kind(type_name)
    if target == "utf8":
        return F.when(c.isNotNull(), cell_text(c, type_name))
    if kind in ("string", "bytes"):
        number = S.parse_double(c.cast("string"))
    elif type_name == "bigint":
        number = S.safe_double(c, strict=False)
    else:
        number = S.cell_number(c, type_name)
    if target == "number":
        return number
    if target == "date":
        return S.as_date(c, type_name) if kind in ("date", "datetime") else S.days_to_date(number)
    if target == "timestamp":
        return c.cast("timestamp") if kind in ("date", "datetime") else S.seconds_to_timestamp(number)
    if target == "time":
        return S.seconds_to_micros(number)
    raise ValueError(f"unknown target {target!r}")


def output_path(root: str, source: str, ext: str, *, out: str | None = None, out_dir: str | None = None, flatten: bool = False) -> str:
    """Where a source file's output goes: out itself, below out_dir (as the tree, or flat), or beside the source."""
    if out:
        return out
    name = os.path.splitext(os.path.basename(source))[0] + "." + ext
    if not out_dir:
        return os.path.join(os.path.dirname(source), name)
    inner = "" if flatten or not os.path.isdir(root) else os.path.relpath(os.path.dirname(source), root)
    return os.path.normpath(os.path.join(out_dir, inner, name))


def plan_outputs(roots: list[str], found: dict[str, str], ext: str, *, out: str | None = None, out_dir: str | None = None, flatten: bool = False) -> dict[str, str]:
    """source -> output for all sources (source -> root); two sources with one output are an error."""
    if out and len(found) != 1:
        raise ValueError("one output needs exactly one input")
    plan: dict[str, str] = {}
    taken: dict[str, str] = {}
    for source, root in found.items():
        path = output_path(root, source, ext, out=out, out_dir=out_dir, flatten=flatten)
        if path in taken:
            raise ValueError(f"{source} and {taken[path]} would both be written to {path}")
        plan[source], taken[path] = path, source
    return plan
