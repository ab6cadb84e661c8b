"""Spark data sources for table files ("stattable") and label catalogs ("statcatalog").

A table is split by page ranges: the driver reads page headers, sums their rows and hands each task (path, pages, first
row).  Python sources get no column list from Catalyst, so `columns` (or a schema given by the user) restricts decoding.

Options: columns (comma-separated names), skipRows, maxRows, rowId (adds _row_id), sourcePath (adds _source_path),
missingTags (adds <column>__missing for numbers), blankAs (null, empty), temporalErrors (null, fail), fixMojibake,
dates (false: numbers as they are), partitionBytes, batchRows, mode (FAILFAST, PERMISSIVE: files that fail are skipped),
metadataIoMode (auto, full, streaming).  Of files of many pages, `read_table` lets tasks read the page headers first and
hands their row counts to the source (option pagePlan).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.errors import InvalidMetadata, SelectionError, TableError, warn
from larkspur.sources.catalog import read_catalog
from larkspur.sources.decode import ColumnDecoder, rows_of_page
from larkspur.sources.files import CATALOG_EXT, TABLE_EXT, discover, opener
from larkspur.sources.layout import Layout, Variable, meta_pages, parse_header, read_layout, resolve_name, stated_rows

KIND_TYPES = {"character": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampType(), "time": T.DayTimeIntervalType()}
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 65_536
#: Of files with more pages, tasks read the page headers (option pagesPerTask of read_table).
PLAN_PAGES = 1 << 14


class Options(dict):
    """Options by name, in any case."""

    def __init__(self, given: dict):
        super().__init__({k.lower(): v for k, v in given.items()})

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def _flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).strip().lower() in ("true", "1", "yes")


def variable_metadata(v: Variable) -> dict:
    meta = {"label": v.label, "format": v.format, "storage_width": v.width, "measure": v.measure, "alignment": v.alignment, "sas_kind": v.kind}
    return meta | ({"format_width": v.format_width, "format_decimals": v.format_decimals} if v.format_width is not None else {})


def chosen(layout: Layout, columns: str | list[str] | None) -> list[Variable]:
    """Variables in the order asked for; all if nothing is asked for.  Unknown and repeated names are errors."""
    if not columns:
        return layout.variables
    wanted = [c for c in (columns.split(",") if isinstance(columns, str) else columns) if c]
    names, out = [v.name for v in layout.variables], []
    for c in wanted:
        at = resolve_name(names, c)
        if at < 0:
            raise SelectionError(f"unknown column {c!r}")
        if layout.variables[at] in out:
            raise SelectionError(f"column {c!r} is asked for twice")
        out.append(layout.variables[at])
    return out


def table_schema(layout: Layout, options: dict) -> T.StructType:
    out = T.StructType()
    dates, tags = _flag(options, "dates", True), _flag(options, "missingTags", False)
    for v in chosen(layout, options.get("columns")):
        kind = v.kind if dates or v.kind == "character" else "double"
        out.add(T.StructField(v.name.rstrip(), KIND_TYPES[kind], True, variable_metadata(v)))
        if tags and v.numeric:
            out.add(T.StructField(f"{v.name.rstrip()}__missing", T.StringType(), True))
    if _flag(options, "rowId", False):
        out.add("_row_id", T.LongType())
    if _flag(options, "sourcePath", False):
        out.add("_source_path", T.StringType())
    return out


@dataclass
class Pages(InputPartition):
    path: str
    pages: list  # (page, rows, first row), or one (first page, end, first row) of a planned range
    layout: Layout | None = None  # without pages, so that tasks needn't scan the file
    planned: bool = False


class TableReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.options = Options(options)
        self.paths = _paths(options, TABLE_EXT)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        size = int(self.options.get("partitionBytes", PARTITION_BYTES))
        skip, most = int(self.options.get("skipRows", 0)), int(self.options.get("maxRows", -1))
        plans = json.loads(self.options.get("pagePlan", "{}"))
        for path in self.paths:
            plan = plans.get(path)
            try:
                layout = read_layout(opener(path), io_mode=self.options.get("metadataIoMode", "auto").lower(), with_pages=plan is None, only=plan and plan["meta"])
            except TableError as e:
                if self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
                    raise
                warn(str(e), path)
                continue
            end = layout.row_count if most < 0 else skip + most
            bare = replace(layout, pages=[])
            if plan is not None:
                ends = [c[2] for c in plan["ranges"][1:]] + [layout.row_count]
                out += [Pages(path, [tuple(c)], bare, True) for c, e in zip(plan["ranges"], ends, strict=True) if c[2] < end and e > skip]
                continue
            kept = [p for p in layout.pages if p[2] + p[1] > skip and p[2] < end]  # pages outside the window aren't read
            step = max(1, size // layout.header.page_size)
            out += [Pages(path, kept[i : i + step], bare) for i in range(0, len(kept), step)]
        return out or [Pages("", [])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        if not partition.pages:
            return
        read, layout, pages = opener(partition.path), partition.layout, partition.pages
        if partition.planned:
            (low, high, first), pages = partition.pages[0], []
            for i, n in stated_rows(layout, read, range(low, high)):
                n = min(n, layout.row_count - first)
                if n > 0:
                    pages.append((i, n, first))
                    first += n
        yield from decode_pages(layout, read, pages, self.names, self.options, partition.path)


def decode_pages(layout: Layout, read, pages: list, names: list[str], options: dict, path: str = "") -> Iterator[pa.RecordBatch]:
    """Batches of the columns `names` of a table's pages; companion columns by their names."""
    h, options = layout.header, Options(options)
    skip, most = int(options.get("skipRows", 0)), int(options.get("maxRows", -1))
    end = layout.row_count if most < 0 else skip + most
    decoder = ColumnDecoder(
        layout, blank_as=options.get("blankAs", "null"), temporal_errors=options.get("temporalErrors", "null"),
        fix_mojibake=_flag(options, "fixMojibake", True), dates=_flag(options, "dates", True),
    )
    all_names = [v.name for v in layout.variables]
    want = int(options.get("batchRows", BATCH_ROWS)) or BATCH_ROWS
    held: list[np.ndarray] = []
    first, count = 0, 0

    def batch() -> pa.RecordBatch:
        rows = held[0] if len(held) == 1 else np.concatenate(held)
        cols = []
        for name in names:
            if name == "_row_id" and resolve_name(all_names, name) < 0:
                cols.append(pa.array(np.arange(first, first + len(rows)), pa.int64()))
            elif name == "_source_path" and resolve_name(all_names, name) < 0:
                cols.append(pa.array([path] * len(rows), pa.string()))
            elif name.endswith("__missing") and resolve_name(all_names, name) < 0:
                cols.append(decoder.tags(layout.variables[resolve_name(all_names, name.removesuffix("__missing"))], rows))
            else:
                at = resolve_name(all_names, name)
                if at < 0:
                    raise SelectionError(f"{path}: no column {name!r}")
                cols.append(decoder.column(layout.variables[at], rows))
        return pa.RecordBatch.from_arrays(cols, names=names)

    for page, n, start in pages:
        rows = rows_of_page(layout, read(h.size + page * h.page_size, h.page_size), n)
        low, high = max(0, skip - start), min(len(rows), end - start)
        if low >= high:
            continue
        if held and (start + low != first + count or count >= want):
            yield batch()
            held, count = [], 0
        if not held:
            first = start + low
        held.append(rows[low:high])
        count += high - low
    if held:
        yield batch()


def _paths(options: dict, ext: str) -> list[str]:
    asked = options.get("paths") or options.get("path")
    if not asked:
        raise InvalidMetadata("no path given")
    asked = json.loads(asked) if asked.startswith("[") else [asked]
    found = discover(asked, ext)
    if not found:
        raise FileNotFoundError(f"no {ext} file below {asked}")
    return found


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stattable"

    def schema(self) -> T.StructType:
        for path in _paths(self.options, TABLE_EXT):
            try:
                plan = json.loads(self.options.get("pagePlan", "{}")).get(path)
                mode = self.options.get("metadataIoMode", "auto").lower()
                return table_schema(read_layout(opener(path), with_pages=False, io_mode=mode, only=plan and plan["meta"]), self.options)
            except TableError as e:
                if self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
                    raise
                warn(str(e), path)
        raise InvalidMetadata("no table could be read")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TableReader(schema, self.options)


LABEL_SCHEMA = "set_name string, value_type string, key_kind string, key_number double, key_tag string, key_string string, label string"


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = _paths(options, CATALOG_EXT)

    def partitions(self) -> list[InputPartition]:
        return [Pages(p, []) for p in self.paths]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for s in read_catalog(opener(partition.path)):
            for x in s.labels:
                yield (s.name, "numeric" if s.numeric else "string", x.key_kind, x.number, x.tag, x.string, x.label)


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statcatalog"

    def schema(self) -> str:
        return LABEL_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CatalogReader(self.options)


def read_raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """_row_id and raw (binary, row_length bytes) of every row, for kernels of one's own; `raw_cells` cuts columns out."""
    layout = read_layout(opener(path))
    step = max(1, PARTITION_BYTES // layout.header.page_size)
    parts = [layout.pages[i : i + step] for i in range(0, len(layout.pages), step)]
    bare = replace(layout, pages=[])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, h = opener(path), bare.header
        for batch in batches:
            for k in batch.column("id").to_pylist():
                for page, n, first in parts[k]:
                    rows = rows_of_page(bare, read(h.size + page * h.page_size, h.page_size), n)
                    width = rows.shape[1]
                    raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows)), pa.int64()), raw], names=["_row_id", "raw"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, "_row_id long, raw binary")


def raw_cells(rows: DataFrame, layout: Layout, name: str) -> DataFrame:
    """_row_id, cell (the column's stored bytes) and, for numbers, bits (of the double, as bigint)."""
    from pyspark.sql import functions as F

    at = resolve_name([v.name for v in layout.variables], name)
    if at < 0:
        raise SelectionError(f"unknown column {name!r}")
    v = layout.variables[at]
    cell = F.substring("raw", v.offset + 1, v.width)
    out = rows.select("_row_id", cell.alias("cell"))
    if not v.numeric:
        return out
    # the bytes kept are the high-order ones
    pad = F.lit(bytes(8 - v.width))
    order = F.concat(pad, F.col("cell")) if layout.header.little else F.concat(F.col("cell"), pad)
    hexed = F.hex(order)
    if layout.header.little:
        hexed = F.concat(*(F.substring(hexed, 2 * k + 1, 2) for k in range(7, -1, -1)))
    high = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("bigint")
    return out.withColumn("bits", F.shiftleft(high, 32).bitwiseOR(low))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TableSource)
    spark.dataSource.register(CatalogSource)


def read_table(spark: SparkSession, path: str | list[str], *, columns: list[str] | None = None, **options) -> DataFrame:
    """Reads one table, or all tables below folders (which share the first one's columns)."""
    register(spark)
    reader = spark.read.format("stattable").options(**{k: str(v) for k, v in options.items()})
    if columns:
        reader = reader.option("columns", ",".join(columns))
    asked = [path] if isinstance(path, str) else path
    step = int(Options(options).get("pagesPerTask", PLAN_PAGES))
    plans = {}
    for p in discover(asked, TABLE_EXT):
        try:
            header = parse_header(opener(p), catalog=False)
        except TableError:
            continue  # the source reports it
        if header.page_count > step:
            plans[p] = plan_pages(spark, p, header.page_count, max(1, min(step, int(Options(options).get("partitionBytes", PARTITION_BYTES)) // header.page_size)))
    if plans:
        reader = reader.option("pagePlan", json.dumps(plans))
    return reader.option("paths", json.dumps(asked)).load()


def plan_pages(spark: SparkSession, path: str, page_count: int, step: int) -> dict:
    """meta: pages that hold metadata; ranges: (first page, end, first row).  Page headers are read by tasks.

    The driver gets the numbers of the pages with metadata, and one row count for each range.
    """
    slots = max(1, min(-(-page_count // step), 4 * spark.sparkContext.defaultParallelism))
    ranges = spark.range(0, page_count, step, slots)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = opener(path)
        h = parse_header(read, catalog=False)
        for batch in batches:
            found = [i for a in batch.column("id").to_pylist() for i in meta_pages(h, read, a, a + step)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["page"])

    meta = sorted(r["page"] for r in ranges.mapInArrow(heads, "page long").collect())
    layout = read_layout(opener(path), with_pages=False, only=meta)
    h = layout.header

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = opener(path)
        for batch in batches:
            first = batch.column("id").to_pylist()
            n = [sum(k for _, k in stated_rows(layout, read, range(a, a + step))) for a in first]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["first", "n"])

    out, at = [], 0
    for r in sorted(ranges.mapInArrow(rows, "first long, n long").collect()):
        if r["n"]:
            out.append((r["first"], min(r["first"] + step, h.page_count), at))
            at += r["n"]
    return {"meta": meta, "ranges": out}


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("statcatalog").option("path", path).load()


def read_table_bytes(files: DataFrame, schema: T.StructType, **options) -> DataFrame:
    """Tables held in a binary column `content` (as of Spark's binaryFile source), from any store Spark reads."""
    from larkspur.sources.files import memory

    names, opts = [f.name for f in schema.fields], Options({k: str(v) for k, v in options.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                read = memory(content.as_py())
                layout = read_layout(read, io_mode=opts.get("metadataIoMode", "auto").lower())
                yield from decode_pages(layout, read, layout.pages, names, opts, path.as_py())

    return files.select("path", "content").mapInArrow(run, schema)
