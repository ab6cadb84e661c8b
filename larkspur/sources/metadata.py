"""Metadata of tables as DataFrames: the table, its columns, pages and pointers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.datasource import variable_metadata
from larkspur.sources.files import opener
from larkspur.sources.layout import RELEASE, in_page, page_parts, read_layout

_TABLE = (
    "path string, row_count bigint, column_count int, table_name string, file_label string, encoding string, vendor string, compression string, "
    "endianness string, word_size int, version string, page_size int, page_count bigint, created timestamp, modified timestamp, column_list array<smallint>"
)
_COLUMNS = "index int, name string, label string, kind string, format string, format_width int, format_decimals int, width int, measure string, alignment string, system_missing boolean"


def table_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row, without a scan of the rows."""
    m = read_layout(opener(path), with_pages=False)
    h = m.header
    row = (path, m.row_count, len(m.variables), h.table_name, m.file_label, h.encoding, h.vendor, m.compression, "little" if h.little else "big", 64 if h.wide else 32, h.release, h.page_size, h.page_count, h.created, h.modified, m.column_list)
    return spark.createDataFrame([row], _TABLE)


def table_columns(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column."""
    rows = []
    for v in read_layout(opener(path), with_pages=False).variables:
        m = variable_metadata(v)
        rows.append((v.index, v.name.rstrip(), v.label or None, v.kind, v.format.strip() or None, m.get("format_width"), m.get("format_decimals"), v.width, v.measure, v.alignment, v.numeric))
    return spark.createDataFrame(rows, _COLUMNS)


def table_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_index, kind, blocks, pointers, rows: what each page holds."""
    read = opener(path)
    m = read_layout(read)
    h, rows = m.header, {p: n for p, n, _ in m.pages}
    out = []
    for i in range(h.page_count):
        kind, blocks, pointers = page_parts(h, read(h.size + i * h.page_size, h.page_size))
        out.append((i, kind, blocks, len(pointers), rows.get(i, 0)))
    return spark.createDataFrame(out, "page_index int, kind string, blocks int, pointers int, rows bigint")


def table_pointers(spark: SparkSession, path: str) -> DataFrame:
    """page_index, pointer, offset, length, compression, type, inside: every subheader pointer, and whether it fits."""
    read = opener(path)
    h = read_layout(read, with_pages=False).header
    out = []
    for i in range(h.page_count):
        for k, p in enumerate(page_parts(h, read(h.size + i * h.page_size, h.page_size))[2]):
            out.append((i, k, p.offset, p.length, p.compression, p.kind, in_page(h, p)))
    return spark.createDataFrame(out, "page_index int, pointer int, offset bigint, length bigint, compression int, type int, inside boolean")


def inspect(path: str) -> dict:
    """row_count, column_count, columns: what the command line prints."""
    m = read_layout(opener(path), with_pages=False)
    columns = [{"index": v.index, "name": v.name.rstrip(), "label": v.label or None, "kind": v.kind, "format": v.format.strip() or None, "width": v.width} for v in m.variables]
    return {"row_count": m.row_count, "column_count": len(columns), "table_name": m.header.table_name, "columns": columns}


def metadata_json(path: str) -> str:
    """Metadata of a table as JSON: counts, names, encoding, origin, times, names and types of columns."""
    m = read_layout(opener(path), with_pages=False)
    h = m.header
    release = RELEASE.match(h.release)
    version = {"major": int(release[1]) if release[1].isdigit() else 9, "minor": int(release[2]), "revision": int(release[4])} if release else None
    return json.dumps(
        {
            "row_count": m.row_count, "column_count": len(m.variables), "table_name": h.table_name, "file_label": m.file_label or None, "file_encoding": h.encoding,
            "vendor": h.vendor, "compression": m.compression, "endianness": "little" if h.little else "big", "version": version,
            "timestamps": {"created": h.created and h.created.isoformat(), "modified": h.modified and h.modified.isoformat()},
            "columns": {"names": [v.name.rstrip() for v in m.variables], "types": ["numeric" if v.numeric else "character" for v in m.variables]},
        },
        ensure_ascii=False,
    )


def result_attributes(path: str) -> dict:
    """column_types and row_count of a table, as they go with a result."""
    m = read_layout(opener(path), with_pages=False)
    return {"column_types": {v.name.rstrip(): v.kind for v in m.variables}, "row_count": m.row_count}


def describe_columns(df: DataFrame) -> DataFrame:
    """index, name, label, kind, format, width, value_labels, missing_tags of a DataFrame's columns, numbered anew after a projection."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        m = f.metadata
        rows.append((i, f.name, m.get("label") or None, m.get("sas_kind"), (m.get("format") or "").strip() or None, m.get("storage_width"), m.get("value_labels"), m.get("missing_tags"), m.get("system_missing")))
    schema = "index int, name string, label string, kind string, format string, width int, value_labels string, missing_tags string, system_missing boolean"
    return df.sparkSession.createDataFrame(rows, schema)
