"""Queries over tables written in the binary format, sinks, metadata, comparison and conversion, with their SQL."""

from __future__ import annotations

import json
import os
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from larkspur.functions import scalars as S
from larkspur.operators import compare as C
from larkspur.operators.selection import MaskedRow, column_index, select_names
from larkspur.plans.queries import _CUSTOMER, _bits, _encoded, _read, _scratch, query, t

# --- sources ------------------------------------------------------------------------------------------------------------


@query(_CUSTOMER)
def src_3_streamed_metadata(spark, d):
    """The same table, its metadata pages read piece by piece."""
    return _read(spark, _encoded(spark, d, "customer"), metadataIoMode="streaming")


@query(_CUSTOMER)
def src_6_planned_pages(spark, d):
    """Page headers read by tasks, ranges of pages handed to the source."""
    return _read(spark, _encoded(spark, d, "customer"), pagesPerTask=2, partitionBytes=65536)


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders QUALIFY _row_id BETWEEN 40 AND 1239")
def src_6_planned_window(spark, d):
    return _read(spark, _encoded(spark, d, "orders", "o_orderkey", compression="rle"), columns=["o_orderkey", "o_totalprice"], pagesPerTask=1, rowId=True, skipRows=40, maxRows=1200)


class _Lines:
    """Writes each row as a line of JSON to a file of its own."""

    def __init__(self, folder: str):
        self.folder = folder

    def begin(self, context) -> None:
        import uuid

        self.names = context.columns
        self.file = open(os.path.join(self.folder, uuid.uuid4().hex + ".json"), "w")  # noqa: SIM115

    def write(self, row) -> None:
        self.file.write(json.dumps(dict(zip(self.names, row, strict=True))) + "\n")

    def write_batch(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            self.file.write(json.dumps(row) + "\n")

    def finish(self) -> None:
        self.file.close()


@query(_CUSTOMER)
def src_12_streamed_rows(spark, d):
    """Rows to a visitor where they are; what it wrote, read again."""
    from larkspur.sources.sinks import stream_into

    out = _scratch(spark)
    stream_into(_read(spark, _encoded(spark, d, "customer")), lambda: _Lines(out))
    return spark.read.schema("c_custkey double, c_name string, c_nationkey double, c_acctbal double, c_mktsegment string").json(f"file://{out}")


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 300")
def src_13_row_iterator(spark, d):
    """The first rows of an iterator over a table."""
    rows = _read(spark, _encoded(spark, d, "customer"), columns=["c_custkey", "c_name"], maxRows=300).toLocalIterator(prefetchPartitions=True)
    return spark.createDataFrame([tuple(r) for r in rows], "c_custkey double, c_name string")


def _batch_sizes(spark, path: str, **options):
    """n: rows of each Arrow batch that the decoder makes of a file, in one task."""
    from larkspur.sources.datasource import decode_pages
    from larkspur.sources.files import opener
    from larkspur.sources.layout import read_layout

    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                read = opener(path)
                layout = read_layout(read)
                sizes = [x.num_rows for x in decode_pages(layout, read, layout.pages, [v.name for v in layout.variables], options)]
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n"])

    return spark.range(1).mapInArrow(run, "n long")


@query("SELECT count(*) AS n, true AS small FROM customer")
def src_14_small_batches(spark, d):
    """All rows come, in batches of about the size asked for (64 rows, and up to a page more)."""
    sizes = _batch_sizes(spark, _encoded(spark, d, "customer", page_size=4096), batchRows=64)
    return sizes.agg(F.sum("n").alias("n"), (F.max("n") <= 128).alias("small"))


@query("SELECT count(*) AS n, 1 AS batches FROM supplier")
def src_15_contiguous_batch(spark, d):
    """A batch goes over pages: these rows fit in one."""
    sizes = _batch_sizes(spark, _encoded(spark, d, "supplier", page_size=4096), batchRows=10_000_000)
    return sizes.agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("batches"))


@query(_CUSTOMER)
def src_16_pointer_rows(spark, d):
    """Every row raw behind a pointer of its own."""
    return _read(spark, _encoded(spark, d, "customer", compression="raw"))


@query(_CUSTOMER)
def src_21_discovery(spark, d):
    """A folder of tables in two places, its other files passed over."""
    import shutil

    path = _encoded(spark, d, "customer")
    top = _scratch(spark)
    for k, inner in enumerate(("a", os.path.join("b", "c"))):
        os.makedirs(os.path.join(top, inner))
        shutil.copy(path, os.path.join(top, inner, f"T{k}.SAS7BDAT"))
    open(os.path.join(top, "notes.txt"), "w").close()
    return _read(spark, top, sourcePath=True).filter(F.col("_source_path").endswith("T1.SAS7BDAT")).drop("_source_path")


@query(_CUSTOMER)
def src_22_archive(spark, d):
    """A table in a ZIP archive, fetched from an address."""
    from larkspur.sources.files import download, extract_table

    path, folder = _encoded(spark, d, "customer"), _scratch(spark)
    archive = os.path.join(_scratch(spark), "tables.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "no table")
        z.write(path, "inner/customer.sas7bdat")
    return _read(spark, extract_table(download("file://" + archive, folder), folder))


@query("SELECT count(*) AS n_rows, 0 AS outside, 0 AS odd FROM customer")
def src_23_diagnostics(spark, d):
    """Rows by page, and pointers that lie outside their page."""
    from larkspur.sources.metadata import table_pages, table_pointers

    path = _encoded(spark, d, "customer", compression="rle")
    pages = table_pages(spark, path).agg(F.sum("rows").alias("n_rows"), F.count_if(~F.col("kind").isin("meta", "data", "mix")).cast("int").alias("odd"))
    outside = table_pointers(spark, path).agg(F.count_if(~F.col("inside")).cast("int").alias("outside"))
    return pages.join(outside)


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey FROM customer")
def udf_6_raw_cells(spark, d):
    """Stored bytes of one column, turned into numbers by a kernel of the caller's."""
    from larkspur.sources.datasource import raw_cells, read_raw_rows
    from larkspur.sources.files import opener
    from larkspur.sources.layout import read_layout

    path = _encoded(spark, d, "customer", little=False)
    cells = raw_cells(read_raw_rows(spark, path), read_layout(opener(path), with_pages=False), "c_custkey")

    def kernel(batches):
        import numpy as np

        for batch in batches:
            bits = batch.column("bits").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(bits, np.int64).view(np.float64))], names=["c_custkey"])

    return cells.mapInArrow(kernel, "c_custkey double")


# --- sinks --------------------------------------------------------------------------------------------------------------


@query("SELECT c_acctbal, c_name FROM customer")
def snk_2_columnar_selection(spark, d):
    """Chosen columns, in another order, through the columnar writer."""
    from larkspur.sources.sinks import write_parquet

    out = os.path.join(_scratch(spark), "out")
    write_parquet(_read(spark, _encoded(spark, d, "customer"), columns=["c_acctbal", "c_name"]), out)
    return spark.read.parquet(f"file://{out}")


@query("SELECT CAST(w AS INTEGER) AS width, CAST(greatest(1, least(1000000 // w, 262144, 5000)) AS BIGINT) AS n_rows FROM range(1, 400) r(w)")
def snk_4_row_group_bytes(spark, d):
    from larkspur.sources.sinks import row_group_rows

    return spark.createDataFrame([(w, row_group_rows([w // 2, w - w // 2], 5000, 1_000_000)) for w in range(1, 400)], "width int, n_rows long")


_COERCE = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS number, CAST(ts AS DATE) AS day,
 epoch(date_trunc('second', ts)) + 315619200.0 AS seconds, CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS safe,
 TIMESTAMP '1960-01-01' + to_seconds(CAST(event_id AS INTEGER)) AS stamp, event_id * 1500000 AS micros, CAST(event_id AS VARCHAR) AS words FROM events"""


@query(_COERCE)
def snk_6_coercions(spark, d):
    """Cells of one kind for columns of another."""
    from larkspur.sources.sinks import coerce

    e, i = t(spark, d, "events"), F.col("event_id").cast("bigint")
    text = F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return e.select(
        "event_id", coerce(text, "string", "number").alias("number"), coerce(F.col("ts"), "timestamp_ntz", "date").alias("day"),
        coerce(F.date_trunc("second", "ts").cast("timestamp_ntz"), "timestamp_ntz", "number").alias("seconds"),
        coerce(F.when(i % 2 == 0, F.lit((1 << 53) + 1)).otherwise(i), "bigint", "number").alias("safe"),
        coerce(i.cast("double"), "double", "timestamp").cast("timestamp_ntz").alias("stamp"), coerce(i.cast("double") * 1.5, "double", "time").alias("micros"), coerce(i.cast("double"), "double", "utf8").alias("words"),
    )


@query("SELECT CAST(p_partkey AS DOUBLE) AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '1960-01-01' + CAST(p_partkey AS INTEGER) END AS d FROM part")
def snk_7_lenient_dates(spark, d):
    """Dates out of range are null; the task warns once for the column."""
    from larkspur.sources.encoder import write_table

    keys = [r[0] for r in t(spark, d, "part").select("p_partkey").collect()]
    path = os.path.join(_scratch(spark), "dates.sas7bdat")
    write_table(path, [("k", "num", 8, "", "", [float(k) for k in keys]), ("d", "num", 8, "DATE9.", "", [1e12 if k % 5 == 0 else float(k) for k in keys])])
    return _read(spark, path)


def _csv_sql(table: str, key: str, text: str) -> str:
    return f"SELECT CAST({key} AS VARCHAR) AS k, {text} AS x FROM {table}"


@query(_csv_sql("customer", "c_custkey", "c_name"))
def snk_9_tsv(spark, d):
    from larkspur.sources.sinks import write_tsv

    out = os.path.join(_scratch(spark), "out")
    write_tsv(_read(spark, _encoded(spark, d, "customer"), columns=["c_custkey", "c_name"]), out)
    return spark.read.option("sep", "\t").option("header", "true").csv(f"file://{out}").toDF("k", "x")


@query(_csv_sql("customer", "c_custkey", "c_mktsegment"))
def snk_10_no_header(spark, d):
    from larkspur.sources.sinks import write_csv

    out = os.path.join(_scratch(spark), "out")
    write_csv(_read(spark, _encoded(spark, d, "customer"), columns=["c_custkey", "c_mktsegment"]), out, header=False)
    return spark.read.csv(f"file://{out}").toDF("k", "x")


_PATHS = "SELECT * FROM (VALUES ('tree', '/r/a/x.sas7bdat', '/o/a/x.csv'), ('tree', '/r/y.sas7bdat', '/o/y.csv'), ('flat', '/r/a/x.sas7bdat', '/o/x.csv'), ('flat', '/r/y.sas7bdat', '/o/y.csv'), ('beside', '/r/a/x.sas7bdat', '/r/a/x.csv'), ('beside', '/r/y.sas7bdat', '/r/y.csv')) v(mode, source, output)"


@query(_PATHS)
def snk_12_output_paths(spark, d):
    from larkspur.sources.sinks import plan_outputs

    top = _scratch(spark)
    found = {os.path.join(top, "a", "x.sas7bdat"): top, os.path.join(top, "y.sas7bdat"): top}
    rows = []
    for mode, options in (("tree", {"out_dir": "/o"}), ("flat", {"out_dir": "/o", "flatten": True}), ("beside", {})):
        rows += [(mode, s.replace(top, "/r"), o.replace(top, "/r")) for s, o in plan_outputs([top], found, "csv", **options).items()]
    return spark.createDataFrame(rows, "mode string, source string, output string")


@query("SELECT s_suppkey * 1.0::DOUBLE AS s_suppkey, s_name, s_nationkey * 1.0::DOUBLE AS s_nationkey, s_acctbal FROM supplier")
def snk_14_writer_by_name(spark, d):
    from larkspur.sources.sinks import write_table

    out = os.path.join(_scratch(spark), "out")
    write_table(_read(spark, _encoded(spark, d, "supplier"), columns=["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]), " Parquet ", out)
    return spark.read.parquet(f"file://{out}")


@query("SELECT * FROM (VALUES ('begin twice', 'the sink is in use; finish it first'), ('early row', 'rows before the sink has begun'), ('short row', 'row of 1 cells, 2 columns'), ('early end', 'finish before the sink has begun'), ('whole life', 'ok')) v(step, outcome)")
def snk_15_lifecycle(spark, d):
    from larkspur.errors import SinkError
    from larkspur.sources.sinks import Guard, RowSink, sink_context

    class Nothing(RowSink):
        def write(self, row) -> None: ...

    context = sink_context(t(spark, d, "region").select("r_regionkey", "r_name"))
    steps = {
        "begin twice": lambda s: (s.begin(context), s.begin(context)), "early row": lambda s: s.write((1, 2)), "short row": lambda s: (s.begin(context), s.write((1,))),
        "early end": lambda s: s.finish(), "whole life": lambda s: (s.begin(context), s.write((1, "a")), s.finish(), s.begin(context), s.finish()),
    }
    rows = []
    for name, act in steps.items():
        try:
            act(Guard(Nothing()))
            rows.append((name, "ok"))
        except SinkError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "step string, outcome string")


@query("SELECT s_suppkey, s_name FROM supplier")
def udf_2_batch_sink(spark, d):
    """Arrow batches to a sink of the caller's; what it wrote, read again."""
    from larkspur.sources.sinks import stream_batches_into

    out = _scratch(spark)
    stream_batches_into(t(spark, d, "supplier").select("s_suppkey", "s_name"), lambda: _Lines(out))
    return spark.read.schema("s_suppkey bigint, s_name string").json(f"file://{out}")


@query("SELECT name, type, label, source FROM (VALUES ('c_custkey', 'double', 'label of c_custkey', 'here'), ('c_name', 'string', '', 'here')) v(name, type, label, source)")
def snk_16_context(spark, d):
    from larkspur.sources.sinks import sink_context

    c = sink_context(_read(spark, _encoded(spark, d, "customer"), columns=["c_custkey", "c_name"]), "here")
    return spark.createDataFrame([(n, k, m["label"], c.source_path) for n, k, m in zip(c.columns, c.types, c.metadata, strict=True)], "name string, type string, label string, source string")


# --- projection, files, cells ---------------------------------------------------------------------------------------------


@query("SELECT 0 AS index, 'c_mktsegment' AS name, 'character' AS kind, CAST(NULL AS VARCHAR) AS label UNION ALL SELECT 1, 'c_custkey', 'double', 'label of c_custkey'")
def prj_6_reindexed(spark, d):
    """Metadata of a projection, its columns numbered anew."""
    from larkspur.sources.metadata import describe_columns

    df = select_names(_read(spark, _encoded(spark, d, "customer")), ["c_mktsegment", "c_custkey"])
    return describe_columns(df).select("index", "name", "kind", "label")


@query("SELECT * FROM (VALUES ('o_orderkey', 0), ('o_totalprice', 3), ('o_orderpriority', 5)) v(name, place)")
def prj_7_column_index(spark, d):
    df = t(spark, d, "orders")
    return spark.createDataFrame([(n, column_index(df, n)) for n in ("o_orderkey", "o_totalprice", "o_orderpriority")], "name string, place int")


@query("SELECT r_regionkey * 2 AS twice, r_name AS name, true AS refused FROM region")
def prj_8_masked_cells(spark, d):
    """Cells by name and index; one outside the projection is refused."""
    from larkspur.errors import SelectionError

    rows = []
    for r in t(spark, d, "region").select("r_regionkey", "r_name").collect():
        whole, masked = MaskedRow(r), MaskedRow(r, ["r_name"])
        try:
            masked.cell(0)
            refused = False
        except SelectionError:
            refused = True
        rows.append((whole.get_as("r_regionkey", lambda x: x * 2), masked.cell("r_name "), refused))
    return spark.createDataFrame(rows, f"twice {dict(t(spark, d, 'region').dtypes)['r_regionkey']}, name string, refused boolean")


@query("SELECT * FROM (VALUES ('a1.sas7bdat'), ('a3.SAS7BDAT')) v(name)")
def fil_2_file_predicate(spark, d):
    from larkspur.sources.files import discover

    top = _scratch(spark)
    for name in ("a1.sas7bdat", "a2.sas7bdat", "a3.SAS7BDAT", "b.sas7bdat", "a.txt"):
        open(os.path.join(top, name), "w").close()
    return spark.createDataFrame([(os.path.basename(p),) for p in discover([top], skip=["a2.sas7bdat"], pattern=r"/a\d")], "name string")


@query("SELECT CAST(p_partkey AS DOUBLE) AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey AS DOUBLE) END AS x, CASE p_partkey % 12 WHEN 0 THEN '.' WHEN 4 THEN '_' WHEN 8 THEN 'C' END AS x__missing, CAST(NULL AS VARCHAR) AS k__missing FROM part")
def mis_3_tagged_values(spark, d):
    """System, underscore and letter missing values beside the numbers."""
    from larkspur.sources.encoder import missing, write_table

    keys = [r[0] for r in t(spark, d, "part").select("p_partkey").collect()]
    path = os.path.join(_scratch(spark), "tags.sas7bdat")
    gone = {0: missing("."), 4: missing("_"), 8: missing("C")}
    write_table(path, [("k", "num", 8, "", "", [float(k) for k in keys]), ("x", "num", 8, "", "", [gone.get(k % 12, float(k)) for k in keys])])
    return _read(spark, path, missingTags=True)


def _labels(spark):
    rows = [("GRADE", "numeric", "number", 1.0, None, "one"), ("GRADE", "numeric", "tag", None, "A", "absent"), ("GRADE", "numeric", "tag", None, "R", "refused"), ("$SEG", "string", "string", None, None, "x")]
    return spark.createDataFrame(rows, "set_name string, value_type string, key_kind string, key_number double, key_tag string, label string")


@query("SELECT * FROM (VALUES ('g', true, 'A,R'), ('s', false, '')) v(name, system_missing, tags)")
def mis_4_label_policy(spark, d):
    columns = spark.createDataFrame([("g", "grade2."), ("g", "grade."), ("s", "Seg."), ("n", "BEST12.")], "name string, format string").filter("format <> 'grade2.'")
    return C.label_policies(columns, _labels(spark)).select("name", "system_missing", "tags")


@query("SELECT * FROM (VALUES ('c_custkey', true), ('c_name', false), ('c_nationkey', true), ('c_acctbal', true), ('c_mktsegment', false)) v(name, system_missing)")
def mis_5_initial_policy(spark, d):
    from larkspur.sources.metadata import table_columns

    return table_columns(spark, _encoded(spark, d, "customer")).select("name", "system_missing")


@query("SELECT * FROM (VALUES ('g', 'GRADE', 'A,C,R', true), ('s', '$SEG', NULL, NULL)) v(name, value_labels, missing_tags, system_missing)")
def cat_1_attach_rescan(spark, d):
    """A catalog attached to a table: sets by format, tags of the labels and of the values."""
    from larkspur.sources.datasource import read_labels
    from larkspur.sources.encoder import missing, write_catalog, write_table
    from larkspur.sources.metadata import describe_columns

    names = [r[0] for r in t(spark, d, "region").select("r_name").orderBy("r_name").collect()]
    folder = _scratch(spark)
    table, catalog = os.path.join(folder, "x.sas7bdat"), os.path.join(folder, "x.sas7bcat")
    write_table(table, [("g", "num", 8, "grade.", "", [1.0, missing("C"), *([2.0] * (len(names) - 2))]), ("s", "char", 30, "$SEG.", "", names)])
    write_catalog(catalog, [("GRADE", [(1, "one"), (".A", "absent"), (".R", "refused")]), ("$SEG", [(n, n.lower()) for n in names])])
    df = C.attach_catalog(_read(spark, table, missingTags=True), read_labels(spark, catalog))
    return describe_columns(df).filter("name in ('g', 's')").select("name", "value_labels", "missing_tags", "system_missing")


# --- texts, numbers, dates ------------------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS DOUBLE) AS k, CASE n_nationkey % 3 WHEN 0 THEN 'é ' || n_name WHEN 1 THEN n_name ELSE 'ß' END AS x FROM nation")
def str_3_decode(spark, d):
    """Bytes of a declared Latin encoding; those that are UTF-8 are read as such."""
    from larkspur.sources.encoder import write_table

    rows = t(spark, d, "nation").select("n_nationkey", "n_name").collect()
    cells = [f"é {n}".encode("cp1252") if k % 3 == 0 else n.encode() if k % 3 == 1 else "ß".encode() for k, n in rows]
    path = os.path.join(_scratch(spark), "latin.sas7bdat")
    write_table(path, [("k", "num", 8, "", "", [float(k) for k, _ in rows]), ("x", "char", 40, "", "", cells)], encoding=62)
    return _read(spark, path)


@query("SELECT * FROM (VALUES ('WINDOWS-1252', 'cp1252'), ('utf_8', 'utf-8'), (' Latin1 ', 'iso8859-1'), ('MACROMAN', 'mac-roman'), ('SHIFT_JIS', 'shift_jis'), ('GB18030', 'gb18030'), ('no such name', 'utf-8')) v(label, codec)")
def str_5_encoding_names(spark, d):
    from larkspur.sources.layout import resolve_encoding

    names = ("WINDOWS-1252", "utf_8", " Latin1 ", "MACROMAN", "SHIFT_JIS", "GB18030", "no such name")
    return spark.createDataFrame([(n, resolve_encoding(n)) for n in names], "label string, codec string")


@query("SELECT s_suppkey * 1.0::DOUBLE AS a, s_name AS \"b c\" FROM supplier")
def str_8_trimmed_names(spark, d):
    from larkspur.sources.encoder import write_table

    rows = t(spark, d, "supplier").select("s_suppkey", "s_name").collect()
    path = os.path.join(_scratch(spark), "names.sas7bdat")
    write_table(path, [("a  ", "num", 8, "", "", [float(k) for k, _ in rows]), ("b c ", "char", 30, "", "", [n for _, n in rows])])
    return _read(spark, path)


@query("SELECT p_partkey, p_partkey % 4 < 3 AS shifted, p_partkey % 4 = 1 AS controls FROM part")
def str_11_relaxed_text(spark, d):
    """Names shifted by a character (0, 1: in front, a control character; 2: without the last), or changed in the middle."""
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    other = F.when(k == 0, F.concat(F.lit("x"), name)).when(k == 1, F.concat(F.lit("\x01"), name)).when(k == 2, F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(F.concat(F.lit("#"), F.reverse(name), F.lit("#")))
    longer, shorter = F.when(k == 2, name).otherwise(other), F.when(k == 2, other).otherwise(name)
    return t(spark, d, "part").select("p_partkey", S.shifted_ascii(longer, shorter).alias("shifted"), S.has_controls(other).alias("controls"))


@query("SELECT CAST(p_partkey % 50 AS DOUBLE) AS w3, CAST(p_partkey % 50 AS DOUBLE) AS w4, CAST(p_partkey % 50 AS DOUBLE) AS w5, CAST(p_partkey % 50 AS DOUBLE) AS w6, CAST(p_partkey % 50 AS DOUBLE) AS w7, CAST(p_partkey AS DOUBLE) AS w8 FROM part")
def num_1_truncated(spark, d):
    """Numbers of 3 to 8 stored bytes, high byte first."""
    from larkspur.sources.encoder import write_table

    keys = [r[0] for r in t(spark, d, "part").select("p_partkey").collect()]
    path = os.path.join(_scratch(spark), "widths.sas7bdat")
    write_table(path, [(f"w{w}", "num", w, "", "", [float(k if w == 8 else k % 50) for k in keys]) for w in range(3, 9)], little=False)
    return _read(spark, path)


@query("SELECT o_orderkey, 'int32' AS narrow, 'int64' AS wide, CASE WHEN o_totalprice = floor(o_totalprice) THEN 'int64' ELSE 'float' END AS price FROM orders")
def num_3_integer_kind(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.integer_kind(F.col("o_orderkey"), 4).alias("narrow"), S.integer_kind(F.col("o_orderkey"), 8).alias("wide"), S.integer_kind(F.col("o_totalprice"), 8).alias("price"))


@query("SELECT c_custkey, c_name AS a, CAST(NULL AS VARCHAR) AS b FROM customer")
def num_6_as_string(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.as_string(F.col("c_name"), "string").alias("a"), S.as_string(F.col("c_acctbal"), "double", strict=False).alias("b"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE DATE '1960-01-01' + CAST(p_partkey AS INTEGER) END AS d, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE TIMESTAMP '1960-01-01' + to_seconds(CAST(p_partkey AS INTEGER)) END AS ts FROM part")
def dt_5_range(spark, d):
    """Days and seconds beyond the years 1 to 9999, and those that aren't finite, are null."""
    k = F.col("p_partkey")
    value = F.when(k % 9 == 0, F.lit(float("inf"))).when(k % 3 == 0, F.lit(-1e13)).otherwise(k.cast("double"))
    return t(spark, d, "part").select("p_partkey", S.days_to_date(value).alias("d"), S.seconds_to_timestamp(value).cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, ts AS a, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS b, CAST(ts AS DATE) AS c, CAST(NULL AS TIMESTAMP) AS e FROM events")
def dt_6_as_datetime(spark, d):
    ts, day = F.col("ts"), F.col("ts").cast("date")
    return t(spark, d, "events").select("event_id", S.as_datetime(ts, "timestamp_ntz").alias("a"), S.as_datetime(day, "date").alias("b"), S.as_date(ts, "timestamp_ntz").alias("c"), S.as_datetime(F.col("value"), "double").alias("e"))


@query("SELECT TIMESTAMP '1960-01-01' + to_seconds(1999996400) AS created, TIMESTAMP '1960-01-01' + to_seconds(2000000000) AS modified")
def dt_11_header_times(spark, d):
    """The header's times, less the zone's difference that it states (3600 s for the first)."""
    import struct

    from larkspur.sources.metadata import table_metadata

    path = _encoded(spark, d, "region")
    with open(path, "r+b") as f:
        f.seek(164 + 4 + 16)
        f.write(struct.pack("<d", 3600.0))
    return table_metadata(spark, path).select(F.col("created").cast("timestamp_ntz").alias("created"), F.col("modified").cast("timestamp_ntz").alias("modified"))


@query("SELECT o_orderkey * 1.0::DOUBLE AS o_orderkey, epoch(o_orderdate) AS o_orderdate, CAST(NULL AS DOUBLE) AS gone, (o_orderkey % 1000) * 1.0::DOUBLE AS day FROM orders")
def dt_12_unix_numbers(spark, d):
    """Dates and datetimes as numbers since 1970; a column of missing values only is a number."""
    from larkspur.sources.encoder import write_frame
    from larkspur.sources.reading import read_frame

    seconds = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 + S.EPOCH_SECONDS
    df = t(spark, d, "orders").select(F.col("o_orderkey").cast("double"), seconds.alias("o_orderdate"), F.lit(None).cast("double").alias("gone"), (F.col("o_orderkey") % 1000 + S.EPOCH_DAYS).cast("double").alias("day"))
    path = os.path.join(_scratch(spark), "orders.sas7bdat")
    write_frame(df, path, formats={"o_orderkey": "", "o_orderdate": "DATETIME20.", "gone": "DATE9.", "day": "DATE9."})
    return read_frame(spark, path, convert_datetimes=False)


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'value' ELSE 'ok_bridge' END AS verdict FROM orders) GROUP BY 1")
def dt_13_bridge(spark, d):
    """Dates against datetimes of the same day (odd keys) or of another one, which compares as a value of its own kind."""
    o = t(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    a = C.snapshot(o.select("o_orderkey", day.alias("x")), "o_orderkey")
    same = C.snapshot(o.filter("o_orderkey % 2 = 1").select("o_orderkey", day.cast("timestamp_ntz").alias("x")), "o_orderkey")
    other = C.snapshot(o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.date_add(day, 40).alias("x")), "o_orderkey")
    return C.compare_snapshots(a, same.unionByName(other)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey * 1.0::DOUBLE AS s_suppkey, CAST(dense_rank() OVER (ORDER BY s_name) AS INTEGER) AS s_name FROM supplier")
def bnd_2_read_options(spark, d):
    """Texts as factors: numbers in the order of the values."""
    from larkspur.sources.reading import read_frame

    return read_frame(spark, _encoded(spark, d, "supplier"), strings_as_factors=True).select("s_suppkey", "s_name")


# --- metadata -------------------------------------------------------------------------------------------------------------


@query("SELECT 'Rows: ' || count(*) || ' Columns: 5 Table: TABLE' AS line FROM customer UNION ALL SELECT '0\tc_custkey\tdouble\t8\tBEST12.\tlabel of c_custkey'")
def meta_3_inspect_text(spark, d):
    import contextlib
    import io

    from larkspur import cli

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        cli.main(["--inspect", _encoded(spark, d, "customer")])
    return spark.createDataFrame([(x,) for x in text.getvalue().splitlines()[:2]], "line string")


@query("SELECT count(*) AS row_count, 5 AS column_count, 'c_acctbal' AS name, 'double' AS kind, 8 AS width FROM customer")
def meta_4_inspect_json(spark, d):
    from larkspur.sources.metadata import inspect

    text = json.dumps(inspect(_encoded(spark, d, "customer")))
    schema = "row_count long, column_count int, columns array<struct<index:int,name:string,kind:string,width:int>>"
    m = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", schema).alias("m"))
    return m.select("m.row_count", "m.column_count", F.col("m.columns")[3]["name"].alias("name"), F.col("m.columns")[3]["kind"].alias("kind"), F.col("m.columns")[3]["width"].alias("width"))


@query("SELECT count(*) AS row_count, 'little' AS endianness, 'SAS' AS vendor, '[\"c_custkey\",\"c_name\",\"c_nationkey\",\"c_acctbal\",\"c_mktsegment\"]' AS names, '[\"numeric\",\"character\",\"numeric\",\"numeric\",\"character\"]' AS types, '9' AS major FROM customer")
def meta_5_metadata_json(spark, d):
    from larkspur.sources.metadata import metadata_json

    j = spark.createDataFrame([(metadata_json(_encoded(spark, d, "customer")),)], "j string")
    get = lambda p: F.get_json_object("j", p)
    return j.select(get("$.row_count").cast("bigint").alias("row_count"), get("$.endianness").alias("endianness"), get("$.vendor").alias("vendor"), get("$.columns.names").alias("names"), get("$.columns.types").alias("types"), get("$.version.major").alias("major"))


@query("SELECT * FROM (VALUES ('o_orderkey', 0), ('o_custkey', 1), ('o_orderstatus', 2), ('o_totalprice', 3), ('o_orderdate', 4), ('o_orderpriority', 5)) v(name, place)")
def meta_6_column_names(spark, d):
    df = _read(spark, _encoded(spark, d, "orders"))
    return spark.createDataFrame([(n, i) for i, n in enumerate(df.columns)], "name string, place int")


@query("SELECT name, type, (SELECT count(*) FROM orders) AS row_count FROM (VALUES ('o_orderkey', 'double'), ('o_custkey', 'double'), ('o_orderstatus', 'character'), ('o_totalprice', 'double'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'character')) v(name, type)")
def meta_8_result_attributes(spark, d):
    from larkspur.sources.metadata import result_attributes

    a = result_attributes(_encoded(spark, d, "orders"))
    return spark.createDataFrame([(n, k, a["row_count"]) for n, k in a["column_types"].items()], "name string, type string, row_count long")


# --- comparison -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS row, 0 AS col, 'string' AS kind, CAST(NULL AS DOUBLE) AS number, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS text FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 5 = 0 THEN 'missing' ELSE 'number' END, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END, NULL FROM customer")
def cmp_3_csv_cells(spark, d):
    """Fields of a CSV as typed cells; empty ones and "." are missing numbers or empty texts."""
    k = F.col("c_custkey")
    out = os.path.join(_scratch(spark), "in")
    df = t(spark, d, "customer").select("c_custkey", F.when(k % 6 == 0, ".").when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 10 == 0, ".").when(k % 5 == 0, "").otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    df.write.option("header", "true").csv(f"file://{out}")
    return C.csv_cells(spark.read.option("header", "true").csv(f"file://{out}"), "c_custkey", {"name": "string", "balance": "number"})


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 <> 0) AS numbers, count(*) AS names FROM customer")
def cmp_4_golden_csv(spark, d):
    """A table against its CSV, in which every seventh number is off by 0.01."""
    out = os.path.join(_scratch(spark), "in")
    k = F.col("c_custkey")
    golden = t(spark, d, "customer").select(k.alias("key"), F.col("c_name").alias("name"), F.when(k % 7 == 0, F.col("c_acctbal") + 0.01).otherwise(F.col("c_acctbal") + 1e-8).alias("balance"))
    golden.write.option("header", "true").csv(f"file://{out}")
    expected = spark.read.option("header", "true").csv(f"file://{out}").withColumn("key", F.col("key").cast("double"))
    j = _read(spark, _encoded(spark, d, "customer")).join(expected, F.col("c_custkey") == F.col("key"))
    return j.agg(F.count("*").alias("n"), F.count_if(C.matches_csv(F.col("c_acctbal"), "double", F.col("balance"))).alias("numbers"), F.count_if(C.matches_csv(F.col("c_name"), "string", F.col("name"))).alias("names"))


@query("SELECT * FROM (VALUES ('a/x.sas7bdat', '/p/a/x.parquet', NULL), ('b/x.sas7bdat', '/q/c/X.parquet', 'several by name'), ('y.sas7bdat', '/q/Y.parquet', 'by name'), ('z.sas7bdat', NULL, NULL)) v(source, partner, note)")
def cmp_7_pair_files(spark, d):
    from larkspur.sources.files import pair_files

    sources = [f"/s/{x}.sas7bdat" for x in ("a/x", "b/x", "y", "z")]
    pairs = pair_files(sources, "/s", ["/q/c/X.parquet", "/p/a/x.parquet", "/q/Y.parquet"], ["/p", "/q"])
    return spark.createDataFrame([(s.removeprefix("/s/"), p, n) for s, (p, n) in pairs.items()], "source string, partner string, note string")


@query("SELECT col, 'ok' AS verdict, count(*) AS n FROM supplier, range(4) r(col) GROUP BY 1")
def cmp_8_foreign_snapshot(spark, d):
    """Our reading of a file against that of another reader, cell by cell."""
    path = _encoded(spark, d, "supplier")
    own = C.snapshot(_read(spark, path, rowId=True, columns=["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]), "_row_id")
    other = C.foreign_snapshot(spark, path).filter("col < 4")
    return C.compare_snapshots(own, other).groupBy(F.col("col").cast("bigint").alias("col"), "verdict").agg(F.count("*").alias("n"))


# --- conversion, errors -----------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('bad.sas7bdat', 'bad.csv', 'error', true), ('in/good.sas7bdat', 'in/good.csv', 'ok', false)) v(source, output, status, told)")
def exe_1_convert(spark, d):
    """Two files at a time; one is no table, the other is converted all the same."""
    import shutil

    from larkspur.plans.convert import convert

    top, out = _scratch(spark), _scratch(spark)
    os.makedirs(os.path.join(top, "in"))
    shutil.copy(_encoded(spark, d, "region"), os.path.join(top, "in", "good.sas7bdat"))
    with open(os.path.join(top, "bad.sas7bdat"), "wb") as f:
        f.write(b"no table" * 200)
    done = convert(spark, [top], kind="csv", out_dir=out, jobs=2)
    return done.select(F.replace("source", F.lit(top + "/"), F.lit("")).alias("source"), F.replace("output", F.lit(out + "/"), F.lit("")).alias("output"), "status", F.col("error").contains("magic").alias("told")).na.fill(False)


@query("SELECT * FROM (VALUES ('magic', 'Corrupted', 'header'), ('encoding', 'Unsupported', NULL), ('short', 'Corrupted', 'header'), ('fail fast', 'Corrupted', 'header')) v(case_name, error, section)")
def exe_3_errors(spark, d):
    """What is wrong with a file decides the error, and where it is."""
    from larkspur.errors import TableError
    from larkspur.sources.files import memory
    from larkspur.sources.layout import read_layout

    with open(_encoded(spark, d, "region"), "rb") as f:
        good = f.read()
    cases = {"magic": b"x" + good[1:], "encoding": good[:70] + b"\xff" + good[71:], "short": good[:100], "fail fast": good[:37] + b"\x07" + good[38:]}
    rows = []
    for name, data in cases.items():
        try:
            read_layout(memory(data))
        except TableError as e:
            rows.append((name, type(e).__name__, getattr(e, "section", None)))
    return spark.createDataFrame(rows, "case_name string, error string, section string")


@query("SELECT 'WARNING: a.sas7bdat: something odd' AS line")
def exe_4_log_file(spark, d):
    from larkspur.errors import log, log_to, warn

    path = os.path.join(_scratch(spark), "warnings.log")
    handler = log_to(path)
    try:
        warn("something odd", "a.sas7bdat")
    finally:
        log.removeHandler(handler)
        handler.close()
    return spark.read.text(f"file://{path}").withColumnRenamed("value", "line")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM region")
def exe_5_tolerant_pages(spark, d):
    """A page that states more subheaders than it can hold is read up to what fits."""
    import struct

    path = _encoded(spark, d, "region", page_size=4096)
    with open(path, "rb") as f:
        data = bytearray(f.read())
    first = struct.unpack_from("<I", data, 200)[0]  # size of the header
    struct.pack_into("<H", data, first + 36, 60_000)
    with open(path, "wb") as f:
        f.write(data)
    return _read(spark, path).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'number' WHEN p_partkey % 28 < 2 THEN 'system' ELSE 'tag' END AS kind FROM part")
def udf_3_own_conversion(spark, d):
    """A conversion of the caller's over cells, as a vectorised function."""
    @F.pandas_udf("string")
    def kind(tag: pd.Series) -> pd.Series:
        return tag.map(lambda x: "number" if x is None or x != x else "system" if x in "._" else "tag")

    return t(spark, d, "part").select("p_partkey", kind(S.bits_tag(_bits())).alias("kind"))
