"""Tables encoded by tasks: the same files, and no table's rows on the driver."""

import datetime
import tracemalloc

import pytest
from pyspark.sql import functions as F

from larkspur.plans.queries import QUERIES
from larkspur.sources import files
from larkspur.sources.datasource import plan_pages, read_table
from larkspur.sources.encoder import write_frame, write_table
from larkspur.sources.layout import parse_header, read_layout
from tests.conftest import DATA

LAYOUTS = [{}, {"wide": False, "pad": False}, {"little": False}, {"compression": "rle"}, {"compression": "rdc"}, {"compression": "raw"}, {"mix": True}]


@pytest.fixture
def gathered(spark, monkeypatch):
    """How many rows the driver got at most by one call."""
    kind, most = type(spark.range(1)), [0]

    def watch(name):
        plain = getattr(kind, name)

        def call(self, *a, **b):
            out = plain(self, *a, **b)
            most[0] = max(most[0], len(out))
            return out

        monkeypatch.setattr(kind, name, call)

    for name in ("collect", "toPandas"):
        watch(name)
    return most


@pytest.mark.parametrize("name", ["meta_6_column_names", "snk_8_csv_roundtrip", "src_18_rle", "dt_12_unix_numbers", "meta_8_result_attributes", "src_19_rdc", "src_6_planned_window"])
def test_rows_stay_in_tasks(spark, gathered, name):
    assert spark.read.parquet(f"{DATA}/orders.parquet").count() == 1500
    QUERIES[name](spark, DATA)
    assert gathered[0] < 150


@pytest.mark.parametrize("options", LAYOUTS)
def test_frame_is_table(spark, tmp_path, options):
    day = datetime.datetime(1959, 12, 30, 1, 2, 3, 500000)
    rows = [(i if i % 5 else None, float("nan") if i % 7 == 0 else i / 4, None if i % 3 == 0 else "é" * (i % 4), day + datetime.timedelta(days=i) if i % 4 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "K long, X double, S string, T timestamp_ntz").coalesce(1)
    second = lambda t: None if t is None else (t - datetime.datetime(1960, 1, 1)).total_seconds()
    columns = [
        ("K", "num", 8, "BEST12.", "key", [None if r[0] is None else float(r[0]) for r in rows]), ("X", "num", 8, "F8.", "", [None if r[1] != r[1] else r[1] for r in rows]),
        ("S", "char", 6, "$CHAR.", "", [r[2] for r in rows]), ("T", "num", 8, "DATETIME22.3", "", [second(r[3]) for r in rows]),
    ]
    one, split, table = (str(tmp_path / f"{n}.sas7bdat") for n in ("one", "split", "table"))
    write_table(table, columns, page_size=2048, **options)
    write_frame(df, one, formats={"X": "F8."}, labels={"K": "key"}, page_size=2048, **options)
    with open(one, "rb") as a, open(table, "rb") as b:
        assert a.read() == b.read()
    parts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, K long, X double, S string, T timestamp_ntz").repartitionByRange(5, "i").sortWithinPartitions("i").drop("i")
    write_frame(parts, split, page_size=2048, **options)
    assert read_table(spark, split, rowId=True).orderBy("_row_id").collect() == read_table(spark, table, rowId=True).orderBy("_row_id").collect()


def test_empty_and_odd_frames(spark, tmp_path):
    path = str(tmp_path / "empty.sas7bdat")
    write_frame(spark.createDataFrame([], "a int, s string"), path, mix=True)
    assert read_table(spark, path).columns == ["a", "s"] and read_table(spark, path).count() == 0
    with pytest.raises(TypeError):
        write_frame(spark.range(1).select(F.array("id").alias("x")), str(tmp_path / "x.sas7bdat"))


def test_pages_are_not_held(tmp_path, spark):
    path = str(tmp_path / "t.sas7bdat")
    write_table(path, [("S", "char", 2000, "", "", [bytes(range(33, 233)) * 10] * 4000)], compression="raw", page_size=65536)
    tracemalloc.start()
    layout = read_layout(files.opener(path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n, _ in layout.pages) == 4000 and peak < 2 << 20  # of 8 MB
    assert plan_pages(spark, path, parse_header(files.opener(path)).page_count, 3)["meta"] == [0]


def test_window_of_unsorted_table(spark, tmp_path):
    """The window's rows are those of the order of keys, however the table lies."""
    spark.read.parquet(f"{DATA}/orders.parquet").orderBy(F.desc("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    got = [(r["o_orderkey"], r["_row_id"]) for r in QUERIES["src_6_planned_window"](spark, str(tmp_path)).orderBy("_row_id").collect()]
    assert got == [(float(i), i) for i in range(40, 1240)]
