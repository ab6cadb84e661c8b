"""Planned pages, metadata modes, sinks out of turn, reading options."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.errors import SelectionError, SinkError
from larkspur.functions import scalars as S
from larkspur.operators.selection import MaskedRow
from larkspur.sources import files
from larkspur.sources.datasource import plan_pages, raw_cells, read_raw_rows, read_table
from larkspur.sources.encoder import write_table
from larkspur.sources.layout import parse_header, read_layout
from larkspur.sources.reading import read_frame, repaired
from larkspur.sources.sinks import Guard, RowSink, coerce, sink_context, stream_into
from tests.test_format import columns


@pytest.mark.parametrize("options", [{}, {"wide": False, "pad": False}, {"little": False}, {"compression": "rle"}, {"compression": "rdc"}, {"compression": "raw"}, {"mix": True}])
def test_planned_pages(spark, tmp_path, options):
    path = str(tmp_path / "t.sas7bdat")
    write_table(path, columns(), page_size=2048, **options)
    whole = read_table(spark, path, rowId=True).orderBy("_row_id").collect()
    for extra in ({}, {"skipRows": 11, "maxRows": 333}):
        got = read_table(spark, path, rowId=True, pagesPerTask=3, **extra).orderBy("_row_id").collect()
        assert got == (whole[11:344] if extra else whole)
    plan = plan_pages(spark, path, parse_header(files.opener(path)).page_count, 3)
    modes = [read_layout(files.opener(path), io_mode=m, only=o) for m in ("auto", "full", "streaming") for o in (None, plan["meta"])]
    assert all(m.variables == modes[0].variables and m.row_count == 700 for m in modes)


def test_raw_cells(spark, tmp_path):
    for little in (True, False):
        path = str(tmp_path / f"{little}.sas7bdat")
        write_table(path, columns(), little=little)
        layout = read_layout(files.opener(path))
        for name, width in (("K", 4), ("D", 8)):
            got = raw_cells(read_raw_rows(spark, path), layout, name).orderBy("_row_id").collect()
            assert len(got[0]["cell"]) == width and np.array([r["bits"] for r in got], np.int64).view(np.float64).tolist() == [float(i) for i in range(700)]
        assert raw_cells(read_raw_rows(spark, path), layout, "NAME").count() == 700


def test_sinks_out_of_turn(spark, tmp_path):
    class Odd(RowSink):
        def write(self, row):
            raise ValueError("full")

    df = spark.range(3)
    with pytest.raises(Exception, match="full"):
        stream_into(df, Odd)
    with pytest.raises(SinkError):
        Guard(Odd()).write((1,))
    assert sink_context(df, "x").source_path == "x"
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(coerce(F.lit(" "), "string", "number")) is None and one(coerce(F.lit("2.5"), "string", "time")) == 2_500_000 and one(coerce(F.lit(1 << 60), "bigint", "number")) is None
    with pytest.raises(ValueError):
        coerce(F.lit(1), "int", "colour")


def test_reading_options(spark, tmp_path):
    path = str(tmp_path / "t.sas7bdat")
    write_table(path, [("D", "num", 8, "DATE9.", "", [0.0, None]), ("E", "num", 8, "DATETIME20.", "", [0.0, 3600.0]), ("N", "num", 8, "TIME8.", "", [None, None]), ("S", "char", 3, "", "", ["b", "a"])])
    df = read_frame(spark, path, tz="Europe/Berlin", strings_as_factors=True)
    assert dict(df.dtypes) == {"D": "date", "E": "timestamp_ntz", "N": "double", "S": "int"} and [r["S"] for r in df.collect()] == [2, 1]
    assert str(df.collect()[0]["E"]) == "1960-01-01 01:00:00" and df.schema["S"].metadata["levels"] == ["a", "b"]
    raw = read_frame(spark, path, convert_datetimes=False).first()
    assert raw["D"] == -3653.0 and raw["E"] == -315619200.0
    assert repaired(["a", "a", ""], "unique") == ["a...1", "a...2", "...3"] and repaired(["a", "a"], "minimal") == ["a", "a"]
    with pytest.raises(SelectionError):
        repaired(["a", "a"], "check_unique")


def test_cells(spark):
    row = spark.createDataFrame([(1, "x")], "a int, `b ` string").first()
    assert MaskedRow(row, ["b"]).cell("b") == "x" and MaskedRow(row).cell(0) == 1
    for key in ("a", "c", 5):
        with pytest.raises(SelectionError):
            MaskedRow(row, ["b"]).cell(key)
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    pairs = {("abc", "bc"): True, ("abc", "ab"): True, ("abc", "xab"): True, ("abc", "abd"): False, ("", "a"): False, ("abcé", "bcé"): False}
    assert {p: one(S.shifted_ascii(F.lit(p[0]), F.lit(p[1]))) for p in pairs} == pairs
    with pytest.raises(Exception, match="not a text"):
        one(S.as_string(F.lit(1), "int"))
    assert [one(S.integer_kind(F.lit(x), w)) for x, w in ((1.0, 4), (3e9, 4), (1.0, 8), (1.5, 8), (1e30, 8))] == ["int32", "int64", "int64", "float", "float"]
