"""Selection, sinks, conversion and command line."""

import datetime
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur import cli
from larkspur.errors import SelectionError
from larkspur.functions import scalars as S
from larkspur.operators.selection import RowSelection, select_columns, select_names
from larkspur.plans.convert import convert
from larkspur.plans.queries import QUERIES
from larkspur.sources.datasource import read_table
from larkspur.sources.encoder import write_table
from larkspur.sources.metadata import table_columns, table_metadata, table_pages, table_pointers
from larkspur.sources.sinks import plan_outputs, row_group_rows, write_csv, write_parquet
from larkspur.sources.sinks import write_table as write_kind
from tests.conftest import DATA


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_selection(spark):
    df = spark.createDataFrame([(i, i * 2, str(i)) for i in range(10)], "a int, `b ` int, c string")
    assert select_columns(df, [2, 0]).columns == ["c", "a"] and select_names(df, ["b", "", "a"]).columns == ["b ", "a"]
    for bad in ([], [3], [0, 0]):
        with pytest.raises(SelectionError):
            select_columns(df, bad)
    for bad in (["A"], ["b", "b "]):
        with pytest.raises(SelectionError):
            select_names(df, bad)
    assert [r["a"] for r in RowSelection(2, 3, names=["a"]).apply(df, ["a"]).collect()] == [2, 3, 4]
    assert RowSelection(skip=99).window(df, ["a"]).count() == 0 and RowSelection(limit=0).window(df, ["a"]).count() == 0
    assert RowSelection(indices=[2], names=["a"]).project(df).columns == ["c"]
    with pytest.raises(SelectionError):
        RowSelection(names=["a"]).window(df, ["a"])
    with pytest.raises(SelectionError):
        RowSelection(1).apply(df, ["a"])


def test_numbers(spark):
    for x, text in ((1.0, "1"), (0.1, "0.1"), (1e16, "10000000000000000"), (1.5e-5, "0.000015"), (1.5e-7, "1.5e-7"), (123456789.25, "123456789.25"), (-2.5e20, "-2.5e20")):
        assert one(spark, S.number_text(F.lit(x))) == text
    assert one(spark, S.exact_int(F.lit(2.0**64))) is None and one(spark, S.exact_int(F.lit(-0.0))) == 0
    with pytest.raises(Exception, match="not an integer"):
        one(spark, S.as_bigint(F.lit(1.5)))
    assert one(spark, S.time_text(F.lit(-500000))) == "-00:00:00.500" and one(spark, S.time_text(F.lit(360000 * 10**6))) == "100:00:00"
    assert one(spark, S.seconds_to_timestamp(F.lit(-8908695999.854775))) == datetime.datetime(1960, 1, 1) - datetime.timedelta(seconds=8908695999, microseconds=854775)
    assert one(spark, S.days_to_date(F.lit(1e9))) is None


def test_sinks(spark, tmp_path):
    assert row_group_rows([8, 8], 10**9, 1600) == 100 and row_group_rows([8], 10, 0) == 1 and row_group_rows([1], 10**9) == 262144
    df = spark.createDataFrame([(1.0, 'a "q", b', None), (2.5, " x ", "")], "n double, s string, `e ` string")
    write_csv(df, str(tmp_path / "csv"), single_file=True)
    part = next(f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv"))
    assert (tmp_path / "csv" / part).read_text() == 'n,s,e\n1,"a ""q"", b",\n2.5, x ,\n'
    write_kind(df, " TSV ", str(tmp_path / "tsv"), header=False)
    write_parquet(spark.range(5000).repartition(1), str(tmp_path / "pq"), rows=1000)
    part = next(f for f in os.listdir(tmp_path / "pq") if f.endswith(".parquet"))
    assert pq.ParquetFile(tmp_path / "pq" / part).num_row_groups == 5
    with pytest.raises(ValueError):
        write_kind(df, "xml", "x")
    with pytest.raises(ValueError):
        plan_outputs(["/r"], {"/r/a/x.sas7bdat": "/r", "/r/b/x.sas7bdat": "/r"}, "csv", out_dir="/o", flatten=True)


def test_convert_and_cli(spark, tmp_path, capsys):
    src = tmp_path / "in" / "sub"
    src.mkdir(parents=True)
    write_table(str(src / "a.sas7bdat"), [("X", "num", 8, "", "lab", [1.0, None, 3.0]), ("S", "char", 4, "", "", ["a", "", "c"])])
    (tmp_path / "in" / "bad.sas7bdat").write_bytes(b"x" * 999)
    done = {os.path.basename(r["source"]): r for r in convert(spark, [str(tmp_path / "in")], kind="csv", out_dir=str(tmp_path / "out")).collect()}
    assert done["a.sas7bdat"]["status"] == "ok" and done["bad.sas7bdat"]["status"] == "error"
    assert done["a.sas7bdat"]["output"] == str(tmp_path / "out" / "sub" / "a.csv")
    with pytest.raises(Exception, match="magic"):
        convert(spark, [str(tmp_path / "in")], kind="csv", out_dir=str(tmp_path / "out2"), fail_fast=True)
    path = str(src / "a.sas7bdat")
    assert cli.main(["--inspect", path, "--inspect-json"]) == 0
    assert json.loads(capsys.readouterr().out)["columns"][0]["label"] == "lab"
    assert table_metadata(spark, path).first()["row_count"] == 3 and table_columns(spark, path).count() == 2
    assert table_pages(spark, path).agg(F.sum("rows")).first()[0] == 3 and table_pointers(spark, path).filter("not inside").count() == 0
    df = read_table(spark, path, missingTags=True, sourcePath=True)
    assert df.schema["X"].metadata["label"] == "lab" and [r["X__missing"] for r in df.collect()] == [None, ".", None]


def test_window_ties(spark, tmp_path):
    """Of rows with equal keys, those that lie first are taken, though the second file is the larger one and is read first."""
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(1).drop("l_orderkey", "l_linenumber", "l_partkey")
    for name, low, high in (("a", 0, 600), ("b", 600, 3000)):
        keys = spark.range(low, high, 1, 1).select(F.lit(1).cast("bigint").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"))
        keys.crossJoin(rows).coalesce(1).sortWithinPartitions("l_partkey").write.parquet(str(tmp_path / name))
        part = next(f for f in os.listdir(tmp_path / name) if f.endswith(".parquet"))
        os.makedirs(tmp_path / "lineitem.parquet", exist_ok=True)
        os.rename(tmp_path / name / part, tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = QUERIES["lim_3_window"](spark, str(tmp_path))
    assert "_metadata" not in got.columns and sorted(r["l_partkey"] for r in got.collect()) == list(range(333, 1333))


def test_days_of_any_year(spark, tmp_path):
    keys = [0, 79_000, 119_999, 1_199_999, 50_000_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    days = QUERIES["dt_1_days"](spark, str(tmp_path)).select("p_partkey", F.unix_date("x").alias("n")).orderBy("p_partkey").collect()
    assert [r["n"] for r in days] == [37 * k - S.EPOCH_DAYS for k in keys]
    day = lambda x: one(spark, F.unix_date(S.days_to_date(F.lit(x), any_year=True)))
    assert [day(x) for x in (2147487299.0, 2147487300.0, -2147479993.0, -2147479994.0, float("nan"), float("inf"))] == [2147483646, None, -2147483646, None, None, None]
    assert one(spark, F.unix_date(S.days_to_date(F.lit(2936550.0)))) is None and one(spark, F.unix_date(S.days_to_date(F.lit(2936549.0)))) == 2932896
