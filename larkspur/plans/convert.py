"""Conversion of many tables: one Spark write for each file, several at a time; outcome as a DataFrame."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from larkspur.errors import warn
from larkspur.operators.selection import RowSelection
from larkspur.sources.datasource import read_labels, read_table
from larkspur.sources.files import discover
from larkspur.sources.sinks import plan_outputs, write_table


def convert(
    spark: SparkSession, inputs: list[str], *, kind: str = "parquet", out: str | None = None, out_dir: str | None = None, flatten: bool = False,
    selection: RowSelection | None = None, catalog: str | None = None, strict_dates: bool = False, jobs: int = 4, fail_fast: bool = False, **options,
) -> DataFrame:
    """Rows source, output, status (ok, error), error.  fail_fast: the first error is raised."""
    found = {source: root for root in inputs for source in discover([root])}
    plan = plan_outputs(inputs, found, kind.strip().lower(), out=out, out_dir=out_dir, flatten=flatten)
    selection = selection or RowSelection()

    def one(item: tuple[str, str]) -> tuple[str, str, str, str | None]:
        source, target = item
        try:
            window = {"skipRows": selection.skip} | ({"maxRows": selection.limit} if selection.limit is not None else {})
            df = read_table(spark, source, temporalErrors="fail" if strict_dates else "null", **window)
            if catalog:
                from larkspur.operators.compare import attach_catalog

                try:
                    df = attach_catalog(df, read_labels(spark, catalog))
                except Exception as e:
                    warn(f"catalog {catalog} isn't attached: {e}", source)
            write_table(selection.project(df), kind, target, **options)
            return source, target, "ok", None
        except Exception as e:
            if fail_fast:
                raise
            warn(str(e)[:500], source)
            return source, target, "error", str(e)[:500]

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        rows = list(pool.map(one, plan.items()))
    return spark.createDataFrame(rows, "source string, output string, status string, error string")
