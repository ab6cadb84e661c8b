"""python -m larkspur.cli INPUT... | --inspect FILE: converts tables, or shows what a table holds."""

from __future__ import annotations

import argparse
import json
import sys

from larkspur.operators.selection import RowSelection


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    p.add_argument("inputs", nargs="*")
    p.add_argument("--inspect", metavar="FILE")
    p.add_argument("--inspect-json", action="store_true")
    p.add_argument("--sink", choices=("parquet", "csv", "tsv"), default="parquet")
    p.add_argument("--out")
    p.add_argument("--out-dir")
    p.add_argument("--flatten", action="store_true")
    p.add_argument("--columns", help="names, comma-separated")
    p.add_argument("--column-indices", help="numbers, comma-separated; they win over names")
    p.add_argument("--skip", type=int, default=0)
    p.add_argument("--max-rows", type=int)
    p.add_argument("--delimiter", default=",")
    p.add_argument("--no-headers", action="store_true")
    p.add_argument("--row-group-rows", type=int)
    p.add_argument("--row-group-bytes", type=int)
    p.add_argument("--strict-dates", action="store_true")
    p.add_argument("--catalog")
    p.add_argument("--jobs", type=int, default=4)
    p.add_argument("--fail-fast", action="store_true")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.inspect:
        from larkspur.sources.metadata import inspect

        found = inspect(a.inspect)
        if a.inspect_json:
            print(json.dumps({k: v for k, v in found.items() if k != "table_name"}))
        else:
            print(f"Rows: {found['row_count']} Columns: {found['column_count']} Table: {found['table_name']}")
            for c in found["columns"]:
                print(f"{c['index']}\t{c['name']}\t{c['kind']}\t{c['width']}\t{c['format'] or ''}\t{c['label'] or ''}")
        return 0
    from pyspark.sql import SparkSession

    from larkspur.plans.convert import convert

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    indices = [int(x) for x in a.column_indices.split(",")] if a.column_indices else None
    names = a.columns.split(",") if a.columns else None
    options: dict = {}
    if a.sink == "parquet":
        options = {"rows": a.row_group_rows, "target_bytes": a.row_group_bytes}
    elif a.sink == "csv":
        options = {"sep": a.delimiter, "header": not a.no_headers}
    else:
        options = {"header": not a.no_headers}
    done = convert(
        spark, a.inputs, kind=a.sink, out=a.out, out_dir=a.out_dir, flatten=a.flatten, selection=RowSelection(a.skip, a.max_rows, indices, names),
        catalog=a.catalog, strict_dates=a.strict_dates, jobs=a.jobs, fail_fast=a.fail_fast, **options,
    ).collect()
    failed = [r for r in done if r["status"] != "ok"]
    for r in failed:
        print(f"{r['source']}: {r['error']}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
