"""Reading with the options of a statistics package: dates or numbers, time zone, factors, repair of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import SelectionError
from larkspur.functions.scalars import EPOCH_DAYS, EPOCH_SECONDS
from larkspur.operators.selection import quoted
from larkspur.sources.datasource import read_table

REPAIRS = ("check_unique", "unique", "minimal")


def unix_numbers(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Numbers since 1960 as numbers since 1970: dates in days, datetimes in seconds; times stay in seconds."""
    shift = {"date": float(EPOCH_DAYS), "datetime": float(EPOCH_SECONDS)}
    return df.select(*((F.col(quoted(c)) - shift[kinds[c]]).alias(c) if kinds.get(c) in shift else F.col(quoted(c)) for c in df.columns))


def repaired(names: list[str], how: str) -> list[str]:
    """check_unique: repeated or empty names are an error; unique: they get ...N; minimal: as they are."""
    if how not in REPAIRS:
        raise ValueError(f"unknown repair of names: {how!r}")
    twice = {n for n in names if names.count(n) > 1 or not n}
    if how == "check_unique" and twice:
        raise SelectionError(f"names that aren't unique: {sorted(twice)}")
    return [f"{n}...{i + 1}" if how == "unique" and n in twice else n for i, n in enumerate(names)]


def read_frame(spark: SparkSession, path: str, *, convert_datetimes: bool = True, tz: str = "UTC", strings_as_factors: bool = False, name_repair: str = "check_unique") -> DataFrame:
    """A table with its dates as dates, or (convert_datetimes false) as numbers since 1970.

    A column that has no value but missing ones is a number, whatever its format says.  tz: datetimes are shown as the
    wall clock of this zone (timestamp_ntz).  strings_as_factors: text becomes 1, 2, ... in the order of its values, which
    are kept in the metadata (`levels`).
    """
    df = read_table(spark, path)
    kinds = {f.name: f.metadata["sas_kind"] for f in df.schema.fields}
    timely = [c for c in df.columns if kinds[c] in ("date", "datetime", "time")]
    some = df.agg(*(F.count(quoted(c)).alias(str(i)) for i, c in enumerate(timely))).first() if timely else []
    kinds |= {c: "double" for c, n in zip(timely, some, strict=True) if not n}
    if convert_datetimes:
        cols = [F.from_utc_timestamp(F.col(quoted(c)), tz).cast("timestamp_ntz").alias(c) if kinds[c] == "datetime" else F.lit(None).cast("double").alias(c) if kinds[c] == "double" and c in timely else F.col(quoted(c)) for c in df.columns]
        out = df.select(*cols)
    else:
        out = unix_numbers(read_table(spark, path, dates=False), kinds)
    if strings_as_factors:
        for c in [c for c in out.columns if kinds[c] == "character"]:
            levels = [r[0] for r in out.select(quoted(c)).distinct().dropna().orderBy(quoted(c)).collect()]  # a factor's levels are part of the schema
            out = out.withColumn(c, F.when(F.col(quoted(c)).isNotNull(), F.array_position(F.lit(levels) if levels else F.array().cast("array<string>"), F.col(quoted(c))).cast("int")).alias(c, metadata={"levels": levels}))
    return out.toDF(*repaired(out.columns, name_repair))
