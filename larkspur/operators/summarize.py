"""Whole-table summaries: one aggregation pass over all columns, then one row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import cell_kind, date_text, datetime_text, trim_unicode
from larkspur.operators.selection import quoted

LEAST_ROWS, MOST_DISTINCT, SHARE = 1000, 10_000, 5


def _kind(df: DataFrame, name: str) -> str:
    kind = df.schema[name].metadata.get("sas_kind")
    return kind or {"number": "double", "string": "character", "bytes": "character"}.get(cell_kind(dict(df.dtypes)[name]), cell_kind(dict(df.dtypes)[name]))


def _long(df: DataFrame, aggregates: dict[str, dict[str, Column]], types: dict[str, str]) -> DataFrame:
    """One row for each key of aggregates, its columns of the given types; all computed in one pass."""
    flat = [c.cast(types[k]).alias(f"{i}_{k}") for i, cols in enumerate(aggregates.values()) for k, c in cols.items()]
    one = df.agg(*flat)
    rows = [F.struct(F.lit(i).alias("index"), F.lit(name).alias("name"), *(F.col(f"{i}_{k}").alias(k) if k in cols else F.lit(None).cast(t).alias(k) for k, t in types.items())) for i, (name, cols) in enumerate(aggregates.items())]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def summarize(df: DataFrame) -> DataFrame:
    """index, name, kind, non_missing, missing and, for numbers, count, sum, min, max.

    Numbers that aren't finite are missing.  Blank text is not missing.  Dates and times count only.
    """
    out: dict[str, dict[str, Column]] = {}
    for name, kind in df.dtypes:
        c = F.col(quoted(name))
        if cell_kind(kind) == "number":
            x = F.when(finite(c.cast("double")), c.cast("double"))
            out[name] = {"non_missing": F.count(x), "missing": F.count("*") - F.count(x), "count": F.count(x), "sum": F.coalesce(F.sum(x), F.lit(0.0)), "min": F.min(x), "max": F.max(x)}
        else:
            out[name] = {"non_missing": F.count(c), "missing": F.count("*") - F.count(c)}
            if cell_kind(kind) in ("date", "datetime", "time"):
                out[name] |= {"count": F.lit(0), "sum": F.lit(0.0)}
    types = {"non_missing": "bigint", "missing": "bigint", "count": "bigint", "sum": "double", "min": "double", "max": "double"}
    long = _long(df, out, types)
    meta = F.create_map(*(x for n in df.columns for x in (F.lit(n), F.struct(F.lit(_kind(df, n)).alias("kind"), F.lit(df.schema[n].metadata.get("label") or None).cast("string").alias("label"), F.lit((df.schema[n].metadata.get("format") or "").strip() or None).cast("string").alias("format")))))
    return long.withColumn("m", meta[F.col("name")]).select("index", "name", "m.label", "m.format", "m.kind", *types)


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Summaries of parts of a table, merged: counts and sums add, minima and maxima combine."""
    return parts.groupBy("index", "name").agg(
        *(F.sum(c).alias(c) for c in ("non_missing", "missing", "count", "sum")), F.min("min").alias("min"), F.max("max").alias("max")
    )


def profile_numeric(df: DataFrame) -> DataFrame:
    """index, name, non_missing, missing, min, max (numbers), low, high (text of the smallest and largest date or time).

    Infinite numbers count neither as missing nor as not.
    """
    out: dict[str, dict[str, Column]] = {}
    for name, kind in df.dtypes:
        c, k = F.col(quoted(name)), cell_kind(kind)
        if k == "number":
            d = c.cast("double")
            x = F.when(finite(d), d)
            out[name] = {"non_missing": F.count(x), "missing": F.count_if(c.isNull() | F.isnan(d)), "min": F.min(x), "max": F.max(x)}
        elif k in ("date", "datetime"):
            text = date_text if k == "date" else datetime_text
            out[name] = {"non_missing": F.count(c), "missing": F.count("*") - F.count(c), "low": text(F.min(c)), "high": text(F.max(c))}
    return _long(df, out, {"non_missing": "bigint", "missing": "bigint", "min": "double", "max": "double", "low": "string", "high": "string"})


def text_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """index, name, value, n: how often each value (trimmed; null and empty ones are null) occurs in text columns."""
    names = [n for n, t in df.dtypes if t == "string" and (columns is None or n in columns)]
    pairs = F.explode(F.array(*(F.struct(F.lit(df.columns.index(n)).alias("index"), F.lit(n).alias("name"), F.nullif(trim_unicode(F.col(quoted(n))), F.lit("")).alias("value")) for n in names))).alias("p")
    return df.select(pairs).groupBy("p.index", "p.name", "p.value").agg(F.count("*").alias("n"))


def profile_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """index, name, non_missing, missing, distinct, high_cardinality, by the totals of each column."""
    values = text_values(df, columns)
    out = values.groupBy("index", "name").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_missing"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("distinct"),
    )
    high = (F.col("distinct") > MOST_DISTINCT) | ((F.col("non_missing") >= LEAST_ROWS) & (F.col("distinct") * SHARE > F.col("non_missing")))
    return out.withColumn("high_cardinality", high)


def profile_text_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """As profile_text for one column, with the rule tried after every row in order: once it holds, distinct stays.

    The running counts use prefix sums over ranges of the order, so that no task holds all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = F.nullif(trim_unicode(F.col(quoted(column))), F.lit(""))
    rows = df.select(F.col(quoted(order)).alias("o"), value.alias("v"))
    first = rows.filter("v is not null").groupBy("v").agg(F.min("o").alias("o")).select("o", F.lit(1).alias("new"))
    marked = rows.filter("v is not null").join(first, "o", "left").select("o", F.coalesce("new", F.lit(0)).alias("new"))
    ranged = marked.repartitionByRange(parts, "o").withColumn("p", F.spark_partition_id())
    from pyspark.sql import Window

    inside = Window.partitionBy("p").orderBy("o")
    running = ranged.withColumns({"d": F.sum("new").over(inside), "n": F.count("*").over(inside)})
    ends = ranged.groupBy("p").agg(F.sum("new").alias("pd"), F.count("*").alias("pn"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    ends = ends.select("p", F.coalesce(F.sum("pd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"))
    total = running.join(ends, "p").select("o", (F.col("d") + F.col("d0")).alias("d"), (F.col("n") + F.col("n0")).alias("n"))
    trip = (F.col("d") > MOST_DISTINCT) | ((F.col("n") >= LEAST_ROWS) & (F.col("d") * SHARE > F.col("n")))
    out = total.agg(F.min_by("d", F.when(trip, F.col("o"))).alias("at"), F.max("d").alias("all"), F.count("*").alias("non_missing"), F.max(trip).alias("high"))
    nulls = rows.agg(F.count_if(F.col("v").isNull()).alias("missing"))
    return out.crossJoin(F.broadcast(nulls)).select(  # one row each
        F.lit(column).alias("name"), "non_missing", "missing",
        F.coalesce(F.when(F.col("high"), F.col("at")).otherwise(F.col("all")), F.lit(0)).alias("distinct"), F.coalesce("high", F.lit(False)).alias("high_cardinality"),
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(quoted(column)).alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """name, rank, value, n: the n most frequent values of each column, ties by value."""
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    counts = text_values(df, columns).filter("value is not null")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("name", "rank", "value", "n")


def non_null_cells(df: DataFrame) -> DataFrame:
    total = sum((F.count(F.col(quoted(c))) for c in df.columns), F.lit(0))
    return df.agg(total.cast("bigint").alias("non_null"))


def missing_policy(df: DataFrame, tag_columns: dict[str, str]) -> DataFrame:
    """name, tags (sorted letters seen), system (is "." or "_" seen): what missing tags occur; tag_columns: name -> column."""
    aggs = {}
    for name, c in tag_columns.items():
        t = F.col(quoted(c))
        aggs[name] = {"tags": F.array_join(F.sort_array(F.collect_set(F.when(t.rlike("^[A-Z]$"), t))), ","), "system": F.coalesce(F.max(t.isin(".", "_")), F.lit(False))}
    return _long(df, aggs, {"tags": "string", "system": "boolean"}).drop("index")


def status_counts(df: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    return df.groupBy(group).pivot(status, values).agg(F.count(F.lit(1))).na.fill(0)
