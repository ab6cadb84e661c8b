"""Snapshots and comparison of tables; value labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalars import cell_kind, cell_number, date_text, has_controls, label_key, parse_time, shifted_ascii
from larkspur.operators.selection import quoted
from larkspur.operators.summarize import missing_policy

#: Tolerances of a comparison.
NUMBER, DATETIME = 1e-4, 1.5


def snapshot(df: DataFrame, row_id: str) -> DataFrame:
    """row, col, kind, number, text: one row for each cell but those of row_id."""
    cells = []
    for i, (name, t) in enumerate((n, t) for n, t in df.dtypes if n != row_id):
        c, kind = F.col(quoted(name)), cell_kind(t)
        text = c.cast("string") if kind in ("string", "bytes") else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(i).alias("col"), F.when(c.isNull(), "missing").otherwise(kind).alias("kind"), cell_number(c, t).alias("number"), text.alias("text")))
    return df.select(F.col(quoted(row_id)).alias("row"), F.explode(F.array(*cells)).alias("c")).select("row", "c.*")


def latin1_as_utf8(c: Column) -> Column:
    from larkspur.functions.scalars import repair_mojibake

    return repair_mojibake(c)


def compare_snapshots(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """row, col, verdict of each cell: ok, ok_kind, ok_bridge, ok_missing, ok_text, value, kind, extra or absent."""
    a = actual.select("row", "col", F.col("kind").alias("ak"), F.col("number").alias("an"), F.col("text").alias("at"))
    e = expected.select("row", "col", F.col("kind").alias("ek"), F.col("number").alias("en"), F.col("text").alias("et"))
    ak, an, at, ek, en, et = map(F.col, ("ak", "an", "at", "ek", "en", "et"))
    near = lambda tol: F.abs(an - en) <= tol
    own = F.when(ak == "datetime", near(DATETIME)).otherwise(near(NUMBER))
    bridge = (F.abs(an * 86400 - en) <= DATETIME) | (F.abs(an - en * 86400) <= DATETIME) | (F.abs(an - en / 86400) <= NUMBER) | near(DATETIME)
    same = F.when(ak == "missing", True).when(ak.isin("string", "bytes"), at == et).otherwise(own)
    text = (ak == "string") & ((latin1_as_utf8(et) == at) | (F.coalesce(has_controls(at) | has_controls(et), F.lit(False)) & shifted_ascii(at, et)))
    verdict = (
        F.when(ek.isNull(), "extra").when(ak.isNull(), "absent")
        .when((ak == ek) & same, "ok").when((ak == ek) & text, "ok_text").when(ak == ek, "value")
        .when(ak.isin("date", "datetime", "time") & (ek == "number") & own, "ok_kind")
        .when(ak.isin("date", "datetime", "number") & ek.isin("date", "datetime", "number") & bridge, "ok_bridge")
        .when(ek == "missing", "ok_missing").otherwise("kind")
    )
    return a.join(e, ["row", "col"], "full").select("row", "col", verdict.alias("verdict"))


def compare_summaries(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """name, verdict by column name: same, left_only, right_only, counts or values differ (relative and absolute)."""
    x = a.select("name", *(F.col(c).alias(f"a_{c}") for c in ("non_missing", "missing", "sum", "min", "max")))
    y = b.select("name", *(F.col(c).alias(f"b_{c}") for c in ("non_missing", "missing", "sum", "min", "max")))
    counts = (F.col("a_non_missing") == F.col("b_non_missing")) & (F.col("a_missing") == F.col("b_missing"))

    def close(c: str) -> Column:
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        return p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= F.greatest(tolerance * F.greatest(F.abs(p), F.abs(q)), F.lit(tolerance)), F.lit(False))

    verdict = F.when(F.col("b_non_missing").isNull(), "left_only").when(F.col("a_non_missing").isNull(), "right_only").when(~counts, "counts").when(~(close("sum") & close("min") & close("max")), "values").otherwise("same")
    return x.join(y, "name", "full").select("name", verdict.alias("verdict"))


def diff_frames(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-8) -> DataFrame:
    """name, kind, n: rows on one side only, columns on one side only, and differing cells of each shared column."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    x = a.select(F.col(quoted(key)).alias("_k"), *(F.col(quoted(c)).alias(f"a{i}") for i, c in enumerate(shared)), F.lit(True).alias("_a"))
    y = b.select(F.col(quoted(key)).alias("_k"), *(F.col(quoted(c)).alias(f"b{i}") for i, c in enumerate(shared)), F.lit(True).alias("_b"))
    types = dict(a.dtypes)
    aggs = [F.count_if(F.col("_b").isNull()).alias("left"), F.count_if(F.col("_a").isNull()).alias("right")]
    for i, c in enumerate(shared):
        p, q = F.col(f"a{i}"), F.col(f"b{i}")
        same = p.eqNullSafe(q)
        if cell_kind(types[c]) == "number":
            same = same | F.coalesce(F.abs(p.cast("double") - q.cast("double")) <= tolerance, F.lit(False))
        aggs.append(F.count_if(F.col("_a") & F.col("_b") & ~same).alias(f"d{i}"))
    rows = [F.struct(F.lit(key).alias("name"), F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in (("left_rows", "left"), ("right_rows", "right"))]
    rows += [F.struct(F.lit(c).alias("name"), F.lit("cells").alias("kind"), F.col(f"d{i}").alias("n")) for i, c in enumerate(shared)]
    rows += [F.struct(F.lit(c).alias("name"), F.lit("left_column").alias("kind"), F.lit(1).cast("bigint").alias("n")) for c in a.columns if c not in b.columns]
    rows += [F.struct(F.lit(c).alias("name"), F.lit("right_column").alias("kind"), F.lit(1).cast("bigint").alias("n")) for c in b.columns if c not in a.columns]
    return x.join(y, "_k", "full").agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def resolve_labels(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """Which set of value labels each variable uses: name, set_name.  columns: name, format; labels: set_name, ..."""
    sets = labels.select("set_name").distinct().select("set_name", label_key(F.col("set_name")).alias("k"))
    own = columns.select("name", label_key(F.coalesce("format", F.lit(""))).alias("k")).filter("k <> ''")
    plain = own.join(sets, "k").select("name", "set_name", F.lit(0).alias("o"))
    dollar = own.select("name", F.concat(F.lit("$"), "k").alias("k")).join(sets, "k").select("name", "set_name", F.lit(1).alias("o"))
    return plain.unionByName(dollar).groupBy("name").agg(F.min_by("set_name", "o").alias("set_name"))


def attach_catalog(df: DataFrame, labels: DataFrame, *, rescan: bool = True) -> DataFrame:
    """The table with `value_labels` (name of the set) in the metadata of its columns; values stay.

    The missing policy of a column (`system_missing`, `missing_tags`) comes from its set of labels and, with rescan, from
    the tags that occur in the companion columns `<name>__missing`, if the table was read with them (missingTags).
    """
    spark = df.sparkSession
    columns = spark.createDataFrame([(f.name, f.metadata.get("format") or "") for f in df.schema.fields], "name string, format string")
    found = {r["name"]: r["set_name"] for r in resolve_labels(columns, labels).collect()}  # one row for each column at most
    tags: dict[str, set] = {r["name"]: set(filter(None, r["tags"].split(","))) for r in label_policies(columns, labels).collect()}
    system = {r["name"]: bool(r["system_missing"]) for r in label_policies(columns, labels).collect()}
    seen = {n: f"{n}__missing" for n in df.columns if f"{n}__missing" in df.columns}
    if rescan and seen:
        for r in missing_policy(df, seen).collect():
            tags[r["name"]] = tags.get(r["name"], set()) | set(filter(None, r["tags"].split(",")))
            system[r["name"]] = system.get(r["name"], False) or r["system"]
    out = []
    for f in df.schema.fields:
        meta = dict(f.metadata)
        if f.name in found:
            meta["value_labels"] = found[f.name]
        if meta.get("sas_kind", "character") != "character":
            meta["system_missing"] = True
        if system.get(f.name):
            meta["system_missing"] = True
        if tags.get(f.name):
            meta["missing_tags"] = ",".join(sorted(tags[f.name]))
        out.append(F.col(quoted(f.name)).alias(f.name, metadata=meta))
    return df.select(*out)


def label_policies(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """name, system_missing, tags: missing policy of each variable from its set of labels."""
    tags = labels.groupBy("set_name").agg(
        F.max(F.col("value_type") == "numeric").alias("system_missing"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("key_kind") == "tag", F.col("key_tag")))), ",").alias("tags")
    )
    return resolve_labels(columns, labels).join(tags, "set_name").select("name", "system_missing", "tags")


def apply_labels(df: DataFrame, column: str, labels: DataFrame, set_name: str, out: str) -> DataFrame:
    """Extension: the label of each value of a column, null without one."""
    kind = dict(df.dtypes)[column]
    key = "key_string" if kind == "string" else "key_number"
    pairs = labels.filter(F.col("set_name") == set_name).filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("label").alias(out))
    return df.join(pairs, F.col(quoted(column)).cast("string" if kind == "string" else "double") == F.col("_key"), "left").drop("_key")


def csv_cells(df: DataFrame, row_id: str, kinds: dict[str, str]) -> DataFrame:
    """Snapshot (row, col, kind, number, text) of a CSV read as text; kinds: string, number, date, datetime, time by column.

    An empty field or "." is empty text, or a missing number.  Text that is no number is an error.
    """
    cells = []
    for i, (name, kind) in enumerate(kinds.items()):
        c = F.col(quoted(name))
        gone = F.coalesce(c, F.lit("")).isin("", ".")
        if kind == "string":
            made, number, text = F.lit("string"), F.lit(None).cast("double"), F.when(gone, "").otherwise(c)
        else:
            made, number, text = F.when(gone, "missing").otherwise(kind), F.when(~gone, c).cast("double"), F.lit(None).cast("string")
        cells.append(F.struct(F.lit(i).alias("col"), made.alias("kind"), number.alias("number"), text.alias("text")))
    return df.select(F.col(quoted(row_id)).cast("bigint").alias("row"), F.explode(F.array(*cells)).alias("c")).select("row", "c.*")


def matches_csv(c: Column, type_name: str, expected: Column) -> Column:
    """Does a cell agree with a field of a CSV?  Empty: missing or empty text.  Numbers to 1e-6, integers exactly (a field
    may be off a whole number by 1e-3), times to a microsecond, dates and datetimes as written."""
    kind, field = cell_kind(type_name), F.coalesce(expected, F.lit(""))
    number = field.try_cast("double")
    if kind in ("string", "bytes"):
        same = c.cast("string") == field
        return F.when(field == "", c.isNull() | (c.cast("string") == "")).otherwise(F.coalesce(same, F.lit(False)))
    if kind == "date":
        same = date_text(c) == field
    elif kind == "datetime":
        same = F.abs(F.unix_micros(c.cast("timestamp")) - F.unix_micros(field.try_cast("timestamp"))) <= 1
    elif kind == "time":
        same = F.abs(cell_number(c, type_name) * 1e6 - parse_time(field)) <= 1
    elif type_name in ("tinyint", "smallint", "int", "bigint"):
        same = (c == F.round(number).cast("bigint")) & (F.abs(number - F.round(number)) <= 1e-3)
    else:
        same = F.abs(c.cast("double") - number) <= 1e-6
    return F.when(field == "", c.isNull()).otherwise(F.coalesce(same, F.lit(False)))


def foreign_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot of a table file as another reader sees it (pandas, on the driver: for checks of small files)."""
    import pandas as pd

    frame = pd.read_sas(path, encoding="utf-8")
    rows = []
    for col, name in enumerate(frame.columns):
        for row, v in enumerate(frame[name].tolist()):
            if isinstance(v, str):
                rows.append((row, col, "string", None, v))
            elif v is None or v != v:
                rows.append((row, col, "missing" if frame[name].dtype.kind != "O" else "string", None, "" if frame[name].dtype.kind == "O" else None))
            elif isinstance(v, pd.Timestamp):
                rows.append((row, col, "datetime", (v - pd.Timestamp("1960-01-01")) / pd.Timedelta(seconds=1), None))
            elif isinstance(v, pd.Timedelta):
                rows.append((row, col, "time", v.total_seconds(), None))
            else:
                rows.append((row, col, "number", float(v), None))
    return spark.createDataFrame(rows, "row long, col int, kind string, number double, text string")
