"""Extension: a folder of tables as a stream; every new file is decoded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.sources.datasource import read_table_bytes

_FILES = T.StructType().add("path", T.StringType()).add("modificationTime", T.TimestampType()).add("length", T.LongType()).add("content", T.BinaryType())


def watch_tables(spark: SparkSession, folder: str, schema: T.StructType, **options) -> DataFrame:
    """Streaming DataFrame of the rows of all tables that appear below folder."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.[sS][aA][sS]7[bB][dD][aA][tT]").option("recursiveFileLookup", "true").load(folder)
    return read_table_bytes(files, schema, **options)
