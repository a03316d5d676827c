"""Facts in text: one a line, fields between commas (`.csv`) or tabs; blank lines and those that begin with % don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed(line: Column, separator: str, schema: T.StructType) -> list[Column]:
    """A line's fields, trimmed and converted; a field that doesn't convert is an error, extra ones at the end are ignored."""
    fields = F.split(line, separator, -1)
    return [F.trim(F.get(fields, F.lit(k))).cast(f.dataType).alias(f.name) for k, f in enumerate(schema)]


def read_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    lines = spark.read.text(path)
    kept = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("%"))
    return kept.select(*typed(F.col("value"), "," if path.endswith(".csv") else "\t", schema))


def rows_of_text(spark: SparkSession, lines: list[str], schema: T.StructType) -> DataFrame:
    frame = spark.createDataFrame([(x,) for x in lines if x.strip() and not x.lstrip().startswith("%")], "value string")
    return frame.select(*typed(F.col("value"), ",", schema))
