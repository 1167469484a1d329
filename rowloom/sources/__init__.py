"""Sources: Parquet tables, any DataFrame, ranges and literal values."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..field import Field
from ..stream import Aux, RecordStream


def parquet(spark: SparkSession, path: str, *columns: str) -> RecordStream:
    """A field for each column (or the named ones), found by ``stream.field(name)``. Columns that no operator reads are not scanned."""
    df = spark.read.parquet(path)
    return RecordStream.of(df.select(*columns) if columns else df)


def rows(spark: SparkSession, fields: list[Field], values: list[tuple]) -> RecordStream:
    """Literal rows; fields without a type are strings."""
    schema = ", ".join(f"`{f.column}` {f.dtype or 'string'}" for f in fields)
    return RecordStream.of(spark.createDataFrame(values, schema), *fields)


def int_range(spark: SparkSession, start: int, end: int) -> Aux:
    return Aux.range(spark, start, end, "int")


def long_range(spark: SparkSession, start: int, end: int) -> Aux:
    return Aux.range(spark, start, end, "long")


def doubles(spark: SparkSession, values: list[float]) -> Aux:
    return Aux.of(spark, values, "double")
