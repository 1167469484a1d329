"""Scalar helpers whose results differ from Spark's defaults: truncating division and null-tolerant text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..record import as_column


def div(a: Column, b) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, as_column(b))


def text(*parts) -> Column:
    """Concatenation in which a null reads ``null``."""
    return F.concat(*[F.coalesce(as_column(p).cast("string"), F.lit("null")) for p in parts])


def years_between(start: Column, end: Column) -> Column:
    """Whole years from start to end."""
    return F.floor(F.months_between(end, start) / 12).cast("long")
