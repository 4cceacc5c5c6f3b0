"""Time literals and range filters that keep the raw column bare, so they reach the Parquet scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

Instant = str | datetime | Column


def instant(df: DataFrame, time: str, value: Instant) -> Column:
    """``value`` as a literal of the column's own timestamp type (naive means UTC)."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast(df.schema[time].dataType)


def between(df: DataFrame, time: str, start: Instant | None = None, end: Instant | None = None) -> DataFrame:
    """Rows with start <= time <= end; a missing bound is open."""
    if start is not None:
        df = df.where(F.col(time) >= instant(df, time, start))
    if end is not None:
        df = df.where(F.col(time) <= instant(df, time, end))
    return df


def since(df: DataFrame, time: str, now: Instant, span: str) -> DataFrame:
    """Rows younger than ``now - span`` and not after ``now``; ``span`` is like '10 minutes'."""
    at = instant(df, time, now)
    return df.where((F.col(time) > at - F.expr(f"INTERVAL {span}")) & (F.col(time) <= at))


def micros(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col.cast("timestamp"))


def age_seconds(df: DataFrame, time: str, now: Instant) -> Column:
    return (micros(instant(df, time, now)) - micros(time)) / F.lit(1000000)


def bucket(time: str, width: str) -> Column:
    return F.window(time, width)["start"]
