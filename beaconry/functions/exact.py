"""Aggregates over decimal columns that add whole units, so results do not depend on row order.

A decimal(p, s) column is summed as a bigint count of its last digit and divided once at the end.
That is exact up to 2**53 units, mergeable on the map side, and much cheaper than decimal arithmetic.
Other numeric types use Spark's own aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType


def scale_of(df: DataFrame, name: str) -> int | None:
    dtype = df.schema[name].dataType
    return dtype.scale if isinstance(dtype, DecimalType) else None


def units(df: DataFrame, name: str) -> Column:
    """The column as a count of its smallest decimal step (cents for two digits)."""
    scale = scale_of(df, name)
    if scale is None:
        return F.col(name)
    return (F.col(name) * F.lit(10**scale)).cast("long")


def mean(df: DataFrame, name: str) -> Column:
    scale = scale_of(df, name)
    if scale is None:
        return F.avg(name)
    return F.sum(units(df, name)) / (F.count(name) * F.lit(10**scale))


def total(df: DataFrame, name: str) -> Column:
    scale = scale_of(df, name)
    if scale is None:
        return F.sum(name)
    return F.sum(units(df, name)) / F.lit(10**scale)


def partial(df: DataFrame, name: str, alias: str | None = None) -> list[Column]:
    """Mergeable state of a mean: ``<alias>_sum`` in units and ``<alias>_n``."""
    alias = alias or name
    return [F.sum(units(df, name)).alias(f"{alias}_sum"), F.count(name).alias(f"{alias}_n")]


def merged_mean(df: DataFrame, name: str, alias: str | None = None) -> Column:
    """Mean from states made by :func:`partial`; ``df`` is the frame the states came from."""
    alias = alias or name
    scale = scale_of(df, name) or 0
    return F.sum(f"{alias}_sum") / (F.sum(f"{alias}_n") * F.lit(10**scale))


def rounded_ratio(scale: int | None, total_units: Column, n: Column, digits: int) -> Column:
    if scale is None:
        return F.round(total_units / n, digits)
    up, down = 10 ** max(digits - scale, 0), 10 ** max(scale - digits, 0)
    num = total_units * F.lit(2 * up) + n * F.lit(down)
    den = F.nullif(n * F.lit(2 * down), F.lit(0))
    whole = F.call_function("div", num.cast("long"), den.cast("long"))
    return whole / F.lit(10**digits)
