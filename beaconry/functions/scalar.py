"""Column functions: parsing, normalisation, slugs, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Metadata keys with these endings hold numbers.
NUMERIC_SUFFIXES = ("_percent", "_pct", "_ms", "_count", "_bytes")

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def to_float(col: Column, default: float = 0.0) -> Column:
    """Text to double: 'true'/'false' are 1/0, plain decimal or exponent text is read, all else is ``default``."""
    text = F.trim(col.cast("string"))
    return (
        F.when(text.rlike(_NUMBER), text.try_cast("double"))
        .when(F.lower(text) == "true", F.lit(1.0))
        .when(F.lower(text) == "false", F.lit(0.0))
        .otherwise(F.lit(float(default)))
    )


def to_ts(col: Column, now: Column) -> Column:
    """ISO 8601 with Z or offset, or an epoch number of seconds; anything else becomes ``now``."""
    text = F.trim(col.cast("string"))
    epoch = F.timestamp_micros((text.try_cast("double") * 1000000).cast("long"))
    return F.coalesce(F.when(text.rlike(_NUMBER), epoch).otherwise(text.try_cast("timestamp")), now.cast("timestamp"))


def clamp(col: Column, low: float, high: float | None = None) -> Column:
    col = F.greatest(F.nanvl(col, F.lit(low)), F.lit(low))
    return col if high is None else F.least(col, F.lit(high))


def country_code(col: Column) -> Column:
    return F.upper(F.substring(F.coalesce(col, F.lit("XX")), 1, 2))


def region_slug(country: Column, region: Column) -> Column:
    return F.concat(F.lower(country), F.lit("-"), F.lower(F.replace(region, F.lit(" "), F.lit("-"))))


def region_slug_display(country: Column, region: Column) -> Column:
    """Panel variant: blanks of the region stay."""
    return F.concat(F.lower(country), F.lit("-"), F.lower(region))


def region_label(country: Column, region: Column) -> Column:
    """``region/country``, or Unknown when either is missing."""
    return F.coalesce(F.concat(region, F.lit("/"), country), F.lit("Unknown"))


def normalize_metadata(meta: Column) -> Column:
    """Values under numeric endings become number text (bad ones 0.0), others stay; null becomes an empty map."""
    numeric = "(" + "|".join(NUMERIC_SUFFIXES) + ")$"
    fixed = F.transform_values(meta, lambda k, v: F.when(k.rlike(numeric), to_float(v).cast("string")).otherwise(v))
    return F.coalesce(fixed, F.create_map().cast("map<string,string>"))


def problem_score(latency: Column, loss: Column, uptime: Column) -> Column:
    return latency / 50.0 + loss * 10.0 + (100.0 - uptime) * 2.0


def availability_pct(total: Column, downtime: Column) -> Column:
    return F.when(total > 0, 100.0 * (1.0 - downtime / total)).otherwise(F.lit(0.0))


def z_ramp(z: Column) -> Column:
    """0 below 1.5 sigma, 1 from 3 sigma, linear between (4 digits)."""
    return F.when(z < 1.5, 0.0).when(z >= 3.0, 1.0).otherwise(F.round((z - 1.5) / 1.5, 4))


def time_since(seconds: Column) -> Column:
    """Age text: Never, ``Ns ago`` below a minute, else ``Nm ago``."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds.isNull(), "Never")
        .when(whole < 60, F.concat(whole.cast("string"), F.lit("s ago")))
        .otherwise(F.concat(F.floor(whole / 60).cast("long").cast("string"), F.lit("m ago")))
    )
