"""Normalisation of raw metric rows and lookup of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beaconry.functions import scalar

# Coordinates and country of known regions, in lookup order.
REGION_COORDS = (
    ("Accra", 5.6037, -0.1870, "GH"),
    ("Kumasi", 6.6885, -1.6244, "GH"),
    ("Tamale", 9.4034, -0.8393, "GH"),
    ("Lagos", 6.5244, 3.3792, "NG"),
    ("Abuja", 9.0765, 7.3986, "NG"),
    ("Kano", 12.0022, 8.5919, "NG"),
    ("Nairobi", -1.2921, 36.8219, "KE"),
    ("Mombasa", -4.0435, 39.6682, "KE"),
    ("Kisumu", -0.0917, 34.7680, "KE"),
)

# Other spellings of a region, in lower case.
REGION_ALIASES = {
    "greater accra": "Accra",
    "accra region": "Accra",
    "lagos mainland": "Lagos",
    "lagos island": "Lagos",
    "fct": "Abuja",
    "test region": "Accra",
}


def normalize(df: DataFrame, now: Column) -> DataFrame:
    """Clean raw text fields: numbers with defaults 0/100/0 and clamps, codes, UTC time, metadata. Other columns stay."""
    return df.withColumns({
        "node_id": F.coalesce(F.col("node_id").cast("string"), F.lit("unknown")),
        "country": scalar.country_code(F.col("country")),
        "region": F.coalesce(F.col("region"), F.lit("Unknown")),
        "latency_ms": scalar.clamp(scalar.to_float(F.col("latency_ms"), 0.0), 0.0),
        "uptime_pct": scalar.clamp(scalar.to_float(F.col("uptime_pct"), 100.0), 0.0, 100.0),
        "packet_loss": scalar.clamp(scalar.to_float(F.col("packet_loss"), 0.0), 0.0, 100.0),
        "time": scalar.to_ts(F.col("timestamp"), now),
        "metadata": scalar.normalize_metadata(F.col("metadata")),
    }).drop("timestamp")


def is_valid(df: DataFrame) -> DataFrame:
    """Rows with every required field and a latency that is not negative."""
    required = F.lit(True)
    for c in ("node_id", "latency_ms", "uptime_pct", "packet_loss", "time"):
        required = required & F.col(c).isNotNull()
    return df.where(required & (F.col("latency_ms") >= 0))


def split_health(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric rows, self-report rows); reports keep their counters and never reach rollups."""
    report = F.coalesce(F.col("metadata")["type"] == "health", F.lit(False))
    meta = F.col("metadata")
    health = df.where(report).select(
        "node_id", "timestamp", meta["cpu_pct"].try_cast("double").alias("cpu_pct"),
        meta["mem_pct"].try_cast("double").alias("mem_pct"), meta["push_ok"].try_cast("long").alias("push_ok"),
        meta["push_err"].try_cast("long").alias("push_err"))
    return df.where(~report), health


def geo_lookup(df: DataFrame, region: str = "region", coords=REGION_COORDS, aliases=None) -> DataFrame:
    """Add ``geo_key``, ``geo_lat``, ``geo_lng``, ``geo_country``: exact name, else alias, else first contained key.

    The tables are short constants, so the lookup is one expression without a join.
    """
    aliases = REGION_ALIASES if aliases is None else aliases
    name = F.col(region)
    folded = F.lower(F.trim(name))
    keys = [c[0] for c in coords]
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    contained = F.coalesce(*[F.when(folded.contains(k.lower()), F.lit(k)) for k in keys])
    exact = F.when(name.isin(*keys), name)
    known_alias = F.try_element_at(alias, folded)
    key = F.coalesce(exact, F.when(known_alias.isin(*keys), known_alias), contained)

    def column(i: int, kind: str) -> Column:
        table = F.create_map(*[F.lit(x) for c in coords for x in (c[0], c[i])])
        return F.try_element_at(table, F.col("geo_key")).cast(kind)

    return df.withColumn("geo_key", F.when(F.length(name) > 0, key)).withColumns(
        {"geo_lat": column(1, "double"), "geo_lng": column(2, "double"), "geo_country": column(3, "string")})
