"""Duplicates, first-wins inserts, conflicts and latest rows.

``row_number() == 1`` lets Spark cut every group on the map side (window group limit), so a group of many
copies shrinks before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from beaconry.operators import prefix


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(spec)).where(F.col("_rn") == 1).drop("_rn")


def dedup_metrics(df: DataFrame, ttl_s: int = 180, received: str | None = None, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """One row per node and second of event time, earliest arrival first.

    With a ``received`` column the key expires ``ttl_s`` after the row that was kept; without it never.
    """
    keyed = df.withColumn("_second", F.date_trunc("second", "time"))
    if received is None:
        return first_per(keyed, ["node_id", "_second"], list(order)).drop("_second")
    out = prefix.windows(keyed, ["node_id", "_second"], received, ttl_s, list(order))
    return out.where("kept").drop("kept", "anchor", "hit", "_second")


def insert_first_wins(new: DataFrame, existing: DataFrame, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Rows of ``new`` to append so that (time, node_id) stays unique: earliest arrival, none that exist."""
    winners = first_per(new, ["time", "node_id"], list(order))
    return winners.join(existing.select("time", "node_id"), ["time", "node_id"], "left_anti")


def conflict_audit(new: DataFrame, existing: DataFrame, ingest_region: str | None = None,
                   order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Rows of ``new`` that :func:`insert_first_wins` leaves out, as audit rows with their JSON payload.

    First arrivals come from a map-side combined aggregate; only keys seen more than once join back, a small
    set that Spark broadcasts at run time when it fits.
    """
    key = ["time", "node_id"]
    place = F.struct(*order)
    first = new.groupBy(*key).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    later = new.join(first.where(F.col("_n") > 1), key).where(place > F.col("_first")).drop("_first", "_n")
    beaten = first_per(new, key, list(order)).join(existing.select(*key), key, "left_semi")
    region = F.coalesce(F.col(ingest_region) if ingest_region else F.lit(None).cast("string"), F.lit("unknown"))
    lost = later.unionByName(beaten.select(*later.columns))
    return lost.select(*key, F.to_json(F.struct(*new.columns)).alias("payload"), region.alias("ingest_region"))


def latest_per_node(df: DataFrame) -> DataFrame:
    """The newest row of each node; equal times go to the earliest arrival."""
    return first_per(df, ["node_id"], [F.desc("time"), F.asc("arrival")])


def dedup_logs(df: DataFrame) -> DataFrame:
    """Unique by timestamp and message (field ``time`` when ``timestamp`` is missing), in time order."""
    at = F.coalesce(F.col("timestamp"), F.col("time")) if "time" in df.columns else F.col("timestamp")
    keyed = df.withColumn("_at", at).withColumn("_message", F.coalesce("message", F.lit("")))
    out = first_per(keyed, ["_at", "_message"], ["arrival"])
    return out.orderBy("_at", "_message").drop("_at", "_message")
