"""Data quality reports and the inventory and map views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from beaconry.functions import state
from beaconry.functions.timeutil import Instant, age_seconds, instant
from beaconry.operators import normalize
from beaconry.operators.dedup import latest_per_node


def quality_report(df: DataFrame, now: Instant, min_nodes: int = 3, max_lag_s: float = 30) -> DataFrame:
    """One row: negative and zero values, duplicate keys overall and of the last day, nodes, freshness.

    Rows shrink to one per (node, time), then one per node, so copies combine before every shuffle.
    """
    at = instant(df, "time", now)
    day = (F.col("time") > at - F.expr("INTERVAL 24 hours")) & (F.col("time") <= at)
    keys = df.groupBy("node_id", "time").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("latency_ms") < 0) | (F.col("packet_loss") < 0)).alias("neg"),
        F.count_if(F.col("latency_ms") == 0).alias("zero"))
    per_node = keys.groupBy("node_id").agg(
        F.sum("n").alias("n"), F.sum("neg").alias("neg"), F.sum("zero").alias("zero"), F.max("time").alias("last"),
        F.count_if(F.col("n") > 1).alias("dup"), F.count_if((F.col("n") > 1) & day).alias("dup_day"))

    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0))

    out = per_node.agg(
        total("n").alias("row_count"), total("neg").alias("negative_rows"), total("zero").alias("zero_latency_rows"),
        total("dup").alias("duplicate_keys"), total("dup_day").alias("duplicate_keys_24h"),
        F.count("node_id").alias("distinct_nodes"), F.max("last").alias("last_time"))
    lag = age_seconds(out, "last_time", now)
    return out.select(
        "row_count", "negative_rows", "zero_latency_rows", "duplicate_keys", "duplicate_keys_24h", "distinct_nodes",
        (F.col("distinct_nodes") >= min_nodes).alias("nodes_ok"), lag.alias("lag_s"),
        F.coalesce(lag <= max_lag_s, F.lit(False)).alias("fresh"),
        ((F.col("negative_rows") == 0) & (F.col("duplicate_keys") == 0)).alias("passed"))


def monotonic_check(df: DataFrame, n: int = 100) -> DataFrame:
    """Per node: whether the times of the newest ``n`` arrivals never run backwards in arrival order."""
    newest = Window.partitionBy("node_id").orderBy(F.desc("arrival"))
    rows = df.select("node_id", "time", "arrival").withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    later = F.lag("time").over(newest)
    rows = rows.withColumn("_back", F.coalesce(F.col("time") > later, F.lit(False)))
    return rows.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("_back").alias("inversions")).withColumn(
        "monotonic", F.col("inversions") == 0)


def _with_state(df: DataFrame, now: Instant, stale_s: float) -> DataFrame:
    return df.withColumn("state", state.node_state(
        age_seconds(df, "time", now), F.col("latency_ms"), F.col("packet_loss"), stale_s))


def inventory(df: DataFrame, now: Instant, region: str = "ALL", status: str = "ALL", stale_s: float = 30) -> DataFrame:
    """Latest row of each node with its state, filtered by country and state, worst first."""
    rows = _with_state(latest_per_node(df), now, stale_s)
    if region != "ALL":
        rows = rows.where(F.col("country") == region)
    if status != "ALL":
        rows = rows.where(F.col("state") == status)
    return rows.orderBy(F.desc(state.severity_weight(F.col("state"))), "node_id")


def map_points(df: DataFrame, now: Instant, region: str = "ALL", status: str = "ALL", stale_s: float = 30,
               coords=normalize.REGION_COORDS, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows with known coordinates and their state; a missing country comes from the region."""
    rows = _with_state(normalize.geo_lookup(df, "region", coords, aliases), now, stale_s)
    if region != "ALL":
        rows = rows.where(F.coalesce("country", "geo_country") == region)
    if status != "ALL":
        rows = rows.where(F.col("state") == status)
    return rows.where(F.col("geo_key").isNotNull())
