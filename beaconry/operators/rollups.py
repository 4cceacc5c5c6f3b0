"""Time-bucketed rollups. Every aggregate is mergeable, so Spark combines on the map side first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from beaconry.functions import exact
from beaconry.functions.scalar import region_slug
from beaconry.functions.timeutil import Instant, bucket, instant
from beaconry.operators import states


def rollup(df: DataFrame, width: str, *, sketch: bool = False) -> DataFrame:
    """One row per (bucket, node): mean, least and greatest latency, mean uptime and loss, sample count.

    ``sketch`` adds a KLL sketch of latency whose merges answer percentiles over longer spans.
    """
    aggs = [
        exact.mean(df, "latency_ms").alias("avg_latency"),
        F.min("latency_ms").alias("min_latency"),
        F.max("latency_ms").alias("max_latency"),
        exact.mean(df, "uptime_pct").alias("avg_uptime"),
        exact.mean(df, "packet_loss").alias("avg_loss"),
        F.count(F.lit(1)).alias("samples"),
    ]
    if sketch:
        aggs.append(F.kll_sketch_agg_double(F.col("latency_ms").cast("double")).alias("latency_sketch"))
    if not df.isStreaming:
        return df.groupBy(bucket("time", width).alias("bucket"), "node_id").agg(*aggs)
    # a stream keeps the watermark only on the window itself
    out = df.groupBy(F.window("time", width).alias("_w"), "node_id").agg(*aggs)
    return out.select(F.col("_w.start").alias("bucket"), *out.columns[1:])


def rollup_1m(df: DataFrame) -> DataFrame:
    return rollup(df, "1 minute")


def rollup_5m_node(df: DataFrame, sketch: bool = True) -> DataFrame:
    return rollup(df, "5 minutes", sketch=sketch)


def rollup_hourly(df: DataFrame) -> DataFrame:
    return rollup(df, "1 hour")


def rollup_daily(df: DataFrame) -> DataFrame:
    return rollup(df, "1 day")


def rollup_5m_region(metrics: DataFrame, nodes: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Region rollup: samples shrink to (bucket, node) moments before they meet the node table.

    The join then handles one row per node and bucket, so neither a hot node nor a large
    node table shuffles raw samples.
    """
    scale = exact.scale_of(metrics, "latency_ms")
    if scale is not None and scale == exact.scale_of(metrics, "uptime_pct") == exact.scale_of(metrics, "packet_loss"):
        return states.finished_region(states.by_region(states.from_samples(metrics, width), nodes), scale)
    lat = F.col("latency_ms").cast("double")  # samples of other types: sums of doubles
    per_node = metrics.groupBy(bucket("time", width).alias("bucket"), "node_id").agg(
        *exact.partial(metrics, "latency_ms", "lat"), F.sum(lat * lat).alias("lat_sq"), *exact.partial(metrics, "packet_loss", "loss"),
        *exact.partial(metrics, "uptime_pct", "up"), F.count(F.lit(1)).alias("n"))
    dim = nodes.select("node_id", region_slug(F.col("country"), F.col("region")).alias("region"))
    total, n = F.sum("lat_sum") / F.lit(10 ** (scale or 0)), F.sum("lat_n")
    spread = F.sum("lat_sq") - total * total / n
    return per_node.join(dim, "node_id").groupBy("bucket", "region").agg(
        exact.merged_mean(metrics, "latency_ms", "lat").alias("avg_latency"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("std_latency"),
        exact.merged_mean(metrics, "packet_loss", "loss").alias("avg_loss"),
        exact.merged_mean(metrics, "uptime_pct", "up").alias("avg_uptime"),
        F.sum("n").alias("samples"))


def _percentile(p: float):
    return F.percentile(F.col("latency_ms").cast("double"), p, F.col("freq"))


def hourly_percentiles(df: DataFrame) -> DataFrame:
    """Hourly rollup with exact p50, p95, p99, least uptime and greatest loss.

    Samples shrink to counts per distinct latency first. The value domain is bounded (two-digit decimals
    up to 10,000), so the exact percentiles read at most that many rows per key, however hot the key is.
    """
    slim = df.groupBy(bucket("time", "1 hour").alias("bucket"), "node_id", "latency_ms").agg(
        F.count(F.lit(1)).alias("freq"),
        *exact.partial(df, "uptime_pct", "up"),
        *exact.partial(df, "packet_loss", "loss"),
        F.min("uptime_pct").alias("min_uptime"),
        F.max("packet_loss").alias("max_loss"),
    )
    lat_units = exact.units(df, "latency_ms")
    scale = 10 ** (exact.scale_of(df, "latency_ms") or 0)
    return slim.groupBy("bucket", "node_id").agg(
        (F.sum(lat_units * F.col("freq")) / (F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("freq"))) * scale))
        .alias("avg_latency"),
        F.min("latency_ms").alias("min_latency"),
        F.max("latency_ms").alias("max_latency"),
        _percentile(0.50).alias("p50_latency"),
        _percentile(0.95).alias("p95_latency"),
        _percentile(0.99).alias("p99_latency"),
        exact.merged_mean(df, "uptime_pct", "up").alias("avg_uptime"),
        F.min("min_uptime").alias("min_uptime"),
        exact.merged_mean(df, "packet_loss", "loss").alias("avg_loss"),
        F.max("max_loss").alias("max_loss"),
        F.sum("freq").alias("samples"),
    )


def daily_availability(df: DataFrame, threshold: float = 95.0) -> DataFrame:
    """Daily rollup with the count and percentage of samples above an uptime threshold."""
    good = F.count_if(F.col("uptime_pct") > threshold)
    n = F.count(F.lit(1))
    return df.groupBy(bucket("time", "1 day").alias("bucket"), "node_id").agg(
        exact.mean(df, "latency_ms").alias("avg_latency"),
        exact.mean(df, "uptime_pct").alias("avg_uptime"),
        exact.mean(df, "packet_loss").alias("avg_loss"),
        n.alias("samples"),
        good.alias("high_availability_count"),
        (good * 100 / n).alias("availability_pct"),
    )


def merge_percentile(rollups: DataFrame, p: float, *keys: str) -> DataFrame:
    """Percentile over many buckets from merged sketches; approximate, with KLL's rank error."""
    merged = F.kll_merge_agg_double("latency_sketch")
    return rollups.groupBy(*keys).agg(
        F.kll_sketch_get_quantile_double(merged, F.lit(p)).alias("latency_quantile"),
        F.sum("samples").alias("samples"),
    )


def refresh_rollup(raw: DataFrame, mat: DataFrame, width: str, start_s: int, end_s: int, now: Instant,
                   make=None) -> DataFrame:
    """Recompute the buckets lying wholly inside [now - start_s, now - end_s) and keep all others.

    The raw side is filtered to whole buckets first, so the scan prunes to the refresh window.
    """
    at = instant(raw, "time", now)
    lo, hi = at - F.make_dt_interval(secs=F.lit(start_s)), at - F.make_dt_interval(secs=F.lit(end_s))
    make = make or (lambda df: rollup(df, width))
    inside = (F.col("bucket") >= lo) & (F.col("bucket") + F.expr(f"INTERVAL {width}") <= hi)
    fresh = make(raw.where((F.col("time") >= lo) & (F.col("time") < hi))).where(inside)
    return mat.where(~inside).unionByName(fresh.select(*mat.columns))


def realtime_view(mat: DataFrame, raw: DataFrame, width: str, threshold: Instant, make=None) -> DataFrame:
    """Materialised buckets below the threshold, and buckets at or above it aggregated live.

    ``threshold`` must be a bucket boundary; the live part reads only raw rows from there on.
    """
    at = instant(raw, "time", threshold)
    make = make or (lambda df: rollup(df, width))
    live = make(raw.where(F.col("time") >= at))
    return mat.where(F.col("bucket") < at).unionByName(live.select(*mat.columns))


def rollup_health(views: dict[str, DataFrame], now: Instant, max_lag: dict[str, int] | None = None) -> DataFrame:
    """Lag of the newest bucket of each rollup against its limit; a rollup without rows is unhealthy."""
    limits = max_lag or MAX_LAG_SECONDS
    parts = []
    for name, df in views.items():
        top = df.agg(F.max("bucket").alias("latest"))
        lag = F.unix_seconds(instant(df, "bucket", now).cast("timestamp")) - F.unix_seconds(
            F.col("latest").cast("timestamp"))
        parts.append(top.select(
            F.lit(name).alias("view_name"), "latest", lag.alias("lag_s"),
            F.coalesce(lag < limits.get(name, 3600), F.lit(False)).alias("healthy")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Greatest lag in seconds before a rollup counts as stale.
MAX_LAG_SECONDS = {"1m": 120, "5m_node": 600, "5m_region": 600, "hourly": 7200, "daily": 86400}
