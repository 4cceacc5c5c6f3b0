"""Choice of rollup tier for a fleet query, and the query itself."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from beaconry.functions.scalar import region_label
from beaconry.operators import fleet, states

# Below this window length in seconds the named tier answers.
TIER_LIMITS = ((120, "raw"), (900, "1m"), (7200, "5m"), (172800, "hourly"))
INTERVAL_TIER = {"1m": "1m", "5m": "5m", "1h": "hourly", "1d": "daily"}


def select_tier(window_s: int, dimension: str = "node", prefer_fresh: bool = False,
                disabled: frozenset[str] = frozenset()) -> str:
    """Tier by window length; a fresh answer under ten minutes, or a disabled tier, means raw samples."""
    if dimension not in ("node", "region"):
        raise ValueError("dimension must be 'node' or 'region'")
    if prefer_fresh and window_s < 600:
        return "raw"
    tier = next((name for limit, name in TIER_LIMITS if window_s < limit), "daily")
    if tier == "5m":
        tier = "5m_region" if dimension == "region" else "5m_node"
    return "raw" if tier in disabled else tier


def query_fleet(raw: DataFrame, nodes: DataFrame, tiers: dict[str, Callable[[str, str], DataFrame]], dimension: str,
                start: str, end: str, interval: str = "auto", prefer_fresh: bool = False,
                disabled: frozenset[str] = frozenset()) -> DataFrame:
    """Fleet statistics from the tier that fits the window; ``interval`` other than auto names the tier.

    ``tiers`` maps tier names to functions that give the rollup between two times (``RollupStore.tier``), so that only its days are read. Node tiers answer region queries through the
    node table. Estimated percentiles come back as ``p95_estimate``, exact ones as ``p95_latency``.
    """
    span = int((datetime.fromisoformat(end) - datetime.fromisoformat(start)).total_seconds())
    tier = select_tier(span, dimension, prefer_fresh, disabled)
    if interval != "auto":
        tier = INTERVAL_TIER[interval]
        if tier == "5m":
            tier = "5m_region" if dimension == "region" else "5m_node"
    if tier == "raw":
        if dimension == "node":
            return fleet.fleet_by_node(raw, start, end)
        return fleet.fleet_by_region(raw, nodes, start, end)
    rollups = tiers[tier](start, end)
    if tier == "5m_region":
        return fleet.fleet_from_region_rollup(rollups, start, end)
    if dimension == "node":
        return fleet.fleet_from_node_rollup(rollups, start, end)
    label = region_label(F.col("country"), F.col("region"))
    keyed = rollups.join(nodes.select("node_id", label.alias("label")), "node_id", "left")
    return fleet.fleet_from_node_rollup(keyed.withColumn("node_id", F.col("label")).drop("label"), start, end)


def fleet_percentiles(tier_states: Callable[[str, str, str], DataFrame], nodes: DataFrame, dimension: str, start: str, end: str,
                      p: float = 0.95) -> DataFrame:
    """Sample-weighted mean, extremes, count and a percentile of latency from the states of the tier that fits the window.

    No sample is read: sketches of the tier's buckets are merged, and the percentile's rank is off by ``states.SKETCH_ERROR`` at most
    (exact while a key has fewer values than ``states.SKETCH_K``). Windows below two hours take the five-minute tier.
    """
    span = int((datetime.fromisoformat(end) - datetime.fromisoformat(start)).total_seconds())
    name = select_tier(max(span, 900), "node")
    rows = tier_states(name, start, end)
    key = F.col("node_id")
    if dimension == "region":
        label = region_label(F.col("country"), F.col("region"))
        rows, key = rows.join(nodes.select("node_id", label.alias("label")), "node_id", "left"), F.col("label")
    out = states.merged(rows, {"dimension": F.coalesce(key, F.lit("Unknown"))})
    return out.select(
        "dimension", (F.col("lat_sum") / (F.col("lat_n") * 100)).alias("avg_latency"), "min_latency", "max_latency",
        F.kll_sketch_get_quantile_double("latency_sketch", F.lit(p)).alias("latency_quantile"), F.col("samples").alias("reporting_count"))
