"""Mergeable rollup states: whole units that add up, so a coarser tier comes from a finer one and equals the one from samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beaconry.functions import exact
from beaconry.functions.scalar import region_slug
from beaconry.functions.timeutil import bucket

#: Values that a sketch keeps at least before it thins them out, and the rank error that follows (fixed by the sketch's design).
SKETCH_K, SKETCH_ERROR = 400, 0.007
_SUMS = ("lat_sum", "lat_n", "lat_sq", "up_sum", "up_n", "loss_sum", "loss_n", "samples")


def square(units: Column) -> Column:
    wide = units.cast("decimal(19,0)")
    return wide * wide


def from_samples(metrics: DataFrame, width: str, sketch: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """State per (bucket, node) of decimal samples; ``sketch`` keeps a quantile sketch of latency.

    Columns ``within``, which bucket and node determine, are kept; rows partitioned by them are not moved again.
    """
    aggs = [
        *exact.partial(metrics, "latency_ms", "lat"), F.sum(square(exact.units(metrics, "latency_ms"))).alias("lat_sq"),
        F.min("latency_ms").alias("min_latency"), F.max("latency_ms").alias("max_latency"),
        *exact.partial(metrics, "uptime_pct", "up"), *exact.partial(metrics, "packet_loss", "loss"), F.count(F.lit(1)).alias("samples")]
    if sketch:
        aggs.append(F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_K)).alias("latency_sketch"))
    return metrics.groupBy(*within, bucket("time", width).alias("bucket"), "node_id").agg(*aggs)


def merged(states: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """States added up by the key expressions."""
    aggs = [F.sum(c).cast(states.schema[c].dataType).alias(c) for c in _SUMS]
    aggs += [F.min("min_latency").alias("min_latency"), F.max("max_latency").alias("max_latency")]
    if "latency_sketch" in states.columns:
        aggs.append(F.kll_merge_agg_double("latency_sketch", F.lit(SKETCH_K)).alias("latency_sketch"))
    return states.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*aggs)


def coarser(states: DataFrame, width: str, within: tuple[str, ...] = ()) -> DataFrame:
    return merged(states, {**{c: F.col(c) for c in within}, "bucket": bucket("bucket", width), "node_id": F.col("node_id")})


def by_region(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node states of known nodes added up per (bucket, region)."""
    dim = nodes.select("node_id", region_slug(F.col("country"), F.col("region")).alias("region"))
    return merged(states.drop("latency_sketch").join(dim, "node_id"), {"bucket": F.col("bucket"), "region": F.col("region")})


def _mean(alias: str, scale: int) -> Column:
    return F.col(f"{alias}_sum") / (F.col(f"{alias}_n") * F.lit(10**scale))


def deviation(total: Column, squares: Column, n: Column, scale: int) -> Column:
    """Sample standard deviation from whole sums; null below two values."""
    wide = n.cast("decimal(19,0)")
    spread = (wide * squares - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("double")
    return F.when(n > 1, F.sqrt(spread / (n * (n - 1)).cast("double")) / F.lit(float(10**scale)))


def finished(states: DataFrame, scale: int = 2) -> DataFrame:
    """Node states as rollup rows: means, extremes, sample count and, if kept, the sketch."""
    more = ["latency_sketch"] if "latency_sketch" in states.columns else []
    return states.select("bucket", "node_id", _mean("lat", scale).alias("avg_latency"), "min_latency", "max_latency",
                         _mean("up", scale).alias("avg_uptime"), _mean("loss", scale).alias("avg_loss"), "samples", *more)


def finished_region(states: DataFrame, scale: int = 2) -> DataFrame:
    return states.select(
        "bucket", "region", _mean("lat", scale).alias("avg_latency"),
        deviation(F.col("lat_sum"), F.col("lat_sq"), F.col("lat_n"), scale).alias("std_latency"),
        _mean("loss", scale).alias("avg_loss"), _mean("up", scale).alias("avg_uptime"), "samples")
