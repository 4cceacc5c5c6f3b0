"""Fleet queries: per node or region statistics, cluster summary, problem nodes, lists and panels.

Raw samples are reduced to one state row per node before the node table is joined. No join carries a
broadcast hint: Spark compares the size of the node table with its own limit, statically or at run time.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconry.functions import exact, scalar
from beaconry.functions.timeutil import Instant, between, bucket, instant, since

SLUG = scalar.region_slug


def node_states(df: DataFrame) -> DataFrame:
    """One mergeable state row per node: unit sums and counts of the three measures."""
    return df.groupBy("node_id").agg(
        *exact.partial(df, "latency_ms", "lat"), *exact.partial(df, "uptime_pct", "up"),
        *exact.partial(df, "packet_loss", "loss"), F.count(F.lit(1)).alias("n"))


def _by_key(df: DataFrame, hist: DataFrame, keys: list[str]) -> DataFrame:
    scale = 10 ** (exact.scale_of(df, "latency_ms") or 0)
    known = F.when(F.col("latency_ms").isNotNull(), F.col("freq"))
    return hist.groupBy(*keys).agg(
        (F.sum(exact.units(df, "latency_ms") * F.col("freq")) / (F.sum(known) * scale)).alias("avg_latency"),
        F.min("latency_ms").cast("double").alias("min_latency"),
        F.max("latency_ms").cast("double").alias("max_latency"),
        F.percentile(F.col("latency_ms").cast("double"), 0.95, F.col("freq")).alias("p95_latency"),
        exact.merged_mean(df, "packet_loss", "loss").alias("avg_packet_loss"),
        F.sum("freq").alias("reporting_count"),
        F.sum("down").alias("downtime_intervals"),
    )


def _histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("node_id", "latency_ms").agg(
        F.count(F.lit(1)).alias("freq"), *exact.partial(df, "packet_loss", "loss"),
        F.count_if(F.col("uptime_pct") < 100).alias("down"))


def _present(df: DataFrame, key: Column) -> DataFrame:
    zero = F.lit(0.0)
    return df.select(
        F.coalesce(key, F.lit("Unknown")).alias("dimension"),
        *[F.coalesce(F.col(c).cast("double"), zero).alias(c)
          for c in ("avg_latency", "min_latency", "max_latency", "p95_latency", "avg_packet_loss")],
        F.coalesce("reporting_count", F.lit(0)).cast("long").alias("reporting_count"),
        F.coalesce("downtime_intervals", F.lit(0)).cast("long").alias("downtime_intervals"),
        scalar.availability_pct(F.col("reporting_count"), F.col("downtime_intervals")).alias("availability_pct"),
    )


def fleet_by_node(metrics: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Exact per-node statistics from raw samples, p95 interpolated."""
    df = between(metrics, "time", start, end)
    return _present(_by_key(df, _histogram(df), ["node_id"]), F.col("node_id"))


def fleet_by_region(metrics: DataFrame, nodes: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """As :func:`fleet_by_node` per ``region/country``; samples of unknown nodes form one group."""
    df = between(metrics, "time", start, end)
    dim = nodes.select("node_id", "country", "region")
    hist = _histogram(df).join(dim, "node_id", "left")
    key = scalar.region_label(F.col("country"), F.col("region"))
    return _present(_by_key(df, hist, ["country", "region"]), key)


def _from_rollup(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    avg = F.avg("avg_latency")
    down = F.when(F.col("avg_uptime") < 100, F.col("samples")).otherwise(0)
    out = df.groupBy(key).agg(
        avg.alias("avg_latency"), F.min(low).alias("min_latency"), F.max(high).alias("max_latency"),
        (avg * 1.5).alias("p95_latency"), F.avg("avg_loss").alias("avg_packet_loss"),
        F.sum("samples").alias("reporting_count"), F.sum(down).alias("downtime_intervals"))
    return _present(out, F.col(key)).withColumnRenamed("p95_latency", "p95_estimate")


def fleet_from_node_rollup(rollups: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Per-node statistics from any node rollup: mean of bucket means, p95 estimated as 1.5 times it."""
    return _from_rollup(between(rollups, "bucket", start, end), "node_id", "min_latency", "max_latency")


def fleet_from_region_rollup(rollups: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Per-region statistics from the region rollup; extremes are those of the bucket means."""
    return _from_rollup(between(rollups, "bucket", start, end), "region", "avg_latency", "avg_latency")


def check_cluster_window(start: str | datetime, end: str | datetime) -> None:
    lo, hi = (datetime.fromisoformat(str(t)) for t in (start, end))
    if hi - lo > timedelta(days=7):
        raise ValueError("WINDOW_TOO_LARGE: cluster queries span at most 7 days")


def cluster_summary(metrics: DataFrame, start: str | datetime, end: str | datetime) -> DataFrame:
    """One row: distinct nodes and fleet means rounded to 2, 2 and 3 digits; at most seven days."""
    check_cluster_window(start, end)
    df = between(metrics, "time", start, end)
    per_node = node_states(df)

    def rounded(name: str, alias: str, digits: int) -> Column:
        value = exact.rounded_ratio(exact.scale_of(df, name), F.sum(f"{alias}_sum"), F.sum(f"{alias}_n"), digits)
        return F.coalesce(value, F.lit(0.0))

    return per_node.agg(
        F.count("node_id").alias("total_nodes"),
        rounded("latency_ms", "lat", 2).alias("avg_latency_ms"),
        rounded("uptime_pct", "up", 2).alias("avg_uptime_pct"),
        rounded("packet_loss", "loss", 3).alias("avg_loss_pct"))


def cluster_summary_from_rollup(rollups: DataFrame, start: str | datetime, end: str | datetime) -> DataFrame:
    check_cluster_window(start, end)
    df = between(rollups, "bucket", start, end)

    def rounded(name: str, digits: int) -> Column:
        return F.coalesce(F.round(F.avg(name), digits), F.lit(0.0))

    return df.agg(
        F.count_distinct("node_id").alias("total_nodes"), rounded("avg_latency", 2).alias("avg_latency_ms"),
        rounded("avg_uptime", 2).alias("avg_uptime_pct"), rounded("avg_loss", 3).alias("avg_loss_pct"))


def regional_breakdown(metrics: DataFrame, nodes: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Distinct reporting nodes, mean latency and uptime (2 digits) per region slug; known nodes only."""
    df = between(metrics, "time", start, end)
    dim = nodes.select("node_id", "country", "region")
    lat, up = exact.scale_of(df, "latency_ms"), exact.scale_of(df, "uptime_pct")
    return (
        node_states(df).join(dim, "node_id").groupBy("country", "region").agg(
            F.count("node_id").alias("nodes"),
            exact.rounded_ratio(lat, F.sum("lat_sum"), F.sum("lat_n"), 2).alias("avg_latency"),
            exact.rounded_ratio(up, F.sum("up_sum"), F.sum("up_n"), 2).alias("avg_uptime"))
        .select(SLUG(F.col("country"), F.col("region")).alias("region"), "nodes", "avg_latency", "avg_uptime"))


def regional_breakdown_from_rollup(rollups: DataFrame, nodes: DataFrame, start: Instant, end: Instant) -> DataFrame:
    df = between(rollups, "bucket", start, end)
    per_node = df.groupBy("node_id").agg(
        F.sum("avg_latency").alias("lat"), F.sum("avg_uptime").alias("up"), F.count(F.lit(1)).alias("n"))
    return (
        per_node.join(nodes.select("node_id", "country", "region"), "node_id").groupBy("country", "region").agg(
            F.count("node_id").alias("nodes"),
            F.round(F.sum("lat") / F.sum("n"), 2).alias("avg_latency"),
            F.round(F.sum("up") / F.sum("n"), 2).alias("avg_uptime"))
        .select(SLUG(F.col("country"), F.col("region")).alias("region"), "nodes", "avg_latency", "avg_uptime"))


def _state_mean(df: DataFrame, name: str, alias: str) -> Column:
    return F.col(f"{alias}_sum") / (F.col(f"{alias}_n") * F.lit(10 ** (exact.scale_of(df, name) or 0)))


def _scored(df: DataFrame, nodes: DataFrame) -> DataFrame:
    means = node_states(df).select(
        "node_id", _state_mean(df, "latency_ms", "lat").alias("lat"),
        _state_mean(df, "packet_loss", "loss").alias("loss"), _state_mean(df, "uptime_pct", "up").alias("up"))
    return (
        means.join(nodes.select("node_id", "country", "region"), "node_id")
        .withColumn("raw_score", scalar.problem_score(F.col("lat"), F.col("loss"), F.col("up"))))


def top_problem_nodes(metrics: DataFrame, nodes: DataFrame, start: Instant, end: Instant, n: int = 5) -> DataFrame:
    """The n (1 to 20) known nodes with the greatest problem score; ties go to the smaller node_id."""
    if not 1 <= n <= 20:
        raise ValueError("top n must be between 1 and 20")
    scored = _scored(between(metrics, "time", start, end), nodes)
    return scored.orderBy(F.desc("raw_score"), "node_id").limit(n).select(
        "node_id", SLUG(F.col("country"), F.col("region")).alias("region"),
        F.round("raw_score", 2).alias("score"), F.round("lat", 2).alias("avg_latency"),
        F.round("loss", 3).alias("avg_loss"))


def top_problem_nodes_from_rollup(rollups: DataFrame, nodes: DataFrame, start: Instant, end: Instant,
                                  n: int = 5) -> DataFrame:
    if not 1 <= n <= 20:
        raise ValueError("top n must be between 1 and 20")
    df = between(rollups, "bucket", start, end)
    means = df.groupBy("node_id").agg(
        F.avg("avg_latency").alias("lat"), F.avg("avg_loss").alias("loss"), F.avg("avg_uptime").alias("up"))
    return (
        means.join(nodes.select("node_id", "country", "region"), "node_id")
        .withColumn("raw_score", scalar.problem_score(F.col("lat"), F.col("loss"), F.col("up")))
        .orderBy(F.desc("raw_score"), "node_id").limit(n)
        .select("node_id", SLUG(F.col("country"), F.col("region")).alias("region"),
                F.round("raw_score", 2).alias("score"), F.round("lat", 2).alias("avg_latency"),
                F.round("loss", 3).alias("avg_loss")))


def kpi_stats(metrics: DataFrame) -> DataFrame:
    """Dashboard headline: means with nulls as zero, rounded to 0, 1 and 2 digits, and distinct nodes."""
    df = metrics
    for c in ("latency_ms", "uptime_pct", "packet_loss"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(metrics.schema[c].dataType)))
    per_node = node_states(df)

    def rounded(name: str, alias: str, digits: int) -> Column:
        value = exact.rounded_ratio(exact.scale_of(df, name), F.sum(f"{alias}_sum"), F.sum(f"{alias}_n"), digits)
        return F.coalesce(value, F.lit(0.0))

    return per_node.agg(
        rounded("latency_ms", "lat", 0).alias("avg_latency"), rounded("uptime_pct", "up", 1).alias("avg_uptime"),
        rounded("packet_loss", "loss", 2).alias("avg_loss"), F.count("node_id").alias("node_count"))


def list_metrics(metrics: DataFrame, nodes: DataFrame, *, node_id: str | None = None, start: Instant | None = None,
                 end: Instant | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of samples, newest first (ties by node_id, then arrival), with the node's country and region.

    The page is cut before the join, so at most ``limit`` (1 to 1000) rows look up their node.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    df = between(metrics, "time", start, end)
    if node_id is not None:
        df = df.where(F.col("node_id") == node_id)
    order = [F.desc("time"), F.asc("node_id")] + ([F.asc("arrival")] if "arrival" in df.columns else [])
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.join(nodes.select("node_id", "country", "region"), "node_id", "left").select(
        "node_id", F.coalesce("country", F.lit("XX")).alias("country"),
        F.coalesce("region", F.lit("Unknown")).alias("region"),
        "latency_ms", "uptime_pct", "packet_loss", "time").orderBy(*order[:2])


def list_nodes(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Nodes that are not deleted, with the time of their last sample; missing coordinates become 0."""
    seen = metrics.groupBy("node_id").agg(F.max("time").alias("last_seen"))
    return (
        nodes.where(F.col("status") != "deleted").join(seen, "node_id", "left")
        .select("node_id", "status", "country", "region",
                F.coalesce(F.col("lat").cast("double"), F.lit(0.0)).alias("lat"),
                F.coalesce(F.col("lng").cast("double"), F.lit(0.0)).alias("lng"), "last_seen")
        .orderBy("country", "region", "node_id"))


def recent_rollups_by_region(rollups: DataFrame, nodes: DataFrame, now: Instant, span: str = "7 days") -> DataFrame:
    df = since(rollups, "bucket", now, span)
    return df.join(nodes.select("node_id", "region"), "node_id").select(
        "bucket", "region", "avg_latency", "avg_uptime")


def node_average(metrics: DataFrame, nodes: DataFrame, now: Instant, span: str = "24 hours") -> DataFrame:
    df = since(metrics, "time", now, span)
    return (
        node_states(df).join(nodes.select("node_id", "node_name", "region"), "node_id")
        .groupBy("node_name", "region").agg(
            exact.merged_mean(df, "latency_ms", "lat").alias("avg_latency"),
            exact.merged_mean(df, "uptime_pct", "up").alias("avg_uptime")))


def unseen_nodes(metrics: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node ids that report but are not in the node table."""
    return metrics.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_anti")


def federation_live(heartbeats: DataFrame, now: Instant, ttl_s: int = 60) -> DataFrame:
    """Latest target per probe among heartbeats not older than the TTL."""
    at = instant(heartbeats, "timestamp", now)
    live = heartbeats.where(
        (F.col("timestamp") <= at) & (F.col("timestamp") > at - F.make_dt_interval(secs=F.lit(ttl_s))))
    last = F.struct("timestamp", "arrival") if "arrival" in heartbeats.columns else F.col("timestamp")
    return live.groupBy("node_id").agg(
        F.max_by("active_target", last).alias("active_target"), F.max("timestamp").alias("last_seen"))


def federation_targets(live: DataFrame) -> DataFrame:
    return live.groupBy(F.coalesce("active_target", F.lit("unknown")).alias("active_target")).agg(
        F.count(F.lit(1)).alias("probes"))


def federation_status(heartbeats: DataFrame, now: Instant, ttl_s: int = 60) -> DataFrame:
    """One row: live probes, how many use a primary target, and the overall status."""
    primary = F.count_if(F.col("active_target").isin("central", "legacy-env"))
    out = federation_live(heartbeats, now, ttl_s).agg(
        F.count(F.lit(1)).alias("total_probes"), primary.alias("primary_probes"))
    return out.withColumn(
        "status",
        F.when(F.col("total_probes") == 0, "unknown")
        .when(F.col("primary_probes") == F.col("total_probes"), "primary")
        .when(F.col("primary_probes") == 0, "failover").otherwise("degraded"))


def nearest_rank_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, min, max, mean, p95 and p99 with the rank rule sorted[int(n * p)].

    Ranks are read from a histogram of distinct values, never from a collected list.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))
    part = Window.partitionBy(*keys)
    ranked = hist.select(
        *keys, value, "freq", F.sum("freq").over(part.orderBy(value)).alias("cum"), F.sum("freq").over(part).alias("n"))

    def at(p: float) -> Column:
        rank = F.floor(F.col("n") * F.lit(p))
        return F.min(F.when(F.col("cum") > rank, F.col(value)))

    return ranked.groupBy(*keys).agg(
        F.sum("freq").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(exact.units(df, value) * F.col("freq"))
         / (F.sum("freq") * F.lit(10 ** (exact.scale_of(df, value) or 0)))).alias("avg"),
        at(0.95).alias("p95"), at(0.99).alias("p99"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.coalesce(exact.total(df, "latency_ms"), F.lit(0.0)).alias("latency_checksum"))


def compare_fingerprints(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Whether two fingerprints (one row each) agree: equal counts and sums within the tolerance."""
    left = a.select(F.lit("a").alias("side"), "row_count", "latency_checksum")
    both = left.unionByName(b.select(F.lit("b").alias("side"), "row_count", "latency_checksum"))
    rows, total = F.max("row_count") - F.min("row_count"), F.max("latency_checksum") - F.min("latency_checksum")
    return both.agg((rows == 0).alias("count_match"), (total <= tolerance).alias("checksum_match"))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of one ingest batch; input has ``node_id`` and ``outcome`` in processed, failed, duplicate."""
    per_node = outcomes.groupBy("node_id").agg(
        F.count_if(F.col("outcome") == "processed").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("bad"),
        F.count_if(F.col("outcome") == "duplicate").alias("dup"))
    ok, bad = F.coalesce(F.sum("ok"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))
    return per_node.agg(
        ok.alias("rows_processed"), bad.alias("rows_failed"),
        F.coalesce(F.sum("dup"), F.lit(0)).alias("duplicate_count"),
        F.count_if(F.col("ok") > 0).alias("active_probes"),
        F.when(ok + bad > 0, F.round(bad / (ok + bad), 4)).otherwise(0.0).alias("error_rate"))


# --- dashboard panels -------------------------------------------------------------------------------------------


def panel_series(metrics: DataFrame, value: str, interval: str, start: Instant | None = None,
                 end: Instant | None = None, nodes: list[str] | None = None) -> DataFrame:
    """Node averages of one measure per interval, as the latency and loss panels show them."""
    df = between(metrics, "time", start, end)
    if nodes is not None:
        df = df.where(F.col("node_id").isin(nodes))
    return df.groupBy(bucket("time", interval).alias("time"), "node_id").agg(exact.mean(df, value).alias(value))


def active_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(F.col("status") == "reporting").alias("active_nodes"))


def active_nodes_by_last_seen(metrics: DataFrame, now: Instant, span: str = "5 minutes") -> DataFrame:
    return since(metrics, "time", now, span).select("node_id").distinct().agg(
        F.count(F.lit(1)).alias("active_nodes"))


def incident_loss(metrics: DataFrame, now: Instant, span: str = "10 minutes") -> DataFrame:
    """Greatest node average of loss, over rows losing more than one percent."""
    df = since(metrics, "time", now, span).where(F.col("packet_loss") > 1.0)
    return df.groupBy("node_id").agg(exact.mean(df, "packet_loss").alias("avg_loss")).agg(
        F.max("avg_loss").alias("max_avg_loss"))


def panel_region_latency(metrics: DataFrame, nodes: DataFrame, width: str = "5 minutes", start: Instant | None = None,
                         end: Instant | None = None, region: str = "All", ceiling: float | None = None) -> DataFrame:
    """Region averages per bucket, optionally of one region and capped; range bounds are open."""
    df = metrics
    if start is not None:
        df = df.where(F.col("time") > instant(df, "time", start))
    if end is not None:
        df = df.where(F.col("time") < instant(df, "time", end))
    dim = nodes.select("node_id", SLUG(F.col("country"), F.col("region")).alias("slug"),
                       scalar.region_slug_display(F.col("country"), F.col("region")).alias("region"))
    if region != "All":
        dim = dim.where(F.col("slug") == region)
    per_node = df.groupBy(bucket("time", width).alias("time"), "node_id").agg(*exact.partial(df, "latency_ms", "lat"))
    mean = exact.merged_mean(df, "latency_ms", "lat")
    if ceiling is not None:
        mean = F.least(mean, F.lit(float(ceiling)))
    return per_node.join(dim, "node_id").groupBy("time", "region").agg(mean.alias("latency"))


def panel_region_heatmap(metrics: DataFrame, nodes: DataFrame, start: Instant | None = None,
                         region: str = "All") -> DataFrame:
    return panel_region_latency(metrics, nodes, "15 minutes", start, None, region, ceiling=300)


def panel_problem_nodes(metrics: DataFrame, nodes: DataFrame, now: Instant, span: str = "1 hour", region: str = "All",
                        n: int = 5) -> DataFrame:
    dim = nodes
    if region != "All":
        dim = nodes.where(SLUG(F.col("country"), F.col("region")) == region)
    scored = _scored(since(metrics, "time", now, span), dim)
    return scored.orderBy(F.desc(F.round("raw_score", 2)), "node_id").limit(n).select(
        "node_id", scalar.region_slug_display(F.col("country"), F.col("region")).alias("region"),
        F.round("lat", 1).alias("avg_latency"), F.round("loss", 2).alias("avg_loss"),
        F.round("raw_score", 2).alias("score"))


def panel_region_bar(region_rollup: DataFrame, start: Instant, region: str = "All") -> DataFrame:
    df = region_rollup.where(F.col("bucket") > instant(region_rollup, "bucket", start))
    if region != "All":
        df = df.where(F.col("region") == region)
    return df.groupBy("region").agg(F.round(F.avg("avg_latency"), 1).alias("latency")).orderBy(F.desc("latency"), "region")


def panel_uptime_trend(region_rollup: DataFrame, start: Instant, region: str = "All") -> DataFrame:
    df = region_rollup.where(F.col("bucket") > instant(region_rollup, "bucket", start))
    if region != "All":
        df = df.where(F.col("region") == region)
    return df.select(F.col("bucket").alias("time"), "region", F.col("avg_uptime").alias("uptime"))


def region_options(nodes: DataFrame) -> DataFrame:
    live = nodes.where(F.col("status") != "deleted")
    every = nodes.sparkSession.range(1).select(F.lit("All").alias("region"))
    return every.unionByName(live.select(SLUG(F.col("country"), F.col("region")).alias("region"))).distinct()


def node_options(nodes: DataFrame, region: str = "All") -> DataFrame:
    live = nodes.where(F.col("status") != "deleted")
    if region != "All":
        live = live.where(SLUG(F.col("country"), F.col("region")) == region)
    return live.select("node_id").distinct()
