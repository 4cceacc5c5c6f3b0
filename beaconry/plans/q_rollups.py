"""Queries over rollups (F1-F6, F11, K3, K4, K11) with their oracle SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from beaconry.operators import rollups as R
from beaconry.plans import stored
from beaconry.plans.registry import query
from beaconry.plans.views import mean, sql
from beaconry.sources import adapters as A

NOW = "2024-01-01 01:00:00"


def node_rollup_sql(view: str, width: str, where: str = "true") -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', time) AS bucket, node_id, {mean('lat_c')} AS avg_latency,
      min(latency_ms) AS min_latency, max(latency_ms) AS max_latency, {mean('up_c')} AS avg_uptime,
      {mean('loss_c')} AS avg_loss, count(*) AS samples FROM {view} WHERE {where} GROUP BY 1, 2"""


def deviation(c: str) -> str:
    """Sample deviation of hundredths from whole sums, one division and one root."""
    spread = f"count({c})::HUGEINT * sum({c}::HUGEINT * {c}) - sum({c})::HUGEINT * sum({c})"
    return f"CASE WHEN count({c}) > 1 THEN sqrt(({spread})::DOUBLE / (count({c}) * (count({c}) - 1))::DOUBLE) / 100.0::DOUBLE END"


REGION_ROLLUP = f"""SELECT time_bucket(INTERVAL '5 minutes', time) AS bucket, slug AS region, {mean('lat_c')} AS avg_latency,
      {deviation('lat_c')} AS std_latency, {mean('loss_c')} AS avg_loss,
      {mean('up_c')} AS avg_uptime, count(*) AS samples FROM metrics JOIN nodes USING (node_id) GROUP BY 1, 2"""


@query("F1", sql("metrics", node_rollup_sql("metrics", "1 minute")))
def rollup_1m(spark, sf):
    return R.rollup_1m(A.metrics(spark, sf))


@query("F2", sql("metrics", f"""SELECT * FROM ({node_rollup_sql("metrics", "5 minutes")}) JOIN (
    SELECT time_bucket(INTERVAL '5 minutes', time) AS bucket, node_id, count(latency_ms) AS sketch_samples,
      min(latency_ms)::DOUBLE AS sketch_low, max(latency_ms)::DOUBLE AS sketch_high FROM metrics GROUP BY 1, 2) USING (bucket, node_id)"""))
def rollup_5m_node(spark, sf):
    """With what the sketch keeps exactly: its number of values, the least and the greatest."""
    out = R.rollup_5m_node(A.metrics(spark, sf))
    return out.withColumns({
        "sketch_samples": F.kll_sketch_get_n_double("latency_sketch"),
        "sketch_low": F.kll_sketch_get_quantile_double("latency_sketch", F.lit(0.0)),
        "sketch_high": F.kll_sketch_get_quantile_double("latency_sketch", F.lit(1.0))}).drop("latency_sketch")


@query("F3", sql("metrics nodes", REGION_ROLLUP))
def rollup_5m_region(spark, sf):
    return R.rollup_5m_region(A.metrics(spark, sf), A.nodes(spark, sf))


@query("F4", sql("native", node_rollup_sql("native", "1 hour")))
def rollup_hourly(spark, sf):
    return R.rollup_hourly(A.metrics(spark, sf, "native"))


@query("F5", sql("native", node_rollup_sql("native", "1 day")))
def rollup_daily(spark, sf):
    return R.rollup_daily(A.metrics(spark, sf, "native"))


def _q(p: float) -> str:
    return f"round(quantile_cont(CAST(latency_ms AS DOUBLE), {p}), 6)"


@query("F6", sql("metrics", f"""SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, node_id, {mean('lat_c')} AS avg_latency,
    min(latency_ms) AS min_latency, max(latency_ms) AS max_latency, {_q(0.5)} AS p50_latency, {_q(0.95)} AS p95_latency,
    {_q(0.99)} AS p99_latency, {mean('up_c')} AS avg_uptime, min(uptime_pct) AS min_uptime, {mean('loss_c')} AS avg_loss,
    max(packet_loss) AS max_loss, count(*) AS samples FROM metrics GROUP BY 1, 2"""))
def hourly_percentiles(spark, sf):
    out = R.hourly_percentiles(A.metrics(spark, sf))
    for c in ("p50_latency", "p95_latency", "p99_latency"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("samples", F.col("samples").cast("long"))


@query("F6", sql("native", f"""SELECT time_bucket(INTERVAL '1 day', time) AS bucket, node_id, {mean('lat_c')} AS avg_latency,
    {mean('up_c')} AS avg_uptime, {mean('loss_c')} AS avg_loss, count(*) AS samples,
    count(*) FILTER (WHERE uptime_pct > 95) AS high_availability_count,
    CAST(count(*) FILTER (WHERE uptime_pct > 95) * 100 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS availability_pct
    FROM native GROUP BY 1, 2"""))
def daily_availability(spark, sf):
    return R.daily_availability(A.metrics(spark, sf, "native"))


@query("F11 F2", sql("metrics", """SELECT node_id, quantile_disc(CAST(latency_ms AS DOUBLE), 0.95) AS latency_quantile, count(*) AS samples
    FROM metrics GROUP BY node_id"""))
def merged_sketch_p95(spark, sf):
    """Percentile from the merged sketches of all five-minute buckets of a node, exact for the few samples a node has here."""
    return R.merge_percentile(stored.tier_states(spark, sf, "5m_node"), 0.95, "node_id")


@query("K3 F2", sql("metrics", f"""SELECT * FROM ({node_rollup_sql('metrics', '5 minutes')}) WHERE {{inside}}
    UNION ALL SELECT * FROM ({node_rollup_sql('metrics', '5 minutes', 'arrival % 4 <> 1')}) WHERE NOT ({{inside}})""".format(
        inside="bucket >= TIMESTAMP '2024-01-01 00:45:00' AND bucket < TIMESTAMP '2024-01-01 00:55:00'")))
def refresh_rollup_5m(spark, sf):
    """A quarter of the samples arrives after the tier was made; the refresh of [now-15m, now-5m) repairs the buckets inside it alone."""
    store = stored.new_store(spark, sf)
    rows = A.metrics(spark, sf).select(*stored.COLUMNS)
    late = F.col("arrival") % 4 == 1
    store.add(rows.where(~late))
    store.refresh(("5m_node",))
    store.add(rows.where(late))
    store.refresh_window(("5m_node",), datetime.fromisoformat(NOW), 900, 300)
    return store.tier("5m_node").drop("latency_sketch")


def _stored(name, oracle, views="metrics", calendar="dense", ops=""):
    def run(spark, sf):
        return stored.tier(spark, sf, name, calendar).drop("latency_sketch")

    run.__name__ = f"stored_{name}"
    query(f"K3 {ops}", sql(views, oracle))(run)


_stored("1m", node_rollup_sql("metrics", "1 minute"), ops="F1")
_stored("5m_node", node_rollup_sql("metrics", "5 minutes"), ops="F2")
_stored("5m_region", REGION_ROLLUP, "metrics nodes", ops="F3")
_stored("hourly", node_rollup_sql("native", "1 hour"), "native", "native", ops="F4")
_stored("daily", node_rollup_sql("native", "1 day"), "native", "native", ops="F5")


@query("K4", sql("metrics", node_rollup_sql("metrics", "1 minute")))
def realtime_view_1m(spark, sf):
    raw = A.metrics(spark, sf)
    mat = stored.tier(spark, sf, "1m", end="2024-01-01 00:50:00")
    return R.realtime_view(mat, raw, "1 minute", "2024-01-01 00:50:00")


@query("K11", sql("metrics nodes", """SELECT view_name, latest, lag_s, coalesce(lag_s < lim, false) AS healthy FROM (
    SELECT view_name, latest, (epoch_us(TIMESTAMP '2024-01-01 01:02:00') - epoch_us(latest)) // 1000000 AS lag_s, lim FROM (
      SELECT '1m' AS view_name, max(time_bucket(INTERVAL '1 minute', time)) AS latest, 120 AS lim FROM metrics
      UNION ALL SELECT '5m_region', max(time_bucket(INTERVAL '5 minutes', time)), 600 FROM metrics JOIN nodes USING (node_id)
      UNION ALL SELECT 'hourly', max(time_bucket(INTERVAL '1 hour', time)), 7200 FROM metrics))"""))
def rollup_health(spark, sf):
    views = {name: stored.tier(spark, sf, name) for name in ("1m", "5m_region", "hourly")}
    return R.rollup_health(views, "2024-01-01 01:02:00")
