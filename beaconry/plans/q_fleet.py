"""Fleet queries, lists and panels (E1-E6, F7-F25, I1, I4, K10) with their oracle SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from beaconry.operators import fleet as Q
from beaconry.plans import stored
from beaconry.plans.q_rollups import NOW, REGION_ROLLUP, node_rollup_sql
from beaconry.plans.registry import query
from beaconry.plans.tiers import fleet_percentiles, query_fleet
from beaconry.plans.views import mean, sql
from beaconry.sources import adapters as A
from beaconry.sources.pages import metrics_page
from beaconry.sources.rollup_store import TIERS

START, END = "2024-01-01 00:00:00", "2024-01-01 01:00:00"
_RANGE = f"time >= TIMESTAMP '{START}' AND time <= TIMESTAMP '{END}'"
_AVAIL = "CASE WHEN count(*) > 0 THEN 100.0 * (1.0 - CAST({d} AS DOUBLE) / CAST({n} AS DOUBLE)) ELSE 0.0 END"


def rounded(df, digits=6, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def _fleet_sql(key: str, source: str, group: str) -> str:
    down = "count(*) FILTER (WHERE uptime_pct < 100)"
    return f"""SELECT coalesce({key}, 'Unknown') AS dimension, {mean('lat_c')} AS avg_latency,
      CAST(min(latency_ms) AS DOUBLE) AS min_latency, CAST(max(latency_ms) AS DOUBLE) AS max_latency,
      round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 6) AS p95_latency, {mean('loss_c')} AS avg_packet_loss,
      count(*) AS reporting_count, {down} AS downtime_intervals,
      CAST({_AVAIL.format(d=down, n='count(*)')} AS DOUBLE) AS availability_pct
      FROM {source} WHERE {_RANGE} GROUP BY {group}"""


FLEET_NODE = _fleet_sql("node_id", "metrics", "node_id")
FLEET_REGION = _fleet_sql("region || '/' || country", "metrics LEFT JOIN nodes USING (node_id)", "region, country")


def _rollup_fleet_sql(key: str, low: str, high: str, source: str) -> str:
    down = "CAST(sum(CASE WHEN avg_uptime < 100 THEN samples ELSE 0 END) AS BIGINT)"
    return f"""SELECT coalesce({key}, 'Unknown') AS dimension, round(avg(avg_latency), 9) AS avg_latency,
      CAST(min({low}) AS DOUBLE) AS min_latency, CAST(max({high}) AS DOUBLE) AS max_latency,
      round(avg(avg_latency) * 1.5 + 1e-11, 9) AS p95_estimate, round(avg(avg_loss), 9) AS avg_packet_loss,
      CAST(sum(samples) AS BIGINT) AS reporting_count, {down} AS downtime_intervals,
      CAST({_AVAIL.format(d=down, n='sum(samples)')} AS DOUBLE) AS availability_pct
      FROM {source} GROUP BY 1"""


_HOURLY = f"hourly AS ({node_rollup_sql('native', '1 hour')})"
_FIVE = f"five AS ({node_rollup_sql('metrics', '5 minutes')})"
_DAILY = f"daily AS ({node_rollup_sql('native', '1 day')})"
_REGION5 = f"region5 AS ({REGION_ROLLUP})"


@query("F7", sql("metrics", FLEET_NODE))
def fleet_by_node(spark, sf):
    return rounded(Q.fleet_by_node(A.metrics(spark, sf), START, END), 6, "p95_latency")


@query("F8", sql("metrics nodes", FLEET_REGION))
def fleet_by_region(spark, sf):
    return rounded(Q.fleet_by_region(A.metrics(spark, sf), A.nodes(spark, sf), START, END), 6, "p95_latency")


def _round_estimates(df):
    # sums of doubles differ in their last bits between engines; the tiny shift settles rounding ties
    return rounded(df.withColumn("p95_estimate", F.col("p95_estimate") + 1e-11),
                   9, "avg_latency", "p95_estimate", "avg_packet_loss")


@query("F9", sql("native", _rollup_fleet_sql("node_id", "min_latency", "max_latency", "hourly"), _HOURLY))
def fleet_from_hourly(spark, sf):
    tier = stored.tier(spark, sf, "hourly", "native", "2024-01-01", "2024-02-01")
    return _round_estimates(Q.fleet_from_node_rollup(tier, "2024-01-01", "2024-02-01"))


@query("F9", sql("native", _rollup_fleet_sql("node_id", "min_latency", "max_latency", "daily"), _DAILY))
def fleet_from_daily(spark, sf):
    tier = stored.tier(spark, sf, "daily", "native", "2024-01-01", "2024-02-01")
    return _round_estimates(Q.fleet_from_node_rollup(tier, "2024-01-01", "2024-02-01"))


@query("F10", sql("metrics nodes", _rollup_fleet_sql("region", "avg_latency", "avg_latency", "region5"), _REGION5))
def fleet_from_region_rollup(spark, sf):
    tier = stored.tier(spark, sf, "5m_region", "dense", START, END)
    return _round_estimates(Q.fleet_from_region_rollup(tier, START, END))


def _tiers(spark, sf, calendar):
    return {name: partial(stored.tier, spark, sf, name, calendar) for name in TIERS}


@query("K10", sql("metrics", _rollup_fleet_sql("node_id", "min_latency", "max_latency", "five"), _FIVE))
def fleet_tier_one_hour(spark, sf):
    """One hour per node picks the five-minute tier."""
    out = query_fleet(A.metrics(spark, sf), A.nodes(spark, sf), _tiers(spark, sf, "dense"), "node", START, END)
    return _round_estimates(out)


@query("K10", sql("native nodes", _rollup_fleet_sql(
    "region || '/' || country", "min_latency", "max_latency", "daily LEFT JOIN nodes USING (node_id)"), _DAILY))
def fleet_tier_month_by_region(spark, sf):
    """A month by region picks the daily tier and reaches regions through the node table."""
    out = query_fleet(A.metrics(spark, sf, "native"), A.nodes(spark, sf), _tiers(spark, sf, "native"), "region",
                      "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    return _round_estimates(out)


def _quantile_sql(key: str, source: str) -> str:
    return f"""SELECT coalesce({key}, 'Unknown') AS dimension, {mean('lat_c')} AS avg_latency, min(latency_ms) AS min_latency,
    max(latency_ms) AS max_latency, quantile_disc(CAST(latency_ms AS DOUBLE), 0.95) AS latency_quantile, count(*) AS reporting_count
    FROM {source} GROUP BY 1"""


@query("K10 F11", sql("native", _quantile_sql("node_id", "native")))
def fleet_p95_from_daily_sketches(spark, sf):
    """A month per node: the 95th percentile from sketches of the daily tier, made of hours made of five minutes."""
    return fleet_percentiles(lambda name, start, end: stored.tier_states(spark, sf, name, "native", start, end), A.nodes(spark, sf),
                             "node", "2024-01-01 00:00:00", "2024-02-01 00:00:00")


@query("K10 F11", sql("native", f"{_quantile_sql('node_id', 'native')}".replace(
    "FROM native", "FROM native WHERE time >= TIMESTAMP '2024-01-10 00:00:00' AND time < TIMESTAMP '2024-01-11 01:00:00'")))
def fleet_p95_from_hourly_sketches(spark, sf):
    """A day and an hour per node from the hourly tier."""
    return fleet_percentiles(lambda name, start, end: stored.tier_states(spark, sf, name, "native", start, end), A.nodes(spark, sf),
                             "node", "2024-01-10 00:00:00", "2024-01-11 00:00:00")


def half_up(total: str, n: str, digits: int, scale: int = 2) -> str:
    up, down = 10 ** max(digits - scale, 0), 10 ** max(scale - digits, 0)
    return (f"CAST(((sum({total}) * {2 * up} + {n} * {down}) // ({n} * {2 * down})) AS DOUBLE) "
            f"/ CAST({10 ** digits} AS DOUBLE)")


@query("F12", sql("metrics", f"""SELECT count(DISTINCT node_id) AS total_nodes, {half_up('lat_c', 'count(*)', 2)} AS avg_latency_ms,
    {half_up('up_c', 'count(*)', 2)} AS avg_uptime_pct, {half_up('loss_c', 'count(*)', 3)} AS avg_loss_pct
    FROM metrics WHERE {_RANGE}"""))
def cluster_summary(spark, sf):
    return Q.cluster_summary(A.metrics(spark, sf), START, END)


@query("F12", sql("metrics", """SELECT count(DISTINCT node_id) AS total_nodes, round(avg(avg_latency), 2) AS avg_latency_ms,
    round(avg(avg_uptime), 2) AS avg_uptime_pct, round(avg(avg_loss), 3) AS avg_loss_pct FROM five""", _FIVE))
def cluster_summary_from_rollup(spark, sf):
    return Q.cluster_summary_from_rollup(stored.tier(spark, sf, "5m_node", "dense", START, END), START, END)


@query("F13 E3", sql("metrics nodes", f"""SELECT slug AS region, count(DISTINCT node_id) AS nodes,
    {half_up('lat_c', 'count(*)', 2)} AS avg_latency, {half_up('up_c', 'count(*)', 2)} AS avg_uptime
    FROM metrics JOIN nodes USING (node_id) WHERE {_RANGE} GROUP BY slug"""))
def regional_breakdown(spark, sf):
    return Q.regional_breakdown(A.metrics(spark, sf), A.nodes(spark, sf), START, END)


@query("F13 E4", sql("metrics nodes", """SELECT slug AS region, count(DISTINCT node_id) AS nodes,
    round(avg(avg_latency), 2) AS avg_latency, round(avg(avg_uptime), 2) AS avg_uptime
    FROM five JOIN nodes USING (node_id) GROUP BY slug""", _FIVE))
def regional_breakdown_from_rollup(spark, sf):
    return Q.regional_breakdown_from_rollup(
        stored.tier(spark, sf, "5m_node", "dense", START, END), A.nodes(spark, sf), START, END)


_SCORED = f"""scored AS (SELECT *, lat / 50.0::DOUBLE + loss * 10.0::DOUBLE + (100.0::DOUBLE - up) * 2.0::DOUBLE AS raw FROM (
    SELECT node_id, slug, shown_slug, {mean('lat_c')} AS lat, {mean('loss_c')} AS loss, {mean('up_c')} AS up
    FROM metrics JOIN nodes USING (node_id) GROUP BY ALL))"""


@query("F14 C14", sql("metrics nodes", """SELECT node_id, slug AS region, round(raw, 2) AS score, round(lat, 2) AS avg_latency,
    round(loss, 3) AS avg_loss FROM scored ORDER BY raw DESC, node_id LIMIT 20""", _SCORED))
def top_problem_nodes(spark, sf):
    return Q.top_problem_nodes(A.metrics(spark, sf), A.nodes(spark, sf), START, END, 20)


@query("F14 E4", sql("metrics nodes", """SELECT node_id, slug AS region, round(raw, 2) AS score, round(lat, 2) AS avg_latency,
    round(loss, 3) AS avg_loss FROM (SELECT *, lat / 50.0::DOUBLE + loss * 10.0::DOUBLE + (100.0::DOUBLE - up) * 2.0::DOUBLE AS raw
    FROM (SELECT node_id, slug, avg(avg_latency) AS lat, avg(avg_loss) AS loss, avg(avg_uptime) AS up
          FROM five JOIN nodes USING (node_id) GROUP BY ALL)) ORDER BY raw DESC, node_id LIMIT 5""", _FIVE))
def top_problem_nodes_from_rollup(spark, sf):
    return Q.top_problem_nodes_from_rollup(
        stored.tier(spark, sf, "5m_node", "dense", START, END), A.nodes(spark, sf), START, END)


@query("C14", sql("metrics nodes", "SELECT node_id, raw AS score FROM scored", _SCORED))
def problem_scores(spark, sf):
    scored = Q._scored(A.metrics(spark, sf), A.nodes(spark, sf))
    return scored.select("node_id", F.col("raw_score").alias("score"))


@query("F15", sql("metrics", f"""SELECT {half_up('lat_c', 'count(*)', 0)} AS avg_latency, {half_up('up_c', 'count(*)', 1)} AS avg_uptime,
    {half_up('loss_c', 'count(*)', 2)} AS avg_loss, count(DISTINCT node_id) AS node_count FROM metrics"""))
def kpi_stats(spark, sf):
    return Q.kpi_stats(A.metrics(spark, sf))


@query("E1 I1", sql("metrics nodes", f"""SELECT m.node_id, coalesce(country, 'XX') AS country, coalesce(region, 'Unknown') AS region,
    latency_ms, uptime_pct, packet_loss, time FROM (SELECT * FROM metrics WHERE {_RANGE}
      ORDER BY time DESC, node_id, arrival LIMIT 100 OFFSET 200) m LEFT JOIN nodes USING (node_id)"""))
def list_metrics_page(spark, sf):
    return Q.list_metrics(A.metrics(spark, sf), A.nodes(spark, sf), start=START, end=END, limit=100, offset=200)


@query("E1 I1", sql("native nodes", """SELECT m.node_id, coalesce(country, 'XX') AS country, coalesce(region, 'Unknown') AS region,
    latency_ms, uptime_pct, packet_loss, time, arrival FROM (SELECT * FROM native ORDER BY time DESC, node_id, arrival LIMIT 500 OFFSET 1000) m
    LEFT JOIN nodes USING (node_id)"""))
def list_metrics_by_cursor(spark, sf):
    """The third page of 500 samples of the stored table, reached by cursors."""
    table, cursor = stored.store(spark, sf, "native").raw, None
    for _ in range(2):
        _, cursor = metrics_page(table, A.nodes(spark, sf), cursor, 500)
        if cursor is None:
            break
    return metrics_page(table, A.nodes(spark, sf), cursor, 500)[0] if cursor else metrics_page(table, A.nodes(spark, sf), None, 1)[0].limit(0)


@query("E2", sql("metrics nodes", """SELECT n.node_id, status, country, region, coalesce(CAST(lat AS DOUBLE), 0) AS lat,
    coalesce(CAST(lng AS DOUBLE), 0) AS lng, max(time) AS last_seen FROM nodes n LEFT JOIN metrics m USING (node_id)
    WHERE status <> 'deleted' GROUP BY ALL"""))
def list_nodes(spark, sf):
    return Q.list_nodes(A.nodes(spark, sf), A.metrics(spark, sf))


@query("E5", sql("metrics nodes", """SELECT DISTINCT node_id FROM metrics WHERE node_id NOT IN
    (SELECT node_id FROM nodes WHERE status = 'reporting')"""))
def unseen_nodes(spark, sf):
    return Q.unseen_nodes(A.metrics(spark, sf), A.nodes(spark, sf).where(F.col("status") == "reporting"))


@query("E6", sql("native nodes", """SELECT bucket, region, avg_latency, avg_uptime FROM hourly JOIN nodes USING (node_id)
    WHERE bucket > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '7 days'""", _HOURLY))
def recent_rollups_by_region(spark, sf):
    tier = stored.tier(spark, sf, "hourly", "native", "2024-01-24 00:00:00", "2024-01-31 00:00:00")
    return Q.recent_rollups_by_region(tier, A.nodes(spark, sf), "2024-01-31 00:00:00")


@query("E6", sql("metrics nodes", f"""SELECT node_name, region, {mean('lat_c')} AS avg_latency, {mean('up_c')} AS avg_uptime
    FROM metrics JOIN nodes USING (node_id) WHERE time > TIMESTAMP '{NOW}' - INTERVAL '24 hours' GROUP BY ALL"""))
def node_average(spark, sf):
    return Q.node_average(A.metrics(spark, sf), A.nodes(spark, sf), NOW)


_LIVE = """live AS (SELECT node_id, arg_max(active_target, (timestamp, arrival)) AS active_target, max(timestamp) AS last_seen
    FROM heartbeats WHERE timestamp <= TIMESTAMP '2024-01-01 00:30:00' AND timestamp > TIMESTAMP '2024-01-01 00:25:00'
    GROUP BY node_id)"""


@query("F17", sql("heartbeats", """SELECT *, CASE WHEN total_probes = 0 THEN 'unknown' WHEN primary_probes = total_probes
    THEN 'primary' WHEN primary_probes = 0 THEN 'failover' ELSE 'degraded' END AS status FROM (SELECT count(*) AS total_probes,
    count(*) FILTER (WHERE active_target IN ('central', 'legacy-env')) AS primary_probes FROM live)""", _LIVE))
def federation_status(spark, sf):
    return Q.federation_status(A.heartbeats(spark, sf), "2024-01-01 00:30:00", ttl_s=300)


@query("F17", sql("heartbeats", "SELECT active_target, count(*) AS probes FROM live GROUP BY 1", _LIVE))
def federation_targets(spark, sf):
    return Q.federation_targets(Q.federation_live(A.heartbeats(spark, sf), "2024-01-01 00:30:00", ttl_s=300))


_RANKED = """ranked AS (SELECT node_id, latency_ms, lat_c, row_number() OVER (PARTITION BY node_id ORDER BY latency_ms) - 1 AS r,
    count(*) OVER (PARTITION BY node_id) AS n FROM metrics)"""


@query("F18", sql("metrics", f"""SELECT node_id, count(*) AS count, min(latency_ms) AS min, max(latency_ms) AS max, {mean('lat_c')} AS avg,
    min(latency_ms) FILTER (WHERE r = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95,
    min(latency_ms) FILTER (WHERE r = CAST(floor(n * 0.99::DOUBLE) AS BIGINT)) AS p99 FROM ranked GROUP BY node_id""", _RANKED))
def nearest_rank_stats(spark, sf):
    return Q.nearest_rank_stats(A.metrics(spark, sf), "latency_ms", "node_id")


@query("F25", sql("metrics", """SELECT count(*) AS row_count, CAST(sum(lat_c) AS DOUBLE) / CAST(100 AS DOUBLE) AS latency_checksum
    FROM metrics"""))
def dataset_fingerprint(spark, sf):
    return Q.dataset_fingerprint(A.metrics(spark, sf))


@query("F25", sql("metrics native", """SELECT a.n = b.n AS count_match, abs(a.s - b.s) <= 1 AS checksum_match
    FROM (SELECT count(*) AS n, sum(lat_c) AS s FROM metrics) a, (SELECT count(*) AS n, sum(lat_c) AS s FROM native) b"""))
def compare_fingerprints(spark, sf):
    return Q.compare_fingerprints(
        Q.dataset_fingerprint(A.metrics(spark, sf)), Q.dataset_fingerprint(A.metrics(spark, sf, "native")))


@query("F16", sql("metrics", """SELECT ok AS rows_processed, bad AS rows_failed, dup AS duplicate_count, active_probes,
    CASE WHEN ok + bad > 0 THEN round(CAST(bad AS DOUBLE) / CAST(ok + bad AS DOUBLE), 4) ELSE 0 END AS error_rate FROM (
    SELECT count(*) FILTER (WHERE probe_type NOT IN ('error', 'click')) AS ok, count(*) FILTER (WHERE probe_type = 'error') AS bad,
    count(*) FILTER (WHERE probe_type = 'click') AS dup,
    count(DISTINCT node_id) FILTER (WHERE probe_type NOT IN ('error', 'click')) AS active_probes FROM metrics)"""))
def batch_summary(spark, sf):
    kind = F.when(F.col("probe_type") == "error", "failed").when(F.col("probe_type") == "click", "duplicate")
    return Q.batch_summary(A.metrics(spark, sf).select("node_id", kind.otherwise("processed").alias("outcome")))


@query("F19", sql("metrics", f"""SELECT time_bucket(INTERVAL '30 seconds', metrics.time) AS time, node_id,
    {mean('lat_c')} AS latency_ms FROM metrics GROUP BY 1, 2"""))
def panel_latency(spark, sf):
    return Q.panel_series(A.metrics(spark, sf), "latency_ms", "30 seconds")


@query("F19", sql("metrics", f"""SELECT time_bucket(INTERVAL '1 minute', metrics.time) AS time, node_id,
    {mean('loss_c')} AS packet_loss FROM metrics GROUP BY 1, 2"""))
def panel_loss(spark, sf):
    return Q.panel_series(A.metrics(spark, sf), "packet_loss", "1 minute")


@query("F20", sql("nodes", "SELECT count(*) FILTER (WHERE status = 'reporting') AS active_nodes FROM nodes"))
def active_nodes(spark, sf):
    return Q.active_nodes(A.nodes(spark, sf))


@query("F20", sql("metrics", f"""SELECT count(DISTINCT node_id) AS active_nodes FROM metrics
    WHERE time > TIMESTAMP '{NOW}' - INTERVAL '5 minutes' AND time <= TIMESTAMP '{NOW}'"""))
def active_nodes_by_last_seen(spark, sf):
    return Q.active_nodes_by_last_seen(A.metrics(spark, sf), NOW)


@query("F21", sql("metrics", f"""SELECT max(a) AS max_avg_loss FROM (SELECT {mean('loss_c')} AS a FROM metrics
    WHERE time > TIMESTAMP '{NOW}' - INTERVAL '10 minutes' AND time <= TIMESTAMP '{NOW}' AND packet_loss > 1 GROUP BY node_id)"""))
def incident_loss(spark, sf):
    return Q.incident_loss(A.metrics(spark, sf), NOW)


@query("F22", sql("metrics nodes", f"""SELECT time_bucket(INTERVAL '5 minutes', metrics.time) AS time, shown_slug AS region,
    {mean('lat_c')} AS latency FROM metrics JOIN nodes USING (node_id) GROUP BY 1, 2"""))
def panel_region_latency(spark, sf):
    return Q.panel_region_latency(A.metrics(spark, sf), A.nodes(spark, sf))


@query("F22", sql("metrics nodes", f"""SELECT time_bucket(INTERVAL '15 minutes', metrics.time) AS time, shown_slug AS region,
    least({mean('lat_c')}, 300) AS latency FROM metrics JOIN nodes USING (node_id) GROUP BY 1, 2"""))
def panel_region_heatmap(spark, sf):
    return Q.panel_region_heatmap(A.metrics(spark, sf), A.nodes(spark, sf))


@query("F23", sql("metrics nodes", """SELECT node_id, shown_slug AS region, round(lat, 1) AS avg_latency, round(loss, 2) AS avg_loss,
    round(raw, 2) AS score FROM scored ORDER BY round(raw, 2) DESC, node_id LIMIT 5""", _SCORED))
def panel_problem_nodes(spark, sf):
    return Q.panel_problem_nodes(A.metrics(spark, sf), A.nodes(spark, sf), NOW, "2 hours")


@query("F23", sql("metrics nodes", """SELECT region, round(avg(avg_latency), 1) AS latency FROM region5
    WHERE bucket > TIMESTAMP '2024-01-01 00:00:00' GROUP BY region""", _REGION5))
def panel_region_bar(spark, sf):
    return Q.panel_region_bar(stored.tier(spark, sf, "5m_region", "dense", START), START)


@query("F23", sql("metrics nodes", """SELECT bucket AS time, region, avg_uptime AS uptime FROM region5
    WHERE bucket > TIMESTAMP '2024-01-01 00:00:00'""", _REGION5))
def panel_uptime_trend(spark, sf):
    return Q.panel_uptime_trend(stored.tier(spark, sf, "5m_region", "dense", START), START)


@query("I4", sql("nodes", "SELECT 'All' AS region UNION SELECT DISTINCT slug FROM nodes WHERE status <> 'deleted'"))
def region_options(spark, sf):
    return Q.region_options(A.nodes(spark, sf))


@query("I4", sql("nodes", "SELECT DISTINCT node_id FROM nodes WHERE status <> 'deleted' AND slug = 'ac-asia'"))
def node_options(spark, sf):
    return Q.node_options(A.nodes(spark, sf), "ac-asia")
