"""Row-window analytics, alerts, logs, audit and quality queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from beaconry.functions.state import performance_level
from beaconry.operators import alerts as H, audit as L, dedup as D, logs as LG, quality as M, rowwindow as G
from beaconry.plans.q_ingest import _AGE, _COORDS, NOW, STATE_SQL
from beaconry.plans.registry import query
from beaconry.plans.views import chain, sql
from beaconry.sources import adapters as A

# --- rolling windows --------------------------------------------------------------------------------------------

_ROLL = """roll AS (SELECT *, count(*) OVER w AS n, CAST(sum(lat_c) OVER w AS BIGINT) AS s,
      CAST(sum(lat_c * lat_c) OVER w AS BIGINT) AS q FROM metrics
      WINDOW w AS (PARTITION BY node_id ORDER BY arrival ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    scored AS (SELECT *, CAST(s AS DOUBLE) / CAST(n * 100 AS DOUBLE) AS mean, CASE WHEN n > 1 THEN
      sqrt(greatest(CAST(n * q - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE), 0.0::DOUBLE)) / 100.0::DOUBLE END AS sd FROM roll),
    zs AS (SELECT *, abs(lat_c / 100.0::DOUBLE - mean) AS off FROM scored)"""


@query("G1 G2 G3", sql("metrics", """SELECT time, node_id, arrival,
      CASE WHEN n >= 5 THEN CAST(((2 * s + n) // (2 * n)) / 100.0::DOUBLE AS DECIMAL(10,2)) END AS latency_avg_window,
      CASE WHEN n >= 5 THEN CAST(round(sd, 2) AS DECIMAL(10,2)) END AS latency_std_window,
      packet_loss > 1.0 AS packet_loss_spike,
      CAST(CASE WHEN n < 5 THEN 0 WHEN sd > 0.001 THEN CASE WHEN off / sd < 1.5 THEN 0 WHEN off / sd >= 3 THEN 1
        ELSE round((off / sd - 1.5::DOUBLE) / 1.5::DOUBLE, 4) END ELSE CASE WHEN off > 1 THEN 1 ELSE 0 END END AS DECIMAL(5,4)) AS anomaly_score
    FROM zs""", _ROLL))
def rolling_anomaly(spark, sf):
    out = G.rolling_anomaly(A.metrics(spark, sf).select("time", "node_id", "latency_ms", "packet_loss", "arrival"))
    return out.select("time", "node_id", "arrival", "latency_avg_window", "latency_std_window", "packet_loss_spike",
                      "anomaly_score")


@query("G3", sql("metrics", "SELECT arrival, node_id, packet_loss FROM metrics WHERE packet_loss > 1.0"))
def loss_spikes(spark, sf):
    return G.loss_spikes(A.metrics(spark, sf)).select("arrival", "node_id", "packet_loss")


@query("G4", sql("metrics", """SELECT node_id, points, CASE WHEN points >= 10 THEN delta END AS delta,
      CASE WHEN points < 10 THEN 'AWAITING' WHEN delta > 5 THEN 'DEGRADING' ELSE 'STABILIZING' END AS trajectory FROM (
      SELECT node_id, max(c) AS points, CAST(sum(lat_c) FILTER (WHERE r <= part) - sum(lat_c) FILTER (WHERE r > c - part) AS DOUBLE)
        / CAST(max(part) * 100 AS DOUBLE) AS delta FROM (SELECT *, CAST(floor(c * 0.3::DOUBLE) AS BIGINT) AS part FROM (
          SELECT *, count(*) OVER (PARTITION BY node_id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY node_id
            ORDER BY time DESC, arrival DESC) AS r FROM metrics) WHERE r <= 300)) GROUP BY node_id)"""))
def trajectory(spark, sf):
    return G.trajectory(A.metrics(spark, sf), "latency_ms", ["node_id"])


@query("G5", sql("metrics", """SELECT node_id, CASE WHEN max(latency_ms) FILTER (WHERE r = 1) > max(latency_ms) FILTER (WHERE r = 2)
      THEN 'rising' ELSE 'falling' END AS trend FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY time DESC,
      arrival DESC) AS r FROM metrics) GROUP BY node_id"""))
def trend(spark, sf):
    return G.trend(A.metrics(spark, sf), "latency_ms", ["node_id"])


@query("G6", sql("metrics", """SELECT time, node_id, latency_ms, arrival FROM metrics ORDER BY time DESC, arrival DESC LIMIT 300"""))
def latest_points(spark, sf):
    return G.latest_n(A.metrics(spark, sf).select("time", "node_id", "latency_ms", "arrival"))


@query("G7", sql("metrics", """SELECT time, node_id, latency_ms, arrival FROM metrics QUALIFY row_number() OVER (
      PARTITION BY node_id, time_bucket(INTERVAL '500 milliseconds', time) ORDER BY time DESC, arrival DESC) = 1"""))
def throttle(spark, sf):
    return G.throttle(A.metrics(spark, sf).select("time", "node_id", "latency_ms", "arrival"), ["node_id"])


@query("G8", sql("heartbeats", """SELECT node_id, prev AS from_target, active_target AS to_target, count(*) AS transitions FROM (
      SELECT *, lag(active_target) OVER (PARTITION BY node_id ORDER BY timestamp, arrival) AS prev FROM heartbeats)
      WHERE prev <> active_target GROUP BY ALL"""))
def target_transitions(spark, sf):
    return G.target_transitions(A.heartbeats(spark, sf))


def _posture(source: str) -> str:
    return f"""SELECT *, CASE WHEN rows_judged = 0 OR blackout > 0 OR critical >= 2 THEN 'COMPROMISED'
      WHEN critical >= 1 OR degraded >= 1 THEN 'CONTESTED' ELSE 'SECURED' END AS posture FROM (SELECT count(*) AS rows_judged,
      count(*) FILTER (WHERE dark) AS blackout, count(*) FILTER (WHERE NOT dark AND lvl = 2) AS critical,
      count(*) FILTER (WHERE NOT dark AND lvl = 1) AS degraded FROM (SELECT {_AGE} > 300 AS dark,
      CASE WHEN latency_ms > 200 OR packet_loss > 5 THEN 2 WHEN latency_ms > 100 OR packet_loss > 1 THEN 1 ELSE 0 END AS lvl
      FROM {source}))"""


_LATEST = """latest AS (SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY time DESC, arrival) = 1)"""


@query("G9", sql("metrics", _posture("latest"), _LATEST))
def posture(spark, sf):
    return G.posture(A.metrics(spark, sf), NOW)


@query("G9", sql("metrics", _posture("metrics")))
def posture_all_rows(spark, sf):
    return G.posture(A.metrics(spark, sf), NOW, latest_only=False)


_LEVELS = """lv AS (SELECT *, epoch_us(time) AS us, CASE WHEN latency_ms > 200 OR packet_loss > 5 THEN 2
      WHEN latency_ms > 100 OR packet_loss > 1 THEN 1 ELSE 0 END AS level FROM metrics),
    st AS (SELECT * FROM (SELECT *, lag(level) OVER w AS old FROM lv WINDOW w AS (PARTITION BY node_id ORDER BY time, arrival))
      WHERE old IS NULL OR old <> level),
    seg AS (SELECT node_id, us, level, row_number() OVER w AS rn,
      coalesce((lead(us) OVER w - us) / 1e6::DOUBLE, 'infinity'::DOUBLE) AS held FROM st
      WINDOW w AS (PARTITION BY node_id ORDER BY us, arrival))"""


@query("G10", sql("metrics", """SELECT node_id, make_timestamp(us + CASE WHEN shown > was THEN 10000000 ELSE 30000000 END) AS changed_at,
      shown FROM fold WHERE shown <> was""", _LEVELS, """fold AS (
      SELECT node_id, rn, us, 0 AS was, CASE WHEN held >= 30 THEN level WHEN held >= 10 THEN greatest(0, level) ELSE 0 END AS shown
      FROM seg WHERE rn = 1
      UNION ALL
      SELECT s.node_id, s.rn, s.us, f.shown, CASE WHEN s.held >= 30 THEN s.level WHEN s.held >= 10 THEN greatest(f.shown, s.level)
        ELSE f.shown END FROM fold f JOIN seg s ON s.node_id = f.node_id AND s.rn = f.rn + 1)""", recursive=True))
def debounce_levels(spark, sf):
    m = A.metrics(spark, sf).select("node_id", "time", "arrival", performance_level(
        F.col("latency_ms"), F.col("packet_loss")).alias("level"))
    return G.debounce(m, ["node_id"], "time", "level")


_RATE = """rises AS (SELECT node_id, bucket, CASE WHEN old IS NULL THEN 0 WHEN lat_c >= old THEN lat_c - old ELSE lat_c END AS rise FROM (
      SELECT *, lag(lat_c) OVER (PARTITION BY node_id, bucket ORDER BY time, arrival) AS old FROM (
        SELECT *, time_bucket(INTERVAL '5 minutes', time) AS bucket FROM metrics)))"""


@query("G11", sql("metrics", """SELECT node_id, bucket, CAST(sum(rise) AS DOUBLE) / 100.0::DOUBLE / 300.0::DOUBLE AS rate
    FROM rises GROUP BY 1, 2""", _RATE))
def counter_rate(spark, sf):
    m = A.metrics(spark, sf).select("node_id", F.col("time").alias("ts"), "arrival", F.col("latency_ms").alias("value"))
    return G.counter_rate(m, ["node_id"], "5 minutes", 300)


_LE = (10.0, 25.0, 50.0, 100.0, 250.0, float("inf"))


@query("G12", sql("metrics", """SELECT node_id, round(CASE WHEN le = 'infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * ((rk - below)
      / (value - below)) END, 9) AS quantile FROM b WHERE value >= rk AND value > 0
      QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY le) = 1""",
      """h AS (SELECT node_id, le, count(*) FILTER (WHERE latency_ms <= le) AS value FROM metrics,
        (SELECT unnest([10.0::DOUBLE, 25, 50, 100, 250, 'infinity'::DOUBLE]) AS le) GROUP BY 1, 2)""",
      """b AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(value) OVER w, 0) AS below,
        max(value) OVER (PARTITION BY node_id) * 0.95::DOUBLE AS rk FROM h WINDOW w AS (PARTITION BY node_id ORDER BY le))"""))
def histogram_quantile(spark, sf):
    counts = A.metrics(spark, sf).groupBy("node_id").agg(
        F.array(*[F.struct(F.lit(le).alias("le"), F.count_if(F.col("latency_ms") <= F.lit(le)).alias("value"))
                  for le in _LE]).alias("b"))
    rows = counts.select("node_id", F.explode("b").alias("b")).select("node_id", "b.*")
    return G.histogram_quantile(rows, 0.95, ["node_id"]).withColumn("quantile", F.round("quantile", 9))


# --- alerts -----------------------------------------------------------------------------------------------------

_FIRED = """fired AS (SELECT node_id, time AS ts, epoch_us(time) AS us, arrival, rule_no, severity, metric_name, value, threshold, message,
      node_id || ':' || metric_name || ':' || severity AS dedup_key, arrival * 10 + rule_no AS seq FROM (
      SELECT *, 0 AS rule_no, 'critical' AS severity, 'latency_ms' AS metric_name, l AS value, 500.0::DOUBLE AS threshold,
        'CRITICAL LATENCY on ' || node_id || ': ' || l || 'ms' AS message FROM m WHERE l > 500
      UNION ALL SELECT *, 1, 'warning', 'latency_ms', l, 200, 'High Latency on ' || node_id || ': ' || l || 'ms' FROM m WHERE l > 200
      UNION ALL SELECT *, 2, 'critical', 'packet_loss', p, 5, 'CRITICAL PACKET LOSS on ' || node_id || ': ' || p || '%' FROM m WHERE p > 5
      UNION ALL SELECT *, 3, 'warning', 'packet_loss', p, 1, 'Packet Loss Detected on ' || node_id || ': ' || p || '%' FROM m WHERE p > 1
      UNION ALL SELECT *, 4, 'warning', 'uptime_pct', u, 95, 'Low Uptime on ' || node_id || ': ' || u || '%' FROM m WHERE u < 95))"""
_M = """m AS (SELECT *, CAST(latency_ms * 2 AS DOUBLE) AS l, CAST(packet_loss AS DOUBLE) AS p, CAST(uptime_pct AS DOUBLE) AS u FROM metrics)"""


def _doubled(spark, sf):
    """Latency doubled, so that every rule fires on the test data."""
    return A.metrics(spark, sf).withColumn("latency_ms", (F.col("latency_ms") * 2).cast("decimal(10,2)"))


@query("H1 N1", sql("metrics", """SELECT node_id, ts, arrival, rule_no, severity, metric_name, value, threshold, message FROM fired""",
                    _M, _FIRED))
def evaluate_rules(spark, sf):
    return H.evaluate_rules(_doubled(spark, sf)).select(
        "node_id", "ts", "arrival", "rule_no", "severity", "metric_name", "value", "threshold", "message")


def _fchain(name: str, source: str, key: str, seconds: int) -> str:
    return chain(name, source, key, "us", seconds).replace("ORDER BY s.arrival", "ORDER BY s.seq")


@query("H2", sql("metrics", "SELECT arrival, rule_no, (arrival, rule_no) IN (SELECT (arrival, rule_no) FROM live) AS kept FROM fired",
                 _M, _FIRED, _fchain("live", "fired", "dedup_key", 900), recursive=True))
def alert_cooldown(spark, sf):
    m = _doubled(spark, sf)
    return H.cooldown(H.evaluate_rules(m)).select("arrival", "rule_no", "kept")


_QUOTA = """quota AS (SELECT f.*, row_number() OVER (PARTITION BY f.node_id, w.us ORDER BY f.us, f.seq) AS hit
      FROM live f ASOF JOIN win_chain w ON f.node_id = w.key AND f.us >= w.us)"""


@query("H3", sql("metrics", "SELECT arrival, rule_no, hit, hit <= 5 AS allowed FROM quota", _M, _FIRED,
                 _fchain("live", "fired", "dedup_key", 900), _fchain("win", "live", "node_id", 3600), _QUOTA, recursive=True))
def alert_node_quota(spark, sf):
    m = _doubled(spark, sf)
    live = H.cooldown(H.evaluate_rules(m)).where("kept").drop("kept")
    return H.node_quota(live).select("arrival", "rule_no", "hit", "allowed")


_TOKENS = """asks AS (SELECT us // 1000000 AS s, count(*) AS n FROM quota WHERE hit <= 5 GROUP BY 1),
    per AS (SELECT *, row_number() OVER (ORDER BY s) AS rn FROM asks),
    tok AS (
      SELECT rn, s, least(n, 10) AS give, 10.0::DOUBLE - least(n, 10) AS tokens, s AS last FROM per WHERE rn = 1
      UNION ALL
      SELECT rn, s, give, CASE WHEN give > 0 THEN level - give ELSE tokens END, CASE WHEN give > 0 THEN s ELSE last END FROM (
        SELECT p.rn, p.s, t.tokens, t.last, level, least(p.n, CAST(floor(level) AS BIGINT)) AS give FROM (
          SELECT t.*, p.rn AS prn, least(10.0::DOUBLE, t.tokens + (p.s - t.last) * (100 / 3600.0::DOUBLE)) AS level
          FROM tok t JOIN per p ON p.rn = t.rn + 1) t JOIN per p ON p.rn = t.prn)),
    sent AS (SELECT q.arrival, q.rule_no, row_number() OVER (PARTITION BY us // 1000000 ORDER BY us, seq) <= coalesce(give, 0) AS ok
      FROM quota q LEFT JOIN tok ON q.us // 1000000 = tok.s WHERE hit <= 5)"""
_H5 = (_M, _FIRED, _fchain("live", "fired", "dedup_key", 900), _fchain("win", "live", "node_id", 3600), _QUOTA, _TOKENS)


@query("H4 H5", sql("metrics", """SELECT f.arrival, f.rule_no, f.severity, CASE WHEN q.arrival IS NULL THEN 'dedup' WHEN q.hit > 5 THEN 'node_quota'
      WHEN s.ok THEN 'sent' ELSE 'global_limit' END AS disposition FROM fired f LEFT JOIN quota q USING (arrival, rule_no)
      LEFT JOIN sent s USING (arrival, rule_no)""", *_H5, recursive=True))
def run_alerts(spark, sf):
    return H.run_alerts(_doubled(spark, sf)).select("arrival", "rule_no", "severity", "disposition")


PAYLOAD_SQL = """SELECT substr(sha256(node_id || '|' || CAST(ts AS VARCHAR) || '|' || arrival || '|' || rule_no), 1, 32) AS alert_id,
      '{"attachments":[{"color":"' || CASE severity WHEN 'critical' THEN '#EF4444' ELSE '#F59E0B' END || '","blocks":[{"type":"section",'
      || '"text":{"type":"mrkdwn","text":"🚨 *' || upper(severity) || '*: ' || message || '"}},{"type":"context","elements":'
      || '[{"type":"mrkdwn","text":"Node: `' || node_id || '` | Time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}]}]}]}' AS payload
    FROM fired"""


@query("H6", sql("metrics", PAYLOAD_SQL, _M, _FIRED))
def dispatch_payload(spark, sf):
    return H.dispatch_payload(H.evaluate_rules(_doubled(spark, sf)))


@query("H7", sql("metrics nodes", f"""SELECT rule, node_id, value FROM (
      SELECT 'node_down' AS rule, node_id, lag AS value FROM w WHERE lag > 300
      UNION ALL SELECT 'high_latency', node_id, lat FROM w WHERE lat > 100
      UNION ALL SELECT 'packet_loss', node_id, loss FROM w WHERE loss > 1
      UNION ALL SELECT 'latency_' || lower(country), w.node_id, w.lat FROM w JOIN nodes USING (node_id)
        JOIN (VALUES ('AA', 40), ('AC', 55), ('AF', 50)) v(country, lim) USING (country) WHERE w.lat > lim)""",
      f"""w AS (SELECT node_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(time))) / 1000000.0::DOUBLE AS lag,
        CAST(sum(lat_c) FILTER (WHERE r) AS DOUBLE) / CAST(count(*) FILTER (WHERE r) * 100 AS DOUBLE) AS lat,
        CAST(sum(loss_c) FILTER (WHERE r) AS DOUBLE) / CAST(count(*) FILTER (WHERE r) * 100 AS DOUBLE) AS loss
        FROM (SELECT *, time > TIMESTAMP '{NOW}' - INTERVAL '5 minutes' AS r FROM metrics
              WHERE time > TIMESTAMP '{NOW}' - INTERVAL '10 minutes') GROUP BY node_id)"""))
def window_rules(spark, sf):
    return H.window_rules(A.metrics(spark, sf), A.nodes(spark, sf), NOW, {"aa": 40.0, "ac": 55.0, "af": 50.0})


@query("H8", sql("metrics", """SELECT arrival, CASE WHEN NOT bad THEN 'inactive' WHEN (us - max(CASE WHEN rose THEN us END) OVER w) / 1e6::DOUBLE >= 60
      THEN 'firing' ELSE 'pending' END AS state FROM (SELECT *, bad AND NOT coalesce(lag(bad) OVER w, false) AS rose FROM (
        SELECT node_id, arrival, time, epoch_us(time) AS us, latency_ms > 20 AS bad FROM metrics)
        WINDOW w AS (PARTITION BY node_id ORDER BY time, arrival))
      WINDOW w AS (PARTITION BY node_id ORDER BY time, arrival)"""))
def pending_alerts(spark, sf):
    m = A.metrics(spark, sf).select("node_id", "time", "arrival", (F.col("latency_ms") > 20).alias("bad"))
    return H.pending(m, ["node_id"], "time", "bad", 60).select("arrival", "state")


_SERIES = """s AS (SELECT metric, metric || '/' || user_id AS series, time_bucket(INTERVAL '5 minutes', time) AS bucket, us, arrival,
      CAST(value * 200000 AS DECIMAL(14,2)) AS v FROM (SELECT user_id, value, event_id AS arrival, (epoch_us(ts) - 1704067200000000) // 720
        + 1704067200000000 AS us, make_timestamp((epoch_us(ts) - 1704067200000000) // 720 + 1704067200000000) AS time,
        CASE event_type WHEN 'view' THEN 'dashboard_cache_hits_total' WHEN 'click' THEN 'dashboard_cache_misses_total'
          WHEN 'error' THEN 'log_dropped_total' WHEN 'signup' THEN 'dlq_size_bytes' ELSE 'aggregate_fallback_total' END AS metric FROM events)),
    rates AS (SELECT series, metric, bucket, CAST(sum(CASE WHEN old IS NULL THEN 0 WHEN c >= old THEN c - old ELSE c END) AS DOUBLE)
      / 100.0::DOUBLE / 300.0::DOUBLE AS rate FROM (SELECT *, lag(c) OVER (PARTITION BY series, bucket ORDER BY us, arrival) AS old
        FROM (SELECT *, CAST(v * 100 AS BIGINT) AS c FROM s)) GROUP BY 1, 2, 3),
    vals AS (
      SELECT 'AggregateFallbackHigh' AS rule, 'warning' AS severity, series AS scope, bucket, rate AS value, rate > 0.1 AS breached, 120 AS hold
        FROM rates WHERE metric = 'aggregate_fallback_total'
      UNION ALL SELECT 'LogsDropped', 'warning', series, bucket, rate, rate > 10, 120 FROM rates WHERE metric = 'log_dropped_total'
      UNION ALL SELECT 'DLQFilling', 'critical', series, bucket, x, x > 50000000, 0 FROM (
        SELECT series, bucket, CAST(arg_max(v, (us, arrival)) AS DOUBLE) AS x FROM s WHERE metric = 'dlq_size_bytes' GROUP BY 1, 2)
      UNION ALL SELECT 'CacheMissRateHigh', 'info', 'api', bucket, x, x > 0.5, 300 FROM (
        SELECT bucket, coalesce(sum(rate) FILTER (WHERE metric = 'dashboard_cache_misses_total'), 0) / nullif(sum(rate), 0) AS x
        FROM rates WHERE metric LIKE 'dashboard_cache%' GROUP BY 1)),
    edges AS (SELECT *, epoch_us(bucket) AS us, breached AND NOT coalesce(lag(breached) OVER w, false) AS rose FROM vals
      WINDOW w AS (PARTITION BY rule, scope ORDER BY bucket))"""


@query("H9", sql("", """SELECT rule, severity, scope, bucket, round(value, 9) AS value, breached, CASE WHEN NOT breached THEN 'inactive'
      WHEN (us - max(CASE WHEN rose THEN us END) OVER (PARTITION BY rule, scope ORDER BY bucket)) / 1e6::DOUBLE >= hold
      THEN 'firing' ELSE 'pending' END AS state FROM edges""", _SERIES))
def metric_rules(spark, sf):
    name = (F.when(F.col("event_type") == "view", "dashboard_cache_hits_total")
            .when(F.col("event_type") == "click", "dashboard_cache_misses_total")
            .when(F.col("event_type") == "error", "log_dropped_total")
            .when(F.col("event_type") == "signup", "dlq_size_bytes").otherwise("aggregate_fallback_total"))
    e = A.table(spark, sf, "events")
    samples = e.select(
        F.concat(name, F.lit("/"), F.col("user_id")).alias("series"), name.alias("metric"),
        F.create_map(F.lit("service"), F.lit("api")).alias("labels"),
        A.from_micros(F.lit(A.EPOCH_US) + F.floor((A.micros("ts") - A.EPOCH_US) / 720).cast("long")).alias("ts"),
        F.col("event_id").alias("arrival"), (F.col("value") * 200000).cast("decimal(14,2)").alias("value"))
    return H.metric_rules(samples).withColumn("value", F.round("value", 9))


# --- logs, audit, quality ---------------------------------------------------------------------------------------


@query("F24", sql("logs", """SELECT time_bucket(INTERVAL '1 minute', timestamp) AS bucket, service, count(*) AS lines FROM logs
    WHERE service IN (SELECT service FROM logs GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 5) GROUP BY 1, 2"""))
def log_volume(spark, sf):
    return LG.log_volume(A.logs(spark, sf))


@query("F24", sql("logs", """SELECT time_bucket(INTERVAL '1 minute', timestamp) AS bucket, count(*) AS lines,
    count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS errors FROM logs GROUP BY 1"""))
def log_error_rate(spark, sf):
    return LG.error_rate(A.logs(spark, sf))


@query("F24", sql("logs", """SELECT lines, missing, CAST(missing AS DOUBLE) / CAST(lines AS DOUBLE) AS missing_ratio FROM (SELECT count(*) AS lines,
    count(*) FILTER (WHERE trace_id IS NULL OR trace_id = 'unknown') AS missing FROM logs)"""))
def missing_trace_ratio(spark, sf):
    return LG.missing_trace_ratio(A.logs(spark, sf))


@query("D3", sql("logs", """SELECT timestamp, message, arrival FROM (SELECT date_trunc('hour', timestamp) AS timestamp, message, arrival FROM logs)
    QUALIFY row_number() OVER (PARTITION BY timestamp, message ORDER BY arrival) = 1"""))
def dedup_logs(spark, sf):
    """Whole texts; times cut to the hour so that copies of a document fall together."""
    rows = A.logs(spark, sf).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return D.dedup_logs(rows).select("timestamp", "message", "arrival")


@query("I5", sql("logs", """SELECT arrival, timestamp, service, latency_ms FROM logs WHERE level = 'ERROR' AND latency_ms > 1000
    AND timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp <= TIMESTAMP '2024-01-01 12:00:00'"""))
def log_search(spark, sf):
    out = LG.log_search(A.logs(spark, sf), level="ERROR", start="2024-01-01 00:00:00", end="2024-01-01 12:00:00",
                        above={"latency_ms": 1000})
    return out.select("arrival", "timestamp", "service", "latency_ms")


@query("L4", sql("logs", """SELECT arrival, CASE WHEN arrival % 7 = 3 THEN 'unknown' ELSE coalesce(trace_id, 'unknown') END AS trace_id,
    CASE WHEN arrival % 7 = 3 THEN 'plain ' || arrival ELSE message END AS message, arrival % 7 = 3 AS decode_error, false AS has_secret,
    CASE WHEN arrival % 7 <> 3 THEN service END AS service FROM logs"""))
def normalize_logs(spark, sf):
    """Documents wrapped as JSON log lines with a trace id and a password; every seventh line is no JSON."""
    line = F.to_json(F.struct("message", "trace_id", "service", F.lit("x").alias("password")))
    line = F.when(F.col("arrival") % 7 == 3, F.concat(F.lit("plain "), F.col("arrival"))).otherwise(line)
    out = LG.normalize_logs(A.logs(spark, sf).select("arrival", line.alias("message")))
    secret = F.array_contains(F.map_keys("fields"), "password")
    return out.select("arrival", "trace_id", "message", "decode_error", secret.alias("has_secret"),
                      F.try_element_at("fields", F.lit("service")).alias("service"))


def _audit_entries(spark, sf):
    c = A.table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.date_format(F.timestamp_micros(F.lit(A.EPOCH_US) + F.col("conv_id") * 1000000),
                                         "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"),
        F.col("role").alias("user"), F.lit("ADMIN").alias("role"), F.lit("POST").alias("action"),
        F.concat(F.lit("conversation:"), F.col("conv_id")).alias("resource"),
        F.create_map(F.lit("text"), F.col("text")).alias("details"))


_JSON_TEXT = r"""array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\'
    WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN unicode(c) > 127 THEN printf('\u%04x', unicode(c))
    ELSE c END), '')"""


@query("L1", f"""WITH RECURSIVE e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
    '{{"action": "POST", "details": {{"text": "' || {_JSON_TEXT} || '"}}, "prev_hash": "' AS head,
    '", "resource": "conversation:' || conv_id || '", "role": "ADMIN", "ts": "' || strftime(make_timestamp((1704067200 + conv_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ')
      || '", "user": "' || role || '"}}' AS tail FROM conversations),
  c AS (SELECT conv_id, turn, n, 'GENESIS' AS prev_hash, substr(sha256(head || 'GENESIS' || tail || 'GENESIS'), 1, 16) AS hash FROM e WHERE n = 1
    UNION ALL SELECT e.conv_id, e.turn, e.n, c.hash, substr(sha256(head || c.hash || tail || c.hash), 1, 16) FROM e JOIN c ON e.conv_id = c.conv_id AND e.n = c.n + 1)
  SELECT conv_id, turn, prev_hash, hash FROM c""")
def audit_chain(spark, sf):
    out = L.chain_build(_audit_entries(spark, sf), ["conv_id"], ["turn"])
    return out.select("conv_id", "turn", "prev_hash", "hash")


@query("L2", """SELECT conv_id, CAST(min(turn) FILTER (WHERE broken) AS BIGINT) AS first_broken_line, count(*) FILTER (WHERE broken) = 0 AS valid FROM (
    SELECT *, CASE conv_id % 6 WHEN 1 THEN place = 2 WHEN 2 THEN place = 1 WHEN 3 THEN place = 3 WHEN 4 THEN place = 2 ELSE false END AS broken
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)) GROUP BY conv_id""")
def audit_verify(spark, sf):
    """A sixth of the chains each: unreadable second line, edited first line, second line missing, second line from elsewhere; a sixth has blank lines."""
    entries = _audit_entries(spark, sf)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    built = L.chain_build(entries, ["conv_id"], ["turn"]).withColumn("place", place)
    kind, at = F.col("conv_id") % 6, F.col("place")
    line = L.entry_json(built)
    value = (F.when((kind == 1) & (at == 2), F.substring(line, 1, 20)).when((kind == 2) & (at == 1), F.replace(line, F.lit('"prev_hash":"GENESIS"'), F.lit('"prev_hash":"GENESI5"')))
             .when((kind == 4) & (at == 2), F.regexp_replace(line, '"prev_hash":"[0-9a-f]+"', '"prev_hash":"0000000000000000"')).otherwise(line))
    lines = built.where(~((kind == 3) & (at == 2))).select("conv_id", F.col("turn").cast("long").alias("line"), value.alias("value"))
    blank = lines.where((kind == 5)).select("conv_id", F.col("line"), F.lit("  ").alias("value"))
    return L.chain_verify(lines.unionByName(blank), ["conv_id"])


@query("L3", "SELECT count(*) AS total_entries, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS file_size_bytes FROM conversations")
def audit_stats(spark, sf):
    return L.audit_stats(A.table(spark, sf, "conversations").select(F.col("text").alias("value")))


@query("M1", sql("metrics", f"""SELECT *, distinct_nodes >= 3 AS nodes_ok, lag_s <= 30 AS fresh, negative_rows = 0 AND duplicate_keys = 0 AS passed FROM (
    SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(neg) AS BIGINT) AS negative_rows, CAST(sum(zero) AS BIGINT) AS zero_latency_rows,
      count(*) FILTER (WHERE n > 1) AS duplicate_keys, count(*) FILTER (WHERE n > 1 AND time > TIMESTAMP '{NOW}' - INTERVAL '24 hours') AS duplicate_keys_24h,
      count(DISTINCT node_id) AS distinct_nodes, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(time))) / 1000000.0::DOUBLE AS lag_s
    FROM (SELECT node_id, date_trunc('second', time) AS time, count(*) AS n, count(*) FILTER (WHERE latency_ms < 0 OR packet_loss < 0) AS neg,
      count(*) FILTER (WHERE latency_ms = 0) AS zero FROM metrics GROUP BY 1, 2))"""))
def quality_report(spark, sf):
    m = A.metrics(spark, sf).withColumn("time", F.date_trunc("second", "time").cast("timestamp_ntz"))
    return M.quality_report(m, NOW)


@query("M2", sql("metrics", """SELECT node_id, checked, inversions, inversions = 0 AS monotonic FROM (SELECT node_id, count(*) AS checked,
    count(*) FILTER (WHERE time > later) AS inversions FROM (SELECT *, lag(time) OVER (PARTITION BY node_id ORDER BY arrival DESC) AS later,
    row_number() OVER (PARTITION BY node_id ORDER BY arrival DESC) AS r FROM metrics) WHERE r <= 100 GROUP BY 1)"""))
def monotonic_check(spark, sf):
    return M.monotonic_check(A.metrics(spark, sf))


def _placed(spark, sf):
    nodes = A.nodes(spark, sf).select("node_id", "country", "region")
    return A.metrics(spark, sf).join(nodes, "node_id")


_STATE = STATE_SQL.format(age=_AGE, stale=120)


@query("I2", sql("metrics nodes", f"""SELECT node_id, country, region, {_STATE} AS state FROM latest JOIN nodes USING (node_id)""", _LATEST))
def inventory(spark, sf):
    return M.inventory(_placed(spark, sf), NOW, stale_s=120).select("node_id", "country", "region", "state")


@query("I3", sql("metrics nodes", f"""SELECT arrival, node_id, state FROM (SELECT *, {_STATE} AS state FROM metrics JOIN nodes USING (node_id))
    WHERE region IN ('ASIA', 'AFRICA', 'MIDDLE EAST', 'EUROPE') AND state = 'CRITICAL'"""))
def map_points(spark, sf):
    out = M.map_points(_placed(spark, sf), NOW, status="CRITICAL", stale_s=120, coords=_COORDS, aliases={"europe": "Africa"})
    return out.select("arrival", "node_id", "state")
