"""SQL text of the telemetry views, shared by all oracle statements (DuckDB dialect)."""

from __future__ import annotations

_METRICS = """{name} AS (
  SELECT time, node_id, latency_ms, uptime_pct, packet_loss, probe_type, arrival,
         CAST(latency_ms * 100 AS BIGINT) AS lat_c, CAST(uptime_pct * 100 AS BIGINT) AS up_c,
         CAST(packet_loss * 100 AS BIGINT) AS loss_c
  FROM (
    SELECT {time} AS time, 'probe-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS node_id,
           CAST(value AS DECIMAL(10,2)) AS latency_ms,
           CAST(CASE WHEN event_type = 'error' THEN 100 - k / 4.0 ELSE 100 END AS DECIMAL(5,2)) AS uptime_pct,
           CAST(CASE WHEN event_type IN ('error', 'click') THEN (k % 16) / 2.0 ELSE 0 END AS DECIMAL(5,2)) AS packet_loss,
           event_type AS probe_type, event_id AS arrival
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)))"""

_DENSE = "make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 720)"

VIEWS = {
    "metrics": _METRICS.format(name="metrics", time=_DENSE),
    "native": _METRICS.format(name="native", time="ts"),
    "nodes": """nodes AS (
  SELECT 'probe-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS node_id, c_name AS node_name,
         CASE c_mktsegment WHEN 'FURNITURE' THEN 'deleted' WHEN 'MACHINERY' THEN 'reporting' ELSE 'registered' END AS status,
         'A' || chr(65 + n_nationkey) AS country, r_name AS region,
         CAST(CASE WHEN c_acctbal >= 0 THEN c_acctbal / 200 END AS DECIMAL(9,6)) AS lat,
         CAST(CAST(CASE WHEN c_acctbal >= 0 THEN c_acctbal / 200 END AS DECIMAL(9,6)) - 20 AS DECIMAL(9,6)) AS lng,
         lower('A' || chr(65 + n_nationkey)) || '-' || lower(replace(r_name, ' ', '-')) AS slug,
         lower('A' || chr(65 + n_nationkey)) || '-' || lower(r_name) AS shown_slug
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "heartbeats": f"""heartbeats AS (
  SELECT 'probe-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS node_id,
         CASE WHEN event_type IN ('view', 'signup') THEN 'central' WHEN event_type = 'purchase' THEN 'legacy-env'
              ELSE 'regional' END AS active_target,
         {_DENSE} AS timestamp, event_id AS arrival FROM events)""",
    "env": """env AS (
  SELECT *, make_timestamp(us) AS received_at, 'probe-' || lpad(CAST(cust AS VARCHAR), 8, '0') AS node_id,
         CASE WHEN odd AND prio = '3-MEDIUM' THEN NULL ELSE 'batch-' || cust END AS batch_id,
         CASE WHEN status = 'F' THEN 'gh-accra' WHEN odd THEN 'us-west' END AS region_id,
         'n-' || cust AS nonce, odd AND prio = '5-LOW' AS bad_ts, 1 + cust % 3 AS n_metrics,
         'A' || chr(CAST(65 + cust % 25 AS INTEGER)) AS country, substr(prio, 3) AS region,
         (us - (cents % 600000) * 1000) // 1000000 AS header_s
  FROM (SELECT o_orderkey AS arrival, o_custkey AS cust, o_orderstatus AS status, o_orderpriority AS prio,
               o_orderstatus = 'P' AS odd, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
               (epoch_us(o_orderdate) - 694224000000000) // 86400 + 1704067200000000 AS us FROM orders))""",
    "logs": """logs AS (
  SELECT make_timestamp(1704067200000000 + doc_id * 1000000) AS timestamp, source AS service,
         CASE WHEN n_chars > 2000 THEN 'CRITICAL' WHEN n_chars > 800 THEN 'ERROR'
              WHEN n_chars > 400 THEN 'WARNING' ELSE 'INFO' END AS level,
         text AS message, CASE lang WHEN 'en' THEN NULL WHEN 'de' THEN 'unknown' ELSE 't-' || doc_id END AS trace_id,
         n_chars AS latency_ms, doc_id AS arrival
  FROM documents)""",
}


def mean(col: str, scale: int = 100) -> str:
    """Same arithmetic as functions.exact.mean: whole units, one division."""
    return f"CAST(sum({col}) AS DOUBLE) / CAST(count({col}) * {scale} AS DOUBLE)"


def sql(views: str, body: str, *ctes: str, recursive: bool = False) -> str:
    """``WITH`` the named views (and extra CTE texts) followed by ``body``."""
    parts = [VIEWS[v] for v in views.split()] + list(ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def chain(name: str, source: str, key: str, us: str, seconds: int) -> str:
    """CTEs ``<name>_chain`` and ``<name>``: rows of ``source`` kept by set-if-absent with a time to live."""
    return f"""{name}_chain AS (
      SELECT {key} AS key, min({us}) AS us FROM {source} WHERE {key} IS NOT NULL GROUP BY 1
      UNION ALL
      SELECT c.key, min(s.{us}) FROM {name}_chain c JOIN {source} s ON s.{key} = c.key AND s.{us} >= c.us + {seconds}000000
      GROUP BY c.key, c.us),
    {name} AS (SELECT s.* FROM {source} s JOIN {name}_chain c ON s.{key} = c.key AND s.{us} = c.us
      QUALIFY row_number() OVER (PARTITION BY s.{key}, s.{us} ORDER BY s.arrival) = 1)"""
