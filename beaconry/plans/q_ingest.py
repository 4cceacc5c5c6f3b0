"""Admission, normalisation, deduplication and node queries (A2-A7, A10, B1-B11, C1-C18, D1-D4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import scalar, state
from beaconry.functions.timeutil import age_seconds
from beaconry.operators import admission as B, dedup as D, nodes as N, normalize as C, prefix
from beaconry.plans.registry import query
from beaconry.plans.views import VIEWS, chain, sql
from beaconry.sources import adapters as A, store
from beaconry.sources.envelopes import SECRET, explode_batch, order_envelopes

NOW = "2024-01-01 01:00:00"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- envelopes --------------------------------------------------------------------------------------------------

_SLUG = "lower(country) || '-' || lower(replace(region, ' ', '-'))"
_SIGNED = "batch_id IS NOT NULL"
_REGION = f"coalesce(region_id, {_SLUG})"


@query("A2", sql("env", """SELECT batch_id, received_at, arrival, CAST(i - 1 AS INTEGER) AS pos, node_id,
    country, region, CAST(cents AS DOUBLE) / 4000.0::DOUBLE * i AS latency_ms
    FROM env, unnest(generate_series(1, least(n_metrics, 2))) AS t(i)"""))
def explode_batch_rows(spark, sf):
    out = explode_batch(order_envelopes(spark, sf), ("batch_id", "received_at", "arrival"))
    return out.select("batch_id", "received_at", "arrival", "pos", "node_id", "country", "region", "latency_ms")


@query("B1", sql("env", """SELECT arrival, pos, concat_ws(',',
      CASE WHEN latency_ms > 10000 THEN 'latency_ms' END, CASE WHEN uptime_pct > 100 THEN 'uptime_pct' END,
      CASE WHEN packet_loss > 100 THEN 'packet_loss' END, CASE WHEN bad_ts THEN 'timestamp' END) AS bad_fields
    FROM (SELECT arrival, CAST(i - 1 AS INTEGER) AS pos, bad_ts, CAST(cents AS DOUBLE) / 4000.0::DOUBLE * i AS latency_ms,
      cents % 10001 / 100.0::DOUBLE AS uptime_pct, cents % 1000 / 100.0::DOUBLE AS packet_loss
      FROM env, unnest(generate_series(1, least(n_metrics, 2))) AS t(i))"""))
def validate_schema(spark, sf):
    rows = explode_batch(order_envelopes(spark, sf), ("arrival",))
    return B.validate_schema(rows).select("arrival", "pos", F.array_join("bad_fields", ",").alias("bad_fields"))


@query("B2", sql("env", f"SELECT arrival, NOT ({_SIGNED}) OR NOT odd AS signature_ok FROM env"))
def verify_signature(spark, sf):
    return B.verify_signature(order_envelopes(spark, sf), SECRET).select("arrival", "signature_ok")


@query("B3", sql("env", f"""SELECT arrival, CASE WHEN {_SIGNED} THEN NOT bad_ts AND abs(us - header_s * 1000000) <= 300000000
    ELSE true END AS fresh FROM env"""))
def check_freshness(spark, sf):
    return B.check_freshness(order_envelopes(spark, sf), F.col("received_at")).select("arrival", "fresh")


@query("B4", sql("env", "SELECT arrival, arrival NOT IN (SELECT arrival FROM kept) AS replayed FROM env",
                 chain("kept", "env", "nonce", "us", 600), recursive=True))
def reject_replays(spark, sf):
    return B.reject_replays(order_envelopes(spark, sf)).select("arrival", "replayed")


@query("B5", sql("env", """SELECT arrival, CASE WHEN batch_id IS NULL THEN 'missing_batch_id'
    WHEN arrival IN (SELECT arrival FROM kept) THEN 'new' ELSE 'already_processed' END AS batch_status FROM env""",
                 chain("kept", "env", "batch_id", "us", 600), recursive=True))
def idempotent_batches(spark, sf):
    return B.idempotent_batches(order_envelopes(spark, sf)).select("arrival", "batch_status")


@query("B6", sql("env", f"SELECT arrival, {_REGION} AS source_region FROM env"))
def derive_region(spark, sf):
    return B.derive_region(order_envelopes(spark, sf)).select("arrival", "source_region")


_ALLOWED = ("gh-accra", "ac-low", "ad-high")


@query("B7", sql("env", f"""SELECT count(*) FILTER (WHERE {_REGION} NOT IN ('gh-accra', 'ac-low', 'ad-high', 'unknown'))
    AS ingest_rejection_count FROM env"""))
def region_rejections(spark, sf):
    return B.region_rejections(B.check_region(B.derive_region(order_envelopes(spark, sf)), _ALLOWED))


@query("B7", sql("env", f"""SELECT arrival, {_REGION} AS source_region,
    {_REGION} IN ('gh-accra', 'ac-low', 'ad-high', 'unknown') AS region_known, false AS region_rejected FROM env"""))
def check_region_lenient(spark, sf):
    out = B.check_region(B.derive_region(order_envelopes(spark, sf)), _ALLOWED, mode="lenient")
    return out.select("arrival", "source_region", "region_known", "region_rejected")


@query("B8", sql("env", f"""SELECT arrival, 1 AS schema_version, received_at AS ingested_at, 'central' AS ingested_by,
    {_REGION} AS source_region FROM env"""))
def enrich_provenance(spark, sf):
    df = B.derive_region(order_envelopes(spark, sf))
    return B.enrich_provenance(df, F.col("received_at"), "central").select("arrival", "_meta.*")


BUCKET_RUN = (
    """req AS (SELECT *, epoch_us(time) / 1000000.0::DOUBLE AS s,
      row_number() OVER (PARTITION BY node_id ORDER BY time, arrival) AS rn FROM metrics)""",
    """run AS (
      SELECT node_id, rn, arrival, 3.0::DOUBLE AS filled, true AS allowed, 2.0::DOUBLE AS tokens, s AS last FROM req WHERE rn = 1
      UNION ALL
      SELECT node_id, rn, arrival, level, level >= 1, CASE WHEN level >= 1 THEN level - 1 ELSE tokens END,
             CASE WHEN level >= 1 THEN s ELSE last END
      FROM (SELECT q.node_id, q.rn, q.arrival, q.s, r.tokens, r.last,
                   least(3.0::DOUBLE, r.tokens + greatest(0, q.s - r.last) * 0.01::DOUBLE) AS level
            FROM run r JOIN req q ON q.node_id = r.node_id AND q.rn = r.rn + 1))""")


@query("B9", sql("metrics", "SELECT arrival, allowed, round(filled - allowed::INTEGER, 6) AS remaining FROM run", *BUCKET_RUN,
                 recursive=True))
def token_bucket(spark, sf):
    out = B.token_bucket(A.metrics(spark, sf), ["node_id"], "time", 0.01, 3, ["arrival"])
    return out.select("arrival", "allowed", F.round("remaining", 6).alias("remaining"))



@query("B10", sql("metrics", """SELECT arrival, hit, hit <= 5 AS allowed FROM (
      SELECT m.arrival, row_number() OVER (PARTITION BY m.node_id, w.us ORDER BY m.us, m.arrival) AS hit
      FROM m ASOF JOIN kept_chain w ON m.node_id = w.key AND m.us >= w.us)""",
                  "m AS (SELECT node_id, epoch_us(time) AS us, arrival FROM metrics)",
                  chain("kept", "m", "node_id", "us", 600), recursive=True))
def fixed_window_quota(spark, sf):
    return B.fixed_window_quota(A.metrics(spark, sf), ["node_id"], "time", 5, 600, ["arrival"]).select(
        "arrival", "hit", "allowed")


@query("B11", sql("env", """SELECT arrival, CASE WHEN arrival % 50 = 7 THEN 'too_many_metrics' WHEN arrival % 5000 = 1 THEN 'batch_too_large'
    WHEN arrival % 20 = 3 THEN 'metric_too_large' END AS limit_error FROM env"""))
def check_limits(spark, sf):
    """Some envelopes get 1,001 metrics, some a body beyond ten megabytes, some a metric beyond four kilobytes; one at its limit passes."""
    env, at = order_envelopes(spark, sf), F.col("arrival")
    first = F.element_at("metrics", 1)
    long = F.transform("metrics", lambda m: m.withField("metadata", F.create_map(F.lit("note"), F.repeat(F.lit("x"), 5000))))
    many = F.when(at % 50 == 7, 1001).when(at % 50 == 8, 1000)
    env = env.withColumn("metrics", F.when(many.isNotNull(), F.array_repeat(first, many)).when(at % 20 == 3, long).otherwise(F.col("metrics")))
    env = env.withColumn("body", F.when(at % 5000 == 1, F.repeat(F.lit("y"), 10 * 1024 * 1024 + 1)).otherwise(F.col("body")))
    return B.check_limits(env).select("arrival", "limit_error")


#: CTEs from the envelopes to those accepted (``batches``).
ADMITTED = (f"""checked AS (SELECT *, CASE WHEN batch_id IS NULL THEN 'missing_batch_id'
          WHEN bad_ts OR abs(us - header_s * 1000000) > 300000000 THEN 'stale_timestamp' END AS reason,
          {_REGION} IN ('gh-accra', 'ac-low', 'ad-high', 'unknown') AS known FROM env)""",
      "fresh AS (SELECT * FROM checked WHERE reason IS NULL)", chain("burned", "fresh", "nonce", "us", 600),
      "good AS (SELECT * FROM burned WHERE NOT odd AND known AND cents * n_metrics <= 40000000)", chain("batches", "good", "batch_id", "us", 600))


@query("B1 B2 B3 B4 B5 B7 B11", sql("env", """SELECT e.arrival, coalesce(e.reason, CASE WHEN n.arrival IS NULL THEN 'nonce_replay'
      WHEN e.odd THEN 'bad_signature' WHEN e.cents * e.n_metrics > 40000000 THEN 'invalid_payload' WHEN NOT e.known THEN 'invalid_region' WHEN b.arrival IS NULL THEN 'already_processed' END) AS reason
    FROM checked e LEFT JOIN burned n USING (arrival) LEFT JOIN batches b USING (arrival)""",
      *ADMITTED,
      recursive=True))
def admit_envelopes(spark, sf):
    return B.admit(order_envelopes(spark, sf), SECRET, _ALLOWED).select("arrival", "reason")


# --- first wins, conflicts, nodes -------------------------------------------------------------------------------

# second-resolution times collide; earlier 'view' rows stand for the existing table
_SEC = """sec AS (SELECT * REPLACE (date_trunc('second', time) AS time) FROM metrics)"""
_OLD = "old AS (SELECT * FROM sec WHERE probe_type = 'view' QUALIFY row_number() OVER (PARTITION BY time, node_id ORDER BY arrival) = 1)"
_FRESH = "fresh AS (SELECT *, row_number() OVER (PARTITION BY time, node_id ORDER BY arrival) AS rn FROM sec WHERE probe_type <> 'view')"


def _second_metrics(spark, sf):
    m = A.metrics(spark, sf).withColumn("time", F.date_trunc("second", "time").cast("timestamp_ntz"))
    old = D.first_per(m.where(F.col("probe_type") == "view"), ["time", "node_id"], ["arrival"])
    return m.where(F.col("probe_type") != "view"), old


@query("A4", sql("metrics", """SELECT time, node_id, latency_ms, arrival FROM fresh WHERE rn = 1
    AND (time, node_id) NOT IN (SELECT (time, node_id) FROM old)""", _SEC, _OLD, _FRESH))
def insert_first_wins(spark, sf):
    new, old = _second_metrics(spark, sf)
    return D.insert_first_wins(new, old).select("time", "node_id", "latency_ms", "arrival")


@query("A5", sql("metrics", """SELECT time, node_id, arrival, 'unknown' AS ingest_region FROM fresh WHERE rn > 1
    OR (time, node_id) IN (SELECT (time, node_id) FROM old)""", _SEC, _OLD, _FRESH))
def conflict_audit(spark, sf):
    new, old = _second_metrics(spark, sf)
    out = D.conflict_audit(new, old)
    arrival = F.get_json_object("payload", "$.arrival").cast("long")
    return out.select("time", "node_id", arrival.alias("arrival"), "ingest_region")


@query("A6", sql("metrics nodes", f"""SELECT node_id, CASE WHEN n.node_name IS NULL THEN 'probe-' || substr(node_id, 1, 8)
    ELSE n.node_name END AS node_name, coalesce(n.status, 'registered') AS status, coalesce(n.country, b.country) AS country,
    coalesce(n.region, 'Unknown') AS region,
    CASE WHEN n.node_name IS NOT NULL AND b.country IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_seen_at
    FROM nodes n FULL JOIN
      (SELECT node_id, upper(substr(arg_min(probe_type, arrival), 1, 2)) AS country FROM metrics GROUP BY 1) b USING (node_id)"""))
def upsert_nodes(spark, sf):
    nodes = A.nodes(spark, sf).select(
        "node_id", "node_name", "status", "country", "region", F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    batch = A.metrics(spark, sf).select(
        "node_id", scalar.country_code(F.col("probe_type")).alias("country"),
        F.lit(None).cast("string").alias("region"), "arrival")
    return N.upsert_nodes(nodes, batch, ntz(NOW))


_CHANGES = """changes AS (SELECT CASE WHEN event_type IN ('error', 'click') THEN 'delete' ELSE 'create' END AS op,
    'probe-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS node_id,
    CASE WHEN event_type = 'view' THEN 'inactive' ELSE 'registered' END AS status, event_id AS seq FROM events)"""
_JUDGED = """judged AS (SELECT c.*, CASE WHEN op = 'create' AND c.status <> 'registered' THEN 'bad_status'
      WHEN op = 'create' AND there THEN 'already_exists' WHEN op = 'delete' AND NOT there THEN 'not_found' END AS reason
    FROM (SELECT c.*, k.node_id IS NOT NULL OR coalesce(b.birth < c.seq, false) AS there FROM changes c
      LEFT JOIN known k USING (node_id)
      LEFT JOIN (SELECT node_id, min(seq) AS birth FROM changes WHERE op = 'create' AND status = 'registered' GROUP BY 1) b
      USING (node_id)) c)"""
_KNOWN = "known AS (SELECT * FROM nodes WHERE status = 'reporting')"


def _changes(spark, sf):
    e = A.table(spark, sf, "events")
    changes = e.select(
        F.when(F.col("event_type").isin("error", "click"), "delete").otherwise("create").alias("op"),
        A.node_key("user_id").alias("node_id"),
        F.when(F.col("event_type") == "view", "inactive").otherwise("registered").alias("status"),
        F.lit("AA").alias("country"), F.lit("ASIA").alias("region"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"),
        F.col("event_id").alias("seq"))
    known = A.nodes(spark, sf).where(F.col("status") == "reporting")
    return N.apply_node_changes(known, changes)


@query("A7", sql("nodes", """SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM judged WHERE op = 'delete' AND reason IS NULL)
    THEN 'deleted' ELSE status END AS status FROM (SELECT node_id, status FROM known UNION ALL SELECT DISTINCT node_id, 'registered'
    FROM judged WHERE op = 'create' AND reason IS NULL)""", _KNOWN, _CHANGES, _JUDGED))
def apply_node_changes(spark, sf):
    return _changes(spark, sf)[0].select("node_id", "status")


@query("A7", sql("nodes", "SELECT seq, op, node_id, reason FROM judged WHERE reason IS NOT NULL", _KNOWN, _CHANGES, _JUDGED))
def rejected_node_changes(spark, sf):
    return _changes(spark, sf)[1].select("seq", "op", "node_id", "reason")


# --- normalisation and scalar functions -------------------------------------------------------------------------


@query("C3 C4 C6", """SELECT event_id AS arrival, greatest(value - 50, 0) AS latency_ms,
      least(greatest(CASE WHEN k % 10 = 0 THEN 100 ELSE k * 2.0::DOUBLE END, 0), 100) AS uptime_pct,
      least(greatest(k * 3.0::DOUBLE - 30, 0), 100) AS packet_loss, upper(substr(event_type, 1, 2)) AS country,
      CASE WHEN event_type = 'view' THEN 'Unknown' ELSE event_type END AS region, ts AS time
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def normalize_metrics(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = A.table(spark, sf, "events").select(
        A.node_key("user_id").alias("node_id"), F.col("event_type").alias("country"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("region"),
        (F.col("value") - 50).cast("string").alias("latency_ms"),
        F.when(k % 10 == 0, "n/a").otherwise((k * 2).cast("string")).alias("uptime_pct"),
        (k * 3 - 30).cast("string").alias("packet_loss"), F.col("ts").cast("string").alias("timestamp"),
        F.create_map(F.lit("k_count"), k.cast("string")).alias("metadata"), F.col("event_id").alias("arrival"))
    out = C.is_valid(C.normalize(raw, F.lit("2024-01-01 00:00:00")))
    return out.select("arrival", "latency_ms", "uptime_pct", "packet_loss", "country", "region",
                      F.col("time").cast("timestamp_ntz").alias("time"))


@query("C1 C2 C5 C17", """SELECT event_id AS arrival, 'probe-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS node_id,
    CAST(CAST(json_extract(props, '$.k') AS DOUBLE) AS VARCHAR) AS k_count FROM events WHERE event_type <> 'error'""")
def parse_metadata(spark, sf):
    k = F.get_json_object("props", "$.k")
    meta = F.create_map(F.lit("k_count"), k, F.lit("type"), F.when(F.col("event_type") == "error", "health").otherwise("ping"))
    raw = A.table(spark, sf, "events").select(
        A.node_key("user_id").alias("node_id"), F.col("ts").cast("string").alias("timestamp"),
        scalar.normalize_metadata(meta).alias("metadata"), F.col("event_id").alias("arrival"))
    rest, _ = C.split_health(raw)
    return rest.select("arrival", "node_id", F.col("metadata")["k_count"].alias("k_count"))


@query("C17", """SELECT 'probe-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS node_id, CAST(k AS DOUBLE) AS cpu_pct, CAST(NULL AS DOUBLE) AS mem_pct,
    CAST(k * 2 AS BIGINT) AS push_ok, CASE WHEN k % 2 = 0 THEN CAST(k AS BIGINT) END AS push_err
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type = 'error'""")
def split_health_reports(spark, sf):
    """The self-reports; what cannot be read as a number is null."""
    k = F.get_json_object("props", "$.k").cast("int")
    meta = F.create_map(F.lit("type"), F.when(F.col("event_type") == "error", "health").otherwise("ping"), F.lit("cpu_pct"), k.cast("string"),
                        F.lit("mem_pct"), F.lit("n/a"), F.lit("push_ok"), (k * 2).cast("string"), F.lit("push_err"), F.when(k % 2 == 0, k.cast("string")))
    raw = A.table(spark, sf, "events").select(A.node_key("user_id").alias("node_id"), F.col("ts").cast("string").alias("timestamp"), meta.alias("metadata"))
    return C.split_health(raw)[1].drop("timestamp")


@query("C7", sql("nodes", """SELECT node_id, slug, shown_slug, region || '/' || country AS label FROM nodes"""))
def region_slugs(spark, sf):
    c, r = F.col("country"), F.col("region")
    return A.nodes(spark, sf).select(
        "node_id", scalar.region_slug(c, r).alias("slug"), scalar.region_slug_display(c, r).alias("shown_slug"),
        scalar.region_label(c, r).alias("label"))


_COORDS = (("Asia", 30.5, 100.5, "AS"), ("Africa", 1.5, 20.5, "AF"), ("MIDDLE EAST", 25.5, 45.5, "ME"))


@query("C8", sql("nodes", """SELECT node_id, CASE region WHEN 'ASIA' THEN 'Asia' WHEN 'AFRICA' THEN 'Africa' WHEN 'MIDDLE EAST'
    THEN 'MIDDLE EAST' WHEN 'EUROPE' THEN 'Africa' END AS geo_key, CASE region WHEN 'ASIA' THEN 30.5::DOUBLE
    WHEN 'AFRICA' THEN 1.5::DOUBLE WHEN 'MIDDLE EAST' THEN 25.5::DOUBLE WHEN 'EUROPE' THEN 1.5::DOUBLE END AS geo_lat FROM nodes"""))
def geo_lookup(spark, sf):
    out = C.geo_lookup(A.nodes(spark, sf), coords=_COORDS, aliases={"europe": "Africa"})
    return out.select("node_id", "geo_key", "geo_lat")


_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(time)) / 1000000.0::DOUBLE"


@query("C9", sql("metrics", f"""SELECT arrival, CASE WHEN floor(a) < 60 THEN CAST(floor(a) AS BIGINT) || 's ago'
    ELSE CAST(floor(a / 60) AS BIGINT) || 'm ago' END AS seen FROM (SELECT arrival, {_AGE} AS a FROM metrics)"""))
def time_since(spark, sf):
    m = A.metrics(spark, sf)
    return m.select("arrival", scalar.time_since(age_seconds(m, "time", NOW)).alias("seen"))


STATE_SQL = """CASE WHEN {age} > {stale} THEN 'STALE' WHEN latency_ms > 200 OR packet_loss > 5 THEN 'CRITICAL'
    WHEN latency_ms > 100 OR packet_loss > 1 THEN 'DEGRADED' ELSE 'HEALTHY' END"""


@query("C10 C11", sql("metrics", f"""SELECT arrival, state, CASE state WHEN 'HEALTHY' THEN 'SECURED' WHEN 'DEGRADED' THEN 'CONTESTED'
    WHEN 'CRITICAL' THEN 'COMPROMISED' ELSE 'BLACKOUT' END AS label, CASE state WHEN 'CRITICAL' THEN 3 WHEN 'DEGRADED' THEN 2
    WHEN 'STALE' THEN 1 ELSE 0 END AS weight FROM (SELECT arrival, {STATE_SQL.format(age=_AGE, stale=1800)} AS state FROM metrics)"""))
def node_states(spark, sf):
    m = A.metrics(spark, sf)
    s = state.node_state(age_seconds(m, "time", NOW), F.col("latency_ms"), F.col("packet_loss"), 1800)
    return m.select("arrival", s.alias("state")).select(
        "*", state.authority_label(F.col("state")).alias("label"), state.severity_weight(F.col("state")).alias("weight"))


@query("C12", sql("metrics", """SELECT arrival, CASE WHEN latency_ms > 150 THEN 'critical' WHEN latency_ms > 100 THEN 'degraded' ELSE 'healthy' END
    AS latency_band, CASE WHEN uptime_pct < 98 THEN 'critical' WHEN uptime_pct < 99.5 THEN 'degraded' ELSE 'healthy' END AS uptime_band,
    CASE WHEN packet_loss > 2 THEN 'critical' WHEN packet_loss > 0.5 THEN 'degraded' ELSE 'neutral' END AS loss_band FROM metrics"""))
def kpi_bands(spark, sf):
    return A.metrics(spark, sf).select(
        "arrival", state.latency_band(F.col("latency_ms")).alias("latency_band"),
        state.uptime_band(F.col("uptime_pct")).alias("uptime_band"), state.loss_band(F.col("packet_loss")).alias("loss_band"))


@query("C15", sql("metrics", """SELECT node_id, 100.0::DOUBLE * (1.0::DOUBLE - CAST(d AS DOUBLE) / CAST(n AS DOUBLE)) AS availability_pct FROM (
    SELECT node_id, count(*) AS n, count(*) FILTER (WHERE uptime_pct < 100) AS d FROM metrics GROUP BY 1)"""))
def availability(spark, sf):
    out = A.metrics(spark, sf).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("uptime_pct") < 100).alias("d"))
    return out.select("node_id", scalar.availability_pct(F.col("n"), F.col("d")).alias("availability_pct"))


@query("C16", sql("heartbeats", """SELECT service, CASE WHEN lag <= 30 THEN 'healthy' WHEN lag <= 60 THEN 'degraded' ELSE 'down' END AS state FROM (
    SELECT node_id AS service, (epoch_us(TIMESTAMP '2024-01-01 01:00:00') - epoch_us(max(timestamp))) / 1000000.0::DOUBLE AS lag
    FROM heartbeats GROUP BY 1)"""))
def etl_health(spark, sf):
    hb = A.heartbeats(spark, sf)
    last = hb.groupBy(F.col("node_id").alias("service")).agg(F.max("timestamp").alias("last"))
    return last.select("service", state.etl_state(age_seconds(last, "last", NOW)).alias("state"))


@query("C18", sql("metrics nodes", f"""SELECT n.node_id, CASE WHEN max(time) IS NULL THEN 'unknown' WHEN
    (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(time))) / 1000000.0::DOUBLE < 300 THEN 'healthy' ELSE 'unhealthy' END AS health
    FROM nodes n LEFT JOIN metrics m USING (node_id) GROUP BY 1"""))
def fleet_health(spark, sf):
    seen = A.metrics(spark, sf).groupBy("node_id").agg(F.max("time").alias("last"))
    both = A.nodes(spark, sf).select("node_id").join(seen, "node_id", "left")
    return both.select("node_id", state.fleet_health(age_seconds(both, "last", NOW)).alias("health"))


# --- deduplication ----------------------------------------------------------------------------------------------


@query("D1", sql("metrics", """SELECT arrival, time, node_id, latency_ms FROM metrics
    QUALIFY row_number() OVER (PARTITION BY node_id, date_trunc('second', time) ORDER BY arrival) = 1"""))
def dedup_metrics(spark, sf):
    return D.dedup_metrics(A.metrics(spark, sf)).select("arrival", "time", "node_id", "latency_ms")


@query("D2", sql("metrics", """SELECT node_id, time, latency_ms, arrival FROM metrics
    QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY time DESC, arrival) = 1"""))
def latest_per_node(spark, sf):
    return D.latest_per_node(A.metrics(spark, sf)).select("node_id", "time", "latency_ms", "arrival")


@query("D4", sql("metrics", "SELECT node_id, time, arrival FROM kept",
                 "m AS (SELECT *, epoch_us(time) AS us FROM metrics WHERE latency_ms * 2 > 200)",
                 chain("kept", "m", "node_id", "us", 900), recursive=True))
def greedy_cooldown(spark, sf):
    hits = A.metrics(spark, sf).where(F.col("latency_ms") * 2 > 200).select("node_id", "time", "arrival")
    return prefix.windows(hits, ["node_id"], "time", 900, ["arrival"]).where("kept").drop("kept", "anchor", "hit")


@query("A10", sql("native", "SELECT arrival, time FROM native WHERE time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '7 days'"))
def apply_retention(spark, sf):
    return store.apply_retention(A.metrics(spark, sf, "native"), "time", "7 days", "2024-01-31 00:00:00").select("arrival", "time")


def _chain_sql(key: str, us: str, where: str = "true") -> str:
    """Rows kept by a cooldown of 30 seconds and hits since, of the rows numbered by key, time and arrival."""
    return f"""WITH RECURSIVE {VIEWS['metrics']},
    rows AS (SELECT arrival, {key} AS key, {us} AS us FROM metrics WHERE {where}),
    c AS (SELECT key, min(us) AS us FROM rows GROUP BY 1
          UNION ALL SELECT c.key, min(r.us) FROM c JOIN rows r ON r.key = c.key AND r.us >= c.us + 30000000 GROUP BY c.key, c.us),
    spans AS (SELECT key, us, lead(us) OVER (PARTITION BY key ORDER BY us) AS following FROM c)
    SELECT arrival, row_number() OVER (PARTITION BY r.key, s.us ORDER BY r.us, arrival) AS hit, hit = 1 AS kept
    FROM rows r JOIN spans s ON s.key = r.key AND r.us >= s.us AND (s.following IS NULL OR r.us < s.following)"""


@query("D4 B10 H2 H3", _chain_sql("'fleet'", "epoch_us(time)"))
def fleet_wide_windows(spark, sf):
    """One key for all rows: the cooldown and the counted windows of the whole fleet."""
    rows = A.metrics(spark, sf).select(F.lit("fleet").alias("key"), "time", "arrival")
    return prefix.windows(rows, ["key"], "time", 30, ["arrival"]).select("arrival", "hit", "kept")


@query("D4 B10 H2 H3", _chain_sql("probe_type", "1704067200000000 + (epoch_us(time) - 1704067200000000) // 1800000000 * 1800000000"))
def one_instant_windows(spark, sf):
    """Few keys whose rows fall on two instants each."""
    us = F.floor((A.micros("time") - A.EPOCH_US) / 1800000000) * 1800000000 + A.EPOCH_US
    rows = A.metrics(spark, sf).select("probe_type", A.from_micros(us).alias("at"), "arrival")
    return prefix.windows(rows, ["probe_type"], "at", 30, ["arrival"]).select("arrival", "hit", "kept")
