"""Whole tables written to files of the engine and read back (A1, A3, A8, A9, A11, N2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconry.operators import alerts as H
from beaconry.plans.q_analytics import _FIRED, _M, PAYLOAD_SQL, _doubled
from beaconry.plans.registry import query
from beaconry.plans.views import sql
from beaconry.schemas import ENVELOPE
from beaconry.session import prepare, scratch_dir
from beaconry.sources import adapters as A, envelopes as E, store as S


@query("A1", sql("env", """SELECT batch_id, nonce, node_id, region_id, received_at, CAST(n_metrics AS INTEGER) AS n_metrics,
    CAST(cents AS DOUBLE) / 4000.0::DOUBLE * n_metrics AS last_latency FROM env"""))
def read_envelope_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(prepare(spark), "envelopes")
    rows = E.order_envelopes(spark, sf)
    rows.select(*spark.createDataFrame([], ENVELOPE).columns).write.json(path)
    out = E.read_envelopes(spark, path).where("_corrupt is null")
    return out.select("batch_id", "nonce", "node_id", "region_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"),
                      F.size("metrics").alias("n_metrics"), F.element_at("metrics", -1)["latency_ms"].alias("last_latency"))


@query("A3", sql("metrics", "SELECT arrival, node_id, time, latency_ms, uptime_pct, packet_loss, CAST(time AS DATE) AS date FROM metrics"))
def write_metric_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(prepare(spark), "metrics")
    S.write_metrics(A.metrics(spark, sf), path)
    return S.read_metrics(spark, path).select("arrival", "node_id", "time", "latency_ms", "uptime_pct", "packet_loss", "date")


@query("A8", sql("logs", """SELECT arrival, strftime(timestamp, '%Y.%m.%d') AS day, service, level, sha256(message) AS message_sha256, latency_ms
    FROM logs"""))
def write_log_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(prepare(spark), "logs")
    S.write_logs(A.logs(spark, sf), path)
    rows = spark.read.schema("arrival long, service string, level string, message string, latency_ms long, day string").json(path)
    return rows.select("arrival", "day", "service", "level", F.sha2(F.col("message").cast("binary"), 256).alias("message_sha256"), "latency_ms")


@query("A8", sql("native", """SELECT arrival, strftime(time, '%Y.%m') AS month, node_id, probe_type, CAST(latency_ms AS DOUBLE) AS latency_ms,
    make_timestamp(epoch_us(time) // 1000 * 1000) AS timestamp FROM native"""))
def write_event_files(spark: SparkSession, sf: str) -> DataFrame:
    """Event documents by month; JSON keeps milliseconds."""
    path = scratch_dir(prepare(spark), "events")
    rows = A.metrics(spark, sf, "native").select("arrival", "node_id", "probe_type", "latency_ms", F.col("time").alias("timestamp"))
    S.write_events(rows, path)
    back = spark.read.schema("arrival long, node_id string, probe_type string, latency_ms double, timestamp timestamp_ntz, month string").json(path)
    return back.select("arrival", "month", "node_id", "probe_type", "latency_ms", F.date_trunc("millisecond", "timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("A9", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'again' ELSE source END AS index,
    doc_id % 3 = 0 AS quarantined FROM documents""")
def replay_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the lines is cut short, a third names no index, a third is complete."""
    path = scratch_dir(prepare(spark), "dead-letters")
    d = A.table(spark, sf, "documents")
    plain = F.to_json(F.struct("doc_id", "n_chars"))
    full = F.to_json(F.struct(F.col("source").alias("_index"), F.struct("doc_id", "n_chars").alias("_source")))
    kind = F.col("doc_id") % 3
    line = F.when(kind == 0, F.concat(F.lit('{"doc_id": '), "doc_id")).when(kind == 1, plain).otherwise(full)
    d.select(line.alias("value")).write.text(path)
    good, bad = S.replay_dlq(S.read_dlq(spark, path), "again")
    good = good.select(F.get_json_object("_source", "$.doc_id").cast("long").alias("doc_id"), F.col("_index").alias("index"),
                       F.lit(False).alias("quarantined"))
    return good.unionByName(bad.select(F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("doc_id"),
                                       F.lit(None).cast("string").alias("index"), F.lit(True).alias("quarantined")))


@query("A3 A11", sql("native", "SELECT arrival, node_id, time, latency_ms FROM native"))
def compact_metric_files(spark: SparkSession, sf: str) -> DataFrame:
    """Days older than the age are rewritten in node order; every row is still there."""
    path = scratch_dir(prepare(spark), "compacted")
    rows = A.metrics(spark, sf, "native")
    S.write_metrics(rows, path)
    S.compact_old(spark, path, rows.agg(F.max("time")).first()[0])
    return S.read_metrics(spark, path).select("arrival", "node_id", "time", "latency_ms")


@query("H6 N2", sql("metrics", f"SELECT 'alert_fired' AS event, payload FROM ({PAYLOAD_SQL})", _M, _FIRED))
def dispatch_to_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(prepare(spark), "alert-log")
    if not H.dispatch(H.evaluate_rules(_doubled(spark, sf)), H.log_sink(f"{path}-lines"), f"{path}-dead"):
        raise RuntimeError("alerts were not delivered")
    lines = spark.read.text(f"{path}-lines")
    return lines.select(F.get_json_object("value", "$.event").alias("event"), F.get_json_object("value", "$.alert").alias("payload"))
