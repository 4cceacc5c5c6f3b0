"""Streaming queries over the test tables, run to the end of the input (K2, K5-K8 and stream forms of B4).

Each reads the whole table as a file stream, writes to the shared scratch folder and returns what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconry.plans import stored
from beaconry.plans.q_analytics import _H5, _ROLL
from beaconry.plans.q_ingest import ADMITTED, BUCKET_RUN
from beaconry.plans.q_rollups import REGION_ROLLUP, node_rollup_sql
from beaconry.plans.registry import query
from beaconry.plans.views import sql
from beaconry.session import prepare, scratch_dir
from beaconry.schemas import ENVELOPE
from beaconry.sources import adapters as A
from beaconry.sources.envelopes import SECRET, as_envelopes, order_envelopes, received_us
from beaconry.sources.snapshot import SnapshotTable
from beaconry.sources.store import compact_old, read_metrics
from beaconry.streaming import jobs, state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = A.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(df: DataFrame, name: str) -> DataFrame:
    """Drain the stream into Parquet and return the rows written."""
    spark = prepare(df.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = scratch_dir(spark, name)
    # state is cut into this many parts for good and adaptive execution cannot merge them: one per core is enough
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), spark.sparkContext.defaultParallelism)))
    try:
        q = (df.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
             .trigger(availableNow=True).start(f"{path}-rows"))
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.schema(df.schema).parquet(f"{path}-rows")


def _metrics(spark, sf):
    return A.as_metrics(table_stream(prepare(spark), sf, "events"))


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("K2", sql("metrics", f"SELECT * FROM r WHERE bucket + INTERVAL '1 minute' <= (SELECT date_trunc('millisecond', max(time)) FROM metrics) - INTERVAL '5 minutes'",
                 f"r AS ({node_rollup_sql('metrics', '1 minute')})"))
def stream_rollup_1m(spark, sf):
    """Buckets closed by the watermark."""
    return _ntz(run_to_end(jobs.stream_rollup(_metrics(spark, sf), "1 minute"), "rollup1m"), "bucket")


@query("K5 D1", sql("metrics", "SELECT DISTINCT node_id, date_trunc('second', time) AS second FROM metrics"))
def stream_dedup(spark, sf):
    out = run_to_end(jobs.stream_dedup(_metrics(spark, sf)), "dedup")
    return out.select("node_id", F.date_trunc("second", "time").cast("timestamp_ntz").alias("second"))


_NEWEST = "(SELECT date_trunc('millisecond', max(time)) FROM metrics)"


@query("K5 D1", sql("metrics", f"""SELECT node_id, time, arrival, latency_ms FROM (SELECT *, row_number() OVER (
    PARTITION BY node_id, date_trunc('second', time) ORDER BY arrival) AS place FROM metrics)
    WHERE place = 1 AND date_trunc('second', time) + INTERVAL '1 second' <= {_NEWEST} - INTERVAL '180 seconds'"""))
def stream_first_arrivals(spark, sf):
    """The first arrival of each node and second, of the seconds that the watermark has passed."""
    rows = _metrics(spark, sf).select("time", "node_id", "arrival", "latency_ms")
    return _ntz(run_to_end(jobs.stream_first_arrival(rows), "first").select("node_id", "time", "arrival", "latency_ms"), "time")


@query("K2", sql("metrics", f"SELECT * FROM r WHERE bucket + INTERVAL '5 minutes' <= {_NEWEST} - INTERVAL '20 minutes'",
                 f"r AS ({node_rollup_sql('metrics', '5 minutes')})"))
def stream_rollup_5m(spark, sf):
    return _ntz(run_to_end(jobs.stream_rollup(_metrics(spark, sf), "5 minutes"), "rollup5m"), "bucket")


@query("K2", sql("metrics nodes", f"SELECT * FROM r WHERE bucket + INTERVAL '5 minutes' <= {_NEWEST} - INTERVAL '15 minutes'",
                 f"r AS ({REGION_ROLLUP})"))
def stream_rollup_region(spark, sf):
    return _ntz(run_to_end(jobs.stream_region_rollup(_metrics(spark, sf), A.nodes(spark, sf)), "region5m"), "bucket")


@query("B4 B5", sql("env", "SELECT DISTINCT nonce FROM env"))
def stream_first_nonces(spark, sf):
    """Nonces that the stream lets through when they live longer than the input."""
    env = order_envelopes(spark, sf).select("nonce", "batch_id", F.col("received_at").cast("timestamp").alias("received_at"))
    path = scratch_dir(prepare(spark), "nonces")
    env.write.parquet(path)
    return run_to_end(jobs.stream_first_use(spark.readStream.schema(env.schema).parquet(path), "nonce", "100000 seconds"), "nonce").select("nonce")


@query("K6", sql("metrics", """SELECT arrival, node_id, CASE WHEN n >= 5 THEN CAST(((2 * s + n) // (2 * n)) / 100.0::DOUBLE AS DECIMAL(10,2)) END
    AS latency_avg_window, CASE WHEN n >= 5 THEN CAST(round(sd, 2) AS DECIMAL(10,2)) END AS latency_std_window FROM zs""", _ROLL))
def stream_anomaly(spark, sf):
    out = run_to_end(state.stream_anomaly(_metrics(spark, sf)), "anomaly")
    return out.select("arrival", "node_id", "latency_avg_window", "latency_std_window")


@query("K6", sql("metrics", """SELECT f.arrival, f.rule_no, CASE WHEN q.arrival IS NULL THEN 'dedup' WHEN q.hit > 5 THEN 'node_quota'
      WHEN s.ok THEN 'sent' ELSE 'global_limit' END AS disposition FROM fired f LEFT JOIN quota q USING (arrival, rule_no)
      LEFT JOIN sent s USING (arrival, rule_no)""", *_H5, recursive=True))
def stream_alerts(spark, sf):
    rows = _metrics(spark, sf).withColumn("latency_ms", (F.col("latency_ms") * 2).cast("decimal(10,2)"))
    return run_to_end(state.stream_alerts(rows), "alerts").select("arrival", "rule_no", "disposition")


@query("K7", sql("metrics", "SELECT arrival, allowed FROM run", *BUCKET_RUN, recursive=True))
def stream_token_bucket(spark, sf):
    rows = _metrics(spark, sf).select("node_id", "time", "arrival")
    return run_to_end(state.stream_token_bucket(rows, ["node_id"], "time", 0.01, 3), "bucket").select("arrival", "allowed")


@query("K8", sql("metrics", """SELECT node_id, probe_type AS active_target, time AS at, true AS live FROM metrics
    UNION ALL SELECT node_id, probe_type, time + INTERVAL '60 seconds', false FROM beats
    WHERE (following IS NULL OR epoch_us(following) - epoch_us(time) > 60000000)
      AND epoch_us(time) // 1000 + 60000 <= (SELECT max(epoch_us(time)) // 1000 - 10000 FROM metrics)""",
                 "beats AS (SELECT *, lead(time) OVER (PARTITION BY node_id ORDER BY time, arrival) AS following FROM metrics)"))
def stream_heartbeats(spark, sf):
    e = table_stream(prepare(spark), sf, "events")
    rows = A.as_metrics(e).select("node_id", F.col("probe_type").alias("active_target"), F.col("time").alias("timestamp"), "arrival")
    return _ntz(run_to_end(state.stream_heartbeats(rows), "heartbeats"), "at")


LATE_S = 300
#: Five arrivals of the dense hour: its quarters, with a tenth of the rows one quarter late.
_BATCH = "CAST(least(3, floor((epoch_us(time) - 1704067200000000) / 900000000)) + CASE WHEN arrival % 10 = 3 THEN 1 ELSE 0 END AS INTEGER)"


def _upkeep(spark: SparkSession, sf: str):
    """The hour sent through the upkeep stream in five micro-batches: (store, late rows)."""
    store = stored.new_store(spark, sf)
    path = scratch_dir(spark, "upkeep")
    rows = A.metrics(spark, sf).select(*stored.COLUMNS)
    quarter = F.least(F.lit(3), F.floor((A.micros("time") - A.EPOCH_US) / 900000000))
    rows = rows.withColumn("batch", (quarter + F.when(F.col("arrival") % 10 == 3, 1).otherwise(0)).cast("int"))
    for k in range(5):  # each run takes what has come since the last one
        rows.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(rows.drop("batch").schema).parquet(f"{path}/in")
        jobs.upkeep_stream(source, store, f"{path}/late", f"{path}/progress", f"{path}/checkpoint", LATE_S, ("5m_node", "hourly")).awaitTermination()
    return store, spark.read.parquet(f"{path}/late")


@query("K9 K3", sql("metrics", f"""SELECT arrival, node_id, time, batch AS epoch FROM (
    SELECT *, max(top) OVER (ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM (
      SELECT *, max(time) OVER (PARTITION BY batch) AS top FROM (SELECT *, {_BATCH} AS batch FROM metrics)))
    WHERE time < mark - INTERVAL '{LATE_S} seconds'"""))
def stream_late_rows(spark, sf):
    """Rows that came after their time was closed, with the micro-batch that brought them."""
    return _upkeep(prepare(spark), sf)[1].select("arrival", "node_id", "time", "epoch")


@query("K9 K3 F4", sql("metrics", node_rollup_sql("metrics", "1 hour")))
def stream_late_repair(spark, sf):
    """The hourly tier after five micro-batches with late rows, and a last refresh for the open buckets: as if made from all rows."""
    store, _ = _upkeep(prepare(spark), sf)
    store.refresh(("5m_node", "hourly"))
    return store.tier("hourly").drop("latency_sketch")


@query("K9 K3 F2", sql("metrics", f"""SELECT * FROM ({node_rollup_sql('metrics', '5 minutes')})
    WHERE bucket + INTERVAL '5 minutes' <= (SELECT max(time) FROM metrics) - INTERVAL '{LATE_S} seconds'"""))
def stream_late_repair_closed(spark, sf):
    """The five-minute tier as the stream leaves it: closed buckets hold their late rows, open ones are not there yet."""
    return _upkeep(prepare(spark), sf)[0].tier("5m_node").drop("latency_sketch")


_INGESTED: dict[tuple, str] = {}


def _ingested(spark: SparkSession, sf: str, cuts: tuple[int, ...]) -> str:
    """The envelopes through the ingest stream, a micro-batch per span of seconds of receipt; the folder of its tables.

    The tables are made once per session and table folder, and read by several queries.
    """
    ident = (spark.sparkContext.applicationId, sf, cuts)
    if ident in _INGESTED and SnapshotTable(spark, f"{_INGESTED[ident]}/metrics").versions():
        return _INGESTED[ident]
    path = scratch_dir(prepare(spark), "ingest")
    orders = A.table(spark, sf, "orders")
    second = F.floor((received_us() - A.EPOCH_US) / 1000000)
    span = F.size(F.filter(F.array(F.lit(-1), *[F.lit(c) for c in cuts]), lambda c: c <= second)) - 1
    for k in range(len(cuts) + 1):  # orders wait on disk; the stream makes their envelopes, which are many times as large
        orders.where(span == k).write.mode("append").parquet(f"{path}/in")
        source = as_envelopes(spark.readStream.schema(orders.schema).parquet(f"{path}/in")).select(*spark.createDataFrame([], ENVELOPE).columns)
        source = source.withColumn("received_at", F.col("received_at").cast("timestamp"))
        jobs.ingest_stream(source, f"{path}/out", f"{path}/checkpoint", SECRET, ("gh-accra", "ac-low", "ad-high")).awaitTermination()
    _INGESTED[ident] = f"{path}/out"
    return _INGESTED[ident]


_STORED = """SELECT node_id, make_timestamp(header_s * 1000000) AS time, us * 1000 AS arrival, CAST((cents % 10001) / 100.0 AS DECIMAL(5,2)) AS uptime_pct,
    CAST((cents % 1000) / 100.0 AS DECIMAL(5,2)) AS packet_loss FROM batches"""


def _stored_metrics(spark: SparkSession, out: str) -> DataFrame:
    rows = read_metrics(spark, f"{out}/metrics")
    return _ntz(rows.select("node_id", "time", "arrival", "uptime_pct", "packet_loss"), "time")


@query("K1 A4 D1", sql("env", _STORED, *ADMITTED, recursive=True))
def ingest_stream_metrics(spark, sf):
    """The metric table after one micro-batch: the first metric of each accepted envelope (its second one has the same second)."""
    return _stored_metrics(spark, _ingested(spark, sf, ()))


@query("K1 A4 A11 D1", sql("env", _STORED, *ADMITTED, recursive=True))
def ingest_stream_compacted(spark, sf):
    """The same after three micro-batches and a compaction of the ingested table."""
    out = _ingested(spark, sf, (800, 1600))
    compact_old(spark, f"{out}/metrics", "2024-02-01 00:00:00")
    return _stored_metrics(spark, out)


@query("K1 F16", sql("env", """SELECT count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_failed,
    CAST(count(*) FILTER (WHERE n_metrics > 1) AS BIGINT) AS duplicate_count FROM batches""", *ADMITTED, recursive=True))
def ingest_stream_summary(spark, sf):
    """Counters of three micro-batches added up."""
    rows = spark.read.parquet(f"{_ingested(spark, sf, (800, 1600))}/summary")
    return rows.agg(*[F.sum(c).alias(c) for c in ("rows_processed", "rows_failed", "duplicate_count")])
