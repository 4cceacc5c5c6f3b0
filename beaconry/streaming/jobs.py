"""Streaming jobs without custom state: rollups, duplicate removal, late rows and the ingest job."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconry.functions import exact
from beaconry.functions.scalar import region_slug
from beaconry.operators import admission, alerts, dedup, nodes as node_ops, normalize, prefix, states
from beaconry.operators.ordered import stored
from beaconry.operators.rollups import rollup
from beaconry.session import passing, scratch_dir
from beaconry.sources.envelopes import explode_batch
from beaconry.sources.rollup_store import RollupStore
from beaconry.sources.snapshot import SnapshotTable
from beaconry.sources.store import METRIC_TYPES, write_metrics
from beaconry.streaming import carried

# Time to live of a duplicate key; lateness each rollup waits for.
DEDUP_TTL_S = 180
LATENESS = {"1 minute": "5 minutes", "5 minutes": "20 minutes", "region": "15 minutes"}


def event_time(df: DataFrame, name: str = "time") -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn(name, F.col(name).cast("timestamp"))


def stream_rollup(df: DataFrame, width: str, lateness: str | None = None) -> DataFrame:
    """Tumbling node rollup in append mode: a bucket comes out once the watermark passed its end."""
    return rollup(event_time(df).withWatermark("time", lateness or LATENESS.get(width, width)), width)


def stream_region_rollup(df: DataFrame, nodes: DataFrame, width: str = "5 minutes",
                         lateness: str = LATENESS["region"]) -> DataFrame:
    dim = nodes.select("node_id", region_slug(F.col("country"), F.col("region")).alias("region"))
    rows = event_time(df).withWatermark("time", lateness).join(dim, "node_id")
    out = rows.groupBy(F.window("time", width).alias("_w"), "region").agg(
        exact.mean(df, "latency_ms").alias("avg_latency"), *exact.partial(df, "latency_ms", "lat"),
        F.sum(states.square(exact.units(df, "latency_ms"))).alias("lat_sq"),
        exact.mean(df, "packet_loss").alias("avg_loss"), exact.mean(df, "uptime_pct").alias("avg_uptime"),
        F.count(F.lit(1)).alias("samples"))
    spread = states.deviation(F.col("lat_sum"), F.col("lat_sq"), F.col("lat_n"), exact.scale_of(df, "latency_ms") or 0)
    return out.select(F.col("_w.start").alias("bucket"), "region", "avg_latency", spread.alias("std_latency"), "avg_loss", "avg_uptime", "samples")


def stream_dedup(df: DataFrame, ttl: str = "180 seconds", received: str | None = None) -> DataFrame:
    """One row per node and second; state is dropped ``ttl`` behind the watermark of the arrival (or event) time."""
    at = received or "time"
    rows = event_time(df, at).withWatermark(at, ttl).withColumn("_second", F.date_trunc("second", "time"))
    return rows.dropDuplicatesWithinWatermark(["node_id", "_second"]).drop("_second")


def stream_first_arrival(df: DataFrame, lateness: str = "180 seconds") -> DataFrame:
    """One row per node and second, the one with the smallest ``arrival`` whatever the micro-batches and their order.

    A second comes out once the watermark of the event time, ``lateness`` behind the newest, has passed it; then its state goes.
    """
    rows = event_time(df).withWatermark("time", lateness)
    kept = [c for c in df.columns if c not in ("time", "node_id")]
    first = F.min_by(F.struct(F.col("time").alias("at"), *kept), "arrival").alias("_first")
    out = rows.groupBy(F.window("time", "1 second").alias("_w"), "node_id").agg(first)
    return out.select(F.col("_first.at").alias("time"), "node_id", *[F.col(f"_first.{c}").alias(c) for c in kept])


def stream_first_use(df: DataFrame, key: str, ttl: str = "600 seconds") -> DataFrame:
    """Envelopes whose nonce or batch id was not used within the TTL."""
    return event_time(df, "received_at").withWatermark("received_at", ttl).dropDuplicatesWithinWatermark([key])


def epoch_writer(path: str, partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """Writer of one micro-batch into ``epoch=<id>`` folders, overwritten when the batch is replayed."""

    def write(df: DataFrame, epoch: int) -> None:
        cols = [partition] if partition else []
        df.write.mode("overwrite").partitionBy(*cols).parquet(f"{path}/epoch={epoch}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _late(batch: DataFrame, epoch: int, progress: str, lateness_s: int) -> tuple[Column, datetime | None]:
    """(condition of late rows, newest time up to this batch); the newest time of each batch is kept in ``progress``."""
    spark, mark = batch.sparkSession, None
    if _exists(spark, progress):
        mark = spark.read.parquet(progress).where(F.col("epoch") < epoch).agg(F.max("newest").cast("timestamp_ntz")).first()[0]
    time = F.col("time").cast("timestamp_ntz")
    old = F.lit(False) if mark is None else time < F.lit(mark).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(lateness_s))
    newest = batch.agg(F.max(F.col("time").cast("timestamp")).alias("newest"))
    epoch_writer(progress)(newest, epoch)
    last = spark.read.parquet(progress).where(F.col("epoch") <= epoch).agg(F.max("newest").cast("timestamp_ntz")).first()[0]
    return old, last


def route_late(df: DataFrame, main: str, late: str, progress: str, checkpoint: str, lateness_s: int,
               once: bool = True) -> StreamingQuery:
    """Split a metric stream: rows older than the newest time of earlier batches minus the lateness go to ``late``.

    The newest time per batch is kept in the small ``progress`` table, so a restarted job routes alike.
    """
    put_main, put_late = epoch_writer(main), epoch_writer(late)

    def run(batch: DataFrame, epoch: int) -> None:
        old, _ = _late(batch, epoch, progress, lateness_s)
        put_main(batch.where(~old), epoch)
        put_late(batch.where(old), epoch)

    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upkeep_stream(df: DataFrame, store: RollupStore, late: str, progress: str, checkpoint: str, lateness_s: int,
                  tiers: tuple[str, ...] = ("1m", "5m_node", "hourly", "daily"), once: bool = True) -> StreamingQuery:
    """Metric stream into the stored tiers: each micro-batch is added to the metric table and closed buckets are refreshed.

    A bucket closes once the newest time seen is ``lateness_s`` past its end. Rows that come later are also listed in the table
    ``late``; they touch closed buckets, which are therefore made anew at once. Open buckets stay pending; ``store.refresh()`` takes them.
    A replayed micro-batch is added once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        old, newest = _late(batch, epoch, progress, lateness_s)
        if newest is None:
            return
        store.add(batch, "stream", epoch)
        epoch_writer(late)(batch.where(old), epoch)
        store.refresh(tiers, high=newest - timedelta(seconds=lateness_s))

    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


REPEAT_TTL_S = 600


def judged_alone(batch: DataFrame) -> DataFrame:
    """The envelopes of a micro-batch, read once and written: what the checks told of each, its number and its hash.

    Bodies and signatures end here, and metrics are kept only where no check of the envelope alone refused it; the hash, which settles
    the order of envelopes received in one microsecond, only where a replay may be looked for.
    """
    ident = F.sha2(F.concat_ws("|", "batch_id", "nonce", "timestamp", "signature", "body", F.col("received_at").cast("string")), 256)
    early, late = F.col("early").isNull(), F.col("late").isNull()
    return stored(batch.select(
        F.monotonically_increasing_id().alias("_row"), F.when(early, F.unhex(ident)).alias("_hash"), "received_at", "batch_id", "node_id",
        "source_region", "early", "late", "fresh_nonce", F.when(early & late, F.col("metrics")).alias("metrics")), "envelopes")


def _mark_repeats(rows: DataFrame, key: str, kind: str, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows that have ``key`` with ``kept``, first uses): a use within the TTL of a first use is not kept, earlier micro-batches included."""
    new = rows.where(F.col(key).isNotNull()).withColumn("_new", F.lit(1))
    if seen is not None:
        past = seen.where(F.col("kind") == kind).select(F.col("key").alias(key), "received_at", F.lit(0).alias("_new"))
        new = new.unionByName(past, allowMissingColumns=True)
    judged = prefix.windows(new, [key], "received_at", REPEAT_TTL_S, ["_new", "_hash", "_row"]).where("_new = 1").drop("_new", "anchor", "hit")
    return judged, judged.where("kept").select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "received_at")


def judge_repeats(rows: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted envelopes as ``_row`` and ``envelope``, rejected ones with ``reason``, first uses of nonces and batch ids to remember).

    ``rows`` are those of :func:`judged_alone`. A nonce is burned by the first fresh use even if a later check fails, a batch id only by a
    batch that passed. The columns that a rejection tells travel with the keys, so no verdict has to be joined back to its envelope.
    ``envelope`` is the envelope's hash, numbered among equal ones.
    """
    slim = ["_row", "_hash", "received_at", "batch_id", "node_id", "source_region", "late"]
    nonces, burned = _mark_repeats(rows.select(*slim, "fresh_nonce"), "fresh_nonce", "nonce", seen)
    unsigned = rows.where("early is null and fresh_nonce is null").select(*slim)
    passed = nonces.where("kept and late is null").select(*slim).unionByName(unsigned.where("late is null"))
    batches, used = _mark_repeats(passed, "batch_id", "batch", seen)
    place = F.row_number().over(Window.partitionBy("_hash").orderBy("_row"))
    accepted = batches.where("kept").select("_row", F.concat_ws("#", F.lower(F.hex("_hash")), place).alias("envelope"))
    told = ["batch_id", "node_id", "source_region", "received_at"]
    refused = [(rows.where("early is not null"), F.col("early")), (nonces.where("not kept"), F.lit("nonce_replay")),
               (nonces.where("kept and late is not null"), F.col("late")), (unsigned.where("late is not null"), F.col("late")),
               (batches.where("not kept"), F.lit("already_processed"))]
    rejected = reduce(DataFrame.unionByName, [df.select(*told, reason.alias("reason")) for df, reason in refused])
    return accepted, rejected, burned.union(used)


#: The order of receipt; the envelope's hash settles ties.
RECEIPT = ("arrival", "envelope")


def ingest_stream(env: DataFrame, out: str, checkpoint: str, secret: str,
                  allowed: tuple[str, ...] = admission.ALLOWED_REGIONS, mode: str = "strict", role: str = "central",
                  rules: tuple[alerts.Rule, ...] = alerts.DEFAULT_RULES, once: bool = True) -> StreamingQuery:
    """Envelope stream to tables below ``out``: metrics, conflicts, rejected, health, nodes, seen, scores, alerts, summary.

    Every envelope is either stored or in ``rejected`` with its reason; ``seen`` holds the first uses of nonces and
    batch ids, and a micro-batch reads those of the last ``REPEAT_TTL_S`` seconds.

    ``metrics`` is a dated table with commits (``store.read_metrics``), the same that compaction and retention work on; (time, node_id) stays unique,
    and a replayed micro-batch is added once. The other tables have a folder per micro-batch, which a replay replaces. ``scores`` are the rolling scores
    and ``alerts`` the alerts with their disposition of all clean samples, going on over micro-batches (see ``carried``); ``summary`` has the counters
    of each micro-batch. The node table is written as one version per batch; read the newest.
    """
    checked = admission.single_checks(env, secret, allowed, mode, role)

    def run(batch: DataFrame, epoch: int) -> None:
        with passing(batch.sparkSession, "micro-batch"):
            good = _admit(batch, out, epoch)
            raw, health = normalize.split_health(good)
            epoch_writer(f"{out}/health")(health, epoch)
            valid = normalize.is_valid(normalize.normalize(raw, F.col("received_at")))
            valid = valid.withColumns({c: F.col(c).cast(t) for c, t in METRIC_TYPES.items()})
            # arrival: order of receipt, then position in the batch
            valid = valid.withColumn("arrival", F.unix_micros("received_at") * 1000 + F.col("pos")).drop("pos")
            rows = dedup.dedup_metrics(valid, order=RECEIPT).withColumn("date", F.to_date("time"))
            accepted = valid.count()
            _store(batch.sparkSession, rows, out, epoch, {"failed": raw.count() - accepted, "valid": accepted}, rules)

    writer = checked.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _admit(batch: DataFrame, out: str, epoch: int) -> DataFrame:
    """The metrics of the accepted envelopes, written; the tables ``rejected`` and ``seen`` get theirs.

    What settles the envelopes leaves the scratch folder before the metrics are worked on.
    """
    spark, memory, seen, path = batch.sparkSession, f"{out}/seen", None, scratch_dir(batch.sparkSession, "metrics")
    with passing(spark, "admission"):
        rows = judged_alone(batch)
        since = rows.agg(F.min("received_at")).first()[0]
        if since is not None and _exists(spark, memory):
            seen = spark.read.parquet(memory).where(
                (F.col("epoch") < epoch) & (F.col("received_at") > F.lit(since) - F.make_dt_interval(secs=F.lit(REPEAT_TTL_S))))
        accepted, rejected, first = judge_repeats(rows, seen)
        epoch_writer(memory)(first, epoch)
        epoch_writer(f"{out}/rejected")(rejected, epoch)
        good = rows.where("early is null and late is null").drop("_hash", "early", "late", "fresh_nonce").join(accepted, "_row")
        return stored(explode_batch(good, ("batch_id", "received_at", "source_region", "envelope")), path=path)


def _probe(spark: SparkSession, rows: DataFrame, table: SnapshotTable, epoch: int) -> DataFrame | None:
    """Stored rows (time, node_id, received_at) that share node and second with new ones.

    Only days of the new rows are listed, and in each only the span of their times is read; the new keys, not the stored rows, are what is
    small enough to go to every task, which Spark decides by size.
    """
    seen = table.manifest()
    spans = rows.groupBy("date").agg(F.min("time").alias("low"), F.max("time").alias("high")).collect()  # a row per day
    if seen.schema is None or not spans:
        return None
    kept = table.read(version=seen, days=[r["date"] for r in spans], without=f"ingest-{epoch}").select("time", "node_id", "received_at", "date")
    inside = F.lit(False)
    for r in spans:
        low, high = (F.lit(r[c]).cast(kept.schema["time"].dataType) for c in ("low", "high"))
        inside = inside | ((F.col("date") == F.lit(r["date"])) & (F.col("time") >= F.date_trunc("second", low))
                           & (F.col("time") < F.date_trunc("second", high) + F.expr("INTERVAL 1 SECOND")))
    keys = rows.select("node_id", F.date_trunc("second", "time").alias("_s")).distinct()
    met = kept.where(inside).withColumn("_s", F.date_trunc("second", "time")).join(keys, ["node_id", "_s"], "left_semi")
    return stored(met.drop("date"), "met")


def _store(spark: SparkSession, rows: DataFrame, out: str, epoch: int, counts: dict[str, int], rules: tuple[alerts.Rule, ...]) -> None:
    rows = stored(rows, "clean")
    table = SnapshotTable(spark, f"{out}/metrics")
    met = _probe(spark, rows, table, epoch)
    if met is None:  # nothing is stored yet: the rows stay as they are
        key = rows.select("time", "node_id").limit(0)
    else:
        key = met.select("time", "node_id")
        # seconds stored within the duplicate TTL; later repeats are conflicts instead
        recent = met.select("node_id", "_s", F.col("received_at").alias("_at"))
        live = F.col("_at") > F.col("received_at") - F.make_dt_interval(secs=F.lit(DEDUP_TTL_S))
        rows = rows.join(
            recent, (rows["node_id"] == recent["node_id"]) & (F.date_trunc("second", "time") == F.col("_s")) & live, "left_anti")
        rows = stored(rows, "clean")
    samples = rows.select("time", "node_id", *METRIC_TYPES, "arrival")
    with passing(spark, "scores"):
        epoch_writer(f"{out}/scores")(carried.scores(samples, f"{out}/state", epoch), epoch)
    with passing(spark, "alerts"):
        judged = carried.dispositions(alerts.fired(samples, rules), f"{out}/state", epoch)
        epoch_writer(f"{out}/alerts")(alerts.described(judged, rules), epoch)
    conflicts = dedup.conflict_audit(rows, key, "source_region", RECEIPT)
    epoch_writer(f"{out}/conflicts")(conflicts, epoch)
    fresh = stored(dedup.insert_first_wins(rows, key, RECEIPT), "fresh")
    write_metrics(fresh.drop("date"), f"{out}/metrics", "ingest", epoch)
    # counts of written rows come from the footers of their files
    lost = spark.read.schema(conflicts.schema).parquet(f"{out}/conflicts/epoch={epoch}").count()
    processed, clean = fresh.count(), rows.count()
    probes = rows.agg(F.count_distinct("node_id")).first()[0]
    told = processed + counts["failed"]
    summary = [(processed, counts["failed"], counts["valid"] - clean + lost, probes, round(counts["failed"] / told, 4) if told else 0.0)]
    epoch_writer(f"{out}/summary")(spark.createDataFrame(
        summary, "rows_processed long, rows_failed long, duplicate_count long, active_probes long, error_rate double"), epoch)
    versions, top = f"{out}/nodes", rows.agg(F.max("received_at")).first()[0]
    if top is None:
        return
    known = None
    if _exists(spark, versions):
        past = spark.read.parquet(versions).where(F.col("epoch") < epoch)
        last = past.agg(F.max("epoch")).first()[0]
        known = past.where(F.col("epoch") == last).drop("epoch") if last is not None else None
    if known is None:
        known = spark.createDataFrame(
            [], "node_id string, node_name string, status string, country string, region string, last_seen_at timestamp")
    epoch_writer(versions)(node_ops.upsert_nodes(known, rows, F.lit(top)), epoch)
