"""Admission of envelopes: schema, signature, freshness, replay, idempotency, region, limits and rate checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from beaconry import schemas
from beaconry.functions.scalar import region_slug
from beaconry.operators import ordered, prefix
from beaconry.sources.envelopes import hmac_sha256, signing_message

# Default region allow-list.
ALLOWED_REGIONS = ("gh-accra", "ng-lagos", "ke-nairobi")


def validate_schema(df: DataFrame) -> DataFrame:
    """Add ``bad_fields``: names of required fields that are missing or out of range, in schema order."""

    def outside(name: str, low: float, high: float) -> Column:
        v = F.col(name)
        return F.when(v.isNull() | F.isnan(v.cast("double")) | (v < low) | (v > high), name)

    country = F.when(~F.coalesce(F.col("country").rlike("^[A-Z]{2}$"), F.lit(False)), "country")
    length = F.char_length("node_id")
    checks = [
        F.when(F.col("node_id").isNull() | (length < 1) | (length > 50), "node_id"), country,
        F.when(F.col("region").isNull(), "region"), outside("latency_ms", 0, 10000), outside("uptime_pct", 0, 100),
        outside("packet_loss", 0, 100),
        F.when(F.col("timestamp").cast("string").try_cast("timestamp").isNull(), "timestamp")]
    return df.withColumn("bad_fields", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def _signed() -> Column:
    """Checks of a signed request apply only when all four headers are there."""
    return (F.col("signature").isNotNull() & F.col("timestamp").isNotNull() & F.col("nonce").isNotNull()
            & F.col("batch_id").isNotNull())


def verify_signature(env: DataFrame, secret: str) -> DataFrame:
    """Add ``signature_ok``; requests without all headers are not checked."""
    want = hmac_sha256(secret, signing_message(F.col("batch_id"), F.col("timestamp"), F.col("nonce"), F.col("body")))
    return env.withColumn("signature_ok", F.when(_signed(), F.col("signature") == want).otherwise(True))


def check_freshness(env: DataFrame, now: Column, max_skew_s: int = 300) -> DataFrame:
    """Add ``fresh``: the header time reads as a timestamp within ``max_skew_s`` of ``now``."""
    skew = F.abs(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("timestamp").try_cast("timestamp")))
    ok = F.coalesce(skew <= max_skew_s * 1_000_000, F.lit(False))
    return env.withColumn("fresh", F.when(_signed(), ok).otherwise(True))


def reject_replays(env: DataFrame, key: str = "nonce", ttl_s: int = 600, ties: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Add ``replayed``: the key was used within the TTL; only a first use starts a new TTL.

    Rows without a key are never replays and take no part.
    """
    none = env.where(F.col(key).isNull()).withColumn("replayed", F.lit(False))
    out = prefix.windows(env.where(F.col(key).isNotNull()), [key], "received_at", ttl_s, list(ties))
    return out.withColumn("replayed", ~F.col("kept")).drop("kept", "anchor", "hit").unionByName(none)


def idempotent_batches(env: DataFrame, ttl_s: int = 600, ties: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Add ``batch_status``: new, already_processed (same id within the TTL) or missing_batch_id."""
    out = reject_replays(env, "batch_id", ttl_s, ties)
    return out.withColumn(
        "batch_status", F.when(F.col("batch_id").isNull(), "missing_batch_id")
        .when(F.col("replayed"), "already_processed").otherwise("new")).drop("replayed")


def derive_region(env: DataFrame) -> DataFrame:
    """Add ``source_region``: the header, else the slug of the first metric, else unknown."""
    first = F.try_element_at("metrics", F.lit(1))
    slug = region_slug(F.coalesce(first["country"], F.lit("xx")), F.coalesce(first["region"], F.lit("unknown")))
    header = F.nullif(F.col("region_id"), F.lit(""))
    return env.withColumn("source_region", F.coalesce(header, F.when(F.size("metrics") > 0, slug), F.lit("unknown")))


def check_region(env: DataFrame, allowed: tuple[str, ...] = ALLOWED_REGIONS, mode: str = "strict",
                 role: str = "central") -> DataFrame:
    """Add ``region_known`` and ``region_rejected``; only strict mode at the centre rejects, never ``unknown``."""
    known = F.col("source_region").isin(*allowed) | (F.col("source_region") == "unknown")
    rejects = mode == "strict" and role == "central"
    return env.withColumn("region_known", known).withColumn("region_rejected", ~known & F.lit(rejects))


def region_rejections(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("region_rejected").alias("ingest_rejection_count"))


def enrich_provenance(df: DataFrame, ingested_at: Column, ingested_by: str) -> DataFrame:
    meta = F.struct(F.lit(1).alias("schema_version"), ingested_at.alias("ingested_at"),
                    F.lit(ingested_by).alias("ingested_by"), F.col("source_region").alias("source_region"))
    return df.withColumn("_meta", meta)


def check_limits(env: DataFrame) -> DataFrame:
    """Add ``limit_error``: too_many_metrics, batch_too_large, metric_too_large, or null."""
    largest = F.array_max(F.transform("metrics", lambda m: F.octet_length(F.to_json(m))))
    return env.withColumn(
        "limit_error", F.when(F.size("metrics") > schemas.MAX_BATCH_METRICS, "too_many_metrics")
        .when(F.octet_length("body") > schemas.MAX_BATCH_BYTES, "batch_too_large")
        .when(largest > schemas.MAX_METRIC_BYTES, "metric_too_large"))


def check_payload(env: DataFrame) -> DataFrame:
    """Add ``payload_error``: invalid_payload if any metric breaks the schema; self-reports may lack measurements."""

    def outside(v: Column, low: float, high: float) -> Column:
        return v.isNull() | F.isnan(v) | (v < low) | (v > high)

    def broken(m: Column) -> Column:
        report = F.coalesce(m["metadata"]["type"] == "health", F.lit(False))
        measured = outside(m["latency_ms"], 0, 10000) | outside(m["uptime_pct"], 0, 100) | outside(m["packet_loss"], 0, 100)
        return (~F.coalesce(F.char_length(m["node_id"]).between(1, 50), F.lit(False))
                | ~F.coalesce(m["country"].rlike("^[A-Z]{2}$"), F.lit(False)) | m["region"].isNull()
                | m["timestamp"].try_cast("timestamp").isNull() | (~report & measured))

    return env.withColumn("payload_error", F.when(F.exists("metrics", broken), "invalid_payload"))


def single_checks(env: DataFrame, secret: str, allowed: tuple[str, ...] = ALLOWED_REGIONS, mode: str = "strict",
                  role: str = "central") -> DataFrame:
    """What one envelope alone tells: adds ``source_region``, ``early`` and ``late`` reasons, and ``fresh_nonce``.

    Rows that never reach the nonce store have no ``fresh_nonce`` and so cannot burn one.
    """
    df = check_payload(check_limits(check_region(derive_region(env), allowed, mode, role)))
    df = verify_signature(check_freshness(df, F.col("received_at")), secret)
    early = F.when(F.col("batch_id").isNull(), "missing_batch_id").when(~F.col("fresh"), "stale_timestamp")
    late = F.coalesce(F.when(~F.col("signature_ok"), "bad_signature"), F.col("limit_error"), F.col("payload_error"),
                      F.when(F.col("region_rejected"), "invalid_region"))
    df = df.withColumns({"early": early, "late": late}).withColumn(
        "fresh_nonce", F.when(F.col("early").isNull() & _signed(), F.col("nonce")))
    return df.drop("fresh", "signature_ok", "limit_error", "payload_error", "region_known", "region_rejected")


def admit(env: DataFrame, secret: str, allowed: tuple[str, ...] = ALLOWED_REGIONS, mode: str = "strict",
          role: str = "central") -> DataFrame:
    """All checks of one batch of envelopes in their order; adds ``source_region`` and ``reason`` (null = accepted).

    A nonce is burned by the first fresh use even if its signature then fails; a batch id only by a batch that
    passed every check before it. The replay checks run on a few columns and meet the envelopes again by ``arrival``,
    which must be unique, so bodies and metrics never leave the JVM.
    """
    df = single_checks(env, secret, allowed, mode, role)
    # Parsed once and written: the checks below read a few columns of it several times.
    slim = ordered.stored(df.select("arrival", "received_at", "batch_id", F.col("early").alias("_early"), F.col("late").alias("_late"),
                                    F.col("fresh_nonce").alias("_nonce"), "source_region"), "judged")
    slim = _replays_of_repeats(slim, "_nonce")
    slim = slim.withColumn("reason", F.coalesce(
        "_early", F.when(F.col("replayed"), "nonce_replay"), "_late")).drop("replayed", "_early", "_late", "_nonce")
    slim = _replays_of_repeats(slim.withColumn("_batch", F.when(F.col("reason").isNull(), F.col("batch_id"))), "_batch")
    reason = F.coalesce("reason", F.when(F.col("replayed"), "already_processed"))
    return env.join(slim.select("arrival", "source_region", reason.alias("reason")), "arrival")


def _replays_of_repeats(rows: DataFrame, key: str) -> DataFrame:
    """:func:`reject_replays` where most keys are used once: only rows of repeated keys are put in order.

    The uses of a key are counted on the map side; what comes back by ``arrival`` are the replays alone.
    """
    again = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(key)
    slim = rows.select(key, "received_at", "arrival").join(again, key, "left_semi")
    bad = reject_replays(slim, key).where("replayed").select("arrival", "replayed")
    return rows.join(bad, "arrival", "left").withColumn("replayed", F.coalesce("replayed", F.lit(False)))


# --- rates ------------------------------------------------------------------------------------------------------


def fixed_window_quota(df: DataFrame, keys: list[str], ts: str, limit: int, window_s: float, ties: list[str]) -> DataFrame:
    """Add ``hit`` (1, 2, ... in its window) and ``allowed`` (hit <= limit).

    A window opens at the first hit outside any window, so windows are the spans between kept rows of a greedy
    chain; rejected hits count too.
    """
    out = prefix.windows(df, keys, ts, window_s, ties)
    return out.withColumn("allowed", F.col("hit") <= limit).drop("kept", "anchor")


def _bucket_kernel(rate: float, capacity: float, initial: tuple[float, float] | None = None):
    """Token bucket over Arrow batches in (group, time) order; a group starts with a full bucket, or with ``initial`` tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = capacity, 0.0
        for batch in batches:
            n = batch.num_rows
            at = (batch.column("_us").to_numpy(zero_copy_only=False) / 1e6).tolist()
            first = batch.column("_first").to_numpy(zero_copy_only=False).tolist()
            asked = batch.column("_asked").to_numpy(zero_copy_only=False).tolist()
            filled, granted = np.empty(n), np.empty(n, dtype=np.int64)
            for i in range(n):
                if first[i]:
                    tokens, last = initial or (capacity, at[i])
                level = min(capacity, tokens + max(0.0, at[i] - last) * rate)
                give = min(asked[i], int(level))
                if give > 0:
                    tokens, last = level - give, at[i]
                filled[i], granted[i] = level, give
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(filled), pa.array(granted)],
                names=[*batch.schema.names, "_filled", "_granted"])

    return run


def _run_buckets(df: DataFrame, keys: list[str], ts: str, rate: float, capacity: float, ties: list[str],
                 initial: tuple[float, float] | None = None, **split) -> DataFrame:
    """Run the bucket per key. In hot keys an idle time that refills the bucket ends a run; runs are independent."""
    order = ["_us", *ties]
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))

    def logic(part: DataFrame, g: ordered.Keys) -> DataFrame:
        group = list(keys)
        if g.chunked:
            part = g.lags(part, order, {"_before": "_us"})
            idle = F.lit(int(np.ceil(capacity / rate * 1e6)))
            fresh = F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= idle)
            part = part.withColumn("_start", F.when(fresh, F.col("_us"))).drop("_before")
            part = g.last_known(part, order, {"_run": "_start"}).drop("_start", "_chunk")
            group.append("_run")
        part = part.withColumn("_first", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)
        schema = StructType([
            *part.schema.fields, StructField("_filled", DoubleType()), StructField("_granted", LongType())])
        return part.mapInArrow(_bucket_kernel(float(rate), float(capacity), initial), schema).drop("_us", "_run", "_first")

    return ordered.per_key(rows, keys, "_us", logic, **split)


def token_bucket(df: DataFrame, keys: list[str], ts: str, rate: float, capacity: float, ties: list[str],
                 **split) -> DataFrame:
    """Add ``allowed``, ``remaining``, ``reset_time`` (epoch seconds when full) and ``retry_after`` (-1 if allowed)."""
    out = _run_buckets(df.withColumn("_asked", F.lit(1).cast("long")), keys, ts, rate, capacity, ties, **split)
    ok = F.col("_granted") > 0
    left = F.col("_filled") - F.col("_granted")
    now_s = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000)
    return out.withColumns({
        "allowed": ok, "remaining": left,
        "reset_time": (now_s + F.ceil((F.lit(float(capacity)) - left) / rate)).cast("long"),
        "retry_after": F.when(ok, -1.0).otherwise((F.lit(1.0) - F.col("_filled")) / rate),
    }).drop("_asked", "_filled", "_granted")


def shared_bucket(df: DataFrame, ts: str, rate: float, capacity: float, ties: list[str], asks: str | None = None,
                  initial: tuple[float, float] | None = None, **split) -> DataFrame:
    """One bucket for all rows with a clock of whole seconds; adds ``allowed``.

    ``initial`` is what an earlier batch left: tokens and the second of its last grant.

    Requests of one second are counted first, so the sequential part sees one row per second. Within a second
    the first requests by ``ties`` get the tokens. Rows whose boolean column ``asks`` is false take none.
    """
    asked = (F.col(asks) if asks else F.lit(True)).cast("long")
    rows = df.withColumn("_second", F.date_trunc("second", ts).cast(df.schema[ts].dataType)).withColumn("_asks", asked)
    per_second = rows.groupBy("_second").agg(F.sum("_asks").alias("_asked")).where(F.col("_asked") > 0)
    grants = _run_buckets(per_second.withColumn("_scope", F.lit("all")), ["_scope"], "_second", rate, capacity, [],
                          initial, **split).select("_second", "_granted")
    # At most ``capacity`` requests of a second can win: ranking stops there before the shuffle, and the last winner
    # tells all rows of its second whether they won.
    place = F.struct(ts, *ties)
    ranked = rows.where("_asks = 1").select("_second", place.alias("_last")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_second").orderBy("_last"))).where(F.col("_rank") <= int(capacity))
    last = ranked.join(grants, "_second").where(F.col("_rank") <= F.col("_granted")).groupBy("_second").agg(
        F.max("_last").alias("_last"))
    granted = (F.col("_asks") == 1) & F.coalesce(place <= F.col("_last"), F.lit(False))
    return rows.join(last, "_second", "left").withColumn("allowed", granted).drop("_second", "_asks", "_last")
