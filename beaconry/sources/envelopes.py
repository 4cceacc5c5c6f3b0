"""Batch envelopes: reading them from files, splitting them, and the envelope view of the test orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconry.schemas import ENVELOPE, METRIC
from beaconry.sources.adapters import EPOCH_US, from_micros, micros, node_key, table

FILES_PER_BATCH = 100


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False,
                   files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """JSON envelopes, one per line; unreadable lines land in ``_corrupt``. A stream takes a bounded file count."""
    schema = ENVELOPE + ", _corrupt string"
    if streaming:
        reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = spark.read
    return reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def explode_batch(env: DataFrame, keep: tuple[str, ...] = ("batch_id", "received_at")) -> DataFrame:
    """One row per metric, in order; metrics that name another node than their envelope are dropped."""
    rows = env.select(*keep, F.col("node_id").alias("_sender"), F.posexplode("metrics").alias("pos", "m"))
    return rows.where(F.col("m.node_id") == F.col("_sender")).select(*keep, "pos", "m.*")


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 from the built-in digest, so it stays in generated code."""
    import hashlib

    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def signing_message(batch_id: Column, timestamp: Column, nonce: Column, body: Column) -> Column:
    return F.concat_ws(":", batch_id, timestamp, nonce, F.sha2(body.cast("binary"), 256))


SECRET = "test-secret"
_DAY0_US = 694224000000000  # 1992-01-01


def order_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`as_envelopes` of the order table."""
    return as_envelopes(table(spark, sf_dir, "orders"))


def received_us(order_date: str = "o_orderdate") -> Column:
    """Receipt of an order's envelope in microseconds: one order day becomes one second."""
    return F.floor((micros(order_date) - F.lit(_DAY0_US)) / 86400).cast("long") + F.lit(EPOCH_US)


def as_envelopes(o: DataFrame) -> DataFrame:
    """Orders as signed envelopes of one to three metrics; also used on order streams.

    Status P signs wrongly, some P orders lack a batch id or a readable timestamp, and the third metric of a
    batch names another node.
    """
    at = received_us()
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    odd = F.col("o_orderstatus") == "P"
    header_ts = F.date_format(F.timestamp_micros(at - (cents % 600000) * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", cents.alias("cents"),
        from_micros(at).alias("received_at"),
        F.when(odd & (F.col("o_orderpriority") == "3-MEDIUM"), F.lit(None)).otherwise(
            F.concat(F.lit("batch-"), F.col("o_custkey"))).alias("batch_id"),
        F.when(F.col("o_orderstatus") == "F", "gh-accra").when(odd, "us-west").alias("region_id"),
        F.when(odd & (F.col("o_orderpriority") == "5-LOW"), "bad").otherwise(header_ts).alias("timestamp"),
        F.concat(F.lit("n-"), F.col("o_custkey")).alias("nonce"), node_key("o_custkey").alias("node_id"))
    metric = lambda i: F.struct(
        F.when(i == 3, F.lit("someone-else")).otherwise(F.col("node_id")).alias("node_id"),
        F.concat(F.lit("A"), F.char((65 + F.col("o_custkey") % 25).cast("long"))).alias("country"),
        F.substring("o_orderpriority", 3, 20).alias("region"),
        (F.col("cents") / 4000.0 * i).alias("latency_ms"), (F.col("cents") % 10001 / 100.0).alias("uptime_pct"),
        (F.col("cents") % 1000 / 100.0).alias("packet_loss"), F.col("timestamp").alias("timestamp"),
        F.lit(None).cast("string").alias("target_host"), F.lit("ping").alias("probe_type"),
        F.create_map(F.lit("n_count"), i.cast("string")).alias("metadata"))
    o = o.withColumn("metrics", F.transform(F.sequence(F.lit(1), (1 + F.col("o_custkey") % 3).cast("int")), metric))
    o = o.withColumn("body", F.to_json(F.struct("node_id", "metrics")))
    signed = hmac_sha256(SECRET, signing_message(F.col("batch_id"), F.col("timestamp"), F.col("nonce"), F.col("body")))
    return o.withColumn("signature", F.when(odd, F.reverse(signed)).otherwise(signed)).withColumnRenamed(
        "o_orderkey", "arrival").drop("cents", "o_custkey", "o_orderstatus", "o_orderpriority")
