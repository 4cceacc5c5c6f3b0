"""Telemetry views over the supplied test tables.

``events`` is read as metric samples and ``customer`` with its nation and region as the node table.
The dense calendar squeezes the 30 days of events into one hour so that minute rollups hold several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconry.session import prepare

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z, first instant of the event table
SQUEEZE = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(col).cast("timestamp_ntz")


def node_key(col: str) -> Column:
    return F.concat(F.lit("probe-"), F.lpad(F.col(col).cast("string"), 8, "0"))


# one SQL text per column keeps the plan quick to build
_DENSE = f"timestamp_micros({EPOCH_US} + (unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div {SQUEEZE})"
_NODE = "concat('probe-', lpad(cast(user_id as string), 8, '0'))"
_K = "cast(get_json_object(props, '$.k') as int)"


def as_metrics(events: DataFrame, calendar: str = "dense") -> DataFrame:
    """Map event rows to metric rows; also used on event streams."""
    time = _DENSE if calendar == "dense" else "ts"
    # the JSON is read once per row; Spark keeps the two projections apart because the value is used several times
    return events.selectExpr("ts", "user_id", "value", "event_type", "event_id", f"{_K} as k").selectExpr(
        f"cast({time} as timestamp_ntz) as time", f"{_NODE} as node_id", "cast(value as decimal(10,2)) as latency_ms",
        "cast(if(event_type = 'error', 100 - k / 4.0D, 100.0D) as decimal(5,2)) as uptime_pct",
        "cast(if(event_type in ('error', 'click'), (k % 16) / 2.0D, 0.0D) as decimal(5,2)) as packet_loss",
        "event_type as probe_type", "map('k', cast(k as string)) as metadata", "event_id as arrival")


def metrics(spark: SparkSession, sf_dir: str, calendar: str = "dense") -> DataFrame:
    return as_metrics(table(spark, sf_dir, "events"), calendar)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node dimension; the three tables are joined without a hint so Spark checks sizes itself."""
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    joined = (
        cust.join(nation, cust.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    lat = "cast(if(c_acctbal >= 0, c_acctbal / 200, null) as decimal(9,6))"
    return joined.selectExpr(
        "concat('probe-', lpad(cast(c_custkey as string), 8, '0')) as node_id", "c_name as node_name",
        "case c_mktsegment when 'FURNITURE' then 'deleted' when 'MACHINERY' then 'reporting' else 'registered' end as status",
        "concat('A', char(65 + n_nationkey)) as country", "r_name as region", f"{lat} as lat",
        f"cast({lat} - 20 as decimal(9,6)) as lng")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as probe heartbeats: the event type decides the active target."""
    return table(spark, sf_dir, "events").selectExpr(
        f"{_NODE} as node_id",
        "case when event_type in ('view', 'signup') then 'central' when event_type = 'purchase' then 'legacy-env' "
        "else 'regional' end as active_target", f"cast({_DENSE} as timestamp_ntz) as timestamp", "event_id as arrival")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as log messages, one second apart."""
    docs = table(spark, sf_dir, "documents")
    level = (
        F.when(F.col("n_chars") > 2000, "CRITICAL").when(F.col("n_chars") > 800, "ERROR")
        .when(F.col("n_chars") > 400, "WARNING").otherwise("INFO")
    )
    return docs.select(
        from_micros(F.lit(EPOCH_US) + F.col("doc_id") * 1000000).alias("timestamp"),
        F.col("source").alias("service"),
        level.alias("level"),
        F.col("text").alias("message"),
        F.when(F.col("lang") == "en", F.lit(None).cast("string")).when(F.col("lang") == "de", "unknown")
        .otherwise(F.concat(F.lit("t-"), F.col("doc_id").cast("string"))).alias("trace_id"),
        F.col("n_chars").alias("latency_ms"),
        F.col("doc_id").alias("arrival"),
    )
