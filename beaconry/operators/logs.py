"""Log documents: normalisation, volume and error panels, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from beaconry.functions.timeutil import Instant, between, bucket

# Fields that must never be stored.
SECRET_FIELDS = ("password", "token", "secret", "api_key", "authorization")


def normalize_logs(df: DataFrame, body: str = "message") -> DataFrame:
    """Decode JSON log lines: adds ``fields`` (string map without secret fields) and ``trace_id``.

    The trace id is ``trace.id``, else ``trace_id``, else unknown. A decoded ``message`` replaces the raw line; a
    line that is not a JSON object stays as it is and is marked by ``decode_error``.
    """
    text = F.trim(body)
    parsed = F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.from_json(text, "map<string,string>"))
    df = df.withColumn("_raw", parsed)
    raw = F.coalesce("_raw", F.create_map().cast("map<string,string>"))
    nested = F.get_json_object(F.try_element_at(raw, F.lit("trace")), "$.id")
    trace = F.coalesce(F.try_element_at(raw, F.lit("trace.id")), nested, F.try_element_at(raw, F.lit("trace_id")))
    hidden = [*SECRET_FIELDS, "trace_id"]
    return df.withColumns({
        "trace_id": F.coalesce(trace, F.lit("unknown")),
        "fields": F.map_filter(raw, lambda k, v: ~k.isin(*hidden)),
        "decode_error": F.col("_raw").isNull(),
        body: F.coalesce(F.try_element_at(raw, F.lit("message")), F.col(body)),
    }).drop("_raw")


def log_volume(df: DataFrame, interval: str = "1 minute", top: int = 5) -> DataFrame:
    """Lines per interval of the ``top`` services with most lines (ties to the smaller name)."""
    counts = df.groupBy(bucket("timestamp", interval).alias("bucket"), "service").agg(F.count(F.lit(1)).alias("lines"))
    best = counts.groupBy("service").agg(F.sum("lines").alias("_all")).orderBy(F.desc("_all"), "service").limit(top)
    return counts.join(F.broadcast(best.select("service")), "service", "left_semi").select("bucket", "service", "lines")


def error_rate(df: DataFrame, interval: str = "1 minute") -> DataFrame:
    bad = F.count_if(F.col("level").isin("ERROR", "CRITICAL"))
    return df.groupBy(bucket("timestamp", interval).alias("bucket")).agg(
        F.count(F.lit(1)).alias("lines"), bad.alias("errors"))


def missing_trace_ratio(df: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("trace_id").isNull() | (F.col("trace_id") == "unknown"))
    n = F.count(F.lit(1))
    return df.agg(n.alias("lines"), missing.alias("missing"), (missing / F.nullif(n, F.lit(0))).alias("missing_ratio"))


def log_search(df: DataFrame, service: str | None = None, level: str | None = None, request_id: str | None = None,
               start: Instant | None = None, end: Instant | None = None,
               above: dict[str, float] | None = None) -> DataFrame:
    """Filter by keyword fields, inclusive time range and numeric fields greater than a limit."""
    df = between(df, "timestamp", start, end)
    for name, value in (("service", service), ("level", level), ("request_id", request_id)):
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, limit in (above or {}).items():
        df = df.where(F.col(name).try_cast("double") > limit)
    return df
