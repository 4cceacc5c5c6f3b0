"""Files of the engine: metric table, event and log documents, dead letters, retention and compaction."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconry.functions.timeutil import Instant, instant
from beaconry.sources.snapshot import SnapshotTable

METRIC_TYPES = {"latency_ms": "decimal(10,2)", "uptime_pct": "decimal(5,2)", "packet_loss": "decimal(5,2)"}


def write_metrics(df: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> None:
    """Append metric rows, decimals cast, by day; one shuffle groups a day's rows into few files.

    The rebalance lets Spark split days that hold much more than others. A streaming writer gives its name and batch number, so that a
    replayed batch is added once.
    """
    out = df.withColumns({c: F.col(c).cast(t) for c, t in METRIC_TYPES.items()}).withColumn("date", F.to_date("time"))
    SnapshotTable(df.sparkSession, path).append(out, writer, batch, time="time")


def read_metrics(spark: SparkSession, path: str, first: Instant | None = None, last: Instant | None = None) -> DataFrame:
    """The rows of the last commit; ``first`` and ``last`` are days whose folders alone are looked at."""
    return SnapshotTable(spark, path).read(first, last)


def write_events(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """ETL event documents as JSON lines, one folder per month."""
    out = df.withColumn("month", F.date_format(ts, "yyyy.MM"))
    out.hint("rebalance", "month").write.mode("append").partitionBy("month").json(path)


def write_logs(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Log documents as JSON lines, one folder per day."""
    out = df.withColumn("day", F.date_format(ts, "yyyy.MM.dd"))
    out.hint("rebalance", "day").write.mode("append").partitionBy("day").json(path)


def read_dlq(spark: SparkSession, path: str) -> DataFrame:
    """Lines of dead-letter files with the file's name and date (``logs-YYYY-MM-DD`` names)."""
    name = F.col("_metadata.file_name")
    date = F.regexp_extract(name, r"^logs-(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    return spark.read.text(path).select("value", name.alias("file"), date.alias("file_date"))


def replay_dlq(lines: DataFrame, default_index: str) -> tuple[DataFrame, DataFrame]:
    """(documents to replay, quarantined lines). ``default_index`` stands in for a missing ``_index``; ``_source`` defaults to the whole document.

    Both keep the file date; write or index in that order to replay chronologically.
    """
    doc = F.when(F.length(F.trim("value")) > 0, F.try_parse_json(F.trim("value")))  # a blank line is no document
    parsed = lines.withColumn("_ok", doc.isNotNull())
    index = F.coalesce(F.get_json_object("value", "$._index"), F.lit(default_index))
    source = F.coalesce(F.get_json_object("value", "$._source"), F.trim("value"))
    good = parsed.where("_ok").select("file_date", "file", index.alias("_index"), source.alias("_source"))
    return good, parsed.where(~F.col("_ok")).select("file_date", "file", "value")


def retained_files(files: DataFrame, keep_days: int, now: Instant) -> DataFrame:
    """Files (column ``file_date``) not older than the retention; names without a date stay."""
    cut = F.date_sub(F.lit(str(now)).cast("date"), keep_days)
    return files.where(F.col("file_date").isNull() | (F.col("file_date") >= cut))


def apply_retention(df: DataFrame, ts: str, keep: str, now: Instant) -> DataFrame:
    """Rows not older than ``keep`` (like '7 days'); the bare column comparison prunes files and partitions."""
    return df.where(F.col(ts) >= instant(df, ts, now) - F.expr(f"INTERVAL {keep}"))


def _day(now: Instant, days: int) -> date:
    return date.fromisoformat(str(now)[:10]) - timedelta(days=days)


def drop_old(spark: SparkSession, path: str, now: Instant, keep_days: int) -> None:
    """Retention of a metric table: days older than ``keep_days`` leave it in one commit, without reading a row."""
    SnapshotTable(spark, path).drop_before(_day(now, keep_days))


def compact_old(spark: SparkSession, path: str, now: Instant, age_days: int = 3) -> list[str]:
    """Rewrite days older than ``age_days`` sorted by node and newest first, so row groups prune by node; the days rewritten.

    Days that are compact already stay. The new files replace the old ones in one commit: readers see either, a job that dies leaves the
    old ones, and a day that gets late rows meanwhile makes the commit fail rather than lose them.
    """
    table, cut = SnapshotTable(spark, path), str(_day(now, age_days))
    read = table.manifest()
    folders: dict[str, list[str]] = {}
    for f in read.folders:
        folders.setdefault(f.day, []).append(f.commit)
    days = sorted(d for d, commits in folders.items() if d < cut and not (len(commits) == 1 and commits[0].startswith("compact-")))
    if days:
        rows = table.read(version=read, days=days)
        order = ["date", "node_id", F.desc("time")]
        table.replace(rows.repartitionByRange(*order).sortWithinPartitions(*order), days, read, name="compact")
    return days
