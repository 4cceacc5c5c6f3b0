"""Pages of a dated metric table by cursor: newest first, each page starting where the last one ended.

A page goes down day by day and stops once it is full, so page ten thousand reads as many folders as page one; an offset would sort
everything before it. Inside a day the cursor's time is a pushed filter, and a page is a top-n over what is left.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from beaconry.sources.snapshot import Manifest, SnapshotTable


@dataclass(frozen=True)
class Cursor:
    """The last row of a page, and the version of the table that its pages are read from."""

    time: datetime
    node_id: str
    arrival: int
    version: int


def _beyond(cursor: Cursor, kind: str):
    """Rows after the cursor: time falls, node and arrival grow."""
    time, at = F.col("time"), F.lit(str(cursor.time)).cast(kind)
    tie = (F.col("node_id") > cursor.node_id) | ((F.col("node_id") == cursor.node_id) & (F.col("arrival") > cursor.arrival))
    return (time <= at) & ((time < at) | tie)


def metrics_page(table: SnapshotTable, nodes: DataFrame, cursor: Cursor | None = None, limit: int = 100,
                 node_id: str | None = None) -> tuple[DataFrame, Cursor | None]:
    """(page, cursor of the next one or None): samples newest first, ties by node_id and arrival, with the node's country and region.

    All pages of a cursor chain see the version of the table that the first one saw. ``limit`` is 1 to 1000 rows, which the driver holds.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    seen: Manifest = table.manifest(None if cursor is None else cursor.version)
    days = sorted((d for d in seen.days() if cursor is None or d <= str(cursor.time)[:10]), reverse=True)
    columns = ["time", "node_id", "arrival", "latency_ms", "uptime_pct", "packet_loss"]
    empty = table.read(version=seen, days=()).select(*columns)
    found, step = [], 1
    while days and len(found) < limit:
        some, days, step = days[:step], days[step:], 2 * step  # empty days take few rounds
        rows = table.read(version=seen, days=some).select(*columns)
        if cursor is not None:
            rows = rows.where(_beyond(cursor, empty.schema["time"].dataType.simpleString()))
        if node_id is not None:
            rows = rows.where(F.col("node_id") == node_id)
        found += rows.orderBy(F.desc("time"), "node_id", "arrival").limit(limit - len(found)).collect()
    page = table.spark.createDataFrame(found, empty.schema)
    page = page.join(nodes.select("node_id", "country", "region"), "node_id", "left").select(
        "node_id", F.coalesce("country", F.lit("XX")).alias("country"), F.coalesce("region", F.lit("Unknown")).alias("region"),
        "latency_ms", "uptime_pct", "packet_loss", "time", "arrival").orderBy(F.desc("time"), "node_id", "arrival")
    last = found[-1] if len(found) == limit else None
    return page, None if last is None else Cursor(last["time"], last["node_id"], last["arrival"], seen.version)
