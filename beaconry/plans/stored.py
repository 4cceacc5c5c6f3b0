"""Stored tiers of the telemetry views, built once per session and table folder and then only read.

The history is the one that upkeep has to survive: four fifths of the samples arrive first, the tiers are refreshed, and the rest, scattered
over all buckets, arrives late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconry.session import prepare, scratch_dir
from beaconry.sources import adapters as A
from beaconry.sources.rollup_store import TIERS, RollupStore
from beaconry.sources.snapshot import SnapshotTable

COLUMNS = ["time", "node_id", "latency_ms", "uptime_pct", "packet_loss", "arrival"]
_STORES: dict[tuple[str, str, str], RollupStore] = {}


def with_sources(name: str) -> tuple[str, ...]:
    """The tier and those that it is made from."""
    out = [name]
    while TIERS[out[-1]].source != "raw":
        out.append(TIERS[out[-1]].source)
    return tuple(out)


def new_store(spark: SparkSession, sf: str) -> RollupStore:
    path = scratch_dir(prepare(spark), "tiers")
    return RollupStore(spark, f"{path}/tiers", SnapshotTable(spark, f"{path}/metrics"), lambda: A.nodes(spark, sf))


def store(spark: SparkSession, sf: str, calendar: str = "dense") -> RollupStore:
    """A metric table with late rows and tiers to be refreshed; the same one for all queries of a session."""
    key = (spark.sparkContext.applicationId, sf, calendar)
    found = _STORES.get(key)
    if found is None or not found.raw.versions():
        found = new_store(spark, sf)
        rows = A.metrics(spark, sf, calendar).select(*COLUMNS)
        late = F.col("arrival") % 5 == 0
        found.add(rows.where(~late))
        found.refresh(("5m_node",))
        found.add(rows.where(late))
        _STORES[key] = found
    return found


def tier(spark: SparkSession, sf: str, name: str, calendar: str = "dense", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a refreshed tier between two times."""
    kept = store(spark, sf, calendar)
    kept.refresh(with_sources(name))
    return kept.tier(name, start, end)


def tier_states(spark: SparkSession, sf: str, name: str, calendar: str = "dense", start: str | None = None, end: str | None = None) -> DataFrame:
    kept = store(spark, sf, calendar)
    kept.refresh(with_sources(name))
    return kept.states(name, start, end)
