"""Stored rollup tiers that follow their metric table.

Tiers hold mergeable states by day: one and five minutes per node from samples, regions and hours from the five-minute tier, days
from hours. Appends to the metric table log the slots they touch; ``refresh`` reads the samples (or finer states) of touched buckets
alone and rewrites the days that hold such buckets, other days' files stay as they are. Late rows are appends like others, so the same
log repairs closed buckets. What a refresh may not touch yet stays pending in the tier's manifest, in one commit with its rows.

A day of a tier is swapped as a whole, so a reader sees it before or after a refresh, never in between; a refresh that dies is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconry.functions.timeutil import between, bucket
from beaconry.operators import states
from beaconry.sources.snapshot import SLOT_MINUTES, SLOTS, Manifest, SnapshotTable, slot_of
from beaconry.sources.store import METRIC_TYPES


@dataclass(frozen=True)
class Tier:
    """``source`` is a tier or the samples; ``minutes`` the width of a bucket."""

    name: str
    source: str
    minutes: int

    @property
    def width(self) -> str:
        return f"{self.minutes} minutes"


#: In the order of refreshing: a tier comes after its source.
TIERS = {t.name: t for t in (Tier("1m", "raw", 1), Tier("5m_node", "raw", 5), Tier("5m_region", "5m_node", 5),
                             Tier("hourly", "5m_node", 60), Tier("daily", "hourly", 1440))}

SKETCHED = ("5m_node", "hourly", "daily")
#: Columns that place the rows of tiers with sketches, and bytes of the source in a part of a day.
WITHIN, PART_BYTES = ("date", "_part"), 4 << 20
#: Partitions up to which a shuffle writes its rows at once; above, it collects them in memory first.
UNSORTED = 200


@contextmanager
def _sorted_sketches(spark: SparkSession) -> Iterator[None]:
    """Sketches are aggregated over sorted rows.

    The hash aggregate of objects falls back to sorting at 128 keys, once before and once after it merges, and the writer sorts by day again.
    One sort serves all three.
    """
    key = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _widened(bits: int, minutes: int) -> int:
    """All slots of the buckets that hold one of the slots."""
    per = max(1, minutes // SLOT_MINUTES)
    mask, out = (1 << per) - 1, 0
    for start in range(0, SLOTS, per):
        if bits >> start & mask:
            out |= mask << start
    return out


def _ready(day: str, bits: int, minutes: int, low: datetime | None, high: datetime | None) -> int:
    """The slots of whole buckets inside [low, high)."""
    per, out, midnight = max(1, minutes // SLOT_MINUTES), 0, datetime.fromisoformat(day)
    for start in range(0, SLOTS, per):
        part = bits & ((1 << per) - 1) << start
        begin = midnight + timedelta(minutes=start * SLOT_MINUTES)
        end = begin + timedelta(minutes=per * SLOT_MINUTES)
        if part and (low is None or begin >= low) and (high is None or end <= high):
            out |= part
    return out


class RollupStore:
    """Tiers below ``root`` of the metric table ``raw``; ``nodes`` gives the node table when regions are refreshed."""

    def __init__(self, spark: SparkSession, root: str, raw: SnapshotTable, nodes: Callable[[], DataFrame] | None = None):
        self.spark, self.raw, self.nodes = spark, raw, nodes
        self.tables = {name: SnapshotTable(spark, f"{root.rstrip('/')}/{name}") for name in TIERS}

    def add(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> Manifest:
        """Append samples (late or not) to the metric table."""
        out = rows.withColumns({c: F.col(c).cast(t) for c, t in METRIC_TYPES.items()}).withColumn("date", F.to_date("time"))
        return self.raw.append(out, writer, batch, time="time")

    def _days(self, **columns: dict[str, object]) -> DataFrame:
        """A row per day, to be broadcast: a shuffle by day would hand all rows of a day to one task."""
        days = sorted(next(iter(columns.values())))
        rows = pa.table({"date": [date.fromisoformat(d) for d in days], **{c: [v[d] for d in days] for c, v in columns.items()}})
        return F.broadcast(self.spark.createDataFrame(rows))

    def _touched(self, bits: dict[str, int], time: str) -> Callable[[DataFrame], DataFrame]:
        """Marks rows in the slots of ``bits`` with the column ``_in``; a row per day is joined."""
        days = self._days(_bits={d: "".join("1" if b >> i & 1 else "0" for i in range(SLOTS)) for d, b in bits.items()})

        def mark(df: DataFrame) -> DataFrame:
            hit: Column = F.substring(F.col("_bits"), slot_of(time) + 1, F.lit(1)) == "1"
            return df.join(days, "date").withColumn("_in", hit).drop("_bits")

        return mark

    def _dealt(self, rows: DataFrame, time: str, tier: Tier, sizes: dict[str, int]) -> DataFrame:
        """Rows partitioned by ``WITHIN``: a day in parts by the hash of bucket and node, as many as its bytes in the source ask for.

        The aggregate and the writer then move nothing more. Sketches of few samples are as large as these, so
        combining before the shuffle would not make it smaller. The number of partitions follows the bytes too, so that a task's
        share does not grow with the table; up to ``UNSORTED`` there are two to a part, so that few parts meet in one.
        """
        parts = self._days(_parts={d: max(1, -(-n // PART_BYTES)) for d, n in sizes.items()})
        place = F.pmod(F.xxhash64(bucket(time, tier.width), "node_id"), F.col("_parts"))
        n = max(1, -(-sum(sizes.values()) // PART_BYTES))
        n = min(2 * n, max(n, UNSORTED))
        return rows.join(parts, "date").withColumn("_part", place).drop("_parts").repartition(n, *WITHIN)

    def refresh(self, names: tuple[str, ...] = tuple(TIERS), low: datetime | None = None, high: datetime | None = None) -> dict[str, list[str]]:
        """Bring tiers up to date; per tier the days that were rewritten.

        Only buckets wholly inside [low, high) are refreshed, others stay pending. A tier needs its source refreshed before.
        """
        seen = self.raw.manifest()
        return {name: self._refresh(TIERS[name], seen, low, high) for name in TIERS if name in names}

    def refresh_window(self, names: tuple[str, ...], now: datetime, start_s: int, end_s: int) -> dict[str, list[str]]:
        """Refresh the buckets between ``start_s`` and ``end_s`` seconds before ``now``."""
        return self.refresh(names, now - timedelta(seconds=start_s), now - timedelta(seconds=end_s))

    def _refresh(self, tier: Tier, seen: Manifest, low: datetime | None, high: datetime | None) -> list[str]:
        table = self.tables[tier.name]
        own = table.manifest()
        pending = {d: int(b, 16) for d, b in json.loads(own.note("pending") or "{}").items()}
        for d, b in seen.touched_after(int(own.note("through") or 0)).items():
            pending[d] = pending.get(d, 0) | b
        wide = {d: _widened(b, tier.minutes) for d, b in pending.items()}
        ready = {d: r for d, b in wide.items() if (r := _ready(d, b, tier.minutes, low, high))}
        left = {d: f"{b & ~ready.get(d, 0):x}" for d, b in pending.items() if b & ~ready.get(d, 0)}
        notes = {"through": str(seen.version), "pending": json.dumps(left)}
        if not ready:
            if own.note("through") != notes["through"] or left != json.loads(own.note("pending") or "{}"):
                table.annotate(notes, self._empty(tier))
            return []
        fresh = self._made(tier, ready, seen)
        some = {d: b for d, b in ready.items() if d in own.days() and b != (1 << SLOTS) - 1}  # days that keep rows
        if some:
            kept = self._touched(some, "bucket")(table.read(version=own, days=some)).where("not _in").drop("_in")
            fresh = fresh.unionByName(kept.hint("rebalance", "date"))
        with _sorted_sketches(self.spark):
            table.replace(fresh, ready, own, notes)
        return sorted(ready)

    def _made(self, tier: Tier, ready: dict[str, int], seen: Manifest) -> DataFrame:
        """Fresh states of the touched buckets, few files a day."""
        source, time = (self.raw, "time") if tier.source == "raw" else (self.tables[tier.source], "bucket")
        read = seen if tier.source == "raw" else source.manifest()
        rows = self._touched(ready, time)(source.read(version=read, days=ready)).where("_in").drop("_in")
        if tier.name in SKETCHED:
            rows = self._dealt(rows, time, tier, source.sizes(read, ready))
            if tier.source == "raw":
                return states.from_samples(rows, tier.width, True, WITHIN).drop("_part")
            return states.coarser(rows, tier.width, WITHIN).drop("_part")
        out = states.from_samples(rows, tier.width) if tier.source == "raw" else states.by_region(rows.drop("date"), self.nodes())
        return out.withColumn("date", F.to_date("bucket")).hint("rebalance", "date")

    def _empty(self, tier: Tier) -> DataFrame:
        none = self.spark.createDataFrame([], "time timestamp_ntz, node_id string, " + ", ".join(f"{c} {t}" for c, t in METRIC_TYPES.items()))
        out = states.from_samples(none, tier.width, sketch=tier.minutes >= 5)
        if tier.name == "5m_region":
            out = states.merged(out.drop("latency_sketch"), {"bucket": F.col("bucket"), "region": F.col("node_id")})
        return out.withColumn("date", F.to_date("bucket"))

    def states(self, name: str, start: str | datetime | None = None, end: str | datetime | None = None) -> DataFrame:
        """State rows with start <= bucket <= end; folders of other days are not listed."""
        first, last = (None if t is None else str(t)[:10] for t in (start, end))
        return between(self.tables[name].read(first, last), "bucket", start, end)

    def tier(self, name: str, start: str | datetime | None = None, end: str | datetime | None = None) -> DataFrame:
        """The tier as rollup rows."""
        rows = self.states(name, start, end)
        return states.finished_region(rows) if name == "5m_region" else states.finished(rows)
