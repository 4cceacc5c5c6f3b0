"""Order-dependent work per key that stays parallel when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. That is right for ordinary keys.
:func:`per_key` first counts rows per key (a map-side combined aggregate) and, only when some keys are hot, takes
their rows aside and cuts them into chunks along the order column. An operator is written once against
:class:`Keys`; for chunks its methods carry in what a chunk needs from earlier ones:

* :meth:`Keys.frame` copies the k rows before each chunk into it (lags and row frames);
* :meth:`Keys.last_known` carries the last known values (running state).

Cooldown chains and windows of counts are in :mod:`beaconry.operators.prefix`.

Every key above the limit is chunked. The list of such keys has at most one row per ``HOT_ROWS`` rows of input; it
stays a stored table that Spark joins, and broadcasts only if it is small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from beaconry.session import scratch_dir

HOT_ROWS = 2_000_000
CHUNK_ROWS = 500_000


def _position(df: DataFrame, order: str) -> Column:
    """The order column as a number that grows with it."""
    if isinstance(df.schema[order].dataType, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order).cast("long")


SEGMENTS = 64


def hot_keys(df: DataFrame, keys: list[str], order: str, hot_rows: int = HOT_ROWS,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None; with cut points of their order column and chunks per segment.

    The cut points are approximate quantiles, so bursts and quiet times get segments of about equal row counts.
    """
    pos = _position(df, order)
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    # a key whose rows all have one time (or none) has no cut point; its rows stay together
    known = stored(counts.where((F.col("_n") > hot_rows) & (F.col("_hi") > F.col("_lo"))), "hot-keys")
    if known.isEmpty():
        return None
    steps = [i / SEGMENTS for i in range(1, SEGMENTS)]
    cuts = df.join(known.select(*keys), keys).groupBy(*keys).agg(
        F.percentile_approx(pos, steps, 1000).alias("_cuts"))
    edges = F.array_distinct(F.array_sort(F.concat(F.array("_lo"), "_cuts", F.array(F.col("_hi") + 1))))
    return stored(known.join(cuts, keys).select(
        *keys, edges.alias("_edges"), F.ceil(F.col("_n") / F.lit(chunk_rows * SEGMENTS)).alias("_parts")), "hot-cuts")


def _chunk(df: DataFrame, order: str) -> Column:
    """Chunk number of a hot row: its segment between two cut points, and its even share of that segment."""
    pos = _position(df, order)
    seg = F.greatest(F.lit(1), F.least(F.size(F.filter("_edges", lambda e: e <= pos)), F.size("_edges") - 1))
    low, high = F.element_at("_edges", seg), F.element_at("_edges", seg + 1)
    share = F.floor((pos - low) * F.col("_parts") / (high - low).cast("double"))
    share = F.greatest(F.lit(0), F.least(share, F.col("_parts") - 1))
    return ((seg - 1) * F.col("_parts") + share).cast("int")


def stored(df: DataFrame, name: str = "rows", path: str | None = None) -> DataFrame:
    """The rows written once to the shared scratch folder (or ``path``); survives lost executors and is not recomputed."""
    path = path or scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_key(df: DataFrame, keys: list[str], order: str, logic: Callable[[DataFrame, "Keys"], DataFrame],
            basis: DataFrame | None = None, hot_rows: int | None = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Run ``logic`` over ordinary keys and over chunks of hot keys, and put both together.

    ``basis`` may name a cheaper frame that holds at least the rows of ``df``. With the same keys and order column it
    is counted instead of ``df``; with some of the keys it only tells whether any key can be hot at all. Give
    ``hot_rows=None`` where the caller knows that keys stay small.
    """
    if hot_rows is None:
        return logic(df, Keys(keys, False))
    count_in = df
    if basis is not None:
        coarse = [k for k in keys if k in basis.columns]
        if coarse == keys and order in basis.columns:
            count_in = basis
        elif basis.groupBy(*coarse).count().where(F.col("count") > hot_rows).isEmpty():
            return logic(df, Keys(keys, False))
    hot = hot_keys(count_in, keys, order, hot_rows, chunk_rows)
    if hot is None:
        return logic(df, Keys(keys, False))
    heavy = stored(df.join(hot, keys).withColumn("_chunk", _chunk(df, order)).drop("_edges", "_parts"), "hot")
    rest = df.join(hot.select(*keys), keys, "left_anti")
    done = logic(heavy, Keys(keys, True)).drop("_chunk")
    return logic(rest, Keys(keys, False)).unionByName(done)


@dataclass(frozen=True)
class Keys:
    """Grouping of an ordered operator: by key, or by key and chunk."""

    keys: list[str]
    chunked: bool

    @property
    def part(self) -> list[str]:
        return [*self.keys, "_chunk"] if self.chunked else list(self.keys)

    def window(self, order: list[str], reverse: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*[F.desc(c) if reverse else F.asc(c) for c in order])

    def frame(self, df: DataFrame, order: list[str], k: int, make: Callable[[WindowSpec], dict[str, Column]],
              reverse: bool = False) -> DataFrame:
        """Add window columns that look at most ``k`` rows back (forward in time when ``reverse``)."""
        w = self.window(order, reverse)
        if not self.chunked:
            return df.withColumns(make(w))
        df = stored(df)
        rest = [c for c in df.columns if c not in self.part]
        tail = df.withColumn("_rn", F.row_number().over(self.window(order, not reverse))).where(F.col("_rn") <= k)
        per_chunk = tail.groupBy(*self.part).agg(F.collect_list(F.struct(*rest)).alias("_rows"))  # at most k rows
        # the nearest k chunks surely hold the k rows before; older copies among them lie outside every frame
        near = Window.partitionBy(*self.keys).orderBy(F.desc("_chunk") if reverse else F.asc("_chunk"))
        ahead = per_chunk.select(*self.part, F.flatten(F.collect_list("_rows").over(near.rowsBetween(-k, -1))).alias("_rows"))
        halo = ahead.select(*self.part, F.explode("_rows").alias("_row")).select(
            *self.part, *[F.col(f"_row.{c}").alias(c) for c in rest], F.lit(True).alias("_halo"))
        rows = df.withColumn("_halo", F.lit(False)).unionByName(halo)
        return rows.withColumns(make(w)).where(~F.col("_halo")).drop("_halo")

    def lags(self, df: DataFrame, order: list[str], lags: dict[str, str], reverse: bool = False) -> DataFrame:
        """Add the previous row's value (the next one's when ``reverse``) of each column (new name -> column)."""
        return self.frame(df, order, 1, lambda w: {new: F.lag(c).over(w) for new, c in lags.items()}, reverse)

    def last_known(self, df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
        """Add the last non-null value so far, this row included, of each column in ``values``."""
        if not self.chunked:
            w = self.window(order).rowsBetween(Window.unboundedPreceding, 0)
            return df.withColumns({new: F.last(c, ignorenulls=True).over(w) for new, c in values.items()})
        df = stored(df)
        cols = list(values.values())
        per_chunk = df.groupBy(*self.part).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in cols])
        before = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        halo = per_chunk.select(*[
            F.last(c, ignorenulls=True).over(before).alias(c) if c in cols else F.col(c) if c in self.part
            else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns], F.lit(True).alias("_halo"))
        rows = df.withColumn("_halo", F.lit(False)).unionByName(halo)
        w = Window.partitionBy(*self.part).orderBy(F.desc("_halo"), *order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({new: F.last(c, ignorenulls=True).over(w) for new, c in values.items()})
        return rows.where(~F.col("_halo")).drop("_halo")


def with_lags(df: DataFrame, keys: list[str], order: list[str], lags: dict[str, str], **split) -> DataFrame:
    """Add the previous row's value of each column in ``lags`` (new name -> column)."""
    return per_key(df, keys, order[0], lambda part, g: g.lags(part, order, lags), **split)
