"""Cooldown chains and fixed windows as a parallel prefix over sorted chunks.

Rows are sorted globally by key, time and ties (a range shuffle), so a hot key, or many rows of one instant, simply spans several
partitions. One pass over each partition settles every key that begins in it. Only the first key of a partition may go on from the
partition before; its rows stay open, and their effect is summed up as a map from the state on entry to the state on exit. The maps
of a key's chunks are composed pairwise, level by level (as many levels as the binary logarithm of the longest run of chunks); going down
again, every chunk gets its entry state from its left neighbours, and the open rows are settled in a second pass.

State: the time from when on a row may be kept, and the number of rows since the last kept one. A map is a list of steps (entry times
up to ``upto`` leave with the last kept time ``exit`` and ``count`` rows since); entries beyond the last step pass through. Only entries up to
one gap after a chunk's first row can occur, so a map has at most as many steps as that span has distinct times, and never more than its
chunk has rows. No task takes more than one partition, or two maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, ByteType, IntegerType, LongType, StructField, StructType

from beaconry.operators.ordered import stored

#: The time of rows without one: before all others.
NO_TIME = -(2**62)
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SETTLED, OPEN, TAIL = 0, 1, 2
_ADDED = [StructField("_part", IntegerType()), StructField("_seq", LongType()), StructField("kept", BooleanType()),
          StructField("_at", LongType()), StructField("hit", LongType()), StructField("_role", ByteType())]


class Chain:
    """Greedy chain over growing times: a row is kept ``gap`` or more after the last kept one."""

    def __init__(self, gap: int):
        self.gap = gap
        self.start()

    def start(self, allowed: int = _LOW, count: int = 0) -> None:
        self.allowed, self.count = allowed, count

    @property
    def last(self) -> int:
        return self.allowed - self.gap if self.allowed != _LOW else NO_TIME

    def run(self, us: np.ndarray, kept: np.ndarray, at: np.ndarray, hit: np.ndarray) -> None:
        """Fill in the results of the rows that come next."""
        i, n = 0, len(us)
        while i < n:
            j = i + int(np.searchsorted(us[i:], self.allowed, side="left"))
            at[i:j] = self.last
            hit[i:j] = np.arange(self.count + 1, self.count + 1 + j - i)
            self.count += j - i
            if j < n:  # a kept row
                kept[j], at[j], hit[j] = True, us[j], 1
                self.allowed, self.count = int(us[j]) + self.gap, 1
                j += 1
            i = j


def chunk_map(us: np.ndarray, gap: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, upto, exit, count) of sorted times."""
    jump = np.searchsorted(us, us + gap, side="left")
    last = np.arange(len(us))
    while (jump < len(us)).any():  # pointer doubling: follow each chain to its end
        inside = jump < len(us)
        target = np.where(inside, jump, 0)
        last, jump = np.where(inside, last[target], last), np.where(inside, jump[target], jump)
    entry = np.flatnonzero(np.append(True, np.diff(us) > 0))  # the first row of each time
    entry = entry[: int(np.searchsorted(us[entry], us[0] + gap, side="left")) + 1]
    return merged_steps(len(us), us[entry], us[last[entry]], len(us) - last[entry])


def merged_steps(n: int, upto: np.ndarray, exits: np.ndarray, count: np.ndarray):
    """Neighbouring steps with the same outcome are one."""
    if len(upto):
        change = np.append((np.diff(exits) != 0) | (np.diff(count) != 0), True)
        upto, exits, count = upto[change], exits[change], count[change]
    return n, upto, exits, count


def compose(a, b, gap: int):
    """The map of chunk ``a`` followed by chunk ``b``."""
    (n, upto, exits, count), (m, upto_b, exits_b, count_b) = a, b
    at = np.searchsorted(upto_b, exits + gap, side="left")
    through = at >= len(upto_b)
    at = np.where(through, 0, at)
    out = np.where(through, exits, exits_b[at] if len(exits_b) else 0), np.where(through, count + m, count_b[at] if len(count_b) else 0)
    more = upto_b > (upto[-1] if len(upto) else _LOW)  # entries that pass through ``a``
    return merged_steps(n + m, np.append(upto, upto_b[more]), np.append(out[0], exits_b[more]), np.append(out[1], count_b[more]))


def _changes(batch: pa.RecordBatch, before: pa.RecordBatch | None, columns: list[int]) -> np.ndarray:
    """Whether a row's key differs from the row's before it; nulls are equal."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = before is None
    for c in columns:
        col = batch.column(c) if before is None else pa.concat_arrays([before.column(c), batch.column(c)])
        old, new = col.slice(0, len(col) - 1), col.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(new, old), False), pc.xor(pc.is_null(new), pc.is_null(old)))
        out[1 if before is None else 0 :] |= differs.to_numpy(zero_copy_only=False)
    return out


def _first_pass(gap: int, n_keys: int, width: int):
    """Settles all keys but the first of the partition; a last row tells the state in which the last key leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, opening, chain = TaskContext.get().partitionId(), 0, None, True, Chain(gap)
        names = None
        for b in batches:
            if not b.num_rows:
                continue
            names = [*b.schema.names, *[f.name for f in _ADDED]]
            n, us = b.num_rows, b.column(width - 1).to_numpy(zero_copy_only=False)
            new = _changes(b, before, list(range(n_keys)))
            kept, at, hit = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
            role = np.full(n, SETTLED, np.int8)
            begin = 0
            if opening:  # up to the first other key
                others = np.flatnonzero(new[1:] if before is None else new) + (before is None)
                begin = int(others[0]) if len(others) else n
                role[:begin], opening = OPEN, begin == n
            alone = new & np.append(new[1:], False)  # keys of one row; the last row of the batch may go on
            alone[:begin] = False
            kept[alone], at[alone], hit[alone] = True, us[alone], 1
            starts = np.flatnonzero(new[begin:]) + begin
            edges = np.unique(np.concatenate(([begin], starts, [n])))
            lows = edges[:-1]
            several = ~alone[lows] if len(lows) else np.zeros(0, bool)
            for lo, hi in zip(lows[several].tolist(), edges[1:][several].tolist()):
                if new[lo]:
                    chain.start()
                chain.run(us[lo:hi], kept[lo:hi], at[lo:hi], hit[lo:hi])
            own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(kept), pa.array(at), pa.array(hit), pa.array(role)]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=names)
            seq, before = seq + n, b.slice(n - 1, 1)
        if before is not None and not opening:
            own = [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int64()), (False, pa.bool_()), (chain.last, pa.int64()),
                                                 (chain.count, pa.int64()), (TAIL, pa.int8()))]
            yield pa.RecordBatch.from_arrays([*before.columns, *own], names=names)

    return run


def _second_pass(gap: int, columns: dict[str, int]):
    """Settles open rows; ``_allowed`` and ``_count`` hold the entry state of their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, current = Chain(gap), None
        for b in batches:
            part, us = (b.column(columns[c]).to_numpy(zero_copy_only=False) for c in ("_part", "_us"))
            n = b.num_rows
            kept, at, hit = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [n]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if lo < hi:
                    if part[lo] != current:
                        current = part[lo]
                        allowed, count = (b.column(columns[c])[lo].as_py() for c in ("_allowed", "_count"))
                        chain.start(_LOW if allowed is None else allowed, count or 0)
                    chain.run(us[lo:hi], kept[lo:hi], at[lo:hi], hit[lo:hi])
            arrays = list(b.columns)
            for name, values in (("kept", kept), ("_at", at), ("hit", hit)):
                arrays[columns[name]] = pa.array(values)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return run


_MAP = "_run long, _j long, _n long, upto array<long>, exit array<long>, count array<long>"


def _chunks(rows: DataFrame, keys: list[str]) -> list[tuple]:
    """(part, role, run, j, allowed as last kept time, count) of each partition's open chunk and last key; a run is a key over partitions.

    Two rows per partition reach the driver, however many rows partitions have.
    """
    ends = rows.where(F.col("_role") != SETTLED).groupBy("_part", "_role").agg(
        F.first(F.struct(*keys)).alias("k"), F.max(F.when(F.col("_role") == TAIL, F.col("_at"))).alias("at"),
        F.max(F.when(F.col("_role") == TAIL, F.col("hit"))).alias("n")).collect()
    out, run, j, key = [], -1, 0, None
    for e in sorted(ends, key=lambda e: (e["_part"], e["_role"])):  # an open key comes before the last key of its partition
        run, j = (run, j + 1) if out and e["k"] == key else (run + 1, 0)
        key = e["k"]
        out.append((e["_part"], e["_role"], run, j, e["at"], e["n"]))
    return out


def _maps(rows: DataFrame, chunks: list[tuple], gap: int) -> DataFrame:
    """Maps of the given open chunks, and those of last keys, which always leave in the same state."""
    spark = rows.sparkSession
    index = spark.createDataFrame([(p, r, j) for p, role, r, j, _, _ in chunks if role == OPEN], "_part int, _run long, _j long")
    tails = spark.createDataFrame([(r, j, 0, [_HIGH], [at], [n]) for _, role, r, j, at, n in chunks if role == TAIL], _MAP)

    def summed(key, table):
        n, upto, exits, count = chunk_map(np.sort(table.column("_us").to_numpy()), gap)
        return pa.table({"_run": pa.array([key[0].as_py()]), "_j": pa.array([key[1].as_py()]), "_n": pa.array([n], pa.int64()),
                         **{c: pa.array([x], pa.list_(pa.int64())) for c, x in (("upto", upto), ("exit", exits), ("count", count))}})

    opened = rows.where(F.col("_role") == OPEN).select("_part", "_us").join(index, "_part")
    return opened.groupBy("_run", "_j").applyInArrow(summed, _MAP).unionByName(tails)


def _entry_states(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(part, allowed, count) of the open chunks: the state in which their key enters."""
    chunks = _chunks(rows, keys)
    length: dict[int, int] = {}
    for _, _, run, _, _, _ in chunks:
        length[run] = length.get(run, 0) + 1
    first = {run: (at, n) for _, role, run, j, at, n in chunks if j == 0 and role == TAIL}
    known, long_runs = [], []
    for c in chunks:
        part, role, run, j, _, _ = c
        # the second chunk of a run whose first one is a last key needs no map, nor does the first of a run
        if length[run] > 2 or (length[run] == 2 and run not in first):
            long_runs.append(c)
        elif role == OPEN:
            at, n = first[run] if j else (None, 0)
            known.append((part, None if at is None else at + gap, n))
    spark, kind = rows.sparkSession, "_part int, _allowed long, _count long"
    out = spark.createDataFrame(known, kind)
    if long_runs:
        index = spark.createDataFrame([(p, r, j) for p, role, r, j, _, _ in long_runs if role == OPEN], "_part int, _run long, _j long")
        states = _entries(_maps(rows, long_runs, gap), max(length.values()), gap)
        out = out.unionByName(index.join(states, ["_run", "_j"]).select("_part", "_allowed", "_count"))
    return out


def _entries(maps: DataFrame, longest: int, gap: int) -> DataFrame:
    """(run, j, allowed, count) of every chunk, from maps composed pairwise in as many levels as ``longest`` has binary digits."""

    def pair(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["_j"])
        got = [(r["_n"], *[np.array(r[c], np.int64) for c in ("upto", "exit", "count")]) for r in rows]
        n, upto, exits, count = got[0] if len(got) == 1 else compose(*got, gap)
        return pa.table({"_run": pa.array([rows[0]["_run"]], pa.int64()), "_j": pa.array([rows[0]["_j"] // 2], pa.int64()), "_n": pa.array([n], pa.int64()),
                         **{c: pa.array([x], pa.list_(pa.int64())) for c, x in (("upto", upto), ("exit", exits), ("count", count))}})

    levels = [stored(maps, "maps")]
    for _ in range(max(0, longest - 1).bit_length()):
        up = levels[-1].withColumn("_pair", F.floor(F.col("_j") / 2))
        levels.append(stored(up.groupBy("_run", "_pair").applyInArrow(pair, _MAP), "maps"))
    entries = levels[-1].select("_run", "_j", F.lit(None).cast("long").alias("_allowed"), F.lit(0).cast("long").alias("_count"))
    for level in reversed(levels[:-1]):
        above = entries.withColumnRenamed("_j", "_up")
        both = level.withColumn("_up", F.floor(F.col("_j") / 2)).join(above, ["_run", "_up"])
        # the left child enters like its parent, the right one with what the left one leaves
        place = F.size(F.filter("upto", lambda x: x < F.coalesce("_allowed", F.lit(_LOW)))) + 1
        hit = place <= F.size("upto")
        left = both.where("_j % 2 = 0")
        # new names first: a lambda would take an alias of the same select for its input
        leaving = left.select(
            "_run", (F.col("_j") + 1).alias("_next"), F.when(hit, F.try_element_at("exit", place) + gap).otherwise(F.col("_allowed")).alias("_leave"),
            F.when(hit, F.try_element_at("count", place)).otherwise(F.col("_count") + F.col("_n")).alias("_since")).select(
            "_run", F.col("_next").alias("_j"), F.col("_leave").alias("_allowed"), F.col("_since").alias("_count"))
        right = level.where("_j % 2 = 1").select("_run", "_j").join(leaving, ["_run", "_j"])
        entries = stored(left.select("_run", "_j", "_allowed", "_count").unionByName(right), "entries")
    return entries


def windows(df: DataFrame, keys: list[str], ts: str, seconds: float, ties: list[str]) -> DataFrame:
    """Add ``kept``, ``anchor`` (time of the last kept row) and ``hit`` (1, 2, ... from the last kept row on).

    A row is kept when at least ``seconds`` passed since the last kept row of its key; rows of one time are ordered by ``ties``. Rows
    without a time come first: they are kept, have no anchor and are counted among themselves.
    """
    if seconds <= 0:
        raise ValueError("the cooldown must be positive")
    gap = int(round(seconds * 1_000_000))
    rest = [c for c in df.columns if c not in keys]
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NO_TIME))
    rows = df.select(*keys, *rest, us.alias("_us"))
    order = [*keys, "_us", *[t for t in ties if t not in keys]]
    ordered_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*rows.schema.fields, *_ADDED])
    found = stored(ordered_rows.mapInArrow(_first_pass(gap, len(keys), len(rows.columns)), schema), "sorted")
    late = found.where(F.col("_role") == OPEN).join(_entry_states(found, keys, gap), "_part")
    late = late.repartition("_part").sortWithinPartitions("_part", "_seq")
    columns = {c: i for i, c in enumerate(late.columns)}
    late = late.mapInArrow(_second_pass(gap, columns), late.schema).drop("_allowed", "_count")
    done = found.where(F.col("_role") == SETTLED).unionByName(late)
    timed = F.col("_us") > F.lit(NO_TIME)
    anchor = F.when(timed, F.timestamp_micros("_at")).cast(df.schema[ts].dataType)
    return done.select(*df.columns, (F.col("kept") | ~timed).alias("kept"), anchor.alias("anchor"), "hit")
