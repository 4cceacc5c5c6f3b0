"""Keyed stream state: rolling anomaly sums, alert suppression, token buckets and live heartbeats.

State per key is small and bounded: twenty samples, one entry per alert kind, one bucket level, one target.
Column names have no leading underscore: the pandas state interface renames such columns.
Rows of a key are handled in arrival order within a micro-batch; event time decides all expiries, so a replay
gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType)

from beaconry.functions import exact
from beaconry.operators import alerts as H
from beaconry.operators.rowwindow import score_windows


def _rows(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key in this micro-batch, in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class _LastSamples(StatefulProcessor):
    """Count, sum and square sum over the last n values of a key."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("values", ArrayType(LongType()))])
        self.past = handle.getValueState("past", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["arrival"])
        past = list(self.past.get()[0]) if self.past.exists() else []
        x = np.array([*past, *pdf["x"].tolist()], dtype=np.int64)
        sums, squares = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
        end = np.arange(len(past), len(x)) + 1
        begin = np.maximum(end - self.n, 0)
        self.past.update(([int(v) for v in x[-(self.n - 1):]] if self.n > 1 else [],))
        yield pdf.assign(wn=end - begin, ws=sums[end] - sums[begin], wq=squares[end] - squares[begin])

    def close(self) -> None:
        pass


def stream_anomaly(df: DataFrame, n: int = 20, min_samples: int = 5) -> DataFrame:
    """Rolling anomaly scores of a metric stream (columns time, node_id, latency_ms, packet_loss, arrival)."""
    scale = exact.scale_of(df, "latency_ms") or 0
    slim = df.where(F.col("latency_ms").isNotNull()).select(
        "time", "node_id", "packet_loss", "arrival", exact.units(df, "latency_ms").alias("x"))
    schema = StructType([*slim.schema.fields, *[StructField(c, LongType()) for c in ("wn", "ws", "wq")]])
    out = slim.groupBy("node_id").transformWithStateInPandas(_LastSamples(n), schema, "append", "none")
    out = out.withColumnsRenamed({"x": "_x", "wn": "_n", "ws": "_s", "wq": "_q"})
    return score_windows(out, scale, min_samples)


class _Suppress(StatefulProcessor):
    """Cooldown per alert kind, then the fixed-window quota of the node."""

    def __init__(self, cooldown_s: int, limit: int, window_s: int):
        self.cooldown_us, self.limit, self.window_us = cooldown_s * 1_000_000, limit, window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("kind", StringType())])
        self.kept = handle.getMapState("kept", kind, StructType([StructField("us", LongType())]))
        self.quota = handle.getValueState(
            "quota", StructType([StructField("start", LongType()), StructField("hits", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["us", "arrival", "rule_no"])
        kept = {k[0]: v[0] for k, v in self.kept.iterator()}
        start, hits = self.quota.get() if self.quota.exists() else (None, 0)
        verdicts, touched = [], set()
        for us, kind in zip(pdf["us"].tolist(), (pdf["metric_name"] + ":" + pdf["severity"]).tolist()):
            if kind in kept and us - kept[kind] < self.cooldown_us:
                verdicts.append("dedup")
                continue
            kept[kind] = us
            touched.add(kind)
            if start is None or us - start >= self.window_us:
                start, hits = us, 0
            hits += 1
            verdicts.append("pass" if hits <= self.limit else "node_quota")
        for kind in touched:
            self.kept.updateValue((kind,), (kept[kind],))
        if start is not None:
            self.quota.update((start, hits))
        yield pdf.assign(verdict=verdicts)

    def close(self) -> None:
        pass


class _Bucket(StatefulProcessor):
    """Token bucket of one key; ``asked`` rows take a token, others pass by. Clock in (fractional) seconds."""

    def __init__(self, rate: float, capacity: float, order: list[str]):
        self.rate, self.capacity, self.order = rate, capacity, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState(
            "level", StructType([StructField("tokens", DoubleType()), StructField("last", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, self.order)
        tokens, last = self.level.get() if self.level.exists() else (self.capacity, None)
        filled, allowed = [], []
        for at, asked in zip(pdf["clock_s"].tolist(), pdf["asked"].tolist()):
            last = at if last is None else last
            now = min(self.capacity, tokens + max(0.0, at - last) * self.rate)
            ok = bool(asked) and now >= 1
            if ok:
                tokens, last = now - 1, at
            filled.append(now)
            allowed.append(ok)
        if last is not None:
            self.level.update((float(tokens), float(last)))
        yield pdf.assign(filled=filled, allowed=allowed)

    def close(self) -> None:
        pass


def _run_bucket(df: DataFrame, keys: list[str], rate: float, capacity: float, order: list[str]) -> DataFrame:
    schema = StructType([*df.schema.fields, StructField("filled", DoubleType()), StructField("allowed", BooleanType())])
    proc = _Bucket(float(rate), float(capacity), order)
    return df.groupBy(*keys).transformWithStateInPandas(proc, schema, "append", "none")


def stream_token_bucket(df: DataFrame, keys: list[str], ts: str, rate: float, capacity: float) -> DataFrame:
    """Rate limiting of a request stream; adds ``allowed`` and ``remaining``."""
    rows = df.withColumns({
        "clock_s": F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6), "asked": F.lit(True)})
    out = _run_bucket(rows, keys, rate, capacity, ["clock_s", "arrival"])
    left = F.col("filled") - F.col("allowed").cast("int")
    return out.withColumn("remaining", left).drop("clock_s", "asked", "filled")


def stream_alerts(df: DataFrame, rules: tuple[H.Rule, ...] = H.DEFAULT_RULES) -> DataFrame:
    """Alerts of a metric stream with ``disposition``: dedup, node_quota, global_limit or sent.

    The fleet-wide bucket is one key by definition; it sees only what the node quotas let through.
    """
    fired = H.evaluate_rules(df, rules).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    schema = StructType([*fired.schema.fields, StructField("verdict", StringType())])
    proc = _Suppress(H.COOLDOWN_S, H.NODE_LIMIT, H.NODE_WINDOW_S)
    judged = fired.groupBy("node_id").transformWithStateInPandas(proc, schema, "append", "none")
    # suppressed alerts spread over many groups; only the rest meets in the group of the bucket
    passed = F.col("verdict") == "pass"
    judged = judged.withColumns({
        "scope": F.when(passed, F.lit("all")).otherwise(F.concat(F.lit("x"), F.pmod(F.hash("node_id"), F.lit(1024)))),
        "clock_s": F.floor(F.col("us") / 1_000_000).cast("double"), "asked": passed})
    out = _run_bucket(judged, ["scope"], H.GLOBAL_PER_HOUR / 3600.0, H.GLOBAL_BURST, ["us", "arrival", "rule_no"])
    disposition = F.when(~F.col("asked"), F.col("verdict")).when(F.col("allowed"), "sent").otherwise("global_limit")
    return out.withColumn("disposition", disposition).drop(
        "us", "verdict", "scope", "clock_s", "asked", "filled", "allowed")


class _Live(StatefulProcessor):
    """Heartbeats of a probe that may still get a successor; one event-time timer looks at the oldest of them.

    A heartbeat expires if none follows within the TTL. That is certain once the watermark has passed its end, so the
    result does not depend on how the input is cut into micro-batches.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        beat = StructType([StructField("us", LongType()), StructField("arrival", LongType()), StructField("target", StringType())])
        self.open = handle.getValueState("open", StructType([StructField("beats", ArrayType(beat))]))

    def _frame(self, key, beats, late_us: int, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"node_id": [key[0]] * len(beats), "active_target": [b[2] for b in beats],
                             "us": [b[0] + late_us for b in beats], "live": [live] * len(beats)})

    def _settle(self, key, beats: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Expiries that are certain by now; keeps the rest and sets the timer of the oldest."""
        ttl_us = self.ttl_ms * 1000
        done = 0
        while done < len(beats) and beats[done][0] // 1000 + self.ttl_ms <= watermark_ms:
            done += 1
        gone = [b for i, b in enumerate(beats[:done]) if i + 1 == len(beats) or beats[i + 1][0] - b[0] > ttl_us]
        left = beats[done:]
        if left:
            self.open.update((left,))
            self.handle.registerTimer(left[0][0] // 1000 + self.ttl_ms)
        else:
            self.open.clear()
        if gone:
            yield self._frame(key, gone, ttl_us, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["us", "arrival"])
        new = [(int(u), int(a), t) for u, a, t in zip(pdf["us"], pdf["arrival"], pdf["active_target"])]
        yield self._frame(key, new, 0, True)
        past = [tuple(b) for b in self.open.get()[0]] if self.open.exists() else []
        if past:
            self.handle.deleteTimer(past[0][0] // 1000 + self.ttl_ms)
        yield from self._settle(key, sorted(past + new, key=lambda b: b[:2]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = [tuple(b) for b in self.open.get()[0]] if self.open.exists() else []
        yield from self._settle(key, past, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_heartbeats(df: DataFrame, ttl_s: int = 60, lateness: str = "10 seconds") -> DataFrame:
    """Life of probes: node, target, time, and whether it is live (every heartbeat) or expired (TTL passed without another)."""
    rows = df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    rows = rows.withColumn("us", F.unix_micros("timestamp"))
    schema = StructType([StructField("node_id", StringType()), StructField("active_target", StringType()),
                         StructField("us", LongType()), StructField("live", BooleanType())])
    out = rows.groupBy("node_id").transformWithStateInPandas(_Live(ttl_s * 1000), schema, "append", "eventTime")
    return out.select("node_id", "active_target", F.timestamp_micros("us").alias("at"), "live")
