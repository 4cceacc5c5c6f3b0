"""Row-window analytics: rolling anomaly scores, trends, transitions, posture, hysteresis and counter rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from beaconry.functions import exact, scalar, state
from beaconry.functions.timeutil import Instant, age_seconds, bucket
from beaconry.operators import ordered
from beaconry.operators.dedup import first_per, latest_per_node

LOSS_SPIKE = 1.0


def rolling_anomaly(df: DataFrame, n: int = 20, min_samples: int = 5, **split) -> DataFrame:
    """Mean and sample deviation of the last ``n`` latencies of each node in arrival order, spike flag and score.

    Mean and deviation are null and the score 0 below ``min_samples``. Sums run over whole units, so results do
    not depend on where Spark cuts the data; hot nodes are split (see ``ordered``).
    """
    scale = exact.scale_of(df, "latency_ms") or 0
    slim = df.where(F.col("latency_ms").isNotNull()).withColumn("_x", exact.units(df, "latency_ms"))

    def sums(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(-(n - 1), 0)
        return {"_n": F.count("_x").over(w), "_s": F.sum("_x").over(w), "_q": F.sum(F.col("_x") * F.col("_x")).over(w)}

    rows = ordered.per_key(
        slim, ["node_id"], "arrival", lambda part, g: g.frame(part, ["arrival"], n - 1, sums), **split)
    return score_windows(rows, scale, min_samples)


def score_windows(rows: DataFrame, scale: int, min_samples: int = 5) -> DataFrame:
    """Finish rows that carry ``_x`` and the count, sum and square sum of their window in units of 10**-scale."""
    one = float(10**scale)
    enough = F.col("_n") >= min_samples
    pairs = F.nullif(F.col("_n") * (F.col("_n") - 1), F.lit(0))
    spread = (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")) / pairs
    rows = rows.withColumns({
        "_mean": F.col("_s") / (F.col("_n") * F.lit(int(one))), "_sd": F.sqrt(F.greatest(spread, F.lit(0.0))) / one})
    off = F.abs(F.col("_x") / F.lit(one) - F.col("_mean"))
    score = F.when(F.col("_sd") > 0.001, scalar.z_ramp(off / F.col("_sd"))).otherwise(F.when(off > 1, 1.0).otherwise(0.0))
    rounded = exact.rounded_ratio(scale, F.col("_s"), F.col("_n"), 2)
    return rows.withColumns({
        "latency_avg_window": F.when(enough, rounded).cast("decimal(10,2)"),
        "latency_std_window": F.when(enough, F.round("_sd", 2)).cast("decimal(10,2)"),
        "packet_loss_spike": F.coalesce(F.col("packet_loss") > LOSS_SPIKE, F.lit(False)),
        "anomaly_score": F.when(enough, score).otherwise(0.0).cast("decimal(5,4)"),
    }).drop("_x", "_n", "_s", "_q", "_mean", "_sd")


def loss_spikes(df: DataFrame, threshold: float = LOSS_SPIKE) -> DataFrame:
    return df.where(F.col("packet_loss") > threshold)


def _newest(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The newest n rows of each key, ranked 1 = newest; Spark cuts groups before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(F.desc("time"), F.desc("arrival"))
    return df.withColumn("_rank", F.row_number().over(spec)).where(F.col("_rank") <= n)


def trajectory(df: DataFrame, value: str, keys: list[str], threshold: float | None = None, worse: str = "up",
               points: int = 300) -> DataFrame:
    """Direction of the newest ``points`` rows per key: mean of the last 30 % minus mean of the first 30 %.

    AWAITING below ten points, DEGRADING when the change exceeds the threshold in the ``worse`` direction,
    else STABILIZING. The threshold is 5 for latency and 0.5 for other measures.
    """
    if threshold is None:
        threshold = 5.0 if value == "latency_ms" else 0.5
    rows = _newest(df.select(*keys, "time", "arrival", value), keys, points)
    rows = rows.withColumn("_count", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    part = F.floor(F.col("_count") * F.lit(0.3))
    x = F.coalesce(exact.units(df, value), F.lit(0))
    sums = rows.groupBy(*keys).agg(
        F.max("_count").alias("points"), F.max(part).alias("_part"),
        F.sum(F.when(F.col("_rank") <= part, x)).alias("_late"),
        F.sum(F.when(F.col("_rank") > F.col("_count") - part, x)).alias("_early"))
    one = 10 ** (exact.scale_of(df, value) or 0)
    delta = (F.col("_late") - F.col("_early")) / F.nullif(F.col("_part") * F.lit(one), F.lit(0))
    bad = delta >= threshold if worse == "up" else delta <= -threshold
    bad = bad & (F.abs(delta) != threshold)
    label = F.when(F.col("points") < 10, "AWAITING").when(bad, "DEGRADING").otherwise("STABILIZING")
    return sums.select(*keys, "points", F.when(F.col("points") >= 10, delta).alias("delta"), label.alias("trajectory"))


def trend(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """rising when the newest value exceeds the one before it, else falling."""
    last = _newest(df.select(*keys, "time", "arrival", value), keys, 2)
    pair = last.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 1, F.col(value))).alias("_new"),
        F.max(F.when(F.col("_rank") == 2, F.col(value))).alias("_old"))
    rising = F.coalesce(F.col("_new") > F.col("_old"), F.lit(False))
    return pair.select(*keys, F.when(rising, "rising").otherwise("falling").alias("trend"))


def latest_n(df: DataFrame, n: int = 300) -> DataFrame:
    """The newest n rows in ascending time for a chart (top-k, no full sort)."""
    return df.orderBy(F.desc("time"), F.desc("arrival")).limit(n).orderBy("time", "arrival")


def throttle(df: DataFrame, keys: list[str], interval: str = "500 milliseconds") -> DataFrame:
    """The last row per key and interval."""
    keyed = df.withColumn("_slot", bucket("time", interval))
    return first_per(keyed, [*keys, "_slot"], [F.desc("time"), F.desc("arrival")]).drop("_slot")


def target_transitions(heartbeats: DataFrame, **split) -> DataFrame:
    """How often each probe changed its active target, by old and new target."""
    rows = ordered.with_lags(heartbeats, ["node_id"], ["timestamp", "arrival"], {"from_target": "active_target"}, **split)
    moved = rows.where(F.col("from_target").isNotNull() & (F.col("from_target") != F.col("active_target")))
    return moved.groupBy("node_id", "from_target", F.col("active_target").alias("to_target")).agg(
        F.count(F.lit(1)).alias("transitions"))


def posture(df: DataFrame, now: Instant, latest_only: bool = True) -> DataFrame:
    """One row: SECURED, CONTESTED or COMPROMISED with the counts behind it.

    A node silent for more than five minutes is a blackout. Judged on the latest row per node by default;
    ``latest_only=False`` judges every row.
    """
    rows = latest_per_node(df) if latest_only else df
    level = state.performance_level(F.col("latency_ms"), F.col("packet_loss"))
    dark = age_seconds(rows, "time", now) > 300
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows_judged"), F.count_if(dark).alias("blackout"),
        F.count_if(~dark & (level == 2)).alias("critical"), F.count_if(~dark & (level == 1)).alias("degraded"))
    return counts.withColumn(
        "posture",
        F.when((F.col("rows_judged") == 0) | (F.col("blackout") > 0) | (F.col("critical") >= 2), "COMPROMISED")
        .when((F.col("critical") >= 1) | (F.col("degraded") >= 1), "CONTESTED").otherwise("SECURED"))


def _segments(df: DataFrame, g: ordered.Keys, ts: str, level: str) -> DataFrame:
    """Spans of constant level with ``_end``, the start of the next span (null for the last), and ``_held`` seconds."""
    order = [ts, "arrival"]
    rows = g.lags(df, order, {"_old": level})
    starts = rows.where(F.col("_old").isNull() | (F.col("_old") != F.col(level))).drop("_old")
    spans = g.lags(starts, order, {"_end": ts}, reverse=True).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    held = (F.unix_micros(F.col("_end").cast("timestamp")) - F.col("_us")) / 1e6
    return spans.withColumn("_held", F.coalesce(held, F.lit(float("inf")))).drop("_end")


def debounce(df: DataFrame, keys: list[str], ts: str, level: str, up_s: float = 10, down_s: float = 30,
             initial: int = 0, levels: int = 3, **split) -> DataFrame:
    """Shown level after hysteresis: a span that lasts shows its level after ``up_s`` when worse, ``down_s`` when better.

    Returns one row per change of the shown level: time of the change and the new level. ``up_s`` must not
    exceed ``down_s``. A span of ``down_s`` always takes over, one of at least ``up_s`` only raises the level, so
    the shown level is the greatest level raised since the last take-over; no step-by-step state is needed.
    """
    if up_s > down_s:
        raise ValueError("up_s must not exceed down_s")
    order = [ts, "arrival"]

    def logic(part: DataFrame, g: ordered.Keys) -> DataFrame:
        seg = _segments(part, g, ts, level)
        marks = {"_reset_at": F.when(F.col("_held") >= down_s, F.col("_us"))}
        for v in range(levels):
            marks[f"_r{v}"] = F.when((F.col("_held") >= up_s) & (F.col(level) == v), F.col("_us"))
        names = {"_reset": "_reset_at", **{f"_l{v}": f"_r{v}" for v in range(levels)}}
        seg = g.last_known(seg.withColumns(marks), order, names)
        floor = F.when(F.col("_reset").isNull(), F.lit(initial)).otherwise(F.lit(0))
        since = F.coalesce(F.col("_reset"), F.lit(-(2**62)))
        seg = seg.withColumn("shown", F.greatest(floor, *[
            F.when(F.col(f"_l{v}") >= since, F.lit(v)) for v in range(levels)]))
        return g.lags(seg, order, {"_was": "shown"})

    seg = ordered.per_key(df.select(*keys, *order, level), keys, ts, logic, **split)
    was = F.coalesce(F.col("_was"), F.lit(initial))
    # a rise shows after up_s, a fall after down_s, both counted from the start of the span that caused it
    wait = F.when(F.col("shown") > was, F.lit(int(up_s * 1e6))).otherwise(F.lit(int(down_s * 1e6)))
    at = F.timestamp_micros(F.col("_us") + wait).cast(df.schema[ts].dataType)
    return seg.where(F.col("shown") != was).select(*keys, at.alias("changed_at"), "shown")


def hold_badge(df: DataFrame, keys: list[str], ts: str, status: str, hold_s: float = 5, **split) -> DataFrame:
    """Badge per span of constant status: CRITICAL and DOWN show at once and stay until another status held ``hold_s``."""
    bad = F.col(status).isin("CRITICAL", "DOWN")
    order = [ts, "arrival"]

    def logic(part: DataFrame, g: ordered.Keys) -> DataFrame:
        # the last span that decides: a bad one holds its status, a good one that lasted clears it
        decides = F.when(bad, F.col(status)).when(F.col("_held") >= hold_s, F.lit(""))
        seg = _segments(part, g, ts, status).withColumn("_decides", decides)
        return g.lags(g.last_known(seg, order, {"_last": "_decides"}), order, {"_before": "_last"})

    seg = ordered.per_key(df.select(*keys, *order, status), keys, ts, logic, **split)
    latched = ~bad & F.coalesce(F.col("_before") != "", F.lit(False))
    first = F.when(latched, F.col("_before")).otherwise(F.col(status))
    later = F.when(latched & (F.col("_held") >= hold_s), F.col(status))
    return seg.select(*keys, ts, status, first.alias("shown_at_start"), F.coalesce(later, first).alias("shown_at_end"))


def counter_rate(df: DataFrame, keys: list[str], window: str, window_s: float) -> DataFrame:
    """Increase per second of counters in each window: sum of rises; a drop is a reset and adds the new value."""
    rows = df.withColumn("bucket", bucket("ts", window))
    spec = Window.partitionBy(*keys, "bucket").orderBy("ts", "arrival")
    x = exact.units(df, "value")
    old = F.lag(x).over(spec)
    rise = F.when(old.isNull(), 0).when(x >= old, x - old).otherwise(x)
    one = 10 ** (exact.scale_of(df, "value") or 0)
    return rows.withColumn("_rise", rise).groupBy(*keys, "bucket").agg(
        (F.sum("_rise") / F.lit(float(one)) / F.lit(float(window_s))).alias("rate"))


def histogram_quantile(df: DataFrame, q: float | Column, keys: list[str]) -> DataFrame:
    """Quantile from cumulative buckets (``le`` double, infinity last; ``value`` count), linear inside a bucket."""
    spec = Window.partitionBy(*keys).orderBy("le")
    top = Window.partitionBy(*keys)
    rows = df.withColumns({
        "_lo": F.coalesce(F.lag("le").over(spec), F.lit(0.0)), "_below": F.coalesce(F.lag("value").over(spec), F.lit(0)),
        "_rank": F.max("value").over(top) * (q if isinstance(q, Column) else F.lit(float(q)))})
    hit = rows.where((F.col("value") >= F.col("_rank")) & (F.col("value") > 0)).groupBy(*keys).agg(
        F.min_by(F.struct("le", "_lo", "_below", "value", "_rank"), "le").alias("b"))
    inside = F.col("b._lo") + (F.col("b.le") - F.col("b._lo")) * (
        (F.col("b._rank") - F.col("b._below")) / (F.col("b.value") - F.col("b._below")))
    return hit.select(*keys, F.when(F.col("b.le") == float("inf"), F.col("b._lo")).otherwise(inside).alias("quantile"))


def breach(col: Column, op: str, threshold: float) -> Column:
    return {">": col > threshold, "<": col < threshold, "==": col == threshold}[op]
