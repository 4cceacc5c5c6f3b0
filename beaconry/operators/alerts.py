"""Alert rules, suppression, dispatch payloads, windowed rules and hold times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from beaconry.functions import exact
from beaconry.functions.timeutil import Instant, age_seconds, instant, since
from beaconry.operators import admission, ordered, prefix
from beaconry.operators.rowwindow import breach, counter_rate, histogram_quantile


@dataclass(frozen=True)
class Rule:
    """Threshold rule; ``test`` may replace the comparison by any condition on the row."""

    metric: str
    op: str
    threshold: float
    severity: str
    template: str
    test: Callable[[], Column] | None = None

    def fires(self) -> Column:
        cond = self.test() if self.test else breach(F.col(self.metric), self.op, self.threshold)
        return F.coalesce(cond, F.lit(False))

    def message(self) -> Column:
        """Text of an alert, whose measure is its ``value``."""
        text = F.replace(F.lit(self.template), F.lit("{id}"), F.coalesce(F.col("node_id"), F.lit("None")))
        text = F.replace(text, F.lit("{val}"), F.col("value").cast("string"))
        return F.replace(text, F.lit("{limit}"), F.lit(str(float(self.threshold))))


# Default rules in evaluation order.
DEFAULT_RULES = (
    Rule("latency_ms", ">", 500.0, "critical", "CRITICAL LATENCY on {id}: {val}ms"),
    Rule("latency_ms", ">", 200.0, "warning", "High Latency on {id}: {val}ms"),
    Rule("packet_loss", ">", 5.0, "critical", "CRITICAL PACKET LOSS on {id}: {val}%"),
    Rule("packet_loss", ">", 1.0, "warning", "Packet Loss Detected on {id}: {val}%"),
    Rule("uptime_pct", "<", 95.0, "warning", "Low Uptime on {id}: {val}%"),
)

COOLDOWN_S = 900
NODE_LIMIT, NODE_WINDOW_S = 5, 3600
GLOBAL_PER_HOUR, GLOBAL_BURST = 100, 10

# Attachment colour by severity.
COLORS = {"critical": "#EF4444", "warning": "#F59E0B"}


def fired(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """One alert per row and matching rule, in rule order, without what :func:`described` adds; a null measure matches nothing."""
    made = F.array(*[
        F.when(r.fires(), F.struct(
            F.lit(i).alias("rule_no"), F.lit(r.severity).alias("severity"), F.lit(r.metric).alias("metric_name"),
            F.col(r.metric).cast("double").alias("value")))
        for i, r in enumerate(rules)])
    hits = df.select("node_id", F.col("time").alias("ts"), "arrival",
                     F.explode(F.filter(made, lambda x: x.isNotNull())).alias("a"))
    return hits.select("node_id", "ts", "arrival", "a.*")


def described(alerts: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Alerts of :func:`fired` with threshold, message and id after ``value``; columns added since come last.

    They follow from the row and its rule, so steps that shuffle alerts go without them.
    """
    def of_rule(pick: Callable[[Rule], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("rule_no") == i, pick(r)) for i, r in enumerate(rules)])

    ident = F.sha2(F.concat_ws("|", "node_id", F.col("ts").cast("string"), "arrival", "rule_no"), 256)
    own = ["node_id", "ts", "arrival", "rule_no", "severity", "metric_name", "value"]
    return alerts.select(
        *own, of_rule(lambda r: F.lit(float(r.threshold))).alias("threshold"), of_rule(lambda r: r.message()).alias("message"),
        F.substring(ident, 1, 32).alias("alert_id"), *[c for c in alerts.columns if c not in own])


def evaluate_rules(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """One alert per row and matching rule, in rule order; a null measure matches nothing."""
    return described(fired(df, rules), rules)


def cooldown(alerts: DataFrame, seconds: int = COOLDOWN_S) -> DataFrame:
    """Add ``kept``: first alert of its node, measure and severity in the cooldown."""
    out = prefix.windows(alerts, ["node_id", "metric_name", "severity"], "ts", seconds, ["arrival", "rule_no"])
    return out.drop("anchor", "hit")


def node_quota(alerts: DataFrame, limit: int = NODE_LIMIT, window_s: int = NODE_WINDOW_S) -> DataFrame:
    """Add ``hit`` and ``allowed``: at most ``limit`` alerts of a node per window."""
    return admission.fixed_window_quota(alerts, ["node_id"], "ts", limit, window_s, ["arrival", "rule_no"])


def global_bucket(alerts: DataFrame, per_hour: float = GLOBAL_PER_HOUR, burst: int = GLOBAL_BURST,
                  asks: str | None = None, **split) -> DataFrame:
    """Add ``allowed`` from one fleet-wide token bucket with a clock of whole seconds."""
    return admission.shared_bucket(alerts, "ts", per_hour / 3600.0, burst, ["arrival", "rule_no"], asks, **split)


def run_alerts(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, **split) -> DataFrame:
    """All alerts with ``disposition``: dedup, node_quota, global_limit or sent.

    Each stage sees only what the stage before let through; the others have their disposition already.
    """
    marked = cooldown(evaluate_rules(df, rules))
    counted = node_quota(marked.where("kept").drop("kept"))
    asking = ordered.stored(counted.where("allowed").drop("hit", "allowed"), "alerts")  # read twice by the bucket
    done = global_bucket(asking, **split)
    ends = [marked.where("not kept").drop("kept").withColumn("disposition", F.lit("dedup")),
            counted.where("not allowed").drop("hit", "allowed").withColumn("disposition", F.lit("node_quota")),
            done.withColumn("disposition", F.when(F.col("allowed"), "sent").otherwise("global_limit")).drop("allowed")]
    return ends[0].unionByName(ends[1]).unionByName(ends[2])


def dispatch_payload(alerts: DataFrame) -> DataFrame:
    """alert_id and the JSON attachment a chat webhook takes."""
    color = F.when(F.col("severity") == "critical", COLORS["critical"]).otherwise(COLORS["warning"])
    head = F.concat(F.lit("\U0001F6A8 *"), F.upper("severity"), F.lit("*: "), F.col("message"))
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    foot = F.concat(F.lit("Node: `"), F.col("node_id"), F.lit("` | Time: "), when)
    md = lambda text: F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))
    section = F.struct(F.lit("section").alias("type"), md(head).alias("text"))
    context = F.struct(F.lit("context").alias("type"), F.array(md(foot)).alias("elements"))
    body = F.concat(F.lit('{"attachments":[{"color":"'), color, F.lit('","blocks":['), F.to_json(section), F.lit(","),
                    F.to_json(context), F.lit("]}]}"))
    return alerts.select("alert_id", body.alias("payload"))


def dispatch(alerts: DataFrame, sink: Callable[[DataFrame], DataFrame | None], dlq_path: str, attempts: int = 3) -> bool:
    """Give the payloads to ``sink`` (log, webhook, queue) until all are delivered; what is left goes to the dead letters.

    Payloads are written once. A sink returns the ``alert_id`` of what it delivered, or None if that is everything;
    later attempts get the rest only, so an alert that went out is not sent again. A sink that fails in the middle
    and cannot say what went out counts as having delivered nothing.
    """
    left = ordered.stored(dispatch_payload(alerts), "payloads")
    for _ in range(attempts):
        try:
            done = sink(left)
        except Exception:  # noqa: BLE001 - a sink may fail in any way
            continue
        if done is None:
            return True
        left = ordered.stored(left.join(done.select("alert_id").distinct(), "alert_id", "left_anti"), "payloads")
        if left.isEmpty():
            return True
    alerts.join(left, "alert_id").write.mode("append").json(dlq_path)
    return False


def log_sink(path: str) -> Callable[[DataFrame], None]:
    """Sink that appends each payload as a log line."""

    def write(payloads: DataFrame) -> None:
        payloads.select(F.to_json(F.struct(
            F.lit("alert_fired").alias("event"), F.lit("alert log").alias("source"),
            F.col("payload").alias("alert"))).alias("value")).write.mode("append").text(path)

    return write


# --- windowed rules ---------------------------------------------------------------------------------------------

# Latency limits by lower-case country code.
COUNTRY_LATENCY = {"gh": 80.0, "ng": 100.0, "ke": 90.0}


def window_rules(df: DataFrame, nodes: DataFrame, now: Instant, countries: dict[str, float] | None = None,
                 include_silent: bool = False) -> DataFrame:
    """Breaches over the last minutes: rule, node and value.

    node_down: last sample of the past ten minutes older than 300 s. high_latency: five-minute mean over 100.
    packet_loss: five-minute mean over 1. latency_<cc>: five-minute mean over the country's limit.
    ``include_silent`` adds known nodes without any sample in ten minutes, value null.
    """
    countries = COUNTRY_LATENCY if countries is None else countries
    at = instant(df, "time", now)
    ten = since(df, "time", now, "10 minutes")
    recent = F.col("time") > at - F.expr("INTERVAL 5 minutes")
    lat, loss = exact.units(df, "latency_ms"), exact.units(df, "packet_loss")

    def recent_mean(x: Column, name: str) -> Column:
        one = F.lit(10 ** (exact.scale_of(df, name) or 0))
        return F.sum(F.when(recent, x)) / F.nullif(F.count(F.when(recent, x)) * one, F.lit(0))

    per_node = ten.groupBy("node_id").agg(
        F.max("time").alias("last"), recent_mean(lat, "latency_ms").alias("lat"),
        recent_mean(loss, "packet_loss").alias("loss"))
    dim = nodes.select("node_id", F.lower("country").alias("cc"), F.col("status"))
    both = per_node.join(dim, "node_id", "full" if include_silent else "left")
    lag = age_seconds(both, "last", now)
    found = [F.when(lag > 300, F.struct(F.lit("node_down").alias("rule"), lag.alias("value")))]
    if include_silent:
        found.append(F.when(F.col("last").isNull() & (F.col("status") != "deleted"), F.struct(
            F.lit("node_down").alias("rule"), F.lit(None).cast("double").alias("value"))))
    found.append(F.when(F.col("lat") > 100, F.struct(F.lit("high_latency").alias("rule"), F.col("lat").alias("value"))))
    found.append(F.when(F.col("loss") > 1.0, F.struct(F.lit("packet_loss").alias("rule"), F.col("loss").alias("value"))))
    for cc, limit in countries.items():
        found.append(F.when((F.col("cc") == cc) & (F.col("lat") > limit), F.struct(
            F.lit(f"latency_{cc}").alias("rule"), F.col("lat").alias("value"))))
    rows = both.select("node_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select(F.col("f.rule").alias("rule"), "node_id", F.col("f.value").alias("value"))


def pending(df: DataFrame, keys: list[str], ts: str, condition: str, hold_s: float | Column, **split) -> DataFrame:
    """Add ``state`` per evaluation: inactive, pending, or firing once the condition held for ``hold_s`` without a break."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    order = [ts, "arrival"]

    def logic(part: DataFrame, g: ordered.Keys) -> DataFrame:
        part = g.lags(part, order, {"_was": condition})
        rose = F.col(condition) & ~F.coalesce(F.col("_was"), F.lit(False))
        return g.last_known(part.withColumn("_rose", F.when(rose, us)), order, {"_since": "_rose"})

    df = df.withColumn(condition, F.coalesce(F.col(condition), F.lit(False)))
    rows = ordered.per_key(df, keys, ts, logic, **split)
    held = (us - F.col("_since")) / 1e6
    state = F.when(~F.col(condition), "inactive").when(held >= hold_s, "firing").otherwise("pending")
    return rows.withColumn("state", state).drop("_was", "_rose", "_since")


@dataclass(frozen=True)
class SeriesRule:
    """Rule over sampled series. ``kind``: gauge, rate, ratio (first over all named metrics) or quantile."""

    name: str
    kind: str
    metrics: tuple[str, ...]
    op: str
    threshold: float
    hold_s: int
    severity: str
    q: float = 0.0
    label: tuple[str, str] | None = None


# Service rules.
SERIES_RULES = (
    SeriesRule("AggregateStale", "gauge", ("aggregate_health_status",), "==", 0, 300, "warning"),
    SeriesRule("AggregateFallbackHigh", "rate", ("aggregate_fallback_total",), ">", 0.1, 120, "warning"),
    SeriesRule("CacheMissRateHigh", "ratio", ("dashboard_cache_misses_total", "dashboard_cache_hits_total"), ">", 0.5, 300, "info"),
    SeriesRule("DashboardQuerySlow", "quantile", ("dashboard_cache_latency_seconds_bucket",), ">", 2, 300, "warning", 0.95),
    SeriesRule("AggregateCircuitOpen", "gauge", ("aggregate_circuit_breaker_open",), "==", 1, 60, "critical"),
    SeriesRule("LogsDropped", "rate", ("log_dropped_total",), ">", 10, 120, "warning"),
    SeriesRule("DLQFilling", "gauge", ("dlq_size_bytes",), ">", 50000000, 0, "critical"),
    SeriesRule("ESIngestionSlow", "quantile", ("es_bulk_duration_seconds_bucket",), ">", 5, 300, "warning", 0.99),
    SeriesRule("MissingTraceRatio", "ratio", ("log_messages_total",), ">", 0.1, 300, "warning", label=("trace_id", "unknown")),
    SeriesRule("LogSurge", "rate", ("log_messages_total",), ">", 1000, 120, "warning"),
    SeriesRule("ReplayFailures", "rate", ("dlq_replay_events_total",), ">", 0, 0, "critical", label=("status", "failed")),
)


def metric_rules(samples: DataFrame, rules: tuple[SeriesRule, ...] = SERIES_RULES, window: str = "5 minutes",
                 window_s: float = 300) -> DataFrame:
    """Evaluate service rules per window: rule, scope (series or service), bucket, value and state.

    ``samples``: series, metric, labels, ts, arrival, value. Rates and quantiles use the samples of one window;
    hold times compare window starts.
    """
    # labels are constant within a series
    labels = samples.groupBy("series").agg(F.first("labels").alias("labels"))
    rates = counter_rate(samples.drop("labels"), ["series", "metric"], window, window_s).join(labels, "series")
    rates = rates.withColumn("service", F.coalesce(F.try_element_at("labels", F.lit("service")), F.lit("")))
    last = samples.groupBy("series", "metric", F.window("ts", window)["start"].alias("bucket")).agg(
        F.max_by("value", F.struct("ts", "arrival")).cast("double").alias("value"))

    def tagged(r: SeriesRule) -> Column:
        if not r.label:
            return F.lit(True)
        return F.coalesce(F.try_element_at("labels", F.lit(r.label[0])) == r.label[1], F.lit(False))

    def matched(df: DataFrame, kind: str) -> DataFrame:
        """One row per input row and rule of the kind that reads its metric; ``_top`` marks numerator rows."""
        hits = [
            F.when(F.col("metric").isin(*r.metrics) & (F.lit(True) if kind == "ratio" else tagged(r)), F.struct(
                F.lit(i).alias("_rule"), ((F.col("metric") == r.metrics[0]) & tagged(r)).alias("_top"), F.lit(r.q).alias("_q")))
            for i, r in enumerate(rules) if r.kind == kind]
        if not hits:
            return df.limit(0).select("*", F.lit(0).alias("_rule"), F.lit(False).alias("_top"), F.lit(0.0).alias("_q"))
        hit = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_hit")
        return df.select("*", hit).select(*df.columns, "_hit.*")

    gauge = matched(last, "gauge").select("_rule", F.col("series").alias("scope"), "bucket", "value")
    rate = matched(rates, "rate").select("_rule", F.col("series").alias("scope"), "bucket", F.col("rate").alias("value"))
    top = F.sum(F.when(F.col("_top"), F.col("rate")))
    ratio = matched(rates, "ratio").groupBy("_rule", F.col("service").alias("scope"), "bucket").agg(
        (F.coalesce(top, F.lit(0.0)) / F.nullif(F.sum("rate"), F.lit(0.0))).alias("value"))
    le = F.try_element_at("labels", F.lit("le"))
    le = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.try_cast("double"))
    buckets = matched(rates, "quantile").groupBy("_rule", "_q", F.col("service").alias("scope"), "bucket", le.alias("le")).agg(
        F.sum("rate").alias("value"))
    quantile = histogram_quantile(buckets, F.col("_q"), ["_rule", "_q", "scope", "bucket"]).select(
        "_rule", "scope", "bucket", F.col("quantile").alias("value"))
    found = gauge.unionByName(rate).unionByName(ratio).unionByName(quantile)

    def of_rule(pick: Callable[[SeriesRule], object]) -> Column:
        return F.element_at(F.array(*[pick(r) if isinstance(pick(r), Column) else F.lit(pick(r)) for r in rules]), F.col("_rule") + 1)

    out = found.select(
        of_rule(lambda r: r.name).alias("rule"), of_rule(lambda r: r.severity).alias("severity"), "scope", "bucket", "value",
        F.lit(0).cast("long").alias("arrival"), of_rule(lambda r: breach(F.col("value"), r.op, r.threshold)).alias("breached"),
        of_rule(lambda r: r.hold_s).alias("hold_s"))
    # one row per window and scope: a key grows with time, not with samples
    out = pending(out, ["rule", "scope"], "bucket", "breached", F.col("hold_s"), hot_rows=None)
    return out.drop("arrival", "hold_s")
