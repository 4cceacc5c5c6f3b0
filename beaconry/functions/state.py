"""Status classification: node state, labels, KPI bands and service health."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# State severity for sorting.
SEVERITY_WEIGHT = {"DOWN": 4, "CRITICAL": 3, "DEGRADED": 2, "STALE": 1, "HEALTHY": 0}

# Display label of each state.
AUTHORITY_LABEL = {
    "HEALTHY": "SECURED",
    "DEGRADED": "CONTESTED",
    "CRITICAL": "COMPROMISED",
    "DOWN": "COMPROMISED",
    "STALE": "BLACKOUT",
}


def performance_level(latency: Column, loss: Column) -> Column:
    """2 critical (latency > 200 or loss > 5), 1 degraded (> 100 or > 1), else 0; null never exceeds."""
    critical = F.coalesce(latency > 200, F.lit(False)) | F.coalesce(loss > 5, F.lit(False))
    degraded = F.coalesce(latency > 100, F.lit(False)) | F.coalesce(loss > 1, F.lit(False))
    return F.when(critical, 2).when(degraded, 1).otherwise(0)


def node_state(age_s: Column, latency: Column, loss: Column, stale_s: float = 30.0) -> Column:
    level = performance_level(latency, loss)
    return (
        F.when(age_s.isNull() | (age_s > stale_s), "STALE")
        .when(level == 2, "CRITICAL").when(level == 1, "DEGRADED").otherwise("HEALTHY")
    )


def _lookup(col: Column, values: dict, default) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


def authority_label(state: Column) -> Column:
    return _lookup(state, AUTHORITY_LABEL, "UNKNOWN")


def severity_weight(state: Column) -> Column:
    return _lookup(state, SEVERITY_WEIGHT, F.lit(None).cast("int"))


def latency_band(v: Column) -> Column:
    return F.when(v > 150, "critical").when(v > 100, "degraded").otherwise("healthy")


def uptime_band(v: Column) -> Column:
    return F.when(v < 98, "critical").when(v < 99.5, "degraded").otherwise("healthy")


def loss_band(v: Column) -> Column:
    return F.when(v > 2, "critical").when(v > 0.5, "degraded").otherwise("neutral")


def etl_state(lag_s: Column) -> Column:
    return F.when(lag_s <= 30, "healthy").when(lag_s <= 60, "degraded").otherwise("down")


def fleet_health(age_s: Column) -> Column:
    return F.when(age_s.isNull(), "unknown").when(age_s < 300, "healthy").otherwise("unhealthy")
