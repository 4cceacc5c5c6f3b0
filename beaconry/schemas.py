"""Schemas of messages and tables."""

from __future__ import annotations

METRIC = (
    "node_id string, country string, region string, latency_ms double, uptime_pct double, packet_loss double, "
    "timestamp string, target_host string, probe_type string, metadata map<string,string>"
)
ENVELOPE = (
    "batch_id string, region_id string, timestamp string, nonce string, signature string, body string, "
    f"node_id string, metrics array<struct<{METRIC.replace(' string', ':string').replace(' double', ':double').replace(' map', ':map')}>>, "
    "received_at timestamp"
)

# Admission limits of one metric and one batch.
MAX_METRIC_BYTES = 4 * 1024
MAX_BATCH_BYTES = 10 * 1024 * 1024
MAX_BATCH_METRICS = 1000
