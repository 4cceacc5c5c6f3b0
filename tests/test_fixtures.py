"""Hand-computed cases, one or more per operator that SQL cannot check alone."""

import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, functions as F

from beaconry.functions import scalar, state
from beaconry.operators import (
    admission as B, alerts as H, audit as L, dedup as D, fleet as Q, logs as LG, nodes as N, normalize as C,
    quality as M, rollups as R, rowwindow as G)
from beaconry.plans.tiers import query_fleet, select_tier
from beaconry.sources import envelopes as E, store as S

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def metric_rows(spark, rows):
    """(node, seconds, latency, uptime, loss) with arrival by position."""
    num = lambda v: None if v is None else float(v)
    data = [(n, at(s), num(lat), num(up), num(loss), i) for i, (n, s, lat, up, loss) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "node_id string, time timestamp_ntz, latency_ms double, uptime_pct double, packet_loss double, arrival long")
    return df.withColumns({c: F.col(c).cast(t) for c, t in S.METRIC_TYPES.items()})


def metric(node="n1", **kw):
    base = dict(node_id=node, country="GH", region="Accra", latency_ms=1.0, uptime_pct=100.0, packet_loss=0.0,
                timestamp="2024-01-01T00:00:00Z", target_host=None, probe_type="ping", metadata=None)
    return {**base, **kw}


def envelopes(spark, tmp_path, rows):
    path = str(tmp_path / "env")
    lines = [(json.dumps(r),) for r in rows]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    return E.read_envelopes(spark, path)


def test_a1_a2_explode_drops_foreign_nodes(spark, tmp_path):
    env = envelopes(spark, tmp_path, [dict(batch_id="b", node_id="n1", received_at="2024-01-01T00:00:00Z",
                                           metrics=[metric("n1"), metric("n2"), metric("n1")])])
    assert [r.node_id for r in E.explode_batch(env).collect()] == ["n1", "n1"]


def test_a1_corrupt_line_is_kept_aside(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("{broken",)], "value string").write.text(path)
    row = E.read_envelopes(spark, path).first()
    assert row._corrupt == "{broken" and row.node_id is None


def test_a3_a11_write_and_compact(spark, tmp_path):
    path = str(tmp_path / "m")
    day = 86400
    df = metric_rows(spark, [("b", 0, 1.005, 100, 0), ("a", 5, 2, 100, 0), ("a", 3, 3, 100, 0), ("a", 9 * day, 4, 100, 0)])
    S.write_metrics(df, path)
    assert dict(S.read_metrics(spark, path).dtypes)["latency_ms"] == "decimal(10,2)"
    before = sorted(map(tuple, S.read_metrics(spark, path).collect()))
    S.compact_old(spark, path, "2024-01-10")
    back = S.read_metrics(spark, path)
    assert sorted(map(tuple, back.collect())) == before
    old = back.where(F.col("date") == "2024-01-01").select("node_id", "time").collect()
    assert [(r.node_id, r.time) for r in old] == [("a", at(5)), ("a", at(3)), ("b", at(0))]


def test_a4_a5_first_wins_and_conflict(spark):
    rows = metric_rows(spark, [("n", 0, 1, 100, 0), ("n", 0, 2, 100, 0), ("m", 0, 3, 100, 0)])
    old = metric_rows(spark, [("m", 0, 9, 100, 0)])
    assert [r.arrival for r in D.insert_first_wins(rows, old).collect()] == [0]
    lost = {json.loads(r.payload)["arrival"]: r.ingest_region for r in D.conflict_audit(rows, old).collect()}
    assert lost == {1: "unknown", 2: "unknown"}
    again = D.insert_first_wins(rows, D.insert_first_wins(rows, old).unionByName(old))
    assert again.count() == 0


def test_a6_new_node_name(spark):
    nodes = spark.createDataFrame([("old", "x", "registered", "GH", "Accra", None)],
                                  "node_id string, node_name string, status string, country string, region string, last_seen_at timestamp")
    batch = spark.createDataFrame([("e33e47e7-8cb4-1", None, None, 2), ("old", "GH", "Accra", 1)],
                                  "node_id string, country string, region string, arrival long")
    out = {r.node_id: r for r in N.upsert_nodes(nodes, batch, F.lit("2024-01-01")).collect()}
    new = out["e33e47e7-8cb4-1"]
    assert (new.node_name, new.country, new.region, new.last_seen_at) == ("probe-e33e47e7", "XX", "Unknown", None)
    assert out["old"].last_seen_at == T0 and out["old"].node_name == "x"


def test_a8_partitioned_documents(spark, tmp_path):
    df = spark.createDataFrame([(T0, "a"), (datetime(2024, 2, 3), "b")], "timestamp timestamp_ntz, message string")
    S.write_events(df, str(tmp_path / "e"))
    S.write_logs(df, str(tmp_path / "l"))
    assert {p.name for p in (tmp_path / "e").iterdir() if p.is_dir()} == {"month=2024.01", "month=2024.02"}
    assert {p.name for p in (tmp_path / "l").iterdir() if p.is_dir()} == {"day=2024.01.01", "day=2024.02.03"}


def test_a9_replay(spark, tmp_path):
    (tmp_path / "logs-2026-01-03.ndjson").write_text('{"a":1}\nnot json\n{"_index":"x","_source":{"b":2}}\n')
    good, bad = S.replay_dlq(S.read_dlq(spark, str(tmp_path)), "logs-again")
    assert {(r._index, r._source) for r in good.collect()} == {("logs-again", '{"a":1}'), ("x", '{"b":2}')}
    assert [(r.value, str(r.file_date)) for r in bad.collect()] == [("not json", "2026-01-03")]
    files = S.read_dlq(spark, str(tmp_path)).select("file", "file_date").distinct()
    assert S.retained_files(files, 7, "2026-01-10").count() == 1 and S.retained_files(files, 7, "2026-01-11").count() == 0


def bad_fields(spark, **kw):
    df = spark.createDataFrame([Row(**metric(**kw))], E.METRIC)
    return B.validate_schema(df).first().bad_fields


def test_b1_schema(spark):
    assert bad_fields(spark) == []
    assert bad_fields(spark, latency_ms=10000.0) == [] and bad_fields(spark, latency_ms=10000.01) == ["latency_ms"]
    assert bad_fields(spark, latency_ms=-0.1) == ["latency_ms"] and bad_fields(spark, country="gh") == ["country"]
    assert bad_fields(spark, node="n" * 51) == ["node_id"] and bad_fields(spark, node="n" * 50) == []
    only = dict(country=None, region=None, latency_ms=None, uptime_pct=None, packet_loss=None, timestamp=None)
    assert bad_fields(spark, **only) == ["country", "region", "latency_ms", "uptime_pct", "packet_loss", "timestamp"]


def test_b2_signature(spark):
    body = '{"node_id":"n","x":"é"}'
    msg = f"b1:2024-01-01T00:00:00Z:n1:{hashlib.sha256(body.encode()).hexdigest()}"
    for secret in ("short", "long" * 40):
        sig = hmac.new(secret.encode(), msg.encode(), hashlib.sha256).hexdigest()
        rows = [("b1", "2024-01-01T00:00:00Z", "n1", sig, body), ("b1", "2024-01-01T00:00:00Z", "n1", sig[::-1], body),
                ("b1", None, "n1", "x", body)]
        df = spark.createDataFrame(rows, "batch_id string, timestamp string, nonce string, signature string, body string")
        assert [r.signature_ok for r in B.verify_signature(df, secret).collect()] == [True, False, True]


def env_row(i, s, **kw):
    base = dict(batch_id=f"b{i}", region_id=None, timestamp=at(s).isoformat() + "Z", nonce=f"n{i}", signature="x", body="{}",
                node_id="n1", metrics=[Row(**metric())], received_at=at(s), arrival=i)
    return Row(**{**base, **kw})


ENV = E.ENVELOPE.replace("received_at timestamp", "received_at timestamp_ntz") + ", arrival long"


def test_b4_b5_b6_b7(spark):
    df = spark.createDataFrame([
        env_row(1, 0), env_row(2, 10, nonce="n1", batch_id="b1"), env_row(3, 600, nonce="n1"), env_row(4, 5, batch_id=None)], ENV)
    assert {r.arrival: r.replayed for r in B.reject_replays(df).collect()} == {1: False, 2: True, 3: False, 4: False}
    got = {r.arrival: r.batch_status for r in B.idempotent_batches(df).collect()}
    assert got == {1: "new", 2: "already_processed", 3: "new", 4: "missing_batch_id"}
    df = spark.createDataFrame([
        env_row(1, 0, metrics=[Row(**metric(region="Greater Accra"))]), env_row(2, 0, metrics=[]), env_row(3, 0, region_id="us-x"),
        env_row(4, 0, region_id="ng-lagos")], ENV)
    df = B.derive_region(df)
    assert [r.source_region for r in df.orderBy("arrival").collect()] == ["gh-greater-accra", "unknown", "us-x", "ng-lagos"]
    strict = [r.region_rejected for r in B.check_region(df).orderBy("arrival").collect()]
    assert strict == [True, False, True, False]
    assert not any(r.region_rejected for r in B.check_region(df, mode="lenient").collect())


def test_b8_provenance(spark):
    df = B.enrich_provenance(B.derive_region(spark.createDataFrame([env_row(1, 0)], ENV)), F.col("received_at"), "central")
    meta = df.first()._meta
    assert (meta.schema_version, meta.ingested_by, meta.source_region) == (1, "central", "gh-accra")


@pytest.mark.parametrize("split", [{}, {"hot_rows": 2, "chunk_rows": 2}])
def test_b9_token_bucket(spark, split):
    df = spark.createDataFrame([("k", at(s), i) for i, s in enumerate([0, 0, 0, 1, 1, 60, 60, 60])],
                               "k string, ts timestamp_ntz, arrival long")
    out = B.token_bucket(df, ["k"], "ts", 1, 2, ["arrival"], **split).orderBy("arrival").collect()
    assert [r.allowed for r in out] == [True, True, False, True, False, True, True, False]
    assert out[2].retry_after == 1.0 and out[0].remaining == 1.0 and out[0].retry_after == -1.0


def test_b10_quota(spark):
    df = spark.createDataFrame([("k", at(s), i) for i, s in enumerate([0, 10, 20, 59, 60])],
                               "k string, ts timestamp_ntz, arrival long")
    out = B.fixed_window_quota(df, ["k"], "ts", 2, 60, ["arrival"]).orderBy("arrival").collect()
    assert [r.allowed for r in out] == [True, True, False, False, True]


def test_b11_limits(spark):
    big = Row(**metric(metadata={"x": "y" * 5000}))
    df = spark.createDataFrame([
        env_row(1, 0, metrics=[Row(**metric())] * 1000), env_row(2, 0, metrics=[Row(**metric())] * 1001),
        env_row(3, 0, metrics=[big])], ENV)
    got = [r.limit_error for r in B.check_limits(df).orderBy("arrival").collect()]
    assert got == [None, "too_many_metrics", "metric_too_large"]


def test_c1_to_float(spark):
    df = spark.createDataFrame([(v,) for v in (None, "true", " 12.5 ", "abc", "12d", "nan", "inf", "1_000", "1e3", "-.5")], "v string")
    got = [r[0] for r in df.select(scalar.to_float(F.col("v"), 0)).collect()]
    assert got == [0, 1, 12.5, 0, 0, 0, 0, 0, 1000, -0.5]


def test_c2_to_ts(spark):
    df = spark.createDataFrame([(v,) for v in ("2026-01-01T00:00:00Z", "2026-01-01T02:00:00+02:00", "bad", "1767225600")], "v string")
    got = [r[0] for r in df.select(scalar.to_ts(F.col("v"), F.lit("2020-01-01")).cast("timestamp_ntz")).collect()]
    assert got == [datetime(2026, 1, 1)] * 2 + [datetime(2020, 1, 1), datetime(2026, 1, 1)]


def test_c3_c4_c5_normalize(spark):
    raw = spark.createDataFrame(
        [("n", "ghana", None, "-5", "120", None, "bad", {"cpu_percent": "12", "name": "x", "n_count": "bad"}),
         (None, None, "R", "NaN", "-1", "200", "2024-01-01T00:00:00Z", None)],
        "node_id string, country string, region string, latency_ms string, uptime_pct string, packet_loss string, timestamp string, metadata map<string,string>")
    a, b = C.normalize(raw, F.lit("2020-01-01")).collect()
    assert (a.country, a.region, a.latency_ms, a.uptime_pct, a.packet_loss) == ("GH", "Unknown", 0, 100, 0)
    assert a.metadata == {"cpu_percent": "12.0", "name": "x", "n_count": "0.0"}
    assert (b.node_id, b.country, b.latency_ms, b.uptime_pct, b.packet_loss, b.metadata) == ("unknown", "XX", 0, 0, 100, {})
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(scalar.clamp(F.col("x"), 0.0)).first()[0]
    assert nan == 0


def test_c8_geo(spark):
    names = ["Lagos", " Greater ACCRA ", "Nairobi West", "nowhere", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "region string")
    assert [r.geo_key for r in C.geo_lookup(df).collect()] == ["Lagos", "Accra", "Nairobi", None, None, None]


def test_c9_c13_scalars(spark):
    df = spark.createDataFrame([(None,), (59.9,), (60.0,), (-0.5,)], "s double")
    assert [r[0] for r in df.select(scalar.time_since(F.col("s"))).collect()] == ["Never", "59s ago", "1m ago", "-1s ago"]
    df = spark.createDataFrame([(1.49,), (1.5,), (2.25,), (3.0,)], "z double")
    assert [r[0] for r in df.select(scalar.z_ramp(F.col("z"))).collect()] == [0, 0, 0.5, 1]
    one = spark.range(1)
    assert one.select(scalar.availability_pct(F.lit(0), F.lit(0))).first()[0] == 0
    labels = spark.createDataFrame([(s,) for s in ("HEALTHY", "DEGRADED", "CRITICAL", "DOWN", "STALE", "?")], "s string")
    got = [tuple(r) for r in labels.select(state.authority_label(F.col("s")), state.severity_weight(F.col("s"))).collect()]
    assert got == [("SECURED", 0), ("CONTESTED", 2), ("COMPROMISED", 3), ("COMPROMISED", 4), ("BLACKOUT", 1), ("UNKNOWN", None)]


def test_c16_c18_health(spark):
    df = spark.createDataFrame([(30.0,), (30.1,), (60.1,), (None,)], "lag double")
    assert [r[0] for r in df.select(state.etl_state(F.col("lag"))).collect()] == ["healthy", "degraded", "down", "down"]
    df = spark.createDataFrame([(299.9,), (300.0,), (None,)], "age double")
    assert [r[0] for r in df.select(state.fleet_health(F.col("age"))).collect()] == ["healthy", "unhealthy", "unknown"]


def test_c17_health_rows_leave_metrics(spark):
    df = spark.createDataFrame([("n", "t", {"type": "health", "cpu_pct": "5", "push_ok": "7"}, None), ("n", "t", None, 1.0)],
                               "node_id string, timestamp string, metadata map<string,string>, latency_ms double")
    rest, health = C.split_health(df)
    assert [r.latency_ms for r in rest.collect()] == [1.0]
    assert [(r.cpu_pct, r.push_ok, r.push_err) for r in health.collect()] == [(5.0, 7, None)]


def test_d1_seconds_and_ttl(spark):
    df = metric_rows(spark, [("n", 0.1, 1, 100, 0), ("n", 0.9, 2, 100, 0), ("n", 1.2, 3, 100, 0)])
    assert sorted(r.arrival for r in D.dedup_metrics(df).collect()) == [0, 2]
    df = df.withColumn("rx", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("arrival") * 180))
    assert sorted(r.arrival for r in D.dedup_metrics(df, 180, "rx").collect()) == [0, 1, 2]
    assert sorted(r.arrival for r in D.dedup_metrics(df, 181, "rx").collect()) == [0, 2]


def test_f7_p95(spark):
    df = metric_rows(spark, [("n", i, 10.0 * i, 100, 0) for i in range(1, 11)])
    row = Q.fleet_by_node(df, at(0), at(60)).first()
    assert row.p95_latency == pytest.approx(95.5) and row.availability_pct == 100


def test_f8_region_and_bad_dimension(spark):
    df = metric_rows(spark, [("n", 1, 100, 100, 0), ("m", 1, 200, 99, 0), ("lost", 1, 1, 100, 0)])
    nodes = spark.createDataFrame([("n", "GH", "Accra"), ("m", "GH", "Accra")], "node_id string, country string, region string")
    got = {r.dimension: (r.reporting_count, r.avg_latency) for r in Q.fleet_by_region(df, nodes, at(0), at(9)).collect()}
    assert got == {"Accra/GH": (2, 150.0), "Unknown": (1, 1.0)}
    with pytest.raises(ValueError):
        query_fleet(df, nodes, {}, "invalid", "2024-01-01", "2024-01-02")


def test_f11_sketch_close_to_exact(spark):
    df = metric_rows(spark, [("n", i, float(i % 100), 100, 0) for i in range(2000)])
    got = R.merge_percentile(R.rollup_5m_node(df), 0.95, "node_id").first()
    assert abs(got.latency_quantile - 94.05) < 3 and got.samples == 2000


def test_f12_window_limit(spark):
    df = metric_rows(spark, [("n", 0, 1, 100, 0)])
    with pytest.raises(ValueError, match="WINDOW_TOO_LARGE"):
        Q.cluster_summary(df, "2024-01-01", "2024-01-08 00:00:01")
    assert Q.cluster_summary(df, "2024-02-01", "2024-02-02").first().asDict() == {
        "total_nodes": 0, "avg_latency_ms": 0.0, "avg_uptime_pct": 0.0, "avg_loss_pct": 0.0}
    assert Q.kpi_stats(df.limit(0)).first().asDict() == {"avg_latency": 0.0, "avg_uptime": 0.0, "avg_loss": 0.0, "node_count": 0}


@pytest.mark.parametrize("targets,want", [
    (["central"] * 3, "primary"), (["regional"] * 2, "failover"), (["central", "regional"], "degraded"), ([], "unknown"),
    (["legacy-env", "central"], "primary")])
def test_f17_federation(spark, targets, want):
    rows = [(f"n{i}", t, at(0), i) for i, t in enumerate(targets)] + [("old", "regional", at(-61), 99)]
    hb = spark.createDataFrame(rows, "node_id string, active_target string, timestamp timestamp_ntz, arrival long")
    assert Q.federation_status(hb, at(0)).first().status == want


def rolled(spark, values, **split):
    df = metric_rows(spark, [("n", i, v, 100, 0) for i, v in enumerate(values)])
    return G.rolling_anomaly(df, **split).orderBy("arrival").collect()


def test_g1_g2_rolling(spark):
    last = rolled(spark, [10, 12])[-1]
    assert last.latency_avg_window is None and last.anomaly_score == 0
    last = rolled(spark, [10, 11, 10.5, 10, 11, 10.5, 10, 11, 10, 11, 10.5])[-1]
    assert float(last.latency_avg_window) == 10.5 and last.anomaly_score == 0
    last = rolled(spark, [10] * 9 + [100])[-1]
    assert (float(last.latency_avg_window), float(last.latency_std_window)) == (19.0, 28.46)
    assert float(last.anomaly_score) == pytest.approx(0.8974, abs=1e-4)


def test_g1_hot_node_split_gives_same_rows(spark):
    values = [(i * 37) % 101 + 0.25 for i in range(300)]
    assert rolled(spark, values) == rolled(spark, values, hot_rows=50, chunk_rows=7)


def test_g3_spike(spark):
    df = metric_rows(spark, [("n", 0, 1, 100, 5.0), ("n", 1, 1, 100, 1.0)])
    assert [r.packet_loss_spike for r in G.rolling_anomaly(df).orderBy("arrival").collect()] == [True, False]


def test_g4_trajectory(spark):
    def label(values, **kw):
        df = metric_rows(spark, [("n", i, v, 100, 0) for i, v in enumerate(values)])
        return G.trajectory(df, "latency_ms", ["node_id"], **kw).first().trajectory

    assert label([1] * 9) == "AWAITING" and label([1] * 7 + [7] * 3) == "DEGRADING"
    assert label([1] * 7 + [6] * 3) == "STABILIZING" and label([9] * 3 + [1] * 7, worse="down") == "DEGRADING"


def levels(spark, rows):
    data = [("k", at(s), lv, i) for i, (s, lv) in enumerate(rows)]
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, level int, arrival long")


@pytest.mark.parametrize("split", [{}, {"hot_rows": 1, "chunk_rows": 1}])
def test_g10_debounce(spark, split):
    def shown(rows):
        return [tuple(r) for r in G.debounce(levels(spark, rows), ["k"], "ts", "level", **split).select(
            F.unix_seconds(F.col("changed_at").cast("timestamp")) - 1704067200, "shown").orderBy("changed_at").collect()]

    assert shown([(0, 0), (10, 2), (15, 0)]) == []
    assert shown([(0, 0), (10, 2), (20, 0), (45, 1), (80, 0)]) == [(20, 2), (75, 1), (110, 0)]
    assert shown([(0, 1), (12, 2), (40, 0), (69, 2), (90, 0)]) == [(10, 1), (22, 2), (120, 0)]


def test_g10_badge(spark):
    rows = [("k", at(s), v, i) for i, (s, v) in enumerate([(0, "HEALTHY"), (5, "CRITICAL"), (6, "DEGRADED"), (8, "HEALTHY")])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, status string, arrival long")
    got = [(r.shown_at_start, r.shown_at_end) for r in G.hold_badge(df, ["k"], "ts", "status").orderBy("ts").collect()]
    assert got == [("HEALTHY", "HEALTHY"), ("CRITICAL", "CRITICAL"), ("CRITICAL", "CRITICAL"), ("CRITICAL", "HEALTHY")]


def test_g11_g12(spark):
    df = spark.createDataFrame([("s", at(i), i, float(v)) for i, v in enumerate([10, 20, 5, 15])],
                               "series string, ts timestamp_ntz, arrival long, value double")
    assert G.counter_rate(df, ["series"], "5 minutes", 300).first().rate == pytest.approx(25 / 300)
    df = spark.createDataFrame([("s", 1.0, 50), ("s", 2.0, 90), ("s", 5.0, 100)], "series string, le double, value long")
    assert G.histogram_quantile(df, 0.95, ["series"]).first().quantile == pytest.approx(3.5)


def alerts_of(spark, rows):
    return H.evaluate_rules(metric_rows(spark, rows))


def test_h1_rules(spark):
    got = alerts_of(spark, [("n", 0, 600, 100, 0)]).collect()
    assert [(r.severity, r.metric_name) for r in got] == [("critical", "latency_ms"), ("warning", "latency_ms")]
    assert got[0].message == "CRITICAL LATENCY on n: 600.0ms"
    assert alerts_of(spark, [("n", 0, 50, 100, 0)]).count() == 0
    assert [r.metric_name for r in alerts_of(spark, [("n", 0, 250, 100, 2)]).collect()] == ["latency_ms", "packet_loss"]
    assert alerts_of(spark, [("n", 0, None, None, None)]).count() == 0


def test_h2_cooldown(spark):
    got = H.cooldown(alerts_of(spark, [("n", 0, 300, 100, 0), ("n", 899, 300, 100, 0), ("n", 900, 300, 100, 0)]))
    assert [r.kept for r in got.orderBy("ts").collect()] == [True, False, True]


@pytest.mark.parametrize("split", [{}, {"hot_rows": 2, "chunk_rows": 2}])
def test_h3_h4_h5_dispositions(spark, split):
    # critical + warning latency, critical + warning loss, uptime: five kinds, then a sixth after the cooldown
    df = metric_rows(spark, [("n", 0, 600, 90, 6), ("n", 900, 300, 100, 0)])
    got = [r.disposition for r in H.run_alerts(df, **split).orderBy("ts", "rule_no").collect()]
    assert got == ["sent"] * 5 + ["node_quota"]
    df = metric_rows(spark, [(f"n{i}", 0, 300, 100, 0) for i in range(12)] + [("n0", 1, 300, 100, 0)])
    got = [r.disposition for r in H.run_alerts(df, **split).orderBy("arrival").collect()]
    assert got == ["sent"] * 10 + ["global_limit"] * 2 + ["dedup"]


def test_h6_n2_dispatch(spark, tmp_path):
    alerts = alerts_of(spark, [("n", 0, 600, 100, 0)]).where("rule_no = 0")
    payload = json.loads(H.dispatch_payload(alerts).first().payload)["attachments"][0]
    assert payload["color"] == "#EF4444" and payload["blocks"][0]["text"]["text"].endswith("*CRITICAL*: CRITICAL LATENCY on n: 600.0ms")
    assert payload["blocks"][1]["elements"][0]["text"].startswith("Node: `n` | Time: 2024-01-01T00:00:00")
    calls = []

    def failing(df):
        calls.append(1)
        raise RuntimeError("down")

    assert H.dispatch(alerts, failing, str(tmp_path / "dlq")) is False and len(calls) == 3
    assert spark.read.json(str(tmp_path / "dlq")).first().node_id == "n"
    assert H.dispatch(alerts, H.log_sink(str(tmp_path / "log")), str(tmp_path / "dlq2")) is True
    assert json.loads(spark.read.text(str(tmp_path / "log")).first().value)["event"] == "alert_fired"


def test_h7_include_silent(spark):
    df = metric_rows(spark, [("a", 0, 150, 100, 0), ("old", -900, 1, 100, 0)])
    nodes = spark.createDataFrame([("a", "GH", "r", "registered"), ("old", "NG", "r", "registered"), ("x", "NG", "r", "deleted")],
                                  "node_id string, country string, region string, status string")
    got = {(r.rule, r.node_id) for r in H.window_rules(df, nodes, at(10), include_silent=True).collect()}
    assert got == {("high_latency", "a"), ("latency_gh", "a"), ("node_down", "old")}


def test_h8_pending_holds(spark):
    rows = [("k", at(s), i, b) for i, (s, b) in enumerate([(0, True), (30, True), (60, True), (90, False), (120, True)])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, arrival long, bad boolean")
    for split in ({}, {"hot_rows": 1, "chunk_rows": 1}):
        out = H.pending(df, ["k"], "ts", "bad", 60, **split).orderBy("ts").collect()
        assert [r.state for r in out] == ["pending", "pending", "firing", "inactive", "pending"]


def test_h9_series_rules(spark):
    rows = []
    for i in range(0, 900, 60):
        rows.append(("drop", "log_dropped_total", {"service": "api"}, at(i), i, 20.0 * i))
        rows.append(("dlq", "dlq_size_bytes", {}, at(i), i, 6e7))
        rows.append(("hit", "dashboard_cache_hits_total", {}, at(i), i, 1.0 * i))
        rows.append(("miss", "dashboard_cache_misses_total", {}, at(i), i, 3.0 * i))
        for le, c in (("1", 1.0), ("4", 2.0), ("+Inf", 2.0)):
            rows.append((f"q{le}", "dashboard_cache_latency_seconds_bucket", {"le": le}, at(i), i, c * i))
    df = spark.createDataFrame(rows, "series string, metric string, labels map<string,string>, ts timestamp_ntz, arrival long, value double")
    got = {(r.rule, r.bucket): (r.value, r.state) for r in H.metric_rules(df).collect()}
    assert got[("DLQFilling", at(0))] == (6e7, "firing")
    assert got[("LogsDropped", at(0))] == (20 * 240 / 300, "pending") and got[("LogsDropped", at(300))][1] == "firing"
    assert got[("CacheMissRateHigh", at(300))][0] == pytest.approx(0.75)
    assert got[("DashboardQuerySlow", at(0))][0] == pytest.approx(1 + 3 * (1.9 - 1) / 1)
    assert ("ReplayFailures", at(0)) not in got


@pytest.mark.parametrize("seconds,dim,fresh,want", [
    (60, "node", False, "raw"), (600, "node", False, "1m"), (3600, "node", False, "5m_node"), (3600, "region", False, "5m_region"),
    (86400, "node", False, "hourly"), (7 * 86400, "node", False, "daily"), (300, "node", True, "raw"), (600, "node", True, "1m")])
def test_k10_tiers(seconds, dim, fresh, want):
    assert select_tier(seconds, dim, fresh) == want
    assert select_tier(seconds, dim, fresh, frozenset({want})) == "raw"


def test_l1_l2_chain(spark):
    rows = [("c", i, f"2024-01-01T00:00:0{i}Z", "ann", "ADMIN", "ACT", "é", {"b": "1", "a": "2"}) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "chain string, seq long, ts string, user string, role string, action string, resource string, details map<string,string>")
    built = L.chain_build(df, ["chain"], ["seq"]).orderBy("seq")
    prev = "GENESIS"
    for r in built.collect():
        entry = {"ts": r.ts, "user": "ann", "role": "ADMIN", "action": "ACT", "resource": "é", "details": r.details, "prev_hash": prev}
        prev = hashlib.sha256((json.dumps(entry, sort_keys=True) + prev).encode()).hexdigest()[:16]
        assert r.hash == prev
    lines = built.select("chain", F.col("seq").alias("line"), L.entry_json(built).alias("value"))
    ok = L.chain_verify(lines, ["chain"]).first()
    assert ok.valid and ok.first_broken_line is None
    edited = lines.withColumn("value", F.when(F.col("line") == 2, F.replace("value", F.lit("ACT"), F.lit("NOP"))).otherwise(F.col("value")))
    for split in ({}, {"hot_rows": 1, "chunk_rows": 1}):
        assert L.chain_verify(edited, ["chain"], **split).first().first_broken_line == 2
    garbage = lines.withColumn("value", F.when(F.col("line") == 3, "{").otherwise(F.col("value")))
    assert L.chain_verify(garbage, ["chain"]).first().first_broken_line == 3


def test_l4_logs(spark):
    lines = ['{"trace_id":"t","password":"x","message":"hi"}', '{"a":1}', "plain", '{"trace.id":"u","trace_id":"v"}', '{"trace":{"id":"w"}}']
    out = LG.normalize_logs(spark.createDataFrame([(v,) for v in lines], "message string")).collect()
    assert [r.trace_id for r in out] == ["t", "unknown", "unknown", "u", "w"]
    assert out[0].message == "hi" and "password" not in out[0].fields and out[2].decode_error and out[2].message == "plain"


def test_m1_quality(spark):
    df = metric_rows(spark, [("n", 0, -1, 100, 0), ("n", 0, 1, 100, 0), ("m", 5, 0, 100, 0)])
    r = M.quality_report(df, at(30)).first()
    assert (r.row_count, r.negative_rows, r.duplicate_keys, r.zero_latency_rows, r.distinct_nodes) == (3, 1, 1, 1, 2)
    assert not r.passed and not r.nodes_ok and r.fresh and r.lag_s == 25


def test_k3_refresh_equals_rebuild(spark):
    df = metric_rows(spark, [("n", s, s, 100, 0) for s in range(0, 1200, 7)])
    stale = R.rollup(df.where(F.col("latency_ms") % 2 == 0), "1 minute")
    fresh = R.refresh_rollup(df, stale, "1 minute", 600, 60, at(1200))
    want = R.rollup(df, "1 minute").where(F.col("bucket").between(F.lit(at(600)).cast("timestamp_ntz"), F.lit(at(1080)).cast("timestamp_ntz")))
    got = fresh.where(F.col("bucket").between(F.lit(at(600)).cast("timestamp_ntz"), F.lit(at(1080)).cast("timestamp_ntz")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert fresh.count() == 20 and fresh.where(F.col("bucket") < F.lit(at(600)).cast("timestamp_ntz")).count() == 10
