"""Streams over several input files give what the batch operators give."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beaconry.operators import admission as B, alerts as H, dedup as D, rollups as R, rowwindow as G
from beaconry.operators.ordered import stored
from beaconry.plans.q_streaming import run_to_end
from beaconry.session import passing, reading_on, scratch_dir
from beaconry.sources import adapters as A, envelopes as E, store as S
from beaconry.streaming import carried, jobs, state


@pytest.fixture(scope="module")
def split(spark, sf, tmp_path_factory):
    """Metrics in time = arrival order, as five files read one per micro-batch."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    order = A.metrics(spark, sf).orderBy("time", "arrival").drop("arrival").coalesce(1)
    numbered = order.withColumn("arrival", F.monotonically_increasing_id()).cache()
    n = numbered.count()
    for i in range(5):
        part = numbered.where((F.col("arrival") >= n * i // 5) & (F.col("arrival") < n * (i + 1) // 5))
        part.coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)

    def stream():
        return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return batch, stream


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_rollup_equals_batch_for_closed_buckets(split):
    batch, stream = split
    got = run_to_end(jobs.stream_rollup(stream(), "1 minute"), "r").cache()
    want = R.rollup_1m(batch).withColumn("bucket", F.col("bucket").cast("timestamp"))
    last = got.agg(F.max("bucket")).first()[0]
    assert got.count() > 0
    same(got, want.where(F.col("bucket") <= F.lit(last)))


def test_region_rollup_equals_batch(split, spark, sf):
    batch, stream = split
    nodes = A.nodes(spark, sf)
    got = run_to_end(jobs.stream_region_rollup(stream(), nodes), "rr").cache()
    last = got.agg(F.max("bucket")).first()[0]
    want = R.rollup_5m_region(batch, nodes).withColumn("bucket", F.col("bucket").cast("timestamp"))
    cols = ["bucket", "region", "avg_latency", F.round("std_latency", 6).alias("sd"), "avg_loss", "avg_uptime", "samples"]
    same(got.select(*cols), want.where(F.col("bucket") <= F.lit(last)).select(*cols))


def test_dedup_equals_batch(split):
    batch, stream = split
    same(run_to_end(jobs.stream_dedup(stream()), "d").select("arrival"), D.dedup_metrics(batch).select("arrival"))


def test_anomaly_equals_batch(split):
    batch, stream = split
    cols = ["arrival", "latency_avg_window", "latency_std_window", "packet_loss_spike", "anomaly_score"]
    same(run_to_end(state.stream_anomaly(stream()), "a").select(*cols), G.rolling_anomaly(batch).select(*cols))


def test_alerts_equal_batch(split):
    batch, stream = split
    double = lambda df: df.withColumn("latency_ms", (F.col("latency_ms") * 3).cast("decimal(10,2)"))
    got = run_to_end(state.stream_alerts(double(stream())), "h").select("arrival", "rule_no", "disposition")
    want = H.run_alerts(double(batch)).select("arrival", "rule_no", "disposition")
    same(got, want)
    assert {r.disposition for r in want.collect()} >= {"sent", "dedup", "global_limit"}


def test_token_bucket_equals_batch(split):
    batch, stream = split
    cols = ["arrival", "allowed", F.round("remaining", 6).alias("left")]
    same(run_to_end(state.stream_token_bucket(stream(), ["node_id"], "time", 0.002, 2), "t").select(*cols),
         B.token_bucket(batch, ["node_id"], "time", 0.002, 2, ["arrival"]).select(*cols))


def test_heartbeats_expire(spark, tmp_path):
    path = str(tmp_path / "hb")
    rows = [[("a", "central", 0, 0), ("b", "regional", 0, 1)], [("a", "regional", 50, 2)], [("a", "regional", 100, 3)],
            [("c", "central", 300, 4)], [("c", "central", 310, 5)]]
    for part in rows:
        df = spark.createDataFrame(part, "node_id string, active_target string, s long, arrival long")
        df.withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1704067200)).drop("s").coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema("node_id string, active_target string, arrival long, timestamp timestamp").option(
        "maxFilesPerTrigger", 1).parquet(path)
    out = run_to_end(state.stream_heartbeats(src), "hb")
    got = {(r.node_id, r.active_target, r.s, r.live) for r in out.withColumn("s", F.unix_seconds("at") - 1704067200).collect()}
    beats = {(n, t, s) for part in rows for n, t, s, _ in part}
    assert {x[:3] for x in got if x[3]} == beats
    # b from 0, a from 100 and nothing else: 0 -> 50 -> 100 are within the TTL, c's end lies beyond the watermark
    assert {x for x in got if not x[3]} == {("b", "regional", 60, False), ("a", "regional", 160, False)}
    whole = spark.readStream.schema(src.schema).parquet(path)
    same(run_to_end(state.stream_heartbeats(whole), "hb"), out)


def test_heartbeats_expire_in_every_gap(spark, tmp_path):
    path = str(tmp_path / "gaps")
    for i, s in enumerate((0, 100, 300, 330, 1000)):
        df = spark.createDataFrame([("a", "central", s, i)], "node_id string, active_target string, s long, arrival long")
        df.withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1704067200)).drop("s").coalesce(1).write.mode("append").parquet(path)
    schema = "node_id string, active_target string, arrival long, timestamp timestamp"
    for files in (1, 3, 100):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        out = run_to_end(state.stream_heartbeats(src), "gaps").withColumn("s", F.unix_seconds("at") - 1704067200)
        assert sorted((r.s, r.live) for r in out.collect()) == [
            (0, True), (60, False), (100, True), (160, False), (300, True), (330, True), (390, False), (1000, True)]


def test_first_use_stream_equals_batch(spark, sf, tmp_path):
    env = E.order_envelopes(spark, sf).drop("metrics").orderBy("received_at", "arrival")
    env = env.withColumn("one", F.lit(1))
    path = str(tmp_path / "env")
    env.coalesce(1).write.parquet(path)
    src = spark.readStream.schema(env.schema).parquet(path)
    got = run_to_end(jobs.stream_first_use(src, "nonce", "1000000 seconds"), "fu").select("nonce")
    assert sorted(r.nonce for r in got.collect()) == sorted(r.nonce for r in env.select("nonce").distinct().collect())


def test_late_rows_are_routed_and_repaired(spark, tmp_path):
    path = tmp_path / "m"
    for part in ([0, 30, 600], [10, 620], [15, 700]):
        df = spark.createDataFrame([("n", s, float(s)) for s in part], "node_id string, s long, v double")
        df.select("node_id", F.timestamp_seconds("s").alias("time"), F.col("v").cast("decimal(10,2)").alias("latency_ms"),
                  F.lit(100).cast("decimal(5,2)").alias("uptime_pct"), F.lit(0).cast("decimal(5,2)").alias("packet_loss")
                  ).coalesce(1).write.mode("append").parquet(str(path))
    schema = spark.read.parquet(str(path)).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    dirs = [str(tmp_path / d) for d in ("main", "late", "progress", "ck")]
    jobs.route_late(src, *dirs, lateness_s=300).awaitTermination()
    late = spark.read.parquet(dirs[1])
    assert sorted(int(r.latency_ms) for r in late.collect()) == [10, 15]
    main = spark.read.parquet(dirs[0]).drop("epoch")
    repaired = R.refresh_rollup(main.unionByName(late.drop("epoch")), R.rollup_1m(main), "1 minute", 720, 600, "1970-01-01 00:12:00")
    first = {r.bucket.minute: r.samples for r in repaired.collect()}
    assert first[0] == 4 and first[10] == 2


def test_ingest_stream_end_to_end(spark, tmp_path):
    secret = "s"

    def env(i, s, metrics, batch=None, nonce=None, sig=None):
        body = json.dumps(metrics)
        ts = f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
        import hashlib
        import hmac
        bid, non = batch or f"b{i}", nonce or f"n{i}"
        good = hmac.new(secret.encode(), f"{bid}:{ts}:{non}:{hashlib.sha256(body.encode()).hexdigest()}".encode(),
                        hashlib.sha256).hexdigest()
        return dict(batch_id=bid, timestamp=ts, nonce=non, signature=sig or good, body=body, node_id="n1",
                    metrics=metrics, received_at=ts)

    def m(s, lat=1.0, **kw):
        return dict(node_id="n1", country="GH", region="Accra", latency_ms=lat, uptime_pct=100.0, packet_loss=0.0,
                    timestamp=f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", **kw)

    files = [
        [env(1, 0, [m(0), m(1)]), env(2, 1, [m(2)], sig="bad"), env(3, 2, [m(0, 9.0)])],
        [env(4, 30, [m(1, 8.0), m(30)]), env(5, 31, [m(31)], batch="b1"), env(6, 32, [m(32, 99999.0)]), env(7, 33, [m(33)], nonce="n1")],
        [env(8, 300, [m(1, 7.0), m(300, None, metadata={"type": "health", "cpu_pct": "12.5"})])],
    ]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i, rows in enumerate(files):
        (src / f"f{i}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = E.read_envelopes(spark, str(src), streaming=True, files_per_batch=1)
    for _ in range(2):  # a second run finds nothing new
        jobs.ingest_stream(stream, out, str(tmp_path / "ck"), secret).awaitTermination()
    got = sorted((r.time.second, float(r.latency_ms)) for r in S.read_metrics(spark, f"{out}/metrics").collect())
    assert got == [(0, 1.0), (1, 1.0), (30, 1.0)]
    # 9.0 and 8.0 repeat a second within its 180 s; 7.0 comes later and meets a stored row
    lost = sorted(json.loads(r.payload)["latency_ms"] for r in spark.read.parquet(f"{out}/conflicts").collect())
    assert lost == [7.0]
    refused = sorted((r.batch_id, r.reason) for r in spark.read.parquet(f"{out}/rejected").collect())
    assert refused == [("b1", "already_processed"), ("b2", "bad_signature"), ("b6", "invalid_payload"), ("b7", "nonce_replay")]
    reports = spark.read.parquet(f"{out}/health").collect()
    assert [(r.node_id, r.cpu_pct) for r in reports] == [("n1", 12.5)]
    nodes = spark.read.parquet(f"{out}/nodes")
    newest = nodes.where(F.col("epoch") == nodes.agg(F.max("epoch")).first()[0]).collect()
    assert [(r.node_id, r.node_name, r.country, r.last_seen_at is not None) for r in newest] == [("n1", "probe-n1", "GH", True)]
    summary = sorted(tuple(r) for r in spark.read.parquet(f"{out}/summary").select(
        "epoch", "rows_processed", "rows_failed", "duplicate_count", "active_probes").collect())
    assert summary == [(0, 2, 0, 1, 1), (1, 1, 0, 1, 1), (2, 0, 0, 1, 1)]
    # the ingested table is the one that compaction works on
    before = sorted(S.read_metrics(spark, f"{out}/metrics").select("time", "latency_ms").collect())
    assert S.compact_old(spark, f"{out}/metrics", "2024-01-10 00:00:00") == ["2024-01-01"]
    assert sorted(S.read_metrics(spark, f"{out}/metrics").select("time", "latency_ms").collect()) == before


def _envelopes(spark, sf, rows):
    """Accepted and refused envelopes of orders: (key, customer, status, price, day, priority)."""
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day int, o_orderpriority string")
    orders = orders.withColumn("o_orderdate", F.expr("timestamp_ntz'1992-01-01 00:00:00' + make_dt_interval(day)")).drop("day")
    return E.as_envelopes(orders).withColumn("received_at", F.col("received_at").cast("timestamp"))


def test_ingest_sets_little_aside_and_leaves_nothing(spark, sf, tmp_path):
    """Bodies, signatures and the metrics of refused envelopes are not written again; scratch folders go with their micro-batch."""
    rows = [(i, i, "F" if i % 3 else "P", float(i), i // 4, "1-URGENT") for i in range(40)]
    env = _envelopes(spark, sf, rows)
    told = jobs.judged_alone(B.single_checks(env, E.SECRET))
    assert not {"body", "signature", "nonce", "timestamp"} & set(told.columns)
    assert told.where("metrics is not null and (early is not null or late is not null)").isEmpty()
    assert told.where("metrics is not null").count() == 26 and told.where("late is not null").count() == 14
    env.write.parquet(str(tmp_path / "in"))
    kept = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(kept.iterdir()) if kept.exists() else set()
    stream = spark.readStream.schema(env.schema).parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), E.SECRET, ("gh-accra",)).awaitTermination()
    assert set(kept.iterdir()) == before
    assert spark.conf.get("spark.beaconry.scratch", None) is None
    assert S.read_metrics(spark, str(tmp_path / "out" / "metrics")).count() == 26
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).where("reason = 'bad_signature'").count() == 14


def test_conflicts_are_written_once(spark, tmp_path, monkeypatch):
    """A sample that is stored already goes to the conflicts with its payload, which is not set aside before; the summary counts it."""
    aside, out = [], str(tmp_path / "out")

    def spied(df, name="rows", path=None):
        aside.append(set(df.columns))
        return stored(df, name, path)

    monkeypatch.setattr(jobs, "stored", spied)
    for epoch, wait in enumerate((0, 300)):
        rows = spark.sql(f"""SELECT timestamp'2024-01-01' AS time, 'n1' AS node_id, 1.5BD AS latency_ms, 100BD AS uptime_pct, 0BD AS packet_loss,
            timestamp'2024-01-01' + make_dt_interval(0, 0, 0, {wait}) AS received_at, 'gh-accra' AS source_region, 'e{epoch}#1' AS envelope,
            {epoch}L AS arrival, 'GH' AS country, 'Accra' AS region, date'2024-01-01' AS date""")
        rows = rows.withColumns({c: F.col(c).cast(t) for c, t in S.METRIC_TYPES.items()})
        jobs._store(spark, rows, out, epoch, {"failed": 0, "valid": 1}, H.DEFAULT_RULES)
    assert aside and not any("payload" in columns for columns in aside)
    lost = spark.read.parquet(f"{out}/conflicts").collect()
    assert [(r.epoch, json.loads(r.payload)["envelope"], r.ingest_region) for r in lost] == [(1, "e1#1", "gh-accra")]
    told = spark.read.parquet(f"{out}/summary").orderBy("epoch").select("rows_processed", "duplicate_count").collect()
    assert [tuple(r) for r in told] == [(1, 0), (0, 1)]


def test_passing_scratch_goes_after_an_error_too(spark):
    folder = None
    with pytest.raises(RuntimeError):
        with passing(spark, "block") as folder:
            rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "rows")
            assert rows.count() == 7 and len(list(Path(folder).iterdir())) == 1
            with reading_on(spark):
                assert [r["k"] for r in rows.orderBy("k").toLocalIterator()] == list(range(7))
            raise RuntimeError
    assert not Path(folder).exists()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_scores_and_alerts_go_on_over_micro_batches(spark, sf):
    rows = A.metrics(spark, sf).select("time", "node_id", (F.col("latency_ms") * 2).cast("decimal(10,2)").alias("latency_ms"), "uptime_pct",
                                       "packet_loss", "arrival").orderBy("time", "arrival").toPandas()
    rows["arrival"] = range(len(rows))
    schema = "time timestamp_ntz, node_id string, latency_ms decimal(10,2), uptime_pct decimal(5,2), packet_loss decimal(5,2), arrival long"
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, G.rolling_anomaly(whole).select("arrival", "latency_avg_window", "latency_std_window", "packet_loss_spike", "anomaly_score").collect()))
    fired = sorted(map(tuple, H.run_alerts(whole).select("arrival", "rule_no", "disposition").collect()))
    assert {d for _, _, d in fired} == {"dedup", "node_quota", "global_limit", "sent"}
    for parts in (1, 3):
        root, scores, alerts = scratch_dir(spark, "carried"), [], []
        for epoch in range(parts):
            part = whole.where(F.floor(F.col("arrival") * parts / len(rows)) == epoch)
            for _ in range(1 + (epoch == 1)):  # a replayed micro-batch gives the same rows
                a = carried.scores(part, root, epoch).select("arrival", "latency_avg_window", "latency_std_window", "packet_loss_spike", "anomaly_score").collect()
                b = carried.dispositions(H.evaluate_rules(part), root, epoch).select("arrival", "rule_no", "disposition").collect()
            scores += a
            alerts += b
        assert sorted(map(tuple, scores)) == want
        assert sorted(map(tuple, alerts)) == fired


def test_alerts_are_described_after_they_are_judged(spark, sf, monkeypatch):
    """Messages and ids follow from row and rule; nothing that is set aside holds them, and alerts come out as from the batch operators."""
    rows = A.metrics(spark, sf).withColumn("latency_ms", (F.col("latency_ms") * 2).cast("decimal(10,2)"))
    aside = []

    def spied(df, name="rows", path=None):
        aside.append(set(df.columns))
        return stored(df, name, path)

    monkeypatch.setattr(carried.ordered, "stored", spied)
    monkeypatch.setattr(carried.prefix, "stored", spied)
    got = H.described(carried.dispositions(H.fired(rows), scratch_dir(spark, "carried"), 0))
    monkeypatch.undo()
    assert aside and not any({"message", "alert_id", "threshold"} & columns for columns in aside)
    want = H.run_alerts(rows)
    assert got.columns == want.columns and got.count() > 0
    same(got, want)


def test_state_is_written_whole_now_and_then_and_expires(spark):
    root = scratch_dir(spark, "state")
    for epoch in range(20):
        state = carried.Carried(spark, root, "k string, v long", ["k"])
        assert {r["k"]: r["v"] for r in state.before(epoch).collect()} == ({} if not epoch else {
            **{f"k{i}": i for i in range(epoch) if epoch <= 16 or i > 3}})
        state.write(spark.createDataFrame([(f"k{epoch}", epoch)], "k string, v long"), epoch, F.col("v") > 3)
