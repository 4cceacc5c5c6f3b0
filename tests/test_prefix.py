"""Cooldowns and windows by parallel prefix against brute force: hot keys, single instants, odd rows and bounds of the maps."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from beaconry.operators import admission as B, prefix as P


def brute(rows, gap):
    """{arrival: (kept, hit)} of (key, second, arrival)."""
    out, state = {}, {}
    for key, s, arrival in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -10**9 if r[1] is None else r[1], r[2])):
        last, n = state.get(key, (None, 0))
        t = -10**9 if s is None else s
        if last is None or t - last >= gap:
            state[key] = (t, 1)
            out[arrival] = (True, 1)
        else:
            state[key] = (last, n + 1)
            out[arrival] = (s is None, n + 1)
    return out


def run(spark, rows, gap, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "key string, s long, arrival long").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
        got = P.windows(df, ["key"], "ts", gap, ["arrival"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    return {r["arrival"]: (r["kept"], r["hit"]) for r in got}, got


def skewed(n=500):
    rng, rows, t = random.Random(7), [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 3, 40])
        rows.append(("hot", t, i))
    rows += [(f"k{k}", rng.randrange(500), 1000 + 10 * k + j) for k in range(5) for j in range(6)]
    rows += [(None, 3, 5000), (None, 4, 5001), ("hot", None, 5002), ("hot", None, 5003), ("cold", None, 5004), ("zz", 9, 5005)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("gap,parts", [(1, 9), (7, 1), (7, 9), (100, 16), (5000, 7)])
def test_equals_brute_force(spark, gap, parts):
    rows = skewed()
    found, got = run(spark, rows, gap, parts)
    assert found == brute(rows, gap)
    by = {r["arrival"]: r for r in got}
    assert by[5002]["anchor"] is None and by[5002]["kept"]
    times = {a: s for _, s, a in rows}
    assert all(r["anchor"].timestamp() == times[r["arrival"]] for r in got if r["kept"] and r["ts"] is not None)


def test_one_key_and_one_instant(spark):
    rows = [("all", 50, i) for i in range(300)]
    assert run(spark, rows, 10, 8)[0] == brute(rows, 10) == {i: (i == 0, i + 1) for i in range(300)}
    rows = [("all", i // 40, i) for i in range(400)]
    assert run(spark, rows, 3, 11)[0] == brute(rows, 3)


def test_no_rows(spark):
    assert run(spark, [], 5, 4)[0] == {}


times = st.lists(st.integers(0, 60), min_size=1, max_size=40).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(times, min_size=1, max_size=5), st.integers(1, 30), st.integers(-20, 90), st.integers(0, 5))
def test_maps_compose_like_the_chain(chunks, gap, entry, count):
    flat = np.sort(np.concatenate([np.array(c, np.int64) for c in chunks]))
    cuts = np.cumsum([len(c) for c in chunks])[:-1]
    parts = [p for p in np.split(flat, cuts) if len(p)]
    whole = P.chunk_map(parts[0], gap)
    for p in parts[1:]:
        whole = P.compose(whole, P.chunk_map(p, gap), gap)
    allowed = min(entry, int(flat[0]) + gap)  # what a chunk before may leave
    chain = P.Chain(gap)
    chain.start(allowed, count)
    out = np.zeros(len(flat), bool), np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    chain.run(flat, *out)
    n, upto, exits, counts = whole
    i = int(np.searchsorted(upto, allowed, side="left"))
    assert n == len(flat)
    assert (exits[i] + gap, counts[i]) == (chain.allowed, chain.count) if i < len(upto) else (allowed, count + n) == (chain.allowed, chain.count)


@settings(max_examples=200, deadline=None)
@given(times, times, st.integers(1, 30))
def test_maps_stay_small(a, b, gap):
    """At most one step per distinct time up to a gap after the first row, and never more than rows."""
    def bound(t):
        span = t[t <= t[0] + gap]
        return min(len(t), len(np.unique(span)) + 1)

    a, b = np.array(a, np.int64), np.array(b, np.int64) + max(a)
    assert len(P.chunk_map(a, gap)[1]) <= bound(a)
    joined = P.compose(P.chunk_map(a, gap), P.chunk_map(b, gap), gap)
    assert len(joined[1]) <= len(P.chunk_map(a, gap)[1]) + len(P.chunk_map(b, gap)[1])


def test_quota_over_partitions(spark):
    rows = [("all", i // 10, i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, s long, arrival long").withColumn("ts", F.timestamp_seconds("s"))
    got = B.fixed_window_quota(df, ["key"], "ts", 5, 4, ["arrival"]).collect()
    want = brute(rows, 4)
    assert {r["arrival"]: (r["hit"], r["allowed"]) for r in got} == {a: (h, h <= 5) for a, (_, h) in want.items()}
