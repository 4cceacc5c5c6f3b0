"""Chunked execution of hot keys gives exactly the rows of the unchunked plan and of brute force."""

import random

import pytest
from pyspark.sql import Window, functions as F

from beaconry.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'hot' holds most rows; times repeat and have gaps."""
    rng = random.Random(7)
    rows, t = [], 0
    for i in range(900):
        t += rng.choice([0, 0, 1, 2, 3, 40])
        rows.append(("hot", t, i, rng.choice([None, i])))
    for k in range(5):
        rows += [(f"k{k}", rng.randrange(500), 1000 + 10 * k + j, j) for j in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, s long, arrival long, v long")
    return df.withColumn("ts", F.timestamp_seconds("s")).repartition(3), rows


SPLIT = {"hot_rows": 20, "chunk_rows": 15}


@pytest.mark.parametrize("k,reverse", [(1, False), (19, False), (1, True)])
def test_frame_equals_plain_window(skewed, k, reverse):
    df, _ = skewed
    order = ["ts", "arrival"]

    def make(w):
        w = w.rowsBetween(-k, 0)
        return {"x": F.sum("v").over(w), "n": F.count(F.lit(1)).over(w)}

    want = O.Keys(["key"], False).frame(df, order, k, make, reverse).select("arrival", "x", "n")
    got = O.per_key(df, ["key"], "ts", lambda part, g: g.frame(part, order, k, make, reverse), **SPLIT)
    assert sorted(map(tuple, got.select("arrival", "x", "n").collect())) == sorted(map(tuple, want.collect()))


def test_last_known_equals_plain_window(skewed):
    df, _ = skewed
    spec = Window.partitionBy("key").orderBy("ts", "arrival").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("arrival", F.last("v", ignorenulls=True).over(spec).alias("x"))
    got = O.per_key(df, ["key"], "ts", lambda part, g: g.last_known(part, ["ts", "arrival"], {"x": "v"}), **SPLIT)
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select("arrival", "x").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
