"""Physical plans: pruned scans, partial aggregation, top-k, group limits and no needless Python or shuffles."""

import re

from pyspark.sql import functions as F

from beaconry.operators import dedup as D, fleet as Q, rollups as R, rowwindow as G
from beaconry.sources import adapters as A, store as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_reads_needed_columns_and_combines_early(spark, sf):
    p = plan(R.rollup_1m(A.metrics(spark, sf)))
    assert p.count("HashAggregate") == 2 and p.count("Exchange") == 1 and "BatchEvalPython" not in p
    assert "partial_sum" in p and "event_id" not in re.search(r"ReadSchema: (.*)", p).group(1)


def test_time_filter_reaches_scan_and_partitions(spark, sf, tmp_path):
    path = str(tmp_path / "m")
    S.write_metrics(A.metrics(spark, sf, "native"), path)
    stored = S.read_metrics(spark, path).where(F.col("date") == "2024-01-03")
    p = plan(Q.fleet_by_node(stored, "2024-01-03 01:00:00", "2024-01-03 02:00:00"))
    assert "PartitionFilters: [isnotnull(date" in p and "GreaterThanOrEqual(time" in p
    assert "metadata" not in re.search(r"ReadSchema: (.*)", p).group(1)


def test_small_dimension_is_broadcast_by_size_not_hint(spark, sf):
    df = Q.regional_breakdown(A.metrics(spark, sf), A.nodes(spark, sf), "2024-01-01", "2024-01-02")
    assert "BroadcastHashJoin" in plan(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(Q.regional_breakdown(
            A.metrics(spark, sf), A.nodes(spark, sf), "2024-01-01", "2024-01-02"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_samples_are_reduced_before_the_dimension_join(spark, sf):
    p = plan(R.rollup_5m_region(A.metrics(spark, sf), A.nodes(spark, sf)))
    join = p.index("BroadcastHashJoin")
    assert "partial_sum" in p[join:]


def test_top_k_and_pages_do_not_sort_everything(spark, sf):
    m, n = A.metrics(spark, sf), A.nodes(spark, sf)
    assert "TakeOrderedAndProject" in plan(Q.top_problem_nodes(m, n, "2024-01-01", "2024-01-02"))
    assert "TakeOrderedAndProject" in plan(Q.list_metrics(m, n, limit=10))
    assert "TakeOrderedAndProject" in plan(G.latest_n(m))


def test_first_rows_are_cut_before_the_shuffle(spark, sf):
    for df in (D.latest_per_node(A.metrics(spark, sf)), D.dedup_metrics(A.metrics(spark, sf))):
        p = plan(df)
        assert p.count("WindowGroupLimit") == 2 and p.count("Exchange") == 1


def test_rolling_window_shuffles_once_without_python(spark, sf):
    p = plan(G.rolling_anomaly(A.metrics(spark, sf)))
    assert p.count("Exchange") == 1 and "Python" not in p and "Arrow" not in p


def test_chained_windows_share_one_shuffle(spark, sf):
    m = A.metrics(spark, sf).select("node_id", "time", "arrival", (F.col("latency_ms") > 100).cast("int").alias("level"))
    assert plan(G.debounce(m, ["node_id"], "time", "level")).count("Exchange") == 1
