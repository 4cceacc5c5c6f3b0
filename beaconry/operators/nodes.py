"""Node table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upsert_nodes(nodes: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The node table after a batch: known reporters get ``last_seen_at``, unseen ones a row from their first sample."""
    first = batch.groupBy("node_id").agg(
        F.min_by(F.struct("country", "region"), "arrival").alias("_first"), F.lit(True).alias("_reported"))
    joined = nodes.withColumn("_known", F.lit(True)).join(first, "node_id", "full")
    fresh = F.col("_known").isNull()
    stamp = now.cast(nodes.schema["last_seen_at"].dataType)
    values = {
        "node_name": F.concat(F.lit("probe-"), F.substring("node_id", 1, 8)),
        "status": F.lit("registered"),
        "country": F.coalesce(F.col("_first.country"), F.lit("XX")),
        "region": F.coalesce(F.col("_first.region"), F.lit("Unknown")),
    }
    seen = F.when(~fresh & F.col("_reported"), stamp).otherwise(F.col("last_seen_at"))
    return joined.select(*[
        F.when(fresh, values[c]).otherwise(F.col(c)).alias(c) if c in values
        else seen.alias(c) if c == "last_seen_at" else F.col(c) for c in nodes.columns])


def apply_node_changes(nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node table, rejected changes with ``reason``) after create and delete requests in ``seq`` order.

    A node exists from its first valid create on, and deleting keeps the row, so every verdict follows from
    comparing a request with that one point; no request has to be replayed in order.
    """
    create = (F.col("op") == "create") & (F.col("status") == "registered")
    known = nodes.select("node_id", F.lit(True).alias("_known"))
    birth = changes.where(create).groupBy("node_id").agg(
        F.min("seq").alias("_birth"), F.min_by(F.struct("country", "region", "lat", "lng"), "seq").alias("_new"))
    judged = changes.join(known, "node_id", "left").join(birth.select("node_id", "_birth"), "node_id", "left")
    there = F.col("_known").isNotNull() | F.coalesce(F.col("_birth") < F.col("seq"), F.lit(False))
    reason = (
        F.when((F.col("op") == "create") & (F.col("status") != "registered"), "bad_status")
        .when((F.col("op") == "create") & there, "already_exists")
        .when((F.col("op") == "delete") & ~there, "not_found"))
    judged = judged.withColumn("reason", reason)
    gone = judged.where((F.col("op") == "delete") & F.col("reason").isNull()).select("node_id").distinct().withColumn(
        "_gone", F.lit(True))
    added = birth.join(known, "node_id", "left_anti").select(
        "node_id", F.lit("registered").alias("status"), "_new.*")
    table = nodes.unionByName(added.select(*[
        F.col(c).cast(nodes.schema[c].dataType).alias(c) for c in added.columns]), allowMissingColumns=True)
    table = table.join(gone, "node_id", "left").withColumn(
        "status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).select(*nodes.columns)
    return table, judged.where(F.col("reason").isNotNull()).select(*changes.columns, "reason")
