"""Scores and alerts of micro-batches with state carried from one to the next.

State is a small table per purpose: the last samples of a node, the last alert of a kind that went through, a node's open window, and the
fleet's bucket. A micro-batch reads what earlier ones left, runs the batch operators over that and its own rows, and writes the state of the
keys it touched into the folder of its number; every ``FULL`` batches all live keys are written, so a read takes at most that many folders, and keys
whose time is up leave then. A replayed micro-batch reads the same state and replaces its own folder.

Results equal those of the batch operators over all rows if rows come in the order of their time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from beaconry.operators import admission, alerts as H, ordered, prefix
from beaconry.operators.dedup import first_per
from beaconry.operators.rowwindow import rolling_anomaly
from beaconry.session import reading_on

FULL = 16


class Carried:
    """Keyed state below ``root``, a folder per micro-batch."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str]):
        self.spark, self.root, self.schema, self.keys = spark, root, schema, keys
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        self.there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def before(self, epoch: int) -> DataFrame:
        """The state that batches before ``epoch`` left."""
        if not self.there or epoch == 0:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, epoch long").parquet(self.root)
        rows = rows.where(F.col("epoch").between((epoch - 1) // FULL * FULL, epoch - 1))
        return first_per(rows, self.keys, [F.desc("epoch")]).drop("epoch")

    def write(self, touched: DataFrame, epoch: int, live: Column | None = None) -> None:
        """State of the touched keys after ``epoch``; ``live`` tells which old ones are worth keeping."""
        out = touched
        if epoch % FULL == 0:
            rest = self.before(epoch).join(touched.select(*self.keys), self.keys, "left_anti")
            out = out.unionByName(rest if live is None else rest.where(live))
        out.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}")


def scores(rows: DataFrame, root: str, epoch: int, n: int = 20, min_samples: int = 5) -> DataFrame:
    """Rolling scores of the rows (time, node_id, latency_ms, packet_loss, arrival), going on from earlier micro-batches."""
    spark = rows.sparkSession
    kind = rows.schema["latency_ms"].dataType.simpleString()
    state = Carried(spark, f"{root}/samples", f"node_id string, last array<struct<arrival:long,latency_ms:{kind}>>", ["node_id"])
    slim = rows.select("time", "node_id", "latency_ms", "packet_loss", "arrival", F.lit(True).alias("_new"))
    past = state.before(epoch).join(slim.select("node_id").distinct(), "node_id", "left_semi").select("node_id", F.explode("last").alias("s")).select(
        "node_id", "s.latency_ms", "s.arrival", F.lit(False).alias("_new"))
    both = ordered.stored(slim.unionByName(past, allowMissingColumns=True), "scores")
    newest = _newest(both.where("latency_ms is not null"), n - 1)
    state.write(newest, epoch)
    return rolling_anomaly(both, n, min_samples).where("_new").drop("_new")


def _newest(rows: DataFrame, n: int) -> DataFrame:
    """The last n samples of each node; ranks are cut before the shuffle, so a list has n entries at most."""
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("arrival")))
    kept = rows.withColumn("_rank", place).where(F.col("_rank") <= n)
    return kept.groupBy("node_id").agg(F.collect_list(F.struct("arrival", "latency_ms")).alias("last"))


def dispositions(alerts: DataFrame, root: str, epoch: int) -> DataFrame:
    """Alerts of :func:`alerts.evaluate_rules` (or ``fired``) with ``disposition``, going on from earlier micro-batches."""
    spark, ts = alerts.sparkSession, alerts.schema["ts"].dataType.simpleString()
    kind = ["node_id", "metric_name", "severity"]
    cooled = Carried(spark, f"{root}/cooldowns", f"node_id string, metric_name string, severity string, ts {ts}", kind)
    quotas = Carried(spark, f"{root}/quotas", f"node_id string, start {ts}, hits long", ["node_id"])
    bucket = Carried(spark, f"{root}/bucket", "scope string, tokens double, last_s double", ["scope"])
    alerts = ordered.stored(alerts, "alerts")
    newest = alerts.agg(F.max("ts")).first()[0]

    def age(column: str, seconds: int) -> Column:
        return F.coalesce(F.col(column) > F.lit(newest).cast(ts) - F.make_dt_interval(secs=F.lit(seconds)), F.lit(True))  # no alerts: all stay

    # what went through before takes part as a row of its own, ahead of rows of the same time
    mark = F.lit(-1).cast("long").alias("arrival"), F.lit(0).alias("rule_no"), F.lit(False).alias("_new")
    past = cooled.before(epoch).select(*kind, "ts", *mark)
    rows = alerts.withColumn("_new", F.lit(True)).unionByName(past, allowMissingColumns=True)
    marked = ordered.stored(prefix.windows(rows, kind, "ts", H.COOLDOWN_S, ["arrival", "rule_no"]).drop("anchor", "hit"), "cooled")
    cooled.write(marked.where("kept").groupBy(*kind).agg(F.max("ts").alias("ts")), epoch, age("ts", H.COOLDOWN_S))
    dropped = marked.where("_new and not kept").drop("kept", "_new").withColumn("disposition", F.lit("dedup"))

    before = quotas.before(epoch)
    past = before.select("node_id", F.col("start").alias("ts"), *mark)
    fresh = marked.where("_new and kept").drop("kept").unionByName(past, allowMissingColumns=True)
    counted = prefix.windows(fresh, ["node_id"], "ts", H.NODE_WINDOW_S, ["arrival", "rule_no"]).drop("kept")
    counted = counted.join(before, "node_id", "left")
    counted = counted.withColumn("hit", F.col("hit") + F.when(F.col("anchor") == F.col("start"), F.col("hits") - 1).otherwise(0))
    counted = ordered.stored(counted.drop("start", "hits"), "counted")
    last = counted.groupBy("node_id").agg(F.max(F.struct("anchor", "hit")).alias("w")).select("node_id", F.col("w.anchor").alias("start"), F.col("w.hit").alias("hits"))
    quotas.write(last, epoch, age("start", H.NODE_WINDOW_S))
    counted = counted.where("_new").drop("_new", "anchor")
    over = counted.where(F.col("hit") > H.NODE_LIMIT).drop("hit").withColumn("disposition", F.lit("node_quota"))

    asking = ordered.stored(counted.where(F.col("hit") <= H.NODE_LIMIT).drop("hit"), "asking")
    level = bucket.before(epoch).first()
    initial = None if level is None else (level["tokens"], level["last_s"])
    done = H.global_bucket(asking, initial=initial, hot_rows=None)
    done = ordered.stored(done.withColumn("disposition", F.when(F.col("allowed"), "sent").otherwise("global_limit")).drop("allowed"), "sent")
    bucket.write(_level(spark, done, initial), epoch)
    return dropped.unionByName(over.select(*dropped.columns)).unionByName(done.select(*dropped.columns))


def _level(spark: SparkSession, done: DataFrame, initial: tuple[float, float] | None) -> DataFrame:
    """The bucket after a micro-batch: the grants of each second, followed in order (a row per second with a grant, up to the burst)."""
    rate, burst = H.GLOBAL_PER_HOUR / 3600.0, float(H.GLOBAL_BURST)
    # after a full refill nothing earlier matters; grants are at most the refill and one burst
    tokens, last = initial or (burst, None)
    with reading_on(spark):
        grants = done.where("disposition = 'sent'").groupBy(F.date_trunc("second", "ts").alias("at")).agg(F.count("*").alias("n"))
        for r in grants.select(F.unix_seconds(F.col("at").cast("timestamp")).alias("s"), "n").orderBy("s").toLocalIterator():
            at = float(r["s"])
            tokens = min(burst, tokens + max(0.0, at - (at if last is None else last)) * rate) - r["n"]
            last = at
    rows = [] if last is None else [("all", tokens, last)]
    return spark.createDataFrame(rows, "scope string, tokens double, last_s double")
