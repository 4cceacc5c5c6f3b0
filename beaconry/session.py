"""Session helpers: time zone and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Where scratch folders go while a block of :func:`passing` runs; whether shuffle files leave with the job that wrote them.
SCRATCH, SHUFFLES = "spark.beaconry.scratch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """All event times are UTC; every entry point calls this first."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors must reach.

    Only a local master may do without it and gets a temporary folder; on a cluster executors would each write to
    their own disk, so there it is an error.
    """
    root = spark.conf.get(SCRATCH, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        root = tempfile.mkdtemp(prefix="beaconry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[str]:
    """A block whose scratch folders and shuffle files do not outlast it; no frame that reads them may leave it.

    Scratch folders made inside lie below one folder, which goes at the end, also after an error.
    """
    folder, before = scratch_dir(spark, name), {k: spark.conf.get(k, None) for k in (SCRATCH, SHUFFLES)}
    spark.conf.set(SCRATCH, folder)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield folder
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def reading_on(spark: SparkSession) -> Iterator[None]:
    """Shuffle files stay, for a local iterator, which reads them after Spark takes its query for ended."""
    before = spark.conf.get(SHUFFLES, None)
    spark.conf.set(SHUFFLES, "false")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES) if before is None else spark.conf.set(SHUFFLES, before)
