"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconry.session import scratch_dir

#: Arrow batches of at most so many rows or bytes reach Python, so that long texts do not pile up in a worker.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared scratch folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stored`` wrote, once nothing reads them any more."""
    for df in frames:
        session, files = df.sparkSession, df.inputFiles()
        if files:
            path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


#: Stands for a null id in row keys; an id of this value counts as null there.
NULL_ID = -(2**63)


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """What tells documents apart even if ids are null or repeat: id and hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(text_or_empty())


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def append_column(df: DataFrame, name: str, kind: str, text: str, fn: Callable[[list], pa.Array]) -> DataFrame:
    """The frame with a column that ``fn`` makes from the texts of a batch, in one pass over the rows."""
    at = df.columns.index(text)
    names = [*df.columns, name]

    def run(batches):
        for b in slices(batches):
            arrays = [*b.columns, fn(b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{name}` {kind}")
