"""Token ids as Parquet list columns.

Documents are range partitioned by id and sorted, so files and rows are in ascending order. Ids are a list column with
dictionary encoding; doc_id and the counters are delta encoded. Row groups and pages have set sizes and page indexes,
so a reader of few documents, or of metadata alone, skips the rest. Each row holds its number of tokens and the tokens
before it in its file; a reader adds the tokens of earlier files, one row per file.

Defined results: null and empty texts are the end id alone; null doc_ids sort first; repeated rows keep their own rows,
ordered by the text's hash; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from beaconry.llm.common import slices, text_or_empty
from beaconry.llm.suffixes import text_groups
from beaconry.llm.tokens import GROUP, encoder

SCHEMA = "doc_id long, n_tokens long, file_start long, part int, ids array<int>"


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of the file format, in ascending order of doc_id within and across partitions."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches):
        part = TaskContext.get().partitionId()
        make = encoder(tokenizer).encode_many
        before = 0
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for i, j in text_groups(texts, GROUP):
                flat, sizes = make(texts[i:j])
                ends = np.cumsum(sizes)
                flat = np.insert(flat.astype("<i4"), ends, end_id)  # the end id after each text
                n = sizes + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.array(before + offsets[:-1]), pa.array(np.full(len(n), part, np.int32)), ids],
                    names=["doc_id", "n_tokens", "file_start", "part", "ids"])
                before += int(offsets[-1])

    return rows.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group: int = 16 << 20, page: int = 64 << 10) -> None:
    """Token files at ``path``; ``row_group`` and ``page`` are target sizes in bytes."""
    (encode(docs, tokenizer, end_id).write.option("compression", "zstd")
     .option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.page.row.count.limit", 2_000)
     .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", "true").parquet(path))


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, with ``tokens``, ids. Bounds of doc_id reach the row groups and page indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    out = ["doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens"]
    return rows.join(F.broadcast(bases), "part").select(*out, *(["ids"] if tokens else []))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian uint32."""

    def run(batches):
        for b in slices(batches, 256):
            ids = b.column(3)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes()
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]) * 4
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
