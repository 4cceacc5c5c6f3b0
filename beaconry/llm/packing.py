"""Packing by power-of-two decomposition.

A document of n tokens (its end id included) is cut into full pieces of ``size`` tokens and, for the rest, one piece
per binary digit, longest first. Every piece is a sequence of its own whose length is a power of two, so no sequence
crosses documents and none is padded. Sequences are numbered bucket by bucket (longest first); a bucket holds equal
lengths, so batches of it are rectangular.

Numbers come from counts per task and bucket: a task counts its own pieces while it tokenizes, the counts (a row per
task and bucket) are summed up, and each piece adds its local number. Texts are tokenized once and never shuffled.

Defined results: null and empty texts are the end id alone; null ids and repeated rows keep their own pieces; other
columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from beaconry.llm.common import slices, stored
from beaconry.llm.suffixes import text_groups
from beaconry.llm.tokens import GROUP, encoder

SIZE = 1024


def lengths(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of n tokens, all powers of two."""
    full, rest = divmod(n, size)
    return [size] * full + [1 << b for b in range(size.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, start, length, ids (binary, little-endian uint32), ids_crc32, doc_tokens, task, local."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "task", "local"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        encode = encoder(tokenizer).encode_many
        task = TaskContext.get().partitionId()
        counts: dict[int, int] = {}
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in text_groups(texts, GROUP):
                flat, sizes = encode(texts[i:j])
                flat, rows, first = flat.astype("<u4", copy=False).tobytes(), [], 0
                for doc_id, n in zip(ids[i:j], sizes.tolist()):
                    whole, at = flat[4 * first : 4 * (first + n)] + end, 0
                    first += n
                    for width in lengths(n + 1, size):
                        part = whole[4 * at : 4 * (at + width)]
                        local = counts.get(width, 0)
                        counts[width] = local + 1
                        rows.append((doc_id, at, width, part, zlib.crc32(part), n + 1, task, local))
                        at += width
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
                                "task int, local long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id (from 0, without gaps), offset."""
    cut = stored(pieces(docs, tokenizer, end_id, size), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task and bucket
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most log2(size) + 1 rows per task that wrote pieces, however many pieces: small enough to broadcast.
    return cut.join(F.broadcast(bases), ["length", "task"]).select(
        "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
