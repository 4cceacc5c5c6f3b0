"""Tamper-evident audit trail: hash chains per key, verification and statistics."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from beaconry.operators import ordered

GENESIS = "GENESIS"
_BODY = ["ts", "user", "role", "action", "resource"]


def _digest(entry: dict, prev: str) -> str:
    """First 16 hex digits of SHA-256 over the sorted JSON of the entry (with prev_hash) and the previous hash."""
    text = json.dumps({**entry, "prev_hash": prev}, sort_keys=True) + prev
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def chain_build(df: DataFrame, chain: list[str], order: list[str]) -> DataFrame:
    """Add ``prev_hash`` and ``hash``; one chain per value of ``chain``, entries in ``order``.

    A hash needs the one before it, so the length of a chain bounds parallelism. Use chains that stay short, such
    as day and service, and add a shard column (``chain_shard``) where one service writes most entries. Rows
    stream through in batches, so a chain never has to fit in memory.
    """
    spec = Window.partitionBy(*chain).orderBy(*order)
    rows = df.withColumn("_first", F.row_number().over(spec) == 1)
    fields = [StructField("prev_hash", StringType()), StructField("hash", StringType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = GENESIS
        for pdf in batches:
            prevs, hashes = [], []
            for first, *values, details in zip(pdf["_first"], *(pdf[c] for c in _BODY), pdf["details"]):
                prev = GENESIS if first else prev
                prevs.append(prev)
                prev = _digest({**dict(zip(_BODY, values)), "details": dict(details or {})}, prev)
                hashes.append(prev)
            yield pdf.assign(prev_hash=prevs, hash=hashes)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *fields])).drop("_first")


def chain_shard(entry_id: str, shards: int) -> Column:
    """Shard number for chains of one hot key."""
    return F.pmod(F.xxhash64(entry_id), F.lit(shards)).cast("int")


def entry_json(df: DataFrame) -> Column:
    """The entry as one JSON line, the form stored in the append-only file."""
    return F.to_json(F.struct(*_BODY, "details", "prev_hash", "hash"))


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("prev", "stored", "expected")]))
def _read_entry(lines: pd.Series) -> pd.DataFrame:
    """Stored link and hash of JSON lines, and the hash their content should have; null when unreadable."""
    out = []
    for line in lines:
        try:
            entry = json.loads(line)
            stored, prev = entry.pop("hash"), entry.pop("prev_hash")
            out.append((prev, stored, _digest(entry, prev)))
        except (ValueError, KeyError, TypeError, AttributeError):
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["prev", "stored", "expected"])


def chain_verify(lines: DataFrame, chain: list[str], **split) -> DataFrame:
    """Per chain: ``valid`` and the first broken line. Input: chain columns, ``line`` number and JSON ``value``.

    Every line stores its predecessor's hash, so lines verify in parallel; only the neighbour link needs order.
    Blank lines are skipped.
    """
    rows = lines.where(F.length(F.trim("value")) > 0)
    rows = rows.select(*chain, "line", _read_entry("value").alias("e")).select(*chain, "line", "e.*")
    rows = ordered.with_lags(rows, chain, ["line"], {"_before": "stored", "_line_before": "line"}, **split)
    link = F.when(F.col("_line_before").isNull(), F.lit(GENESIS)).otherwise(F.col("_before"))
    good = (F.col("prev") == link) & (F.col("stored") == F.col("expected"))
    broken = F.when(~F.coalesce(good, F.lit(False)), F.col("line"))
    return rows.groupBy(*chain).agg(F.min(broken).alias("first_broken_line")).withColumn(
        "valid", F.col("first_broken_line").isNull())


def audit_stats(lines: DataFrame) -> DataFrame:
    """Entries and stored bytes (each line ends with a newline)."""
    return lines.agg(F.count(F.lit(1)).alias("total_entries"),
                     F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("file_size_bytes"))
