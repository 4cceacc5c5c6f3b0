"""Exact top-k inner products by aggregation of sorted lists without random access.

Candidates are dealt into tiles of about ``tile_rows`` rows and queries into blocks of at most ``query_rows``; a task
holds one tile and one block, a query block visits each tile once. A tile keeps a list per component: its (value, row) entries sorted once.
A query reads its lists from their best end (the large one for a positive weight), heavy components deeper than light ones. What
is read goes to a table of seen candidates: the sum of what is known, and which components are known. A seen candidate lies between
that sum plus its unknown components at the worst end of their lists and the sum plus them at the last entries read; all unseen ones share one upper
bound, the sum of the last entries. A query stops reading once nobody outside the k best lower bounds can still qualify but a few; the
scores of those are then resolved. If even the last look leaves many, the lists are read to their ends, which is the plain score of
whoever is still in. Tiles give their k best, a group-limited window merges them.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows with null ids, take no part;
shorter vectors count as zero beyond their end; equal ids of a query give one result (its smallest vector); rows with
the query's id are not its candidates; ties go to smaller ids; fewer than k candidates give them all. Components are
64-bit integers, and scores must fit too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconry.llm.common import stored

TILE_ROWS, QUERY_ROWS = 16_384, 65_536
#: Shares of a list that the looks read at the heaviest component, and the candidates that are resolved at once.
LOOKS, FEW = (1 / 64, 1 / 16, 1 / 4), 64


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) per component, x as double; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


class Tile:
    """Candidates with a sorted list of (value, row) per component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.rows = np.argsort(x, axis=0, kind="stable").T.copy()  # ascending, a list per component
        self.values = np.take_along_axis(x.T, self.rows, axis=1).astype(np.float64)
        self.read = 0  # entries read by all queries so far

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to smaller ids."""
        n, d = self.x.shape
        weight = q.astype(np.float64)
        used = np.flatnonzero(weight)[np.argsort(-np.abs(weight[np.flatnonzero(weight)]), kind="stable")]
        worst = np.where(weight > 0, weight * self.values[:, 0], weight * self.values[:, -1])[used] if n else np.zeros(len(used))
        slack = 1e-9 * (1 + float(np.abs(weight) @ np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1])))) if n else 0.0
        known, seen, at = np.zeros(n), np.zeros((len(used), n), bool), np.zeros(len(used), np.int64)
        left = np.flatnonzero(self.ids != query_id)
        for share in LOOKS if n > 4 * FEW and len(used) else ():
            depth = np.clip(np.ceil(n * share * np.abs(weight[used]) / abs(weight[used[0]])).astype(np.int64), 1, n)
            last = np.empty(len(used))
            for i, j in enumerate(used):
                lo, hi = at[i], max(at[i], depth[i])
                entries = slice(lo, hi) if weight[j] < 0 else slice(n - hi, n - lo)
                rows = self.rows[j, entries]
                known[rows] += weight[j] * self.values[j, entries]
                seen[i, rows] = True
                last[i] = weight[j] * self.values[j, hi - 1 if weight[j] < 0 else n - hi]
                at[i], self.read = hi, self.read + hi - lo
            sure = seen[:, left]
            table = sure.any(axis=0)
            # Unknown components: at best the last entry read, at worst the far end of the list.
            low = known[left] + worst.sum() - worst @ sure
            high = np.where(table, known[left] + last.sum() - last @ sure, last.sum())
            line = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            left = left[high + slack >= line - slack]
            if len(left) <= max(FEW, 4 * k):
                break
        else:
            self.read += int((n - at).sum())
        scores = self.x[left] @ q
        best = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left][best], scores[best]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the list column, short ones filled with zeros."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for frames (vec_id, v) of integer vectors."""
    vectors = stored(vectors.where("vec_id is not null and v is not null").select("vec_id", "v"), "vectors")
    queries = stored(queries.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    tiles = max(1, math.ceil(vectors.count() / tile_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = vectors.select(deal(tiles).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), deal(blocks).alias("block"), "vec_id", "v")

    def run(key, candidates: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not candidates.num_rows or not asked.num_rows:
            return schema.empty_table()
        rows, wanted = (pa.concat_arrays(t.column("v").chunks) for t in (candidates, asked))
        width = max(pc.max(c.value_lengths()).as_py() for c in (rows, wanted))
        tile = Tile(candidates.column("vec_id").to_numpy(), _matrix(rows, width))
        parts = []
        for query_id, q in zip(asked.column("vec_id").to_pylist(), _matrix(wanted, width)):
            ids, scores = tile.top(query_id, q, k)
            parts.append((np.full(len(ids), query_id), ids, scores))
        return pa.table([np.concatenate(x) for x in zip(*parts)], schema=schema)

    found = (left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block"))
             .applyInArrow(run, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``; candidates are all other rows."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
