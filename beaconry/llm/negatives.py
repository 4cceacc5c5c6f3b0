"""Hard-negative mining with an inverted multi-index.

Vectors are cut into two halves; each half has a codebook (k-means on at most ``TRAIN_ROWS`` vectors), and a pair of codewords
is a cell. Rows are dealt into tiles; a task holds one tile, indexed by cell, and the anchors stream past it. For an anchor a
codeword's half-score is at most ``q.c + |q| * radius``, the radius being that of the tile's own rows; a heap visits the cells in
descending order of the summed bounds of both halves (multi-sequence order). A visit scores a cell's rows exactly, and an anchor
stops once the next bound lies below everything that could still change its result: the last positive found, or, for each
window of negatives, its lower limit or its last negative found. So results are exact, whatever the codebooks are.

Two passes over the tiles: positives first, since the windows of negatives depend on the positives of all tiles.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; rows that repeat
an id count once (smallest label, then vector); shorter vectors count as zero beyond their end; ties go to smaller ids; fewer
rows than asked for give them all; windows of negative positive scores are empty; other columns are ignored; an empty table gives no
rows. Scores must be below 2^63.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from beaconry.llm.common import stored
from beaconry.llm.topk import integers

#: Rows of a tile and anchors that pass one task at most; rows of a cell on average; vectors that train the codebooks.
TILE_ROWS, ANCHOR_ROWS, CELL_ROWS, TRAIN_ROWS = 250_000, 250_000, 256, 20_000


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codewords of the rows of x: distinct rows to begin with, then Lloyd's steps."""
    x = np.unique(x, axis=0)
    k = max(1, min(k, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1]))
    words = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, words)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    norms, out = (words * words).sum(1), np.empty(len(x), np.int64)
    for i in range(0, len(x), 1 << 16):
        out[i : i + (1 << 16)] = (norms - 2 * (x[i : i + (1 << 16)] @ words.T)).argmin(1)
    return out


class MultiIndex:
    """Rows of a tile in the order of their cells, with the bounds of both halves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.at, self.books = books[0].shape[1], books
        y = x.astype(np.float64)
        codes, self.radii = [], []
        for part, words in zip((y[:, : self.at], y[:, self.at :]), books):
            own = nearest(part, words)
            far = np.zeros(len(words))
            np.maximum.at(far, own, np.sqrt(((part - words[own]) ** 2).sum(1)))
            codes.append(own)
            self.radii.append(far)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, cell = ids[order], labels[order], cell[order]
        # Products below 2^53 are exact in doubles; larger ones take whole numbers.
        top = float(np.abs(y).max(initial=0))
        self.exact, self.top = x[order], top
        self.x = y[order]
        self.bounds = np.searchsorted(cell, np.arange(len(books[0]) * len(books[1]) + 1))
        self.visited = self.scored = 0

    def half_bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """Greatest half-scores per query and codeword."""
        out = []
        for part, words, far in zip((q[:, : self.at], q[:, self.at :]), self.books, self.radii):
            b = part @ words.T + np.sqrt((part * part).sum(1))[:, None] * far
            out.append(b + 1e-9 * (1 + np.abs(b)))
        return out

    def cells(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, start, end) of the cells with rows, by descending bound: the multi-sequence order of one query."""
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        fa, fb, width = first[a].tolist(), second[b].tolist(), len(second)
        a, b = a.tolist(), b.tolist()
        heap, bounds = [(-(fa[0] + fb[0]), 0, 0)], self.bounds
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (-(fa[i] + fb[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):  # a row of the grid opens when its left neighbour row's first cell is taken
                heapq.heappush(heap, (-(fa[i + 1] + fb[0]), i + 1, 0))
            cell = a[i] * width + b[j]
            if bounds[cell] < bounds[cell + 1]:
                yield -bound, bounds[cell], bounds[cell + 1]

    def scores(self, start: int, end: int, q: np.ndarray, doubles: np.ndarray, safe: bool) -> np.ndarray:
        self.visited += 1
        self.scored += end - start
        return (self.x[start:end] @ doubles).astype(np.int64) if safe else self.exact[start:end] @ q

    def safe(self, q: np.ndarray) -> bool:
        return self.top * float(np.abs(q.astype(np.float64)).sum()) < 2.0**52

    def positives(self, anchor: int, label: int, q: np.ndarray, halves, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the n best rows of the anchor's label, ties to smaller ids."""
        doubles, safe = q.astype(np.float64), self.safe(q)
        ids, found, last = np.zeros(0, np.int64), np.zeros(0, np.int64), -math.inf
        for bound, s, e in self.cells(*halves):
            if bound < last:
                break
            got = self.scores(s, e, q, doubles, safe)
            take = (self.labels[s:e] == label) & (got >= last) & (self.ids[s:e] != anchor)
            if take.any():
                ids, found = best(np.append(ids, self.ids[s:e][take]), np.append(found, got[take]), n)
                last = found[-1] if len(found) == n else -math.inf
        return ids, found

    def negatives(self, label: int, q: np.ndarray, halves, positives: list[int], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the n best rows of other labels in the window of each positive score."""
        doubles, safe = q.astype(np.float64), self.safe(q)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(positives)
        low = [-(-p // 2) for p in positives]
        high = [95 * p // 100 for p in positives]
        reading = [j for j in range(len(positives)) if low[j] <= high[j]]
        for bound, s, e in self.cells(*halves):
            reading = [j for j in reading if bound >= low[j]]
            if not reading:
                break
            got = self.scores(s, e, q, doubles, safe)
            at = np.flatnonzero((got >= min(low[j] for j in reading)) & (self.labels[s:e] != label))
            if not len(at):
                continue
            ids, got = self.ids[s:e][at], got[at]
            for j in reading:
                take = (got >= low[j]) & (got <= high[j])
                if take.any():
                    found[j] = best(np.append(found[j][0], ids[take]), np.append(found[j][1], got[take]), n)
                    if len(found[j][1]) == n:
                        low[j] = int(found[j][1][-1])
        return found


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:n]
    return ids[order], scores[order]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)[: int(n.sum())]
    return out


def over_tiles(rows: DataFrame, asked: DataFrame, tiles: int, blocks: int, books, work, schema: str) -> DataFrame:
    """``work(index, batch of asked rows)`` for every tile of rows and every asked row.

    Sorted by slot (a tile and a block of asked rows), candidates come first; they are the index that the asked rows, which may be
    many, stream past in Arrow batches.
    """
    width = sum(b.shape[1] for b in books)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(deal(tiles).alias("tile"), each(blocks).alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "v")
    right = asked.select(each(tiles).alias("tile"), deal(blocks).alias("block"), F.lit(1).alias("kind"), *asked.columns)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("slot", F.col("tile") * blocks + F.col("block"))
    both = both.select("slot", "kind", "vec_id", "label", "v", *[c for c in asked.columns if c not in ("vec_id", "label", "v")])
    both = both.repartition(tiles * blocks, "slot").sortWithinPartitions("slot", "kind")

    def run(batches):
        slot, parts, index = None, [], None
        for b in batches:
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                part, own = b.slice(s, e - s), int(key[s])
                if own // 2 != slot:
                    slot, parts, index = own // 2, [], None
                if own % 2 == 0:
                    parts.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), width)))
                elif parts or index:
                    if index is None:
                        index, parts = MultiIndex(*[np.concatenate(x) for x in zip(*parts)], books), []
                    yield work(index, part)

    return both.mapInArrow(run, schema)


def _halves(index: MultiIndex, part: pa.RecordBatch) -> tuple[np.ndarray, list]:
    q = _matrix(part.column(4), sum(b.shape[1] for b in index.books))
    return q, list(zip(*index.half_bounds(q.astype(np.float64))))


def codebooks(rows: DataFrame, n: int, tile_rows: int, cell_rows: int, train_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves, with as many words as give a tile's cells ``cell_rows`` rows on average."""
    share = int(min(1.0, 1.2 * train_rows / max(1, n)) * (2**31 - 1))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(2**31)) <= share).select("v").limit(train_rows).toArrow().column("v")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    x = _matrix(pa.concat_arrays(sample.chunks), width).astype(np.float64) if len(sample) else np.zeros((0, width))
    k = max(2, int(math.sqrt(min(n, tile_rows) / cell_rows)))
    return k_means(x[:, : width // 2], k), k_means(x[:, width // 2 :], k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, tile_rows: int = TILE_ROWS,
                   anchor_rows: int = ANCHOR_ROWS, cell_rows: int = CELL_ROWS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for frames (vec_id, label, v) of integer vectors.

    ``anchors`` holds the ids that are anchors. A negative scores from 50 to 95 hundredths of the positive.
    """
    spark = vectors.sparkSession
    whole = vectors.where("vec_id is not null and label is not null and v is not null")
    rows = stored(whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "vectors")
    asked = stored(rows.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi"), "anchors")
    n = rows.count()
    tiles = max(math.ceil(n / tile_rows), spark.sparkContext.defaultParallelism)
    blocks = max(1, math.ceil(asked.count() / anchor_rows))
    books = codebooks(rows, n, math.ceil(n / tiles), cell_rows, train_rows)

    def find_positives(index: MultiIndex, part: pa.RecordBatch) -> pa.RecordBatch:
        q, halves = _halves(index, part)
        out = [(a, *index.positives(a, label, q[i], halves[i], positives))
               for i, (a, label) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))]
        arrays = [np.repeat([o[0] for o in out], [len(o[1]) for o in out]), *[np.concatenate([o[i] for o in out]) for i in (1, 2)]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["anchor_id", "positive_id", "positive_score"])

    def find_negatives(index: MultiIndex, part: pa.RecordBatch) -> pa.RecordBatch:
        q, halves = _halves(index, part)
        out = []
        for i, (a, label, wanted) in enumerate(zip(*[part.column(c).to_pylist() for c in (2, 3, 5)])):
            levels = sorted({w["positive_score"] for w in wanted})
            found = dict(zip(levels, index.negatives(label, q[i], halves[i], levels, negatives)))
            for w in wanted:
                ids, scores = found[w["positive_score"]]
                out += [(a, w["positive_id"], w["positive_score"], x, y) for x, y in zip(ids.tolist(), scores.tolist())]
        cols = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    near = over_tiles(rows, asked, tiles, blocks, books, find_positives, "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("r", rank).where(F.col("r") <= positives).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("wanted"))  # at most ``positives`` a list
    wanting = stored(asked.join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "positives")
    far = over_tiles(rows, wanting, tiles, blocks, books, find_negatives,
                     "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def search(embeddings: DataFrame, every: int = 50, turned: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by ``every``; ids divisible by ``turned`` first get the next label."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("int")
    rows = embeddings.select(
        vec_id.alias("vec_id"), F.when(vec_id % turned == 0, (label + 1) % labels).otherwise(label).alias("label"),
        integers(F.col("embedding"), scale).alias("v"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % every == 0))
