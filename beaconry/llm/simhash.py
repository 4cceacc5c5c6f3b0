"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has a bit for every bit position that is set in over half of the shingle hashes. Two fingerprints link
if they differ in at most ``max_bits`` bits. Only distinct fingerprints are compared: copies share one.

The trie is dealt out by one exact block: of ``max_bits + 1`` blocks at least one agrees between linked fingerprints,
so each fingerprint goes, rotated, below ``max_bits + 1`` trie nodes (block number, block value). Below such a node
pairs of trie nodes are traversed together, level by level; each pair carries its differing bits, and it is dropped as
soon as they exceed the budget. Small pairs end in a comparison of their leaves. A task returns a spanning forest of
the links it found, not the links. A node with far more fingerprints than the mean is dealt out as pairs of salts.
Components are then joined by alternating large-star and small-star steps, each written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; rows with null ids take part and
get the smallest id of their component (null if it has none); repeated rows get the same row; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from beaconry.llm.common import NULL_ID, row_key, slices, spare_name, stored

SEED = 42
#: A trie node is dealt out by salts if it holds more fingerprints than this and than four times the mean.
HOT_FINGERPRINTS = 1_500
LEAF_PAIRS = 256
STEP_PAIRS = 1 << 20


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned SimHash of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = len(tokens) - k + 1
    starts, stops = first[:n].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])],
                     np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, text hash and fingerprint (as a signed long) of every row."""

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs)[1].alias("text_hash"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Labels of positions 0..n-1 under unions of whole arrays of links; the label is the smallest position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def trie_links(group: np.ndarray, value: np.ndarray, first_bit: int, max_bits: int) -> np.ndarray:
    """Smallest linked position for each row; rows are sorted by (group, value) and link within their group only.

    ``value`` is unsigned with the group's own bits on top, so a trie node is a range of rows. ``first_bit`` is the
    first bit, from the top, in which rows of one group can differ.
    """
    n = len(value)
    forest = Forest(n)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(depth: int) -> np.ndarray:
        if depth not in zeros:
            bit = (value >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)])
        return zeros[depth]

    def compare(a0, a1, b0, b1) -> None:
        width = (a1 - a0) * (b1 - b0)
        stops = np.cumsum(width)
        at = 0
        while at < len(width):
            till = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + STEP_PAIRS)))
            w = width[at:till]
            pair = np.repeat(np.arange(at, till), w)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(w) - w, w)
            cols = (b1 - b0)[pair]
            i, j = a0[pair] + k // cols, b0[pair] + k % cols
            near = (i < j) & (_popcount(value[i] ^ value[j]) <= max_bits)
            if near.any():
                forest.link(i[near], j[near])
            at = till

    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    stack = [(first_bit, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        if len(a0) > STEP_PAIRS:
            half = len(a0) // 2
            stack += [(depth, a0[s], a1[s], b0[s], b1[s], bits[s]) for s in (slice(half), slice(half, None))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth >= 64)
        joined = forest.label[a0] == forest.label[b0]
        one = joined & (a1 - a0 == 1) & (b1 - b0 == 1)  # already in one component
        leaf = small & ~one
        if leaf.any():
            compare(a0[leaf], a1[leaf], b0[leaf], b1[leaf])
        go = ~small
        if not go.any():
            continue
        a0, a1, b0, b1, bits = a0[go], a1[go], b0[go], b1[go], bits[go]
        z = zeros_before(depth)
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = (a0 == b0) & (a1 == b1)
        ways = [(a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1),
                (am[~same], a1[~same], b0[~same], bm[~same], bits[~same] + 1)]
        parts = [np.concatenate(x) for x in zip(*ways)]
        ok = (parts[4] <= max_bits) & (parts[1] > parts[0]) & (parts[3] > parts[2])
        ok &= ~((parts[0] == parts[2]) & (parts[1] == parts[3]) & (parts[1] - parts[0] == 1))
        stack.append((depth + 1, *[x[ok] for x in parts]))
    return forest.label


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of max_bits + 1 blocks."""
    n = max_bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _rotated(fp: Column, left: int) -> Column:
    return fp if left == 0 else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, 64 - left))


def links(distinct: DataFrame, max_bits: int = 4, hot: int = HOT_FINGERPRINTS) -> DataFrame:
    """A spanning forest (a, b), a > b, of all pairs of distinct fingerprints ``fp`` within ``max_bits`` bits."""
    blocks = _blocks(max_bits)
    rows = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), _rotated(F.col("fp"), first).alias("turned"),
                 F.shiftrightunsigned(_rotated(F.col("fp"), first), 64 - width).alias("node"))
        for i, (first, width) in enumerate(blocks)])).alias("x")).select("fp", "x.*")
    # At most (max_bits + 1) * 2 ** (widest block) nodes exist, whatever the input: 40,960 for 4 bits.
    counts = rows.groupBy("block", "node").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    crowded = (counts.join(F.broadcast(mean)).where(F.col("n") > F.greatest(F.lit(float(hot)), 4 * F.col("mean")))
               .select("block", "node", F.ceil(2 * F.col("n") / F.greatest(F.lit(float(hot)), 4 * F.col("mean")))
                       .cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    dealt = rows.join(F.broadcast(crowded), ["block", "node"], "left").select(
        "block", "node", "turned",
        F.explode(F.when(F.col("salts").isNull(), F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("t")))).otherwise(
            F.transform(F.filter(F.sequence(F.lit(0), F.col("salts") - 1), lambda o: o != salt),
                        lambda o: F.struct(F.least(o, salt).alias("s"), F.greatest(o, salt).alias("t"))))).alias("pair"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        block, node, s, p = (t.column(c).to_numpy() for c in ("block", "node", "s", "t"))
        turned = t.column("turned").to_numpy().view(np.uint64)
        for i, (first, width) in enumerate(blocks):
            mine = np.flatnonzero(block == i)
            if not len(mine):
                continue
            order = mine[np.lexsort((turned[mine], p[mine], s[mine], node[mine]))]
            v = turned[order]
            keys = np.stack([node[order], s[order], p[order]])
            group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
            label = trie_links(group, v, width, max_bits)
            moved = np.flatnonzero(label != np.arange(len(v)))
            if first:
                v = (v >> np.uint64(first)) | (v << np.uint64(64 - first))
            fp = v.view(np.int64)
            a, b = fp[moved], fp[label[moved]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return (dealt.select("block", "node", "turned", "pair.s", "pair.t").repartition("block", "node", "s", "t")
            .mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of the component."""
    spark = edges.sparkSession
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    mark = None
    while True:  # each round shrinks what is left; the links stand still once every component is a star
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if found == mark or not found["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = found
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(
            low.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """Per row: doc_id, text_hash, fp, component_id (smallest doc_id reachable over links of ``max_bits`` bits)."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), max_bits))
    # Fingerprints without link are their own component.
    at_root = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    # Written, so that both sides of the join are plain shuffles, whose hot partitions adaptive execution splits.
    lows = stored(at_root.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = at_root.join(lows, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp")


def keep_one(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each component, with its columns: the one with the smallest id.

    A component whose ids are all null keeps the row with the smallest text hash. If the kept id and text repeat, a null text goes
    before an empty one, then the row with the smallest hash of all columns stays.
    """
    found = near_duplicates(docs, words, max_bits)
    best = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id")
            .agg(F.min("text_hash").alias("digest")).select(F.col("component_id").isNull(), F.coalesce("component_id", F.lit(NULL_ID)), "digest"))
    key, digest = row_key(docs)
    cols = docs.columns
    e, k, h, n = (spare_name(docs, c) for c in ("keep_null_", "keep_id_", "keep_hash_", "keep_row_"))
    rows = docs.withColumns({e: F.col("doc_id").isNull(), k: key, h: digest})
    kept = rows.join(stored(best.toDF(e, k, h), "kept"), [e, k, h], "left_semi")
    hashed = [F.to_json(c) if isinstance(docs.schema[c].dataType, (MapType, VariantType)) else F.col(c) for c in cols]
    place = F.struct(F.col("text").isNotNull(), F.xxhash64(*hashed))
    one = kept.groupBy(e, k, h).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), place).alias(n))
    return one.select(*[F.col(n)[c].alias(c) for c in cols])
