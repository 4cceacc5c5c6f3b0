"""Repeated passages by sparse suffix arrays.

Words are blank-separated and lower-cased (A-Z). A suffix is kept only where the k-gram at its start is the minimiser of
a window of ``least - k + 1`` k-grams, so every passage of ``least`` words holds a kept suffix at the same place in all
its copies. Kept suffixes whose k-gram occurs once have no partner and go. For the rest the words after and before the
k-gram (``CONTEXT`` each) are the extension: suffixes with equal extensions repeat as they are and share one row; the
distinct ones are sorted by k-gram and following words, and once more by k-gram and preceding words. Neighbours in
either order are compared and their match is extended to both sides; ``least`` words or more are a repeat. An exact check
of the windows around k-grams with three or more contexts adds partners hidden from both orders. The gap between kept suffixes is shorter than ``CONTEXT``, so matches of neighbouring suffixes cover a long passage together.

Both orders are global range sorts whose keys are distinct, so no k-gram, however frequent, has to fit one task.
Neighbours in different partitions are compared from the first and last row of each partition.

What a step wrote is deleted once the next one is written.

Defined results: null and empty texts have no passages; null ids are reported as null; a passage that repeats inside one
document counts, and so do equal rows, each with its spans; ties do not arise, for spans are sets of words; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from beaconry.llm.common import NULL_ID, discard, row_key, slices, stored

LEAST, K, CONTEXT = 50, 20, 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word (as bytes); forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _MIX + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(29)
        out *= _MIX
    return out ^ (out >> np.uint64(32))


def anchors(h: np.ndarray, n: np.ndarray, least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the kept suffixes: the leftmost minimum of each window.

    ``h`` holds the words of several texts one after another, ``n`` the number of words of each; windows stay in a text.
    """
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, w = _rolled(h, k), least - k + 1
    inside = np.arange(len(h)) + least <= np.repeat(np.cumsum(n), n)
    found = []
    for i in range(0, len(grams) - w + 1, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[i : i + (1 << 16) + w - 1], w)
        starts = np.flatnonzero(inside[i : i + len(view)])
        found.append(i + starts + view[starts].argmin(axis=1))
    at = np.unique(np.concatenate(found))
    return at, grams[at]


def _span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words of each span: differences of running sums of words times powers of an odd number."""
    up, down = np.full(len(h) + 1, _MIX), np.full(len(h) + 1, np.uint64(pow(int(_MIX), -1, 1 << 64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
        return (sums[end] - sums[start]) * down[start]


def _mixed(total: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = (total ^ (total >> np.uint64(31))) * _MIX + (left * 64 + right).astype(np.uint64)
        total = (total ^ (total >> np.uint64(29))) * _MIX
    return total ^ (total >> np.uint64(32))


def text_groups(texts: list[str | None], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of about ``size`` characters, or one longer text."""
    start = used = 0
    for i, t in enumerate(texts):
        if used and used + len(t or "") > size:
            yield start, i
            start, used = i, 0
        used += len(t or "")
    yield start, len(texts)


def kept_suffixes(docs: DataFrame, least: int = LEAST, k: int = K, context: int = CONTEXT) -> DataFrame:
    """Per kept suffix: k1, k2 (row key), pos, left, right (words at hand on each side), gram, ctx."""

    def run(batches):
        hashes = WordHashes()
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            for first, last in text_groups(texts):
                parts = [hashes.of(t) for t in texts[first:last]]
                n = np.array([len(x) for x in parts], np.int64)
                h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                at, gram = anchors(h, n, least, k)
                if not len(at):
                    continue
                ends = np.cumsum(n)
                row = np.searchsorted(ends, at, side="right")
                pos = at - (ends - n)[row]
                left, right = np.minimum(pos, context), np.minimum(n[row] - k - pos, context)
                ctx = _mixed(_span_hashes(h, at - left, at + k + right), left, right)
                take = pa.array(first + row)
                own = [b.column(i).take(take) for i in range(2)]
                small = [pa.array(x.astype(np.int32)) for x in (pos, left, right)]
                big = [pa.array(x.view(np.int64)) for x in (gram, ctx)]
                yield pa.RecordBatch.from_arrays([*own, *small, *big],
                                                 names=["k1", "k2", "pos", "l", "r", "gram", "ctx"])

    k1, k2 = row_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "k1 long, k2 long, pos int, l int, r int, gram long, ctx long")


def extensions(docs: DataFrame, wanted: DataFrame, k: int = K, context: int = CONTEXT) -> DataFrame:
    """(gram, ctx, after, before) for one suffix (k1, k2, pos) of each (gram, ctx): its words on both sides as bytes.

    Four bytes a word; ``before`` starts next to the k-gram.
    """
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "ctx", "pos")).alias("suffixes"))
    k1, k2 = row_key(docs)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    rows = texts.join(lists, ["k1", "k2"]).select("text", "suffixes")

    def run(batches):
        hashes = WordHashes()
        for b in slices(batches, 200):
            out = []
            for text, suffixes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (hashes.of(text) & np.uint64(0xFFFFFFFF)).astype(">u4")
                for s in suffixes:
                    p = s["pos"]
                    out.append((s["gram"], s["ctx"], words[p + k : p + k + context].tobytes(),
                                words[max(0, p - context) : p][::-1].tobytes()))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["gram", "ctx", "after", "before"])

    # Equal rows of documents give the same suffix twice.
    return rows.mapInArrow(run, "gram long, ctx long, after binary, before binary").dropDuplicates(["gram", "ctx"])


def _common(a: bytes, b: bytes) -> int:
    """Words that two contexts share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    diff = np.frombuffer(a[:n], np.uint32) != np.frombuffer(b[:n], np.uint32)
    return int(diff.argmax())


PAIRS = "gram long, ctx long, l int, r int, edge boolean, after binary, before binary"


def compare_neighbours(rows: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """Matches of adjacent rows of sorted partitions (gram, ctx, l, r); the ends of partitions as edge rows."""
    names = [x.split()[0] for x in PAIRS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for row in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if last is None:
                    out.append((row[0], row[1], 0, 0, True, *row[2:]))
                elif last[0] == row[0]:
                    r, left = _common(last[2], row[2]), _common(last[3], row[3])
                    if left + k + r >= least:
                        out.append((row[0], row[1], left, r, False, None, None))
                        out.append((row[0], last[1], left, r, False, None, None))
                last = row
            if out:
                yield batch(out)
        if last is not None:
            yield batch([(last[0], last[1], 0, 0, True, *last[2:])])

    return rows.select("gram", "ctx", "after", "before").mapInArrow(run, PAIRS)


def neighbour_matches(contexts: DataFrame, side: str, scratch: list[DataFrame], least: int = LEAST, k: int = K) -> DataFrame:
    """Matches of neighbours in the global order by (gram, ``side``); what is written goes to the list ``scratch``."""
    order = ["gram", side, "ctx"]
    found = stored(compare_neighbours(contexts.repartitionByRange(*order).sortWithinPartitions(*order), least, k), "neighbours")
    scratch.append(found)
    ends = found.where("edge").select("gram", "ctx", "after", "before").dropDuplicates(["gram", "ctx"])
    across = compare_neighbours(ends.repartition(1).sortWithinPartitions(*order), least, k)  # two rows per partition
    keep = ["gram", "ctx", "l", "r"]
    return found.where("not edge").select(*keep).union(across.where("not edge").select(*keep))


def hidden_matches(contexts: DataFrame, scratch: list[DataFrame], least: int = LEAST, k: int = K) -> DataFrame:
    """Exact check after the neighbours: windows of ``least`` words around a k-gram that several contexts share.

    A partner can hide from both orders behind others that match longer on one side only. That takes at least three
    contexts of a k-gram, so only those are looked at; counting windows is a sum, whatever their frequency.
    """
    need = least - k
    crowded = stored(contexts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 2").select("gram"), "crowded")
    digest = xxhash.xxh64_intdigest

    def run(batches):
        for b in slices(batches):
            win, row, left = [], [], []
            for i, (gram, after, before) in enumerate(zip(*[c.to_pylist() for c in b.columns[2:]])):
                for n in range(max(0, need - len(after) // 4), min(need, len(before) // 4) + 1):
                    win.append(digest(before[: 4 * n] + b"|" + after[: 4 * (need - n)], gram & 0xFFFFFFFFFFFFFFFF))
                    row.append(i)
                    left.append(n)
            take, l = pa.array(row, pa.int64()), np.array(left, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(win, np.uint64).view(np.int64)), *[b.column(i).take(take) for i in range(2)], pa.array(l),
                 pa.array((need - l).astype(np.int32))], names=["win", "gram", "ctx", "l", "r"])

    windows = contexts.join(crowded, "gram", "left_semi").select("gram", "ctx", F.col("gram").alias("g"), "after", "before")
    windows = windows.mapInArrow(run, "win long, gram long, ctx long, l int, r int")
    shared = stored(windows.groupBy("win").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    scratch += [crowded, shared]
    return windows.join(shared, "win").select("gram", "ctx", "l", "r")


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = K, context: int = CONTEXT) -> DataFrame:
    """Per passage: doc_id, k1, k2, start_word, end_word (exclusive)."""
    kept = stored(kept_suffixes(docs, least, k, context), "suffixes")
    grams = kept.groupBy("gram").agg(F.count("*").alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b"))
    # Written, so that both sides of the join are plain shuffles, whose hot partitions adaptive execution splits; so below.
    many = stored(grams.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("varied")), "grams")
    live = stored(kept.join(many, "gram"), "repeated-suffixes")
    discard(kept, many)
    groups = live.where("varied").groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one"))
    groups, scratch = stored(groups, "contexts"), []
    contexts = stored(extensions(docs, groups.select("gram", "ctx", "one.*"), k, context), "extensions")
    pairs = (neighbour_matches(contexts, "after", scratch, least, k).union(neighbour_matches(contexts, "before", scratch, least, k))
             .union(hidden_matches(contexts, scratch, least, k)))
    pairs = pairs.groupBy("gram", "ctx").agg(F.collect_set(F.struct("l", "r")).alias("m"))
    same = groups.where("n > 1").select("gram", "ctx", F.lit(True).alias("same"))
    marks = stored(pairs.join(same, ["gram", "ctx"], "full"), "marks")
    discard(groups, contexts, *scratch)
    whole = F.col("l") + k + F.col("r") >= least
    none = F.array().cast("array<struct<l:int,r:int>>")
    varied = live.where("varied").join(marks, ["gram", "ctx"]).select("k1", "k2", "pos", F.concat(
        F.coalesce("m", none), F.when(F.col("same") & whole, F.array(F.struct("l", "r"))).otherwise(none)).alias("m"))
    plain = live.where(~F.col("varied") & whole).select("k1", "k2", "pos", F.array(F.struct("l", "r")).alias("m"))
    spans = varied.unionByName(plain).select(
        "k1", "k2", F.transform("m", lambda x: F.struct(
            (F.col("pos") - x["l"]).alias("s"), (F.col("pos") + k + x["r"]).alias("e"))).alias("spans")).where(F.size("spans") > 0)
    # A document's spans are at most a few per kept suffix of it.
    docs_spans = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return merged_spans(docs_spans.select(F.nullif(F.col("k1"), F.lit(NULL_ID)).alias("doc_id"), "k1", "k2", "spans"))


def merged_spans(docs_spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of each row joined: one sort and one running maximum of the ends."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            # The row in the upper bits keeps the rows apart in one sort and one maximum.
            s, e = [(row << 32) + flat.field(i).to_numpy().astype(np.int64) for i in range(2)]
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(s)) - 1 if len(s) else first
            own = [b.column(i).take(pa.array(s[first] >> 32)) for i in range(3)]
            ends = [pa.array(x & 0xFFFFFFFF) for x in (s[first], e[last])]
            yield pa.RecordBatch.from_arrays([*own, *ends], names=["doc_id", "k1", "k2", "start_word", "end_word"])

    return docs_spans.mapInArrow(run, "doc_id long, k1 long, k2 long, start_word long, end_word long")


def report(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
