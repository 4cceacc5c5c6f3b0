"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least ``max(least, 3 q)`` long, that no neighbouring word extends. At
the dyadic scale B the words are cut into aligned blocks of B words. The sum of squared differences between a block and every place of the
window after it is a convolution; it is taken as an exact integer by number-theoretic transforms modulo primes whose product is beyond
the greatest possible sum, so a place matches exactly where it is zero. The distance of a match seeds a run, which is extended
word by word to both sides. Distances below 16 are looked for at B = 8, those from B to 2 B - 1 at larger B: a run of period q and that
length always holds an aligned block of its scale whose copy q words on is in the run too, so no run is missed.

Exact tests spare transforms and seeds: a block can only match inside its window if each of its words comes again within that distance;
a block whose whole window lies in a run of period B or less can only match at multiples of that period; and if block and match lie in two
runs of one period of at most B / 2, a run over both needs a distance that takes an end of the one to the same end of the other. The texts of a group (about
``GROUP`` characters, or one longer text) are worked on as one sequence with separators.

Sizes: a task holds one group; a text of n words takes memory in proportion to n and, per scale, time in proportion to n log n. The roots of
unity suffice for texts of 25 million words.

Defined results: null, empty and blank texts have no words and no runs; each row is judged by itself, so ties and repeated rows get equal
results and keep their rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconry.llm.common import id_crc, slices
from beaconry.llm.suffixes import text_groups

LEAST, REPEATS = 24, 3
#: Characters of a group, and elements of a batch of transforms.
GROUP, ELEMENTS = 1 << 20, 1 << 18
#: Primes with roots of unity of all orders up to 2^25, and a generator of each (fixed values).
PRIMES = ((2_013_265_921, 31), (469_762_049, 3), (167_772_161, 3))


@lru_cache(maxsize=128)
def _twiddles(p: int, g: int, n: int, inverse: bool) -> np.ndarray:
    root = pow(g, (p - 1) // n, p)
    root = pow(root, p - 2, p) if inverse else root
    out = np.ones(max(1, n // 2), np.uint64)
    done, step = 1, root
    while done < len(out):  # powers of the root by doubling
        out[done : 2 * done] = out[:done] * np.uint64(step) % np.uint64(p)
        done, step = 2 * done, step * step % p
    return out


def transform(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """Transform of every row; the result is in bit-reversed order."""
    rows, n, mod = len(x), x.shape[1], np.uint64(p)
    half = n // 2
    while half:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0], y[:, :, 1]
        x = np.stack([(a + b) % mod, (a + (mod - b)) % mod * _twiddles(p, g, 2 * half, False) % mod], axis=2).reshape(rows, n)
        half //= 2
    return x


def back(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """Inverse of ``transform``, from bit-reversed to natural order."""
    rows, n, mod, half = len(x), x.shape[1], np.uint64(p), 1
    while half < n:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0], y[:, :, 1] * _twiddles(p, g, 2 * half, True) % mod
        x = np.stack([(a + b) % mod, (a + (mod - b)) % mod], axis=2).reshape(rows, n)
        half *= 2
    return x * np.uint64(pow(n, p - 2, p)) % mod


def squared_differences(blocks: np.ndarray, windows: np.ndarray, p: int, g: int) -> np.ndarray:
    """Sums of squared differences, modulo p, of each block (B words) with places 0 to 2 B - 1 of its window (3 B words)."""
    size, mod = blocks.shape[1], np.uint64(p)
    x, y = np.zeros((len(blocks), 4 * size), np.uint64), np.zeros((len(blocks), 4 * size), np.uint64)
    x[:, :size], y[:, : 3 * size] = blocks[:, ::-1] % p, windows % p
    cross = back(transform(x, p, g) * transform(y, p, g) % mod, p, g)[:, size - 1 : 3 * size - 1]
    own = (x[:, :size] * x[:, :size] % mod).sum(axis=1) % mod
    sums = np.zeros((len(blocks), 3 * size + 1), np.uint64)
    np.cumsum(y[:, : 3 * size] * y[:, : 3 * size] % mod, axis=1, out=sums[:, 1:])
    other = (sums[:, size : 3 * size] - sums[:, : 2 * size]) % mod
    return (own[:, None] + other + (mod - cross) * np.uint64(2)) % mod


def matches(w: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) wherever the block at a start occurs again 1 to 2 * size - 1 words on. Words are below 2^31."""
    found = [], []
    greatest, primes = size * int(w.max(initial=0)) ** 2, 1
    while math.prod(p for p, _ in PRIMES[:primes]) <= greatest:
        primes += 1
    per = max(1, ELEMENTS // (4 * size))
    padded = np.concatenate([w, np.zeros(3 * size, w.dtype)])
    for i in range(0, len(starts), per):
        at = starts[i : i + per]
        windows = padded[at[:, None] + np.arange(3 * size)]
        zero = np.ones((len(at), 2 * size), bool)
        for p, g in PRIMES[:primes]:
            zero &= squared_differences(windows[:, :size], windows, p, g) == 0
        zero[:, 0] = False
        row, d = np.nonzero(zero)
        found[0].append(at[row])
        found[1].append(d)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _same(w: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal those d words after them. Separators differ from all."""
    n, width = 0, 32
    while True:
        if step > 0:
            a, b = at + n, min(at + n + width, len(w) - d)
        else:
            a, b = max(at - n - width + 1, 0), at - n + 1
        if a >= b:
            return n
        left = w[a:b]
        bad = np.flatnonzero((left != w[a + d : b + d]) | (left == 0))
        if len(bad):
            return n + int(bad[0] if step > 0 else b - a - 1 - bad[-1])
        n, width = n + b - a, min(4 * width, 1 << 16)


def runs(w: np.ndarray, least: int = LEAST, repeats: int = REPEATS, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of the sequence, by start, then period.

    Words are whole numbers from 1 on; 0 separates texts, of which the longest has ``longest`` words.
    """
    n, longest = len(w), len(w) if longest is None else longest
    if least < 24 or repeats < 3:
        raise ValueError("the scales find runs of at least 24 words and three periods")
    order = np.argsort(w, kind="stable")
    gap = np.full(n, n + 1, np.int64)  # words until the same word comes again
    again = w[order[:-1]] == w[order[1:]]
    gap[order[:-1][again]] = np.diff(order)[again]
    gap[w == 0] = n + 1
    found: dict[tuple[int, int], int] = {}
    # The run over each word that ends last.
    begin, reach, period = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
    size = 8
    while longest >= least and (size == 8 or size * repeats <= longest):
        starts = np.arange(n // size) * size
        keep = gap[: len(starts) * size].reshape(-1, size).max(axis=1) < 2 * size
        starts = starts[keep]
        starts = starts[(reach[starts] < starts + 3 * size) | (period[starts] > size)]
        at, d = matches(w, starts, size)
        if size > 8:
            at, d = at[d >= size], d[d >= size]
        covered = (reach[at] >= at + d + size) & (d % period[at] == 0)
        at, d = at[~covered], d[~covered]
        to = at + d
        paired = ((reach[at] >= at + size) & (reach[to] >= to + size) & (period[at] == period[to]) & (begin[at] != begin[to])
                  & (2 * period[at] <= size) & (period[at] <= d))
        idle = paired & (begin[to] - begin[at] != d) & (reach[to] - reach[at] != d)
        at, d = at[~idle], d[~idle]
        order, last = np.lexsort((at, d)), (0, -1)
        for i, q in zip(at[order].tolist(), d[order].tolist()):
            if last[0] == q and i + size + q <= last[1]:
                continue
            if reach[i] >= i + q + size and q % period[i] == 0:
                continue
            start, end = i - _same(w, i - 1, q, -1), i + size + _same(w, i + size, q, 1) + q
            last = (q, end)
            if end - start < max(least, repeats * q) or (start, end) in found:
                continue
            found[start, end] = q
            inside = slice(start, end)
            farther = reach[inside] < end
            begin[inside][farther] = start
            period[inside][farther] = q
            reach[inside][farther] = end
        size *= 2
    return sorted((s, e, q) for (s, e), q in found.items())


def repeated_tail(words: list, h: int) -> list:
    """The words of a text whose tail is made periodic if ``h``, the crc32 of its id, is divisible by ten."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def _summary(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of a text with runs (start, end, period)."""
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    best = None
    for s, e, q in found:
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    if found:
        kept = np.ones(len(words), bool)
        for s, e, q in found:
            kept[s + q : e] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    digest = hashlib.sha256(b" ".join(words)).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), digest)


def texts_runs(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts, given as words."""
    codes: dict[bytes, int] = {}
    n = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(n + 1) - n - 1
    w = np.zeros(int((n + 1).sum()), np.int64)
    for t, first in zip(texts, firsts.tolist()):
        w[first : first + len(t)] = np.fromiter((codes.setdefault(x, len(codes) + 1) for x in t), np.int64, len(t))
    out: list[list] = [[] for _ in texts]
    for s, e, q in runs(w, least, repeats, int(n.max(initial=0))):
        k = int(np.searchsorted(firsts, s, side="right")) - 1
        out[k].append((s - int(firsts[k]), e - int(firsts[k]), q))
    return out


def _rows(texts: Iterator, numbers, least: int, repeats: int):
    words = [repeated_tail((t or "").encode("utf-8", "replace").split(), h) if h is not None else (t or "").encode("utf-8", "replace").split()
             for t, h in zip(texts, numbers)]
    return words, texts_runs(words, least, repeats)


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Per run: doc_id, start, length, period (in words)."""

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for i, j in text_groups(texts, GROUP):
                _, found = _rows(texts[i:j], [None] * (j - i), least, repeats)
                owner = pa.array(np.repeat(np.arange(i, j), [len(f) for f in found]))
                flat = [r for f in found for r in f]
                cols = [[s for s, _, _ in flat], [e - s for s, e, _ in flat], [q for _, _, q in flat]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(owner), *[pa.array(c, pa.int64()) for c in cols]],
                                                 names=["doc_id", "start", "length", "period"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, period long")


SUMMARY = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def report(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, tails: bool = False) -> DataFrame:
    """Per row: doc_id, number of runs, the run with the greatest exponent, digests of all runs and of the text without repeats.

    ``tails`` first makes the tails of a tenth of the texts periodic (see ``repeated_tail``).
    """
    names = ["doc_id", *[f.split()[0] for f in SUMMARY.split(", ")]]
    types = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches):
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            numbers = b.column(2).to_pylist() if tails else [None] * len(texts)
            rows = []
            for i, j in text_groups(texts, GROUP):
                rows += map(_summary, *_rows(texts[i:j], numbers[i:j], least, repeats))
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), id_crc().alias("h"))
    return rows.mapInArrow(run, f"doc_id long, {SUMMARY}")
