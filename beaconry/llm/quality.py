"""Quality classifier: random-indexing word vectors pooled per document and a two-layer network.

Every token has a word bucket and a shape bucket (upper, lower, digits and marks, runs shortened). A bucket starts with
a sparse random index vector; its word vector adds the index vectors of the buckets around it in the labelled texts.
A document is the mean of its word vectors, the mean of its shape vectors, its length and its share of distinct
tokens. A numpy network with one hidden layer scores it, and a temperature fitted on a held-back part of the rows
calibrates the probability.

Sizes: every labelled row trains. Up to ``chunk_docs`` rows train on the driver; more are cut into chunks of that size,
which tasks train from the same weights for some epochs, and the averaged weights go on to the next round, so the driver gets
a few sums per task. The vector table has a fixed number of buckets, so what is broadcast does not grow. Scoring reads every
whole text and moves no rows.

Defined results: null and empty texts are scored as texts without tokens; null ids are never held out and never
labelled; without any labelled row every score is 0.5; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconry.llm.common import append_column, id_crc, spare_name, stored


@dataclass(frozen=True)
class Params:
    chunk_docs: int = 12_000
    word_buckets: int = 1 << 15
    shape_buckets: int = 1 << 12
    dim: int = 48
    nonzero: int = 6
    window: int = 2
    hidden: int = 32
    epochs: int = 40
    round_epochs: int = 4
    seed: int = 7


_RUN = re.compile(r"(.)\1+")
CACHE_TOKENS = 200_000


def _char_class(ch: str) -> str:
    if ch.isdigit():
        return "0"
    if ch.isalpha():
        return "X" if ch.isupper() else "x"
    return ch


class Buckets(dict):
    """Token -> word bucket and shape bucket packed into one number; forgets everything when full."""

    def __init__(self, p: Params):
        super().__init__()
        self.p = p

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        head = token[:64]
        shape = _RUN.sub(r"\1\1", "".join(map(_char_class, head)))[:12]
        word = zlib.crc32(token.lower().encode("utf-8", "replace")) % self.p.word_buckets
        value = word | (self.p.word_buckets + zlib.crc32(shape.encode("utf-8", "replace")) % self.p.shape_buckets) << 32
        self[token] = value
        return value

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        tokens = (text or "").split()
        packed = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return packed & 0xFFFFFFFF, packed >> 32, len(set(tokens))


def index_vectors(p: Params) -> np.ndarray:
    """Sparse ternary index vector of every bucket, a function of the seed alone."""
    rng = np.random.default_rng(p.seed)
    n = p.word_buckets + p.shape_buckets
    out = np.zeros((n, p.dim), np.float32)
    at = rng.random((n, p.dim)).argsort(axis=1)[:, : p.nonzero]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (n, p.nonzero)), axis=1)
    return out


def _context_sums(index: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    around = np.zeros((len(ids), index.shape[1]), np.float32)
    for d in range(1, window + 1):
        if len(ids) > d:
            around[:-d] += index[ids[d:]]
            around[d:] += index[ids[:-d]]
    order = np.argsort(ids, kind="stable")
    buckets, first = np.unique(ids[order], return_index=True)
    return buckets, np.add.reduceat(around[order], first, axis=0)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, allowed, limit: int | None = None) -> DataFrame:
    """Labelled documents (doc_id, label, text), one row per id; with ``limit`` only so many ids, those with the smallest hash.

    The documents are scanned once, by all tasks, and the rows are written; an id that repeats gives its smallest text.
    """
    chosen = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label")))
    if limit is not None:  # rows of two numbers, broadcast
        chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = texts.join(chosen, "doc_id")
    return stored(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")


def _pool(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    total = np.zeros(vectors.shape[1], np.float64)
    for i in range(0, len(ids), 1 << 16):
        total += vectors[ids[i : i + (1 << 16)]].sum(axis=0)
    return total / max(1, len(ids))


def features(vectors: np.ndarray, buckets: Buckets, text: str | None) -> np.ndarray:
    words, shapes, distinct = buckets.ids(text)
    n = len(words)
    return np.concatenate([_pool(vectors, words), _pool(vectors, shapes), [np.log1p(n), distinct / max(1, n)]])


@dataclass(frozen=True)
class Model:
    params: Params
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -40, 40)))


def _initial(width: int, p: Params, rng: np.random.Generator) -> list[np.ndarray]:
    return [rng.normal(0, (2 / width) ** 0.5, (width, p.hidden)), np.zeros(p.hidden), rng.normal(0, (1 / p.hidden) ** 0.5, p.hidden), np.zeros(1)]


def _constant(p: Params, vectors: np.ndarray, mean: np.ndarray, scale: np.ndarray, label: float | None) -> Model:
    """The model of rows that are all alike, or of none."""
    w = _initial(len(mean), p, np.random.default_rng(p.seed))
    prior = 0.0 if label is None else (4.0 if label else -4.0)
    return Model(p, vectors, mean, scale, w[0] * 0, w[1], w[2] * 0, prior, 1.0)


def _epoch(w: list, m: list, v: list, step: float, xs: np.ndarray, y: np.ndarray, fit: np.ndarray) -> tuple[list, float]:
    """One pass of Adam on the logistic loss over the rows ``fit``; the moments change in place."""
    w = list(w)
    for i in range(0, len(fit), 128):
        rows = fit[i : i + 128]
        a, t = xs[rows], y[rows]
        hid = np.maximum(a @ w[0] + w[1], 0)
        err = (1 / (1 + np.exp(-np.clip(hid @ w[2] + w[3], -40, 40))) - t) / len(rows)
        back_hid = np.outer(err, w[2]) * (hid > 0)
        grads = [a.T @ back_hid + 1e-4 * w[0], back_hid.sum(0), hid.T @ err + 1e-4 * w[2], np.array([err.sum()])]
        step += 1
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w, step


def _logits(w: list, xs: np.ndarray) -> np.ndarray:
    return np.maximum(xs @ w[0] + w[1], 0) @ w[2] + w[3]


def _loss(z: np.ndarray, y: np.ndarray, t: float = 1.0) -> np.ndarray:
    s = np.clip(z / t, -40, 40)
    return np.logaddexp(0, s) - y * s


TEMPERATURES = np.geomspace(1, 8, 60)  # few rows must not sharpen the scores


def train_network(x: np.ndarray, y: np.ndarray, p: Params, vectors: np.ndarray) -> Model:
    """Adam on the logistic loss; a fifth of the rows is kept back to choose the epoch and the temperature."""
    rng = np.random.default_rng(p.seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * p.dim + 2), np.ones(2 * p.dim + 2))
    if not len(x) or y.min() == y.max():
        return _constant(p, vectors, mean, scale, y[0] if len(x) else None)
    w = _initial(x.shape[1], p, rng)
    order = rng.permutation(len(x))
    back, fit = order[: len(x) // 5], order[len(x) // 5 :]
    xs = (x - mean) / scale
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step, kept, lowest = 0, w, np.inf
    for _ in range(p.epochs):
        rng.shuffle(fit)
        w, step = _epoch(w, m, v, step, xs, y, fit)
        if len(back):  # the weights of the epoch that does best on the rows kept back
            now = float(np.mean(_loss(_logits(w, xs[back]), y[back])))
            if now < lowest:
                kept, lowest = [a.copy() for a in w], now
    w = kept if len(back) else w
    z = _logits(w, xs[back])
    best = min(TEMPERATURES, key=lambda t: float(np.mean(_loss(z, y[back], t)))) if len(back) else 1.0
    return Model(p, vectors, mean, scale, w[0], w[1], w[2], float(w[3][0]), float(best))


def _summed(chunks: DataFrame, of_chunk: Callable[[int, np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all chunks of a vector that ``of_chunk`` makes from (number, x, y); a row per task reaches the driver."""

    def run(frames):
        total = None
        for pdf in frames:
            for number, x, y in zip(pdf["chunk"], pdf["x"], pdf["y"]):
                part = of_chunk(int(number), np.frombuffer(x).reshape(-1, width), np.frombuffer(y))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"total": [total.tobytes()]})

    return sum(np.frombuffer(r["total"]) for r in chunks.mapInPandas(run, "total binary").collect())


def train_chunks(rows: DataFrame, n: int, p: Params, vectors: np.ndarray) -> Model:
    """The network of ``train_network`` from more rows (doc_id, label, x): chunks train side by side, their weights are averaged.

    Each round starts all chunks from the same weights and runs ``round_epochs`` epochs; each chunk keeps a fifth of its rows back,
    and the weights that do best on all of these stay.
    """
    width, count = 2 * p.dim + 2, -(-n // p.chunk_docs)

    def packed(pdf):
        pdf = pdf.sort_values("doc_id", kind="stable")
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "x": [b"".join(pdf["x"])], "y": [pdf["label"].to_numpy(float).tobytes()]})

    chunks = stored(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(count)))
                    .groupBy("chunk").applyInPandas(packed, "chunk long, x binary, y binary"), "chunks")
    total = _summed(chunks, lambda _, x, y: np.concatenate([[y.sum()], x.sum(0)]), width)
    mean = total[1:] / n
    scale = np.sqrt(_summed(chunks, lambda _, x, y: ((x - mean) ** 2).sum(0), width) / n) + 1e-6
    if total[0] in (0, n):
        return _constant(p, vectors, mean, scale, total[0])
    first = _initial(width, p, np.random.default_rng(p.seed))
    shapes = [a.shape for a in first]
    ends = np.cumsum([a.size for a in first])

    def split(flat):
        return [a.reshape(s).copy() for a, s in zip(np.split(flat, ends[:-1]), shapes)]

    size, grid = int(ends[-1]), len(TEMPERATURES)
    start = np.concatenate([np.concatenate([a.ravel() for a in first]), np.zeros(2 * size + 1)])  # weights, moments, steps
    kept, lowest, best = first, np.inf, 1.0
    rounds = -(-p.epochs // p.round_epochs)
    for number in range(rounds + 1):  # the last one only judges

        def trained(chunk, x, y, start=start, number=number):
            order = np.random.default_rng((p.seed, chunk)).permutation(len(x))
            back, fit = order[: len(x) // 5], order[len(x) // 5 :]
            rng, xs = np.random.default_rng((p.seed, chunk, number)), (x - mean) / scale
            w, m, v = (split(start[i * size : (i + 1) * size]) for i in range(3))
            step, z = start[-1], _logits(w, xs[back])
            judged = [float(_loss(z, y[back], t).sum()) for t in TEMPERATURES]
            for _ in range(min(p.round_epochs, p.epochs - number * p.round_epochs)):
                rng.shuffle(fit)
                w, step = _epoch(w, m, v, step, xs, y, fit)
            now = np.concatenate([a.ravel() for a in (*w, *m, *v)] + [[step]])
            return np.concatenate([judged, [len(back)], now * len(fit), [len(fit)]])

        got = _summed(chunks, trained, width)
        loss = got[:grid] / max(1.0, got[grid])
        if number and loss[0] < lowest:
            kept, lowest, best = split(start[:size]), loss[0], float(TEMPERATURES[loss.argmin()])
        start = got[grid + 1 : -1] / got[-1]
    return Model(p, vectors, mean, scale, kept[0], kept[1], kept[2], float(kept[3][0]), best)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), allowed=None) -> Model:
    """Word vectors and network from all labelled rows that the condition ``allowed`` admits."""
    spark = docs.sparkSession
    index = index_vectors(p)
    shared = spark.sparkContext.broadcast(index)
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if allowed is None else allowed)

    def contexts(frames):
        total = np.zeros_like(shared.value)
        seen = np.zeros(len(total), bool)
        buckets = Buckets(p)
        for pdf in frames:
            for text in pdf["text"]:
                for ids in buckets.ids(text)[:2]:
                    for i in range(0, len(ids), 1 << 15):
                        at, sums = _context_sums(shared.value, ids[i : i + (1 << 15)], p.window)
                        total[at] += sums
                        seen[at] = True
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 4096):
            part = at[i : i + 4096]
            yield pd.DataFrame({"bucket": part, **{f"v{j}": total[part, j].astype(float) for j in range(p.dim)}})

    cols = [f"v{j}" for j in range(p.dim)]
    # A task gives up to a row per bucket, however many texts it reads: few tasks for few texts.
    sums = (
        sample.select("text").coalesce(8 * -(-max(1, n := sample.count()) // p.chunk_docs))
        .mapInPandas(contexts, "bucket long, " + ", ".join(f"{c} double" for c in cols))
        .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]).toPandas())
    vectors = index / np.linalg.norm(index, axis=1, keepdims=True)
    if len(sums):
        context = sums[cols].to_numpy(np.float32)
        context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
        vectors[sums["bucket"].to_numpy()] += context
    vectors = vectors.astype(np.float32)
    table = spark.sparkContext.broadcast(vectors)

    def pooled(frames):
        buckets = Buckets(p)
        for pdf in frames:
            x = [features(table.value, buckets, t).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": x})

    rows = sample.mapInPandas(pooled, "doc_id long, label int, x binary")
    if n > p.chunk_docs:
        return train_chunks(rows, n, p, vectors)
    rows = rows.toPandas().sort_values(["doc_id"], kind="stable")
    x = np.frombuffer(b"".join(rows["x"])).reshape(len(rows), 2 * p.dim + 2)
    return train_network(x, rows["label"].to_numpy(float), p, vectors)


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of the documents and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Buckets] = {}

    def run(texts):
        buckets = state.setdefault("b", Buckets(shared.value.params))
        if not texts:
            return pa.array([], pa.float64())
        x = np.stack([features(shared.value.vectors, buckets, t) for t in texts])
        return pa.array(shared.value.scores(x))

    return append_column(docs, name, "double", "text", run)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_back: int = 2,
             p: Params = Params()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Labels of rows with crc32(doc_id) mod 4 = ``held_back`` are not read."""
    model = fit(docs, labels, p, id_crc() % 4 != held_back)
    scored = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, "score")
    return scored.select(
        "doc_id", F.coalesce(id_crc() % 4 == held_back, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, p: Params = Params()) -> DataFrame:
    """The documents, with their columns, that the classifier does not reject."""
    model = fit(docs, labels, p, id_crc() % 4 != 2)
    name = spare_name(docs, "quality_score")
    return with_score(docs, model, name).where(F.col(name) >= threshold).drop(name)
