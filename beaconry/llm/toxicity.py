"""Toxicity classifier with counterfactual regularisation.

Features are the words of a text and their beginnings (four to seven letters), hashed and counted once per text; those
that tell the labels apart best in the sample are kept. A logistic model is fitted to the labels with a penalty on the
change of the score when identity terms are swapped for others of the same list, so that a group's name alone moves
the score little. Sentences that name a group are swapped as they are. Besides, a share of the labelled texts of both classes is copied with a
term put in and, as its counterfactual, with the next term of that list: the copies keep their label, so what the terms of all lists
weigh is learned from texts of both labels, even where the sample names no group or names one in toxic texts alone. Identity terms are always
kept as features, else the penalty could not reach them.

Sizes: the sample has at most ``train_docs`` labelled rows (smallest hashes of the id), counted by Spark; the driver
gets the ``features`` best features and the sample's few kept features. Scoring reads every whole text, moves no rows.

Defined results: null and empty texts score as texts without words; null ids are never held out and never labelled;
without labelled rows every score is 0.5; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconry.llm.common import append_column, id_crc
from beaconry.llm.quality import labelled_sample

#: Terms that can stand for each other, one list per kind of group (fixed values).
IDENTITY = [
    ["women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab", "indigenous"],
    ["gay", "lesbian", "straight", "bisexual", "queer"],
    ["immigrants", "refugees", "natives", "foreigners"],
    ["elderly", "young", "disabled", "deaf", "blind"],
    ["frauen", "männer", "femmes", "hommes", "mujeres", "hombres"],
]
BITS = 22


@dataclass(frozen=True)
class Params:
    train_docs: int = 20_000
    features: int = 3_000
    least_docs: int = 4
    penalty: float = 20.0
    inserted: float = 0.5  # share of the labelled texts that are copied with an identity term put in
    ridge: float = 2e-4
    steps: int = 250


WORD = re.compile(r"[^\W\d_]+")


def feature_ids(word: str) -> list[int]:
    """The word and its beginnings, hashed."""
    parts = ["=" + word[:64], *{word[:n] for n in range(4, 8) if len(word) > n}]
    return [zlib.crc32(p.encode("utf-8", "replace")) & ((1 << BITS) - 1) for p in parts]


class Lookup(dict):
    """Word -> the ids of its kept features (all if ``kept`` is None)."""

    def __init__(self, kept: dict[int, int] | None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = feature_ids(word)
        found = tuple(ids) if self.kept is None else tuple(self.kept[i] for i in ids if i in self.kept)
        if len(self) >= 200_000:
            self.clear()
        self[word] = found
        return found

    def of(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        for w in words:
            out.update(self[w])
        return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def put_in(text: str | None, share: float) -> str | None:
    """The term to put into a copy of a text, by the text's hash; None for the texts that are not copied."""
    h = zlib.crc32((text or "").encode("utf-8", "replace"))
    terms = sorted(swaps())
    return terms[h // 1000 % len(terms)] if h % 1000 < 1000 * share else None


def swaps() -> dict[str, str]:
    """Each identity term and the next of its list."""
    return {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}


@dataclass(frozen=True)
class Model:
    kept: dict[int, int]
    weights: np.ndarray
    bias: float
    swapped: int = 0  # labelled texts that name a group
    inserted: int = 0  # copies with a term put in

    def score(self, lookup: Lookup, text: str | None) -> float:
        at = list(lookup.of(words_of(text)))
        z = self.bias + float(self.weights[at].sum())
        return 1 / (1 + float(np.exp(-min(40.0, max(-40.0, z)))))


def train(rows: list[list[int]], other: list[list[int]], y: np.ndarray, width: int, p: Params) -> tuple[np.ndarray, float]:
    """Adam on the logistic loss with the counterfactual penalty; ``other`` holds the features after the swap."""
    if not len(y):
        return np.zeros(width), 0.0

    def sparse(lists):
        sizes = [len(x) for x in lists]
        return np.repeat(np.arange(len(lists)), sizes), np.array([i for x in lists for i in x], np.int64)

    r, c = sparse(rows)
    changed = [i for i, (a, b) in enumerate(zip(rows, other)) if sorted(a) != sorted(b)]
    gone = sparse([sorted(set(rows[i]) - set(other[i])) for i in changed])
    new = sparse([sorted(set(other[i]) - set(rows[i])) for i in changed])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # rare labels count more
    for step in range(1, p.steps + 1):
        z = np.bincount(r, w[c], len(y)) + bias
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(c, err[r], width) + p.ridge * w
        if changed:
            gap = np.bincount(gone[0], w[gone[1]], len(changed)) - np.bincount(new[0], w[new[1]], len(changed))
            pull = 2 * p.penalty * gap / len(y)
            grad += np.bincount(gone[1], pull[gone[0]], width) - np.bincount(new[1], pull[new[0]], width)
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), allowed=None) -> Model:
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if allowed is None else allowed, p.train_docs)

    def counted(frames):
        every = np.zeros((2, 1 << BITS), np.int32)
        lookup = Lookup(None)
        total = [0, 0]
        for pdf in frames:
            for label, text in zip(pdf["label"], pdf["text"]):
                at = list(lookup.of(words_of(text)))
                every[int(label > 0), at] += 1
                total[int(label > 0)] += 1
        at = np.flatnonzero(every.any(axis=0))
        yield pd.DataFrame({"feature": [-1], "neg": [total[0]], "pos": [total[1]]})
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pd.DataFrame({"feature": part, "neg": every[0, part], "pos": every[1, part]})

    counts = sample.select("label", "text").coalesce(16).mapInPandas(counted, "feature long, neg long, pos long").groupBy("feature").agg(
        F.sum("neg").cast("double").alias("neg"), F.sum("pos").cast("double").alias("pos"))
    total = counts.where("feature = -1").first()
    names = sorted({i for t in swaps() for i in feature_ids(t)})
    if total is None or not total["neg"] + total["pos"]:
        return Model({}, np.zeros(0), 0.0)
    rate_pos, rate_neg = (total["pos"] + 1.0), (total["neg"] + 1.0)
    share = (F.col("pos") + F.col("neg")) / (rate_pos + rate_neg)
    apart = (F.col("pos") / rate_pos - F.col("neg") / rate_neg) / F.sqrt(share * (1 - share) + 1e-6)
    best = (counts.where((F.col("feature") >= 0) & (F.col("pos") + F.col("neg") >= p.least_docs))
            .orderBy(F.desc(F.abs(apart)), "feature").limit(p.features).select("feature").collect())
    kept = {f: i for i, f in enumerate(sorted({r[0] for r in best} | set(names)))}
    swap = swaps()

    def described(frames):
        lookup = Lookup(kept)
        features = lambda words: sorted(lookup.of(words))
        for pdf in frames:
            words, terms = [words_of(t) for t in pdf["text"]], [put_in(t, p.inserted) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "label": pdf["label"], "x": [features(w) for w in words],
                "other": [features({swap.get(t, t) for t in w}) if w & swap.keys() else None for w in words],
                "copy": [None if t is None else features(w | {t}) for w, t in zip(words, terms)],
                "copy_other": [None if t is None else features((w | {swap[t]}) - {t}) for w, t in zip(words, terms)]})

    rows = sample.mapInPandas(described, "doc_id long, label int, x array<int>, other array<int>, copy array<int>, copy_other array<int>")
    rows = rows.toPandas().sort_values("doc_id", kind="stable")
    y = (rows["label"].to_numpy(float) > 0).astype(float)
    x = [list(v) for v in rows["x"]]
    other = [a if b is None else list(b) for a, b in zip(x, rows["other"])]
    copied = np.flatnonzero(rows["copy"].notna().to_numpy())
    x += [list(v) for v in rows["copy"].iloc[copied]]
    other += [list(v) for v in rows["copy_other"].iloc[copied]]
    w, bias = train(x, other, np.append(y, y[copied]), len(kept), p)
    return Model(kept, w, bias, int(rows["other"].notna().sum()), len(copied))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, held_back: int = 0, p: Params = Params()) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Labels of rows with crc32(doc_id) mod 5 = ``held_back`` are not read."""
    model = fit(docs, labels, p, id_crc() % 5 != held_back)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Lookup] = {}

    def run(texts):
        lookup = state.setdefault("l", Lookup(shared.value.kept))
        return pa.array([shared.value.score(lookup, t) for t in texts], pa.float64())

    scored = append_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), "score", "double", "text", run)
    return scored.select(
        "doc_id", F.coalesce(id_crc() % 5 == held_back, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
