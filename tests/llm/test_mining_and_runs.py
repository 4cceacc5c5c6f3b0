"""Hard negatives, languages and periodic runs against brute force and held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from beaconry.llm import language, negatives, periods
from beaconry.llm.common import table
from tests.llm.conftest import as_dicts

SF = "/root/testdata/sf0.01"


def mined(rows, turned=7):
    """Brute force over (vec_id, vector, label)."""
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % turned == 0 else label
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        whole[i] = min(whole.get(i, (label, ints)), (label, ints))
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        scored = sorted((-score(v, w), i, other) for i, (other, w) in whole.items() if i != a)
        for p, i, _ in [r for r in scored if r[2] == label][:5]:
            fit = [r for r in scored if r[2] != label and 50 * -p <= 100 * -r[0] <= 95 * -p][:3]
            out |= {(a, i, k + 1, r[1], -p, -r[0]) for k, r in enumerate(fit)}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


EMB = "vec_id long, embedding array<float>, label int, block int, slot string"


def test_hard_negatives_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(40)]  # many equal vectors, so many ties
    rows += [(2000, None, 1), (2050, [None] * 6, 1), (2100, [float("nan")] * 6, 2), (2150, [float("inf")] * 6, 1), (None, rows[0][1], 1),
             (2200, rows[0][1], None), rows[3], (4, rows[9][1], 0), (2250, [0.0] * 6, 1), (2300, [0.5, 0.25], 1)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], EMB).repartition(3)
    found = rows_of(negatives.search(df))
    assert found == mined(rows)
    assert any(r[0] == 50 for r in found)
    ints = df.select("vec_id", "label", negatives.integers(df["embedding"], 256).alias("v"))
    turned = ints.selectExpr("vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) as label", "v")
    small = negatives.hard_negatives(turned, turned.where("vec_id % 50 = 0"), tile_rows=40, anchor_rows=3, cell_rows=4, train_rows=50)
    assert rows_of(small) == found  # sizes of tiles, blocks and codebooks change nothing


def test_hard_negatives_empty(spark):
    assert negatives.search(spark.createDataFrame([], EMB)).count() == 0
    assert negatives.search(spark.createDataFrame([(50, [1.0], 3, 1, "a")], EMB)).count() == 0


def test_heap_order_and_early_stop():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 400
    x = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8))).astype(np.int64)
    labels, ids = rng.integers(0, 3, 3000), rng.permutation(3000)
    y = x.astype(float)
    index = negatives.MultiIndex(ids, labels, x, (negatives.k_means(y[:, :4], 12), negatives.k_means(y[:, 4:], 12)))
    q = index.exact[7]
    halves = [h[0] for h in index.half_bounds(q[None].astype(float))]
    bounds = [b for b, _, _ in index.cells(*halves)]
    assert bounds == sorted(bounds, reverse=True)
    assert sum(e - s for _, s, e in index.cells(*halves)) == 3000
    scores = index.exact @ q
    for bound, s, e in index.cells(*halves):
        assert scores[s:e].max() <= bound
    index.visited = index.scored = 0
    index.positives(int(index.ids[7]), int(index.labels[7]), q, halves, 5)
    assert index.scored < 1500, "clustered vectors let an anchor stop before half of the rows"


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = language.classify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    right = [r["lang"] == r["lang_pred"] for r in held]
    assert np.mean(right) > 0.97
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es", "und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    # scores say how often the choice is right, and rejected rows hold more errors
    assert abs(np.mean([r["score"] for r in held]) - np.mean(right)) < 0.03
    sure = [ok for r, ok in zip(held, right) if not r["rejected"]]
    assert len(sure) > 0.9 * len(held) and np.mean(sure) > np.mean(right)


def test_language_odd_rows(spark, odd, empty):
    rows = language.classify(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [by[i][0]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and by[16][0]["lang_pred"] == "und"  # null, empty, blank, digits
    assert by[7][0]["lang_pred"] == "en" and by[7][0]["score"] == by[8][0]["score"]
    assert language.classify(empty).count() == 0
    none = odd.withColumn("lang", odd["lang"].substr(100, 1)).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language.classify(none).collect()} == {"und"}


def test_language_never_reads_held_out_rows(spark):
    texts = {"aa": "ba na mo ra ka", "bb": "xyl quor zent plim"}
    rows = [(i, " ".join(random.Random(i).choices(texts[k].split(), k=40)), k if zlib.crc32(str(i).encode()) % 3 != 1 else "wrong")
            for i, k in enumerate(["aa", "bb"] * 60)]
    got = language.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == ["aa", "bb"][r["doc_id"] % 2] for r in got)


def all_runs(w, least=24, repeats=3):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def repetitive(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        k = rng.choice([1, 2, 2, 3, 20])
        base = [rng.randint(1, k) for _ in range(rng.randint(1, 30))]
        out += (base * 12)[: rng.randint(1, 9 * len(base))] if rng.random() < 0.6 else base
    return out


def test_runs_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        assert periods.texts_runs([[b"%d" % x for x in t] for t in texts]) == [all_runs(t) for t in texts]
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert periods.texts_runs([[c.encode() for c in b]]) == [all_runs(b)]  # many runs of many periods


def test_transforms_are_exact():
    rng = np.random.default_rng(2)
    for size in (8, 32):
        x = rng.integers(1, 2**20, (5, 3 * size))
        plain = np.array([[int(((r[:size] - r[d : d + size]) ** 2).sum()) for d in range(2 * size)] for r in x])
        for p, g in periods.PRIMES:
            assert (periods.squared_differences(x[:, :size], x, p, g) == plain % p).all()


def expected_report(doc_id, text, tails):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if tails and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    drop = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return {"doc_id": doc_id, "n_runs": len(found), "start": best and best[0], "length": best and best[1] - best[0],
            "period": best and best[2], "exponent_milli": best and 1000 * (best[1] - best[0]) // best[2],
            "runs_sha256": sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()),
            "collapsed_sha256": sha(b" ".join(w for i, w in enumerate(words) if i not in drop))}


def key(r):
    return str(sorted((k, str(v)) for k, v in r.items()))


@pytest.mark.parametrize("tails", [False, True])
def test_runs_odd_rows(odd, empty, odd_texts, tails):
    got = as_dicts(periods.report(odd, tails=tails))
    want = [expected_report(r["doc_id"], r["text"], tails) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert periods.report(empty, tails=tails).count() == 0 and periods.periodic_runs(empty).count() == 0


def test_runs_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = as_dicts(periods.report(docs, tails=True))
    want = [expected_report(r["doc_id"], r["text"], True) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(r["n_runs"] for r in want) > 5
    listed = periods.periodic_runs(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in listed} == {
        r["doc_id"]: r["n_runs"] for r in as_dicts(periods.report(docs)) if r["n_runs"]}
