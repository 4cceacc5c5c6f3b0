"""Classifiers on held-out rows, exact top-k, archives, queries against their SQL, and the pipeline."""

import collections
import random
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from beaconry.llm import quality, topk, toxicity, warc
from beaconry.llm.queries import ORACLES, QUERIES
from beaconry.session import scratch_dir
from tests.llm.conftest import DOCS, as_dicts
from tools.check_oracle import TABLES, rows_of

LABELLED = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    ones = label == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("module,column,least", [(quality, "quality", 0.98), (toxicity, "toxic", 0.96)])
def test_held_out_accuracy(spark, module, column, least):
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(got["score"].to_numpy(), got[column].to_numpy()) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_odd_tables(odd, empty, labels, no_labels, module):
    rows = as_dicts(module.classify(odd, labels))
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in rows)
    assert [c for c, _ in module.classify(odd, labels).dtypes] == ["doc_id", "held_out", "score", "predicted"]
    assert module.classify(empty, labels).count() == 0
    assert {r["score"] for r in as_dicts(module.classify(odd, no_labels))} == {0.5}


def test_keep_good_keeps_columns(odd, no_labels):
    assert quality.keep_good(odd, no_labels, threshold=0.4).columns == odd.columns
    assert quality.keep_good(odd, no_labels, threshold=0.4).count() == odd.count()


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    p = quality.Params(epochs=2)
    a, b = (quality.classify(docs, t, p=p).orderBy("doc_id").toPandas() for t in (labels, turned))
    assert np.allclose(a["score"], b["score"])


def test_every_labelled_row_trains(spark):
    """More rows than a chunk train side by side; none is left out, and the model still tells the labels apart."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("bad", "worse") if i % 3 == 0 else ("good", "fine")) if rng.random() < 0.4 else rng.choice("abcdef")
                         for _ in range(20)), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    p = quality.Params(chunk_docs=100, epochs=12)
    model = quality.fit(docs, labels, p)
    x = np.stack([quality.features(model.vectors, quality.Buckets(p), r[1]) for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6)  # of all 600 rows, in six chunks
    assert auc(model.scores(x), np.array([r[2] for r in rows])) > 0.99 and 1 <= model.temperature <= 8
    one = quality.fit(docs, labels.withColumn("quality", F.lit(1)), p)
    assert set(one.scores(x).round(6)) == {round(1 / (1 + np.exp(-4)), 6)}


def test_counterfactual_penalty_pulls_identity_terms_together():
    rng = np.random.default_rng(0)
    # Feature 0 says the label; 1 and 2 are identity terms, and 1 goes with the label by accident of the sample.
    y = np.array([1, 1, 1, 0, 0, 0] * 20, float)
    rows = [[0, 1] if t and rng.random() < 0.9 else ([0, 2] if t else [2]) for t in y]
    other = [[{1: 2, 2: 1}.get(i, i) for i in r] for r in rows]
    gap = []
    for penalty in (0.0, 20.0):
        w, _ = toxicity.train(rows, other, y, 3, toxicity.Params(penalty=penalty))
        gap.append(abs(w[1] - w[2]))
        assert w[0] > 1
    assert gap[1] < 0.2 * gap[0]


def mentions(rng, n):
    """Texts whose label comes from one word; a group is named in most labelled texts and in few others."""
    rows = []
    for i in range(n):
        toxic = i % 2
        words = [rng.choice(["tree", "river", "stone", "cloud", "street", "window"]) for _ in range(12)]
        if rng.random() < (0.7 if toxic else 0.02):
            words.insert(3, "vilest")
        if rng.random() < (0.9 if toxic else 0.05):
            words.insert(6, "muslims")
        rows.append((i, " ".join(words), toxic))
    return rows


def test_counterfactuals_of_labelled_texts_shrink_the_gap(spark):
    rows = mentions(random.Random(3), 600)
    neutral = [(10_000 + i, f"tree river {t} stone cloud street", 0) for i, t in enumerate(["muslims", "christians", "women", "window"])]
    docs = spark.createDataFrame([r[:2] for r in rows + neutral], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    scores = {}
    for name, p in (("plain", toxicity.Params(penalty=0.0, inserted=0.0)), ("counterfactual", toxicity.Params())):
        got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels, p=p).collect()}
        scores[name] = [got[10_000 + i] for i in range(4)]
    gap = {name: s[0] - s[3] for name, s in scores.items()}
    assert gap["plain"] > 0.1 and gap["counterfactual"] < 0.5 * gap["plain"]
    assert max(scores["counterfactual"]) < 0.5
    model = toxicity.fit(docs, labels)
    named = sum("muslims" in t for _, t, _ in rows)
    assert model.swapped == named and 0.4 * len(rows) < model.inserted < 0.6 * len(rows)


def plain_top(vectors, k):
    ok = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in vectors
          if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        qv = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("tile,block", [(7, 2), (4096, 4096)])
def test_top_k(spark, tile, block):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(0, 0.2, 6).astype(np.float32).tolist()) for i in range(0, 420, 3)]
    rows += [(i, [0.5] * 6) for i in range(1000, 1030)] + [(100, None), (200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6),
             (500, [float("inf")] * 6), (None, [9.0] * 6), (700, []), (800, [0.0] * 6), (900, [0.1, 0.2]), (900, [0.3, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    vectors = df.select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, tile, block)
    exact = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain_top(exact, 10)
    assert topk.search(df.limit(0)).count() == 0


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(2)
    x = (1024 * rng.normal(0, 0.1, (3000, 4))).astype(np.int64)
    for q in (np.array([900, 5, -3, 2]), np.array([0, -700, 300, 0]), np.array([0, 0, 0, 0]), np.array([400, 400, -400, 400])):
        tile = topk.Tile(np.arange(3000), x)
        ids, scores = tile.top(-1, q, 10)
        every = x @ q
        order = np.lexsort((np.arange(3000), -every))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
        if q[0] == 900:  # one heavy component: its list need not be read far, the light ones hardly at all
            assert tile.read < 0.2 * np.count_nonzero(q) * len(x)


def test_read_lists_give_true_bounds():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, d = int(rng.integers(1, 700)), int(rng.integers(1, 9))
        x = rng.integers(-40, 40, (n, d)) * rng.integers(0, 2, d)  # ties and constant lists
        tile, q = topk.Tile(rng.permutation(n), x), rng.integers(-9, 9, d)
        ids, scores = tile.top(int(tile.ids[0]), q, 5)
        want = sorted((-int(s), int(i)) for s, i in zip(x @ q, tile.ids) if i != tile.ids[0])[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == want


def plain_archive(pages):
    payload = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, p in payload:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    return collections.Counter(
        (i, len(p), hashlib.sha256(p).hexdigest(), *(("revisit", first[p]) if i is not None and len(p) >= 100 and i > first[p] else ("response", None)))
        for i, p in payload)


def test_archive_round_trip(spark):
    body = "<html>WARC/1.0\r\nWARC-Type: response\r\n\r\n é中 " + "x" * 200 + "</html>"
    rows = [(1, "http://a/é b", body), (5, "http://b", body), (3, None, body), (4, "http://c", None), (6, "http://d", ""), (7, "u", "short"),
            (8, "u", "short"), (None, "n", body), (2, "http://e", "\r\n\r\n" * 30 + "HTTP/1.1 200"), (5, "http://b", body), (9, "z", "y" * 99),
            (10, "z", "y" * 99), (11, "z", "long " * 40_000)]
    pages = spark.createDataFrame([(*r, "digest", 5) for r in rows], "page_id long, url string, html string, payload string, refers_to long")
    path = scratch_dir(spark, "test-warc")
    warc.archive(pages.repartition(3), path)
    got = as_dicts(warc.read_warc(spark, path))
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == plain_archive(rows)
    assert all(r["payload"] is None or len(r["payload"]) == r["payload_bytes"] for r in got)
    path = scratch_dir(spark, "test-no-warc")
    warc.archive(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(spark, version):
    bodies = [b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nhello\nhttp://x 1.1.1.1 20200101 text/html 3\n", b"no head", b""]
    records = [(f"http://h/{i} x", "10.0.0.1", "19970305112233", "text/html", b) for i, b in enumerate(bodies)]
    data = warc.arc_file("a.arc", version, records)
    parsed = list(warc.parse_arc(data))
    assert [b for _, _, b in parsed[1:]] == bodies and parsed[1][1]["URL"] == "http://h/0 x"
    df = spark.createDataFrame([("a.arc", bytearray(data))], "name string, content binary")
    got = as_dicts(warc.convert(df))
    assert [r["type"] for r in got] == ["response", "resource", "resource"] and got[0]["date"] == "1997-03-05T11:22:33Z"
    assert bytes(got[0]["payload"]).startswith(b"hello") and len({r["record_id"] for r in got}) == 3
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-5].replace(b" 7\n", b" 9999\n")))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'").fetchall()
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows_of(df.columns, df.collect()) == rows_of(cols, res.fetchall())


def test_all_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", ["op4_suffix_array_dedup", "op9_toxicity"])
def test_query_runs_over_the_whole_table(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_pipeline_stages(spark, odd, empty):
    sf, rows = "/root/testdata/sf0.001", odd.count()
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        found[name] = out.count()
        if name != "packing":
            assert out.columns == odd.columns and found[name] <= rows
        assert stage(spark, empty, sf).count() == 0
    # a null, empty and blank texts make one component; so do the two long copies and their near copy, and the repeated row
    assert found["SimHash near-dedup"] < rows - 5 and found["PII"] == rows and found["packing"] >= rows
    assert found["benchmark decontamination"] == rows  # nothing here comes from the benchmark


def test_pipeline_against_stages_by_hand(spark):
    """Rows of run(): what plain Python keeps of each stage's input, cut and numbered."""
    from tests.llm.test_text_ops import plain_components, plain_fingerprint, word_list

    sf = "/root/testdata/sf0.001"
    good = as_dicts(corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in good}
    roots = plain_components(set(fps.values()), 4)
    low: dict = {}
    for i, f in fps.items():
        low[roots[f]] = min(i, low.get(roots[f], i))
    items = [word_list(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wins = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    kept = []
    for r in good:
        words = word_list(r["text"])
        if r["doc_id"] in low.values() and not any(tuple(words[i : i + 10]) in wins for i in range(len(words) - 9)):
            kept.append(r["doc_id"])
    got = as_dicts(corpus_pipeline.run(spark, sf).drop("ids"))
    assert sorted({r["doc_id"] for r in got}) == sorted(kept)
    total = collections.Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in got)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
