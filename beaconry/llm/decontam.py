"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` = k + w - 1 consecutive words: w word k-grams. Its fingerprint is the smallest hash of these
k-grams, so equal windows have equal fingerprints on both sides and every shared span of ``span`` words is a hit.
Neighbouring windows mostly share their minimum; a document keeps one row per run of equal minima (about 2 / (w + 1)
of its words). Runs whose fingerprint occurs in the benchmark are extended to their windows, which must then equal an
item's window word by word. An item of fewer words is one window of its own length.

The fingerprints of the benchmark are broadcast only if they were counted and are at most ``broadcast_rows``; beyond
that, keys of runs are joined by a shuffle and the texts of documents with a hit are fetched afterwards.

Defined results: null and empty texts have no words and no hits; items without words never occur; null item ids are
ignored in the list of items but their windows hit; repeated rows are reported once each; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from beaconry.llm.common import row_key, spare_name, stored, text_or_empty

K, W = 5, 6
SPAN = K + W - 1
BROADCAST_ROWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only; ``lower`` is the same for ASCII and much faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(WORD), 0)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _text(words: Column, start: Column, n) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def with_minima(rows: DataFrame) -> DataFrame:
    """``minima``: fingerprint of each window of SPAN words of ``words``."""
    w = F.col("words")
    grams = F.when(F.size(w) >= SPAN, F.transform(
        F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[w[i + d] for d in range(K)])))
    rows = rows.withColumn("grams", grams)
    g = F.col("grams")
    return rows.withColumn("minima", F.when(F.size(w) >= SPAN, F.transform(
        F.sequence(F.lit(0), F.size(g) - W), lambda i: F.array_min(F.slice(g, i + 1, W))))).drop("grams")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, fp, win): every window of every item."""
    rows = with_minima(benchmark.select("item_id", words_of(text_or_empty()).alias("words")).where(F.size("words") > 0))
    w, m = F.col("words"), F.col("minima")
    whole = F.array(F.struct(F.size(w).alias("n"), F.xxhash64(F.size(w), w).alias("fp"), F.array_join(w, " ").alias("win")))
    each = F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.struct(
        F.lit(SPAN).alias("n"), m[i].alias("fp"), _text(w, i, SPAN).alias("win")))
    return rows.select("item_id", F.explode(F.when(F.size(w) >= SPAN, each).otherwise(whole)).alias("x")).select("item_id", "x.*")


def _runs(short: list[int]) -> Column:
    """Runs (fp, from, to, n) of equal minima, and one per k-gram of each length in ``short``."""
    w, m, heads = F.col("words"), F.col("minima"), F.col("heads")
    kind = "array<struct<fp:bigint,from:int,to:int,n:int>>"
    runs = F.when(F.size(w) >= SPAN, F.transform(heads, lambda i, t: F.struct(
        m[i].alias("fp"), i.alias("from"), (F.coalesce(F.get(heads, t + 1), F.size(m)) - 1).alias("to"),
        F.lit(SPAN).alias("n"))).cast(kind)).otherwise(_empty(kind))

    def grams(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(
            F.xxhash64(F.lit(n), F.slice(w, i + 1, n)).alias("fp"), i.alias("from"), i.alias("to"), F.lit(n).alias("n")))
            .cast(kind)).otherwise(_empty(kind))

    return F.concat(runs, *[grams(n) for n in short])


def _exploded(docs: DataFrame, short: list[int]) -> DataFrame:
    """A row per run, and one with a null run for a document without any."""
    k1, k2 = row_key(docs)
    rows = with_minima(docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), words_of(text_or_empty()).alias("words")))
    m = F.col("minima")
    rows = rows.withColumn("heads", F.when(F.size("words") >= SPAN, F.filter(
        F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (m[i] != F.coalesce(F.get(m, i - 1), F.lit(0))))))
    rows = rows.select("doc_id", "k1", "k2", "words", _runs(short).alias("runs"))
    return rows.select("doc_id", "k1", "k2", "words", F.size("words").cast("long").alias("n_words"),
                       F.posexplode_outer("runs").alias("at", "run"))


KEYS = ["doc_id", "k1", "k2"]
WINDOW = "array<struct<doc:boolean,start:int,n:int,win:string>>"


def _candidates_small(docs: DataFrame, marks: DataFrame, short: list[int]) -> DataFrame:
    """One pass: runs meet the broadcast fingerprints while the words of their document are still at hand."""
    marks = marks.withColumn("hit", F.lit(True))
    rows = _exploded(docs, short).withColumn("fp", F.col("run.fp")).join(F.broadcast(marks), "fp", "left")
    itself = F.coalesce(F.col("at") == 0, F.lit(True))
    rows = rows.where(F.col("hit") | itself)
    none = F.lit(None)
    own = F.when(itself, F.array(F.struct(F.lit(True).alias("doc"), none.alias("start"), none.alias("n"), none.alias("win")))
                 .cast(WINDOW)).otherwise(_empty(WINDOW))
    wins = F.when(F.col("hit"), _windows(F.col("run"), F.col("words")).cast(WINDOW)).otherwise(_empty(WINDOW))
    return rows.select(*KEYS, "n_words", F.explode(F.concat(own, wins)).alias("w")).select(*KEYS, "n_words", "w.*")


def _candidates_large(docs: DataFrame, marks: DataFrame, short: list[int]) -> DataFrame:
    """Runs go to the fingerprints without their words; documents with a hit are fetched by key."""
    runs = _exploded(docs, short).where("run is not null").select("k1", "k2", "run", F.col("run.fp").alias("fp"))
    hits = runs.join(marks.hint("shuffle_hash"), "fp", "left_semi").groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"))
    k1, k2 = row_key(docs)
    texts = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), words_of(text_or_empty()).alias("words"))
    rows = texts.join(hits, ["k1", "k2"], "left")
    none = F.lit(None)
    own = F.array(F.struct(F.lit(True).alias("doc"), none.alias("start"), none.alias("n"), none.alias("win"))).cast(WINDOW)
    wins = F.flatten(F.transform("runs", lambda r: _windows(r, F.col("words")).cast(WINDOW)))
    return rows.select(*KEYS, F.size("words").cast("long").alias("n_words"),
                       F.explode(F.concat(own, F.coalesce(wins, _empty(WINDOW)))).alias("w")).select(*KEYS, "n_words", "w.*")


def _windows(run: Column, words: Column) -> Column:
    return F.transform(F.sequence(run["from"], run["to"]), lambda i: F.struct(
        F.lit(False).alias("doc"), i.alias("start"), run["n"].alias("n"), _text(words, i, run["n"]).alias("win")))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, k1, k2, n_words, n_hit and items (ids as strings, sorted as strings)."""
    windows = stored(item_windows(benchmark), "benchmark-windows")
    facts = windows.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("n") < SPAN, F.col("n"))).alias("short")).first()
    small = facts["n"] <= broadcast_rows
    marks = windows.select("fp").distinct()
    make = _candidates_small if small else _candidates_large
    found = stored(make(docs, marks, sorted(facts["short"])), "contamination")
    items = windows.groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    each = found.where("not doc").join(F.broadcast(items) if small else items, "win")
    hits = each.groupBy("k1", "k2").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))))
        .cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rows = found.where("doc").select(*KEYS, "n_words").join(hits, ["k1", "k2"], "left")
    return rows.select(*KEYS, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                       F.coalesce("items", _empty("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their columns, that hold no window of any benchmark item."""
    a, b = spare_name(docs, "key_id"), spare_name(docs, "key_text")
    k1, k2 = row_key(docs)
    bad = contamination(docs, benchmark).where("n_hit > 0").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    return docs.withColumn(a, k1).withColumn(b, k2).join(bad, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
