"""PII, SimHash, packing, suffixes, decontamination and token files against brute force, odd cases included."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beaconry.llm import decontam, packing, pii, simhash, suffixes, token_output
from beaconry.llm.tokens import Encoder
from beaconry.session import scratch_dir
from tests.llm.conftest import as_dicts, document_rows, prose, DOCS

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return 16 <= len(digits) <= 19 and total % 10 == 0


def plain_spans(text):
    checks = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": luhn,
              "phone": lambda v: 8 <= sum(c.isdigit() for c in v) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if checks[k](m.group())]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_pii_base_spans(odd):
    rows = as_dicts(odd.select("doc_id", "text"))
    got = as_dicts(pii.report(odd))
    assert len(got) == len(rows)
    want = collections.Counter((r["doc_id"], hashlib.sha256(listed(plain_spans(r["text"])).encode()).hexdigest()) for r in rows)
    assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        if r["doc_id"] is not None:
            base = plain_spans(by_id[r["doc_id"]])
            assert r["spans"].startswith(listed(base))
            assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]


def test_pii_redaction_keeps_columns_and_the_rest(odd, empty):
    got = as_dicts(pii.redact(odd))
    assert [*pii.redact(odd).columns] == odd.columns
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[13].startswith("mail <EMAIL>, <EMAIL><EMAIL> or ip <IP> and 300.1.1.1; card <CARD>, ")
    assert text[0] is None and text[1] == "" and text[7].startswith("w")
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    assert pii.redact(empty).count() == 0 and pii.report(empty).count() == 0


def test_boosting_separates_cells():
    cells = [{**dict.fromkeys(pii.FEATURES, 0), "kind": 3, "digits": d, "cue": c, "fold": f, "n": 50, "pos": 50 if d > 8 and c else 0}
             for d in range(16) for c in (0, 5) for f in (0, 1)]
    model = pii.boost(cells, pii.Params())
    x = {f: np.array([c[f] for c in cells]) for f in pii.FEATURES}
    chosen = model.value(x) >= model.thresholds[3]
    assert chosen.tolist() == [c["pos"] > 0 for c in cells]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                label[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_against_brute_force(spark, odd, odd_texts):
    import random

    rng = random.Random(1)
    base = prose(rng, 60, [f"q{i}" for i in range(80)]).split(" ")
    near = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(60)] = f"new{i}"
        near.append(" ".join(words))
    more = spark.createDataFrame(document_rows(near, 1000), DOCS)
    docs = odd.union(more)
    got = as_dicts(simhash.near_duplicates(docs))
    rows = as_dicts(docs.select("doc_id", "text"))
    roots = plain_components({plain_fingerprint(r["text"]) for r in rows}, 4)
    lows: dict = {}
    for r in rows:
        if r["doc_id"] is not None:
            root = roots[plain_fingerprint(r["text"])]
            lows[root] = min(lows.get(root, r["doc_id"]), r["doc_id"])
    want = collections.Counter((r["doc_id"], plain_fingerprint(r["text"]), lows.get(roots[plain_fingerprint(r["text"])])) for r in rows)
    assert collections.Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    kept = as_dicts(simhash.keep_one(docs))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(lows.values())
    assert list(simhash.keep_one(docs).columns) == docs.columns


@pytest.mark.parametrize("hot", [3, 10_000])
def test_trie_links_with_and_without_salts(spark, hot):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(40):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for bits in (0, 2, 4):
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(df, bits, hot)).collect()}
        want = plain_components(fps, bits)
        groups = collections.Counter(want.values())
        together = {f: want[f] for f in fps if groups[want[f]] > 1}
        assert {f for f in roots} | set(roots.values()) == set(together)
        for f, r in roots.items():
            assert want[f] == want[r]
        assert len(set(roots.values())) == len(set(together.values()))


def test_candidates_of_all_documents_train(spark, monkeypatch):
    seen, boost = [], pii.boost
    monkeypatch.setattr(pii, "boost", lambda cells, p: seen.extend(cells) or boost(cells, p))
    docs = spark.range(9_000).selectExpr("if(id < 4500, id, null) as doc_id", "concat('write to me', id, '@example.com today') as text")
    pii.fit(docs)
    assert sum(c["n"] for c in seen if c["kind"] == 0) == 4_500  # every document that has an id


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_keep_one_tells_null_ids_and_null_texts_apart(spark):
    rows = [(None, "same words here twice", "a"), (-1, "same words here twice", "b"), (7, None, "c"), (7, "", "d"), (7, "", "e"),
            (8, "quite another text with words of its own", "z"), (8, "quite another text with words of its own", "y"),
            (None, "a lonely text without any id at all", "x")]
    kept = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        kept.add(tuple(sorted((r["doc_id"] is None, r["doc_id"] or 0, str(r["text"])[:5], r["lang"]) for r in simhash.keep_one(df).collect())))
    assert len(kept) == 1  # whatever the order of the rows
    found = kept.pop()
    assert [(n, i, t) for n, i, t, _ in found] == [(False, -1, "same "), (False, 7, "None"), (False, 8, "quite"), (True, 0, "a lon")]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_tokenizer(path, odd_texts):
    import random

    rng = random.Random(2)
    letters = "ab Z.'’sÉßİΣς\n\t   ́é中1²!#<|endoftext|>-\x85\x1c🙂"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    encoder, tokenizer = Encoder(path), Tokenizer.from_file(path)
    for text in [t for t in odd_texts if t] + made + ["<|ENDOFTEXT|> a", "don't WE'LL", "\n a \n b"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_with_a_mark_need_no_pattern(path):
    """Words, alone or with a mark at their end, are cut without the pattern; others still go through it."""
    encoder, tokenizer, cut = Encoder(path), Tokenizer.from_file(path), []
    pattern = encoder.pattern

    class Counting:
        def findall(self, part):
            cut.append(part)
            return pattern.findall(part)

    encoder.pattern = Counting()
    for text, odd in (("Straße, Ça va? THE end.", ""), ("One: one; ONE!", ""), ("wait... 12. don't", "wait... 12. don't"), ("a.b, . a", "a.b, .")):
        cut.clear()
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert {part.strip() for part in cut} == set(odd.split())


def test_packing(odd, empty):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = as_dicts(packing.pack(odd, BYTES))
    want = collections.Counter()
    for r in as_dicts(odd.select("doc_id", "text")):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        at = 0
        for n in packing.lengths(len(ids)):
            want[(r["doc_id"], at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids))] += 1
            at += n
        assert at == len(ids)
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows))) and {r["offset"] for r in rows} == {0}
    ordered = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert ordered == sorted(ordered, reverse=True) and all(n & (n - 1) == 0 and n <= 1024 for n in ordered)
    assert packing.pack(empty, BYTES).count() == 0


def test_token_files(spark, odd, empty):
    path = scratch_dir(spark, "test-tokens")
    token_output.write(odd, path, WORDS, 2)
    got = sorted(as_dicts(token_output.digests(token_output.read(spark, path))), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    tokenizer = Tokenizer.from_file(WORDS)
    text = {r["doc_id"]: r["text"] for r in as_dicts(odd.select("doc_id", "text"))}
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            want = tokenizer.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    part = token_output.read(spark, path, first=7, last=9)
    assert sorted(r["doc_id"] for r in part.collect()) == [7, 8, 9]
    plan = token_output.read(spark, path, tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    path = scratch_dir(spark, "test-no-tokens")
    token_output.write(empty, path, WORDS, 2)
    assert token_output.digests(token_output.read(spark, path)).count() == 0


def repeated_words(texts, least=50):
    words = [(t or "").encode().lower().split() for t in texts]
    windows = [[tuple(w[i : i + least]) for i in range(len(w) - least + 1)] for w in words]
    seen = collections.Counter(x for w in windows for x in w)
    return [{p for i, x in enumerate(w) if seen[x] > 1 for p in range(i, i + least)} for w in windows]


def test_repeated_passages(spark, odd, empty):
    import random

    rng = random.Random(9)
    pool = [f"v{i}" for i in range(3000)]
    shared = [prose(rng, n, pool) for n in (50, 51, 64, 49, 200)]
    texts = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 40), pool)]
        for s in rng.sample(shared, rng.randint(0, 2)):
            words = s.split(" ")
            cut = rng.randint(0, 12)
            parts += [" ".join(words[cut:] if i % 3 == 0 else words), prose(rng, rng.randint(0, 30), pool)]
        texts.append(" ".join(p for p in parts if p))
    docs = odd.union(spark.createDataFrame(document_rows(texts, 500), DOCS))
    got = collections.defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        assert r["end_word"] - r["start_word"] >= 50
        got[(r["doc_id"], r["k2"])].update(range(r["start_word"], r["end_word"]))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2")).collect()
    for r, want in zip(rows, repeated_words([r["text"] for r in rows])):
        assert got[(r["doc_id"], r["k2"])] == want
    assert suffixes.report(empty).count() == 0


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("limit", [0, 200_000])
def test_contamination(spark, odd, empty, odd_texts, limit):
    items = [(1, " ".join(odd_texts[10].split(" ")[45:75])), (2, "Two WORDS!"), (10, odd_texts[6]), (3, ""), (4, None), (None, "one"),
             (5, " ".join(odd_texts[7].split(" ")[100:109])), (6, " ".join(odd_texts[7].split(" ")[3000:3040]) + " tail"), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = as_dicts(decontam.contamination(odd, bench, broadcast_rows=limit))
    rows = as_dicts(odd.select("doc_id", "text"))
    want = collections.Counter()
    for r in rows:
        words = word_list(r["text"])
        hit, found = set(), set()
        for item, text in items:
            iw = word_list(text)
            n = min(10, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(item)
        want[(r["doc_id"], len(words), len(hit), tuple(sorted(str(i) for i in found if i is not None)))] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == sum(n for k, n in want.items() if k[2] == 0)
    assert decontam.report(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(odd, bench.limit(0)).collect()} == {0}


def test_spans_merge_like_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for doc in [None, *range(40)]:
        starts = rng.integers(0, 400, rng.integers(1, 30))
        rows.append((doc, 1, 2, [(int(s), int(s + rng.integers(1, 40))) for s in starts]))
    schema = "doc_id long, k1 long, k2 long, spans array<struct<s:int,e:int>>"
    want = []
    for doc, _, _, spans in rows:
        held = []
        for s, e in sorted(spans):
            if held and held[-1][1] >= s:
                held[-1][1] = max(held[-1][1], e)
            else:
                held.append([s, e])
        want += [(doc, s, e) for s, e in held]
    got = suffixes.merged_spans(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in got), key=key) == sorted(want, key=key)
    assert suffixes.merged_spans(spark.createDataFrame([], schema)).count() == 0
