"""Small tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

EXTRA = "score double, fp long, words string, base string, label int, hit boolean, n string, spans string, k1 long, keep_id_ string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def document_rows(texts, first=0):
    return [(first + i, t, "en", "s", None if t is None else len(t), 0.5, 1, "w", "b", 1, True, "n", "s", 3, "k")
            for i, t in enumerate(texts)]


def prose(rng, n, words=None):
    pool = words or ["alpha", "beta", "gamma", "delta", "of", "the", "and", "river", "stone", "Light", "été", "ñandú", "house"]
    return " ".join(rng.choice(pool) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    long = prose(rng, 6000, [f"w{i}" for i in range(400)])
    passage = prose(rng, 70, [f"p{i}" for i in range(90)])
    return [
        None, "", " \n\t ", "one", "One", "two words", prose(rng, 12), long, long, long[:-3] + "xyz",
        prose(rng, 40) + " " + passage + " " + prose(rng, 30), prose(rng, 25) + " " + passage, passage.upper(),
        "mail a.b@mail.example.com, a@b.c_d@e.fr or ip 10.0.0.1 and 300.1.1.1; card 4111 1111 1111 1111, 4111-1111-1111-1112",
        "+1 (706) 555-3138 é +4412345678 🙂 x@y.zz token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end", "x" * 30_000,
        "9 " * 3000, "@" * 2000 + "a." * 2000, "İSTANBUL Straße ΣΑΣ é", "a  b   c\n\n d <|endoftext|> e",
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    rows = document_rows(odd_texts)
    none = tuple([None] * 15)
    anonymous = (None, "a text without id", None, None, None) + (None,) * 10
    return spark.createDataFrame([*rows, rows[6], none, anonymous], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (4, 0, 0), (4, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
