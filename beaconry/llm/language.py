"""Language identification by compression.

Each language has raw-content zstandard dictionaries made of excerpts of its labelled texts. A text (lower-cased) is cut into blocks of
``block`` bytes, every block is compressed with each language's dictionary, and the language with the fewest bytes in all is chosen.
Equal sizes are settled by a second dictionary of the languages concerned, then by the number of training rows, then by name.
The margin is what the runner-up needs more, in bits per byte of text; a logistic curve through the margins of labelled excerpts that no
dictionary holds turns it into the score, and a choice whose margin is below ``reject`` is marked ``rejected``.

Sizes: the ``MAX_LANGS`` most frequent languages are learned, each from at most ``PER_LANG`` distinct texts with the smallest hashes, one
excerpt of at most ``EXCERPT`` characters each; a dictionary holds at most ``DICT_BYTES``.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so are all if nothing was learned; null languages teach
nothing; equal texts get equal results; repeated rows keep their own rows; null ids are not held out and teach like others; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame, functions as F

from beaconry.llm.common import append_column, id_crc, stored

MAX_LANGS, PER_LANG, EXCERPT, DICT_BYTES = 200, 240, 2_000, 64 << 10
#: Excerpts of a language that calibrate, of its ``PER_LANG``.
HELD = 80
BLOCK, LEVEL = 8 << 10, 6
#: A margin in bits per byte below which the choice is rejected.
REJECT = 0.02
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Languages with most training rows first, two dictionaries each, and the curve from margin to score."""

    langs: tuple[str, ...]
    first: tuple[bytes, ...]
    second: tuple[bytes, ...]
    slope: float = 8.0
    shift: float = 0.0
    reject: float = REJECT
    block: int = BLOCK


class Coder:
    """Compressors of a model; made once per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.sets = [[self._compressor(d) for d in dicts] for dicts in (model.first, model.second)]

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        if len(content) < 8:
            return zstd.ZstdCompressor(**plain)
        made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(dict_data=made, **plain)

    def sizes(self, which: int, data: bytes, langs) -> list[int]:
        step = self.model.block
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(len(self.sets[which][k].compress(b)) for b in blocks) for k in langs]

    def choose(self, text: str | None) -> tuple[int | None, float]:
        """(place of the language or None, margin in bits per byte)."""
        if not text or not self.model.langs or not LETTER.search(text):
            return None, 0.0
        data = text.lower().encode("utf-8", "replace")
        sizes = self.sizes(0, data, range(len(self.model.langs)))
        least = min(sizes)
        tied = [k for k, n in enumerate(sizes) if n == least]
        if len(tied) > 1:
            again = self.sizes(1, data, tied)
            return tied[again.index(min(again))], 0.0
        if len(sizes) == 1:
            return 0, 8.0
        return tied[0], 8.0 * (sorted(sizes)[1] - least) / len(data)

    def score(self, margin: float) -> float:
        z = self.model.slope * margin + self.model.shift
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def calibrated(model: Model, held: list[tuple[str, str]]) -> Model:
    """The curve with the least logistic loss on the (language, excerpt) rows kept back."""
    coder = Coder(model)
    got = [(coder.choose(text), lang) for lang, text in held]
    rows = [(m, k is not None and model.langs[k] == lang) for (k, m), lang in got if k is not None]
    if not rows:
        return model
    m, right = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)

    def loss(slope: float, shift: float) -> float:
        z = slope * m + shift
        return float(np.mean(np.logaddexp(0, z) - right * z)) + 1e-4 * slope

    slope, shift = min(((a, b) for a in np.geomspace(1, 100, 25) for b in np.linspace(-2, 4, 25)), key=lambda p: loss(*p))
    return Model(model.langs, model.first, model.second, float(slope), float(shift), model.reject, model.block)


def sample(docs: DataFrame, allowed: Column, per_lang: int = PER_LANG, excerpt: int = EXCERPT, max_langs: int = MAX_LANGS) -> dict:
    """Per language, most frequent first: excerpts of at most ``per_lang`` distinct texts, by the hash of the text."""
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not counts:
        return {}
    h = F.xxhash64(F.col("text").cast("string"), F.lit(11))
    # Some 3 x per_lang rows per language pass, or all of a small one, whatever the size of the table.
    parts = [F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 3 * per_lang / r["n"]) * 2.0**31)) for r in counts]
    start = F.pmod(F.shiftrightunsigned(h, 20), F.greatest(F.length("text") - excerpt + 1, F.lit(1))).cast("int")
    chosen = rows.where(F.pmod(h, F.lit(2**31)) <= F.coalesce(*parts)).select(
        "lang", h.alias("h"), F.substring(F.col("text").cast("string"), start + 1, F.lit(excerpt)).alias("part"))
    chosen = chosen.where(F.col("part").rlike(r"\p{L}")).groupBy("lang", "h").agg(F.max("part").alias("part"))
    found = {r["lang"]: [] for r in counts}
    # Equal texts are one row each here, so a language has some 3 x per_lang rows at most.
    for r in stored(chosen, "excerpts").orderBy("lang", "h").toLocalIterator():
        if len(found[r["lang"]]) < per_lang:
            found[r["lang"]].append(r["part"])
    return {k: v for k, v in found.items() if v}


def fit(docs: DataFrame, allowed: Column | None = None, held: int = HELD, dict_bytes: int = DICT_BYTES, reject: float = REJECT) -> Model:
    """Dictionaries from the texts and languages of the rows that the condition ``allowed`` admits."""
    texts = sample(docs, F.lit(True) if allowed is None else allowed)
    first, second, back = [], [], []
    for lang, parts in texts.items():
        kept, rest = parts[: min(held, len(parts) // 3)], parts[min(held, len(parts) // 3) :]
        back += [(lang, p) for p in kept]
        joined = [b"\n".join(p.lower().encode("utf-8", "replace") for p in rest[i::2])[:dict_bytes] for i in (0, 1)]
        first.append(joined[0])
        second.append(joined[1] or joined[0])
    return calibrated(Model(tuple(texts), tuple(first), tuple(second), reject=reject), back)


def with_language(docs: DataFrame, model: Model, name: str = "lang_found") -> DataFrame:
    """All columns of the documents and a struct (lang_pred, score, margin, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Coder] = {}
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    def run(texts):
        coder = state.get("c") or state.setdefault("c", Coder(shared.value))
        out = []
        for t in texts:
            k, margin = coder.choose(t)
            out.append({"lang_pred": "und", "score": 0.0, "margin": 0.0, "rejected": True} if k is None else {
                "lang_pred": coder.model.langs[k], "score": coder.score(margin), "margin": margin, "rejected": margin < coder.model.reject})
        return pa.array(out, kind)

    return append_column(docs, name, "struct<lang_pred:string,score:double,margin:double,rejected:boolean>", "text", run)


def classify(docs: DataFrame, held_back: int = 1) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, margin, rejected. Rows with crc32(doc_id) mod 3 = ``held_back`` teach nothing."""
    held_out = F.coalesce((id_crc() % 3 == held_back) & F.col("doc_id").isNotNull(), F.lit(False))
    model = fit(docs, ~held_out)
    found = with_language(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_found.*")
