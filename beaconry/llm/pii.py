"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks. On top of them generators with high recall
propose candidates that may overlap: anything with an at sign, dotted groups of digits, long numbers, long opaque
strings. Boosted trees score each candidate from its format and its context; thresholds calibrated on held-back
documents select which candidates are added. Added spans have kinds of their own, base spans always stay.

No table labels personal data, so the trees learn from weak labels: a candidate counts as personal if it overlaps a
checked base span or is the value of a credential assignment. Features hold no such check, so the trees carry over to
spans that look the same but miss the strict pattern. Training counts candidates per cell of binned features over all
documents that have an id; only the cells, whose number the bins bound, reach the driver. Scores are plain CASE expressions. Nothing is shuffled when documents are scored.

Positions are code points, ends exclusive. Defined results: null texts are empty, empty texts have no spans, repeated
rows get equal rows, other columns are ignored, an empty table gives an empty result and no tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from beaconry.llm.common import spare_name, text_or_empty

#: The fixed patterns, written so that no input makes them backtrack: possessive repeats, and a start that is either the
#: end of the last match or not inside a run of the same characters.
LOCAL, DIGIT = "A-Za-z0-9._%+-", "0-9"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:\G|(?<![{DIGIT}]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "like_email": r"(?<![^\s<>,;@])[^\s<>,;@]++@[^\s<>,;@]++",
    "like_ip": r"(?<![0-9])[0-9]{1,3}+(?:[.\[\]()\x20]{1,3}+[0-9]{1,3}+){3}",
    "like_number": r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "like_secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CUES = {
    1: r"(?i)mail\W{0,3}$", 2: r"(?i)(?:tel|phone|call|fax|mobile)\w*\W{0,3}$", 3: r"(?i)(?:card|visa|iban|account)\w*\W{0,3}$",
    4: r"(?i)(?:ip|host|server|address)\W{0,3}$", 5: r"(?i)(?:token|secret|passw|pwd|api.?key)\w{0,8}\W{1,5}$",
}
FEATURES = ["kind", "digits", "letters", "length", "marks", "before", "after", "cue", "dots"]
SPAN_TYPE = "array<struct<s:int,e:int,v:string>>"


@dataclass(frozen=True)
class Params:
    rounds: int = 24
    rate: float = 0.3
    precision: float = 0.95
    least_support: int = 20
    context: int = 24


def _chars(text: Column) -> Column:
    return F.char_length(text)


def _matches(rows: DataFrame, text: str, patterns: dict[str, str], gates: dict[str, Column]) -> DataFrame:
    """Columns ``p_<kind>``: leftmost, non-overlapping matches with positions.

    Matches and the gaps between them come from the pattern; positions are the running lengths of both.
    """
    none = F.array().cast("array<string>")
    t = F.col(text)
    rows = rows.select("*", *[
        F.when(gates.get(k, F.lit(True)), F.regexp_extract_all(t, F.lit(p), 0)).otherwise(none).alias(f"m_{k}")
        for k, p in patterns.items()])
    rows = rows.select("*", *[
        F.when(F.size(f"m_{k}") > 0, F.split(t, p, -1)).otherwise(none).alias(f"g_{k}") for k, p in patterns.items()])

    def placed(k: str) -> Column:
        m, g = F.col(f"m_{k}"), F.col(f"g_{k}")

        def step(acc, i):
            start = acc["at"] + _chars(g[i])
            end = start + _chars(m[i])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(
                F.struct(start.alias("s"), end.alias("e"), m[i].alias("v")))).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_TYPE).alias("out"))
        return F.when(F.size(m) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step, lambda a: a["out"])).otherwise(
            F.array().cast(SPAN_TYPE))

    rows = rows.select("*", *[placed(k).alias(f"p_{k}") for k in patterns])
    return rows.drop(*[f"{x}_{k}" for k in patterns for x in "mg"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda v: F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: _chars(_digits(v)).between(8, 15),
}


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``base``: array of (kind, s, e) by kind, then start."""
    has_digit = F.col(text).rlike("[0-9]")
    gates = {"email": F.contains(F.col(text), F.lit("@")), "ip": has_digit, "card": has_digit,
             "phone": F.contains(F.col(text), F.lit("+"))}
    rows = _matches(docs, text, BASE, gates)

    def checked(k: str) -> Column:
        return F.transform(F.filter(f"p_{k}", lambda x: VALID[k](x["v"])),
                           lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    return rows.withColumn("base", F.concat(*[checked(k) for k in BASE])).drop(*[f"p_{k}" for k in BASE])


def _char_class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike("[0-9]"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"\s"), 3)
            .when(c.rlike("[+(@#]"), 4).otherwise(5))


def candidates(rows: DataFrame, text: str, p: Params) -> DataFrame:
    """``cands``: candidates with binned features; ``weak``: whether a candidate counts as personal in training."""
    has_digit = F.col(text).rlike("[0-9]")
    gates = {"like_email": F.contains(F.col(text), F.lit("@")), "like_ip": has_digit, "like_number": has_digit}
    rows = _matches(rows, text, GENERATORS, gates)
    t = F.col(text)

    def described(number: int, x: Column) -> Column:
        v = x["v"]
        n = _chars(v)
        before = F.substring(t, F.greatest(F.lit(1), x["s"] - p.context + 1), F.least(F.lit(p.context), x["s"]))
        cue = F.lit(0)
        for c, pattern in reversed(CUES.items()):
            cue = F.when(before.rlike(pattern), c).otherwise(cue)
        letters = n - _chars(F.regexp_replace(v, "[A-Za-z]", ""))
        hit = F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(number).alias("kind"), F.least(_chars(_digits(v)), F.lit(24)).alias("digits"),
            F.floor(4 * letters / n).cast("int").alias("letters"), F.floor(F.least(n, F.lit(48)) / 4).cast("int").alias("length"),
            F.least(n - _chars(F.regexp_replace(v, r"[^A-Za-z0-9]", "")), F.lit(6)).alias("marks"),
            _char_class(F.right(before, F.lit(1))).alias("before"), _char_class(F.substring(t, x["e"] + 1, F.lit(1))).alias("after"),
            cue.alias("cue"), F.least(n - _chars(F.regexp_replace(v, r"\.", "")), F.lit(4)).alias("dots"), hit.alias("base_hit"))

    def of_kind(number: int, k: str) -> Column:
        return F.transform(f"p_{k}", lambda x: described(number, x))

    return rows.withColumn("cands", F.concat(*[of_kind(i, k) for i, k in enumerate(GENERATORS)])).drop(*[f"p_{k}" for k in GENERATORS])


@dataclass(frozen=True)
class Trees:
    """Each tree: (feature, cut, (feature, cut, low, high) below, the same above); thresholds by kind number."""

    prior: float
    trees: list
    thresholds: dict[int, float]

    def value(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(x["kind"]), self.prior)
        for f, cut, low, high in self.trees:
            for side, (g, c, a, b) in ((x[f] <= cut, low), (x[f] > cut, high)):
                out += np.where(side, np.where(x[g] <= c, a, b), 0.0)
        return out

    def column(self, x: Column) -> Column:
        leaf = lambda t: F.when(x[t[0]] <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))
        total = F.lit(self.prior)
        for f, cut, low, high in self.trees:
            total = total + F.when(x[f] <= cut, leaf(low)).otherwise(leaf(high))
        return total

    def chosen(self, x: Column) -> Column:
        """Whether the score passes the threshold of the candidate's kind."""
        passing = F.lit(False)
        for kind, least in self.thresholds.items():
            passing = passing | ((x["kind"] == kind) & (self.column(x) >= least))
        return passing & ~x["base_hit"]


def _best_cut(x: dict, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray):
    best = (1e-9, None, 0)
    g, h = grad[rows], hess[rows]
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in FEATURES:
        v = x[f][rows]
        for cut in np.unique(v)[:-1]:
            low = v <= cut
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            if gain > best[0]:
                best = (gain, f, int(cut))
    return best[1:]


def boost(cells: list[dict], p: Params) -> Trees:
    """Trees of depth two on weighted cells; cells with fold 1 calibrate the thresholds."""
    if not cells:
        return Trees(0.0, [], {})
    x = {f: np.array([c[f] for c in cells]) for f in FEATURES}
    n, pos = (np.array([c[k] for c in cells], float) for k in ("n", "pos"))
    fit = np.array([c["fold"] == 0 for c in cells])
    share = (pos[fit].sum() + 0.5) / (n[fit].sum() + 1.0)
    model = Trees(float(np.log(share / (1 - share))), [], {})
    trees: list = []
    for _ in range(p.rounds):
        score = Trees(model.prior, trees, {}).value(x)
        prob = 1 / (1 + np.exp(-score))
        grad, hess = np.where(fit, pos - n * prob, 0.0), np.where(fit, n * prob * (1 - prob), 0.0)

        def leaf(rows):
            return float(p.rate * grad[rows].sum() / (hess[rows].sum() + 1.0))

        f, cut = _best_cut(x, grad, hess, fit)
        if f is None:
            break
        sides = []
        for side in (fit & (x[f] <= cut), fit & (x[f] > cut)):
            g, c = _best_cut(x, grad, hess, side)
            sides.append((g, c, leaf(side & (x[g] <= c)), leaf(side & (x[g] > c))) if g else (f, cut, leaf(side), leaf(side)))
        trees.append((f, cut, *sides))
    score = Trees(model.prior, trees, {}).value(x)
    thresholds = {}
    for kind in range(len(GENERATORS)):
        mine = np.flatnonzero(~fit & (x["kind"] == kind))
        order = mine[np.argsort(-score[mine], kind="stable")]
        total, right = np.cumsum(n[order]), np.cumsum(pos[order])
        last = np.flatnonzero(np.diff(np.append(score[order], -np.inf)) != 0)  # ends of equal scores
        good = [i for i in last if right[i] >= p.precision * total[i] and total[i] >= p.least_support]
        if good:
            thresholds[kind] = float(score[order][good[-1]])
    return Trees(model.prior, trees, thresholds)


def fit(docs: DataFrame, p: Params = Params()) -> Trees:
    rows = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    rows = candidates(base_spans(rows, "text"), "text", p)
    c = rows.select(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2)).cast("int").alias("fold"), F.explode("cands").alias("c"))
    cells = c.groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(
        F.count("*").alias("n"),
        F.sum((F.col("c.base_hit") | ((F.col("c.cue") == 5) & (F.col("c.kind") == 3) & (F.col("c.digits") > 3))).cast("int")).alias("pos"))
    found = sorted((r.asDict() for r in cells.collect()), key=lambda r: tuple(r.values()))
    return boost(found, p)


def spans(docs: DataFrame, model: Trees, text: str, p: Params = Params()) -> DataFrame:
    """The frame with ``base`` and ``added``: arrays of (kind, s, e), each by kind, then start."""
    rows = base_spans(docs, text)
    if not model.thresholds:
        return rows.withColumn("added", F.filter("base", lambda _: F.lit(False)))
    names = F.array(*[F.lit(k) for k in GENERATORS])
    rows = candidates(rows, text, p)
    added = F.transform(F.filter("cands", model.chosen), lambda x: F.struct(
        names[x["kind"]].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return rows.withColumn("added", added).drop("cands")


def _listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row: doc_id, counts and digest of base spans, and all spans as text."""
    rows = spans(docs.select("doc_id", text_or_empty().alias("text")), fit(docs, p), "text", p)

    def count(k: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one.

    Null texts stay null; ``n_chars``, where there is one, counts the new text.
    """
    model = fit(docs, p)
    cols = docs.columns
    whole = spare_name(docs, "whole_row")
    rows = spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias(whole), text_or_empty().alias("plain")), model, "plain", p)
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("back"), x["kind"].alias("kind"))))
    t = F.col("plain")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        end = -x["back"]
        fresh = x["s"] >= acc["at"]
        more = F.array(F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], end).alias("at"),
                        F.when(fresh, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    rows = rows.withColumn("order", order)
    rows = rows.withColumn("new_text", F.when(F.size("order") == 0, t).otherwise(F.aggregate(
        "order", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))))

    def result(c: str) -> Column:
        own = F.col(whole)[c]
        kept = F.col(whole)["text"].isNull()
        if c == "text":
            return F.when(kept, own).otherwise(F.col("new_text")).alias(c)
        if c == "n_chars":
            return F.when(kept, own).otherwise(_chars(F.col("new_text")).cast(docs.schema[c].dataType)).alias(c)
        return own.alias(c)

    return rows.select(*[result(c) for c in cols])
