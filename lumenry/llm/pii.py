"""Personal data by candidate gradient boosting, in DataFrame expressions only.

High-recall generators (regular expressions) propose spans, which may overlap.
Base spans, which pass the checks of their kind, always stay.  The other
candidates (spelled-out mail addresses, national phone numbers, cards in odd
separators, long address forms) are scored by boosted trees over features of
format and context; a threshold per kind, calibrated on held-out labelled
candidates, selects those that are redacted too.

The trees are trained here, on a labelled table that is made from templates.
They become CASE expressions, so scoring stays in the JVM.  Spans are in code
points, end exclusive.  Texts are whole; no stage shuffles.

Patterns are written so that a match never depends on backtracking through a
group, which keeps them linear and off the stack on texts of any length.

Results: a null or empty text has no spans and stays as it is when redacted.
Candidates of one start are taken in the order of their ends and kinds; of spans
that overlap, redaction names the first.  Repeated rows get equal results; an
empty table gives an empty one.  Columns of any name pass through, but for those
of the results' names, which the results replace.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import set_aside

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
#: Base patterns.  Each is the asked-for pattern, made possessive, and begun only
#: where a leftmost match can begin: not inside a run of its first class, unless
#: the match before ended there.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators: (kind, pattern, what a text must contain).
EXTRA = (
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\(at\)|\[at\]|\{{at\}}| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}| dot ) ?[A-Za-z0-9-]++)++", "dot"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    ("card", r"(?<![0-9A-Za-z./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z./_])", None),
    ("phone", r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", None),
    ("phone", r"(?<![0-9A-Za-z+().-])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z-])", "00"),
)
#: Letters of context before and after a candidate.
BEFORE, AFTER = 32, 12
SIGNS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|host|addr(?:ess)?|server|from|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay(?:ment|ing)?)\b",
    "phone": r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|contact|whatsapp|text|ring|reach)\b",
}
AGAINST = r"(?i)(?:\b(?:order|invoice|version|ref|reference|isbn|serial|part|model|case|ticket|tracking|item|sku|build|page|section|meet|look|stop)\b|[#$])"
FEATURES = ("kind", "digits", "length", "brackets", "marks", "luhn", "sign", "against", "distinct", "spaces")
#: Shape of the model.
ROUNDS, RATE, PRECISION = 24, 0.3, 0.98


def _find(df: DataFrame, name: str, pattern: str, needs: str | None, text: str) -> DataFrame:
    """df with array columns name_v (matches) and name_s (their starts).

    The texts between the matches and the matches themselves alternate, so the
    starts are running sums of their lengths: over blocks of 256, then inside
    the block.  Each array is a column of its own (and used twice in the next),
    so that it is computed once a row and not once an element.
    """
    v, g, d, b, s = (f"{name}_{x}" for x in "vgdbs")
    some = F.contains(F.col(text), F.lit(needs)) if needs else F.lit(True)
    numbers = F.array().cast("array<int>")
    df = df.withColumn(v, F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    full = lambda c, made: F.when(F.size(c) > 0, made).otherwise(numbers)
    total = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    df = df.withColumn(g, full(v, F.transform(F.split(F.col(text), pattern, -1), F.length)))
    step = lambda x, i: F.get(F.col(g), i) + F.when(i > 0, F.length(F.get(F.col(v), i - 1))).otherwise(0)
    df = df.withColumn(d, full(g, F.transform(F.col(v), step)))
    df = df.withColumn(b, full(d, F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / 256).cast("int")), lambda k: total(F.slice(d, k * 256 + 1, F.lit(256))))))
    before = lambda i: total(F.slice(b, F.lit(1), F.floor(i / 256).cast("int")))
    start = F.transform(F.col(d), lambda x, i: before(i) + total(F.slice(d, i - i % 256 + 1, i % 256 + 1)))
    return df.withColumn(s, F.when(F.size(b) > 0, start).otherwise(numbers)).drop(g, d, b)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(v, r"\."), lambda p: F.when(small(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int") <= 255).otherwise(False))
    d = _digits(v)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False)
    return F.length(d).between(9, 15)


def _checked(kind: str):
    return lambda c: _valid(kind, c["v"])


def _spans(name: str, kind: str) -> Column:
    return F.transform(
        F.col(f"{name}_v"),
        lambda v, i: F.struct(F.lit(KINDS.index(kind)).alias("k"), F.get(F.col(f"{name}_s"), i).alias("s"), (F.get(F.col(f"{name}_s"), i) + F.length(v)).alias("e"), v.alias("v")),
    )


def _features(c: Column, text: str) -> Column:
    """A candidate's features, as a struct of doubles."""
    v, t = c["v"], F.col(text)
    before = F.substring(t, F.greatest(c["s"] - BEFORE, F.lit(0)) + 1, F.least(c["s"], F.lit(BEFORE)))
    after = F.substring(t, c["e"] + 1, F.lit(AFTER))
    around = F.concat(before, F.lit(" "), after)
    sign = reduce(lambda a, k: a.when(c["k"] == KINDS.index(k), around.rlike(SIGNS[k])), KINDS[1:], F.when(c["k"] == 0, around.rlike(SIGNS["email"])))
    d = _digits(v)
    values = {
        "kind": c["k"],
        "digits": F.length(d),
        "length": F.length(v),
        "brackets": F.length(F.regexp_replace(v, r"[^()\[\]{}]", "")),
        "marks": F.length(F.regexp_replace(v, r"[^./_:-]", "")),
        "luhn": F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False).cast("int"),
        "sign": sign.cast("int"),
        "against": around.rlike(AGAINST).cast("int"),
        "distinct": F.size(F.array_distinct(F.split(d, ""))),
        "spaces": F.length(F.regexp_replace(v, "[^ ]", "")),
    }
    return F.struct(*[values[n].cast("double").alias(n) for n in FEATURES])


# ---- training -------------------------------------------------------------------------


def labelled_candidates(n: int = 720, seed: int = 11) -> list[tuple[str, int]]:
    """Short texts with one candidate each, and whether it is personal data."""
    rng = random.Random(seed)
    pick, num = rng.choice, lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick("abdeilmnorst") for _ in range(rng.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 5)))

    def card(good: bool) -> str:
        d = "4" + num(14)
        total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in d))
        last = (-total) % 10
        s = pick("./_")
        d += str(last if good else (last + rng.randint(1, 9)) % 10)
        return s.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))

    def mail(mark: str) -> str:
        a, d = {"(": ("(at)", "(dot)"), "[": ("[at]", "[dot]"), " ": (" at ", " dot ")}[mark]
        return f"{word()}{a}{word()}{d}{word()[:3]}"

    ask = {"phone": ["call", "phone:", "tel", "mobile", "fax", "text", "contact"], "card": ["card", "visa", "credit card", "payment"], "email": ["email", "mail", "contact", "write to"], "ip": ["ip", "host", "login from"]}
    no = ["order", "invoice", "ref", "serial", "isbn", "ticket", "tracking", "part", "#"]
    made: list[tuple[str, int]] = []
    while len(made) < n:
        kind = pick(("phone", "phone", "card", "email", "ip", "exit"))
        lead, label = pick(("sign", "none", "no")), 0
        if kind == "phone":
            v = phone()
            label = int(lead == "sign" or (lead == "none" and v[0] == "("))
        elif kind == "exit":
            kind, v = "phone", "00" + pick("1234567") + "".join(pick(" -") + num(3) for _ in range(3))
            label = int(lead == "sign")
        elif kind == "card":
            good = rng.random() < 0.5
            v, label = card(good), int(good and lead != "no")
        elif kind == "email":
            mark = pick("([ ")
            v, label = mail(mark), int(lead != "no" if mark != " " else lead == "sign")
        else:
            v = ":".join("".join(pick("0123456789abcdef") for _ in range(4)) for _ in range(8))
            label = int(lead != "no")
        before = {"sign": pick(ask[kind]), "none": word(), "no": pick(no)}[lead]
        made.append((f"{prose()} {before} {v} {prose()}", label))
    return made


@dataclass
class Model:
    """Trees of depth two: (feature, cut, (feature, cut, low, high), (feature, cut, low, high))."""

    trees: list = field(default_factory=list)
    bias: float = 0.0
    slope: float = 1.0  # calibration: probability = 1 / (1 + exp(-(slope * score + offset)))
    offset: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, t, low, high in self.trees:
            side = x[:, f] <= t
            for rows, (g, u, a, b) in ((side, low), (~side, high)):
                out[rows] += np.where(x[rows, g] <= u, a, b)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(x) + self.offset)))

    def column(self, features: Column) -> Column:
        """The calibrated probability as an expression."""
        leaf = lambda s: F.when(features[FEATURES[s[0]]] <= F.lit(s[1]), F.lit(s[2])).otherwise(F.lit(s[3]))
        total = F.lit(self.bias)
        for f, t, low, high in self.trees:
            total = total + F.when(features[FEATURES[f]] <= F.lit(t), leaf(low)).otherwise(leaf(high))
        return 1 / (1 + F.exp(-(F.lit(self.slope) * total + F.lit(self.offset))))

    def selects(self, kind: Column, features: Column) -> Column:
        cuts = reduce(lambda a, k: a.when(kind == k, F.lit(self.thresholds[k])), range(1, len(KINDS)), F.when(kind == 0, F.lit(self.thresholds[0])))
        return self.column(features) >= cuts


def _best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray):
    """The cut with the largest Newton gain: (gain, feature, cut, low value, high value)."""
    worth = lambda a, b: a * a / (b + 1.0)
    G, H = g.sum(), h.sum()
    best = (0.0, 0, np.inf, float(-G / (H + 1.0)), 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = g[low].sum(), h[low].sum()
            gain = worth(a, b) + worth(G - a, H - b) - worth(G, H)
            if gain > best[0] + 1e-9:
                best = (gain, f, float(t), float(-a / (b + 1.0)), float(-(G - a) / (H - b + 1.0)))
    return best


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Gradient boosting with logistic loss on two thirds; calibration and thresholds on the rest."""
    fit = np.arange(len(y)) % 3 != 2
    model = Model(bias=float(np.log((y[fit].mean() + 1e-3) / (1 - y[fit].mean() + 1e-3))))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-model.score(x[fit])))
        g, h = p - y[fit], p * (1 - p)
        _, f, t, _, _ = _best_cut(x[fit], g, h)
        t = t if np.isfinite(t) else 0.0
        low = x[fit][:, f] <= t
        sides = []
        for rows in (low, ~low):
            _, f2, t2, a, b = _best_cut(x[fit][rows], g[rows], h[rows]) if rows.any() else (0, 0, 0.0, 0.0, 0.0)
            sides.append((int(f2), float(t2) if np.isfinite(t2) else 1e9, RATE * a, RATE * b))
        model.trees.append((int(f), float(t), *sides))
    s, held = model.score(x[~fit]), y[~fit]
    for _ in range(50):  # Newton steps for slope and offset, lightly held to (1, 0)
        p = 1 / (1 + np.exp(-(model.slope * s + model.offset)))
        w = p * (1 - p)
        grad = np.array([((p - held) * s).sum() + 0.1 * (model.slope - 1), (p - held).sum() + 0.1 * model.offset])
        hess = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        model.slope, model.offset = float(model.slope - step[0]), float(model.offset - step[1])
    p = model.probability(x[~fit])
    for k in range(len(KINDS)):
        mine = x[~fit][:, 0] == k
        cuts = [c for c in np.linspace(0.5, 0.99, 50) if (mine & (p >= c)).any() and held[mine & (p >= c)].mean() >= PRECISION]
        model.thresholds[k] = float(min(cuts)) if cuts else 0.99
    return model


def train(spark: SparkSession) -> Model:
    """Features of the labelled table come from the same expressions that score texts."""
    rows = [{"i": i, "text": t, "y": y} for i, (t, y) in enumerate(labelled_candidates())]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<i: int, text: string, y: int>>")))
    found = _candidates(table, "text").select("i", "y", "text", F.explode("_extra").alias("c"))
    got = found.select("i", "y", _features(F.col("c"), "text").alias("x")).orderBy("i").collect()
    return boost(np.array([[r["x"][n] for n in FEATURES] for r in got]), np.array([r["y"] for r in got], dtype=float))


# ---- the operator ---------------------------------------------------------------------


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """df with _base (valid base spans, by kind and start) and _extra (other candidates)."""
    keep = df.columns
    for kind in KINDS:
        df = _find(df, f"_{kind}", BASE[kind], {"email": "@", "phone": "+"}.get(kind), text)
    for n, (_, pattern, needs) in enumerate(EXTRA):
        df = _find(df, f"_x{n}", pattern, needs, text)
    base = F.concat(*[F.filter(_spans(f"_{k}", k), _checked(k)) for k in KINDS])
    extra = F.concat(*[_spans(f"_x{n}", kind) for n, (kind, _, _) in enumerate(EXTRA)])
    return df.select(*[f"`{c}`" for c in keep], base.alias("_base"), extra.alias("_extra"))


def _of_kind(kind: int):
    return lambda c: c["k"] == kind


def _overlapped(c: Column, kind: int) -> Column:
    """Whether a base span of the kind overlaps candidate c.  Those do not overlap each other,
    so it is the last one that starts before c ends, found by bisection, or none."""
    spans = F.col(f"_base{kind}")
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    mid = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    early = lambda a: (a["lo"] < a["hi"]) & (F.get(spans, mid(a))["s"] < c["e"])
    narrow = lambda a, _: F.when(early(a), F.struct((mid(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(
        F.struct(a["lo"].alias("lo"), F.when(a["lo"] < a["hi"], mid(a)).otherwise(a["hi"]).alias("hi"))
    )
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int") + 1)
    return F.when(F.size(spans) > 0, F.aggregate(steps, start, narrow, lambda a: F.coalesce(F.get(spans, a["lo"] - 1)["e"] > c["s"], F.lit(False)))).otherwise(F.lit(False))


def find(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with _base and _added, arrays of (k: kind's number, s, e, v)."""
    docs, own, keep = set_aside(docs, "_base", "_added")
    df = docs.withColumn("_t", F.coalesce(F.col(own[text]), F.lit("")))
    df = _candidates(df, "_t")
    both = (F.size("_extra") > 0) & (F.size("_base") > 0)
    # each array is a column that the next one uses twice, so that it is computed once a row
    df = df.withColumns({f"_base{k}": F.when(both, F.filter("_base", _of_kind(k))).otherwise(F.slice("_base", 1, 0)) for k in range(len(KINDS))})
    free = F.filter("_extra", lambda c: ~reduce(Column.__or__, [_overlapped(c, k) for k in range(len(KINDS))]))
    df = df.withColumn("_free", F.when(both, free).otherwise(F.col("_extra")))
    scored = F.transform("_free", lambda c: F.struct(c.alias("c"), _features(c, "_t").alias("x")))
    df = df.withColumn("_scored", F.when(F.size("_free") > 0, scored))
    chosen = F.transform(F.filter("_scored", lambda r: model.selects(r["c"]["k"], r["x"])), lambda r: r["c"])
    return df.withColumn("_added", F.coalesce(chosen, F.slice("_extra", 1, 0))).select(*keep, "_base", "_added")


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def all_spans() -> Column:
    """Base and added spans, by kind as listed, then start."""
    return F.array_sort(F.concat("_base", "_added"))


def redacted(text: str = "text") -> Column:
    """The text with every run of overlapping spans replaced by [KIND] of its first span."""
    order = F.array_sort(F.transform(F.concat("_base", "_added"), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, c: F.when(
        c["s"] >= a["at"], F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, c["s"] - a["at"]), F.get(kinds, c["k"])).alias("out"), c["e"].alias("at"))
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], c["e"]).alias("at")))
    end = lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text))))
    return F.when(F.size(order) > 0, F.aggregate(order, start, step, end)).otherwise(F.col(text))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text; n_chars, where there is one, follows."""
    moved, own, keep = set_aside(docs)
    text = F.col(own["text"])
    df = find(moved, train(docs.sparkSession), text=own["text"]).withColumn("_new", redacted(own["text"]))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_new") != text, F.length("_new")).otherwise(F.col(own.get("n_chars", own["text"])))}
    return df.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else k for c, k in zip(docs.columns, keep, strict=True)])
