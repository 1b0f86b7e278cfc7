"""Quality rules: a learned decision list.

Per-document statistics are computed by array kernels; a decision list is
learned from labelled statistics by sequential covering: rules for the class
"reject" are grown condition by condition on two thirds of the labelled rows,
pruned on the rest, and kept while they are precise there.  The list is emitted
as one ordered Spark CASE expression over the statistics.

The labelled sample is bounded: at most ``bound`` rows of ``labels``, those of
the least hash of doc_id.  Statistics and verdicts cover all rows and whole
texts.

Results: a null or empty text has zero statistics and fails the base rule.
Without usable labels the list is empty and only the base rule rejects.
Repeated rows get equal verdicts.  Columns of any name pass through ``apply``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import NOT_SPACE, SAME, Words, _table, append_struct, pieces, shingles, text_buffer

#: Labelled rows that training reads at most.
BOUND = 4000
#: Fixed value: the symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"

STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper", "n_digits", "n_sentence_ends", "n_marks", "max_word_bytes",
]
FIELDS = ", ".join(f"{n}: long" for n in STATS)

_CLASSES = {
    "n_symbols": _table(lambda b: chr(b) in SYMBOLS),
    "n_upper": _table(lambda b: 65 <= b <= 90),
    "n_digits": _table(lambda b: 48 <= b <= 57),
    "n_sentence_ends": _table(lambda b: chr(b) in ".!?"),
    "n_marks": _table(lambda b: 33 <= b <= 126 and not chr(b).isalnum()),
}
_HEAD = _table(lambda b: b & 0xC0 != 0x80)
_LINE = _table(lambda b: b != 0x0A)


def _per_row(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[cuts])


def _extra_equal(hash_: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many values of a row equal an earlier one of the row."""
    order = np.lexsort((hash_, row))
    h, r = hash_[order], row[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[again], minlength=rows)


def _piece(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    rows = len(offsets) - 1
    data, cuts = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    words = Words(flat, offsets, NOT_SPACE, SAME)
    stats = {"n_words": np.diff(words.first)}
    inside = NOT_SPACE[data]
    stats["word_chars"] = _per_row(inside & _HEAD[data], cuts)
    for name, table in _CLASSES.items():
        stats[name] = _per_row(table[data], cuts)

    lines = Words(flat, offsets, _LINE, SAME)
    filled = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(inside, out=filled[1:])
    has_word = filled[lines.end] > filled[lines.start]
    stats["n_lines"] = np.bincount(lines.row[has_word], minlength=rows)
    stats["n_dup_lines"] = _extra_equal(lines.hash[has_word], lines.row[has_word], rows)
    stats["n_distinct_words"] = stats["n_words"] - _extra_equal(words.hash, words.row, rows)

    h, r, at = shingles(words, 3)
    order = np.lexsort((h, r))
    same = (h[order][1:] == h[order][:-1]) & (r[order][1:] == r[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.hash) + 3, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 3, -1)
    covered = np.cumsum(cover)[: len(words.hash)] > 0
    stats["n_repeat_words"] = np.bincount(words.row[covered], minlength=rows)

    longest = np.zeros(rows, dtype=np.int64)
    full = np.flatnonzero(stats["n_words"])
    if len(full):
        longest[full] = np.maximum.reduceat(words.end - words.start, words.first[:-1][full])
    stats["max_word_bytes"] = longest
    return [stats[n] for n in STATS]


def document_stats(column: pa.Array) -> list[tuple[str, pa.Array]]:
    flat, offsets = text_buffer(column)
    parts = [_piece(flat, offsets[a : b + 1]) for a, b in pieces(offsets)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * len(STATS)
    return [(n, pa.array(c.astype(np.int64))) for n, c in zip(STATS, columns, strict=True)]


def with_stats(docs: DataFrame, name: str = "_stats") -> DataFrame:
    """docs with a struct of statistics of its text."""
    return append_struct(docs, name, FIELDS, document_stats)


def base_failed(stats: str = "_stats") -> Column:
    """The base rule: under 50 words, or over half of them in repeated windows."""
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


#: Measures that conditions are about: numerator over denominator (both statistics).
MEASURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "same_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "variety": ("n_distinct_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "sentences": ("n_sentence_ends", "n_words"),
    "marks": ("n_marks", "word_chars"),
    "longest": ("max_word_bytes", None),
}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.measure]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, stats: str) -> Column:
        x = measure_column(self.measure, stats)
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


def measure_column(name: str, stats: str) -> Column:
    top, bottom = MEASURES[name]
    x = F.col(stats)[top].cast("double")
    return x if bottom is None else x / F.greatest(F.col(stats)[bottom], F.lit(1)).cast("double")


def measure_table(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {n: rows[a].astype(float) if b is None else rows[a].astype(float) / np.maximum(rows[b], 1) for n, (a, b) in MEASURES.items()}


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(table.values())))
    return reduce(np.logical_and, (c.holds(table) for c in rule), np.ones(n, dtype=bool))


def _grow(table, bad: np.ndarray, grid, longest: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if n == 0 or p == 0:
            break
        best, gain = None, 1e-9
        before = np.log2(p / (p + n))
        for condition in grid:
            now = inside & condition.holds(table)
            q = (now & bad).sum()
            if q == 0:
                continue
            won = q * (np.log2(q / now.sum()) - before)
            if won > gain:
                best, gain = condition, won
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(table)
    return rule


def _settle(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Thresholds moved to the middle of the gap that they lie in, away from kept rows."""
    out = []
    for i, c in enumerate(rule):
        rest = _covers(rule[:i] + rule[i + 1 :], table)
        x = table[c.measure]
        if c.above:
            inner = x[rest & bad & (x > c.threshold)]
            outer = x[rest & ~bad & (x <= c.threshold)]
            at = (inner.min() + (outer.max() if len(outer) else c.threshold)) / 2 if len(inner) else c.threshold
            at = max(at, c.threshold)
        else:
            inner = x[rest & bad & (x <= c.threshold)]
            outer = x[rest & ~bad & (x > c.threshold)]
            at = (inner.max() + (outer.min() if len(outer) else c.threshold)) / 2 if len(inner) else c.threshold
            at = min(at, c.threshold)
        out.append(Condition(c.measure, c.above, float(at)))
    return tuple(out)


def learn_rules(
    rows: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, least: int = 4, longest: int = 4, most: int = 16, cuts: int = 24
) -> list[Rule]:
    """Rules for rows where ``bad``; a rule must hold ``precision`` on the pruning
    rows (with one error added) and cover ``least`` bad ones there and in growing."""
    table = measure_table(rows)
    grid = []
    for name, x in table.items():
        for t in np.unique(np.quantile(x, np.linspace(0.01, 0.99, cuts))) if len(x) else []:
            grid += [Condition(name, True, float(t)), Condition(name, False, float(t))]
    held = np.arange(len(bad)) % 3 == 2  # for pruning; rows arrive in hash order
    left = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < most and (bad & left & ~held).sum() >= least:
        grown = left & ~held
        rule = _grow({k: v[grown] for k, v in table.items()}, bad[grown], grid, longest)
        if not rule:
            break

        def worth(r: Rule) -> float:
            got = _covers(r, table) & left & held
            p, n = (got & bad).sum(), (got & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got = _covers(rule, table) & left
        p, n = (got & bad & held).sum(), (got & ~bad & held).sum()
        q = (got & bad & ~held).sum()
        if p < least / 2 or q < least or p / (p + n) < precision or q / (got & ~held).sum() < precision:
            break
        rules.append(_settle(rule, {k: v[left] for k, v in table.items()}, bad[left]))
        left &= ~got
    return rules


def rejected(rules: list[Rule], stats: str = "_stats") -> Column:
    """The list as one ordered CASE: the first rule that holds rejects."""
    out = None
    for rule in rules:
        test = reduce(Column.__and__, (c.column(stats) for c in rule))
        out = F.when(test, F.lit(True)) if out is None else out.when(test, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, **options) -> list[Rule]:
    """Learn from at most ``bound`` labelled rows; documents outside them are not computed."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_bad"), F.xxhash64("doc_id").alias("_place"))
        .orderBy("_place", "_id", "_bad")
        .limit(bound)
    )
    wanted = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    got = with_stats(wanted).select("_place", "_id", "_bad", "_stats.*").orderBy("_place", "_id", "_bad", *STATS).limit(2 * bound).collect()
    if not got:
        return []
    rows = {n: np.array([r[n] for r in got], dtype=np.int64) for n in STATS}
    bad = np.array([r["_bad"] for r in got], dtype=bool)
    passed = ~((rows["n_words"] < 50) | (100 * rows["n_repeat_words"] > 50 * rows["n_words"]))
    return learn_rules({k: v[passed] for k, v in rows.items()}, bad[passed], **options)


def verdicts(docs: DataFrame, rules: list[Rule], stats: str = "_stats") -> DataFrame:
    """docs with the statistics struct, and whether the base rule fails and the document is kept."""
    fresh = with_stats(docs, stats)
    failed = base_failed(stats)
    return fresh.withColumns({f"{stats}_failed": failed, f"{stats}_kept": ~failed & ~rejected(rules, stats)})


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """The rows of docs that neither the base rule nor the list rejects."""
    name = "_stats"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    out = verdicts(docs, train(docs, labels, bound), name)
    return out.where(F.col(f"{name}_kept")).select(*[f"`{c}`" for c in docs.columns])
