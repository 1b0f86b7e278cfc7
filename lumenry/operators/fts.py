"""Full-text retrieval: tokens, postings, BM25, and the ranked union of stages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Letters with a mark, folded to the letter, as the default tokeniser does.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column, ascii_only: bool = False) -> Column:
    """Lower-cased, unaccented runs of letters and digits."""
    if ascii_only:
        return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.regexp_extract_all(F.translate(F.lower(text), _MARKED, _PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Terms of a query; any may match.  A term with an underscore is a phrase."""
    return re.findall(r"\w+", query)


def phrase_of(term: str) -> list[str]:
    return [p.lower() for p in re.split(r"_+", term) if p]


def postings(files: DataFrame, fields: dict[str, Column], ascii_only: bool = False) -> DataFrame:
    """(field, term, doc_id, tf, positions): the inverted index of some fields."""
    one = [files.select(F.lit(name).alias("field"), F.col("file_id").alias("doc_id"), F.posexplode(tokens(c, ascii_only)).alias("pos", "term")) for name, c in fields.items()]
    every = one[0]
    for more in one[1:]:
        every = every.unionByName(more)
    return every.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def update_postings(old: DataFrame, changed: DataFrame, removed: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Postings after some files changed or went: only those are tokenised."""
    gone = changed.select(F.col("file_id").alias("doc_id")).unionByName(removed.select(F.col("file_id").alias("doc_id"))).distinct()
    return old.join(gone, "doc_id", "left_anti").unionByName(postings(changed, fields))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("cf"))


def _folded(text: Column, ascii_only: bool) -> tuple[Column, str]:
    """The text as the tokeniser reads it, and the class of a token's characters."""
    return (F.lower(text), "a-z0-9") if ascii_only else (F.translate(F.lower(text), _MARKED, _PLAIN), r"\p{L}\p{N}")


def count_tokens(text: Column, ascii_only: bool = False) -> Column:
    read, inside = _folded(text, ascii_only)
    return F.coalesce(F.regexp_count(read, F.lit(f"[{inside}]+")), F.lit(0))


def occurrences(text: Column, phrase: list[str], ascii_only: bool = False) -> Column:
    """How often a phrase stands in a text: its first word where the others follow, so
    that the next occurrence may begin inside this one.  No array of tokens is made."""
    read, inside = _folded(text, ascii_only)
    plain = (lambda w: w) if ascii_only else (lambda w: w.translate(str.maketrans(_MARKED, _PLAIN)))
    first, *rest = [re.escape(plain(w)) for w in phrase]
    follow = "".join(f"[^{inside}]+{w}" for w in rest)
    pattern = f"(?<![{inside}]){first}(?={follow}(?![{inside}]))"
    return F.when(F.contains(read, F.lit(plain(phrase[0]))), F.regexp_count(read, F.lit(pattern))).otherwise(0)


def bm25(files: DataFrame, fields: dict[str, tuple[Column, float]], query: str, *, ascii_only: bool = False) -> DataFrame:
    """Rows of files that hold a term, with ``rank``, negative as in SQLite: less is better.

    Every phrase's weighted count, and the length over all fields, are taken in
    one narrow pass; the corpus figures are one row, joined to the rows that are left.
    """
    phrases = [p for p in (phrase_of(t) for t in query_terms(query)) if p]
    if not phrases:
        return files.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    names = list(fields)
    counted = files.withColumn("_len", sum((count_tokens(fields[n][0], ascii_only) for n in names), F.lit(0)))
    for i, p in enumerate(phrases):
        counted = counted.withColumn(f"_f{i}", sum((F.lit(fields[n][1]) * F.coalesce(occurrences(fields[n][0], p, ascii_only), F.lit(0)) for n in names), F.lit(0.0)))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(phrases))])
    some = counted.where(" or ".join(f"_f{i} > 0" for i in range(len(phrases))))
    joined = some.join(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        f = F.col(f"_f{i}")
        total = total + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return joined.withColumn("rank", -total).drop("_n", "_avg", "_len", *[f"_{x}{i}" for x in "fd" for i in range(len(phrases))])


def symbol_score(rank: Column) -> Column:
    return 0.85 - 0.75 / (1 + F.abs(rank))


def excerpt_score(rank: Column) -> Column:
    return 0.55 - 0.47 / (1 + F.abs(rank))


def exact_score(test: Column, vendor: Column) -> Column:
    return 1.0 - 0.12 * test.cast("int") - 0.25 * vendor.cast("int")


CONTENT_SCORE = 0.55


def ranked(stages: list[DataFrame], key: list[str], limit: int) -> DataFrame:
    """The union of stages: earlier stages first, then score, tests and vendored
    files last, path, line; the first row of a key stays; ``limit`` rows.

    Stage DataFrames have path, start, score, is_test, is_vendor and the key.
    Later stages only append, so ranking all at once equals running them in turn.
    """
    every = None
    for n, s in enumerate(stages):
        s = s.withColumn("stage", F.lit(n))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    order = ["stage", F.col("score").desc(), "is_test", "is_vendor", "path", "start"]
    w = Window.partitionBy(*key).orderBy(*order)
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(*order).limit(limit)
