"""Exact search: matching lines with context, merged into spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dialect
from ..functions import text as T

CONTEXT = 2


def matching_lines(files: DataFrame, test, whole: Column | None = None) -> DataFrame:
    """(file_id, path, lines, line) of each matching line.  ``whole`` is a test of the
    whole content that must hold where any line matches; it keeps other files
    from being cut into lines."""
    some = files if whole is None else files.where(whole)
    cut = some.select("file_id", "path", T.lines(F.col("content")).alias("lines"))
    hits = F.filter(F.transform("lines", lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())
    return cut.withColumn("at", hits).where(F.size("at") > 0)


def merge_spans(found: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Spans of files with matches: context lines on both sides, clamped, and merged
    where one begins no later than a line after the one before ends.

    A file's matches are already together in one array, so the islands are built
    by one fold and need no shuffle.
    """
    n = F.size("lines")
    span = lambda i: F.struct(F.greatest(i - context, F.lit(1)).alias("start"), F.least(i + context, n).alias("end"), F.lit(1).alias("matches"))
    empty = F.array().cast("array<struct<start:int,end:int,matches:int>>")
    zero = F.struct(empty.alias("done"), F.lit(None).cast("struct<start:int,end:int,matches:int>").alias("open"))

    def step(acc, s):
        o = acc["open"]
        joined = F.struct(o["start"].alias("start"), F.greatest(o["end"], s["end"]).alias("end"), (o["matches"] + 1).alias("matches"))
        closed = F.when(o.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(o)))
        return F.when(o.isNotNull() & (s["start"] <= o["end"] + 1), F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(
            F.struct(closed.alias("done"), s.alias("open"))
        )

    spans = F.aggregate(F.transform("at", span), zero, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    out = found.select("file_id", "path", "lines", F.explode(spans).alias("s"))
    return out.select("file_id", "path", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.matches").alias("matches"), T.line_slice(F.col("lines"), F.col("s.start"), F.col("s.end")).alias("snippet"))


def literal_search(files: DataFrame, query: str, *, ignore_case: bool = False, path: str | None = None) -> DataFrame:
    """Spans of lines that hold the query."""
    files = files if path is None else files.where(F.contains("path", F.lit(path)))
    return merge_spans(matching_lines(files, lambda x: dialect.literal(x, query, ignore_case), dialect.literal(F.col("content"), query, ignore_case)))


def regex_search(files: DataFrame, pattern: str, *, ignore_case: bool = False, path: str | None = None) -> DataFrame:
    """Spans of lines that the pattern matches; it must be one that stays in a line."""
    files = files if path is None else files.where(F.contains("path", F.lit(path)))
    jvm = dialect.to_jvm(pattern, ignore_case)
    anchored = any(c in pattern for c in "^$") or "\\b" in pattern
    return merge_spans(matching_lines(files, lambda x: x.rlike(jvm), None if anchored else F.col("content").rlike(jvm)))


def limit_spans(spans: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` spans in path order, and one row (total, omitted, coverage)."""
    kept = spans.orderBy("path", "start").limit(limit)
    total = spans.agg(F.count("*").alias("total"))
    summary = total.select("total", F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"), F.when(F.col("total") > limit, "partial").otherwise("complete").alias("coverage"))
    return kept, summary


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The smallest span around each point: points (file_id, line), spans (file_id, name, start, end).

    Candidates are pre-cut to the file by the equi-join; the smallest is kept by
    one aggregate of a struct, which combines on the map side.
    """
    s = spans.select(F.col("file_id").alias("_file"), "name", "start", "end")
    hit = points.join(s, (F.col("file_id") == F.col("_file")) & (F.col("start") <= F.col("line")) & (F.col("end") >= F.col("line")))
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("width"), (-F.col("start")).alias("back"), "name", "start", "end")).alias("best")
    return hit.groupBy("file_id", "line").agg(best).select("file_id", "line", "best.name", "best.start", "best.end")


def outside(text_hits: DataFrame, hits: DataFrame) -> DataFrame:
    """Text hits (path, line) that no hit (path, start, end) covers."""
    h = hits.select(F.col("path").alias("_path"), "start", "end")
    return text_hits.join(h, (F.col("path") == F.col("_path")) & F.col("line").between(F.col("start"), F.col("end")), "left_anti")


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
