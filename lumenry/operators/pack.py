"""Evidence packs: definitions and relations of several symbols, in one budget."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import budget, graph

TRIED, MATCHED = 24, 6
KIND_ORDER = {"def": 0, "call": 1, "ref": 1, "test": 2, "doc": 3, "config": 3}


def identifiers(query: str) -> list[str]:
    """Distinct identifiers of a query, the first 24."""
    return list(dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", query)))[:TRIED]


def matched(symbols: DataFrame, query: str) -> DataFrame:
    """(query, symbol_id, name) of the first six identifiers that name a symbol."""
    names = identifiers(query)
    if not names:
        return symbols.where(F.lit(False)).select(F.col("name").alias("query"), "symbol_id", "name")
    hits = [graph.definitions(symbols, n).select(F.lit(i).alias("i"), F.lit(n).alias("query"), "symbol_id", "name") for i, n in enumerate(names)]
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    rank = every.withColumn("_r", F.dense_rank().over(Window.orderBy("i")))  # over the symbols that a query names
    return rank.where(F.col("_r") <= MATCHED).select("query", "symbol_id", "name")


def pack(files: DataFrame, symbols: DataFrame, edges: DataFrame, query: str, *, limit_tokens: int = 2000, intent: str = "explore") -> DataFrame:
    """Definitions, callers and callees of the named symbols, once each, by file and
    kind, while they fit.  Bodies stay for the intent ``edit`` only."""
    names = matched(symbols, query)
    f = files.select("file_id", "path", "is_test")
    body = F.col("snippet") if intent == "edit" else F.col("sig")
    own = names.select("query", "symbol_id").join(symbols.drop("path"), "symbol_id").join(f, "file_id")
    hits = own.select("path", "start", "end", F.col("name").alias("symbol"), F.lit("def").alias("kind"), "sig", body.alias("snippet"), F.lit(1.0).alias("score"), F.lit("definition").alias("why"), "is_test")
    calls = graph.callers(edges, symbols, names).join(f, "file_id")
    hits = hits.unionByName(calls.select("path", "start", "end", "symbol", F.when(F.col("is_test"), "test").otherwise(F.col("kind")).alias("kind"), F.lit("").alias("sig"), F.lit("").alias("snippet"), "score", F.lit("caller").alias("why"), "is_test"))
    down = graph.callees(edges, symbols, names).join(f.withColumnRenamed("file_id", "def_file"), "def_file")
    hits = hits.unionByName(down.select("path", "start", "end", F.col("name").alias("symbol"), "kind", F.lit("").alias("sig"), F.lit("").alias("snippet"), F.lit(0.9).alias("score"), F.lit("callee").alias("why"), "is_test"))
    kinds = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])
    hits = hits.withColumn("prio", F.coalesce(F.element_at(kinds, F.col("kind")), F.lit(4)))
    best = hits.groupBy("path").agg(F.min(F.struct("prio", (-F.round(F.col("score") * 1e6)).alias("neg"), F.col("path").alias("p"))).alias("place"))
    once = Window.partitionBy("path", "start", "end", "kind", "symbol").orderBy("prio", F.col("score").desc(), "why")
    placed = hits.join(best, "path").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    priced = placed.withColumn("snippet_truncated", F.lit(False)).withColumn("cost", budget.cost())
    return budget.prefix(priced, ["place", "prio", F.col("score").desc(), "start", "end"], limit_tokens)


def expand(files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines of one file."""
    rows = T.lines(F.col("content"))
    return files.where(F.col("path") == path).select("path", F.lit(start).alias("start"), F.least(F.lit(end), F.size(rows)).alias("end"), T.line_slice(rows, F.lit(start), F.lit(end)).alias("snippet"))


def expand_hints(hits: DataFrame, omitted: DataFrame) -> DataFrame:
    """One row: commands that show what was cut or left out."""
    command = F.concat(F.lit("expand "), "path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    every = hits.where("snippet_truncated").select("path", "start", "end").unionByName(omitted.select("path", "start", "end"))
    return every.orderBy("path", "start").limit(100).agg(F.array_join(F.array_sort(F.collect_list(command)), "; ").alias("hint"))
