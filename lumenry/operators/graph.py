"""Symbols and edges as a graph: resolution, neighbours, reachability, rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage

DAMPING, ROUNDS = 0.85, 20
#: Nodes and links that one task may solve; larger graphs are solved by joins.
SMALL_NODES, SMALL_LINKS = 100_000, 1_000_000


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with dst_symbol_id: the one symbol of that name in the file, else the
    one of that name anywhere, else null."""
    in_file = symbols.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("local_id")).where("n = 1").select(F.col("file_id").alias("_f"), F.col("name").alias("_n"), "local_id")
    anywhere = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("global_id")).where("n = 1").select(F.col("name").alias("_g"), "global_id")
    out = edges.join(in_file, (F.col("file_id") == F.col("_f")) & (F.col("dst_name") == F.col("_n")), "left")
    out = out.join(anywhere, F.col("dst_name") == F.col("_g"), "left")
    return out.withColumn("dst_symbol_id", F.coalesce("local_id", "global_id")).drop("_f", "_n", "_g", "local_id", "global_id")


def source_ids(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges with src_symbol_id by name in the file; of equal names the last."""
    last = symbols.groupBy("file_id", "name").agg(F.max("symbol_id").alias("src_symbol_id")).select(F.col("file_id").alias("_f"), F.col("name").alias("_n"), "src_symbol_id")
    return edges.drop("src_symbol_id").join(last, (F.col("file_id") == F.col("_f")) & (F.col("src_name") == F.col("_n")), "left").drop("_f", "_n")


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["file_id", "line", "src_name", "dst_name", "kind"])


#: A name found twice at a place keeps the kind of the highest priority.
PRIORITY = {"method": 5, "class": 4, "function": 3, "type": 2, "variable": 1}


def dedup_symbols(symbols: DataFrame) -> DataFrame:
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("kind")), F.lit(0))
    w = Window.partitionBy("file_id", "start", "name").orderBy(rank.desc(), "symbol_id")
    return symbols.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def definitions(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.where((F.col("name") == query) | (F.col("qualname") == query))


def callers(edges: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Edges into the symbols named in ``names`` (query, symbol_id, name): by resolved id or by
    name, once each.  Many symbols are asked at once."""
    e = edges.select("edge_id", "src_symbol_id", "dst_name", "dst_symbol_id", "kind", "file_id", "line", "source", "confidence")
    by_id = e.join(names.select("query", F.col("symbol_id").alias("_id")), F.col("dst_symbol_id") == F.col("_id")).drop("_id")
    by_name = e.join(names.select("query", F.col("name").alias("_name")).distinct(), F.col("dst_name") == F.col("_name")).drop("_name")
    hits = by_id.unionByName(by_name).dropDuplicates(["query", "edge_id"])
    s = symbols.select(F.col("symbol_id").alias("_s"), F.col("name").alias("src_name"), "start", "end")
    out = hits.join(s, F.col("src_symbol_id") == F.col("_s"), "left").drop("_s")
    return out.select(
        "query", "edge_id", "file_id", "line", F.coalesce("start", "line").alias("start"), F.coalesce("end", "line").alias("end"), F.coalesce("src_name", "dst_name").alias("symbol"),
        F.when(F.col("kind") == "call", "call").otherwise("ref").alias("kind"), F.when(F.col("source") == "lsp", F.col("confidence")).otherwise(0.9).alias("score"),
    )


def callees(edges: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Resolved targets of the symbols' edges, of any kind."""
    out = edges.join(names.select("query", F.col("symbol_id").alias("_id")), F.col("src_symbol_id") == F.col("_id"))
    s = symbols.select(F.col("symbol_id").alias("_s"), "name", F.col("file_id").alias("def_file"), "start", "end")
    return out.join(s, F.col("dst_symbol_id") == F.col("_s")).select("query", F.col("_s").alias("symbol_id"), "name", "def_file", "start", "end", F.lit("call").alias("kind")).distinct()


def reach(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hop) reached from start (node) along links (src, dst) in at most depth steps.

    One join a hop against what is not visited yet; lineage is cut each hop.
    """
    seen = cut_lineage(start.select("node", F.lit(0).alias("hop")).distinct(), "reach")
    frontier = seen
    for hop in range(1, depth + 1):
        step = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        fresh = cut_lineage(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")), "reach")
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def _solve(rounds: int, damping: float):
    def run(key, table):
        is_link = np.array(table.column("link"), dtype=bool)
        a, b = (np.array(table.column(c), dtype=np.int64) for c in ("a", "b"))
        nodes = np.sort(a[~is_link])
        src, dst = (np.searchsorted(nodes, x[is_link]) for x in (a, b))
        n = len(nodes)
        out = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            given = np.bincount(dst, rank[src] / out[src], minlength=n)
            rank = (1 - damping) / n + damping * (given + rank[out == 0].sum() / n)
        return pa.table({"node": pa.array(nodes), "rank": pa.array(rank)})

    return run


def pagerank(nodes: DataFrame, links: DataFrame, *, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(node, rank) after a fixed number of rounds from a uniform start; the rank of
    nodes without links out is spread over all.  Nodes are numbers, each once, and
    links join them.

    A graph within SMALL_NODES and SMALL_LINKS, which is checked, is solved in one
    task; a larger one by a join and an aggregate a round, written and read back
    every few rounds.
    """
    links = cut_lineage(links.select("src", "dst"), "links")
    n = nodes.count()
    if n <= SMALL_NODES and links.count() <= SMALL_LINKS:
        flat = nodes.select(F.lit(False).alias("link"), F.col("node").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        flat = flat.unionByName(links.select(F.lit(True).alias("link"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")))
        kind = nodes.schema["node"].dataType
        return flat.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_solve(rounds, damping), "node long, rank double").select(F.col("node").cast(kind).alias("node"), "rank")
    return pagerank_by_joins(nodes, links, n, rounds=rounds, damping=damping)


def pagerank_by_joins(nodes: DataFrame, links: DataFrame, n: int, *, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """The same for a graph of any size; n is the number of nodes."""
    degree = links.groupBy("src").agg(F.count("*").alias("out"))
    weighted = cut_lineage(links.join(degree, "src").select("src", "dst", "out"), "pagerank")
    base = nodes.join(degree, nodes.node == degree.src, "left").select("node", F.col("src").isNull().alias("dangling"))
    rank = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        given = weighted.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = rank.select("node", "dangling").join(given, F.col("node") == F.col("dst"), "left").join(F.broadcast(lost))  # one row
        rank = new.select("node", "dangling", ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if i % 4 == 3:
            rank = cut_lineage(rank, "pagerank")
    return rank.select("node", "rank")


def hubs(nodes: DataFrame, links: DataFrame, top: int = 10) -> DataFrame:
    """The highest ranks among nodes that are linked to or rank above the mean."""
    n = nodes.count()
    indegree = links.where("src <> dst").distinct().groupBy("dst").agg(F.count("*").alias("indegree"))
    ranked = pagerank(nodes, links).join(indegree, F.col("node") == F.col("dst"), "left").select("node", "rank", F.coalesce("indegree", F.lit(0)).cast("long").alias("indegree"))
    some = ranked.where((F.col("indegree") > 0) | (F.col("rank") > 1.0 / max(n, 1)))
    return some.orderBy(F.col("rank").desc(), "node").limit(top).select("node", F.round("rank", 5).alias("rank"), "indegree")


# ---- references from outside (a language server, an index) -------------------------------


def pick_for_enrichment(symbols: DataFrame, limit: int) -> DataFrame:
    """Symbols to ask references for: no variables; tests last, functions before methods, path, line."""
    order = ["is_test", (F.col("kind") == "method"), "path", "start"]
    return symbols.where("kind <> 'variable'").orderBy(*order).limit(limit)


def store_references(edges: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """edges with the outside references of some files replaced by refs (src_symbol_id, dst_name,
    dst_symbol_id, file_id, line): once each, kind ref, full confidence."""
    gone = files.select("file_id").distinct()
    keep = edges.where("source <> 'lsp'").unionByName(edges.where("source = 'lsp'").join(gone, "file_id", "left_anti"))
    new = refs.dropDuplicates(["src_symbol_id", "dst_name", "file_id", "line"])
    new = new.withColumns({"kind": F.lit("ref"), "source": F.lit("lsp"), "confidence": F.lit(1.0)})
    return keep.unionByName(new, allowMissingColumns=True)


def with_homonyms(hits: DataFrame, definitions_of: DataFrame) -> DataFrame:
    """hits (query, ...) with the definitions of queries that have more than one put first."""
    many = definitions_of.groupBy("query").agg(F.count("*").alias("_n")).where("_n > 1").select("query")
    first = definitions_of.join(many, "query", "left_semi").withColumn("stage", F.lit(0))
    return first.unionByName(hits.withColumn("stage", F.lit(1)), allowMissingColumns=True)


def file_ranks(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Position of each file by its best hit: kind priority, score, path."""
    by = by or []
    best = hits.groupBy(*by, "path").agg(F.min(F.struct("prio", (-F.round(F.col("score") * 1e6)).alias("neg"), "path")).alias("best"))
    w = Window.partitionBy(*by).orderBy("best")
    return best.withColumn("place", F.row_number().over(w)).select(*by, "path", "place")
