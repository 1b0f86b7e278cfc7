"""Graph, map and maintenance queries over the relational tables and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, repomap
from ..sources import corpus
from ..sources import generation as gen
from .registry import query

#: Symbols are suppliers named by nation and balance class; edges are line items, each
#: naming the supplier it uses; an order is a file.
SYMBOLS = "sy AS (SELECT s_suppkey AS symbol_id, s_nationkey::BIGINT AS file_id, 'n' || (s_suppkey % 97) AS name, s_suppkey AS st FROM supplier)"
EDGES = (
    "ed AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS edge_id, l_orderkey, l_suppkey, l_linenumber, "
    "(l_partkey % 25) AS file_id, 'n' || (l_suppkey % 97) AS dst_name, 'n' || (l_partkey % 97) AS src_name FROM lineitem)"
)
RESOLVED = (
    "lo AS (SELECT file_id AS f, name AS n, min(symbol_id) AS id FROM sy GROUP BY 1, 2 HAVING count(*) = 1), "
    "gl AS (SELECT name AS n, min(symbol_id) AS id FROM sy GROUP BY 1 HAVING count(*) = 1), "
    "so AS (SELECT file_id AS f, name AS n, max(symbol_id) AS id FROM sy GROUP BY 1, 2), "
    "re AS (SELECT e.*, coalesce(lo.id, gl.id) AS dst_symbol_id, so.id AS src_symbol_id FROM ed e LEFT JOIN lo ON lo.f = e.file_id AND lo.n = e.dst_name LEFT JOIN gl ON gl.n = e.dst_name LEFT JOIN so ON so.f = e.file_id AND so.n = e.src_name)"
)


def _symbols(spark, sf):
    s = corpus.table(spark, sf, "supplier")
    name = F.concat(F.lit("n"), (F.col("s_suppkey") % 97).cast("string"))
    return s.select(
        F.col("s_suppkey").alias("symbol_id"), F.col("s_nationkey").cast("long").alias("file_id"), name.alias("name"), name.alias("qualname"), F.lit("function").alias("kind"),
        F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 3).alias("end"),
    )


def _edges(spark, sf):
    e = corpus.table(spark, sf, "lineitem")
    n = lambda c: F.concat(F.lit("n"), (F.col(c) % 97).cast("string"))
    return e.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"),
        (F.col("l_partkey") % 25).alias("file_id"), n("l_suppkey").alias("dst_name"), n("l_partkey").alias("src_name"), F.lit("call").alias("kind"),
        F.col("l_linenumber").alias("line"), F.lit("parser").alias("source"), F.lit(0.65).alias("confidence"),
    )


def _resolved(spark, sf):
    s = _symbols(spark, sf)
    return graph.resolve(graph.source_ids(_edges(spark, sf), s), s)


@query(f"WITH {SYMBOLS}, {EDGES}, {RESOLVED} SELECT l_orderkey, l_linenumber, l_suppkey, dst_name, dst_symbol_id, src_symbol_id FROM re")
def edge_resolve_unique(spark, sf):
    return _resolved(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", "dst_name", "dst_symbol_id", "src_symbol_id")


@query("SELECT DISTINCT l_partkey % 25 AS file_id, l_linenumber AS line, 'n' || (l_partkey % 97) AS src_name, 'n' || (l_suppkey % 97) AS dst_name FROM lineitem")
def edge_dedup(spark, sf):
    return graph.dedup_edges(_edges(spark, sf)).select("file_id", "line", "src_name", "dst_name")


@query(f"WITH {SYMBOLS} SELECT symbol_id, file_id, name FROM sy WHERE name = 'n5'")
def graph_def(spark, sf):
    return graph.definitions(_symbols(spark, sf), "n5").select("symbol_id", "file_id", "name")


def _names(spark, sf, names):
    s = _symbols(spark, sf)
    return s.where(F.col("name").isin(*names)).select(F.col("name").alias("query"), "symbol_id", "name")


@query(
    f"WITH {SYMBOLS}, {EDGES}, {RESOLVED}, q AS (SELECT name AS query, symbol_id, name FROM sy WHERE name IN ('n5', 'n7', 'n96')), "
    "h AS (SELECT DISTINCT query, edge_id FROM (SELECT q.query, re.edge_id FROM re JOIN q ON re.dst_symbol_id = q.symbol_id UNION SELECT q.query, re.edge_id FROM re JOIN q ON re.dst_name = q.name)) "
    "SELECT h.query, re.file_id, re.l_linenumber AS line, coalesce(sy.st, re.l_linenumber) AS st, coalesce(sy.name, re.dst_name) AS symbol, count(*) AS uses FROM h JOIN re ON re.edge_id = h.edge_id LEFT JOIN sy ON sy.symbol_id = re.src_symbol_id GROUP BY ALL"
)
def graph_callers(spark, sf):
    out = graph.callers(_resolved(spark, sf), _symbols(spark, sf), _names(spark, sf, ["n5", "n7", "n96"]))
    return out.groupBy("query", "file_id", F.col("line").cast("int").alias("line"), F.col("start").alias("st"), "symbol").agg(F.count("*").alias("uses"))


@query(
    f"WITH {SYMBOLS}, {EDGES}, {RESOLVED} SELECT DISTINCT q.name AS query, d.symbol_id, d.name, d.file_id AS def_file FROM re JOIN sy q ON re.src_symbol_id = q.symbol_id AND q.name IN ('n5', 'n7', 'n96') JOIN sy d ON d.symbol_id = re.dst_symbol_id"
)
def graph_callees(spark, sf):
    out = graph.callees(_resolved(spark, sf), _symbols(spark, sf), _names(spark, sf, ["n5", "n7", "n96"]))
    return out.select("query", "symbol_id", "name", "def_file")


TRADE = "li AS (SELECT DISTINCT s.s_nationkey AS src, c.c_nationkey AS dst FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_nationkey <> c.c_nationkey)"


def _trade(spark, sf):
    """Nation to nation, from all line items."""
    t = lambda n: corpus.table(spark, sf, n)
    l = t("lineitem").select("l_orderkey", "l_suppkey")
    o, c, s = t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey"), t("supplier").select("s_suppkey", "s_nationkey")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).where("src <> dst").distinct()


@query(f"WITH RECURSIVE {TRADE}, w(node, hop) AS (SELECT 3::INTEGER, 0 UNION SELECT li.dst, w.hop + 1 FROM w JOIN li ON li.src = w.node WHERE w.hop < 2) SELECT node, min(hop) AS hop FROM w GROUP BY node")
def graph_bfs_depth(spark, sf):
    start = spark.range(1).select(F.lit(3).alias("node"))
    return graph.reach(_trade(spark, sf), start, 2)


@query(f"WITH {SYMBOLS}, {EDGES}, {RESOLVED}, fl AS (SELECT DISTINCT re.file_id AS src, sy.file_id AS dst FROM re JOIN sy ON sy.symbol_id = re.dst_symbol_id WHERE re.file_id <> sy.file_id) SELECT dst, count(*) AS indegree FROM fl GROUP BY dst")
def file_link_indegree(spark, sf):
    return repomap.indegree(repomap.file_links(_resolved(spark, sf), _symbols(spark, sf)))


RANKS = (
    f"WITH RECURSIVE {TRADE}, nn AS (SELECT n_nationkey AS node, (SELECT count(*) FROM li WHERE src = n_nationkey) AS out, (SELECT count(*) FROM nation)::DOUBLE AS n FROM nation), "
    "pr(i, node, rank) AS (SELECT 0, node, 1.0 / n FROM nn UNION ALL "
    "SELECT i + 1, m.node, 0.15 / m.n + 0.85 * (coalesce(sum(CASE WHEN li.dst IS NOT NULL THEN p.rank / o.out END), 0.0) + sum(CASE WHEN o.out = 0 THEN p.rank ELSE 0.0 END) / m.n) "
    "FROM pr p JOIN nn o ON o.node = p.node CROSS JOIN nn m LEFT JOIN li ON li.src = p.node AND li.dst = m.node WHERE i < 20 GROUP BY i, m.node, m.n) "
)


@query(RANKS + "SELECT node, round(rank, 6) AS rank FROM pr WHERE i = 20")
def pagerank_20(spark, sf):
    nodes = corpus.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.pagerank(nodes, _trade(spark, sf)).select("node", F.round("rank", 6).alias("rank"))


@query(
    RANKS + ", ind AS (SELECT dst, count(*) AS d FROM li GROUP BY dst) SELECT pr.node, round(rank, 5) AS rank, coalesce(d, 0)::BIGINT AS indegree FROM pr LEFT JOIN ind ON ind.dst = pr.node "
    "WHERE i = 20 AND (coalesce(d, 0) > 0 OR rank > 1.0 / (SELECT count(*) FROM nation)) ORDER BY pr.rank DESC, pr.node LIMIT 10"
)
def hub_topk(spark, sf):
    nodes = corpus.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.hubs(nodes, _trade(spark, sf))


@query(
    "WITH f AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents), g AS (SELECT split_part(path, '/', 1) AS name, count(*) AS files, min(path) AS first FROM f GROUP BY 1) "
    "SELECT name, files, CASE WHEN files = 1 THEN first ELSE name END AS path, first || ':1' AS evidence FROM g"
)
def package_groups(spark, sf):
    return repomap.packages(corpus.documents(spark, sf))


ENTRY = "p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '/main.py' WHEN 1 THEN 'cmd/' || source || '/x.go' WHEN 2 THEN 'src/main.rs' WHEN 3 THEN 'lib/app.ts.bak' WHEN 4 THEN 'bin/run' ELSE 'docs/index.md' END AS path FROM documents)"


@query(f"WITH {ENTRY} SELECT doc_id, path FROM p WHERE doc_id % 6 IN (0, 1, 2, 4)")
def entrypoints(spark, sf):
    d = corpus.table(spark, sf, "documents")
    m = F.col("doc_id") % 6
    path = (
        F.when(m == 0, F.concat("source", F.lit("/main.py"))).when(m == 1, F.concat(F.lit("cmd/"), "source", F.lit("/x.go"))).when(m == 2, "src/main.rs").when(m == 3, "lib/app.ts.bak").when(m == 4, "bin/run").otherwise("docs/index.md")
    )
    return d.select("doc_id", path.alias("path")).where(T.is_entrypoint(F.col("path")))


@query("SELECT 'files' AS name, count(*) AS n FROM documents UNION ALL SELECT 'symbols', count(*) FROM supplier UNION ALL SELECT 'edges', count(*) FROM lineitem")
def row_counts(spark, sf):
    return gen.row_counts({"files": corpus.documents(spark, sf), "symbols": _symbols(spark, sf), "edges": _edges(spark, sf)})


# ---- maintenance ---------------------------------------------------------------------------

#: Two states of orders as files: the later lacks every eleventh, has new ones and some that changed.
OLD = "ol AS (SELECT 'o' || o_orderkey AS path, o_custkey AS size, o_orderdate AS mtime, md5(o_orderpriority) AS content_hash FROM orders WHERE o_orderkey % 13 <> 0)"
NEW = "ne AS (SELECT 'o' || o_orderkey AS path, o_custkey + (CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS size, o_orderdate AS mtime, md5(o_orderpriority) AS content_hash FROM orders WHERE o_orderkey % 11 <> 0)"


def _states(spark, sf):
    o = corpus.table(spark, sf, "orders")
    path, digest = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.md5("o_orderpriority").alias("content_hash")
    old = o.where("o_orderkey % 13 <> 0").select(path, F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("mtime"), digest, F.col("o_orderkey").alias("file_id"))
    new = o.where("o_orderkey % 11 <> 0").select(path, (F.col("o_custkey") + F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)).alias("size"), F.col("o_orderdate").alias("mtime"), digest, F.col("o_orderkey").alias("file_id"))
    stamp = lambda df: df.withColumn("mtime", F.col("mtime").cast("timestamp"))
    return stamp(old), stamp(new)


@query(f"WITH {OLD}, {NEW} SELECT ne.path, ne.size FROM ne LEFT JOIN ol ON ol.path = ne.path WHERE ol.path IS NULL OR ol.size <> ne.size OR ol.mtime <> ne.mtime")
def snapshot_changed(spark, sf):
    return gen.changed(*_states(spark, sf)).select("path", "size")


@query(f"WITH {OLD}, {NEW} SELECT ol.path FROM ol ANTI JOIN ne ON ol.path = ne.path")
def snapshot_removed_anti(spark, sf):
    return gen.removed(*_states(spark, sf)).select("path")


@query(f"WITH {OLD}, {NEW}, ch AS (SELECT ne.*, ol.content_hash AS h FROM ne LEFT JOIN ol ON ol.path = ne.path WHERE ol.path IS NULL OR ol.size <> ne.size) SELECT CASE WHEN h = content_hash THEN 'metadata' ELSE 'content' END AS part, count(*) AS files FROM ch GROUP BY 1")
def same_digest_split(spark, sf):
    old, new = _states(spark, sf)
    meta, content = gen.same_content(old, gen.changed(old, new))
    return meta.select(F.lit("metadata").alias("part")).unionByName(content.select(F.lit("content").alias("part"))).groupBy("part").agg(F.count("*").alias("files"))


@query(f"WITH {OLD}, {NEW} SELECT coalesce(ne.path, ol.path) AS path, CASE WHEN ol.path IS NULL THEN 'added' WHEN ne.path IS NULL THEN 'removed' ELSE 'changed' END AS state FROM ne FULL JOIN ol ON ol.path = ne.path WHERE ol.path IS NULL OR ne.path IS NULL OR ne.size <> ol.size")
def stale_full_outer(spark, sf):
    old, new = _states(spark, sf)
    return gen.stale(new, old)


@query(f"WITH {OLD}, {NEW}, u AS (SELECT * FROM ne UNION ALL SELECT ol.* FROM ol ANTI JOIN ne ON ol.path = ne.path) SELECT path, size FROM u")
def upsert_latest(spark, sf):
    old, new = _states(spark, sf)
    return gen.upsert(old, new, ["path"]).select("path", "size")


@query(f"WITH {OLD}, {NEW}, u AS (SELECT * FROM ol UNION ALL SELECT ne.* FROM ne ANTI JOIN ol ON ol.path = ne.path) SELECT path, size FROM u")
def insert_ignore(spark, sf):
    old, new = _states(spark, sf)
    return gen.insert_ignore(old, new, ["path"]).select("path", "size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, sf):
    gone = corpus.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file_id"))
    lines = corpus.table(spark, sf, "lineitem").withColumn("file_id", F.col("l_orderkey"))
    return gen.delete_cascade(gone, {"lines": lines})["lines"].select("l_orderkey", "l_linenumber")


@query("SELECT o_orderstatus AS status, sha256(array_to_string(list(('o' || o_orderkey) || '|' || md5(o_orderpriority) ORDER BY 'o' || o_orderkey), chr(10))) AS digest, count(*) AS files FROM orders GROUP BY 1")
def repo_state_digest(spark, sf):
    o = corpus.table(spark, sf, "orders")
    f = o.select(F.col("o_orderstatus").alias("status"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.md5("o_orderpriority").alias("content_hash"))
    return gen.state_digest(f, ["status"])


# ---- outside references, homonyms, file ranks --------------------------------------------


@query("SELECT s_suppkey AS symbol_id FROM supplier WHERE s_suppkey % 5 <> 0 ORDER BY s_suppkey % 3 = 0, s_suppkey % 2 = 0, 'f' || s_nationkey, s_suppkey LIMIT 20")
def lsp_symbol_selection(spark, sf):
    s = corpus.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("symbol_id"), (F.col("s_suppkey") % 3 == 0).alias("is_test"), F.col("s_suppkey").alias("start"), F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("path"),
        F.when(F.col("s_suppkey") % 5 == 0, "variable").when(F.col("s_suppkey") % 2 == 0, "method").otherwise("function").alias("kind"),
    )
    return graph.pick_for_enrichment(s, 20).select("symbol_id")


@query(
    "WITH e AS (SELECT l_orderkey AS file_id, l_linenumber AS line, l_suppkey AS dst, CASE WHEN l_partkey % 2 = 0 THEN 'lsp' ELSE 'parser' END AS source FROM lineitem) "
    "SELECT file_id, source, count(*) AS n FROM (SELECT * FROM e WHERE source <> 'lsp' OR file_id % 3 <> 0 UNION ALL SELECT DISTINCT file_id, line, dst, 'lsp' FROM e WHERE file_id % 3 = 0 AND source = 'parser') GROUP BY 1, 2"
)
def lsp_reference_store(spark, sf):
    e = corpus.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("dst_symbol_id"), F.col("l_suppkey").cast("string").alias("dst_name"),
        F.lit(1).alias("src_symbol_id"), F.when(F.col("l_partkey") % 2 == 0, "lsp").otherwise("parser").alias("source"), F.lit("call").alias("kind"), F.lit(0.65).alias("confidence"),
    )
    files = e.where("file_id % 3 = 0").select("file_id").distinct()
    refs = e.where("file_id % 3 = 0 and source = 'parser'").drop("source", "kind", "confidence")
    return graph.store_references(e, refs, files).groupBy("file_id", "source").agg(F.count("*").alias("n"))


@query(
    f"WITH {SYMBOLS}, d AS (SELECT name AS query, symbol_id FROM sy), h AS (SELECT name AS query, max(symbol_id) AS symbol_id FROM sy GROUP BY name) "
    "SELECT query, symbol_id, 0 AS stage FROM d WHERE query IN (SELECT query FROM d GROUP BY query HAVING count(*) > 1) UNION ALL SELECT query, symbol_id, 1 FROM h"
)
def homonym_definitions(spark, sf):
    s = _symbols(spark, sf).select(F.col("name").alias("query"), "symbol_id")
    hits = s.groupBy("query").agg(F.max("symbol_id").alias("symbol_id"))
    return graph.with_homonyms(hits, s)


@query(
    "WITH h AS (SELECT l_shipdate::DATE::VARCHAR AS q, 'p' || (l_partkey % 50) AS path, l_linenumber % 4 AS prio, l_discount AS score FROM lineitem), "
    "b AS (SELECT q, path, min(ROW(prio, -round(score * 1e6), path)) AS best FROM h GROUP BY 1, 2) SELECT q, path, CAST(row_number() OVER (PARTITION BY q ORDER BY best) AS INT) AS place FROM b"
)
def file_best_rank(spark, sf):
    h = corpus.table(spark, sf, "lineitem")
    h = h.select(F.col("l_shipdate").cast("date").cast("string").alias("q"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("path"), (F.col("l_linenumber") % 4).alias("prio"), F.col("l_discount").alias("score"))
    return graph.file_ranks(h, ["q"])


@query(f"WITH {OLD}, {NEW} SELECT path FROM (SELECT path FROM ol EXCEPT SELECT path FROM ne) UNION SELECT path FROM (SELECT path FROM ne EXCEPT SELECT path FROM ol)")
def path_set_difference(spark, sf):
    return gen.path_differences(*_states(spark, sf))


@query(f"WITH {SYMBOLS} SELECT symbol_id, name, file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY CASE symbol_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END DESC, symbol_id) AS k FROM sy) WHERE k = 1")
def symbol_dedup_priority(spark, sf):
    """Suppliers of a nation and name found at one place; the kind of the highest priority stays."""
    kinds = F.array(*[F.lit(k) for k in ("method", "class", "function", "type", "variable")])
    s = _symbols(spark, sf).withColumns({"kind": F.get(kinds, (F.col("symbol_id") % 5).cast("int")), "start": F.lit(1)})
    return graph.dedup_symbols(s).select("symbol_id", "name", "file_id")


@query(
    f"WITH {SYMBOLS}, {EDGES}, {RESOLVED}, h AS (SELECT DISTINCT edge_id FROM (SELECT re.edge_id FROM re JOIN sy q ON re.dst_symbol_id = q.symbol_id AND q.name = 'n5' UNION SELECT edge_id FROM re WHERE dst_name = 'n5')), "
    "c AS (SELECT re.file_id, re.l_linenumber::INT AS line, coalesce(sy.st, re.l_linenumber) AS st, coalesce(sy.name, re.dst_name) AS symbol FROM h JOIN re ON re.edge_id = h.edge_id LEFT JOIN sy ON sy.symbol_id = re.src_symbol_id) "
    "SELECT file_id, st, symbol, count(*) AS places FROM (SELECT DISTINCT file_id, st, symbol, line FROM c) GROUP BY ALL"
)
def graph_callers_distinct(spark, sf):
    """Callers of one name, each place once: the graph's hits before the budget."""
    out = graph.callers(_resolved(spark, sf), _symbols(spark, sf), _names(spark, sf, ["n5"]))
    once = out.select("file_id", F.col("line").cast("int").alias("line"), F.col("start").alias("st"), "symbol").distinct()
    return once.groupBy("file_id", "st", "symbol").agg(F.count("*").alias("places"))
