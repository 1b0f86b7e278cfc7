"""Search, index, ranking and budget queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, extract, fts, pack, spans, trigram
from ..sources import corpus
from .registry import query

#: The documents table as files, in SQL.
FILES = """
f AS (
  SELECT doc_id AS file_id, lang || '/' || source || '/' || doc_id || '.txt' AS path, lang, octet_length(encode(text)) AS size, text AS content,
    source = 'src3' AS is_test, source = 'src7' AS is_vendor
  FROM documents
)"""
#: Their lines: a final newline adds none.
LINES = (
    FILES
    + """, c AS (
  SELECT file_id, path, is_test, is_vendor, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS lines FROM f
), l AS (
  SELECT file_id, path, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM c
)"""
)
#: Spans of the lines in m.
SPANS = """, b AS (
  SELECT file_id, path, lines, n, greatest(n - 2, 1) AS s, least(n + 2, len(lines)) AS e FROM m
), g AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM b
), i AS (
  SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM g
), spans AS (
  SELECT file_id, path, CAST(min(s) AS INT) AS "start", CAST(max(e) AS INT) AS "end", CAST(count(*) AS INT) AS matches,
    array_to_string(list_slice(any_value(lines), min(s), max(e)), chr(10)) AS snippet
  FROM i GROUP BY file_id, path, island
)
"""
LITERAL, FOLDED, PATTERN = 'token = "', "LICENSE", r"\+1 \([0-9]{3}\) 555-[0-9]{4}"


@query("WITH" + LINES + f", m AS (SELECT * FROM l WHERE contains(line, '{LITERAL}'))" + SPANS + "SELECT * FROM spans")
def literal_spans(spark, sf):
    return spans.literal_search(corpus.documents(spark, sf), LITERAL)


@query("WITH" + LINES + f", m AS (SELECT * FROM l WHERE regexp_matches(line, '{FOLDED}', 'i'))" + SPANS + "SELECT * FROM spans")
def literal_spans_icase(spark, sf):
    return spans.literal_search(corpus.documents(spark, sf), FOLDED, ignore_case=True)


@query("WITH" + LINES + f", m AS (SELECT * FROM l WHERE regexp_matches(line, '{PATTERN}'))" + SPANS + "SELECT * FROM spans")
def regex_line_spans(spark, sf):
    return spans.regex_search(corpus.documents(spark, sf), PATTERN)


@query(
    "WITH" + LINES + f", m AS (SELECT * FROM l WHERE contains(line, '{LITERAL}'))" + SPANS
    + "SELECT count(*) AS total, greatest(count(*) - 5, 0) AS omitted, CASE WHEN count(*) > 5 THEN 'partial' ELSE 'complete' END AS coverage FROM spans"
)
def regex_limit_omission(spark, sf):
    return spans.limit_spans(spans.regex_search(corpus.documents(spark, sf), 'token = "'), 5)[1]


@query("WITH" + LINES + f", m AS (SELECT * FROM l WHERE contains(line, '{LITERAL}'))" + SPANS + 'SELECT path, "start", "end", snippet FROM spans ORDER BY path, "start" LIMIT 10')
def literal_limit(spark, sf):
    return spans.limit_spans(spans.literal_search(corpus.documents(spark, sf), LITERAL), 10)[0].select("path", "start", "end", "snippet")


@query("WITH" + LINES + ", m AS (SELECT * FROM l WHERE contains(path, 'de/src1') AND contains(line, 'der'))" + SPANS + "SELECT * FROM spans")
def path_filter_exact(spark, sf):
    return spans.literal_search(corpus.documents(spark, sf), "der", path="de/src1")


@query("WITH" + FILES + " SELECT file_id, path FROM f WHERE path ILIKE '%EN/src_/1%'")
def path_filter_like(spark, sf):
    return corpus.documents(spark, sf).where(T.like_insensitive(F.col("path"), "EN/src_/1")).select("file_id", "path")


@query("WITH" + FILES + " SELECT path FROM f WHERE regexp_matches(path, '^e[ns]/src1[0-9]/[^/]*7\\.txt$') OR contains(lower(path), 'e[ns]/src1?/7.txt') ORDER BY path LIMIT 20")
def path_glob(spark, sf):
    return corpus.find_files(corpus.documents(spark, sf), "e[ns]/src1?/*7.txt").select("path")


@query("WITH" + FILES + " SELECT CASE WHEN is_test THEN 'test' ELSE 'doc' END AS kind, count(*) AS files FROM f GROUP BY 1")
def file_kind(spark, sf):
    d = corpus.documents(spark, sf)
    return d.groupBy(T.file_kind(F.col("path"), F.col("is_test")).alias("kind")).agg(F.count("*").alias("files"))


@query("SELECT lang, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def lang_counts(spark, sf):
    return corpus.documents(spark, sf).groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("SELECT doc_id, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark, sf):
    d = corpus.table(spark, sf, "documents")
    return d.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("WITH" + FILES + " SELECT lang, CAST(sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM (SELECT DISTINCT path, lang, content FROM f) GROUP BY lang")
def source_tokens(spark, sf):
    return budget.source_tokens(corpus.documents(spark, sf), ["lang"])


@query("SELECT doc_id, length(trim(string_split(text, chr(10))[1])) AS sig_chars, left(trim(string_split(text, chr(10))[1]), 300) AS sig FROM documents")
def signatures(spark, sf):
    d = corpus.table(spark, sf, "documents")
    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    return d.select("doc_id", F.length(first).cast("long").alias("sig_chars"), T.signature(F.col("text")).alias("sig"))


@query("WITH" + LINES + " SELECT file_id, path, array_to_string(list_slice(lines, 2, least(4, len(lines))), chr(10)) AS snippet FROM c")
def line_slice_expand(spark, sf):
    d = corpus.documents(spark, sf)
    return d.select("file_id", "path", T.line_slice(T.lines(F.col("content")), F.lit(2), F.lit(4)).alias("snippet"))


@query("WITH" + LINES + " SELECT path, 2 AS \"start\", CAST(least(5, len(lines)) AS INT) AS \"end\", array_to_string(list_slice(lines, 2, least(5, len(lines))), chr(10)) AS snippet FROM c WHERE file_id = 3")
def expand_file(spark, sf):
    d = corpus.documents(spark, sf)
    one = d.where("file_id = 3").select("path").first()
    return pack.expand(d, one[0] if one else "", 2, 5)


# ---- trigrams ------------------------------------------------------------------------------



@query(
    "SELECT tri, count(*) AS files FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substring(text, i, 3))) AS tri FROM documents)"
    " WHERE length(tri) = 3 GROUP BY tri"
)
def trigram_postings(spark, sf):
    return trigram.index(corpus.documents(spark, sf)).groupBy("tri").agg(F.count("*").alias("files"))


@query("WITH" + FILES + " SELECT file_id FROM f WHERE " + " AND ".join(f"contains(content, '{LITERAL[i : i + 3]}')" for i in range(len(LITERAL) - 2)))
def trigram_candidates(spark, sf):
    return trigram.candidates(trigram.index(corpus.documents(spark, sf)), trigram.plan(LITERAL))


@query("WITH" + FILES + " SELECT file_id FROM f WHERE (contains(content, 'tok') AND contains(content, 'oke') AND contains(content, 'ken')) OR contains(content, 'Lic')")
def trigram_regex_candidates(spark, sf):
    return trigram.candidates(trigram.index(corpus.documents(spark, sf)), trigram.plan("token.*=|Lic.?e|Lice", literal=False))


@query("WITH" + LINES + f", m AS (SELECT * FROM l WHERE contains(line, '{LITERAL}'))" + SPANS + "SELECT * FROM spans")
def trigram_vs_scan_parity(spark, sf):
    """The literal search through the index; its SQL is the plain scan."""
    d = corpus.documents(spark, sf)
    return spans.literal_search(trigram.pruned(d, trigram.index(d), trigram.plan(LITERAL)), LITERAL)


@query("WITH" + FILES + " SELECT count(*) AS postings, count(DISTINCT file_id) AS files FROM (SELECT DISTINCT file_id, unnest(list_transform(range(1, greatest(length(content) - 1, 1)), lambda i: substring(content, i, 3))) AS t FROM f WHERE file_id % 4 <> 1) WHERE length(t) = 3")
def trigram_delta_merge(spark, sf):
    """An index of all files, from which a quarter is removed and another indexed anew."""
    d = corpus.documents(spark, sf)
    merged = trigram.merge(trigram.index(d), d.where("file_id % 4 = 2"), d.where("file_id % 4 = 1"))
    return merged.agg(F.count("*").alias("postings"), F.countDistinct("file_id").alias("files"))


# ---- full text -----------------------------------------------------------------------------

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
QUERY = "token the license"


def _bm25_sql(fields: list[tuple[str, float]], terms: list[str]) -> str:
    toks = ", ".join(f"{TOKENS.format(c)} AS t{i}" for i, (c, _) in enumerate(fields))
    length = " + ".join(f"len(t{i})" for i in range(len(fields)))
    f = ", ".join("(" + " + ".join(f"{w} * len(list_filter(t{i}, lambda x: x = '{t}'))" for i, (_, w) in enumerate(fields)) + f")::DOUBLE AS f{k}" for k, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS d{k}" for k in range(len(terms)))
    idf = lambda k: f"ln((n - d{k} + 0.5) / (d{k} + 0.5))"
    total = " + ".join(f"CASE WHEN {idf(k)} <= 0 THEN 1e-6 ELSE {idf(k)} END * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / avg))" for k in range(len(terms)))
    return (
        f"WITH{FILES}, t AS (SELECT *, {toks} FROM f), u AS (SELECT *, ({length})::DOUBLE AS len, {f} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg, {stats} FROM u), "
        f"r AS (SELECT u.*, -({total}) AS rank FROM u, s WHERE {' OR '.join(f'f{k} > 0' for k in range(len(terms)))}) "
    )


@query(
    "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) "
    "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term"
)
def fts_doc_freq(spark, sf):
    index = fts.postings(corpus.documents(spark, sf), {"content": F.col("content")}, ascii_only=True)
    return fts.document_frequency(index)


@query(_bm25_sql([("content", 1.0)], QUERY.split()) + "SELECT file_id, round(rank, 4) + 0.0 AS rank FROM r")
def bm25_single_field(spark, sf):
    d = fts.bm25(corpus.documents(spark, sf), {"content": (F.col("content"), 1.0)}, QUERY, ascii_only=True)
    return d.select("file_id", F.round("rank", 4).alias("rank"))


@query(_bm25_sql([("path", 5.0), ("lang", 3.0), ("content", 1.0)], ["src1", "en", "token"]) + "SELECT file_id, round(rank, 4) + 0.0 AS rank, round(0.85 - 0.75 / (1 + abs(rank)), 4) AS score FROM r")
def bm25_weighted_fields(spark, sf):
    fields = {"path": (F.col("path"), 5.0), "lang": (F.col("lang"), 3.0), "content": (F.col("content"), 1.0)}
    d = fts.bm25(corpus.documents(spark, sf), fields, "src1 en token", ascii_only=True)
    return d.select("file_id", F.round("rank", 4).alias("rank"), F.round(fts.symbol_score(F.col("rank")), 4).alias("score"))


PHRASE_F = "len(list_filter(range(1, len(t0) + 1), lambda i: t0[i] = 'of' AND i + 1 <= len(t0) AND t0[i + 1] = 'the'))::DOUBLE"


@query(
    f"WITH{FILES}, t AS (SELECT *, {TOKENS.format('content')} AS t0 FROM f), u AS (SELECT *, len(t0)::DOUBLE AS len, {PHRASE_F} AS f0 FROM t), "
    "s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg, count(*) FILTER (WHERE f0 > 0) AS d0 FROM u) "
    "SELECT file_id, round(-(CASE WHEN ln((n - d0 + 0.5) / (d0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d0 + 0.5) / (d0 + 0.5)) END * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / avg))), 4) + 0.0 AS rank "
    "FROM u, s WHERE f0 > 0"
)
def bm25_phrase(spark, sf):
    d = fts.bm25(corpus.documents(spark, sf), {"content": (F.col("content"), 1.0)}, "of_the", ascii_only=True)
    return d.select("file_id", F.round("rank", 4).alias("rank"))


@query(
    _bm25_sql([("content", 1.0)], QUERY.split())
    + ", x AS (SELECT 0 AS stage, path, 1.0::DOUBLE - 0.12 * is_test::INT - 0.25 * is_vendor::INT AS score, is_test, is_vendor FROM f WHERE contains(content, 'License, Version') "
    "UNION ALL SELECT 1, path, 0.55 - 0.47 / (1 + abs(rank)), is_test, is_vendor FROM r), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY stage, score DESC) AS k FROM x) "
    "SELECT stage, path, round(score, 4) AS score FROM y WHERE k = 1 ORDER BY stage, y.score DESC, is_test, is_vendor, path LIMIT 30"
)
def ranked_union_topk(spark, sf):
    d = corpus.documents(spark, sf)
    cols = ["path", "score", "is_test", "is_vendor"]
    exact = d.where(F.contains("content", F.lit("License, Version"))).withColumn("score", fts.exact_score(F.col("is_test"), F.col("is_vendor"))).select(*cols, F.lit(1).alias("start"))
    text = fts.bm25(d, {"content": (F.col("content"), 1.0)}, QUERY, ascii_only=True).withColumn("score", fts.excerpt_score(F.col("rank"))).select(*cols, F.lit(1).alias("start"))
    return fts.ranked([exact, text], ["path"], 30).select("stage", "path", F.round("score", 4).alias("score"))


# ---- budget, dedup -------------------------------------------------------------------------

COST = "greatest(1, CAST(ceil(length(to_json(struct_pack(path := path, \"start\" := 1, kind := 'doc', snippet := left(content, 120)))) / 4.0) AS BIGINT))"


def _priced(spark, sf):
    d = corpus.documents(spark, sf).select("file_id", "path", "lang", F.lit(1).alias("start"), F.lit("doc").alias("kind"), F.substring("content", 1, 120).alias("snippet"))
    return d.withColumn("cost", budget.cost(["path", "start", "kind", "snippet"]))


@query("WITH" + FILES + f", p AS (SELECT path, lang, {COST} AS cost FROM f), u AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY lang ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM p) SELECT path, cost, used FROM u WHERE used <= 1500")
def budget_prefix(spark, sf):
    return budget.prefix(_priced(spark, sf), ["path"], 1500, by=["lang"]).select("path", "cost", "used")


@query("WITH" + FILES + f", p AS (SELECT path, lang, {COST} AS cost FROM f), u AS (SELECT *, sum(cost) OVER (PARTITION BY lang ORDER BY path ROWS UNBOUNDED PRECEDING) AS used FROM p), k AS (SELECT * FROM u WHERE used <= 1500) SELECT CAST(sum(cost) AS BIGINT) AS tokens, count(*) AS hits, (SELECT count(*) FROM p) - count(*) AS omitted, CASE WHEN count(*) < (SELECT count(*) FROM p) THEN 'partial' ELSE 'complete' END AS coverage, CASE WHEN count(*) < (SELECT count(*) FROM p) THEN 'raise the budget or narrow the query' END AS hint FROM k")
def budget_summary(spark, sf):
    priced = _priced(spark, sf)
    return budget.summary(priced, budget.prefix(priced, ["path"], 1500, by=["lang"]))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def hit_dedup_first(spark, sf):
    e = corpus.table(spark, sf, "events")
    return spans.first_of(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT c.conv_id, c.role || '-' || c.turn AS name, c.turn AS st, c.turn + (length(c.text) % 4) AS en FROM conversations c) "
    "SELECT conv_id, turn, name, st, en FROM (SELECT p.conv_id, p.turn, s.name, s.st, s.en, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY s.en - s.st, s.st DESC, s.name) AS k FROM p JOIN s ON s.conv_id = p.conv_id AND s.st <= p.turn AND s.en >= p.turn) WHERE k = 1"
)
def enclosing_span_join(spark, sf):
    c = corpus.table(spark, sf, "conversations")
    s = c.select(F.col("conv_id").alias("file_id"), F.concat_ws("-", "role", F.col("turn").cast("string")).alias("name"), F.col("turn").alias("start"), (F.col("turn") + F.length("text") % 4).alias("end"))
    out = spans.enclosing(c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("line")).distinct(), s)
    return out.select(F.col("file_id").alias("conv_id"), F.col("line").alias("turn"), "name", F.col("start").alias("st"), F.col("end").alias("en"))


@query(
    "WITH h AS (SELECT conv_id, min(turn) AS st, max(turn) - 1 AS en FROM conversations GROUP BY conv_id HAVING conv_id % 2 = 0) "
    "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = c.conv_id AND c.turn BETWEEN h.st AND h.en)"
)
def span_overlap_anti(spark, sf):
    c = corpus.table(spark, sf, "conversations")
    h = c.where("conv_id % 2 = 0").groupBy(F.col("conv_id").alias("path")).agg(F.min("turn").alias("start"), (F.max("turn") - 1).alias("end"))
    return spans.outside(c.select(F.col("conv_id").alias("path"), F.col("turn").alias("line")), h).select(F.col("path").alias("conv_id"), F.col("line").alias("turn"))


@query(
    "WITH q AS (SELECT doc_id, 'see ' || lang || '/' || source || '/' || doc_id || '.txt:' || (doc_id % 7 + 1) || '-' || (doc_id % 7 + 3) || CASE WHEN doc_id % 3 = 0 THEN ' and gone.txt:1' ELSE '' END AS a, doc_id % 7 AS k FROM documents) "
    "SELECT doc_id AS answer_id, k <= 3 AND doc_id % 3 <> 0 AS valid, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS citations FROM q"
)
def citation_valid(spark, sf):
    d = corpus.documents(spark, sf)
    a = d.select(
        F.col("file_id").alias("answer_id"),
        F.concat(F.lit("see "), "path", F.lit(":"), (F.col("file_id") % 7 + 1).cast("string"), F.lit("-"), (F.col("file_id") % 7 + 3).cast("string"), F.when(F.col("file_id") % 3 == 0, " and gone.txt:1").otherwise("")).alias("text"),
    )
    return extract.citations_valid(a, d.select("path", F.lit(1).alias("start"), F.lit(6).alias("end")))


#: A source with one route of each family for every document.
_SOURCES = (
    ("ts", "router.get('/a{}', one)\n@Post('/b{}')\nclass C {{}}\n", [(1, "GET", "/a{}"), (2, "POST", "/b{}")]),
    ("php", "Route::any('c{}', 'x');\n#[Route('/d{}', name: 'n',\n  methods: ['PUT'])]\n", [(1, "ANY", "c{}"), (2, "PUT", "/d{}")]),
    ("py", "urls = [path('e{}', v),\n  re_path('f{}', w)]\n", [(1, "ANY", "e{}"), (2, "ANY", "f{}")]),
    ("go", "x\nmux.HandleFunc('/g{}', h)\n", [(2, "ANY", "/g{}")]),
    ("rs", "app.route('/h{}', delete(h))\n#[get('/i{}')]\n", [(1, "DELETE", "/h{}"), (2, "GET", "/i{}")]),
)
_ROUTES_SQL = " UNION ALL ".join(
    f"SELECT 'src/' || doc_id || '.{ext}' AS path, {line}::BIGINT AS line, '{method}' AS method, replace('{route}', '{{}}', doc_id::VARCHAR) AS route FROM documents WHERE doc_id % 5 = {i}"
    for i, (ext, _, found) in enumerate(_SOURCES)
    for line, method, route in found
)


@query(f"SELECT path, line, method, route FROM ({_ROUTES_SQL})")
def route_extract(spark, sf):
    d, i = corpus.table(spark, sf, "documents"), F.col("doc_id").cast("string")
    pick = lambda made: F.get(F.array(*made), (F.col("doc_id") % 5).cast("int"))
    content = pick([F.replace(F.lit(text.replace("{{", "{").replace("}}", "}")), F.lit("{}"), i) for _, text, _ in _SOURCES])
    content = F.replace(content, F.concat(F.lit("class C "), i), F.lit("class C {}"))
    path = F.concat(F.lit("src/"), i, F.lit("."), pick([F.lit(ext) for ext, _, _ in _SOURCES]))
    files = d.select(path.alias("path"), content.alias("content"))
    return extract.every_route(files).select("path", F.col("line").cast("long").alias("line"), "method", "route")


@query(
    "WITH p AS (SELECT doc_id, 'web/app/(shop)/' || lang || '/[' || source || ']/' || (doc_id % 5) || '/route.ts' AS path FROM documents) "
    "SELECT doc_id, '/' || split_part(path, '/', 4) || '/:' || trim(split_part(path, '/', 5), '[]') || '/' || split_part(path, '/', 6) AS route FROM p"
)
def next_route_path(spark, sf):
    d = corpus.table(spark, sf, "documents")
    path = F.concat(F.lit("web/app/(shop)/"), "lang", F.lit("/["), "source", F.lit("]/"), (F.col("doc_id") % 5).cast("string"), F.lit("/route.ts"))
    return d.select("doc_id", extract.next_path(path).alias("route"))


@query("SELECT doc_id, length(left(text, strpos(text, ' the ') - 1)) - length(replace(left(text, strpos(text, ' the ') - 1), chr(10), '')) + 1 AS line FROM documents WHERE contains(text, ' the ')")
def line_of_offset(spark, sf):
    d = corpus.table(spark, sf, "documents").where(F.contains("text", F.lit(" the ")))
    return d.select("doc_id", T.line_of(F.col("text"), F.instr("text", " the ") - 1).cast("long").alias("line"))


SHOP = '''"""Lending."""
from store import find_book

LIMIT = 3


class Desk:
    def lend(self, book):
        return find_book(book)


def find_desk(name):
    return Desk().lend(name)
'''


@query()
def extract_python_symbols(spark, sf):
    """Symbols of a small source of our own."""
    files = spark.range(1).select(F.lit(1).cast("long").alias("file_id"), F.lit("desk.py").alias("path"), F.lit("python").alias("lang"), F.lit(SHOP).alias("content"))
    return extract.symbols(files)


@query()
def pack_explore(spark, sf):
    """Definitions and relations of two symbols of that source."""
    from ..operators import graph

    files = spark.range(1).select(F.lit(1).cast("long").alias("file_id"), F.lit("desk.py").alias("path"), F.lit("python").alias("lang"), F.lit(SHOP).alias("content"), F.lit(False).alias("is_test"))
    s = extract.symbols(files).withColumn("symbol_id", F.xxhash64("path", "start", "name"))
    e = extract.edges(files).withColumn("edge_id", F.xxhash64("line", "dst_name", "kind"))
    e = graph.resolve(graph.source_ids(e, s), s)
    return pack.pack(files, s, e, "Desk lend find_book").select("path", "start", "end", "symbol", "kind", "why", "cost", "used")
