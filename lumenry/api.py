"""A corpus: index a tree, keep it up to date, and search it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dialect
from .operators import budget, extract, fts, graph, pack, repomap, spans, trigram
from .sources import corpus
from .sources import generation as gen
from .sources.generation import Store



class Corpus:
    """Relations of a source tree in generations below ``store``."""

    def __init__(self, spark: SparkSession, root: str, store: str, *, ignore: tuple[str, ...] = ()):
        self.spark, self.root, self.ignore, self.store = spark, root, ignore, Store(spark, store)

    # -- index ------------------------------------------------------------------------
    def index(self, *, force: bool = False) -> dict[str, int]:
        """Build or update: only files that changed are parsed and tokenised."""
        live = corpus.read_tree(self.spark, self.root, ignore=self.ignore)
        if force or self.store.manifest()["generation"] is None:
            files, new = live, live
            old = None
        else:
            name = self.store.manifest()["generation"]
            before = self.store.read("files", name)
            old = {t: self.store.read(t, name) for t in ("files", "symbols", "edges", "trigrams", "postings")}
            _, new = gen.same_content(before, gen.changed(before, live))
            gone = gen.removed(before, live.select("path"))
            out = gone.select("file_id").unionByName(new.select("file_id")).distinct()
            files = live
        parsed = new.where(F.col("size") <= corpus.MAX_STRUCTURE)
        fields = {"content": F.col("content"), "path": F.col("path")}
        made = {"symbols": extract.symbols(parsed), "edges": extract.edges(parsed), "trigrams": trigram.index(new), "postings": fts.postings(new, fields)}
        if old is not None:
            keep = {t: old[t].join(out.withColumnRenamed("file_id", "doc_id") if t == "postings" else out, "doc_id" if t == "postings" else "file_id", "left_anti") for t in made}
            made = {t: (keep[t].drop("symbol_id", "src_symbol_id", "dst_symbol_id", "edge_id").unionByName(df)) for t, df in made.items()}
        symbols = made["symbols"].withColumn("symbol_id", F.xxhash64("path", "start", "name", "kind", "qualname"))
        edges = made["edges"].withColumn("edge_id", F.xxhash64("path", "line", F.coalesce("src_name", F.lit("")), "dst_name", "kind"))
        edges = graph.resolve(graph.source_ids(graph.dedup_edges(edges), symbols), symbols)
        # sorted, so that a lookup reads the row groups that may hold its keys
        lookup = lambda df, key: df.repartitionByRange(key).sortWithinPartitions(key)
        self.store.write({"files": files, "symbols": graph.dedup_symbols(symbols), "edges": edges, "trigrams": lookup(made["trigrams"], "tri"), "postings": lookup(made["postings"], "term")})
        counts = {t: self.table(t).count() for t in ("files", "symbols", "edges")}
        return counts | {"changed": new.select("path").count() if old is not None else counts["files"]}

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def stale(self) -> DataFrame:
        return gen.stale(corpus.walk(self.spark, self.root, ignore=self.ignore), self.table("files"))

    # -- search -----------------------------------------------------------------------
    def search(self, query: str, mode: str = "auto", *, ignore_case: bool = False, path: str | None = None, limit: int = 20, use_index: bool = True) -> DataFrame:
        """Ranked hits (auto, text, symbol), or spans (literal, regex)."""
        dialect.check_mode(mode, ignore_case)
        files = self.table("files")
        if mode in ("literal", "regex"):
            if use_index:
                plan = trigram.plan(query, literal=mode == "literal", ignore_case=ignore_case)
                files = trigram.pruned(files, self.table("trigrams"), plan)
            find = spans.literal_search if mode == "literal" else spans.regex_search
            return spans.limit_spans(find(files, query, ignore_case=ignore_case, path=path), limit)[0]
        return self._ranked(query, mode, path, limit)

    def _ranked(self, query: str, mode: str, path: str | None, limit: int) -> DataFrame:
        from .functions import text as T

        files = self.table("files") if path is None else self.table("files").where(T.like_insensitive(F.col("path"), path))
        meta = files.select("file_id", "is_test", "is_vendor")
        s = self.table("symbols").join(meta, "file_id")
        shape = lambda df, score, why: df.select("path", "start", "end", F.col("name").alias("symbol"), "kind", "sig", "snippet", "snippet_truncated", score.alias("score"), F.lit(why).alias("why"), "is_test", "is_vendor")
        stages = []
        if mode == "symbol" or dialect.route_mode(query) == "symbol":
            stages.append(shape(graph.definitions(s, query), fts.exact_score(F.col("is_test"), F.col("is_vendor")), "exact symbol"))
        hits = fts.bm25(s, {"name": (F.col("name"), 5.0), "qualname": (F.col("qualname"), 3.0), "snippet": (F.col("snippet"), 1.0)}, query)
        stages.append(shape(hits.orderBy("rank", "path", "start").limit(3 * (limit + 1)), fts.symbol_score(F.col("rank")), "full text"))
        if mode != "symbol":
            found = fts.bm25(files, {"content": (F.col("content"), 1.0)}, query).orderBy("rank", "is_test", "path").limit(limit + 1)
            none = F.lit(None).cast("string")
            stages.append(found.select("path", F.lit(1).alias("start"), F.lit(1).alias("end"), none.alias("symbol"), F.lit("text").alias("kind"), F.lit("").alias("sig"), corpus.excerpt(F.col("content")).alias("snippet"), F.lit(False).alias("snippet_truncated"), F.lit(fts.CONTENT_SCORE).alias("score"), F.lit("content").alias("why"), "is_test", "is_vendor"))
        return fts.ranked(stages, ["path", "start", "symbol", "kind"], limit)

    def within(self, hits: DataFrame, tokens: int = 1500) -> tuple[DataFrame, DataFrame]:
        """Hits that fit a budget, and the summary."""
        order = [c for c in ("stage", F.col("score").desc(), "is_test", "is_vendor", "path", "start")]
        priced = hits.withColumn("cost", budget.cost())
        kept = budget.prefix(priced, order, tokens)
        return kept, budget.summary(priced, kept)

    # -- graph ------------------------------------------------------------------------
    def graph(self, operation: str, symbol: str, depth: int = 2) -> DataFrame:
        s, e = self.table("symbols"), self.table("edges")
        names = graph.definitions(s, symbol).select(F.lit(symbol).alias("query"), "symbol_id", "name")
        if operation == "def":
            return graph.definitions(s, symbol)
        if operation in ("refs", "callers"):
            return graph.callers(e, s, names)
        if operation == "callees":
            return graph.callees(e, s, names)
        if operation in ("path", "impact"):
            links = e.where("kind = 'call' and src_symbol_id is not null and dst_symbol_id is not null").select(F.col("src_symbol_id").alias("src"), F.col("dst_symbol_id").alias("dst")).distinct()
            hops = graph.reach(links, names.select(F.col("symbol_id").alias("node")), depth).where("hop > 0")
            return hops.join(s, F.col("node") == F.col("symbol_id")).select("hop", "symbol_id", "name", "path", "start", "end")
        raise ValueError(f"unknown operation {operation!r}")

    def pack(self, query: str, *, limit_tokens: int = 2000, intent: str = "explore") -> DataFrame:
        return pack.pack(self.table("files"), self.table("symbols"), self.table("edges"), query, limit_tokens=limit_tokens, intent=intent)

    def map(self) -> dict[str, DataFrame]:
        return repomap.build(self.table("files"), self.table("symbols"), self.table("edges"))

    def files(self, query: str, limit: int = 20) -> DataFrame:
        return corpus.find_files(self.table("files"), query, limit)

    def briefing(self, focus: str | None = None) -> str:
        """The map, and a pack of the focus, as Markdown."""
        parts = self.map()
        hot = self.table("edges").where("dst_symbol_id is not null").groupBy("dst_name").agg(F.count("*").alias("uses")).orderBy(F.col("uses").desc(), "dst_name").limit(7)
        parts["hotspots"] = hot
        if focus:
            parts["focus"] = self.pack(focus).select("path", "start", "symbol", "kind")
        return repomap.markdown(parts)
