"""A small library-lending service, indexed, searched, changed and indexed again."""

import pytest
from pyspark.sql import functions as F

from lumenry.api import Corpus
from lumenry.operators import metrics
from lumenry.sources.generation import Store

FILES = {
    "desk.py": "from store import find_book\n\n\nclass Desk:\n    def lend(self, book):\n        return find_book(book)\n\n    def close(self):\n        return None\n",
    "app.py": 'from desk import Desk\n\n\n@app.post("/loans")\ndef loan(book):\n    return Desk().lend(book)\n',
    "store.py": "SHELF = []\n\n\ndef find_book(name):\n    return check_book(name)\n\n\ndef check_book(name):\n    return name in SHELF\n",
    "web/api.ts": 'export const renew = (id: string) => {\n  return close(id);\n};\nrouter.post("/renew", renew);\n',
    "svc/service.go": "type Shelf struct {\n}\n\nfunc (s *Shelf) Add(b string) {\n}\n",
    "svc/worker.rs": "struct Worker;\n\nimpl Worker {\n    fn close(&self) {\n    }\n}\n",
    "shop/app/(in)/[id]/route.ts": "export async function GET() {}\n",
    "tests/test_desk.py": "def test_lend():\n    Desk().lend('x')\n",
    "README.md": "# Library\n\nLends books to readers.\n",
    "crlf.txt": "one\r\ntwo needle\r\nthree\r\n",
    "empty.txt": "",
    "kelvin.txt": "\u212aelvin stra\u00dfe",
    "node_modules/x.js": "needle",
}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (root / "bin.dat").write_bytes(b"needle\x00needle")
    (root / "bad.txt").write_bytes(b"needle \xff end")
    return root


def test_corpus(spark, tree, tmp_path):
    c = Corpus(spark, str(tree), str(tmp_path / "store"))
    counts = c.index()
    assert counts["files"] == len(FILES) - 1 - 1 + 1 and counts["symbols"] >= 9  # without node_modules and the empty file, with bad.txt
    paths = {r.path for r in c.table("files").select("path").collect()}
    assert "node_modules/x.js" not in paths and "bin.dat" not in paths and "bad.txt" in paths
    assert c.stale().count() == 1  # the binary file is seen by the walk and not indexed

    hit = c.search("needle", "literal").collect()
    assert [(r.path, r.start, r.end, r.snippet) for r in hit if r.path == "crlf.txt"] == [("crlf.txt", 1, 3, "one\ntwo needle\nthree")]
    assert {r.path for r in hit} == {"crlf.txt", "bad.txt"}
    same = lambda i: sorted(map(tuple, c.search(r"find_\w+\(", "regex", use_index=i).select("path", "start", "end").collect()))
    assert same(True) == same(False) and len(same(True)) >= 2
    assert c.search("kelvin", "literal", ignore_case=True).count() == 1

    top = c.search("lend").first()
    assert (top.path, top.symbol, top.why) == ("desk.py", "lend", "exact symbol")
    kept, summary = c.within(c.search("lend book"), 200)
    row = summary.first()
    assert row.tokens <= 200 and row.hits == kept.count()

    assert {r.path for r in c.graph("def", "close").collect()} == {"desk.py", "svc/worker.rs"}
    assert {r.symbol for r in c.graph("callers", "find_book").collect()} >= {"lend"}
    assert {r.name for r in c.graph("callees", "find_book").collect()} == {"check_book"}
    assert {(r.name, r.hop) for r in c.graph("impact", "lend", 2).collect()} == {("find_book", 1), ("check_book", 2)}
    assert {r.name for r in c.graph("path", "lend", 1).collect()} == {"find_book"}
    kinds = {(r.symbol, r.kind) for r in c.pack("how does lend use find_book").collect()}
    assert ("lend", "def") in kinds and ("find_book", "def") in kinds

    m = c.map()
    assert {r.route for r in m["routes"].collect()} >= {"/loans", "/renew", "/:id"}
    assert m["entrypoints"].first().path == "app.py" and m["identity"].first().summary == "Lends books to readers."
    assert "## Packages" in c.briefing("lend")
    assert [r.path for r in c.files("*.md").collect()] == ["README.md"]

    first = c.store.manifest()["generation"]
    (tree / "store.py").write_text(FILES["store.py"] + "\n\ndef lost_book():\n    return find_book('x')\n")
    (tree / "desk.py").unlink()
    again = c.index()
    assert again["changed"] == 1 and c.store.manifest()["previous"] == first
    assert c.graph("def", "lost_book").count() == 1 and c.graph("def", "Desk").count() == 0
    fresh = Corpus(spark, str(tree), str(tmp_path / "other"))
    fresh.index()
    for t, cols in (("trigrams", ["tri", "file_id"]), ("postings", ["field", "term", "doc_id", "tf"]), ("symbols", ["symbol_id", "qualname"]), ("edges", ["edge_id", "dst_symbol_id"])):
        assert sorted(map(str, c.table(t).select(*cols).collect())) == sorted(map(str, fresh.table(t).select(*cols).collect())), t


def test_store_rolls_back_and_collects(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        s.read("t")
    a = s.write({"t": spark.range(3)})
    with pytest.raises(Exception):
        s.write({"t": spark.range(3).select(F.raise_error(F.lit("no")))})
    assert s.manifest()["generation"] == a and s.read("t").count() == 3
    s.write({"t": spark.range(4)})
    last = s.write({"t": spark.range(5)})
    assert s.read("t").count() == 5 and a not in {p.name for p in (tmp_path / "s").iterdir()}
    assert s.manifest()["generation"] == last


def test_cost_and_cache(spark):
    e = spark.createDataFrame([(1, "run", None, 1000, 400, 100)], "event_id long, kind string, model string, input_tokens long, cached_input_tokens long, output_tokens long")
    none = spark.createDataFrame([], "model string, input_per_million double, cached_input_per_million double, output_per_million double")
    assert metrics.cost(e, none).first().cost_usd is None
    named = metrics.cost(e.withColumn("model", F.lit("x")), none).first().cost_usd
    assert abs(named - (600 * 0.25 + 400 * 0.025 + 100 * 2.0) / 1e6) < 1e-12
    c = spark.createDataFrame([("a", 10, 10, 5, 1), ("b", 20, 30, 6, 2), ("c", 1, 40, 7, 3)], "cache_key string, created_at long, last_hit_at long, size_bytes long, hit_count long")
    assert {r.cache_key for r in metrics.prune_cache(c, oldest=5, max_bytes=6).collect()} == {"b"}
    assert metrics.cache_lookup(c, "a", 15, 10).count() == 1 and metrics.cache_lookup(c, "a", 25, 10).count() == 0
    assert tuple(metrics.cache_status(c).first()) == (3, 18, 6)
