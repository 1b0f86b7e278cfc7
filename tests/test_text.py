"""Pattern dialect, globs, trigram plans, budgets."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from lumenry.functions import dialect
from lumenry.functions import text as T
from lumenry.operators import budget, extract, fts, graph, spans, trigram


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_dialect_end_anchor(spark):
    assert not one(spark, F.lit("abc\n").rlike(dialect.to_jvm("c$")))
    assert one(spark, F.lit("abc").rlike(dialect.to_jvm("c$")))
    assert one(spark, F.lit("a\rb").rlike(dialect.to_jvm("a.b")))


def test_dialect_folding(spark):
    assert one(spark, dialect.literal(F.lit("\u212aelvin"), "kelvin", True))
    assert not one(spark, dialect.literal(F.lit("Kelvin"), "kelvin", False))
    assert one(spark, dialect.literal(F.lit(r"a\Eb*"), r"a\eB*", True))


@pytest.mark.parametrize("bad", ["(?=x)y", r"(a)\1", "(?<!q)z", "("])
def test_dialect_errors(bad):
    with pytest.raises(dialect.PatternError):
        dialect.to_jvm(bad)


def test_modes():
    assert dialect.route_mode("Desk.lend") == "symbol" and dialect.route_mode("lend a book") == "text"
    with pytest.raises(ValueError):
        dialect.check_mode("fuzzy", False)
    with pytest.raises(ValueError):
        dialect.check_mode("text", True)


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.py", "a.py", True), ("*.py", "a/b.py", False), ("**/b.py", "a/b.py", True), ("src/?[ab].rs", "src/xa.rs", True), ("[!a].c", "a.c", False)])
def test_glob(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(T.glob_regex(glob))) is hit


def test_paths(spark):
    df = spark.createDataFrame([("tests/x.py",), ("src/app.spec.ts",), ("lib/core.rs",), ("node_modules/q/x.js",), ("README.md",), ("Makefile",)], ["path"])
    p = F.col("path")
    got = {r[0]: tuple(r)[1:] for r in df.select("path", T.language(p), T.is_test(p), T.is_vendor(p), T.is_walked(p), T.file_kind(p, T.is_test(p)), T.is_text(p)).collect()}
    assert got["tests/x.py"] == ("python", True, False, True, "test", True)
    assert got["src/app.spec.ts"][1] and got["lib/core.rs"][0] == "rust"
    assert got["node_modules/q/x.js"][2] and not got["node_modules/q/x.js"][3]
    assert got["README.md"][4] == "doc" and got["Makefile"][4] == "config"


@pytest.mark.parametrize(("text", "rows"), [("", [""]), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("\n\n", ["", ""])])
def test_lines(spark, text, rows):
    assert one(spark, T.lines(F.lit(text))) == rows


def test_clip_bytes(spark):
    for n in range(1, 9):
        want = "aé字b".encode()[:n].decode(errors="ignore")
        assert one(spark, T.clip_bytes(F.lit("aé字b"), n)) == want


def brute_spans(rows, hit, context=2):
    out = []
    for i, r in enumerate(rows):
        if hit(r):
            s, e = max(i - context, 0), min(i + context + 1, len(rows))
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
    return [(s + 1, e) for s, e in out]


def test_spans_against_brute_force(spark):
    texts = ["\n".join("x" if b else "." for b in bits) for n in range(1, 9) for bits in itertools.product([0, 1], repeat=n)]
    df = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], ["file_id", "path", "content"])
    got = {}
    for r in spans.literal_search(df, "x").collect():
        got.setdefault(r.file_id, []).append((r.start, r.end))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_spans(t.split("\n"), lambda r: "x" in r)


def test_plans():
    assert trigram.plan("ab").matches_all and trigram.plan("abcd").parts == ("abc", "bcd")
    assert trigram.plan("abcd", ignore_case=True).matches_all
    assert trigram.plan("fo+bar|qux.*zip", literal=False).op == "any"
    assert trigram.plan("ab|cdef", literal=False).matches_all
    assert trigram.plan("(?i)abc", literal=False).matches_all
    assert trigram.plan("colou?rful", literal=False).parts == ("col", "olo", "rfu", "ful")
    assert trigram.plan(r"a\.bc[xyz]def", literal=False).parts == ("a.b", ".bc", "def")


def test_index_equals_scan(spark):
    words = ["token", "tok", "en", "broken", "bro", "ken=", "fobar", "foobar", "quxzip"]
    texts = ["\n".join(p) for p in itertools.permutations(words, 2)]
    df = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(texts)], ["file_id", "path", "content"])
    idx = trigram.index(df).cache()
    for q, literal in (("token", True), ("ken=", True), ("fo+bar", False), ("qux.?zip|bro", False), ("^tok$", False)):
        find = spans.literal_search if literal else spans.regex_search
        key = lambda d: sorted((r.path, r.start, r.end) for r in d.collect())
        assert key(find(trigram.pruned(df, idx, trigram.plan(q, literal=literal)), q)) == key(find(df, q))


def test_budget_prefix_is_longest(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([3, 1, 4, 1, 5])], ["i", "cost"])
    for b in range(16):
        kept = [r.cost for r in budget.prefix(df, ["i"], b).orderBy("i").collect()]
        want = [c for n, c in enumerate([3, 1, 4, 1, 5]) if sum([3, 1, 4, 1, 5][: n + 1]) <= b]
        assert kept == want


def test_cost_is_json_length(spark):
    hit = {"path": 'a"b', "start": 1, "end": 2, "symbol": None, "kind": "def", "sig": "é\t", "snippet": "x\ny", "snippet_truncated": False, "score": 0.55, "why": "w"}
    df = spark.createDataFrame([tuple(hit.values())], "path string, start int, end int, symbol string, kind string, sig string, snippet string, snippet_truncated boolean, score double, why string")
    shown = {k: v for k, v in hit.items() if k != "snippet_truncated"}
    text = json.dumps(shown, ensure_ascii=False, separators=(",", ":"))
    assert df.select(budget.hit_json().alias("j")).first()["j"] == text
    assert df.select(budget.cost().alias("c")).first()["c"] == max(1, math.ceil(len(text) / 4))


def test_fit_snippet_sweep():
    hit = {"path": "p", "start": 1, "end": 9, "symbol": None, "kind": "def", "sig": "s", "snippet": 'a"\n' * 40, "snippet_truncated": False, "score": 1.0, "why": "w"}
    for b in range(1, 120):
        got = budget.fit_snippet(hit, b)
        if got is None:
            assert b < 40
        elif got["snippet_truncated"]:
            assert hit["snippet"].startswith(got["snippet"])


def test_equal_share_and_fit(spark):
    rows = [(f"p{i}", 1, 2, "s", "def", "sig", "x" * 400, False, 1.0, "w") for i in range(4)]
    df = spark.createDataFrame(rows, "path string, start int, end int, symbol string, kind string, sig string, snippet string, snippet_truncated boolean, score double, why string")
    priced = df.withColumn("cost", budget.cost())
    out = budget.fit_snippets(priced, budget.equal_share(priced, 200)).withColumn("c", budget.cost()).collect()
    assert len(out) == 4 and all(r.c <= 50 and r.snippet_truncated for r in out)


def test_tokens_and_phrases(spark):
    assert one(spark, fts.tokens(F.lit("Café retry_payment ÜBER 字x"))) == ["cafe", "retry", "payment", "uber", "字x"]
    assert fts.phrase_of("retry_payment") == ["retry", "payment"]
    df = spark.createDataFrame([(1, "retry payment retry"), (2, "payment retry"), (3, "none"), (4, "other words")], ["file_id", "content"])
    got = fts.bm25(df, {"content": (F.col("content"), 1.0)}, "retry_payment").collect()
    assert [r.file_id for r in got] == [1] and got[0]["rank"] < 0
    assert fts.bm25(df, {"content": (F.col("content"), 1.0)}, "?!").count() == 0


def test_postings_update(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c")], ["file_id", "content"])
    f = {"content": F.col("content")}
    old = fts.postings(df, f)
    new = spark.createDataFrame([(2, "z b")], ["file_id", "content"])
    got = fts.update_postings(old, new, df.where("file_id = 3"), f)
    want = fts.postings(spark.createDataFrame([(1, "a b a"), (2, "z b")], ["file_id", "content"]), f)
    rows = lambda df: sorted(map(str, df.select("field", "term", "doc_id", "tf", "positions").collect()))
    assert rows(got) == rows(want)


def test_pagerank_by_joins_equals_one_task(spark):
    nodes = spark.range(7).select(F.col("id").alias("node"))
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (4, 3), (5, 0)], ["src", "dst"])
    a = {r.node: r["rank"] for r in graph.pagerank(nodes, links).collect()}
    b = {r.node: r["rank"] for r in graph.pagerank_by_joins(nodes, links, 7).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert abs(sum(a.values()) - 1) < 1e-9


def test_parse_languages():
    s, e = extract.parse("class A:\n    def run(self):\n        return go(1)\n\n\ndef go(x):\n    return x\n", "python")
    assert [(x["qualname"], x["kind"]) for x in s] == [("A", "class"), ("A.run", "method"), ("go", "function")]
    assert ("run", "go", "call") in [(x["src_name"], x["dst_name"], x["kind"]) for x in e]
    s, _ = extract.parse("export const lend = (id: string) => {\n  return find(id);\n};\n", "typescript")
    assert (s[0]["name"], s[0]["kind"], s[0]["end"]) == ("lend", "function", 3)
    s, _ = extract.parse("type Desk struct {\n}\n\nfunc (d *Desk) Lend(b string) {\n\tfind(b)\n}\n\nfunc main() {\n}\n", "go")
    assert [(x["name"], x["kind"]) for x in s] == [("Desk", "class"), ("Lend", "method"), ("main", "function")]
    s, _ = extract.parse("struct Desk;\n\nimpl Desk {\n    fn lend(&self) {\n    }\n}\n", "rust")
    assert [(x["name"], x["kind"]) for x in s] == [("Desk", "class"), ("lend", "function")]
    s, e = extract.parse("<?php\nuse App\\Find;\nclass Desk {\n  public function lend($b) {\n    return find($b);\n  }\n}\n", "php")
    assert [(x["qualname"], x["kind"]) for x in s] == [("Desk", "class"), ("Desk.lend", "method")]
    assert extract.parse("def broken(:\n", "python") == ([], [])


def test_routes(spark):
    rows = [
        ("a.py", '@app.post("/loans")\n'), ("r.php", "Route::get('/books', 1);\n"), ("u.py", 'path("books/<id>", view)\n'), ("m.go", 'mux.HandleFunc("/x", f)\n'),
        ("s.php", "<?php\n#[Route(\n  '/multi', methods: ['PUT'])]\n#[Route('/bare')]\n"), ("web/app/(shop)/[id]/route.ts", "export async function GET() {}\n"), ("c.rs", '#[get("/health")]\nx.route("/y", delete(z)).get("w")\n'),
        ("n.txt", "x.get('/not a source')"), ("l.ts", "@Controller()\nclass L {\n  @Post('/login')\n  login() {}\n  a.Get(\n '/far')}\n"),
    ]
    got = {(r.path, r.method, r.route, r.line) for r in extract.routes(spark.createDataFrame(rows, ["path", "content"])).collect()}
    assert got == {
        ("a.py", "POST", "/loans", 1), ("r.php", "GET", "/books", 1), ("u.py", "ANY", "books/<id>", 1), ("m.go", "ANY", "/x", 1), ("s.php", "PUT", "/multi", 2),
        ("web/app/(shop)/[id]/route.ts", "GET", "/:id", 1), ("c.rs", "GET", "/health", 1), ("c.rs", "DELETE", "/y", 2), ("c.rs", "GET", "w", 2), ("l.ts", "POST", "/login", 3), ("l.ts", "GET", "/far", 5),
    }


def test_expand_parts(spark):
    assert tuple(one(spark, extract.expand_parts(F.lit("expand a/b.py:3-9")))) == ("a/b.py", 3, 9)
    assert tuple(one(spark, extract.expand_parts(F.lit("expand a.py:4")))) == ("a.py", 4, 4)
    assert one(spark, extract.expand_parts(F.lit("find x")))["start"] is None
