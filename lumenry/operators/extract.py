"""Symbols, calls and imports of source files, and routes of web frameworks."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SNIPPET_BYTES = 2000
# Fixed value: words that look like calls but are not.
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "func", "fn", "match", "loop", "isset", "empty")

SYMBOLS = "file_id long, path string, name string, qualname string, kind string, start int, end int, sig string, snippet string, snippet_truncated boolean"
EDGES = "file_id long, path string, src_name string, dst_name string, kind string, line int, source string, confidence double"

_BLOCK = {
    "typescript": [(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^\s*(?:export\s+)?interface\s+(\w+)", "type"), (r"^\s*(?:export\s+)?type\s+(\w+)\s*=", "type"), (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", "function"), (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=", "variable"), (r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(\w+)\s*\([^;]*\)\s*(?::[^{;]+)?\{", "method")],
    "go": [(r"^func\s+\([^)]*\)\s*(\w+)\s*\(", "method"), (r"^func\s+(\w+)\s*[\[(]", "function"), (r"^type\s+(\w+)\s+struct\b", "class"), (r"^type\s+(\w+)\s", "type"), (r"^(?:var|const)\s+(\w+)", "variable")],
    "rust": [(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(\w+)", "class"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:trait|type)\s+(\w+)", "type"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)", "function"), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:", "variable")],
    "php": [(r"^\s*(?:abstract\s+|final\s+)*class\s+(\w+)", "class"), (r"^\s*(?:interface|trait)\s+(\w+)", "type"), (r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+)*function\s+(\w+)", "function")],
    "java": [(r"^\s*(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*class\s+(\w+)", "class"), (r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*(?:interface|enum|record)\s+(\w+)", "type"), (r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|synchronized\s+)+[\w<>\[\],\s]+?\s(\w+)\s*\([^;]*\)\s*(?:throws[^{]+)?\{", "method")],
}
_BLOCK["javascript"] = _BLOCK["typescript"]
_RULES = {lang: [(re.compile(p), k) for p, k in rules] for lang, rules in _BLOCK.items()}
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_IMPORT = re.compile(r"^\s*(?:import|use|from|require(?:_once)?|include(?:_once)?)\b(.*)|(?:require|import)\s*\(\s*(['\"][^'\"]+['\"])")
_QUOTED = re.compile(r"['\"]([^'\"]+)['\"]")


def _python(source: str):
    """(name, containers, kind, start, end) and calls and imports of Python, from its syntax tree."""
    symbols, calls = [], []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return symbols, calls

    def visit(node, inside: tuple[str, ...], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                symbols.append((child.name, inside, "class", child.lineno, child.end_lineno))
                visit(child, (*inside, child.name), True)
                continue
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                symbols.append((child.name, inside, "method" if in_class else "function", child.lineno, child.end_lineno))
                visit(child, (*inside, child.name), False)
                continue
            if isinstance(child, (ast.Assign, ast.AnnAssign)) and isinstance(node, ast.Module):
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name):
                        symbols.append((target.id, inside, "variable", child.lineno, child.end_lineno))
            if isinstance(child, ast.Call):
                f = child.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if name and name not in KEYWORDS:
                    calls.append((name, "call", child.lineno))
            if isinstance(child, (ast.Import, ast.ImportFrom)) and child.names:
                last = child.names[-1]
                calls.append(((last.asname or last.name).split(".")[-1], "import", child.lineno))
            visit(child, inside, in_class)

    visit(tree, (), False)
    return symbols, calls


def _end_of_block(rows: list[str], start: int) -> int:
    """Last line of the braces that open at or after a line; the line itself if none do."""
    depth, opened = 0, False
    for i in range(start, len(rows)):
        line = re.sub(r"'[^']*'|\"[^\"]*\"|//.*", "", rows[i])
        depth += line.count("{") - line.count("}")
        opened |= "{" in line
        if opened and depth <= 0:
            return i + 1
        if not opened and line.rstrip().endswith(";"):
            return i + 1
    return len(rows) if opened else start + 1


def _braces(source: str, lang: str):
    """The same for languages of braces, line by line."""
    rows = source.split("\n")
    symbols, calls, open_, declared = [], [], [], set()
    for i, line in enumerate(rows):
        open_ = [c for c in open_ if c[1] > i]
        for rule, kind in _RULES.get(lang, ()):
            m = rule.match(line)
            if not m or m[1] in KEYWORDS:
                continue
            end = _end_of_block(rows, i)
            inside = tuple(c[0] for c in open_)
            kind = "method" if kind == "function" and any(c[2] for c in open_) else kind
            symbols.append((m[1], inside, kind, i + 1, end))
            declared.add((i, m[1]))
            if kind == "class" or (kind == "type" and lang != "go"):
                open_.append((m[1], end, True))
            break
        m = _IMPORT.search(line)
        if m and (m[2] or not line.lstrip().startswith("from(")):
            body = m[1] or m[2] or ""
            quoted = _QUOTED.findall(body)
            if quoted:
                calls += [(q.rstrip("/").split("/")[-1], "import", i + 1) for q in quoted]
            else:
                words = re.findall(r"\w+", body)
                if words:
                    calls.append((words[-1], "import", i + 1))
            continue
        for c in _CALL.finditer(line):
            if c[1] not in KEYWORDS and (i, c[1]) not in declared:
                calls.append((c[1], "call", i + 1))
    return symbols, calls


def parse(source: str, lang: str | None):
    """Symbols and edges of one source; edges name the smallest symbol around their line."""
    found, uses = _python(source) if lang == "python" else _braces(source, lang or "")
    rows = source.split("\n")
    symbols = []
    for name, inside, kind, start, end in found:
        body = "\n".join(rows[start - 1 : end]).rstrip()
        raw = body.encode()
        clipped = raw[:SNIPPET_BYTES].decode(errors="ignore").rstrip() if len(raw) > SNIPPET_BYTES else body
        symbols.append({"name": name, "qualname": ".".join((*inside, name)), "kind": kind, "start": start, "end": end, "sig": body.split("\n")[0].strip()[:300], "snippet": clipped, "snippet_truncated": len(raw) > SNIPPET_BYTES})
    edges = []
    for dst, kind, line in dict.fromkeys(uses):
        around = [s for s in symbols if s["start"] <= line <= s["end"] and s["kind"] != "variable"]
        owner = min(around, key=lambda s: s["end"] - s["start"], default=None)
        edges.append({"src_name": owner and owner["name"], "dst_name": dst, "kind": kind, "line": line, "source": "parser", "confidence": 0.65})
    return symbols, edges


def _parsed(files: DataFrame, what: int, schema: str) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        for pdf in batches:
            out = []
            for file_id, path, lang, content in zip(pdf.file_id, pdf.path, pdf.lang, pdf.content, strict=True):
                out += [{"file_id": file_id, "path": path} | row for row in parse(content or "", lang)[what]]
            yield pd.DataFrame(out, columns=names)

    return files.where("lang is not null").select("file_id", "path", "lang", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _parsed(files, 0, SYMBOLS)


def edges(files: DataFrame) -> DataFrame:
    return _parsed(files, 1, EDGES)


# ---- routes -----------------------------------------------------------------------------

# How frameworks declare routes; group of the verb (0: any verb) and of the route.
ROUTES = (
    (r"(?i)(?:@\w+\.|\.|->)(get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)", 1, 2),
    (r"(?i)Route::(get|post|put|delete|patch|options|any)\s*\(\s*['\"]([^'\"]+)", 1, 2),
    (r"(?i)(?:@|#\[(?!head|options))(get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)", 1, 2),
    (r"(?i)(?:path|re_path)\s*\(\s*['\"]([^'\"]+)", 0, 1),
    (r"(?i)(?:Handle|HandleFunc)\s*\(\s*['\"]([^'\"]+)", 0, 1),
    (r"(?i)\.route\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*(get|post|put|delete|patch)\s*\(", 2, 1),
    (r"(?is)#\[Route\s*\(\s*['\"]([^'\"]+).{0,200}?methods\s*:\s*\[\s*['\"]([A-Z]+)", 2, 1),
)
NEXT_EXPORT = r"(?m)^\s*export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b"
NEXT_FILE = r"(^|/)app/(.*/)?route\.(ts|js|tsx|jsx)$"


def _found(pattern: str, method, route) -> Column:
    """(line, method, route) of every match in content; a match begins after the texts between
    the matches and the matches before it, whose line ends are counted."""
    matches, between = F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), F.split("content", pattern, -1)
    ends = lambda texts, n: F.aggregate(F.slice(texts, F.lit(1), n), F.lit(0), lambda a, t: a + F.regexp_count(t, F.lit("\n")))
    row = lambda m, i: F.struct((1 + ends(between, i + 1) + ends(matches, i)).alias("line"), method(m).alias("method"), route(m).alias("route"))
    return F.when(F.col("content").rlike(pattern), F.transform(matches, row))


def every_route(files: DataFrame) -> DataFrame:
    """(path, line, method, route) of the sources among files, once each, from one pass over their texts."""
    part = lambda pattern, g: lambda m: F.regexp_extract(m, pattern, g)
    verb = lambda pattern, g: (lambda m: F.upper(part(pattern, g)(m))) if g else (lambda m: F.lit("ANY"))
    found = [_found(p, verb(p, v), part(p, r)) for p, v, r in ROUTES]
    found.append(F.when(F.col("path").rlike(NEXT_FILE), _found(NEXT_EXPORT, verb(NEXT_EXPORT, 1), lambda m: next_path(F.col("path")))))
    none = F.array().cast("array<struct<line:int,method:string,route:string>>")
    every = F.concat(*[F.coalesce(f, none) for f in found])
    return files.where(T.language(F.col("path")).isNotNull()).select("path", F.inline(every)).dropDuplicates(["path", "line", "method", "route"])


def next_path(path: Column) -> Column:
    """The route of a file under app/: groups in brackets go, [id] becomes :id."""
    below = F.regexp_replace(path, r"^(?:.*/)?app/|/?route\.(?:ts|js|tsx|jsx)$", "")
    kept = F.filter(F.split(below, "/"), lambda s: (F.length(s) > 0) & ~s.rlike(r"^\(.*\)$"))
    named = F.transform(kept, lambda s: F.regexp_replace(s, r"^\[(?:\.\.\.)?([^\]]+)\]$", ":$1"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def routes(files: DataFrame, top: int = 50) -> DataFrame:
    """Routes in order of path and line, the first ``top``."""
    return every_route(files).orderBy("path", "line", "method", "route").limit(top)


def json_usage(payload: Column, keys: tuple[str, ...]) -> Column:
    """The first of some keys in a flat JSON object, as a number."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in keys]).cast("long")


def expand_parts(query: Column) -> Column:
    """path, start and end of an ``expand path:start-end`` query."""
    p = r"^expand\s+(.+):(\d+)(?:-(\d+))?$"
    start = F.regexp_extract(query, p, 2)
    end = F.regexp_extract(query, p, 3)
    number = lambda s: F.when(s == "", None).otherwise(s).cast("int")
    return F.struct(F.regexp_extract(query, p, 1).alias("path"), number(start).alias("start"), F.coalesce(number(end), number(start)).alias("end"))


def citations_valid(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """answers (answer_id, text): whether each path:line(-line) cited lies in a hit, and there is one."""
    p = r"([\w./-]+):(\d+)(?:-(\d+))?"
    each = answers.select("answer_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("n", "cite"))
    num = lambda g: F.when(F.regexp_extract("cite", p, g) == "", None).otherwise(F.regexp_extract("cite", p, g)).cast("int")
    cited = each.select("answer_id", "n", F.regexp_extract("cite", p, 1).alias("path"), num(2).alias("first"), F.coalesce(num(3), num(2)).alias("last"))
    h = hits.select(F.col("path").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = cited.join(h, (F.col("path") == F.col("_p")) & (F.col("_s") <= F.col("first")) & (F.col("_e") >= F.col("last")), "left")
    one = held.groupBy("answer_id", "n").agg(F.max(F.col("_p").isNotNull()).alias("good"))
    return one.groupBy("answer_id").agg((F.min(F.col("good") & F.col("n").isNotNull())).alias("valid"), F.count("n").alias("citations"))


def answer(lines: DataFrame) -> DataFrame:
    """One answer per run of JSON lines (run, n, line): the last ``result`` or ``answer``, else the
    assistant's texts in order."""
    got = lines.select(
        "run", "n", F.coalesce(F.get_json_object("line", "$.result"), F.get_json_object("line", "$.answer")).alias("final"),
        F.when(F.get_json_object("line", "$.role") == "assistant", F.get_json_object("line", "$.text")).alias("said"),
    )
    one = got.groupBy("run").agg(
        F.max(F.when(F.col("final").isNotNull(), F.struct("n", "final"))).alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("n", "said")))).alias("all"),
    )
    return one.select("run", F.coalesce("last.final", F.array_join(F.transform("all", lambda x: x["said"]), "\n")).alias("answer"))


def find_keys(payload: Column, keys: tuple[str, ...]) -> Column:
    """The first value of any of some keys, at any depth, in the order of the text."""
    names = "|".join(re.escape(k) for k in keys)
    return F.nullif(F.regexp_extract(payload, rf'"(?:{names})"\s*:\s*("(?:[^"\\]|\\.)*"|[-+.eE0-9]+|true|false|null)', 1), F.lit(""))
