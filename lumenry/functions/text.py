"""Column functions over text: lines, paths, truncation, estimates, display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by language, and directories that are not walked.
LANGUAGES = {
    "python": ("py", "pyi"),
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "go": ("go",),
    "rust": ("rs",),
    "php": ("php",),
    "java": ("java",),
}
TEXT_EXTENSIONS = ("md", "txt", "rst", "json", "yaml", "yml", "toml", "ini", "cfg", "html", "css", "sql", "sh")
DOC_EXTENSIONS = ("md", "txt")
SKIPPED_DIRS = (".git", ".lumenry", ".venv", "venv", "node_modules", "vendor", "target", "dist", "build", "__pycache__", ".next", ".nuxt")
TEST_DIRS = ("test", "tests", "spec", "specs", "__tests__")
VENDOR_DIRS = ("vendor", "node_modules")
ENTRY_NAMES = (
    "main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "__main__.py", "main.go", "main.rs", "index.js", "index.ts",
    "server.js", "server.ts", "app.js", "app.ts", "index.php",
)
ENTRY_PATHS = ("src/main.rs", "src/lib.rs", "src/index.ts", "src/index.js", "public/index.php", "artisan")
ENTRY_PREFIXES = ("cmd/", "bin/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension of the file name; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def language(path: Column) -> Column:
    """Language of a path, or null."""
    out = None
    for name, endings in LANGUAGES.items():
        test = extension(path).isin(*endings)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def is_text(path: Column) -> Column:
    return language(path).isNotNull() | extension(path).isin(*TEXT_EXTENSIONS)


def is_test(path: Column) -> Column:
    """A test directory above the file, or a test's file name."""
    dirs = F.split(path, "/")
    name = basename(path)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in TEST_DIRS])) | name.startswith("test_") | name.rlike(r"(_test\.go$|\.test\.|\.spec\.)")


def is_vendor(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in VENDOR_DIRS]))


def is_walked(path: Column) -> Column:
    """No skipped directory on the way."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def file_kind(path: Column, test: Column) -> Column:
    """test, doc or config, or code."""
    return F.when(test, "test").when(extension(path).isin(*DOC_EXTENSIONS), "doc").when(language(path).isNull(), "config").otherwise("code")


def is_entrypoint(path: Column) -> Column:
    starts = F.lit(False)
    for p in ENTRY_PREFIXES:
        starts = starts | path.startswith(p)
    return basename(path).isin(*ENTRY_NAMES) | path.isin(*ENTRY_PATHS) | starts


def lines(text: Column) -> Column:
    """Lines as an array: a final newline adds none, a carriage return before a newline goes."""
    cut = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def line_slice(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (1-based, inclusive, clamped), joined again."""
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(all_lines))
    return F.when(first <= last, F.array_join(F.slice(all_lines, first, last - first + 1), "\n")).otherwise(F.lit(""))


def clip_bytes(text: Column, n: int) -> Column:
    """The longest prefix of whole characters within n bytes."""
    cut = F.rtrim(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")), F.lit("\ufffd"))
    return F.when(F.octet_length(text) <= n, text).otherwise(cut)


def clip_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def signature(snippet: Column) -> Column:
    """Trimmed first line, at most 300 characters."""
    return clip_chars(F.trim(F.element_at(F.split(snippet, "\n"), 1)), 300)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def like_insensitive(path: Column, value: str) -> Column:
    """SQL LIKE '%value%' that folds ASCII letters only; % and _ in the value stay wild."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(path).like("%" + re.sub("[A-Z]", lambda m: m[0].lower(), value) + "%")


def glob_regex(glob: str) -> str:
    """A regular expression for a glob with *, ?, ** and [sets]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*" if glob[i : i + 2] == "**" else "[^/]*"
            i += 2 if glob[i : i + 2] == "**" else 1
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = end + 1
            continue
        out += "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def path_matches(path: Column, query: str) -> Column:
    """A glob match (where the query has glob characters), or the query inside the path, whatever the case."""
    plain = F.lower(path).contains(query.replace("*", "").lower())
    return (path.rlike(glob_regex(query)) | plain) if any(c in query for c in "*?[") else plain


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal, halves up, in whole numbers."""
    t = F.floor((n + unit // 20) / (unit // 10)).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def format_count(n: Column) -> Column:
    """1.2M, 3.4K or the number."""
    return F.when(n >= 1_000_000, F.concat(_tenths(n, 1_000_000), F.lit("M"))).when(n >= 1_000, F.concat(_tenths(n, 1_000), F.lit("K"))).otherwise(n.cast("string"))


def format_duration(ms: Column) -> Column:
    return F.when(ms >= 60_000, F.format_string("%.1fm", ms / 60_000)).when(ms >= 1_000, F.format_string("%.1fs", ms / 1_000)).otherwise(F.concat(ms.cast("string"), F.lit("ms")))
