"""The map of a corpus: packages, entry points, routes, hubs, stack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract, graph

#: Fixed values: (label, manifest, text that the manifest holds, or none).
STACK = (
    ("Python", "pyproject.toml", None), ("Python", "requirements.txt", None), ("Node.js", "package.json", None), ("Go", "go.mod", None), ("Rust", "Cargo.toml", None), ("PHP", "composer.json", None),
    ("Django", "pyproject.toml", "django"), ("FastAPI", "pyproject.toml", "fastapi"), ("Flask", "requirements.txt", "flask"), ("React", "package.json", '"react"'), ("Next.js", "package.json", '"next"'),
    ("Vue", "package.json", '"vue"'), ("Express", "package.json", '"express"'), ("Axum", "Cargo.toml", "axum"), ("Actix", "Cargo.toml", "actix"), ("Gin", "go.mod", "gin-gonic"), ("Laravel", "composer.json", "laravel"), ("Symfony", "composer.json", "symfony"),
)


def packages(files: DataFrame) -> DataFrame:
    """By first path segment: files, the sole file's path or the segment, first path as evidence."""
    top = F.element_at(F.split("path", "/"), 1)
    g = files.groupBy(top.alias("name")).agg(F.count("*").alias("files"), F.min("path").alias("first_path"))
    return g.select("name", "files", F.when(F.col("files") == 1, F.col("first_path")).otherwise(F.col("name")).alias("path"), F.concat("first_path", F.lit(":1")).alias("evidence"))


def entrypoints(files: DataFrame) -> DataFrame:
    return files.where(T.is_entrypoint(F.col("path"))).select("path")


def file_links(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (src, dst) files of resolved edges."""
    s = symbols.select(F.col("symbol_id").alias("_s"), F.col("file_id").alias("dst"))
    return edges.join(s, F.col("dst_symbol_id") == F.col("_s")).select(F.col("file_id").alias("src"), "dst").where("src <> dst").distinct()


def indegree(links: DataFrame) -> DataFrame:
    """How many other files lead to each."""
    return links.groupBy("dst").agg(F.count("*").alias("indegree"))


def stack(files: DataFrame) -> DataFrame:
    """Labels of manifests and of what they hold, to a depth of three."""
    near = files.where(F.size(F.split("path", "/")) <= 4)
    made = None
    for label, manifest, marker in STACK:
        test = T.basename(F.col("path")) == manifest
        test = test if marker is None else test & F.contains("content", F.lit(marker))
        one = near.where(test).select(F.lit(label).alias("label"))
        made = one if made is None else made.unionByName(one)
    return made.distinct()


def one_liner(files: DataFrame) -> DataFrame:
    """The first paragraph of the README that is text, at most 300 characters."""
    readme = files.where(F.lower("path").isin("readme.md", "readme.txt", "readme")).orderBy("path").limit(1)
    paragraphs = F.filter(F.transform(F.split("content", r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: (p != "") & ~p.startswith("#"))
    return readme.select(T.clip_chars(F.element_at(paragraphs, 1), 300).alias("summary"), F.concat("path", F.lit(":1")).alias("evidence"))


def build(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The parts of the map, each a DataFrame."""
    nodes = files.select(F.col("file_id").alias("node"))
    links = file_links(edges, symbols)
    hubs = graph.hubs(nodes, links).join(files.select("file_id", "path"), F.col("node") == F.col("file_id")).select("path", "rank", "indegree")
    return {"packages": packages(files), "entrypoints": entrypoints(files), "routes": extract.routes(files), "hubs": hubs, "stack": stack(files), "identity": one_liner(files)}


def markdown(parts: dict[str, DataFrame], most: int = 200) -> str:
    """The map as text; empty sections are left out, long ones cut at ``most`` rows."""
    out = []
    for title, df in parts.items():
        rows = df.limit(most).collect()
        if rows:
            out += [f"## {title.capitalize()}", ""] + ["- " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items() if v is not None) for r in rows] + [""]
    return "\n".join(out)
