"""Relations of a corpus: files and their contents, from trees or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Bytes of a file that is searched as text, and of one that is parsed.
MAX_TEXT, MAX_STRUCTURE = 64 << 20, 1 << 20
EXCERPT_BYTES = 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as files: path lang/source/doc_id.txt; one source stands for tests, one for vendored code."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        "lang", F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"),
        (F.col("source") == "src3").alias("is_test"), (F.col("source") == "src7").alias("is_vendor"),
    )


def relative(path: Column, root: str) -> Column:
    """A file URI below root as a relative path with forward slashes."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"^[a-z]+:/+", "/")), "^" + root.rstrip("/").replace(".", r"\.") + "/+", "")


def walk(spark: SparkSession, root: str, *, ignore: tuple[str, ...] = (), max_bytes: int = MAX_TEXT) -> DataFrame:
    """Files below root that may be indexed: (path, size, mtime, too_large).  Spark's
    file sources pass over empty files.

    The content column is not read.  ignore: globs of paths left out, as an
    ignore file lists them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = raw.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    keep = T.is_walked(F.col("path"))
    for g in ignore:
        keep = keep & ~F.col("path").rlike(T.glob_regex(g)) & ~F.col("path").startswith(g.rstrip("/") + "/") & (T.basename(F.col("path")) != g)
    return files.where(keep).withColumn("too_large", F.col("size") > max_bytes)


def read_tree(spark: SparkSession, root: str, *, ignore: tuple[str, ...] = (), max_bytes: int = MAX_TEXT) -> DataFrame:
    """files ⋈ contents of a tree: binary files (a NUL inside) and too large ones are
    left out, bytes that are not UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = relative(F.col("path"), root)
    keep = T.is_walked(path) & (F.col("length") <= max_bytes) & (F.instr(F.col("content").cast("string"), "\0") == 0)
    for g in ignore:
        keep = keep & ~path.rlike(T.glob_regex(g)) & ~path.startswith(g.rstrip("/") + "/") & (T.basename(path) != g)
    rows = raw.where(keep).select(
        path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        F.sha1("content").alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
    p = F.col("path")
    return rows.select(
        F.xxhash64("path").alias("file_id"), "path", T.language(p).alias("lang"), "size", "mtime", "content_hash",
        T.is_test(p).alias("is_test"), T.is_vendor(p).alias("is_vendor"), "content", F.struct(F.col("size").alias("length"), "mtime").alias("version"),
    )


def excerpt(content: Column) -> Column:
    return T.clip_bytes(content, EXCERPT_BYTES)


def by_path(files: DataFrame, path: str) -> DataFrame:
    """Point lookup; Parquet statistics prune what cannot hold the path."""
    return files.where(F.col("path") == path)


def find_files(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Files by glob or part of their path, in path order."""
    return files.where(T.path_matches(F.col("path"), query)).orderBy("path").limit(limit)
