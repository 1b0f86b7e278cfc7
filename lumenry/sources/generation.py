"""Immutable generations of tables, published by one small pointer.

A generation is a directory of Parquet tables.  Writers build a new one beside
the current and then replace the pointer; readers resolve the pointer once and
keep a consistent snapshot.  A failed build leaves the pointer as it was.  All
file access goes through Hadoop's FileSystem, so any store will do.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = "1"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- pointer ----------------------------------------------------------------------
    def manifest(self) -> dict:
        """The current manifest, or an empty one."""
        p = self._path(f"{self.root}/MANIFEST")
        if not self.fs.exists(p):
            return {"generation": None, "previous": None, "meta": {}}
        stream = self.fs.open(p)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        fresh = self._path(f"{self.root}/.MANIFEST-{uuid.uuid4().hex}")
        out = self.fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"{self.root}/MANIFEST")
        if not self.fs.rename(fresh, target):  # stores whose rename does not replace
            self.fs.delete(target, False)
            if not self.fs.rename(fresh, target):
                raise OSError(f"cannot publish {target}")

    # -- tables -----------------------------------------------------------------------
    def write(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> str:
        """Build and publish a generation; the one before stays readable."""
        now = self.manifest()
        name = f"gen-{uuid.uuid4().hex}"
        try:
            for table, df in tables.items():
                df.write.parquet(f"{self.root}/{name}/{table}")
        except Exception:
            self.fs.delete(self._path(f"{self.root}/{name}"), True)
            raise
        self._publish({"generation": name, "previous": now["generation"], "tables": sorted(tables), "meta": (meta or {}) | {"schema_version": SCHEMA_VERSION}})
        self.collect_garbage()
        return name

    def read(self, table: str, generation: str | None = None) -> DataFrame:
        name = generation or self.manifest()["generation"]
        if name is None:
            raise FileNotFoundError(f"{self.root} has no generation")
        return self.spark.read.parquet(f"{self.root}/{name}/{table}")

    def collect_garbage(self) -> list[str]:
        """Delete generations other than the current and the one before."""
        m = self.manifest()
        gone = []
        for status in self.fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("gen-") and name not in (m["generation"], m["previous"]):
                self.fs.delete(status.getPath(), True)
                gone.append(name)
        return gone


# ---- maintenance of tables -----------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of old with their key; of several new ones the last version stays."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and rows of new whose key is not there yet, one a key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def delete_cascade(removed: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the rows of removed files."""
    ids = removed.select("file_id").distinct()
    return {n: t.join(ids, "file_id", "left_anti") for n, t in tables.items()}


def changed(previous: DataFrame, current: DataFrame, *, force: bool = False, touched: str | None = None) -> DataFrame:
    """Rows of current that are new or differ in size, time (to a microsecond) or content."""
    p = previous.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    j = current.join(p, F.col("path") == F.col("_path"), "left")
    test = F.col("_path").isNull() | (F.col("size") != F.col("_size")) | (F.abs(F.col("mtime").cast("double") - F.col("_mtime").cast("double")) > 1e-6)
    test = F.lit(True) if force else test
    if touched is not None:
        test = test | F.col("path").startswith(touched)
    return j.where(test).drop("_path", "_size", "_mtime")


def removed(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.join(current.select("path"), "path", "left_anti")


def path_differences(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that only one of two states has."""
    a, b = previous.select("path"), current.select("path")
    return a.join(b, "path", "left_anti").unionByName(b.join(a, "path", "left_anti")).distinct()


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of some tables."""
    made = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, made)


def same_content(previous: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(only metadata changed, content changed), by digest."""
    p = previous.select(F.col("path").alias("_p"), F.col("content_hash").alias("_h"))
    j = some.join(p, F.col("path") == F.col("_p"), "left").withColumn("_same", F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False))).drop("_p", "_h")
    return j.where("_same").drop("_same"), j.where("not _same").drop("_same")


def stale(live: DataFrame, indexed: DataFrame) -> DataFrame:
    """Paths that only one side has, or whose size differs."""
    i = indexed.select(F.col("path").alias("_path"), F.col("size").alias("_size"))
    j = live.select("path", "size").join(i, F.col("path") == F.col("_path"), "full_outer")
    state = F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "removed").when(F.col("size") != F.col("_size"), "changed")
    return j.select(F.coalesce("path", "_path").alias("path"), state.alias("state")).where("state is not null")


def state_digest(files: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 over paths and hashes in path order, of each group."""
    rows = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws("|", r["path"], r["content_hash"])), "\n")
    return files.groupBy(*by).agg(F.sha2(text, 256).alias("digest"), F.count("*").alias("files"))
