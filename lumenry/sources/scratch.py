"""Tables that cut lineage, in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows of a file, where the caller knows how many there are at most.
ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset a folder of this machine serves a session
    that runs on this machine alone; on a cluster that is an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_scopes: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in here go at the end, but for those to ``keep``; they go
    with the scope around, if there is one."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            remove(spark, path)


def cut_lineage(df: DataFrame, name: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """df, written and read again.  With ``rows``, about how many there are, small results go
    to few files: two tasks a core at least, so that what computes them runs side by side."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
