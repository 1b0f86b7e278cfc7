"""Streams: change events, metrics queues, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANGE = "path string, kind string, at timestamp"
METRIC = (
    "event_id string, created_at timestamp, project string, kind string, harness string, model string, query_hash string, "
    "input_tokens long, cached_input_tokens long, output_tokens long, saved_input_tokens long, duration_ms long, cache_hit boolean"
)
REQUEST = "requested_at timestamp, force boolean"


def changes(spark: SparkSession, landing: str, files_per_trigger: int = 1000) -> DataFrame:
    """Change events from a landing folder of JSON lines; artefact paths are dropped."""
    raw = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).json(landing)
    return raw.where("path is not null and not startswith(path, '.lumenry/') and kind <> 'access'")


def metric_queue(spark: SparkSession, landing: str) -> DataFrame:
    """Metric events once each, as far back as the watermark reaches."""
    return spark.readStream.schema(METRIC).json(landing).withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def enqueue(events: DataFrame, landing: str) -> None:
    """Append events as new JSON files."""
    events.write.mode("append").json(landing)


def drain(queue: DataFrame, table: str, checkpoint: str):
    """Append a metric stream to a Parquet table until the queue is empty."""
    return queue.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindex_requests(spark: SparkSession, landing: str, checkpoint: str, run: Callable[[bool], None]):
    """Call run(force) once for each micro-batch of requests; force if any asks for it."""

    def each(batch: DataFrame, _: int) -> None:
        row = batch.agg(F.count("*").alias("n"), F.bool_or("force").alias("force")).first()
        if row["n"]:
            run(bool(row["force"]))

    return spark.readStream.schema(REQUEST).json(landing).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(events: DataFrame, checkpoint: str, apply: Callable[[DataFrame, bool], None], *, overflow: int = 16_384, once: bool = True):
    """Apply coalesced changes: apply(paths, full), full if too many came or a rescan is asked
    for.  A batch that fails is replayed from the checkpoint."""

    def each(batch: DataFrame, _: int) -> None:
        paths = batch.select("path").distinct()
        row = batch.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("kind") == "rescan"), F.lit(False)).alias("rescan")).first()
        if row["n"]:
            apply(paths, bool(row["rescan"]) or row["n"] > overflow)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()


def bursts(events: DataFrame, key: str, at: str, gap_seconds: float) -> DataFrame:
    """Runs of a key's events without a gap: (key, burst, start, end, n), as a batch."""
    w = Window.partitionBy(key).orderBy(at)
    stamp = F.col(at).cast("timestamp").cast("double")
    fresh = F.coalesce((stamp - F.lag(stamp).over(w) > gap_seconds).cast("int"), F.lit(1))
    runs = events.withColumn("_fresh", fresh).withColumn("burst", F.sum("_fresh").over(w))
    return runs.groupBy(key, "burst").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def tumbling(events: DataFrame, at: str, width: str, late: str | None = None) -> DataFrame:
    rows = events if late is None else events.withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, late: str | None = None) -> DataFrame:
    rows = events if late is None else events.withWatermark(at, late)
    return rows.groupBy(F.window(at, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    rows = events if late is None else events.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
