"""Incremental ingestion of postings: each micro-batch is checked, deduplicated by URL and merged into a stored table."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.functions.urls import is_listing_page, is_people_page, normalize_url

UPDATE, KEEP = ["title", "company", "last_seen_at", "job_id"], ["first_seen_at"]


def prepare(batch: DataFrame) -> DataFrame:
    """One row per normalised URL, the best by time and id; people's and listing pages and rows without a URL are dropped."""
    rows = batch.select(normalize_url(F.col("url")).alias("url"), "title", "company", "scraped_at", "job_id").where("url <> ''").where(~is_people_page(F.col("url")) & ~is_listing_page(F.col("title"), F.col("url")))
    best = rows.groupBy("url").agg(F.max_by(F.struct("title", "company", "job_id"), F.struct("scraped_at", "job_id")).alias("r"), F.max("scraped_at").alias("last_seen_at"), F.min("scraped_at").alias("first_seen_at"))
    return best.select("url", "r.title", "r.company", "last_seen_at", "r.job_id", "first_seen_at")


def latest_wins(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and new rows as one row per URL: the later by time and id, first seen at the earlier time; batches may come in any order."""
    both = old.unionByName(fresh).groupBy("url").agg(F.max_by(F.struct("title", "company", "job_id"), F.struct("last_seen_at", "job_id")).alias("r"), F.max("last_seen_at").alias("last_seen_at"), F.min("first_seen_at").alias("first_seen_at"))
    return both.select("url", "r.title", "r.company", "last_seen_at", "r.job_id", "first_seen_at")


class Store:
    """A table in versions: every merge writes a new version and then moves the pointer, so that a failed merge changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.version: str | None = None

    def read(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(self.version)

    def merge(self, batch: DataFrame, batch_id: int = 0) -> None:
        fresh = prepare(batch)
        old = self.read()
        merged = fresh if old is None else latest_wins(old, fresh)
        target = os.path.join(self.path, f"v{batch_id}-{uuid4().hex[:8]}")
        merged.select("url", *UPDATE, *KEEP).write.parquet(target)
        self.version = target


def ingest(spark: SparkSession, source: str, schema, store: Store, checkpoint: str) -> DataFrame:
    """Read all files of a folder as a stream, merge batch by batch, and return the stored table."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(store.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event-time window, for a stream; rows later than the watermark are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def run_windows(spark: SparkSession, source: str, schema, ts: str, key: str, window: str, late: str, folder: str, files_each: int = 1) -> DataFrame:
    """The windows of a folder of files read as a stream to its end, so many files at a time; of a window that several batches changed the last state counts."""
    stream = windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source), ts, key, window, late)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/windows/batch={batch_id}/rows")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(f"{folder}/windows/*/rows")
    return states.groupBy("start", key).agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("start", key, "x.n", "x.total")
