"""Queries that run streams or folds to their end over the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.session import shared_folder
from jobsieve.plans import duck
from jobsieve.streaming import breaker, ingest
from jobsieve.tables import table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid4().hex}"


def breaker_fold(spark: SparkSession, d: str) -> DataFrame:
    return breaker.fold(table(spark, d, "engine_calls"))


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    return breaker_fold(spark, d).groupBy("engine", "state").agg(F.count("*").alias("calls"), F.count_if(~F.coalesce("allowed", F.lit(True))).alias("refused"))


def breaker_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return breaker.snapshot(breaker_fold(spark, d), SNAPSHOT)


def microbatch_ingest(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs")
    folder = _folder(spark)
    jobs.select("job_id", "url", "title", "company", "scraped_at").write.option("maxRecordsPerFile", 50_000).parquet(f"{folder}/landed")
    store = ingest.Store(spark, f"{folder}/store")
    landed = spark.read.parquet(f"{folder}/landed")
    return ingest.ingest(spark, f"{folder}/landed", landed.schema, store, f"{folder}/progress").select("url", "job_id", "first_seen_at", "last_seen_at")


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows over the events, landed in four files and read one file at a time; the watermark waits longer than any event is late."""
    folder = _folder(spark)
    events = table(spark, d, "events").select("ts", "event_type", "value")
    events.repartition(4).write.parquet(f"{folder}/landed")
    landed = spark.read.parquet(f"{folder}/landed").schema
    return ingest.run_windows(spark, f"{folder}/landed", landed, "ts", "event_type", "1 hour", "3650 days", folder).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict:
    return {"breaker_fold": breaker_fold, "breaker_states": breaker_states, "breaker_snapshot": breaker_snapshot, "microbatch_ingest": microbatch_ingest, "stream_window_counts": stream_window_counts}


SNAPSHOT = 1714608000.0
_FOLD = """
WITH RECURSIVE c AS (SELECT engine, ts, call_kind, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY engine ORDER BY ts, call_kind) AS rn FROM (SELECT DISTINCT engine, ts, call_kind FROM engine_calls WHERE engine IS NOT NULL AND ts IS NOT NULL AND call_kind IN ('query', 'success', 'limit'))),
f(engine, rn, ts, call_kind, allowed, state, until, limits, probing) AS (
  SELECT DISTINCT engine, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), 'closed', 0.0::DOUBLE, 0, false FROM c
  UNION ALL
  SELECT c.engine, c.rn, c.ts, c.call_kind,
    CASE WHEN c.call_kind = 'query' THEN CASE f.state WHEN 'open' THEN f.until <= c.now WHEN 'half-open' THEN NOT f.probing ELSE true END END,
    CASE c.call_kind WHEN 'query' THEN CASE WHEN f.state = 'open' AND f.until <= c.now THEN 'half-open' ELSE f.state END WHEN 'success' THEN 'closed' ELSE CASE WHEN f.state = 'half-open' OR f.limits + 1 >= 2 THEN 'open' ELSE f.state END END,
    CASE c.call_kind WHEN 'success' THEN 0 WHEN 'limit' THEN CASE WHEN f.state = 'half-open' OR f.limits + 1 >= 2 THEN c.now + least(300, 120 * pow(2, least(60, greatest(0, f.limits - 1)))) ELSE f.until END ELSE f.until END,
    CASE c.call_kind WHEN 'success' THEN 0 WHEN 'limit' THEN f.limits + 1 ELSE f.limits END,
    CASE c.call_kind WHEN 'query' THEN f.probing OR f.state = 'half-open' OR (f.state = 'open' AND f.until <= c.now) ELSE false END
  FROM f JOIN c ON c.engine = f.engine AND c.rn = f.rn + 1),
r AS (SELECT engine, ts, call_kind, allowed, state, until AS blocked_until FROM f WHERE rn > 0)"""


def oracle_sql() -> dict[str, str]:
    url = duck.normal_url("url")
    return {
        "breaker_fold": _FOLD + " SELECT * FROM r",
        "breaker_states": _FOLD + " SELECT engine, state, count(*) AS calls, CAST(sum(CASE WHEN NOT coalesce(allowed, true) THEN 1 ELSE 0 END) AS BIGINT) AS refused FROM r GROUP BY engine, state",
        "breaker_snapshot": _FOLD + f", l AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts DESC, call_kind DESC) AS rn FROM r) SELECT engine, state, CASE WHEN state = 'open' THEN greatest(0, blocked_until - {SNAPSHOT}) ELSE 0 END AS seconds_left FROM l WHERE rn = 1",
        "microbatch_ingest": f"WITH u AS (SELECT {url} AS url, job_id, title, scraped_at FROM jobs), k AS (SELECT * FROM u WHERE url <> '' AND NOT {duck.people_page('url')} AND NOT {duck.listing_page('title', 'url')}) SELECT url, arg_max(job_id, struct_pack(a := scraped_at, b := job_id)) AS job_id, min(scraped_at) AS first_seen_at, max(scraped_at) AS last_seen_at FROM k GROUP BY url",
        "stream_window_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }
