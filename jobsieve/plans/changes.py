"""Queries that change stored tables, keep caches and read semi-structured fields, and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.operators import store
from jobsieve.plans.gate import NOW
from jobsieve.session import shared_folder
from jobsieve.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _at(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


@query(f"SELECT application_id, CASE WHEN status = 'saved' THEN 'applied' ELSE status END AS status, CASE WHEN status = 'saved' THEN TIMESTAMP '{NOW}' ELSE applied_at END AS applied_at, CASE WHEN status = 'saved' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM applications")
def status_change(spark: SparkSession, d: str) -> DataFrame:
    """Saved applications become applied ones; the time of applying is set with that status only."""
    return store.change_status(table(spark, d, "applications"), F.col("status") == "saved", "applied", _at()).select("application_id", "status", "applied_at", "updated_at")


@query("""
WITH o AS (SELECT DISTINCT coalesce(profile_slug, '') AS slug, unnest(tags) AS skill FROM jobs WHERE job_id % 2 = 0), n AS (SELECT DISTINCT coalesce(profile_slug, '') AS slug, lower(trim(unnest(tags))) AS skill FROM jobs WHERE job_id % 2 = 1 AND profile_slug = 'default')
SELECT slug, skill FROM o WHERE slug <> 'default' AND skill IS NOT NULL UNION SELECT slug, skill FROM n WHERE skill <> ''""")
def skills_replaced(spark: SparkSession, d: str) -> DataFrame:
    """All skills of one profile replaced by a new list, in lower case; other profiles keep theirs."""
    rows = lambda c: table(spark, d, "jobs").where(c).select(F.coalesce("profile_slug", F.lit("")).alias("slug"), F.explode("tags").alias("skill")).distinct()
    new = rows("job_id % 2 = 1 and profile_slug = 'default'").select("slug", F.lower(F.trim("skill")).alias("skill")).where("skill <> ''")
    return store.replace_group(rows("job_id % 2 = 0").where("skill is not null"), new, "slug", ["default"]).distinct()


@query("""
WITH o AS (SELECT job_id, company, location, salary FROM jobs WHERE job_id % 3 <> 0), n AS (SELECT job_id, company, location FROM jobs WHERE job_id % 3 = 1 UNION ALL SELECT job_id, company, location FROM jobs WHERE job_id % 3 = 0)
SELECT coalesce(o.job_id, n.job_id) AS job_id, CASE WHEN n.job_id IS NOT NULL THEN n.company ELSE o.company END AS company, CASE WHEN n.job_id IS NOT NULL THEN n.location ELSE o.location END AS location, o.salary FROM o FULL OUTER JOIN n ON o.job_id = n.job_id""")
def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rows merged by key: only the columns that the change has are set, the others stay as they are."""
    jobs = table(spark, d, "jobs").select("job_id", "company", "location", "salary")
    return store.merge_columns(jobs.where("job_id % 3 <> 0"), jobs.where("job_id % 3 <> 2").select("job_id", "company", "location"), "job_id")


@query("""
WITH s AS (SELECT quality.normalized_url AS k, * FROM jobs WHERE quality.normalized_url IS NOT NULL), o AS (SELECT k, arg_max(title, job_id) AS title, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, max(job_id) AS job_id FROM s WHERE job_id % 4 <> 0 GROUP BY k), n AS (SELECT k, arg_max(title, job_id) AS title FROM s WHERE job_id % 4 = 0 GROUP BY k)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(o.first_seen_at, TIMESTAMP '2025-06-01') AS first_seen_at, CASE WHEN n.k IS NOT NULL THEN TIMESTAMP '2025-06-01' ELSE o.last_seen_at END AS last_seen_at, n.k IS NOT NULL AS active FROM o FULL OUTER JOIN n ON o.k = n.k""")
def upsert_reactivates(spark: SparkSession, d: str) -> DataFrame:
    """Postings seen again are active and have a new last sight; what was seen first stays; the old ones here were inactive."""
    rows = table(spark, d, "jobs").select(F.col("quality.normalized_url").alias("k"), "job_id", "title", "first_seen_at", "last_seen_at").where("k is not null")
    old = rows.where("job_id % 4 <> 0").groupBy("k").agg(F.max_by("title", "job_id").alias("title"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")).withColumn("active", F.lit(False))
    new = rows.where("job_id % 4 = 0").groupBy("k").agg(F.max_by("title", "job_id").alias("title"))
    return store.seen_again(old, new, "k", ["title"], _at())


@query("SELECT job_id, EXISTS (SELECT 1 FROM dismissed_jobs x WHERE x.job_id = j.job_id) AS dismissed, EXISTS (SELECT 1 FROM applications a WHERE a.job_id = j.job_id) AS applied FROM jobs j")
def exists_flags(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda t, name: table(spark, d, t).select("job_id").where("job_id is not null").distinct().withColumn(name, F.lit(True))
    jobs = table(spark, d, "jobs").select("job_id").join(mark("dismissed_jobs", "dismissed"), "job_id", "left").join(mark("applications", "applied"), "job_id", "left")
    return jobs.select("job_id", F.coalesce("dismissed", F.lit(False)).alias("dismissed"), F.coalesce("applied", F.lit(False)).alias("applied"))


RENAMED = {"title": "headline", "company": "employer", "location": "place", "not_there": "nothing"}


@query("SELECT job_id, title AS headline, company AS employer, location AS place FROM jobs")
def renamed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Only the columns of a list, under other names; those that a table lacks are left out."""
    return store.renamed(table(spark, d, "jobs"), ["job_id"], RENAMED)


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END, '$.k') AS BIGINT), -1) AS k FROM (SELECT event_id, props FROM events WHERE event_id % 10 <> 0) UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 10 = 0")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A number out of JSON text, a default where the text is broken (every tenth is broken here)."""
    raw = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json(raw, "k long")["k"], F.lit(-1)).alias("k"))


@query("SELECT job_id, array_to_string(list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t <> ''), '|') AS items FROM jobs")
def list_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Lists written as JSON or with commas come out alike (every second one is written the other way here)."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    written = F.when(F.col("job_id") % 2 == 0, F.to_json(tags)).otherwise(F.array_join(tags, " , "))
    return table(spark, d, "jobs").select("job_id", F.array_join(store.as_list(written), "|").alias("items"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 3 = 0 AND c.doc_id = d.doc_id AND md5(coalesce(c.text, '')) = md5(coalesce(d.text, '') || CASE WHEN d.doc_id % 9 = 0 THEN '+' ELSE '' END))")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that are new or whose content is another than the cache knows; a third is cached, a ninth changed since."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cache = docs.where("doc_id % 3 = 0").select("doc_id", F.md5("text").alias("digest"))
    now = docs.select("doc_id", F.md5(F.concat("text", F.when(F.col("doc_id") % 9 == 0, "+").otherwise(""))).alias("digest"))
    return store.changed(now, cache, ["doc_id", "digest"]).select("doc_id")


@query("SELECT source, coalesce(TIMESTAMP '2024-06-01' - max(scraped_at) < INTERVAL 24 HOUR, false) AS valid FROM jobs WHERE source IS NOT NULL GROUP BY source")
def cache_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("source is not null").groupBy("source").agg(store.still_valid(F.max("scraped_at"), _at("2024-06-01"), 24).alias("valid"))


@query("SELECT job_id, title, company, url FROM jobs")
def json_cache(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON and read back with their schema."""
    rows = table(spark, d, "jobs").select("job_id", "title", "company", "url")
    path = f"{shared_folder(spark)}/cache-{uuid4().hex}"
    rows.write.json(path, ignoreNullFields=False)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT engine, ts, least(20.0::DOUBLE, 1.5::DOUBLE * pow(2, n)) AS seconds FROM (SELECT engine, ts, row_number() OVER (PARTITION BY engine, date_trunc('hour', ts) ORDER BY ts) - 1 AS n FROM (SELECT DISTINCT engine, ts FROM engine_calls WHERE call_kind = 'limit'))")
def backoff_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Waiting times that double with every limit of an engine within an hour, up to a cap."""
    from pyspark.sql import Window as W

    calls = table(spark, d, "engine_calls").where("call_kind = 'limit'").select("engine", "ts").distinct()
    n = F.row_number().over(W.partitionBy("engine", F.date_trunc("hour", "ts")).orderBy("ts")) - 1
    return calls.select("engine", "ts", F.least(F.lit(20.0), 1.5 * F.pow(F.lit(2.0), n)).alias("seconds"))


@query("SELECT job_id, array_to_string(list_sort(list_distinct(list_transform(string_split(coalesce(title, ''), ' '), lambda w: lower(w)))), ' ') AS words FROM jobs")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of a title, whatever their case."""
    return table(spark, d, "jobs").select("job_id", F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(F.coalesce("title", F.lit("")), " "), F.lower))), " ").alias("words"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
