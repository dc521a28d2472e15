"""Queries that read raw payloads as sources land them. The payloads are built from the postings, fifty in each, and must give them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.plans import duck
from jobsieve.sources import postings as P
from jobsieve.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TYPES = ["Werkstudent", "Planer", "Junior", "Team"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def payloads(spark: SparkSession, d: str, item: Column, wrap: str | None = None, first: str = "") -> DataFrame:
    """(slug, raw): arrays of fifty items as JSON, under a name if wrap gives one."""
    rows = table(spark, d, "jobs").where("job_id is not null").select(F.floor(F.col("job_id") / 50).alias("p"), "job_id", item.alias("i"))
    lists = rows.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("job_id", "i")))["i"].alias("items"))
    text = F.to_json("items") if wrap is None else F.to_json(F.struct(F.col("items").alias(wrap)))
    if first:
        text = F.concat(F.lit("[" + first + ","), F.substring(text, 2, 2_000_000_000))
    return lists.select(F.concat(F.lit("team-"), F.col("p").cast("string")).alias("slug"), text.alias("raw"))


def _brief(df: DataFrame) -> DataFrame:
    return df.select("title", "company", "location", "url", F.md5(F.coalesce("description", F.lit(""))).alias("description"), "posted_date", "job_type")


def _type_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({text}), {duck.text(t.lower())}) THEN {duck.text(t)}" for t in TYPES) + " END"


_OF = "'team-' || (job_id // 50)"


@query(f"""SELECT {duck.cleaned('title')} AS title, company, location, url, md5({duck.cleaned("coalesce(description, '')")}) AS description, posted_date, {_type_sql("coalesce(title, '') || ' ' || coalesce(description, '')")} AS job_type FROM jobs WHERE title <> '' AND url <> ''""")
def board_payloads(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("title", F.col("company").alias("company_name"), "location", "url", "description", F.col("posted_date").alias("created_at"), "tags")
    return _brief(P.board_json(payloads(spark, d, item, "data"), "board", types=TYPES))


@query(f"""SELECT {duck.cleaned('title')} AS title, upper('t') || 'eam ' || (job_id // 50) AS company, location, url, md5({duck.cleaned("coalesce(description, '')")}) AS description, posted_date, CAST(NULL AS VARCHAR) AS job_type FROM jobs""")
def applicant_payloads(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("title", F.col("url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"), F.col("description").alias("content"), F.col("posted_date").alias("updated_at"))
    return _brief(P.applicant_system_json(payloads(spark, d, item, "jobs"), "applicants"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_OF}, job_id) AS rn FROM jobs WHERE title <> '' AND url <> '')
SELECT title, 'Team ' || (job_id // 50) AS company, location, url, md5(coalesce(description, '')) AS description, strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS posted_date, {_type_sql("title || ' ' || coalesce(description, '')")} AS job_type FROM r WHERE rn = 1""")
def epoch_payloads(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.struct("location").alias("categories"), F.col("description").alias("descriptionPlain"), F.unix_millis(F.col("scraped_at").cast("timestamp")).alias("createdAt"))
    return _brief(P.epoch_board_json(payloads(spark, d, item), "epochs", types=TYPES))


_PLACE = "trim(concat_ws(', ', nullif(location, ''), 'DE'))"


@query(f"""
SELECT title, 'Team-' || (job_id // 50) AS company, {_PLACE} AS location, url, md5(concat_ws(chr(10), company, description, salary)) AS description, posted_date, CAST(NULL AS VARCHAR) AS job_type FROM jobs
WHERE url <> '' AND (regexp_matches(lower(concat_ws(' ', title, {_PLACE})), 'turmenauen|remote|germany') OR regexp_matches(lower(concat_ws(' ', title, {_PLACE})), 'planer|consultant'))""")
def sectioned_payloads(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text")))
    sections = F.struct(text("company").alias("companyDescription"), text("description").alias("jobDescription"), text("salary").alias("qualifications"))
    item = F.struct(F.col("title").alias("name"), F.col("url").alias("ref"), F.struct(F.col("location").alias("city"), F.lit("DE").alias("country")).alias("location"), F.col("posted_date").alias("releasedDate"), F.struct(sections.alias("sections")).alias("jobAd"))
    return _brief(P.sectioned_board_json(payloads(spark, d, item, "content"), "sections", "Turmenauen", ["Planer", "Consultant"]))


@query("""
SELECT trim(title) AS title, trim(company) AS company, '12345 ' || location AS location, CASE WHEN job_id % 3 = 0 THEN url ELSE 'https://agency.example/jobs?id=' || job_id END AS url,
 md5(concat_ws(' | ', 'Beruf: ' || nullif(job_type, ''), CASE WHEN len(tags) > 0 THEN 'Arbeitszeit: ' || array_to_string(tags, ', ') END, 'Branche: ' || nullif(source, ''))) AS description, nullif(posted_date, '') AS posted_date, CAST(NULL AS VARCHAR) AS job_type
FROM jobs WHERE trim(title) <> '' AND location IS NOT NULL AND NOT (job_id % 3 = 0 AND coalesce(url, '') = '')""")
def agency_payloads(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("job_id") % 3 == 0
    item = F.struct(
        F.col("title").alias("titel"), F.col("company").alias("arbeitgeber"), F.struct(F.col("location").alias("ort"), F.lit("12345").alias("plz")).alias("arbeitsort"), F.when(~third, F.col("job_id").cast("string")).alias("refnr"), F.when(third, F.col("url")).alias("externeUrl"),
        F.col("posted_date").alias("aktuelleVeroeffentlichungsdatum"), F.col("job_type").alias("beruf"), F.col("tags").alias("arbeitszeitmodelle"), F.col("source").alias("branche"),
    )
    read = P.agency_json(payloads(spark, d, item, "stellenangebote"), "agency")
    return _brief(read.where("location <> '12345'"))


@query("""
SELECT trim(title) AS title, trim(company) AS company, coalesce(nullif(location, ''), 'Remote') AS location, 'https://remote.example/job/' || job_id AS url, md5(coalesce(description, '')) AS description, strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS posted_date, 'Remote' AS job_type FROM jobs WHERE trim(title) <> ''""")
def remote_payloads(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("title").alias("position"), "company", F.concat(F.lit("/job/"), F.col("job_id").cast("string")).alias("url"), "description", "tags", F.unix_seconds(F.col("scraped_at").cast("timestamp")).alias("epoch"), "location")
    return _brief(P.remote_list_json(payloads(spark, d, item, first='{"legal": "notice"}'), "remote", "https://remote.example"))


@query(r"""
WITH r AS (SELECT string_split(title, ' - ') AS p, title, url, description FROM (SELECT coalesce(title, '') || ' - ' || coalesce(company, '') AS title, url, description FROM jobs WHERE url IS NOT NULL))
SELECT trim(array_to_string(p[1:len(p) - 1], ' - ')) AS title, trim(p[-1]) AS company, CAST(NULL AS VARCHAR) AS location, url, md5(coalesce(description, '')) AS description, CAST(NULL AS VARCHAR) AS posted_date, CAST(NULL AS VARCHAR) AS job_type FROM r""")
def search_titles(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "jobs").where("url is not null").select(F.concat(F.coalesce("title", F.lit("")), F.lit(" - "), F.coalesce("company", F.lit(""))).alias("title"), "url", F.col("description").alias("snippet"))
    return _brief(P.search_results(found, "search"))


@query(f"""
SELECT trim(split_part(t, ' | ', 1)) AS title, trim(split_part(t, ' | ', 2)) AS company, CAST(NULL AS VARCHAR) AS location, 'https://feed.example/' || job_id AS url, md5({duck.cleaned("d")}) AS description, '2024-05-01' AS posted_date, CAST(NULL AS VARCHAR) AS job_type
FROM (SELECT job_id, 'Stelle ' || job_id || ' | Firma ' || (job_id % 17) AS t, 'Text &amp; ' || job_id AS d FROM jobs)""")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("job_id").cast("string")
    xml = F.concat(F.lit("<item><title>Stelle "), n, F.lit(" | Firma "), (F.col("job_id") % 17).cast("string"), F.lit("</title><link>https://feed.example/"), n, F.lit("</link><description>Text &amp;amp; "), n, F.lit("</description><pubDate>2024-05-01</pubDate></item>"))
    return _brief(P.feed_xml(table(spark, d, "jobs").select(xml.alias("raw")), "feed"))


@query("""
SELECT 'Senior Planner ' || job_id AS title, 'Firma' AS company, CAST(NULL AS VARCHAR) AS location, 'https://firma.example/jobs/senior-planner-' || job_id || '?a=1&b=2' AS url, md5('') AS description, '2024-05-01' AS posted_date, CAST(NULL AS VARCHAR) AS job_type FROM jobs WHERE job_id % 2 = 0""")
def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("job_id").cast("string")
    path = F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("/jobs/senior-planner-"), n, F.lit("?a=1&amp;b=2"))).otherwise(F.concat(F.lit("/blog/jobs-"), n))
    entry = F.concat(F.lit("<url><loc> https://firma.example"), path, F.lit("</loc><lastmod>2024-05-01</lastmod></url>"))
    maps = table(spark, d, "jobs").select(F.floor(F.col("job_id") / 50).alias("p"), entry.alias("e")).groupBy("p").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("e"), ""), F.lit("</urlset>")).alias("raw"))
    return _brief(P.sitemap_xml(maps, "sitemap"))


@query("SELECT 'https://x.example/map-' || source || '.xml?a=1&b=2' AS loc FROM feeds")
def sitemap_children(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit("<sitemap><loc>https://x.example/map-"), "source", F.lit(".xml?a=1&amp;b=2</loc></sitemap>"))
    return P.sitemap_index(table(spark, d, "feeds").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</sitemapindex>")).alias("raw")))


@query("SELECT 'Planer ' || job_id AS title, 'Firma' AS company, 'Ort' AS location, 'https://firma.example/' || job_id AS url, md5('Text') AS description, '2024-05-01' AS posted_date, 'FULL_TIME' AS job_type FROM jobs")
def jsonld_pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("job_id").cast("string")
    item = F.concat(F.lit('{"@type": "JobPosting", "title": "Planer '), n, F.lit('", "url": "https://firma.example/'), n, F.lit('", "description": "<p>Text</p>", "datePosted": "2024-05-01", "employmentType": "FULL_TIME", "hiringOrganization": {"name": "Firma"}, "jobLocation": {"address": {"addressLocality": "Ort"}}}'))
    script = F.when(F.col("job_id") % 2 == 0, item).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    return _brief(P.page_jsonld(table(spark, d, "jobs").select(F.concat(F.lit('<html><script type="application/ld+json">'), script, F.lit("</script></html>")).alias("raw")), "pages"))


@query("SELECT job_id, location IS NULL OR location = '' OR regexp_matches(lower(location), 'münchen|munich|muenchen|germany|deutschland|remote|dach') AS here FROM jobs")
def city_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", P.in_city(F.col("location"), "München").alias("here"))


@query("SELECT job_id FROM jobs WHERE contains(lower(concat_ws(' ', location, title)), 'turmenauen') OR contains(lower(concat_ws(' ', title, description, array_to_string(coalesce(tags, []), ' '))), 'statistik')")
def city_or_keyword(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_postings(table(spark, d, "jobs"), "Turmenauen", ["Statistik"], either=True).select("job_id")


@query("""
WITH p AS (SELECT url, title, 0 AS r FROM jobs WHERE job_id < 3 AND url IS NOT NULL), f AS (SELECT url, title, 1 AS r FROM jobs WHERE job_id BETWEEN 2 AND 9 AND url IS NOT NULL AND (SELECT count(*) FROM p) < 5),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY r, title) AS rn FROM (SELECT * FROM p UNION ALL SELECT * FROM f)) SELECT url, title FROM b WHERE rn = 1""")
def few_then_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A source that gave fewer than five rows, completed by its fallback."""
    jobs = table(spark, d, "jobs").where("url is not null").select("job_id", "url", "title")
    return P.with_few(jobs.where("job_id < 3").drop("job_id"), jobs.where("job_id between 2 and 9").drop("job_id"), 5)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
