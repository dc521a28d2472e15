"""Queries behind lists, boards and reports: marks, tiers, searches, orders, groups and totals, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.functions import dates as D
from jobsieve.functions.text import contains_any
from jobsieve.operators.ranking import rank_within
from jobsieve.plans import duck
from jobsieve.plans.gate import NOW
from jobsieve.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
MARKERS = ("thesis", "masterarbeit", "bachelorarbeit", "abschlussarbeit", "tesi", "werkstudent")
SKILLS = {"datenqualität": "data", "data quality": "data", "testautomatisierung": "engineering", "test automation": "engineering", "energieplanung": "", "lohnabrechnung": "finance", "payroll": "finance"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _score() -> Column:
    return F.when(F.isnan("match_score"), F.lit(0.0)).otherwise(F.coalesce("match_score", F.lit(0.0)))


def marked() -> Column:
    return contains_any(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))), MARKERS)


_SCORE = "CASE WHEN isnan(match_score) THEN 0 ELSE coalesce(match_score, 0) END"
_MARKED = duck.any_of("lower(coalesce(title, '') || ' ' || coalesce(description, ''))", MARKERS)
_RECENT = duck.recent("posted_date", NOW, 24)
_POSTED = duck.posted_date("posted_date", NOW)


@query(f"SELECT job_id, {_MARKED} AS marked FROM jobs")
def marked_postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", marked().alias("marked"))


@query(f"SELECT count(*) AS postings, CAST(sum(CASE WHEN {_RECENT} AND NOT {_MARKED} THEN 1 ELSE 0 END) AS BIGINT) AS fresh FROM jobs")
def fresh_unmarked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").agg(F.count("*").alias("postings"), F.count_if(D.is_recent(F.col("posted_date"), _now()) & ~marked()).alias("fresh"))


def tier(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 35, "medium").otherwise("low")


@query(f"""
WITH t AS (SELECT job_id, CASE WHEN {_SCORE} >= 75 THEN 'high' WHEN {_SCORE} >= 35 THEN 'medium' ELSE 'low' END AS tier FROM jobs)
SELECT job_id, tier, job_id IN (SELECT job_id FROM applications WHERE status = 'saved' AND job_id IS NOT NULL) AS saved FROM t WHERE tier <> 'low' OR saved""")
def tier_filter(spark: SparkSession, d: str) -> DataFrame:
    saved = table(spark, d, "applications").where("status = 'saved'").select("job_id").distinct().withColumn("is_saved", F.lit(True))
    tiers = table(spark, d, "jobs").select("job_id", tier(_score()).alias("tier")).join(saved, "job_id", "left")
    return tiers.select("job_id", "tier", F.coalesce("is_saved", F.lit(False)).alias("saved")).where("tier <> 'low' or saved")


@query(f"SELECT job_id, CASE WHEN {_SCORE} >= 80 THEN 'Excellent' WHEN {_SCORE} >= 60 THEN 'Strong' WHEN {_SCORE} >= 40 THEN 'Potential' WHEN {_MARKED} THEN 'Discovery' ELSE 'Review' END AS label, CASE WHEN {_SCORE} >= 75 THEN 'Very High' WHEN {_SCORE} >= 55 THEN 'High' WHEN {_SCORE} >= 35 THEN 'Medium' ELSE 'Low' END AS confidence FROM jobs")
def match_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = _score()
    label = F.when(s >= 80, "Excellent").when(s >= 60, "Strong").when(s >= 40, "Potential").when(marked(), "Discovery").otherwise("Review")
    return table(spark, d, "jobs").select("job_id", label.alias("label"), F.when(s >= 75, "Very High").when(s >= 55, "High").when(s >= 35, "Medium").otherwise("Low").alias("confidence"))


@query("SELECT job_id FROM jobs WHERE contains(lower(coalesce(title, '')), 'lohn') OR contains(lower(coalesce(company, '')), 'lohn') OR len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'lohn'))) > 0")
def posting_search(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("lohn"))
    return table(spark, d, "jobs").where(has(F.col("title")) | has(F.col("company")) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), has)).select("job_id")


@query("SELECT job_id, title FROM jobs WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(company, '')), 'planer') AND contains(lower(coalesce(location, '')), 'en')")
def report_search(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("company", F.lit(""))))
    return table(spark, d, "jobs").where(text.contains("planer") & F.lower(F.coalesce("location", F.lit(""))).contains("en")).select("job_id", "title")


@query(f"""SELECT job_id, substring(coalesce(title, ''), 1, 65) AS title, substring(coalesce(company, ''), 1, 35) AS company, substring(coalesce(location, ''), 1, 25) AS location, coalesce(source, '') AS source, coalesce(nullif(posted_date, ''), 'N/A') AS posted_date,
 round({_SCORE}, 1) AS match, {_RECENT} AS recent, coalesce(quality.score, 0) AS quality_score, coalesce(quality.bucket, 'low') AS quality_bucket, coalesce(quality.url_status, 'unknown') AS url_status FROM jobs""")
def listed_columns(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return table(spark, d, "jobs").select(
        "job_id", cut("title", 65), cut("company", 35), cut("location", 25), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.nullif("posted_date", F.lit("")), F.lit("N/A")).alias("posted_date"), F.round(_score(), 1).alias("match"), D.is_recent(F.col("posted_date"), _now()).alias("recent"),
        F.coalesce("quality.score", F.lit(0)).alias("quality_score"), F.coalesce("quality.bucket", F.lit("low")).alias("quality_bucket"), F.coalesce("quality.url_status", F.lit("unknown")).alias("url_status"),
    )


def _display_keys() -> list[Column]:
    recent = F.when(D.is_recent(F.col("posted_date"), _now()), 0).otherwise(1)
    posted = F.coalesce(F.unix_micros(D.posted_date(F.col("posted_date"), _now()).cast("timestamp")), F.lit(0))
    return [recent, -_score(), F.when(marked(), 0).otherwise(1), -F.coalesce("quality.score", F.lit(0)), -posted, F.lower(F.coalesce("title", F.lit("")))]


_KEYS = [f"CASE WHEN {_RECENT} THEN 0 ELSE 1 END", f"-({_SCORE})", f"CASE WHEN {_MARKED} THEN 0 ELSE 1 END", "-coalesce(quality.score, 0)", f"-coalesce(epoch_us({_POSTED}), 0)", "lower(coalesce(title, ''))"]


@query(f"SELECT job_id FROM jobs ORDER BY {', '.join(_KEYS)}, job_id LIMIT 100")
def display_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred postings: recent ones, then by match, mark, quality, date and title."""
    return table(spark, d, "jobs").orderBy(*_display_keys(), "job_id").limit(100).select("job_id")


@query(f"SELECT job_id FROM jobs ORDER BY {_KEYS[0]}, {_KEYS[2]}, {_KEYS[3]}, {_KEYS[1]}, {_KEYS[4]}, job_id LIMIT 100")
def service_order(spark: SparkSession, d: str) -> DataFrame:
    """The same in the order of the service: mark and quality come before the match."""
    k = _display_keys()
    return table(spark, d, "jobs").orderBy(k[0], k[2], k[3], k[1], k[4], "job_id").limit(100).select("job_id")


_GROUPS = {
    "company": "coalesce(nullif(company, ''), 'Unknown Company')", "source": "coalesce(nullif(source, ''), 'Unknown Source')", "date": f"coalesce(strftime({_POSTED}, '%Y %m %d'), 'N/A')",
}


def _grouped_sql(label: str) -> str:
    return f"SELECT {label} AS label, job_id, row_number() OVER (PARTITION BY {label} ORDER BY {', '.join(_KEYS)}, job_id) AS rank_no FROM jobs"


def _grouped(spark: SparkSession, d: str, label: Column) -> DataFrame:
    jobs = table(spark, d, "jobs").select("job_id", label.alias("label"), *[k.alias(f"k{i}") for i, k in enumerate(_display_keys())])
    return rank_within(jobs, "label", [F.col(f"k{i}") for i in range(6)] + [F.col("job_id")]).select("label", "job_id", "rank_no")


@query(_grouped_sql(_GROUPS["company"]))
def grouped_by_company(spark: SparkSession, d: str) -> DataFrame:
    """Every posting with its place in the group of its company; one company may hold a third of all rows."""
    return _grouped(spark, d, F.coalesce(F.nullif("company", F.lit("")), F.lit("Unknown Company")))


@query(_grouped_sql(_GROUPS["source"]))
def grouped_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, F.coalesce(F.nullif("source", F.lit("")), F.lit("Unknown Source")))


@query(_grouped_sql(_GROUPS["date"]))
def grouped_by_date(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d, F.coalesce(F.date_format(D.posted_date(F.col("posted_date"), _now()), "yyyy MM dd"), F.lit("N/A")))


@query(f"""
WITH g AS (SELECT CASE WHEN {_SCORE} >= 80 THEN 'Excellent' WHEN {_SCORE} >= 60 THEN 'Strong' WHEN {_SCORE} >= 40 THEN 'Potential' WHEN {_MARKED} THEN 'Discovery' ELSE 'Review' END AS label, count(*) AS postings FROM jobs GROUP BY 1)
SELECT label, postings, row_number() OVER (ORDER BY CASE label WHEN 'Excellent' THEN 0 WHEN 'Strong' THEN 1 WHEN 'Potential' THEN 2 WHEN 'Discovery' THEN 3 ELSE 4 END) AS place FROM g""")
def group_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups of tiers in their fixed order; there are five at most."""
    from pyspark.sql import Window as W

    rank = F.when(F.col("label") == "Excellent", 0).when(F.col("label") == "Strong", 1).when(F.col("label") == "Potential", 2).when(F.col("label") == "Discovery", 3).otherwise(4)
    groups = match_tiers(spark, d).groupBy("label").agg(F.count("*").alias("postings"))
    return groups.withColumn("place", F.row_number().over(W.orderBy(rank)).cast("long"))


@query("SELECT job_id, posted_date FROM jobs ORDER BY coalesce(posted_date, '') DESC, job_id LIMIT 25 OFFSET 25")
def date_string_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").orderBy(F.desc(F.coalesce("posted_date", F.lit(""))), "job_id").offset(25).limit(25).select("job_id", "posted_date")


@query("SELECT job_id, title FROM jobs ORDER BY try_cast(title AS DOUBLE) IS NULL, try_cast(title AS DOUBLE), lower(coalesce(title, '')), job_id LIMIT 100")
def column_sort(spark: SparkSession, d: str) -> DataFrame:
    """A column with numbers first, in their order, then texts in theirs."""
    n = F.col("title").try_cast("double")
    return table(spark, d, "jobs").orderBy(n.isNull(), n, F.lower(F.coalesce("title", F.lit(""))), "job_id").limit(100).select("job_id", "title")


@query("SELECT application_id, updated_at FROM applications ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, application_id LIMIT 50")
def latest_applications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), "application_id").limit(50).select("application_id", "updated_at")


BOARD = ("saved", "applied", "interview", "offer", "rejected")


@query(f"SELECT status, count(*) AS n FROM applications WHERE status IN ({', '.join(duck.text(s) for s in BOARD)}) GROUP BY status")
def status_board(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").where(F.col("status").isin(*BOARD)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(sum(CASE WHEN s >= 55 THEN 1 ELSE 0 END) AS BIGINT) AS strong, count(*) AS shown FROM (SELECT {_SCORE} AS s FROM jobs ORDER BY {_SCORE} DESC, job_id LIMIT 8)")
def strong_among_first(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "jobs").select("job_id", _score().alias("s")).orderBy(F.desc("s"), "job_id").limit(8)
    return first.agg(F.count_if(F.col("s") >= 55).alias("strong"), F.count("*").alias("shown"))


@query(f"SELECT count(*) AS postings, round(avg({_SCORE}), 4) AS mean_score, CAST(sum(CASE WHEN {_SCORE} >= 55 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM jobs")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").agg(F.count("*").alias("postings"), F.round(F.avg(_score()), 4).alias("mean_score"), F.count_if(_score() >= 55).alias("good"))


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in ("jobs", "applications", "notes", "dismissed_jobs")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every table that a deletion would meet, as one row."""
    from functools import reduce

    counts = [table(spark, d, t).agg(F.count("*").alias("n")).withColumn("t", F.lit(t)) for t in ("jobs", "applications", "notes", "dismissed_jobs")]
    both = reduce(DataFrame.unionByName, counts)
    return both.agg(*[F.max(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in ("jobs", "applications", "notes", "dismissed_jobs")])


_CATEGORY = "CASE t " + " ".join(f"WHEN {duck.text(k)} THEN {duck.text(v or 'other')}" for k, v in SKILLS.items()) + " ELSE 'other' END"


@query(f"SELECT {_CATEGORY} AS category, string_agg(DISTINCT t, '|' ORDER BY t) AS skills FROM (SELECT lower(trim(unnest(tags))) AS t FROM jobs) WHERE t <> '' GROUP BY 1")
def skills_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tags by category, sorted; tags without a category are other. Distinct tags are few beside the rows."""
    known = F.create_map(*[F.lit(x) for k, v in SKILLS.items() for x in (k, v or "other")])
    tags = table(spark, d, "jobs").select(F.explode("tags").alias("t")).select(F.lower(F.trim("t")).alias("t")).where("t <> ''").distinct()
    return tags.groupBy(F.coalesce(F.try_element_at(known, F.col("t")), F.lit("other")).alias("category")).agg(F.array_join(F.array_sort(F.collect_list("t")), "|").alias("skills"))


@query("SELECT tag, n, least(100, n * 5) AS width FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM jobs) GROUP BY tag) ORDER BY n DESC, tag LIMIT 8")
def gap_bars(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "jobs").select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.select("tag", "n", F.least(F.lit(100), F.col("n") * 5).alias("width")).orderBy(F.desc("n"), "tag").limit(8)


RELATED = (("lohnabrechnung", "finanzen"), ("payroll", "finance"), ("datenqualität", "daten"), ("daten", "informatik"), ("test automation", "testing"))
_EDGES = "(VALUES " + ", ".join(f"({duck.text(a)}, {duck.text(b)})" for a, b in RELATED) + ") e(skill, parent)"


@query(f"WITH s AS (SELECT DISTINCT job_id, lower(trim(unnest(tags))) AS skill FROM jobs) SELECT job_id, skill FROM s UNION SELECT job_id, parent FROM s JOIN {_EDGES} ON s.skill = e.skill")
def skill_parents(spark: SparkSession, d: str) -> DataFrame:
    """Skills with their parents, one step up; the edges are a fixed list."""
    own = table(spark, d, "jobs").select("job_id", F.explode("tags").alias("s")).select("job_id", F.lower(F.trim("s")).alias("skill")).distinct()
    edges = spark.createDataFrame(list(RELATED), "skill string, parent string")
    return own.unionByName(own.join(F.broadcast(edges), "skill").select("job_id", F.col("parent").alias("skill"))).distinct()


ROLES = {"analyst": ("datenqualität", "data quality", "statistics"), "planner": ("energieplanung", "energy planning", "einkauf", "purchasing"), "engineer": ("testautomatisierung", "test automation")}


@query(" UNION ALL ".join(f"SELECT job_id, {duck.text(r)} AS role, round(len(list_intersect(list_transform(coalesce(tags, []), lambda t: lower(t)), {duck.texts(s)})) / {len(s)}.0::DOUBLE, 2) AS strength FROM jobs WHERE len(list_intersect(list_transform(coalesce(tags, []), lambda t: lower(t)), {duck.texts(s)})) > 0" for r, s in ROLES.items()))
def role_strengths(spark: SparkSession, d: str) -> DataFrame:
    """Roles of a posting by the share of their skills that it names."""
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    cells = F.array(*[F.struct(F.lit(r).alias("role"), F.round(F.size(F.array_intersect(tags, F.array(*[F.lit(x) for x in s]))) / F.lit(float(len(s))), 2).alias("strength")) for r, s in ROLES.items()])
    return table(spark, d, "jobs").select("job_id", F.explode(F.filter(cells, lambda c: c["strength"] > 0)).alias("c")).select("job_id", "c.role", "c.strength")


@query("SELECT p.url, min(j.job_id) AS job_id FROM (SELECT DISTINCT url FROM url_probes WHERE url IS NOT NULL) p JOIN jobs j ON j.url = p.url GROUP BY p.url")
def first_by_url(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "url_probes").select("url").where("url is not null").distinct()
    return table(spark, d, "jobs").groupBy("url").agg(F.min("job_id").alias("job_id")).join(probes, "url").select("url", "job_id")


@query(f"""
WITH o AS (SELECT url, max(CASE WHEN {_MARKED} THEN 5 ELSE 0 END + CASE WHEN {_RECENT} THEN 2 ELSE 0 END) AS points FROM jobs WHERE url IS NOT NULL GROUP BY url)
SELECT application_id, coalesce(o.points, 0) AS points FROM applications a LEFT JOIN jobs j USING (job_id) LEFT JOIN o ON o.url = j.url""")
def application_points(spark: SparkSession, d: str) -> DataFrame:
    """Applications with the points of their posting's URL, 0 without one."""
    jobs = table(spark, d, "jobs")
    points = F.when(marked(), 5).otherwise(0) + F.when(D.is_recent(F.col("posted_date"), _now()), 2).otherwise(0)
    by_url = jobs.where("url is not null").groupBy("url").agg(F.max(points).alias("points"))
    return table(spark, d, "applications").select("application_id", "job_id").join(jobs.select("job_id", "url"), "job_id", "left").join(by_url, "url", "left").select("application_id", F.coalesce("points", F.lit(0)).alias("points"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
