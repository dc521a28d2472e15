"""Queries over texts, URLs and times: cleaning, predicates, checks, extraction, similarity, windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.functions import text as T
from jobsieve.functions import urls as U
from jobsieve.operators import similarity, skills
from jobsieve.plans import duck
from jobsieve.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2025-06-01"
PROFILE = "data quality team statistics reports user research project planning".split()
VOCABULARY = {
    "statistics": ["statistics", "statistik", "statistique", "estadística", "statistica", "statistiek"], "databases": ["relational databases", "datenbankabfragen", "bases de données", "bases de datos", "basi di dati", "gegevensbanken"],
    "cost accounting": ["cost accounting", "kostenrechnung", "comptabilité analytique", "contabilidad de costes", "kostenberekening"], "network security": ["network security", "netzwerktechnik", "sécurité des réseaux", "seguridad de redes", "netwerkbeveiliging"],
    "scripting": ["script languages", "skriptsprachen", "langages de script"], "project planning": ["project planning", "projektplanung", "gestion de projet", "gestión de proyectos", "projectplanning"],
}
OWNED, RELATED = ["statistics", "scripting"], {"databases": ["scripting"]}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lit(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_SPLIT = U.SPLIT.replace("'", "''")
NORMAL_URL = duck.normal_url("url")


@query(f"SELECT job_id, {NORMAL_URL} AS normal_url FROM jobs")
def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", U.normalize_url(F.col("url")).alias("normal_url"))


@query(rf"SELECT regexp_replace(lower(regexp_extract(trim(url), '{_SPLIT}', 2)), '^www\.', '') AS host, count(*) AS n FROM jobs WHERE url IS NOT NULL GROUP BY 1")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("url is not null").groupBy(U.host_name(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT job_id, regexp_replace(replace(split_part(lower(regexp_extract(url, '{_SPLIT}', 2)), '.', 1), 'www', ''), '^-+|-+$', '', 'g') AS root FROM jobs WHERE url IS NOT NULL)
SELECT job_id, CASE WHEN root = '' THEN 'Web' ELSE upper(root[1]) || root[2:] END AS site FROM s""")
def url_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("url is not null").select("job_id", U.site_source(F.col("url")).alias("site"))


@query(f"SELECT job_id, len(list_intersect(string_split(lower(regexp_extract(coalesce(url, ''), '{_SPLIT}', 3)), '/'), {_lit(U.PEOPLE_SEGMENTS)})) > 0 AS people FROM jobs")
def people_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", U.is_people_page(F.col("url")).alias("people"))


_CLEAN = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT job_id, md5({_CLEAN.replace('{x}', 'description')}) AS cleaned FROM jobs WHERE description IS NOT NULL")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("description is not null").select("job_id", F.md5(T.clean_text(F.col("description"))).alias("cleaned"))


@query(rf"SELECT company, CASE WHEN regexp_matches(c, '(?i)^\(via\s+(.+?)\)$') THEN trim(regexp_extract(c, '(?i)^\(via\s+(.+?)\)$', 1)) ELSE c END AS cleaned FROM (SELECT DISTINCT company, {_CLEAN.replace('{x}', 'company')} AS c FROM jobs WHERE company IS NOT NULL)")
def clean_company(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("company").where("company is not null").distinct().select("company", T.clean_company(F.col("company")).alias("cleaned"))


_MAIL, _PHONE = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"


@query(f"SELECT doc_id, nullif(regexp_extract(text, '{_MAIL}'), '') AS email, nullif(regexp_extract(text, '{_PHONE}'), '') AS phone FROM documents WHERE text IS NOT NULL")
def contact_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.first_match(text, _MAIL).alias("email"), T.first_match(text, _PHONE).alias("phone"))


@query("SELECT job_id, length(description) AS chars FROM jobs WHERE length(coalesce(description, '')) BETWEEN 1 AND 199")
def thin_descriptions(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("description")
    return table(spark, d, "jobs").where(size.between(1, 199)).select("job_id", size.cast("long").alias("chars"))


@query("SELECT text_hash, n, min_id FROM (SELECT md5(text) AS text_hash, count(*) AS n, min(doc_id) AS min_id FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text) WHERE n > 1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").where("text is not null and text <> ''").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("min_id"))
    return df.where("n > 1")


@query(f"SELECT job_id, CASE WHEN last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'recent' WHEN last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY THEN 'older' ELSE 'stale' END AS age FROM jobs")
def recency(spark: SparkSession, d: str) -> DataFrame:
    since = lambda n: F.col("last_seen_at") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF} 00:00:00' - INTERVAL {n} DAY")
    return table(spark, d, "jobs").select("job_id", F.when(since(30), "recent").when(since(180), "older").otherwise("stale").alias("age"))


@query("""
SELECT count(*) AS postings, round(avg(quality.score), 6) AS mean_score, CAST(sum(CASE WHEN quality.score >= 80 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN quality.score >= 55 AND quality.score < 80 THEN 1 ELSE 0 END) AS BIGINT) AS medium,
CAST(sum(CASE WHEN quality.score < 55 OR quality.score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN quality.url_status IN ('alive', 'redirected') THEN 1 ELSE 0 END) AS BIGINT) AS reachable FROM jobs""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("quality.score")
    return table(spark, d, "jobs").agg(
        F.count("*").alias("postings"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("mean_score"), F.count_if(score >= 80).alias("high"), F.count_if((score >= 55) & (score < 80)).alias("medium"),
        F.count_if(score.isNull() | (score < 55)).alias("low"), F.count_if(F.col("quality.url_status").isin("alive", "redirected")).alias("reachable"),
    )


def _skill_sql() -> str:
    parts = []
    for skill, names in sorted(VOCABULARY.items()):
        pattern = "|".join(sorted(names, key=len, reverse=True))
        # RE2 has no lookaround: letters around a hit are replaced by blanks of their own first, so that boundaries can be consumed.
        text = r"' ' || replace(regexp_replace(lower(description), '[^\p{L}\p{N}]', '  ', 'g'), '  ', '  ') || ' '"
        parts.append(f"SELECT job_id, '{skill}' AS skill, len(regexp_extract_all({text}, ' (?:{pattern.replace(' ', '  ')}) ')) AS hits FROM jobs WHERE description IS NOT NULL")
    return "SELECT job_id, skill, CAST(hits AS BIGINT) AS hits, least(1.0::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * hits) AS confidence FROM (" + " UNION ALL ".join(parts) + ") WHERE hits > 0"


@query(_skill_sql())
def skill_extract(spark: SparkSession, d: str) -> DataFrame:
    return skills.extract_skills(table(spark, d, "jobs"), VOCABULARY, "job_id", "description")


@query(f"""
WITH f AS ({_skill_sql()}), c AS (SELECT skill, count(*) AS postings FROM f WHERE NOT list_contains({_lit(OWNED)}, skill) GROUP BY skill)
SELECT skill, postings, round(postings / max(postings) OVER (), 6) AS share FROM c ORDER BY postings DESC, skill LIMIT 15""")
def skills_gap(spark: SparkSession, d: str) -> DataFrame:
    return skills.gap(skill_extract(spark, d), OWNED)


@query(f"""
WITH f AS ({_skill_sql()}), w AS (SELECT job_id, list(skill) AS s FROM f GROUP BY job_id)
SELECT job_id, round(least(100.0, (len(list_intersect(s, {_lit(OWNED)})) + 0.5 * len(list_intersect(s, {_lit(list(RELATED))}))) / len(s) * 110.0), 6) AS score FROM w""")
def skill_match(spark: SparkSession, d: str) -> DataFrame:
    wanted = skill_extract(spark, d).groupBy("job_id").agg(F.collect_set("skill").alias("s"))
    return wanted.select("job_id", F.round(skills.match_score(F.col("s"), OWNED, RELATED), 6).alias("score"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(greatest(0, least(100, 130 * list_cosine_similarity(v.embedding::DOUBLE[], q.e))), 4) AS score FROM embeddings v, q""")
def semantic_cosine(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    one = df.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return df.join(F.broadcast(one)).select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 130 * similarity.cosine(F.col("embedding"), F.col("q")))), 4).alias("score"))


def _term_sql() -> str:
    words = sorted(set(PROFILE))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS n{i}" for i, w in enumerate(words))
    g = [f"CASE WHEN n{i} > 0 THEN 1 + ln(n{i}) ELSE 0 END" for i in range(len(words))]
    dot, norm = " + ".join(g), " + ".join(f"({x}) * ({x})" for x in g)
    return rf"SELECT job_id, round(CASE WHEN {norm} = 0 THEN 0 ELSE ({dot}) / (sqrt({norm}) * sqrt({len(words)})) END, 6) AS score FROM (SELECT job_id, {tf} FROM (SELECT job_id, regexp_split_to_array(lower(coalesce(description, '')), '[^\p{{L}}\p{{N}}]+') AS t FROM jobs))"


@query(_term_sql())
def tf_cosine(spark: SparkSession, d: str) -> DataFrame:
    return similarity.term_cosine(table(spark, d, "jobs"), PROFILE, "job_id", "description").select("job_id", F.round("score", 6).alias("score"))


@query()
def token_set_ratio(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "jobs").select("title").where("title is not null").distinct()
    return titles.select("title", F.round(similarity.token_set_ratio(F.lower("title"), F.lit("developer in our data quality team")), 4).alias("score"))


@query()
def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return similarity.fuzzy_dedup(table(spark, d, "jobs"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""
SELECT e.engine, e.ts, e.call_kind, max(p.ts) AS last_limit FROM (SELECT DISTINCT engine, ts, call_kind FROM engine_calls WHERE call_kind = 'query') e
ASOF JOIN (SELECT DISTINCT engine, ts FROM engine_calls WHERE call_kind = 'limit') p ON e.engine = p.engine AND e.ts >= p.ts GROUP BY ALL""")
def last_limit_before(spark: SparkSession, d: str) -> DataFrame:
    """The last limit before each query: an as-of join as a running maximum over the union, bounded per engine and day by a carry."""
    from jobsieve.operators.asof import last_before

    calls = table(spark, d, "engine_calls").select("engine", "ts", "call_kind").distinct()
    return last_before(calls.where("call_kind = 'query'"), calls.where("call_kind = 'limit'").select("engine", "ts"), "engine", "ts", "last_limit").where("last_limit is not null").select("engine", "ts", "call_kind", "last_limit")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
