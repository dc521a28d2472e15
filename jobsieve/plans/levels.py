"""Queries about what texts ask for and about HTML pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.functions import levels as L
from jobsieve.operators import similarity
from jobsieve.operators.pages import html_main_text
from jobsieve.plans import duck
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


_X = "(coalesce(title, '') || ' ' || coalesce(description, ''))"
_TEXT = lambda: F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))


def _m(pattern: str) -> str:
    return f"regexp_matches(x, {duck.text(pattern)})"


def _g(pattern: str, i: int) -> str:
    return f"try_cast(nullif(regexp_extract(x, {duck.text(pattern)}, {i}), '') AS INT)"


@query(f"""
WITH t AS (SELECT job_id, {_X} AS x FROM jobs), n AS (SELECT *, {_g(L.YEARS, 1)} AS y, {_g(L.YEAR_RANGE, 1)} AS lo, {_g(L.YEAR_RANGE, 2)} AS hi FROM t)
SELECT job_id, CASE WHEN {_m(L.MIDDLE)} THEN 'mid' WHEN {_m(L.ENTRY)} THEN 'entry' WHEN {_m(L.SENIOR)} THEN 'senior' WHEN lo IS NOT NULL THEN CASE WHEN hi >= 7 THEN 'senior' WHEN lo >= 3 THEN 'mid' ELSE 'entry' END
 WHEN y IS NOT NULL THEN CASE WHEN y >= 7 THEN 'senior' WHEN y >= 3 THEN 'mid' ELSE 'entry' END ELSE 'unknown' END AS level, coalesce(lo, y, 0) AS min_years, coalesce(hi, 0) AS max_years FROM n""")
def experience_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", L.experience_level(_TEXT()).alias("e")).select("job_id", "e.*")


@query(f"WITH t AS (SELECT job_id, {_X} AS x FROM jobs) SELECT job_id, CASE {' '.join(f'WHEN {_m(p)} THEN {duck.text(n)}' for n, p in L.EDUCATION)} ELSE 'unknown' END AS education FROM t")
def education_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", L.education_level(_TEXT()).alias("education"))


@query(f"""WITH t AS (SELECT job_id, {_X} AS x FROM jobs)
SELECT job_id, coalesce({", ".join(f"nullif(upper(regexp_extract(x, {duck.text(p)}, 1)), '')" for p in L.LANGUAGE_LEVEL)}, CASE WHEN {_m(L.LANGUAGE_FLUENT)} THEN 'C1' WHEN {_m(L.LANGUAGE_VERY_GOOD)} THEN 'B2' WHEN {_m(L.LANGUAGE_GOOD)} THEN 'B1' WHEN {_m(L.LANGUAGE_WELCOME)} THEN 'preferred'
 WHEN len(regexp_extract_all(lower(x), {duck.text(L.LANGUAGE_WORDS)})) > 10 THEN 'B1' ELSE '' END) AS german FROM t""")
def german_requirements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", L.german_requirement(_TEXT()).alias("german"))


_PLAIN = "coalesce(text, '')"


def _typeset_sql(x: str) -> str:
    for old, new in L.TYPESET:
        x = f"replace({x}, {duck.text(old)}, {duck.text(new)})"
    for mark, new in L.TYPESET_MARKS:
        for before in ("", " "):
            for after in ("", " "):
                x = f"replace({x}, {duck.text(f'${before}{mark}{after}$')}, {duck.text(new)})"
    return x


@query(f"SELECT doc_id, md5({_typeset_sql(_PLAIN)}) AS typeset FROM documents")
def typeset_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(L.typeset(F.col("text"))).alias("typeset"))


@query(r"""
WITH t AS (SELECT job_id, trim(regexp_replace(coalesce(description, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS x, trim(regexp_replace(coalesce(title, '') || ' ' || coalesce(description, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS body FROM jobs)
SELECT job_id, md5(CASE WHEN length(x) >= 200 THEN x ELSE body END) AS main_text FROM t WHERE length(x) >= 200 OR length(body) >= 200""")
def html_main_texts(spark: SparkSession, d: str) -> DataFrame:
    """The postings put into pages with menus and footers, and taken out of them again."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><style>x{}</style></head><body><nav><a href='/'>Menu</a></nav><h1>"), escaped(F.col("title")), F.lit('</h1><div class="box job-description">'), escaped(F.col("description")), F.lit("</div><script>var a = 1;</script><footer>Imprint</footer></body></html>"))
    return table(spark, d, "jobs").select("job_id", html_main_text(html).alias("m")).where("m is not null").select("job_id", F.md5("m").alias("main_text"))


@query("SELECT job_id, string_agg(tag, '|' ORDER BY length(tag) DESC, tag) AS skills FROM (SELECT DISTINCT job_id, unnest(tags) AS tag FROM jobs) WHERE tag IS NOT NULL GROUP BY job_id")
def ordered_skills(spark: SparkSession, d: str) -> DataFrame:
    """The skills of a posting in the order of their weight (here the length), then by name."""
    weighed = F.transform(F.array_distinct(F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))), lambda t: F.struct((-F.length(t)).alias("w"), t.alias("t")))
    return table(spark, d, "jobs").where("size(array_compact(tags)) > 0").select("job_id", F.array_join(F.array_sort(weighed)["t"], "|").alias("skills"))


ROLES = ("Planer Lagersteuerung", "Analyst data quality", "Entwicklerin Testautomatisierung")


@query()
def best_roles(spark: SparkSession, d: str) -> DataFrame:
    """The highest likeness of a title to any of the roles; each distinct title is compared once."""
    titles = table(spark, d, "jobs").select("title").where("title is not null").distinct()
    scores = [similarity.token_set_ratio(F.lower("title"), F.lit(r.lower())) for r in ROLES]
    return titles.select("title", F.round(F.greatest(*scores), 4).alias("score"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
