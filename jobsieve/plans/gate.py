"""Queries that judge postings by their URLs, titles and dates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.functions import dates as D
from jobsieve.functions import urls as U
from jobsieve.functions.text import contains_any
from jobsieve.operators import quality as Q
from jobsieve.plans import duck
from jobsieve.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2025-06-01"
NOW = f"{AS_OF} 00:00:00"
RULES = Q.Rules(trusted=("jobhafen", "stellenfuchs", "workbeacon"), mode="strict")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"SELECT job_id, {duck.listing_page('trim(title)', 'url')} AS listing FROM jobs WHERE url IS NOT NULL")
def listing_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("url is not null").select("job_id", U.is_listing_page(F.trim("title"), F.col("url")).alias("listing"))


def _gate_sql(rules: Q.Rules, stage: str) -> str:
    score = " + ".join(
        [
            "35", "CASE WHEN length(title) BETWEEN 20 AND 100 THEN 15 ELSE 6 END", "CASE WHEN role THEN 10 ELSE 0 END", "CASE WHEN named THEN 10 ELSE 0 END", "CASE WHEN trusted THEN 10 ELSE 0 END", "CASE WHEN path THEN 10 ELSE 0 END", "CASE WHEN location <> '' THEN 5 ELSE 0 END",
            f"CASE WHEN length(description) >= {rules.description_chars} THEN 15 WHEN length(description) > 0 THEN 5 ELSE 0 END", "CASE WHEN age IS NULL OR age < INTERVAL 0 DAY THEN 0 WHEN age <= INTERVAL 30 DAY THEN 5 WHEN age <= INTERVAL 90 DAY THEN 3 ELSE 0 END",
        ]
    )
    flags = f"""array_to_string(list_filter([CASE WHEN NOT length(title) BETWEEN 20 AND 100 THEN 'title_shape' END, CASE WHEN NOT role THEN 'weak_role_signal' END, CASE WHEN NOT named THEN 'generic_company' END, CASE WHEN NOT trusted THEN 'untrusted_source' END,
      CASE WHEN NOT path THEN 'weak_url_path' END, CASE WHEN length(description) >= {rules.description_chars} THEN NULL WHEN length(description) > 0 THEN 'short_description' ELSE 'missing_description' END,
      CASE WHEN age IS NULL THEN 'unparsed_date' WHEN age < INTERVAL 0 DAY THEN 'future_date' WHEN age > INTERVAL 90 DAY THEN 'stale_posting' END], lambda x: x IS NOT NULL), ',')"""
    least = rules.least(stage)
    return f"""
WITH c AS (SELECT job_id, {duck.cleaned("coalesce(title, '')")} AS title, {duck.company("coalesce(company, '')")} AS company, {duck.cleaned("coalesce(location, '')")} AS location, {duck.cleaned("coalesce(description, '')")} AS description,
  lower({duck.cleaned("coalesce(source, '')")}) AS source, {duck.normal_url("url")} AS url, TIMESTAMP '{NOW}' - ({duck.posted_date("posted_date", NOW)}) AS age FROM jobs),
t AS (SELECT *, {duck.any_of("source", rules.trusted)} AS trusted, {duck.any_of("lower(title) || ' ' || lower(description) || ' ' || lower(url) || ' ' || source", Q.ROLE_WORDS)} AS role,
  company <> '' AND lower(company) NOT IN ({", ".join(duck.text(w) for w in Q.GENERIC_COMPANIES)}) AS named, {duck.any_of("lower(url)", Q.JOB_WORDS)} AS path FROM c),
r AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid_url' WHEN {duck.any_of("lower(url)", rules.garbage)} THEN 'garbage_domain' WHEN {duck.people_page("url")} THEN 'noise_url' WHEN {duck.listing_page("title", "url")} THEN 'listing_page'
  WHEN {duck.any_of("lower(url)", Q.NOISE_URL)} THEN 'noise_url' WHEN {duck.any_of("lower(title)", Q.NOISE_TITLE)} THEN 'noise_title' WHEN length(title) < {rules.title_chars[0]} OR length(title) > {rules.title_chars[1]} THEN 'title_length'
  WHEN location = '' THEN 'missing_location' WHEN company = '' AND NOT trusted THEN 'missing_company' ELSE '' END AS reason FROM t),
s AS (SELECT *, CASE WHEN reason = '' THEN {score} ELSE 0 END AS raw, CASE WHEN reason = '' THEN {flags} ELSE '' END AS flags FROM r)
SELECT job_id, reason = '' AND raw >= {least} AS accepted, least(raw, 100) AS score, CASE WHEN raw >= 80 THEN 'high' WHEN raw >= 55 THEN 'medium' ELSE 'low' END AS bucket, flags,
  CASE WHEN reason <> '' THEN reason WHEN raw < {least} THEN 'score_below_{least}' ELSE '' END AS reject_reason FROM s"""


@query(_gate_sql(RULES, "final"))
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return Q.assess(table(spark, d, "jobs"), RULES, AS_OF).select("job_id", "accepted", "score", "bucket", "flags", "reject_reason")


@query(f"SELECT reject_reason, count(*) AS seen FROM ({_gate_sql(RULES, 'final')}) GROUP BY 1")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return Q.gate_metrics(quality_gate(spark, d))


@query(f"SELECT reject_reason, count(*) AS seen FROM ({_gate_sql(RULES, 'batch')}) GROUP BY 1")
def gate_metrics_merged(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of two batches of one table, each assessed by itself, put together."""
    jobs = table(spark, d, "jobs")
    halves = [jobs.where("job_id % 2 = 0"), jobs.where("job_id % 2 = 1")]
    return Q.merge_metrics(*[Q.gate_metrics(Q.assess(h, RULES, AS_OF, "batch")) for h in halves])


@query(f"""
WITH g AS ({_gate_sql(RULES, 'final')})
SELECT job_id, {duck.cleaned("coalesce(title, '')")} AS title, {duck.company("coalesce(company, '')")} AS company, {duck.normal_url("url")} AS url, g.score, coalesce(quality.url_status, '') AS url_status FROM jobs JOIN g USING (job_id) WHERE g.accepted""")
def gate_applied(spark: SparkSession, d: str) -> DataFrame:
    """The accepted postings with cleaned fields, and the new score beside what was known of them."""
    jobs = table(spark, d, "jobs")
    known = jobs.select("job_id", F.coalesce("quality.url_status", F.lit("")).alias("url_status"))
    return Q.assess(jobs, RULES, AS_OF).where("accepted").join(known, "job_id").select("job_id", "title", "company", "url", "score", "url_status")


@query(f"SELECT job_id, {duck.posted_date('posted_date', NOW)} AS posted FROM jobs")
def posted_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", D.posted_date(F.col("posted_date"), _now()).alias("posted"))


@query(f"SELECT job_id, CASE WHEN coalesce(posted_date, '') = '' THEN 'N/A' ELSE coalesce(strftime({duck.posted_date('posted_date', NOW)}, '%Y %m %d %H:%M:%S'), posted_date) END AS shown FROM jobs")
def shown_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", D.shown_date(F.col("posted_date"), _now()).alias("shown"))


@query(f"SELECT job_id, {duck.recent('posted_date', NOW, 24)} AS day, {duck.recent('posted_date', NOW, 72)} AS three_days FROM jobs")
def recent_flags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("posted_date")
    return table(spark, d, "jobs").select("job_id", D.is_recent(raw, _now()).alias("day"), D.is_recent(raw, _now(), 72).alias("three_days"))


_T = "lower(trim(coalesce(posted_date, '')))"


@query(rf"""
SELECT job_id, CASE WHEN {_T} = '' THEN NULL WHEN {duck.has(_T, ("heute", "today", "just posted", "minutes ago", "minuten"))} THEN TIMESTAMP '{NOW}'
 WHEN regexp_matches({_T}, 'vor\s+(\d+)\s*tag|(\d+)\s+days?') THEN TIMESTAMP '{NOW}' - to_days(CAST(regexp_extract(regexp_extract({_T}, 'vor\s+(\d+)\s*tag|(\d+)\s+days?'), '\d+') AS INT))
 WHEN regexp_matches({_T}, '(\d+)\s*hour|vor\s+(\d+)\s*stunde') THEN TIMESTAMP '{NOW}' - to_hours(CAST(regexp_extract(regexp_extract({_T}, '(\d+)\s*hour|vor\s+(\d+)\s*stunde'), '\d+') AS INT)) END AS posted FROM jobs""")
def crawled_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", D.crawled_date(F.col("posted_date"), _now()).alias("posted"))


@query(f"""
WITH r AS (SELECT job_id, title, url, row_number() OVER (PARTITION BY quality.normalized_url ORDER BY coalesce(quality.score, 0) DESC, length(coalesce(description, '')) DESC, {duck.any_of("lower(source)", RULES.trusted)} DESC, scraped_at DESC NULLS LAST, job_id DESC) AS rn FROM jobs WHERE quality.normalized_url IS NOT NULL)
SELECT job_id FROM r WHERE rn = 1 AND NOT coalesce({duck.listing_page("trim(title)", "coalesce(url, '')")}, false)""")
def unique_postings(spark: SparkSession, d: str) -> DataFrame:
    """The best posting of each address - by score, length, trusted source and time - without listing pages; what the fuzzy step starts from."""
    jobs = table(spark, d, "jobs").where("quality.normalized_url is not null")
    trusted = contains_any(F.lower("source"), RULES.trusted)
    best = F.struct(F.coalesce("quality.score", F.lit(0)), F.length(F.coalesce("description", F.lit(""))), trusted, "scraped_at", "job_id")
    kept = jobs.groupBy("quality.normalized_url").agg(F.max_by(F.struct("job_id", "title", "url"), best).alias("r")).select("r.*")
    return kept.where(~F.coalesce(U.is_listing_page(F.trim("title"), F.coalesce("url", F.lit(""))), F.lit(False))).select("job_id")


_SIGNAL = lambda title, snippet, url: f"({duck.any_of(f'lower({url})', U.SIGNAL_URL)} OR ({duck.any_of(snippet, U.SIGNAL_TEXT)} AND {duck.any_of(snippet, U.SIGNAL_ROLE)}))"
_TEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"


def _source_sql(url: str) -> str:
    literal = " ".join(f"WHEN contains(lower({url}), {duck.text(x)}) THEN {duck.text(name)}" for x, name in U.SOURCE_LITERALS)
    root = f"regexp_replace(replace(split_part(lower({duck.url_part(url, 2)}), '.', 1), 'www', ''), '^-+|-+$', '', 'g')"
    return f"CASE {literal} WHEN contains({duck.url_part(url, 2)}, '.') AND {root} <> '' THEN upper({root}[1]) || {root}[2:] ELSE 'Web' END"


KNOWN = ("Jobhafen", "Jobs", "Stellenfuchs")
_NOISE = ("/salaries/", "karrierebibel", "lebenslauf", "curriculum-vitae")
_NOISE_TITLE = ("salary", "resume", "lebenslauf")


@query(f"SELECT job_id, {_SIGNAL('title', _TEXT, 'url')} AS job_signal FROM jobs WHERE url IS NOT NULL")
def job_signal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("url is not null").select("job_id", U.has_job_signal(F.col("title"), F.col("description"), F.col("url")).alias("job_signal"))


@query(f"""SELECT job_id, {duck.people_page("url")} OR {duck.any_of("lower(url)", _NOISE)} OR {duck.any_of("lower(coalesce(title, ''))", _NOISE_TITLE)} OR (contains(lower(url), 'glassdoor.') AND NOT {duck.board_detail("url")})
 OR (NOT {_SIGNAL('title', _TEXT, 'url')} AND NOT ({_source_sql("url")}) IN ({", ".join(duck.text(k) for k in KNOWN)})) AS noise FROM jobs WHERE url IS NOT NULL""")
def search_noise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("url is not null").select("job_id", U.is_search_noise(F.col("title"), F.col("description"), F.col("url"), _NOISE, _NOISE_TITLE, KNOWN).alias("noise"))


_CAREER = "lower(coalesce(url, '') || ' ' || coalesce(title, '') || ' ' || coalesce(description, ''))"


@query(f"SELECT job_id, NOT {duck.any_of(_CAREER, U.CAREER_NOISE)} AND NOT {duck.any_of('''lower(coalesce(title, ''))''', U.CAREER_NOISE_TITLES)} AND ({duck.any_of(_CAREER, U.CAREER_WORDS)} OR {duck.any_of(f'lower({duck.url_part(chr(117) + chr(114) + chr(108), 2)})', ('hirepond',))}) AS career FROM jobs WHERE url IS NOT NULL")
def career_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("url is not null").select("job_id", U.is_career_page(F.col("title"), F.col("description"), F.col("url"), ("hirepond",)).alias("career"))


@query(f"SELECT url, {_source_sql('url')} AS source FROM (SELECT DISTINCT url FROM jobs WHERE url IS NOT NULL)")
def detected_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("url").where("url is not null").distinct().select("url", U.detected_source(F.col("url")).alias("source"))


@query(rf"""
WITH h AS (SELECT DISTINCT regexp_replace(lower({duck.url_part("trim(url)", 2)}), '^www\.', '') AS host FROM jobs WHERE url IS NOT NULL)
SELECT host, array_to_string(list_transform(string_split(replace(split_part(host, '.', 1), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS company FROM h""")
def domain_companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("url is not null").select(U.host_name(F.col("url")).alias("host"), U.company_of_domain(F.col("url")).alias("company")).distinct()


#: Addresses of boards, one for each applicant system, that postings are spread over so that the rule meets all of them.
BOARDS = ("https://boards.greenhouse.io/acme/jobs/", "https://jobs.lever.co/acme-labs/", "https://acme.wd3.myworkdayjobs.com/x/", "https://career5.successfactors.eu/", "https://jobs.smartrecruiters.com/Acme/", "https://acme.recruitee.com/o/", "https://acme.jobs.personio.de/job/", "https://acme.example/jobs/")
_BOARD = duck.texts(BOARDS) + "[1 + job_id % 8] || job_id"


def _vendor_sql(column: str, what: str) -> str:
    whens = []
    for name, with_slug, plain in U.VENDORS:
        any_of = "(?i)" + "|".join(p for p in (with_slug, plain) if p)
        value = duck.text(name) if what == "vendor" else f"nullif(regexp_extract({column}, {duck.text('(?i)' + with_slug)}, 1), '')" if with_slug else "NULL"
        whens.append(f"WHEN regexp_matches({column}, {duck.text(any_of)}) THEN {value}")
    return "CASE " + " ".join(whens) + " END"


@query(f"WITH b AS (SELECT job_id, {_BOARD} AS url FROM jobs) SELECT job_id, {_vendor_sql('url', 'vendor')} AS vendor, {_vendor_sql('url', 'slug')} AS slug FROM b")
def board_vendors(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.get(F.array(*[F.lit(b) for b in BOARDS]), (F.col("job_id") % 8).cast("int")), F.col("job_id").cast("string"))
    return table(spark, d, "jobs").select("job_id", U.vendor(url).alias("v")).select("job_id", "v.vendor", "v.slug")


@query(f"SELECT source, unnest(list_filter(list_transform(list_filter(list_transform(string_split(rules, chr(10)), lambda x: lower(trim(x))), lambda x: regexp_matches(x, '^(?:dis)?allow:')), lambda x: trim(substring(x, instr(x, ':') + 1))), lambda p: regexp_matches(p, '{'|'.join(U.ROBOTS_WORDS)}'))) AS path FROM (SELECT source, 'User-agent: *' || chr(10) || 'Disallow: /' || source || '/admin' || chr(10) || 'Allow: /' || source || '/Karriere' || chr(10) || ' disallow: /jobs/' || source AS rules FROM feeds)")
def robots_career_paths(spark: SparkSession, d: str) -> DataFrame:
    rules = F.concat(F.lit("User-agent: *\nDisallow: /"), "source", F.lit("/admin\nAllow: /"), "source", F.lit("/Karriere\n disallow: /jobs/"), "source")
    return table(spark, d, "feeds").select("source", F.explode(U.robots_paths(rules)).alias("path"))


@query(f"""
WITH p AS (SELECT *, {duck.normal_url("url")} AS plain, {duck.normal_url("coalesce(final_url, url)")} AS final, coalesce(head_status < 400, false) OR (head_status IN (403, 405) AND coalesce(get_status < 400, false)) AS ok FROM url_probes WHERE url IS NOT NULL),
s AS (SELECT *, CASE WHEN ok THEN CASE WHEN final <> plain THEN 'redirected' ELSE 'alive' END WHEN head_status IS NULL OR (head_status IN (403, 405) AND get_status IS NULL) THEN 'uncertain'
 WHEN head_status = 429 OR (head_status IN (403, 405) AND get_status IN (403, 429)) THEN 'blocked' ELSE 'dead' END AS status FROM p)
SELECT url, probed_at, status, CASE WHEN ok THEN true WHEN status = 'blocked' THEN {duck.board_detail("url")} ELSE false END AS keep, CASE WHEN ok THEN final ELSE plain END AS verified_url FROM s""")
def probe_decisions(spark: SparkSession, d: str) -> DataFrame:
    decided = Q.probe_decision(F.col("url"), F.col("head_status"), F.col("get_status"), F.col("final_url"))
    return table(spark, d, "url_probes").where("url is not null").select("url", "probed_at", decided.alias("p")).select("url", "probed_at", "p.status", "p.keep", "p.verified_url")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
