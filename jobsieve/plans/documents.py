"""Queries over documents: sections, checks, profile texts, skills as lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.operators import checks as C
from jobsieve.operators import similarity
from jobsieve.operators.sections import HEADINGS, split_sections
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


_SECTIONS = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
h AS (SELECT *, nullif(regexp_extract(trim(regexp_replace(lower(trim(line)), '[^a-z\s&]', '', 'g')), '^({"|".join(HEADINGS)})', 1), '') AS heading FROM l),
p AS (SELECT *, max(CASE WHEN heading IS NOT NULL THEN no END) OVER (PARTITION BY doc_id ORDER BY no) AS top FROM h),
c AS (SELECT p.doc_id, p.no, p.line, coalesce(p.top, 0) AS top, coalesce(g.heading, 'header') AS section FROM p LEFT JOIN h g ON g.doc_id = p.doc_id AND g.no = p.top WHERE p.heading IS NULL),
s AS (SELECT doc_id, section, top, string_agg(line, chr(10) ORDER BY no) AS content FROM c GROUP BY ALL),
d AS (SELECT doc_id, section, regexp_replace(arg_max(content, top), '^\s+|\s+$', '', 'g') AS content FROM s GROUP BY ALL)"""


@query(_SECTIONS + " SELECT doc_id, section, md5(content) AS content, CAST(length(content) AS BIGINT) AS chars FROM d")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    return split_sections(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "section", F.md5("content").alias("content"), F.length("content").cast("long").alias("chars"))


def _status_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 8 THEN 'pass' WHEN {score} >= 5 THEN 'warning' ELSE 'fail' END"


_X = "coalesce(text, '')"
_ODD = rf"len(list_distinct(regexp_extract_all({_X}, {duck.text(f'[{C.ODD_CHARACTERS}]|[^' + chr(92) + 'x00-' + chr(92) + f'x7f{C.PLAIN_LETTERS}]')})))"
_AT = {w: f"instr(lower({_X}), '{w}')" for w in C.ORDER_MARKS}
_MARKS = " + ".join(f"CASE WHEN {x} > 0 THEN 1 ELSE 0 END" for x in _AT.values())
_FOUND = " + ".join(f"CASE WHEN contains(lower({_X}), {duck.text(w)}) THEN 1 ELSE 0 END" for w in C.KEYWORDS)
_CONTACT = " + ".join(f"CASE WHEN regexp_matches({_X}, {duck.text(p)}) THEN 1 ELSE 0 END" for p in (C.MAIL, C.PHONE, C.NETWORK))
_N = f"length(trim({_X}))"
_TEXT_CHECKS = {
    "text": f"CASE WHEN {_N} = 0 THEN 0 WHEN {_N} < 200 THEN 3 WHEN {_N} < 500 THEN 6 ELSE 10 END", "characters": f"CASE WHEN {_ODD} = 0 THEN 10 WHEN {_ODD} <= 3 THEN 7 ELSE 4 END", "contact": f"CAST(floor(({_CONTACT}) / 3.0::DOUBLE * 10) AS INT)",
    "order": f"CASE WHEN {_MARKS} < 2 THEN 5 WHEN {_AT['profile']} > 0 AND {_AT['experience']} > 0 AND {_AT['profile']} > {_AT['experience']} THEN 5 ELSE 10 END", "keywords": f"least(10, CAST(floor(({_FOUND}) / {len(C.KEYWORDS)}.0::DOUBLE * 12) AS INT))",
}
_LONG = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS \"check\", {sql} AS score FROM documents" for name, sql in _TEXT_CHECKS.items())
_OWN = "list_filter(s, lambda x: x <> 'header')"
_STANDARD = f"list_filter({_OWN}, lambda x: list_contains({duck.texts(C.STANDARD_SECTIONS)}, x))"
_HEADINGS = f"SELECT doc_id, 'headings' AS \"check\", CASE WHEN len({_OWN}) = 0 THEN 3 WHEN len({_STANDARD}) = len({_OWN}) THEN 10 ELSE greatest(3, CAST(floor(len({_STANDARD}) / len({_OWN})::DOUBLE * 10) AS INT)) END AS score FROM (SELECT doc_id, coalesce(list(section) FILTER (section IS NOT NULL), []) AS s FROM documents LEFT JOIN d USING (doc_id) GROUP BY doc_id)"
_ALL_CHECKS = f"{_SECTIONS}, x AS ({_LONG} UNION ALL {_HEADINGS}), y AS (SELECT *, {_status_sql('score')} AS status FROM x)"


@query(_ALL_CHECKS + ' SELECT doc_id, "check", score, status FROM y')
def document_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    sections = split_sections(docs, "doc_id", "text").groupBy("doc_id").agg(F.collect_set("section").alias("sections"))
    own = F.coalesce("sections", F.array().cast("array<string>"))  # a text of headings alone has no section
    return C.long_form(docs.join(sections, "doc_id", "left"), "doc_id", C.text_checks(F.col("text"), own))


@query(
    _ALL_CHECKS + """, r AS (SELECT doc_id, CAST(floor(sum(score) / (count(*) * 10)::DOUBLE * 100) AS INT) AS overall, CAST(sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN status = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warned,
 coalesce(string_agg(CASE WHEN status = 'fail' THEN "check" END, '|' ORDER BY "check"), '') AS critical FROM y GROUP BY doc_id)
SELECT doc_id, overall, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 45 THEN 'D' ELSE 'F' END AS grade, failed, warned, critical FROM r"""
)
def document_report(spark: SparkSession, d: str) -> DataFrame:
    return C.report(document_checks(spark, d), "doc_id")


_FONTS = ("Arial", "Times-Roman", "Comic Sans", "Papyrus", "LM Roman 10", "Impact")
_FILE = """SELECT doc_id, coalesce(n_chars, 0) % 5 AS images, coalesce(n_chars, 0) % 4 AS tables, coalesce(n_chars, 0) * 4000 AS size, 1 + coalesce(n_chars, 0) // 3000 AS pages, text IS NOT NULL AS readable, doc_id % 7 AS fonts_n,
 regexp_extract_all(coalesce(text, ''), '[a-z]+://[^ \n]+|[\\w.+-]+@[\\w-]+[.][\\w.-]+') AS links FROM documents"""


def _file_sql() -> str:
    standard = "|".join(f.replace(" ", " ") for f in C.STANDARD_FONTS)
    odd = f"len(list_filter(fonts, lambda f: NOT regexp_matches(regexp_replace(lower(f), '[- ]', '', 'g'), {duck.text(standard)})))"
    by = {
        "images": "CASE WHEN images <= 0 THEN 10 WHEN images <= 1 THEN 6 WHEN images <= 3 THEN 4 ELSE 2 END", "tables": "CASE WHEN tables <= 0 THEN 10 WHEN tables <= 2 THEN 6 ELSE 3 END",
        "fonts": f"CASE WHEN len(fonts) = 0 THEN 5 WHEN {odd} <= 0 THEN 10 WHEN {odd} <= 2 THEN 7 ELSE 4 END", "size": "CASE WHEN size <= 1048576 THEN 10 WHEN size <= 2097152 THEN 8 WHEN size <= 5242880 THEN 5 ELSE 2 END",
        "pages": "CASE pages WHEN 1 THEN 10 WHEN 2 THEN 9 WHEN 3 THEN 6 ELSE 3 END", "links": r"CASE WHEN len(links) = 0 THEN 7 WHEN len(list_filter(links, lambda u: NOT regexp_matches(u, '^https?://[\w.-]+|^mailto:'))) = 0 THEN 10 ELSE 7 END", "readable": "CASE WHEN readable THEN 10 ELSE 0 END",
    }
    long = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS \"check\", {sql} AS score FROM f" for name, sql in by.items())
    return f"WITH f AS (SELECT *, {duck.texts(_FONTS)}[1:fonts_n] AS fonts FROM ({_FILE})), x AS ({long}) SELECT doc_id, \"check\", score, {_status_sql('score')} AS status FROM x"


@query(_file_sql())
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of what a reader of files reports; what it would report is derived from each document's length."""
    n = F.coalesce("n_chars", F.lit(0))
    links = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([a-z]+://[^ \n]+|[\w.+-]+@[\w-]+[.][\w.-]+)"), F.lit(1))
    fonts = F.slice(F.array(*[F.lit(f) for f in _FONTS]), F.lit(1), (F.col("doc_id") % 7).cast("int"))
    return C.long_form(table(spark, d, "documents"), "doc_id", C.file_checks(n % 5, n % 4, fonts, n * 4000, 1 + F.floor(n / 3000), links, F.col("text").isNotNull()))


@query(rf"""
WITH m AS (SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '{C.MAIL}'), '') AS mail, substring(coalesce(text, ''), 1, 200) AS edge, substring(coalesce(text, ''), 201) AS main FROM documents)
SELECT doc_id, CASE WHEN mail IS NOT NULL AND contains(lower(edge), lower(mail)) AND NOT contains(lower(main), lower(mail)) THEN 5 ELSE 10 END AS score FROM m""")
def edge_contact_check(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 characters of a document are taken for its header."""
    text = F.coalesce("text", F.lit(""))
    mail = F.nullif(F.regexp_extract(text, C.MAIL, 0), F.lit(""))
    return table(spark, d, "documents").select("doc_id", C.only_at_the_edge(mail, F.substring(text, 1, 200), F.expr("substring(coalesce(text, ''), 201)")).alias("score"))


LINES_NOT_NAMES = ("curriculum", "lebenslauf", "resume", "profile", "profil", "cv")


@query(f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND length(x) < 60 AND NOT regexp_matches(lower(x), '{"|".join(LINES_NOT_NAMES)}'))[1] AS first_line FROM documents)
SELECT doc_id, coalesce(first_line, '') AS first_line FROM l""")
def document_names(spark: SparkSession, d: str) -> DataFrame:
    """The first short line that is no heading of the document itself."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < 60) & ~F.lower(x).rlike("|".join(LINES_NOT_NAMES)))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("first_line"))


LOOKED_UP = ("r", "go", "python", "sql", "statistik", "statistics", "spreadsheet", "it")


@query(rf"""
SELECT doc_id, array_to_string(list_sort(list_filter({duck.texts(LOOKED_UP)}, lambda s: CASE WHEN length(s) <= 2 THEN regexp_matches(lower(coalesce(text, '')), '(^|[^\p{{L}}\p{{N}}_])' || s || '($|[^\p{{L}}\p{{N}}_])') ELSE contains(lower(coalesce(text, '')), s) END)), ',') AS skills FROM documents""")
def skill_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Skills of a list in a text: those of one or two letters as whole words, others anywhere."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){s}($|[^\p{{L}}\p{{N}}_])") if len(s) <= 2 else low.contains(s), F.lit(s)) for s in sorted(LOOKED_UP)]))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("skills"))


@query("""
SELECT doc_id, pos, substring(coalesce(text, ''), greatest(1, pos - 40), CASE WHEN pos > 40 THEN 40 ELSE pos - 1 END + 80) AS around FROM (SELECT doc_id, text, instr(lower(coalesce(text, '')), 'projekt') AS pos FROM documents) WHERE pos > 0""")
def word_context(spark: SparkSession, d: str) -> DataFrame:
    """The first place of a word and up to 40 characters on both sides of its beginning and end."""
    text, pos = F.coalesce("text", F.lit("")), F.instr(F.lower(F.coalesce("text", F.lit(""))), "projekt")
    around = F.substring(text, F.greatest(F.lit(1), pos - 40), F.when(pos > 40, 40).otherwise(pos - 1) + 80)
    return table(spark, d, "documents").select("doc_id", pos.cast("long").alias("pos"), around.alias("around")).where("pos > 0")


_GRAMS_PROFILE = "we are looking for a data engineer with knowledge of statistics and project planning for our data team"


def _gram_sql() -> str:
    grams = similarity.ngrams(_GRAMS_PROFILE)
    stop = duck.texts(similarity.STOP_WORDS)
    w = rf"list_filter(regexp_extract_all(lower(coalesce(description, '')), '[\p{{L}}\p{{N}}]{{2,}}'), lambda t: NOT list_contains({stop}, t))"
    base = f"WITH w AS (SELECT job_id, {w} AS w FROM jobs), g AS (SELECT job_id, list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w), n AS (SELECT job_id"
    keys = sorted(grams)
    counts = "".join(f", len(list_filter(g, lambda x: x = {duck.text(k)})) AS n{i}" for i, k in enumerate(keys))
    logs = [f"CASE WHEN n{i} > 0 THEN 1 + ln(n{i}) ELSE 0 END" for i in range(len(keys))]
    weights = [grams[k] for k in keys]
    size = sum(v * v for v in weights) ** 0.5
    dot = " + ".join(f"({x}) * {v!r}::DOUBLE" for x, v in zip(logs, weights))
    norm = " + ".join(f"({x}) * ({x})" for x in logs)
    return f"{base}{counts} FROM g) SELECT job_id, round(CASE WHEN {norm} = 0 THEN 0 ELSE least(100, 150 * ({dot}) / (sqrt({norm}) * {size!r}::DOUBLE)) END, 4) AS score FROM n"


@query(_gram_sql())
def ngram_cosine(spark: SparkSession, d: str) -> DataFrame:
    return similarity.ngram_cosine(table(spark, d, "jobs"), _GRAMS_PROFILE, "job_id", "description").select("job_id", F.round("score", 4).alias("score"))


@query("""
WITH s AS (SELECT job_id, match_score, CAST(quality.score AS DOUBLE) AS q FROM jobs)
SELECT job_id, round(CASE WHEN match_score IS NOT NULL AND NOT isnan(match_score) AND q IS NOT NULL THEN 0.6 * match_score + 0.4 * q ELSE coalesce(CASE WHEN isnan(match_score) THEN NULL ELSE match_score END, q, 0) END, 6) AS score FROM s""")
def blended_scores(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(~F.isnan("match_score"), F.col("match_score"))
    return table(spark, d, "jobs").select("job_id", F.round(similarity.blend(a, F.col("quality.score").cast("double")), 6).alias("score"))


@query("""
WITH p AS (SELECT coalesce(nullif(profile_slug, ''), 'none') AS slug, title, tags FROM jobs WHERE is_active = 1), k AS (SELECT slug, unnest(list_distinct(tags)) AS tag FROM p)
SELECT slug, repeat(string_agg(DISTINCT tag, ' ' ORDER BY tag) || ' ', 3) AS boosted FROM k WHERE tag IS NOT NULL GROUP BY slug""")
def boosted_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile's text with its skills three times, so that they weigh more."""
    tags = table(spark, d, "jobs").where("is_active = 1").select(F.coalesce(F.nullif("profile_slug", F.lit("")), F.lit("none")).alias("slug"), F.explode("tags").alias("tag")).where("tag is not null")
    return tags.groupBy("slug").agg(similarity.boosted(F.array_sort(F.collect_set("tag")), 3).alias("boosted"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
