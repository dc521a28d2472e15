"""Queries of the training-data problems, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobsieve.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.boilerplate import find_boilerplate

    lines = find_boilerplate(table(spark, d, "jobs"))
    return lines.select("job_id", "line_no").distinct().join(_residual_descriptions(spark, d), "job_id", "left_anti")


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.boilerplate import main_text

    return main_text(table(spark, d, "jobs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.canonical import map_to_references

    return map_to_references(table(spark, d, "jobs"), table(spark, d, "ref_places"), table(spark, d, "ref_job_types"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How often each value without an entry occurs."""
    from jobsieve.llm.canonical import map_values, reference_names

    jobs = table(spark, d, "jobs")
    missing = map_values(jobs, reference_names(table(spark, d, "ref_places"), table(spark, d, "ref_job_types"))).where("ref_id = -1")
    typed = jobs.selectExpr("'location' AS field_name", "location AS raw").unionAll(jobs.selectExpr("'job_type'", "job_type"))
    return typed.groupBy("field_name", "raw").count().withColumnRenamed("count", "n").join(missing.drop("ref_id"), ["field_name", "raw"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.tokens import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.contamination import find_leaks

    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.contamination import leak_report

    return leak_report(p9_found(spark, d), table(spark, d, "eval_items"))


def _residual_descriptions(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.residue import find_residue

    return find_residue(table(spark, d, "jobs"), fields=["description"]).select("job_id").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.truncation import find_truncated

    return find_truncated(table(spark, d, "jobs")).join(_residual_descriptions(spark, d), "job_id", "left_anti")


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.truncation import truncation_by_source

    return truncation_by_source(table(spark, d, "jobs"), p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.languages import find_wrong_labels
    from jobsieve.llm.residue import find_residue

    jobs = table(spark, d, "jobs")
    cases = find_wrong_labels(jobs, table(spark, d, "posting_labels"))
    residue = find_residue(jobs).select("job_id", "field_name").distinct()
    return cases.select("job_id", "field_name", "lang").distinct().join(residue, ["job_id", "field_name"], "left_anti")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.languages import text_segments, train, training_rows

    jobs = table(spark, d, "jobs")
    return text_segments(jobs, train(training_rows(jobs, table(spark, d, "posting_labels"), "job_id", "title", "description", "lang")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.names import variant_pairs

    return variant_pairs(table(spark, d, "jobs"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.names import link_names

    return link_names(table(spark, d, "jobs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.residue import find_residue

    return find_residue(table(spark, d, "jobs")).select("job_id", "field_name").distinct()


def p5_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.residue import recurrent_lines

    return recurrent_lines(table(spark, d, "jobs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.personal import find_personal

    return find_personal(table(spark, d, "documents"), table(spark, d, "ref_places"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    from jobsieve.llm.personal import redact

    return redact(table(spark, d, "documents"), table(spark, d, "ref_places"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_WINDOWS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(item_text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 11], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)), iw AS (SELECT DISTINCT item_id, md5(array_to_string(w[k:k + 11], ' ')) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (h))"""
_LINES = r"""
WITH j AS (SELECT row_number() OVER () AS r, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:\s]+)', 1)), '^www\.', '') AS host, description FROM jobs),
l AS (SELECT DISTINCT r, host, trim(regexp_replace(regexp_replace(lower(regexp_replace(line, '(?i)</?(?:p|li|ul|ol|br|div|b|i|em|strong|h\d)\b[^<>]*>', ' ', 'g')), '\s+', ' ', 'g'), '\d[\da-f]*', '0', 'g')) AS line FROM (SELECT r, host, unnest(string_split(coalesce(description, ''), chr(10))) AS line FROM j)),
n AS (SELECT host, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL), m AS (SELECT host, count(*) AS records FROM j GROUP BY host)
SELECT host, line, n, records FROM n JOIN m USING (host) WHERE n > 1 AND n >= 0.05 * (records + 20)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the problems that have a plain definition; the others are tested against brute force and planted cases."""
    from jobsieve.llm.twins import canonical_sql

    return {
        "p9_found": _WINDOWS + " SELECT doc_id, item_id FROM leaks",
        "p9_report": _WINDOWS + " SELECT item_id, count(doc_id) AS documents FROM (SELECT DISTINCT item_id FROM eval_items) LEFT JOIN leaks USING (item_id) GROUP BY item_id",
        "p5_boilerplate": _LINES,
        "p7_found": canonical_sql() + " SELECT DISTINCT job_id, field_name, ref_id FROM mapped",
        "p7_unmatched": canonical_sql() + " SELECT field_name, raw, count(*) AS n FROM mapped WHERE ref_id = -1 GROUP BY field_name, raw",
    }
