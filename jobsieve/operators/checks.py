"""Checks of documents for machine readability: one score from 0 to 10 each, in long form, and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fonts, headings, characters and words that a check knows.
STANDARD_FONTS = ("arial", "helvetica", "times", "timesnewroman", "times new roman", "calibri", "cambria", "garamond", "georgia", "verdana", "tahoma", "courier", "couriernew", "courier new", "palatino", "bookman", "cmr", "cmss", "cmtt", "lmroman", "lmsans")
STANDARD_SECTIONS = (
    "experience", "work experience", "professional experience", "employment", "education", "academic background", "qualifications", "skills", "technical skills", "core competencies", "projects", "personal projects", "certifications", "certificates",
    "awards", "awards & certificates", "languages", "language skills", "summary", "profile", "objective", "about me", "publications", "research", "references", "personal details", "personal information",
)
ODD_CHARACTERS = "•·|→←↑↓★☆▪▫►◄■□●○♦♣♠♥✔✘✦✧⊕⊗⊙⊛"
PLAIN_LETTERS = "äöüÄÖÜßéèêëàâîïôûùçñ—–‘’“”\"'…"
ORDER_MARKS = ("profile", "experience", "education", "skills", "projects")
KEYWORDS = ("python", "java", "sql", "data", "engineering", "backend", "software", "aws", "cloud", "docker", "api", "database", "spark", "hadoop", "etl", "machine learning", "pipeline", "development", "agile", "testing", "ci/cd", "git", "microservices", "rest", "linux", "kubernetes")
MAIL, PHONE = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
NETWORK = r"(?i)linkedin\.com/in/[\w-]+"
GRADES = ((90, "A"), (75, "B"), (60, "C"), (45, "D"))


def steps(value: Column, *bounds: tuple[int, int], other: int) -> Column:
    """The score of the first bound that the value does not exceed."""
    out = F.when(value <= bounds[0][0], bounds[0][1])
    for top, score in bounds[1:]:
        out = out.when(value <= top, score)
    return out.otherwise(other)


def text_checks(text: Column, sections: Column | None = None) -> dict[str, Column]:
    """The checks that need the text alone, and with an array of section names that of the headings."""
    plain = F.coalesce(text, F.lit(""))
    low = F.lower(plain)
    n = F.length(F.trim(plain))
    odd = F.size(F.array_distinct(F.regexp_extract_all(plain, F.lit(rf"([{ODD_CHARACTERS}]|[^\x00-\x7f{PLAIN_LETTERS}])"), F.lit(1))))
    at = {w: F.instr(low, w) for w in ORDER_MARKS}
    marks = sum((F.when(x > 0, 1).otherwise(0) for x in at.values()), F.lit(0))
    found = sum((F.when(low.contains(w), 1).otherwise(0) for w in KEYWORDS), F.lit(0))
    contact = sum((F.when(plain.rlike(p), 1).otherwise(0) for p in (MAIL, PHONE, NETWORK)), F.lit(0))
    checks = {
        "text": F.when(n == 0, 0).when(n < 200, 3).when(n < 500, 6).otherwise(10),
        "characters": F.when(odd == 0, 10).when(odd <= 3, 7).otherwise(4),
        "contact": F.floor(contact / F.lit(3) * 10).cast("int"),
        "order": F.when(marks < 2, 5).when((at["profile"] > 0) & (at["experience"] > 0) & (at["profile"] > at["experience"]), 5).otherwise(10),
        "keywords": F.least(F.lit(10), F.floor(found / F.lit(len(KEYWORDS)) * 12).cast("int")),
    }
    if sections is not None:
        own = F.filter(sections, lambda s: F.lower(F.trim(s)) != "header")
        standard = F.size(F.filter(own, lambda s: F.lower(F.trim(s)).isin(*STANDARD_SECTIONS)))
        checks["headings"] = F.when(F.size(own) == 0, 3).when(standard == F.size(own), 10).otherwise(F.greatest(F.lit(3), F.floor(standard / F.size(own) * 10).cast("int")))
    return checks


def file_checks(images: Column, tables: Column, fonts: Column, size: Column, pages: Column, links: Column, readable: Column) -> dict[str, Column]:
    """The checks that need what a reader of files reports."""
    odd = F.size(F.filter(fonts, lambda f: ~F.exists(F.array(*[F.lit(s) for s in STANDARD_FONTS]), lambda s: F.contains(F.regexp_replace(F.lower(f), "[- ]", ""), s))))
    valid = F.forall(links, lambda u: u.rlike(r"^https?://[\w.-]+|^mailto:"))
    mb = 1024 * 1024
    return {
        "images": steps(images, (0, 10), (1, 6), (3, 4), other=2),
        "tables": steps(tables, (0, 10), (2, 6), other=3),
        "fonts": F.when(F.coalesce(F.size(fonts), F.lit(0)) <= 0, 5).otherwise(steps(odd, (0, 10), (2, 7), other=4)),
        "size": steps(size, (mb, 10), (2 * mb, 8), (5 * mb, 5), other=2),
        "pages": F.when(pages == 1, 10).when(pages == 2, 9).when(pages == 3, 6).otherwise(3),
        "links": F.when(F.coalesce(F.size(links), F.lit(0)) <= 0, 7).when(valid, 10).otherwise(7),
        "readable": F.when(F.coalesce(readable, F.lit(False)), 10).otherwise(0),
    }


def only_at_the_edge(mail: Column, edge_text: Column, main_text: Column) -> Column:
    """Score of the check that a mail address does not stand in headers and footers alone."""
    m = F.lower(mail)
    return F.when(mail.isNotNull() & F.contains(F.lower(edge_text), m) & ~F.contains(F.lower(main_text), m), 5).otherwise(10)


def status(score: Column) -> Column:
    return F.when(score >= 8, "pass").when(score >= 5, "warning").otherwise("fail")


def long_form(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """(id_col, check, score, status), one row per check."""
    cells = F.array(*[F.struct(F.lit(name).alias("check"), c.cast("int").alias("score")) for name, c in checks.items()])
    return df.select(id_col, F.explode(cells).alias("x")).select(id_col, "x.check", "x.score", status(F.col("x.score")).alias("status"))


def report(long: DataFrame, id_col: str) -> DataFrame:
    """(id_col, overall, grade, failed, warned, critical): the whole per cent of all points, its grade, and the failed checks in alphabetical order."""
    overall = F.floor(F.sum("score") / (F.count("*") * 10) * 100).cast("int")
    grouped = long.groupBy(id_col).agg(overall.alias("overall"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warning").alias("warned"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "fail", F.col("check")))), "|").alias("critical"))
    grade = F.when(F.col("overall") >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        grade = grade.when(F.col("overall") >= least, name)
    return grouped.select(id_col, "overall", grade.otherwise("F").alias("grade"), "failed", "warned", "critical")
