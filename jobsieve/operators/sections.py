"""Sections of documents by their headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Heading words, the first that a line begins with names the section.
HEADINGS = (
    "profile", "summary", "objective", "about", "experience", "work experience", "professional experience", "employment", "education", "academic", "qualifications", "skills", "technical skills", "core competencies", "technologies", "projects",
    "personal projects", "academic projects", "certifications", "certificates", "awards", "awards & certificates", "languages", "language skills", "publications", "research", "references", "personal details", "personal information", "interests", "hobbies",
)
#: Lines of a text that are one block; the heading of a block is carried over from the blocks before it.
BLOCK = 10_000


def split_sections(df: DataFrame, id_col: str, text_col: str, headings: tuple[str, ...] = HEADINGS) -> DataFrame:
    """(id_col, section, content): the text under each heading, header for the lines above the first; no row for a heading without lines.

    A heading that comes again replaces what stood under it before. Every line takes the last heading at or before it by
    a running maximum; lines of one text are put in blocks, so that a very long text is spread over tasks. Null texts have
    one empty header; repeated rows give equal sections.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy(id_col, "text").agg(F.lit(1).alias("one"))
    lines = rows.select(F.col(id_col), F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    key = F.trim(F.regexp_replace(F.lower(F.trim("line")), r"[^a-z\s&]", ""))
    # Of the words that a line begins with the first listed one counts: the alternatives are tried in the order of the list.
    heading = F.regexp_extract(key, "^(" + "|".join(headings) + ")", 1)
    named = lines.withColumns({"heading": F.nullif(heading, F.lit("")), "block": F.floor(F.col("no") / BLOCK)}).withColumn("mark", F.when(F.col("heading").isNotNull(), F.struct("no", "heading")))
    text = [F.col(id_col), F.col("t")]
    within = named.withColumn("own", F.max("mark").over(W.partitionBy(*text, "block").orderBy("no").rowsBetween(W.unboundedPreceding, 0)))
    blocks = named.groupBy(*text, "block").agg(F.max("mark").alias("top"))
    carried = blocks.withColumn("before", F.max("top").over(W.partitionBy(*text).orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select(*text, "block", "before")
    placed = within.where("mark is null").join(carried, [id_col, "t", "block"]).withColumn("at", F.coalesce("own", "before"))
    parts = placed.groupBy(*text, F.coalesce("at.heading", F.lit("header")).alias("section"), F.coalesce("at.no", F.lit(-1)).alias("at")).agg(F.array_sort(F.collect_list(F.struct("no", "line")))["line"].alias("lines"))
    last = parts.groupBy(*text, "section").agg(F.max_by("lines", "at").alias("lines"))
    return last.select(F.col(id_col), "section", F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", "").alias("content"))
