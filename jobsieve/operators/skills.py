"""Skills in texts by a vocabulary with synonyms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alternation(names: list[str]) -> str:
    """Whole words only, in any script; longer names first."""
    return r"(?iU)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"


def extract_skills(df: DataFrame, vocabulary: dict[str, list[str]], id_col: str, text_col: str) -> DataFrame:
    """(id_col, skill, hits, confidence) of every skill found; all patterns are counted in one projection over each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = [F.struct(F.lit(skill).alias("skill"), F.regexp_count(text, F.lit(alternation(names))).alias("hits")) for skill, names in sorted(vocabulary.items())]
    found = F.filter(F.array(*counted), lambda s: s["hits"] > 0)
    return df.select(id_col, F.explode(found).alias("s")).select(id_col, "s.skill", F.col("s.hits").cast("long").alias("hits"), F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.1) * F.col("s.hits")).alias("confidence"))


def match_score(wanted: Column, owned: list[str], related: dict[str, list[str]]) -> Column:
    """min(100, 110 x coverage): an owned skill counts 1, one with a related owned skill 0.5; 50 if nothing is wanted."""
    have = F.array(*[F.lit(s) for s in owned])
    full = F.size(F.array_intersect(wanted, have))
    near = [s for s, others in related.items() if s not in owned and set(others) & set(owned)]
    half = F.size(F.array_intersect(wanted, F.array(*[F.lit(s) for s in near]) if near else F.array().cast("array<string>")))
    return F.when(F.size(wanted) == 0, F.lit(50.0)).otherwise(F.least(F.lit(100.0), (full + 0.5 * half) / F.size(wanted) * 110.0))


def gap(found: DataFrame, owned: list[str], top: int = 15) -> DataFrame:
    """The skills most often wanted and not owned, with their share of the most frequent one (a top-k report)."""
    counts = found.where(~F.col("skill").isin(*owned)).groupBy("skill").agg(F.count("*").alias("postings"))
    best = counts.agg(F.max("postings").alias("most"))
    return counts.join(F.broadcast(best)).select("skill", "postings", F.round(F.col("postings") / F.col("most"), 6).alias("share")).orderBy(F.desc("postings"), "skill").limit(top)
