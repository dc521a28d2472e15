"""Text functions as native column expressions."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds any of the literals as a substring; false for null. For a computed text, which is computed once."""
    return F.coalesce(text.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """The same by plain searches, a few times faster; for a text that is a column of its own, for it is named once a word."""
    return F.coalesce(reduce(operator.or_, (text.contains(w) for w in words), F.lit(False)), F.lit(False))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def unescape(text: Column) -> Column:
    """The common character entities decoded in one pass: &amp; last, so that &amp;lt; becomes &lt;."""
    out = text
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.when(text.contains("&"), out).otherwise(text)


def clean_text(text: Column) -> Column:
    """Entities decoded, tags dropped, white space squeezed; empty for null. Texts without entities, tags or odd blanks pass without a pattern."""
    plain = unescape(F.coalesce(text, F.lit("")))
    bare = F.when(F.coalesce(text, F.lit("")).rlike("[<&]"), F.regexp_replace(plain, "<[^>]+>", " ")).otherwise(plain)
    return F.trim(F.regexp_replace(bare, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def clean_company(name: Column) -> Column:
    """A cleaned name without the wrapper "(via ...)"."""
    text = clean_text(name)
    inner = F.regexp_extract(text, r"(?i)^\(via\s+(.+?)\)$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(text)


def first_match(text: Column, pattern: str) -> Column:
    """The first match of a pattern, null if none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0)
    return F.when(found != "", found)
