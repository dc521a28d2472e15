"""Levels that a text asks for - experience, education, a language - as native column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of requirements. Of the experience patterns a later one overrides an earlier one; of the others the first that occurs decides.
YEARS = r"(?i)(\d+)\+?\s*(?:years?|jahre?|yrs?)\s*(?:of\s+)?(?:experience|erfahrung|berufserfahrung)"
YEAR_RANGE = r"(?i)(\d+)\s*[-–]\s*(\d+)\s*(?:years?|jahre?)\s*(?:of\s+)?(?:experience|erfahrung)"
SENIOR = r"(?i)\b(?:senior|lead|principal|staff|expert)\b"
ENTRY = r"(?i)\b(?:junior|entry.?level|graduate|werkstudent|working.?student|intern|praktikant|trainee|berufseinsteiger)\b"
MIDDLE = r"(?i)\b(?:mid.?level|intermediate|experienced)\b"
_BEGIN, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"  # the borders of a word in any script
EDUCATION = tuple(
    (name, f"(?i){_BEGIN}(?:{words}){_END}")
    for name, words in (
        ("phd", r"ph\.?d|doktor|doctorate|promotion"), ("master_completed", r"master(?:'s)?\s+(?:of|in|degree)|m\.?sc\.?|m\.?a\.?|master\s+abschluss|masterabschluss"),
        ("master_current", r"master(?:'s)?\s+student|currently\s+(?:pursuing|studying)\s+master|masterstudent|masterstudium"), ("bachelor", r"bachelor(?:'s)?(?:\s+(?:of|in|degree))?|b\.?sc\.?|b\.?a\.?|bachelorabschluss"),
    )
)
LANGUAGE_LEVEL = (r"(?i)deutsch(?:kenntnisse|e?\s+sprach)?\s*(?:auf\s+)?(?:niveau\s*)?([abc][12])", r"(?i)german\s+(?:language\s+)?(?:level\s+)?([abc][12])")
LANGUAGE_FLUENT = r"(?i)flie[sß]end(?:e[srmn]?)?\s+deutsch|flie[s]send(?:e[srmn]?)?\s+deutsch|deutsch\s+(?:als\s+)?muttersprach|verhandlungssicher(?:e[srmn]?)?\s+deutsch"
LANGUAGE_VERY_GOOD, LANGUAGE_GOOD = r"(?i)sehr\s+gute?\s+deutsch", r"(?i)gute?\s+deutsch"
LANGUAGE_WELCOME = r"(?i)german\s+(?:is\s+)?(?:a\s+)?(?:plus|advantage|asset|beneficial)|deutsch(?:kenntnisse)?\s+(?:w[aue]ren?|sind?)\s+(?:von\s+)?vorteil|ideally\s+(?:also\s+)?(?:speaking?\s+)?german"
LANGUAGE_WORDS = r"\b(und|oder|die|das|der|mit|von|ist|als|bei|auf|aus|nach)\b"


def experience_level(text: Column) -> Column:
    """(level, min_years, max_years): entry, mid or senior from years, a range of years and words, unknown without any."""
    plain = F.coalesce(text, F.lit(""))
    number = lambda p, i: F.regexp_extract(plain, p, i).try_cast("int")
    years, low, high = number(YEARS, 1), number(YEAR_RANGE, 1), number(YEAR_RANGE, 2)
    by = lambda top, n: F.when(top >= 7, "senior").when(n >= 3, "mid").otherwise("entry")
    level = F.when(plain.rlike(MIDDLE), "mid").when(plain.rlike(ENTRY), "entry").when(plain.rlike(SENIOR), "senior").when(low.isNotNull(), by(high, low)).when(years.isNotNull(), by(years, years)).otherwise("unknown")
    return F.struct(level.alias("level"), F.coalesce(low, years, F.lit(0)).alias("min_years"), F.coalesce(high, F.lit(0)).alias("max_years"))


def education_level(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    out = F.when(plain.rlike(EDUCATION[0][1]), EDUCATION[0][0])
    for name, pattern in EDUCATION[1:]:
        out = out.when(plain.rlike(pattern), name)
    return out.otherwise("unknown")


def german_requirement(text: Column) -> Column:
    """The level of German that a text asks for: named, implied by words, preferred, or implied by a text in German; empty if none."""
    plain = F.coalesce(text, F.lit(""))
    named = [F.nullif(F.upper(F.regexp_extract(plain, p, 1)), F.lit("")) for p in LANGUAGE_LEVEL]
    words = F.regexp_count(F.lower(plain), F.lit(LANGUAGE_WORDS)) > 10
    return F.coalesce(*named, F.when(plain.rlike(LANGUAGE_FLUENT), "C1").when(plain.rlike(LANGUAGE_VERY_GOOD), "B2").when(plain.rlike(LANGUAGE_GOOD), "B1").when(plain.rlike(LANGUAGE_WELCOME), "preferred").when(words, "B1").otherwise(""))


# Characters that a typesetting system needs in another form, in this order.
TYPESET = (("”", '"'), ("“", '"'), ("’", "'"), ("–", "-"), ("—", "--"), ("•", "-"), (" ", " "), ("·", r"\textperiodcentered{}"), ("¨", '"'))
TYPESET_MARKS = (("|", r"\textbar{}"), (r"\cdot", r"\textperiodcentered{}"))


def typeset(text: Column) -> Column:
    """A text with typographic characters in the form of a typesetting system; a bar or dot set as mathematics becomes text."""
    out = F.coalesce(text, F.lit(""))
    for old, new in TYPESET:
        out = F.replace(out, F.lit(old), F.lit(new))
    for mark, new in TYPESET_MARKS:
        for before in ("", " "):
            for after in ("", " "):
                out = F.replace(out, F.lit(f"${before}{mark}{after}$"), F.lit(new))
    return out
