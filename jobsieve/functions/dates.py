"""Posting dates as native column expressions; every function takes the time that counts as now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of relative dates.
NOW_WORDS = ("just now", "moment", "gerade", "jetzt", "today", "heute")
YESTERDAY_WORDS = ("yesterday", "gestern")
HOUR_WORDS = ("hour", "stunde")
MINUTE_WORDS = ("min",)
RECENT_WORDS = ("just now", "moment", "gerade", "jetzt", "hour", "stunde", "minute", "min ago", "min.", "today", "heute", "1 day", "1 tag")
MONTH_NUMBERS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Notations: year, month, day, hour, minute, second and fraction as groups; the offset of a zone is dropped, as in the source.
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
YMD = r"^(\d{4})[/ -](\d{1,2})[/ -](\d{1,2})(?: (\d{1,2}):(\d{1,2}):(\d{1,2}))?()$"
DMY = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
MAIL = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+(?:[+-]\d{4}|[A-Z]{1,4}))?$"


def _instant(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, fraction: Column) -> Column:
    two = lambda c: F.lpad(F.when(c == "", F.lit("0")).otherwise(c), 2, "0")
    text = F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), F.rpad(F.substring(fraction, 1, 6), 6, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def iso_instant(text: Column) -> Column:
    g = [F.regexp_extract(text, ISO, i) for i in range(1, 8)]
    return F.when(text.rlike(ISO), _instant(*g))


def epoch_instant(text: Column) -> Column:
    """Digits as seconds, or as milliseconds if they are more than 10,000,000,000."""
    n = F.try_to_number(F.substring(text, 1, 15), F.lit("9" * 15)).cast("double")
    return F.when(text.rlike(r"^\d{1,15}$"), F.timestamp_micros((F.when(n > 1e10, n / 1000).otherwise(n) * 1e6).cast("long")).cast("timestamp_ntz"))


def posted_date(raw: Column, now: Column) -> Column:
    """The wall time that a posting date names: digits, relative words, ISO, mail dates and four plain notations, in this order; null for others."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    low = F.lower(text)
    back = lambda interval: now - F.expr(f"INTERVAL {interval}")
    none = F.lit("")
    ymd, dmy, mail = [[F.regexp_extract(text, p, i) for i in range(1, n)] for p, n in ((YMD, 7), (DMY, 4), (MAIL, 7))]
    months = F.create_map(*[x for m, i in MONTH_NUMBERS.items() for x in (F.lit(m), F.lit(f"{i:02}"))])
    plain = F.coalesce(
        iso_instant(text),
        F.when(text.rlike(MAIL), _instant(mail[2], F.coalesce(F.try_element_at(months, F.lower(mail[1])), F.lit("99")), mail[0], mail[3], mail[4], mail[5], none)),
        F.when(text.rlike(YMD), _instant(*ymd, none)),
        F.when(text.rlike(DMY), _instant(dmy[2], dmy[1], dmy[0], none, none, none, none)),
    )
    return (
        F.when(text == "", F.lit(None).cast("timestamp_ntz")).when(text.rlike(r"^\d+$"), epoch_instant(text)).when(_has(low, NOW_WORDS), now).when(_has(low, YESTERDAY_WORDS), back("1 DAY"))
        .when(_has(low, HOUR_WORDS), back("1 HOUR")).when(_has(low, MINUTE_WORDS), back("15 MINUTES")).otherwise(plain)
    )


def is_recent(raw: Column, now: Column, hours: int = 24) -> Column:
    """Whether a posting is younger than so many hours: by its instant if it has one, else by relative words of about a day."""
    text = F.coalesce(raw, F.lit(""))
    at = F.coalesce(epoch_instant(text), iso_instant(text)) if hours > 24 else iso_instant(text)
    return F.when(text == "", False).otherwise(F.coalesce(now - at < F.expr(f"INTERVAL {hours} HOURS"), _has(F.lower(text), RECENT_WORDS)))


def shown_date(raw: Column, now: Column) -> Column:
    """A posting date as it is shown: yyyy MM dd HH:mm:ss, the raw value if it can't be read, N/A if it is empty."""
    return F.when(F.coalesce(raw, F.lit("")) == "", "N/A").otherwise(F.coalesce(F.date_format(posted_date(raw, now), "yyyy MM dd HH:mm:ss"), raw))


def crawled_date(raw: Column, now: Column) -> Column:
    """The instant of a board's relative date: today, N days or N hours back; null for others."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    days, hours = F.regexp_extract(t, r"vor\s+(\d+)\s*tag|(\d+)\s+days?", 0), F.regexp_extract(t, r"(\d+)\s*hour|vor\s+(\d+)\s*stunde", 0)
    amount = lambda c: F.regexp_extract(c, r"\d+", 0).try_cast("int")
    today = _has(t, ("heute", "today", "just posted", "minutes ago", "minuten"))
    return F.when(t == "", F.lit(None).cast("timestamp_ntz")).when(today, now).when(days != "", now - F.make_dt_interval(amount(days))).when(hours != "", now - F.make_dt_interval(F.lit(0), amount(hours)))
