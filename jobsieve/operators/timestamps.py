"""Timestamps in mixed notations and time zones as instants (problem 4).

Raw strings are reduced to a dictionary of distinct (string, source) values; each is parsed once, by the first notation
that fits the whole string; the dictionary can be kept in a folder and is then only extended by values it lacks. The
parser gives an instant, a wall time (turned into an instant with the source's zone by the JVM's zone rules), or an amount
that counts back from the row's own reference time; the join brings them back to the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.session import finished, remove, write_once

EPOCH = datetime(1970, 1, 1)
#: Fixed offsets, in hours, of zone abbreviations; those with several meanings are settled by the source's zone below.
OFFSETS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "MEZ": 1, "CEST": 2, "MESZ": 2, "EET": 2, "EEST": 3, "MSK": 3, "JST": 9, "KST": 9, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "IST": 5.5,
}
REGIONAL = {("IST", "Europe"): 1, ("IST", "Asia/Jerusalem"): 2, ("CST", "Asia"): 8}
_MONTHS = (
    "jan january januar janvier enero januari gennaio janv ene gen jän jänner", "feb february februar février febrero februari febbraio févr fév", "mar march märz mars marzo maart mär mrz mrt", "apr april avril abril aprile avr abr", "may mai mayo mei maggio mag",
    "jun june juni juin junio giugno giu", "jul july juli juillet julio luglio juil lug", "aug august août agosto augustus aoû ago", "sep september septembre septiembre settembre sept set", "oct october oktober octobre octubre ottobre okt ott",
    "nov november novembre noviembre", "dec december dezember décembre diciembre dicembre dez déc dic",
)
MONTHS = {word: i + 1 for i, words in enumerate(_MONTHS) for word in words.split()}
_UNITS = {
    1: "s sec secs second seconds sekunde sekunden seconde secondes segundo segundos seconden secondo secondi", 60: "m min mins minute minutes minuten minuto minutos minuut minuti",
    3600: "h hr hrs hour hours stunde stunden std heure heures hora horas uur uren ora ore", 86400: "d day days tag tage tagen jour jours día días dia dias dag dagen giorno giorni", 604800: "w wk week weeks woche wochen semaine semaines semana semanas weken settimana settimane",
    2592000: "month months monat monate monaten mois mes meses maand maanden mese mesi", 31536000: "y year years jahr jahre jahren an ans année années año años jaar jaren anno anni",
}
UNITS = {word: seconds for seconds, words in _UNITS.items() for word in words.split()}
ONE = set("a an one ein eine einem einer einen un une una uno een".split())
NOW = re.compile(r"(?:today|just now|now|just posted|a moment ago|heute|gerade(?: eben)?|soeben|eben|jetzt|neu|aujourd'hui|à l'instant|maintenant|hoy|ahora(?: mismo)?|ahora|justo ahora|vandaag|zojuist|zonet|nu|oggi|adesso|proprio ora|ora)")
YESTERDAY = re.compile(r"(?:yesterday|gestern|hier|ayer|gisteren|ieri)")
DAY_BEFORE = re.compile(r"(?:the day before yesterday|day before yesterday|vorgestern|avant-hier|anteayer|antes de ayer|eergisteren|l'altro ieri|avantieri)")
AMOUNT = re.compile(r"(?:(?:vor|il y a|hace|seit|since)\s+)?(\d{1,6}|[^\W\d]+)\s*([^\W\d]+)\.?(?:\s+(?:ago|geleden|fa|her))?")
MARKED = re.compile(r"^(?:vor|il y a|hace)\s|\s(?:ago|geleden|fa|her)$")
LEAD = re.compile(r"^(?:(?:posted|published|added|updated|online|veröffentlicht|eingestellt|publiée?|publicado|geplaatst|pubblicat[oa])(?:\s+(?:on|am|seit|le|el|op|il))?\s*:?\s+)")
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]\.?m\.?)?(?:\s*(?:uhr|h))?"
_ZONE = r"\s*(z|[+-]\d{2}:?\d{2}|[+-]\d{2}|(?:gmt|utc)[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5})?(?:\s*\([a-z ]+\))?"
_AT = r"(?:\s*,\s*|\s+(?:at|um|à|a las|om|alle)\s+|t|\s+)"
NOTATIONS = (
    ("ymd", re.compile(rf"(\d{{4}})([-/. ])(\d{{1,2}})\2(\d{{1,2}})(?:{_AT}{_TIME}{_ZONE})?")),
    ("compact", re.compile(rf"(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE}")),
    ("dots", re.compile(rf"(\d{{1,2}})([.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:{_AT}{_TIME}{_ZONE})?")),
    ("slashes", re.compile(rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:{_AT}{_TIME}{_ZONE})?")),
    ("day_first", re.compile(rf"(?:[^\W\d]{{2,10}}\.?,?\s+)?(\d{{1,2}})(?:\.|st|nd|rd|th)?\s*(?:of\s+|de\s+)?-?([^\W\d]{{3,10}})\.?,?-?\s*(?:de\s+)?(\d{{4}}|\d{{2}})(?:{_AT}{_TIME}{_ZONE})?")),
    ("month_first", re.compile(rf"(?:[^\W\d]{{2,10}}\.?,?\s+)??([^\W\d]{{3,10}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:{_AT}{_TIME}{_ZONE})?")),
)


def _zone_hours(zone: str, source_zone: str | None) -> float | None:
    zone = zone.upper()
    if m := re.fullmatch(r"(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?", zone):
        hours = int(m[2]) + int(m[3] or 0) / 60
        return None if hours > 18 or int(m[3] or 0) > 59 else hours if m[1] == "+" else -hours
    for (name, region), hours in REGIONAL.items():
        if zone == name and (source_zone or "").startswith(region):
            return hours
    return OFFSETS.get(zone)


def _micros(value: datetime) -> int:
    return (value - EPOCH) // timedelta(microseconds=1)


def _clock(hour: str | None, minute: str | None, second: str | None, fraction: str | None, half: str | None) -> tuple[int, int, int, int]:
    h = int(hour or 0)
    if half:
        if not 1 <= h <= 12:
            raise ValueError
        h = h % 12 + (12 if half[0] == "p" else 0)
    return h, int(minute or 0), int(second or 0), int((fraction or "0")[:6].ljust(6, "0"))


def parse(raw: str | None, day_order: str | None = None, source_zone: str | None = None) -> tuple[str, int] | None:
    """('instant' | 'wall' | 'ago', microseconds) of a string that names a day or an instant, else None.

    An instant counts from 1970-01-01 UTC, a wall time from 1970-01-01 of its zone, 'ago' back from the reference time.
    """
    if raw is None:
        return None
    text = " ".join(raw.split()).lower().strip(" \"'")
    if not text:
        return None
    if re.fullmatch(r"\d{9,16}", text):
        seconds = int(text)
        return "instant", seconds * (1_000_000 if len(text) <= 11 else 1_000 if len(text) <= 14 else 1)
    text = LEAD.sub("", text)
    if NOW.fullmatch(text):
        return "ago", 0
    if YESTERDAY.fullmatch(text):
        return "ago", 86_400_000_000
    if DAY_BEFORE.fullmatch(text):
        return "ago", 2 * 86_400_000_000
    if (m := AMOUNT.fullmatch(text)) and (MARKED.search(text) or re.fullmatch(r"\d+\s*[a-z]", text)):
        count = int(m[1]) if m[1].isdigit() else 1 if m[1] in ONE else None
        unit = UNITS.get(m[2])
        return None if count is None or unit is None else ("ago", count * unit * 1_000_000)
    for name, notation in NOTATIONS:
        m = notation.fullmatch(text)
        if not m:
            continue
        g = m.groups()
        try:
            if name == "ymd":
                year, month, day, rest = g[0], g[2], g[3], g[4:]
            elif name == "compact":
                year, month, day, rest = g[0], g[1], g[2], (g[3], g[4], g[5], g[6], None, g[7])
            elif name == "dots":
                day, month, year, rest = g[0], g[2], g[3], g[4:]
            elif name == "slashes":
                (day, month), year, rest = (g[:2] if (day_order or "dmy") != "mdy" else g[1::-1]), g[2], g[3:]
                if day_order == "ymd" and len(year) == 2:
                    year, month, day = g[0], g[1], g[2]
            elif name == "day_first":
                day, month, year, rest = g[0], MONTHS.get(g[1]), g[2], g[3:]
            else:
                month, day, year, rest = MONTHS.get(g[0]), g[1], g[2], g[3:]
            if month is None:
                continue
            year = int(year) + (2000 if len(year) == 2 else 0)
            value = datetime(year, int(month), int(day), *_clock(*rest[:5]))
        except (ValueError, OverflowError):
            return None
        zone = rest[5] if len(rest) > 5 else None
        if not zone:
            return "wall", _micros(value)
        hours = _zone_hours(zone, source_zone)
        return None if hours is None else ("instant", _micros(value) - round(hours * 3_600_000_000))
    return None


#: Of the rules by which values are parsed; a kept dictionary belongs to one version.
VERSION = 1
ENTRY = ["raw", "source", "day_order", "time_zone"]
#: A value with this share of all rows is a hot key of the join back to the rows; there are at most 1 / HOT of them. The rows
#: of each are spread over SALTS tasks.
HOT, SALTS = 1e-4, 64


def parse_distinct(values: DataFrame) -> DataFrame:
    """ENTRY with kind and micros for distinct ENTRY rows; kind is null where nothing is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, order, zone = (batch.column(i).to_pylist() for i in (0, 2, 3))
            found = [parse(r, o, z) or (None, None) for r, o, z in zip(raw, order, zone)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], [*ENTRY, "kind", "micros"])

    return values.select(*ENTRY).mapInArrow(run, "raw string, source string, day_order string, time_zone string, kind string, micros long")


def value_counts(df: DataFrame, raw_col: str, source_col: str) -> DataFrame:
    """(raw, source, n) of the values that are not blank."""
    return df.select(F.col(raw_col).alias("raw"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).where("raw is not null and trim(raw) <> ''").groupBy("raw", "source").agg(F.count("*").alias("n"))


def dictionary(values: DataFrame, zones: DataFrame, path: str | None = None) -> DataFrame:
    """The parsed entries of distinct (raw, source); with a path, from the dictionary kept there, extended by what it lacks.

    A kept dictionary is a folder of parts. Each extension writes a part of its own, and only parts whose write has ended are
    read, so that a failed or concurrent extension leaves no half and no double entries. Zone and order of the day are part
    of an entry: a source that changes them is parsed anew.
    """
    wanted = values.select("raw", "source").join(F.broadcast(zones), "source", "left").select(*ENTRY)
    if path is None:
        return write_once(parse_distinct(wanted))
    spark = values.sparkSession
    parts = finished(spark, path)
    kept = spark.read.parquet(*parts).dropDuplicates(ENTRY) if parts else None
    if kept is not None:
        old = kept.select(*[F.col(c).alias(f"k_{c}") for c in ENTRY])
        same = (F.col("raw") == F.col("k_raw")) & (F.col("source") == F.col("k_source")) & F.col("day_order").eqNullSafe(F.col("k_day_order")) & F.col("time_zone").eqNullSafe(F.col("k_time_zone"))
        wanted = wanted.join(old, same, "left_anti")
    part = f"{path}/{uuid4().hex}"
    parse_distinct(wanted).write.parquet(part)
    fresh = spark.read.parquet(part)
    if kept is not None and fresh.isEmpty():
        remove(spark, part)
        return kept
    return fresh if kept is None else kept.unionByName(fresh).dropDuplicates(ENTRY)


def feed_zones(feeds: DataFrame) -> DataFrame:
    """One row per source: (source, time_zone, day_order). The feeds are a list kept by hand, of bounded size."""
    return feeds.where("source is not null").groupBy("source").agg(F.min("time_zone").alias("time_zone"), F.min("day_order").alias("day_order"))


def normalise_timestamps(df: DataFrame, feeds: DataFrame, id_col: str = "job_id", raw_col: str = "posted_date", source_col: str = "source", reference_col: str = "scraped_at", path: str | None = None) -> DataFrame:
    """Distinct (id_col, utc_us): the rows whose raw value names a day or an instant, in microseconds since 1970-01-01 UTC.

    A value without zone is wall time in its source's zone (UTC for an unknown source); a wall time that occurs twice means
    its first occurrence, a skipped one is moved forward by the gap; a day alone means its local midnight. Relative values
    count back from the reference time in exact units; without a reference time they give no row. Null, blank, impossible
    and open-ended values and words without a date give no row. Repeated rows give one row.
    """
    zones = feed_zones(feeds)
    with_id = F.col(id_col)
    rows = df.select(with_id, F.col(raw_col).alias("raw"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(reference_col).cast("timestamp_ntz").alias("reference")).where("raw is not null and trim(raw) <> ''")
    values = write_once(value_counts(df, raw_col, source_col))
    today = zones.select("source", F.col("day_order").alias("z_order"), F.col("time_zone").alias("z_zone"))
    entries = dictionary(values, zones, path).where("kind is not null").join(F.broadcast(today), "source", "left")
    entries = entries.where(F.col("day_order").eqNullSafe(F.col("z_order")) & F.col("time_zone").eqNullSafe(F.col("z_zone"))).select("raw", "source", "time_zone", "kind", "micros")
    # Rows of frequent values are spread over SALTS tasks, to which the few entries of those values are copied.
    total = values.agg(F.sum("n").alias("total"))
    hot = values.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2.0), HOT * F.col("total"))).select("raw", "source", F.lit(True).alias("hot"))
    salted = rows.join(F.broadcast(hot), ["raw", "source"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(with_id, "reference"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    parsed = entries.join(F.broadcast(hot), ["raw", "source"], "left").withColumn("salt", F.explode(copies)).drop("hot")
    reference_us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', reference)")
    zone = F.coalesce("time_zone", F.lit("UTC"))
    joined = salted.join(parsed, ["raw", "source", "salt"])
    utc = (
        F.when(F.col("kind") == "instant", F.col("micros"))
        .when(F.col("kind") == "wall", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("micros"), zone)))
        .otherwise(reference_us - F.col("micros"))
    )
    return joined.select(F.col(id_col), utc.alias("utc_us")).where("utc_us is not null").distinct()


def reference_instant(raw: str | None, day_order: str | None, zone: str | None, reference: datetime | None) -> int | None:
    """The same for a single value, in Python, for tests against the distributed form."""
    from zoneinfo import ZoneInfo

    found = parse(raw, day_order, zone)
    if found is None:
        return None
    kind, micros = found
    if kind == "instant":
        return micros
    if kind == "ago":
        return None if reference is None else _micros(reference) - micros
    wall = EPOCH + timedelta(microseconds=micros)
    return _micros(wall.replace(tzinfo=ZoneInfo(zone or "UTC")).astimezone(timezone.utc).replace(tzinfo=None))
