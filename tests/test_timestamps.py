from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobsieve.operators.timestamps import dictionary, feed_zones, normalise_timestamps, parse, reference_instant, value_counts

SCHEMA = "job_id long, posted_date string, source string, scraped_at timestamp_ntz"
NOW = datetime(2024, 5, 5, 12)


def us(*a):
    return int((datetime(*a) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame([("B", "Europe/Berlin", "dmy"), ("N", "America/New_York", "mdy"), ("N", "America/New_York", "mdy"), ("Y", "Asia/Tokyo", "ymd"), (None, "UTC", "dmy")], "source string, time_zone string, day_order string")


CASES = [
    ("2024-03-31 02:30", "B", us(2024, 3, 31, 1, 30)),  # skipped: moved forward by the gap
    ("2024-10-27T02:30:00", "B", us(2024, 10, 27, 0, 30)),  # twice: the first
    ("03/04/2024", "B", us(2024, 4, 2, 22)), ("03/04/2024", "N", us(2024, 3, 4, 5)), ("2024/04/03", "Y", us(2024, 4, 2, 15)),
    ("1714900000", "B", 1714900000 * 10**6), ("1714900000123", "B", 1714900000123 * 1000), ("20240719T231736Z", "B", us(2024, 7, 19, 23, 17, 36)),
    ("Tue, 30 Jul 2024 15:15:52 +0200", "N", us(2024, 7, 30, 13, 15, 52)), ("1. August 2024, 17:03 Uhr", "B", us(2024, 8, 1, 15, 3)), ("Nov 12, 2024 12:23 AM", "N", us(2024, 11, 12, 5, 23)),
    ("2024-08-04 14:01:31.547383+05:30", "B", us(2024, 8, 4, 8, 31, 31) + 547383), ("03.11.24", "B", us(2024, 11, 2, 23)), ("2025-06-01 10:00:00 CST", "N", us(2025, 6, 1, 16)),
    ("vor einem Tag", "B", us(2024, 5, 4, 12)), ("Posted 3d ago", "B", us(2024, 5, 2, 12)), ("just now", "B", us(2024, 5, 5, 12)), ("gestern", "Y", us(2024, 5, 4, 12)), ("hace 2 horas", "B", us(2024, 5, 5, 10)), ("il y a 5 minutes", "B", us(2024, 5, 5, 11, 55)),
    ("31.02.2025", "B", None), ("30+ days ago", "B", None), ("vor mehr als 30 Tagen", "B", None), ("soon", "B", None), ("Q3 2025", "B", None), ("0000-00-00", "B", None), ("  ", "B", None), (None, "B", None), ("2025-13-04", "Y", None),
]


def test_notations(spark, feeds):
    df = spark.createDataFrame([(i, raw, src, NOW) for i, (raw, src, _) in enumerate(CASES)], SCHEMA)
    got = {r.job_id: r.utc_us for r in normalise_timestamps(df, feeds).collect()}
    zones = {"B": ("dmy", "Europe/Berlin"), "N": ("mdy", "America/New_York"), "Y": ("ymd", "Asia/Tokyo")}
    for i, (raw, src, expected) in enumerate(CASES):
        assert got.get(i) == expected, raw
        assert reference_instant(raw, *zones[src], NOW) == expected, raw


def test_edges(spark, feeds):
    df = spark.createDataFrame([(1, "2024-01-01", None, NOW), (1, "2024-01-01", None, NOW), (2, "today", "B", None), (None, "2024-01-01", "unknown", NOW), (3, "x" * 100_000, "B", NOW)], SCHEMA)
    clashing = df.select("*", F.lit(1).alias("kind"), F.lit(2).alias("micros"), F.lit("z").alias("time_zone"))
    assert sorted(((r.job_id, r.utc_us) for r in normalise_timestamps(clashing, feeds).collect()), key=str) == [(1, us(2024, 1, 1)), (None, us(2024, 1, 1))]
    assert normalise_timestamps(df.where("false"), feeds).count() == 0
    assert normalise_timestamps(df, feeds.where("false")).count() == 2


def test_dictionary_is_extended(spark, feeds, tmp_path):
    path = str(tmp_path / "dict")
    df = spark.createDataFrame([(1, "2024-01-01", "B", NOW), (2, "soon", "B", NOW)], SCHEMA)
    more = spark.createDataFrame([(3, "2024-01-01", "B", NOW), (4, "2024-02-02", "B", NOW)], SCHEMA)
    zones = feed_zones(feeds)
    kept = lambda frame, z=zones: dictionary(value_counts(frame, "posted_date", "source"), z, path)
    assert kept(df).count() == 2
    assert kept(more).count() == 3
    assert kept(more).count() == 3
    # A part that another writer left unfinished is not read, and one that holds the same entries doubles nothing.
    (tmp_path / "dict" / "half").mkdir()
    dictionary(value_counts(df, "posted_date", "source"), zones).write.parquet(f"{path}/other")
    assert kept(more).count() == 3
    # A source that moves to another zone is parsed anew, and only its present entries are used.
    moved = feeds.withColumn("time_zone", F.lit("Asia/Tokyo"))
    assert {r.utc_us for r in normalise_timestamps(more, moved, path=path).where("job_id = 3").collect()} == {us(2023, 12, 31, 15)}
    assert {r.utc_us for r in normalise_timestamps(more, feeds, path=path).where("job_id = 3").collect()} == {us(2023, 12, 31, 23)}


def test_frequent_values_are_spread(spark, feeds):
    df = spark.createDataFrame([(i, "today" if i % 3 else f"{i} minutes ago", "B", NOW) for i in range(600)], SCHEMA)
    got = {r.job_id: r.utc_us for r in normalise_timestamps(df, feeds).collect()}
    assert len(got) == 600 and got[1] == us(2024, 5, 5, 12) and got[3] == got[1] - 3 * 60_000_000


def test_parse_never_raises():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="0123456789 -/.:TZ+agodvrJunMayUhr,", max_size=30))
    def check(text):
        parse(text, "dmy", "Europe/Berlin")

    check()
