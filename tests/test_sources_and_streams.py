import os
from datetime import datetime

from jobsieve.sources import postings as P
from jobsieve.streaming.ingest import Store, ingest, run_windows, windowed_counts


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_board_json(spark):
    raw = spark.createDataFrame([('{"data": [{"title": "Dev <b>x</b>", "company_name": "A", "url": "https://x.example/1", "description": "Full-time &amp; remote", "salary_min": 40000, "salary_max": 50000, "odd": 1}, {"title": "", "url": "u"}]}',), ("not json",)], "raw string")
    (r,) = rows(P.board_json(raw, "board", types=["Part-time", "Full-time"]))
    assert (r["title"], r["description"], r["salary"], r["job_type"], r["tags"]) == ("Dev x", "Full-time & remote", "€40,000 - €50,000", "Full-time", [])


def test_feed_and_sitemap(spark):
    item = "<item><title>Engineer bei Acme - Town</title><link>https://x.example/2</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"
    (r,) = rows(P.feed_xml(spark.createDataFrame([(item,)], "raw string"), "feed"))
    assert (r["title"], r["company"], r["description"]) == ("Engineer", "Acme - Town", "Hi")
    xml = "<urlset><url><loc>https://x.example/jobs/data-engineer</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://x.example/blog/job</loc></url></urlset>"
    (r,) = rows(P.sitemap_xml(spark.createDataFrame([(xml,)], "raw string"), "map"))
    assert (r["title"], r["posted_date"]) == ("Data Engineer", "2024-01-02")


def test_pages(spark):
    page = '<html><script type="application/ld+json">{"@type": "JobPosting", "title": "Planner", "url": "https://x.example/3", "hiringOrganization": {"name": "B"}, "jobLocation": {"address": {"addressLocality": "Town"}}}</script><a href="/jobs/7">Planner &amp; more</a><a href="/about">About us</a></html>'
    raw = spark.createDataFrame([(page,), (None,)], "raw string")
    (r,) = rows(P.page_jsonld(raw, "page"))
    assert (r["title"], r["company"], r["location"]) == ("Planner", "B", "Town")
    (r,) = rows(P.page_links(raw, "page"))
    assert (r["title"], r["url"]) == ("Planner & more", "/jobs/7")


def test_applicant_system_and_union(spark):
    raw = spark.createDataFrame([("acme-pumps", '{"jobs": [{"title": "Dev", "absolute_url": "https://x.example/1", "location": {"name": "Town"}, "content": "c"}]}')], "slug string, raw string")
    a = P.applicant_system_json(raw, "ats")
    b = P.applicant_system_json(raw, "other")
    (r,) = rows(P.first_wins(a, b))
    assert (r["company"], r["source"]) == ("Acme Pumps", "ats")
    assert P.filter_postings(a, "town", ["dev"]).count() == 1 and P.filter_postings(a, "city").count() == 0


def test_ingest_merges_micro_batches(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1, h)
    schema = "job_id long, url string, title string, company string, scraped_at timestamp_ntz"
    spark.createDataFrame([(1, "https://x.example/1?utm_source=a", "old", "A", t(1)), (2, "", "no url", "A", t(1))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    df = spark.read.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), df.schema, store, str(tmp_path / "progress"))
    spark.createDataFrame([(3, "https://x.example/1", "new", "A", t(5)), (4, "https://x.example/4", "four", "B", t(5))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.url: (r.title, r.first_seen_at.hour, r.last_seen_at.hour) for r in ingest(spark, str(tmp_path / "in"), df.schema, store, str(tmp_path / "progress")).collect()}
    assert got == {"https://x.example/1": ("new", 1, 5), "https://x.example/4": ("four", 5, 5)}


def test_windowed_counts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 1, 5), "a", 1.0), (datetime(2024, 1, 1, 1, 50), "a", 2.0), (datetime(2024, 1, 1, 2, 0), "a", 4.0)], "ts timestamp_ntz, kind string, value double")
    assert sorted((r.start.hour, r.n, r.total) for r in windowed_counts(df, "ts", "kind").collect()) == [(1, 2, 3.0), (2, 1, 4.0)]


def test_late_rows_of_a_stream(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string, value double"
    at = lambda day, hour: datetime(2024, 1, day, hour)
    for name, own in (("a", [(at(1, 1), "a", 1.0)]), ("b", [(at(5, 1), "a", 2.0)]), ("c", [(at(5, 1), "a", 8.0)]), ("d", [(at(1, 1), "a", 4.0)])):  # a watermark drops rows from the second batch after it on
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / name))
        (file,) = (tmp_path / name).glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.utime(file, (1_700_000_000 + 100 * ord(name),) * 2)  # files are read in this order
        file.rename(tmp_path / "in" / f"{name}.parquet")
    landed = spark.read.parquet(str(tmp_path / "in")).schema
    got = lambda late, folder: sorted((r.start.day, r.n, r.total) for r in run_windows(spark, str(tmp_path / "in"), landed, "ts", "kind", "1 hour", late, str(tmp_path / folder)).collect())
    assert got("30 days", "wide") == [(1, 2, 5.0), (5, 2, 10.0)]
    assert got("2 hours", "narrow") == [(1, 1, 1.0), (5, 2, 10.0)]  # four days late when it comes


def test_more_payloads(spark):
    one = lambda *r: spark.createDataFrame([r], "slug string, raw string")
    (r,) = rows(P.epoch_board_json(one("acme-labs", '[{"text": "Dev", "hostedUrl": "u", "categories": {"location": "Town"}, "createdAt": 1714521600000}, {"text": "Again", "hostedUrl": "u"}, {"text": "", "hostedUrl": "v"}]'), "s"))
    assert (r["title"], r["company"], r["posted_date"]) == ("Dev", "Acme Labs", "2024-05-01T00:00:00")
    assert P.epoch_board_json(one("a", "broken"), "s").count() == 0
    kept = P.sectioned_board_json(one("acme", '{"content": [{"name": "Dev", "ref": "u", "location": {"city": "Town", "country": "xy"}, "jobAd": {"sections": {"jobDescription": {"text": "a"}, "qualifications": {"text": "b"}}}}, {"name": "Cook", "ref": "v", "location": {"city": "City"}}]}'), "s", "Town", ["planner"])
    (r,) = rows(kept)
    assert (r["location"], r["description"], r["company"]) == ("Town, xy", "a\nb", "Acme")
    (r,) = rows(P.agency_json(one("a", '{"stellenangebote": [{"titel": " Dev ", "arbeitgeber": "A", "arbeitsort": {"ort": "Town", "plz": "12345"}, "refnr": "7", "beruf": "Koch", "arbeitszeitmodelle": ["VZ", "TZ"]}, {"titel": "No address"}]}'), "s"))
    assert (r["title"], r["location"], r["url"], r["description"]) == ("Dev", "12345 Town", "https://agency.example/jobs?id=7", "Beruf: Koch | Arbeitszeit: VZ, TZ")
    (r,) = rows(P.remote_list_json(one("a", '[{"legal": "x"}, {"position": "Dev", "url": "/1", "epoch": 1714521600, "tags": ["a"]}]'), "s", "https://r.example"))
    assert (r["url"], r["posted_date"], r["location"], r["tags"]) == ("https://r.example/1", "2024-05-01T00:00:00", "Remote", ["a"])
    found = spark.createDataFrame([("Dev - team - Acme", "u", "s"), ("Dev", "v", None)], "title string, url string, snippet string")
    assert [(r["title"], r["company"]) for r in rows(P.search_results(found, "s"))] == [("Dev - team", "Acme"), ("Dev", "")]
    assert [r.loc for r in P.sitemap_index(spark.createDataFrame([("<sitemapindex><sitemap><loc> https://x.example/a?b=1&amp;c=2 </loc></sitemap></sitemapindex>",)], "raw string")).collect()] == ["https://x.example/a?b=1&c=2"]
    places = spark.createDataFrame([("Munich area", True), (None, True), ("Remote", True), ("Berlin", False)], "p string, e boolean")
    from pyspark.sql import functions as F

    assert places.where(P.in_city(F.col("p"), "München") != F.col("e")).count() == 0


def test_few_rows_call_for_the_fallback(spark):
    df = spark.createDataFrame([(f"u{i}", f"t{i}") for i in range(4)], "url string, title string")
    more = spark.createDataFrame([("u3", "other"), ("u9", "t9")], "url string, title string")
    assert {(r.url, r.title) for r in P.with_few(df, more, 5).collect()} == {("u0", "t0"), ("u1", "t1"), ("u2", "t2"), ("u3", "t3"), ("u9", "t9")}
    assert P.with_few(df, more, 4).count() == 4 and P.with_few(df.where("false"), more, 1).count() == 2
