from pyspark.sql import functions as F

from jobsieve.functions import text as T
from jobsieve.functions import urls as U


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalize_url(spark):
    cases = {
        "HTTPS://Jobs.Site.example/a/b/?b=2&utm_source=x&ref=y&a=1#top": "https://jobs.site.example/a/b?a=1&b=2",
        "site.example/x": "https://site.example/x",
        "https://site.example": "https://site.example/",
        "https://site.example/?q=a%20b": "https://site.example/?q=a+b",
        "https://site.example/?a=%zz": "https://site.example/?a=%25zz",
        "": "",
        None: "",
    }
    for url, expected in cases.items():
        assert one(spark, U.normalize_url, url) == expected
        if url:
            assert one(spark, U.normalize_url, expected) == expected


def test_url_predicates(spark):
    assert one(spark, U.is_people_page, "https://site.example/in/someone")
    assert not one(spark, U.is_people_page, "https://site.example/jobs/1")
    listing = lambda t, u: spark.createDataFrame([(t, u)], "t string, u string").select(U.is_listing_page(F.col("t"), F.col("u"))).first()[0]
    assert listing("1,000+ jobs in Town", "https://x.example/a") and listing("Engineer", "https://x.example/jobs?q=engineer") and listing("Engineer", "https://x.example/jobsuche/")
    assert not listing("Engineer for pumps", "https://x.example/job?id=3") and not listing(None, "https://x.example/job/3")


def test_titles_and_sites(spark):
    assert one(spark, U.title_from_url, "https://x.example/jobs/senior-data-engineer_berlin/17") == "Senior Data Engineer Berlin"
    assert one(spark, U.title_from_url, "https://x.example/a/b") is None
    assert one(spark, U.site_source, "https://jobhafen.example/job?id=1") == "Jobhafen" and one(spark, U.site_source, "nothing") == "Web"


def test_clean_text(spark):
    assert one(spark, T.clean_text, " a &amp;lt; b <p>c</p>\n d&nbsp;") == "a &lt; b c d"
    assert one(spark, T.clean_text, None) == ""
    assert one(spark, T.clean_company, "(via  Acme Pumps )") == "Acme Pumps"
