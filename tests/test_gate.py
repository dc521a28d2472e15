"""The quality gate, the predicates over URLs and titles, and the decisions about probed URLs, on the cases that they exist for."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobsieve.functions import dates as D
from jobsieve.functions import urls as U
from jobsieve.operators import checks as C
from jobsieve.operators import quality as Q

AS_OF = "2025-06-01"
TRUSTED = ("stepstone", "google", "ddg", "glassdoor")
RULES = Q.Rules(trusted=TRUSTED, mode="strict")
DETAIL = "https://www.glassdoor.de/job-listing/werkstudent-data-engineering-mwd-example-JV_IC2622109_KO0,32_KE33,40.htm?jl=1009563665458"
LONG = "Build pipelines, work with Python, data engineering workflows and backend services in a production environment."
CASES = [
    # title, company, location, url, description, source, posted_date, expected reason ("" for accepted)
    ("Senior Data Engineer Profile", "Example", "Berlin", "https://linkedin.com/in/example-person", "No real posting.", "Google→LinkedIn", AS_OF, "noise_url"),
    ("Data Engineer Profile", "Example", "Berlin", "https://www.xing.com/profile/example_person", "No real posting.", "DDG->XING", AS_OF, "noise_url"),
    ("Feng Da - Zhihu", "Web", "Berlin", "https://www.zhihu.com/people/feng-da-67-58", "No real posting.", "DDG->Web", AS_OF, "garbage_domain"),
    ("University of Somewhere Jobs & Careers - 32 Open Positions", "Board", "Town", "https://www.glassdoor.com/Jobs/University-of-Somewhere-Jobs-E420414.htm", "A listing page, not a posting.", "DDG->Board", AS_OF, "listing_page"),
    ("Werkstudent Data Engineering", "Board", "Berlin", DETAIL, LONG, "DDG->Board", AS_OF, ""),
    ("Working Student Data Engineering", "Car AG", "Leipzig", "https://jobs.example.com/careers/data-engineering-working-student?id=42&utm_source=feed", LONG, "StepStone", AS_OF, ""),
    ("Data Engineer", "Example", "", "https://x.example/jobs/1", LONG, "StepStone", AS_OF, "missing_location"),
    ("Data Engineer", "", "Berlin", "https://x.example/jobs/1", LONG, "elsewhere", AS_OF, "missing_company"),
    ("Data", "Example", "Berlin", "https://x.example/jobs/1", LONG, "StepStone", AS_OF, "title_length"),
    ("Salary of a data engineer", "Example", "Berlin", "https://x.example/a/1", LONG, "StepStone", AS_OF, "noise_title"),
    ("Gardener", "Web", "Berlin", "https://x.example/a/1", "", "elsewhere", "no date", "score_below_55"),
    (None, None, None, None, None, None, None, "invalid_url"),
]
SCHEMA = "job_id int, title string, company string, location string, url string, description string, source string, posted_date string"


@pytest.fixture(scope="module")
def assessed(spark):
    df = spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(CASES)], SCHEMA)
    return {r.job_id: r for r in Q.assess(df, RULES, AS_OF).collect()}


def test_reasons(assessed):
    for i, case in enumerate(CASES):
        assert assessed[i].reject_reason == case[7], case
        assert assessed[i].accepted == (case[7] == "")


def test_scores_and_flags(assessed, spark):
    good = assessed[5]
    assert good.score == 100 and good.bucket == "high" and good.flags == "" and good.url == "https://jobs.example.com/careers/data-engineering-working-student?id=42"
    assert assessed[10].flags == "title_shape,weak_role_signal,generic_company,untrusted_source,weak_url_path,missing_description,unparsed_date" and assessed[10].score == 46
    df = spark.createDataFrame([(1, "Data Engineer in a team", "Car AG", "Town", "https://x.example/jobs/1", "short", "StepStone", d) for d in ("2025-06-20", "2025-05-20", "2025-04-01", "2024-01-01")], SCHEMA)
    got = [(r.score, r.flags) for r in Q.assess(df, RULES, AS_OF).collect()]
    assert got == [(100, "short_description,future_date"), (100, "short_description"), (100, "short_description"), (100, "short_description,stale_posting")]
    batch = Q.assess(df.withColumn("source", F.lit("x")).withColumn("title", F.lit("Gardener")), RULES, AS_OF, "batch").first()
    assert batch.accepted and RULES.least("batch") == 20 and Q.Rules(mode="lenient").least("final") == 25 and Q.Rules().least("final") == 40 and Q.Rules(final_least=7).least("final") == 7
    assert Q.assess(df.where("false"), RULES, AS_OF).count() == 0


def test_metrics_of_batches_add_up(spark):
    df = spark.createDataFrame([(i, *c[:7]) for i, c in enumerate(CASES)], SCHEMA)
    parts = [Q.gate_metrics(Q.assess(df.where(f"job_id % 2 = {k}"), RULES, AS_OF)) for k in (0, 1)]
    whole = {r.reject_reason: r.seen for r in Q.gate_metrics(Q.assess(df, RULES, AS_OF)).collect()}
    assert {r.reject_reason: r.seen for r in Q.merge_metrics(*parts).collect()} == whole


def test_listing_pages(spark):
    pages = [
        ("1,000+ jobs in Town", "https://x.example/a", True), ("25 offene Stellen", "https://x.example/a", True), ("Jetzt 500 offene finden", "https://x.example/a", True), ("Finde 100 aktuelle Angebote", "https://x.example/a", True), ("Backend (30 new)", "https://x.example/a", True),
        ("Data Jobs & Stellenangebote", "https://x.example/a", True), ("Python Jobs in Berlin | Board", "https://x.example/a", True), ("Engineer - Indeed", "https://x.example/a", True), ("Developer, Mär 2026", "https://x.example/a", True), ("389 Jobs & more", "https://x.example/a", True),
        ("Engineer", "https://x.example/jobs?q=engineer", True), ("Engineer", "https://x.example/jobs?q=", False), ("Engineer", "https://x.example/jobsuche/", True), ("Engineer", "https://www.linkedin.com/jobs/engineer", True), ("Engineer", "https://www.linkedin.com/jobs/view/123", False),
        ("Engineer", "https://www.glassdoor.com/Jobs/x.htm", True), ("3 jobs in one", DETAIL, False), ("Engineer", "https://indeed.com/jobs?l=town", True), ("Engineer", "https://indeed.com/viewjob?jk=1", False), ("Engineer for pumps", "https://x.example/job?id=3", False), (None, "https://x.example/job/3", False),
    ]
    df = spark.createDataFrame(pages, "t string, u string, e boolean").withColumn("g", U.is_listing_page(F.col("t"), F.col("u")))
    assert [(r.t, r.u) for r in df.where("g is null or g <> e").collect()] == []


def test_search_noise_and_career_pages(spark):
    rows = [
        ("https://www.zhihu.com/question/27533426", "Werkstudent和Praktikant的区别？", "A page of questions.", True), (DETAIL, "Working Student Data Engineering", "Apply for this job.", False), ("https://x.example/in/someone", "Engineer", "", True),
        ("https://www.glassdoor.de/Reviews/x", "Engineer job", "", True), ("https://x.example/a", "We are hiring", "a data engineer", False), ("https://x.example/a", "A text", "about nothing", True), ("https://www.stepstone.de/a", "A text", "about nothing", False),
    ]
    df = spark.createDataFrame(rows, "u string, t string, s string, e boolean").withColumn("g", U.is_search_noise(F.col("t"), F.col("s"), F.col("u"), ("/salaries/",), ("resume",), ("StepStone",)))
    assert [r.u for r in df.where("g <> e").collect()] == []
    career = spark.createDataFrame([("https://x.example/karriere/1", "Engineer", "", True), ("https://x.example/lebenslauf", "jobs", "", False), ("https://uni.example/x", "Text", "", True), ("https://y.example/x", "Text", "", False)], "u string, t string, s string, e boolean")
    assert career.where(U.is_career_page(F.col("t"), F.col("s"), F.col("u"), ("uni.",)) != F.col("e")).count() == 0


def test_sources_vendors_and_robots(spark):
    df = spark.createDataFrame([("https://de.indeed.com/x",), ("https://acme.example/x",), ("https://www.acme-labs.example/x",), ("",)], "u string")
    assert [tuple(r) for r in df.select(U.detected_source(F.col("u")), U.company_of_domain(F.col("u"))).collect()] == [("Indeed", "De"), ("Acme", "Acme"), ("Web", "Acme Labs"), ("Web", "")]
    boards = spark.createDataFrame([("https://jobs.lever.co/acme-labs/1",), ("https://api.lever.co/1",), ("https://x.example",)], "u string")
    assert [tuple(r.v) if r.v else None for r in boards.select(U.vendor(F.col("u")).alias("v")).collect()] == [("lever", "acme-labs"), ("lever", None), None]
    robots = spark.createDataFrame([("User-agent: *\n Disallow: /Jobs/x\nAllow: /about\nSitemap: /jobs.xml",), (None,)], "t string")
    assert [r[0] for r in robots.select(U.robots_paths(F.col("t"))).collect()] == [["/jobs/x"], []]


def test_probe_decisions(spark):
    rows = [(DETAIL, 403, 403, None, "blocked", True), ("https://x.example/jobs/1", 403, 403, None, "blocked", False), ("https://x.example/jobs/1", 200, None, "https://x.example/jobs/1/", "alive", True), ("https://x.example/jobs/1", 301, None, "https://x.example/jobs/2", "redirected", True),
            ("https://x.example/jobs/1", 405, 200, None, "alive", True), ("https://x.example/jobs/1", 405, 404, None, "dead", False), ("https://x.example/jobs/1", 404, None, None, "dead", False), ("https://x.example/jobs/1", None, None, None, "uncertain", False), ("https://x.example/jobs/1", 429, None, None, "blocked", False)]
    df = spark.createDataFrame(rows, "u string, h int, g int, f string, status string, keep boolean").withColumn("p", Q.probe_decision(F.col("u"), F.col("h"), F.col("g"), F.col("f")))
    assert df.where("p.status <> status or p.keep <> keep").count() == 0
    assert spark.createDataFrame(rows[7:8], df.drop("p").schema).select(Q.probe_decision(F.col("u"), F.col("h"), F.col("g"), F.col("f"), False)["keep"]).first()[0]


def test_posting_dates(spark):
    now = datetime(2025, 6, 1)
    cases = {
        "2026 03 14": datetime(2026, 3, 14), "1748736000": datetime(2025, 6, 1), "1748736000123": datetime(2025, 6, 1, 0, 0, 0, 123000), "Just now": now, "gestern": datetime(2025, 5, 31), "vor 2 Stunden": datetime(2025, 5, 31, 23), "5 min ago": datetime(2025, 5, 31, 23, 45),
        "2025-05-20T10:11:12.5+02:00": datetime(2025, 5, 20, 10, 11, 12, 500000), "2025-05-20 10:11": datetime(2025, 5, 20, 10, 11), "Tue, 20 May 2025 10:11:12 +0200": datetime(2025, 5, 20, 10, 11, 12), "20.05.2025": datetime(2025, 5, 20), "2025/05/20": datetime(2025, 5, 20),
        "2025-13-40": None, "soon": None, "": None, None: None, "9" * 40: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    at = F.lit("2025-06-01").cast("timestamp_ntz")
    got = {r.x: r.p for r in df.select("x", D.posted_date(F.col("x"), at).alias("p")).collect()}
    assert got == cases
    shown = {r.x: r.p for r in df.select("x", D.shown_date(F.col("x"), at).alias("p")).collect()}
    assert shown["20.05.2025"] == "2025 05 20 00:00:00" and shown["soon"] == "soon" and shown[None] == "N/A"
    recent = spark.createDataFrame([("2025-05-31T12:00:00", True, True), ("2025-05-29T12:00:00", False, True), ("2 hours ago", True, True), ("last year", False, False), (None, False, False)], "x string, d boolean, t boolean")
    assert recent.where((D.is_recent(F.col("x"), at) != F.col("d")) | (D.is_recent(F.col("x"), at, 72) != F.col("t"))).count() == 0
    crawled = spark.createDataFrame([("vor 3 Tagen", datetime(2025, 5, 29)), ("5 hours", datetime(2025, 5, 31, 19)), ("heute", now), ("x", None)], "x string, e timestamp_ntz")
    assert crawled.where(~D.crawled_date(F.col("x"), at).eqNullSafe(F.col("e"))).count() == 0


def test_document_checks(spark):
    df = spark.createDataFrame([(1, "Profile\na.b@c.example\n030 1234567\nlinkedin.com/in/ann\nExperience python sql data " + "x " * 300, ["profile", "experience"]), (2, None, ["header"]), (3, "★☆▪▫ experience profile", ["profile", "stuff"])], "id int, text string, s array<string>")
    long = C.long_form(df, "id", C.text_checks(F.col("text"), F.col("s")))
    got = {(r.id, r.check): r.score for r in long.collect()}
    assert got[1, "text"] == 10 and got[1, "contact"] == 10 and got[1, "order"] == 10 and got[1, "headings"] == 10 and got[1, "characters"] == 10
    assert got[2, "text"] == 0 and got[2, "headings"] == 3 and got[3, "characters"] == 4 and got[3, "order"] == 5 and got[3, "headings"] == 5
    report = {r.id: r for r in C.report(long, "id").collect()}
    assert report[1].grade in "AB" and report[2].critical == "contact|headings|keywords|text" and report[2].grade == "F"
    files = spark.createDataFrame([(1, 0, 0, ["Arial-Bold"], 1000, 1, ["https://a.example"], True), (2, 4, 3, ["Foo", "Bar", "Baz"], 6_000_000, 9, ["ftp:x"], None), (3, 1, 1, None, 0, 0, None, True)], "id int, i int, t int, f array<string>, z long, p int, l array<string>, r boolean")
    got = {(r.id, r.check): r.score for r in C.long_form(files, "id", C.file_checks(*[F.col(c) for c in "itfzplr"])).collect()}
    assert [got[1, k] for k in ("images", "tables", "fonts", "size", "pages", "links", "readable")] == [10] * 7
    assert [got[2, k] for k in ("images", "tables", "fonts", "size", "pages", "links", "readable")] == [2, 3, 4, 2, 3, 7, 0] and got[3, "fonts"] == 5 and got[3, "links"] == 7


def test_levels_and_pages(spark):
    from jobsieve.functions import levels as L
    from jobsieve.operators.pages import html_main_text, main_text

    cases = [
        ("5+ years of experience", "mid", 5, 0, "unknown", ""), ("2-8 years experience", "senior", 2, 8, "unknown", ""), ("Senior role", "senior", 0, 0, "unknown", ""), ("senior junior", "entry", 0, 0, "unknown", ""), ("Mid-level, M.Sc. wanted", "mid", 0, 0, "master_completed", ""),
        ("Deutsch C1, Masterstudent", "unknown", 0, 0, "master_current", "C1"), ("fließend Deutsch", "unknown", 0, 0, "unknown", "C1"), ("sehr gute Deutschkenntnisse", "unknown", 0, 0, "unknown", "B2"), ("gute Deutschkenntnisse, PhD", "unknown", 0, 0, "phd", "B1"), ("German is a plus", "unknown", 0, 0, "unknown", "preferred"),
        ("und " * 11, "unknown", 0, 0, "unknown", "B1"), (None, "unknown", 0, 0, "unknown", ""), ("x" * 5000 + " Deutsch B2", "unknown", 0, 0, "unknown", "B2"),
    ]
    df = spark.createDataFrame(cases, "t string, l string, lo int, hi int, e string, g string").select("*", L.experience_level(F.col("t")).alias("x"), L.education_level(F.col("t")).alias("y"), L.german_requirement(F.col("t")).alias("z"))
    assert [(r.t[:30] if r.t else None) for r in df.where("x.level <> l or x.min_years <> lo or x.max_years <> hi or y <> e or z <> g").collect()] == []
    assert spark.createDataFrame([("„a” – b $ | $ c $\\cdot$",)], "t string").select(L.typeset(F.col("t"))).first()[0] == '„a" - b \\textbar{} c \\textperiodcentered{}'
    body = "word " * 60
    page = f"<html><nav>Menu</nav><div class='x job-description'>short</div><article><p>{body}</p><script>no</script></article><footer>Imprint</footer></html>"
    assert main_text(page) == body.strip()
    assert main_text(f"<body><div id='a'>x</div>{body}<br>&amp; more") == "x " + body.strip() + " & more"
    assert main_text("<p>too short</p>") is None and main_text("") is None and main_text(None) is None and main_text("<<<>>" * 10) is None
    assert [r[0] for r in spark.createDataFrame([(page,), (None,), ("x",)], "h string").select(html_main_text(F.col("h"))).collect()] == [body.strip(), None, None]
