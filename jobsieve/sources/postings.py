"""Raw payloads of job sites as postings of one schema.

Every reader takes landed rows of one text column and gives the same columns, so that sources are put together with
unionByName; what a source lacks is null. The per-source cap of a crawl is `store.cap_per_group`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.text import clean_text, contains_any
from jobsieve.functions.urls import company_of_domain, title_from_url

COLUMNS = ("title", "company", "location", "url", "description", "posted_date", "job_type", "salary", "tags", "source")


def _shape(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    given = {"source": F.lit(source)} | columns
    return df.select(*[given.get(c, F.lit(None).cast("array<string>" if c == "tags" else "string")).alias(c) for c in COLUMNS])


def salary_text(low: Column, high: Column) -> Column:
    amount = lambda c: F.concat(F.lit("€"), F.format_number(c, 0))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(amount(low), F.lit(" - "), amount(high))).when(low.isNotNull(), F.concat(F.lit("from "), amount(low)))


def first_type(text: Column, types: list[str]) -> Column:
    """The first listed type that the text names; the order of the list decides."""
    return F.get(F.filter(F.array(*[F.lit(t) for t in types]), lambda t: F.contains(F.lower(text), F.lower(t))), F.lit(0))


def board_json(raw: DataFrame, source: str, col: str = "raw", types: list[str] | None = None) -> DataFrame:
    """{"data": [{title, company_name, location, url, description, created_at, tags, remote, salary_min, salary_max}]}; rows without title or URL are dropped."""
    item = "struct<title:string,company_name:string,location:string,url:string,description:string,created_at:string,tags:array<string>,salary_min:double,salary_max:double>"
    rows = raw.select(F.explode(F.from_json(col, f"struct<data:array<{item}>>")["data"]).alias("r")).select("r.*").where("title <> '' and url <> ''")
    rows = rows.withColumn("_text", F.concat_ws(" ", "title", "description"))  # a lambda in the same projection would see the cleaned title
    return _shape(rows, source, title=clean_text(F.col("title")), company=F.col("company_name"), location=F.col("location"), url=F.col("url"), description=clean_text(F.col("description")), posted_date=F.col("created_at"), tags=F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 10), salary=salary_text(F.col("salary_min"), F.col("salary_max")), job_type=first_type(F.col("_text"), types or []) if types else F.lit(None).cast("string"))


def feed_xml(raw: DataFrame, source: str, col: str = "raw") -> DataFrame:
    """One RSS item or Atom entry per row; the company follows the first of " at ", " bei ", " - ", " | " in the title."""
    item = F.from_xml(F.col(col), "struct<title:string,link:string,description:string,summary:string,pubDate:string,updated:string>")
    rows = raw.select(item.alias("r")).select("r.*")
    parts = F.split("title", r"\s(?:at|bei|-|\|)\s", 2)
    return _shape(rows, source, title=F.trim(parts[0]), company=F.trim(F.get(parts, F.lit(1))), url=F.col("link"), description=clean_text(F.coalesce("description", "summary")), posted_date=F.coalesce("pubDate", "updated"))


def applicant_system_json(raw: DataFrame, source: str, col: str = "raw", slug_col: str = "slug") -> DataFrame:
    """{"jobs": [{title, absolute_url, location: {name}, content, updated_at}]} of one company's board; the company is its slug in title case."""
    item = "struct<title:string,absolute_url:string,location:struct<name:string>,content:string,updated_at:string>"
    rows = raw.select(slug_col, F.explode(F.from_json(col, f"struct<jobs:array<{item}>>")["jobs"]).alias("r")).select(slug_col, "r.*")
    return _shape(rows, source, title=clean_text(F.col("title")), company=F.initcap(F.regexp_replace(slug_col, "[-_]", " ")), location=F.col("location.name"), url=F.col("absolute_url"), description=clean_text(F.col("content")), posted_date=F.col("updated_at"))


def epoch_board_json(raw: DataFrame, source: str, col: str = "raw", slug_col: str = "slug", types: list[str] | None = None) -> DataFrame:
    """[{text, hostedUrl, categories: {location}, descriptionPlain, createdAt in milliseconds}] of one company's board; dates come out in ISO form, the first row of a URL counts."""
    item = "struct<text:string,hostedUrl:string,categories:struct<location:string>,descriptionPlain:string,createdAt:bigint>"
    rows = raw.select(slug_col, F.posexplode(F.from_json(col, f"array<{item}>")).alias("at", "r")).where("r.text <> '' and r.hostedUrl <> ''")
    rows = rows.groupBy("r.hostedUrl").agg(F.min_by(F.struct(slug_col, "r"), F.struct(slug_col, "at")).alias("x")).select(F.col(f"x.{slug_col}").alias("slug"), "x.r.*")
    posted = F.when(F.col("createdAt") > 0, F.date_format(F.timestamp_millis("createdAt"), "yyyy-MM-dd'T'HH:mm:ss"))
    return _shape(rows, source, title=F.col("text"), company=F.initcap(F.replace(F.col("slug"), F.lit("-"), F.lit(" "))), location=F.col("categories.location"), url=F.col("hostedUrl"), description=F.col("descriptionPlain"), posted_date=posted, job_type=first_type(F.concat_ws(" ", "text", "descriptionPlain"), types or []) if types else F.lit(None).cast("string"))


def sectioned_board_json(raw: DataFrame, source: str, city: str, keywords: list[str], col: str = "raw", company_col: str = "slug") -> DataFrame:
    """{content: [{name, ref, location: {city, country}, releasedDate, jobAd: {sections: {...: {text}}}}]}: rows of a city (or remote) or with a keyword; the four sections are put together, one a line."""
    names = ("companyDescription", "jobDescription", "qualifications", "additionalInformation")
    sections = ",".join(f"{n}:struct<text:string>" for n in names)
    item = f"struct<name:string,ref:string,location:struct<city:string,country:string>,releasedDate:string,jobAd:struct<sections:struct<{sections}>>>"
    rows = raw.select(company_col, F.explode(F.from_json(col, f"struct<content:array<{item}>>")["content"]).alias("r")).select(company_col, "r.*").where("ref <> ''")
    place = F.trim(F.concat_ws(", ", F.nullif("location.city", F.lit("")), F.nullif("location.country", F.lit(""))))
    hay = F.lower(F.concat_ws(" ", "name", place))
    kept = rows.where(contains_any(hay, [city.lower(), "remote", "germany"]) | (contains_any(hay, [k.lower() for k in keywords]) if keywords else F.lit(True)))
    text = F.concat_ws("\n", *[F.col(f"jobAd.sections.{n}.text") for n in names])
    return _shape(kept, source, title=F.col("name"), company=F.initcap(F.col(company_col)), location=place, url=F.col("ref"), description=text, posted_date=F.col("releasedDate"))


def agency_json(raw: DataFrame, source: str, col: str = "raw", base: str = "https://agency.example/jobs?id=") -> DataFrame:
    """{stellenangebote: [{titel, arbeitgeber, arbeitsort: {ort, plz}, refnr, externeUrl, eintrittsdatum, aktuelleVeroeffentlichungsdatum, beruf, arbeitszeitmodelle, befristung, branche}]}: an external address goes before the agency's own."""
    item = "struct<titel:string,arbeitgeber:string,arbeitsort:struct<ort:string,plz:string>,refnr:string,externeUrl:string,eintrittsdatum:string,aktuelleVeroeffentlichungsdatum:string,beruf:string,arbeitszeitmodelle:array<string>,befristung:string,branche:string>"
    rows = raw.select(F.explode(F.from_json(col, f"struct<stellenangebote:array<{item}>>")["stellenangebote"]).alias("r")).select("r.*")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    url = F.coalesce(given("externeUrl"), F.concat(F.lit(base), given("refnr")))
    parts = [F.concat(F.lit("Beruf: "), given("beruf")), F.when(F.size("arbeitszeitmodelle") > 0, F.concat(F.lit("Arbeitszeit: "), F.array_join("arbeitszeitmodelle", ", "))), F.concat(F.lit("Befristung: "), given("befristung")), F.concat(F.lit("Branche: "), given("branche"))]
    shaped = _shape(rows, source, title=F.trim("titel"), company=F.trim("arbeitgeber"), location=F.concat_ws(" ", given("arbeitsort.plz"), "arbeitsort.ort"), url=url, description=F.concat_ws(" | ", *parts), posted_date=F.coalesce(given("eintrittsdatum"), given("aktuelleVeroeffentlichungsdatum")))
    return shaped.where("title <> '' and url is not null")


def search_results(df: DataFrame, source: str) -> DataFrame:
    """Search results (title, url, snippet): the last piece of a title behind " - " is the company, the rest the title."""
    pieces = F.split("title", " - ")
    two = F.size(pieces) >= 2
    title = F.when(two, F.trim(F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), " - "))).otherwise(F.col("title"))
    return _shape(df, source, title=title, company=F.when(two, F.trim(F.element_at(pieces, -1))).otherwise(F.lit("")), url=F.col("url"), description=F.col("snippet"))


def remote_list_json(raw: DataFrame, source: str, site: str, col: str = "raw") -> DataFrame:
    """[{notice}, {position, company, url, description, tags, date or epoch, salary, location}, ...]: the first element is no posting; relative addresses are completed, dates are ISO or epoch seconds."""
    item = "struct<position:string,company:string,url:string,description:string,tags:array<string>,date:string,epoch:bigint,salary:string,location:string>"
    rows = raw.select(F.posexplode(F.from_json(col, f"array<{item}>")).alias("at", "r")).where("at > 0").select("r.*")
    url = F.when(F.startswith("url", F.lit("/")), F.concat(F.lit(site), "url")).otherwise(F.col("url"))
    posted = F.coalesce(F.nullif("date", F.lit("")), F.when(F.col("epoch") > 0, F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss")))
    shaped = _shape(rows, source, title=F.trim("position"), company=F.trim("company"), location=F.coalesce(F.nullif("location", F.lit("")), F.lit("Remote")), url=url, description=F.col("description"), posted_date=posted, job_type=F.lit("Remote"), salary=F.nullif("salary", F.lit("")), tags=F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 10))
    return shaped.where("title <> '' and url <> ''")


# Other names of towns, and words in a place that stand for all towns of the country.
CITY_ALIASES = {"münchen": ("munich", "muenchen"), "munich": ("münchen", "muenchen"), "köln": ("cologne", "koeln"), "nürnberg": ("nuremberg", "nuernberg")}
EVERYWHERE = ("germany", "deutschland", "remote", "dach")


def in_city(location: Column, city: str, everywhere: tuple[str, ...] = EVERYWHERE) -> Column:
    """Whether a place means a city: by its name or another one of it, by a word for the whole country, or by saying nothing."""
    low = F.lower(F.coalesce(location, F.lit("")))
    return (low == "") | contains_any(low, [city.lower(), *CITY_ALIASES.get(city.lower(), ()), *everywhere])


def _decoded_xml(text: Column) -> Column:
    from jobsieve.functions.text import unescape

    return unescape(text)


def sitemap_index(raw: DataFrame, col: str = "raw") -> DataFrame:
    """(loc): the child sitemaps that an index lists."""
    pairs = F.regexp_extract_all(F.col(col), F.lit(r"(?s)<sitemap>(.*?)</sitemap>"), F.lit(1))
    return raw.select(F.explode(pairs).alias("u")).select(_decoded_xml(F.regexp_extract("u", r"<loc>\s*(.*?)\s*</loc>", 1)).alias("loc")).where("loc <> ''")


def sitemap_xml(raw: DataFrame, source: str, col: str = "raw", include: str = r"(?i)job|career|karriere|stelle", exclude: str = r"(?i)/search|/login|/blog") -> DataFrame:
    """The (loc, lastmod) pairs of a sitemap that look like postings, entities decoded; titles come from the path, companies from the host."""
    pairs = F.regexp_extract_all(F.col(col), F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    rows = raw.select(F.explode(pairs).alias("u")).select(_decoded_xml(F.regexp_extract("u", r"<loc>\s*(.*?)\s*</loc>", 1)).alias("loc"), F.regexp_extract("u", r"<lastmod>\s*(.*?)\s*</lastmod>", 1).alias("lastmod"))
    rows = rows.where((F.col("loc") != "") & F.col("loc").rlike(include) & ~F.col("loc").rlike(exclude))
    return _shape(rows, source, title=title_from_url(F.col("loc"), 3, 150), company=company_of_domain(F.col("loc")), url=F.col("loc"), posted_date=F.when(F.col("lastmod") != "", F.col("lastmod")))


def page_jsonld(raw: DataFrame, source: str, col: str = "raw") -> DataFrame:
    """The JobPosting objects in a page's JSON-LD scripts; title and URL are required."""
    item = "struct<`@type`:string,title:string,url:string,description:string,datePosted:string,employmentType:string,hiringOrganization:struct<name:string>,jobLocation:struct<address:struct<addressLocality:string>>>"
    scripts = F.regexp_extract_all(F.col(col), F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    rows = raw.select(F.explode(scripts).alias("s")).select(F.explode(F.coalesce(F.when(F.col("s").rlike(r"^\s*\["), F.from_json("s", f"array<{item}>")), F.array(F.from_json("s", item)))).alias("r")).select("r.*")
    rows = rows.where((F.col("`@type`") == "JobPosting") & (F.col("title") != "") & (F.col("url") != ""))
    return _shape(rows, source, title=clean_text(F.col("title")), company=F.col("hiringOrganization.name"), location=F.col("jobLocation.address.addressLocality"), url=F.col("url"), description=clean_text(F.col("description")), posted_date=F.col("datePosted"), job_type=F.col("employmentType"))


def page_links(raw: DataFrame, source: str, col: str = "raw", include: str = r"(?i)job|career|karriere|stelle") -> DataFrame:
    """The anchors of a listing page whose target looks like a posting, with link texts of 4 to 249 characters."""
    anchors = F.regexp_extract_all(F.col(col), F.lit(r'(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>'), F.lit(0))
    rows = raw.select(F.explode(anchors).alias("a")).select(F.regexp_extract("a", r'href="([^"]+)"', 1).alias("href"), clean_text(F.regexp_extract("a", r"(?s)>(.*)</a>", 1)).alias("text"))
    return _shape(rows.where(F.col("href").rlike(include) & F.length("text").between(4, 249)), source, title=F.col("text"), url=F.col("href"))


def filter_postings(df: DataFrame, city: str | None = None, keywords: list[str] | None = None, either: bool = False) -> DataFrame:
    """Rows of a city (in location or title) and with any of the keywords in title, description or tags; with either, one of the two is enough."""
    tests = []
    if city:
        tests.append(contains_any(F.lower(F.concat_ws(" ", "location", "title")), [city.lower()]))
    if keywords:
        tests.append(contains_any(F.lower(F.concat_ws(" ", "title", "description", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))), [k.lower() for k in keywords]))
    if not tests:
        return df
    return df.where(tests[0] | tests[-1] if either else tests[0] & tests[-1])


def with_few(primary: DataFrame, fallback: DataFrame, least: int, key: str = "url") -> DataFrame:
    """The primary rows, and if there are fewer than `least` also the fallback rows with other keys."""
    from jobsieve.operators.store import first_per_key

    few = primary.agg((F.count("*") < least).alias("_few"))
    both = primary.withColumn("_p", F.lit(0)).unionByName(fallback.join(F.broadcast(few), F.col("_few"), "left_semi").withColumn("_p", F.lit(1)))
    return first_per_key(both, [key], [F.col("_p"), F.col("title")]).drop("_p")


def first_wins(*sources: DataFrame, key: str = "url") -> DataFrame:
    """The union of sources in which the first one that has a key wins."""
    from functools import reduce

    from jobsieve.operators.store import first_per_key

    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    return first_per_key(reduce(DataFrame.unionByName, ranked), [key], [F.col("_rank"), F.col("title")]).drop("_rank")
