"""Relational queries over the job tables: joins, changes, windows, groups, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.operators import store
from jobsieve.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT application_id, a.job_id, status, title, company, updated_at FROM applications a JOIN jobs j ON a.job_id = j.job_id")
def app_join_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("job_id", "title", "company")
    return table(spark, d, "applications").join(jobs, "job_id").select("application_id", "job_id", "status", "title", "company", "updated_at")


@query("SELECT job_id, title, match_score FROM jobs WHERE profile_slug = 'default' AND is_active = 1 AND match_score >= 40 AND NOT isnan(match_score) AND lower(source) = 'jobhafen' AND contains(lower(location), 'a') ORDER BY match_score DESC, last_seen_at DESC, job_id LIMIT 25 OFFSET 10")
def jobs_filtered_page(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "jobs").where("profile_slug = 'default' AND is_active = 1 AND match_score >= 40 AND NOT isnan(match_score)")
    df = df.where((F.lower("source") == "jobhafen") & F.lower("location").contains("a"))
    return df.orderBy(F.desc("match_score"), F.desc("last_seen_at"), "job_id").offset(10).limit(25).select("job_id", "title", "match_score")


@query("SELECT job_id, title, source FROM jobs WHERE job_id = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("job_id = 7").select("job_id", "title", "source")


@query("SELECT status, count(*) AS applications FROM applications GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").groupBy("status").agg(F.count("*").alias("applications"))


@query("SELECT profile_slug, CAST(sum(CASE WHEN status IN ('applied', 'interview', 'offer') THEN 1 ELSE 0 END) AS BIGINT) AS in_progress, count(*) AS applications, count(DISTINCT job_id) AS jobs FROM applications GROUP BY profile_slug")
def progress_by_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").groupBy("profile_slug").agg(F.sum(F.when(F.col("status").isin("applied", "interview", "offer"), 1).otherwise(0)).alias("in_progress"), F.count("*").alias("applications"), F.countDistinct("job_id").alias("jobs"))


@query("SELECT job_id, source FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM dismissed_jobs x WHERE x.job_id = j.job_id)")
def dismissed_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", "source").join(table(spark, d, "dismissed_jobs").select("job_id"), "job_id", "left_anti")


@query("SELECT note_id, n.application_id FROM notes n WHERE NOT EXISTS (SELECT 1 FROM applications a WHERE a.application_id = n.application_id AND a.status <> 'saved')")
def orphan_notes(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "applications").where("status <> 'saved'").select("application_id")
    return table(spark, d, "notes").select("note_id", "application_id").join(kept, "application_id", "left_anti").select("note_id", "application_id")


@query("SELECT n.application_id, count(*) AS notes, max(n.created_at) AS last_note FROM notes n JOIN applications a ON n.application_id = a.application_id GROUP BY n.application_id")
def notes_by_application(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "notes").groupBy("application_id").agg(F.count("*").alias("notes"), F.max("created_at").alias("last_note"))
    return notes.join(table(spark, d, "applications").select("application_id"), "application_id")


@query("""
SELECT job_id, coalesce(max(p2.head_status), 0) AS head_status FROM jobs j LEFT JOIN (SELECT url, max(head_status) AS head_status FROM url_probes GROUP BY url) p2 ON j.url = p2.url GROUP BY job_id""")
def probe_lookup_left(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "url_probes").groupBy("url").agg(F.max("head_status").alias("head_status"))
    return table(spark, d, "jobs").select("job_id", "url").join(probes, "url", "left").select("job_id", F.coalesce("head_status", F.lit(0)).alias("head_status"))


@query("""
WITH p AS (SELECT DISTINCT url FROM url_probes WHERE url IS NOT NULL), f AS (SELECT DISTINCT final_url AS url FROM url_probes WHERE final_url IS NOT NULL)
SELECT job_id, CASE WHEN p.url IS NOT NULL THEN 'url' WHEN f.url IS NOT NULL THEN 'final' ELSE 'none' END AS matched_by FROM jobs j LEFT JOIN p ON j.url = p.url LEFT JOIN f ON j.quality.normalized_url = f.url""")
def or_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by one key or another as two equality joins instead of one join with OR."""
    probes = table(spark, d, "url_probes")
    by_url = probes.select("url").where("url is not null").distinct().withColumn("u", F.lit(True))
    by_final = probes.select(F.col("final_url").alias("nurl")).where("nurl is not null").distinct().withColumn("f", F.lit(True))
    jobs = table(spark, d, "jobs").select("job_id", "url", F.col("quality.normalized_url").alias("nurl"))
    return jobs.join(by_url, "url", "left").join(by_final, "nurl", "left").select("job_id", F.when(F.col("u"), "url").when(F.col("f"), "final").otherwise("none").alias("matched_by"))


@query("SELECT place_name, count(j.job_id) AS jobs FROM ref_places p JOIN jobs j ON contains(lower(j.location), lower(p.place_name)) GROUP BY place_name")
def place_contains_count(spark: SparkSession, d: str) -> DataFrame:
    """How many locations hold a place's name anywhere: distinct locations and names meet by three letters in common, then the whole name is looked for."""
    names = table(spark, d, "ref_places").select("place_name").where("place_name <> ''").distinct()
    places = table(spark, d, "jobs").where("location is not null").groupBy(F.lower("location").alias("text")).agg(F.count("*").alias("n"))
    return store.contained(places, "text", names.withColumn("name", F.lower("place_name")), "name").groupBy("place_name").agg(F.sum("n").alias("jobs"))


@query("SELECT split_part(split_part(source, '→', 1), '->', 1) AS source_root, count(*) AS jobs FROM jobs GROUP BY 1")
def source_root_count(spark: SparkSession, d: str) -> DataFrame:
    root = F.substring_index(F.substring_index("source", "→", 1), "->", 1)
    return table(spark, d, "jobs").groupBy(root.alias("source_root")).agg(F.count("*").alias("jobs"))


_SIDE = "SELECT quality.normalized_url AS k, arg_max(title, job_id) AS title, max(last_seen_at) AS last_seen_at, min(first_seen_at) AS first_seen_at, max(job_id) AS job_id FROM jobs WHERE quality.normalized_url IS NOT NULL AND job_id % 3 {c} 0 GROUP BY 1"


@query(f"""
WITH o AS (SELECT k, last_seen_at, first_seen_at, job_id FROM ({_SIDE.format(c="<>")})), n AS (SELECT k, last_seen_at, first_seen_at, job_id FROM ({_SIDE.format(c="=")}))
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.last_seen_at ELSE o.last_seen_at END AS last_seen_at, CASE WHEN n.k IS NOT NULL THEN n.job_id ELSE o.job_id END AS job_id, CASE WHEN o.k IS NOT NULL THEN o.first_seen_at ELSE n.first_seen_at END AS first_seen_at
FROM o FULL OUTER JOIN n ON o.k = n.k""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select(F.col("quality.normalized_url").alias("k"), "job_id", "last_seen_at", "first_seen_at").where("k is not null")
    side = lambda c: jobs.where(c).groupBy("k").agg(F.max("last_seen_at").alias("last_seen_at"), F.min("first_seen_at").alias("first_seen_at"), F.max("job_id").alias("job_id"))
    return store.upsert(side("job_id % 3 <> 0"), side("job_id % 3 = 0"), "k", ["last_seen_at", "job_id"], ["first_seen_at"])


@query("SELECT job_id, min(coalesce(reason, '')) AS reason FROM dismissed_jobs GROUP BY job_id UNION ALL SELECT DISTINCT job_id, 'applied' FROM applications a WHERE NOT EXISTS (SELECT 1 FROM dismissed_jobs x WHERE x.job_id = a.job_id)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "dismissed_jobs").groupBy("job_id").agg(F.min(F.coalesce("reason", F.lit(""))).alias("reason"))
    return store.insert_ignore(old, table(spark, d, "applications").select("job_id", F.lit("applied").alias("reason")).distinct(), ["job_id"])


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, application_id DESC) AS rn, min(created_at) OVER (PARTITION BY job_id) AS first_created FROM applications)
SELECT job_id, application_id, status, first_created AS created_at FROM r WHERE rn = 1""")
def replace_keep_created(spark: SparkSession, d: str) -> DataFrame:
    apps = table(spark, d, "applications").select("job_id", "application_id", "status", "updated_at", "created_at")
    return apps.groupBy("job_id").agg(F.max_by(F.struct("application_id", "status"), F.struct("updated_at", "application_id")).alias("r"), F.min("created_at").alias("created_at")).select("job_id", "r.application_id", "r.status", "created_at")


@query("SELECT job_id, CASE WHEN quality.url_status = 'dead' THEN 0 ELSE is_active END AS is_active FROM jobs")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    return store.soft_delete(table(spark, d, "jobs").select("job_id", "is_active", "quality"), F.col("quality.url_status") == "dead").select("job_id", "is_active")


@query("SELECT note_id, application_id FROM notes n WHERE EXISTS (SELECT 1 FROM applications a WHERE a.application_id = n.application_id AND coalesce(a.profile_slug, '') <> 'default')")
def delete_with_orphans(spark: SparkSession, d: str) -> DataFrame:
    return store.delete_with_orphans(table(spark, d, "applications"), table(spark, d, "notes"), F.col("profile_slug") == "default", "application_id")[1].select("note_id", "application_id")


@query("SELECT application_id, status FROM applications WHERE profile_slug = CASE WHEN EXISTS (SELECT 1 FROM applications WHERE profile_slug = 'no-such') THEN 'no-such' ELSE 'default' END")
def fallback_rows(spark: SparkSession, d: str) -> DataFrame:
    apps = table(spark, d, "applications").select("application_id", "status", "profile_slug")
    return store.with_fallback(apps.where("profile_slug = 'no-such'"), apps.where("profile_slug = 'default'")).select("application_id", "status")


@query("SELECT coalesce(status IN ('saved', 'applied', 'phone_screen', 'interview', 'offer', 'accepted', 'rejected', 'withdrawn', 'ghosted', 'archived'), false) AS known, count(*) AS n FROM applications GROUP BY 1")
def enum_validate(spark: SparkSession, d: str) -> DataFrame:
    known = F.coalesce(F.col("status").isin("saved", "applied", "phone_screen", "interview", "offer", "accepted", "rejected", "withdrawn", "ghosted", "archived"), F.lit(False))
    return table(spark, d, "applications").groupBy(known.alias("known")).agg(F.count("*").alias("n"))


@query("SELECT quality.normalized_url AS url, min(job_id) AS job_id FROM jobs GROUP BY 1")
def dedup_first_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy(F.col("quality.normalized_url").alias("url")).agg(F.min("job_id").alias("job_id"))


@query("""
WITH r AS (SELECT quality.normalized_url AS url, job_id, row_number() OVER (PARTITION BY quality.normalized_url ORDER BY coalesce(quality.score, 0) DESC, length(coalesce(description, '')) DESC, scraped_at DESC, job_id DESC) AS rn FROM jobs)
SELECT url, job_id FROM r WHERE rn = 1""")
def dedup_best_url(spark: SparkSession, d: str) -> DataFrame:
    best = F.struct(F.coalesce("quality.score", F.lit(0)), F.length(F.coalesce("description", F.lit(""))), "scraped_at", "job_id")
    return table(spark, d, "jobs").groupBy(F.col("quality.normalized_url").alias("url")).agg(F.max_by("job_id", best).alias("job_id"))


@query("SELECT source, job_id FROM (SELECT source, job_id, row_number() OVER (PARTITION BY source ORDER BY job_id) AS rn FROM jobs) WHERE rn <= 30")
def per_source_cap(spark: SparkSession, d: str) -> DataFrame:
    return store.cap_per_group(table(spark, d, "jobs").select("source", "job_id"), ["source"], [F.col("job_id")], 30)


@query("SELECT type_name || ' ' || place_name AS search_text, type_id, place_id FROM ref_job_types, ref_places WHERE country_code = 'DE'")
def fanout_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search texts of two fixed lists: every type is exploded over the list of places."""
    places = table(spark, d, "ref_places").where("country_code = 'DE'").agg(F.collect_list(F.struct("place_id", "place_name")).alias("places"))
    types = table(spark, d, "ref_job_types").join(F.broadcast(places))
    return types.select("type_id", "type_name", F.explode("places").alias("p")).select(F.concat_ws(" ", "type_name", "p.place_name").alias("search_text"), "type_id", "p.place_id")


@query("SELECT source, count(*) AS postings, CAST(sum(CASE WHEN is_active = 1 THEN 1 ELSE 0 END) AS BIGINT) AS active, count(DISTINCT company) AS companies, min(first_seen_at) AS first_seen FROM jobs GROUP BY source")
def source_overview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("source").agg(F.count("*").alias("postings"), F.sum(F.when(F.col("is_active") == 1, 1).otherwise(0)).alias("active"), F.countDistinct("company").alias("companies"), F.min("first_seen_at").alias("first_seen"))


@query("SELECT coalesce(quality.url_status, 'unknown') AS url_status, count(*) AS n FROM jobs GROUP BY 1")
def url_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy(F.coalesce("quality.url_status", F.lit("unknown")).alias("url_status")).agg(F.count("*").alias("n"))


@query("""
SELECT url, probed_at, CASE WHEN coalesce(head_status, 999) < 400 THEN CASE WHEN coalesce(final_url, url) <> url THEN 'redirected' ELSE 'alive' END WHEN head_status IN (403, 405) AND coalesce(get_status, 999) < 400 THEN 'alive' WHEN head_status IN (403, 429) OR (head_status = 405 AND get_status IN (403, 429)) THEN 'blocked' WHEN head_status IS NULL THEN 'uncertain' ELSE 'dead' END AS state FROM url_probes""")
def probe_state(spark: SparkSession, d: str) -> DataFrame:
    head, get = F.coalesce("head_status", F.lit(999)), F.coalesce("get_status", F.lit(999))
    state = (
        F.when(head < 400, F.when(F.coalesce("final_url", "url") != F.col("url"), "redirected").otherwise("alive")).when(F.col("head_status").isin(403, 405) & (get < 400), "alive")
        .when(F.col("head_status").isin(403, 429) | ((F.col("head_status") == 405) & F.col("get_status").isin(403, 429)), "blocked").when(F.col("head_status").isNull(), "uncertain").otherwise("dead")
    )
    return table(spark, d, "url_probes").select("url", "probed_at", state.alias("state"))


@query("SELECT tag, count(*) AS postings FROM (SELECT job_id, unnest(list_distinct(tags)) AS tag FROM jobs) GROUP BY tag")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("postings"))


@query("SELECT company, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources, count(*) AS postings FROM jobs WHERE company IS NOT NULL AND source IS NOT NULL GROUP BY company HAVING count(*) >= 5")
def company_sources(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "jobs").where("company is not null and source is not null").groupBy("company").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.count("*").alias("postings"))
    return groups.where("postings >= 5")


@query("SELECT job_id, match_score, row_number() OVER (ORDER BY match_score DESC, job_id) AS rank_no FROM jobs WHERE match_score IS NOT NULL AND NOT isnan(match_score) QUALIFY rank_no <= 50")
def top_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best 50 with their rank: a top-k first, so that the ranks are set on 50 rows."""
    from pyspark.sql import Window as W

    top = table(spark, d, "jobs").where("match_score is not null and not isnan(match_score)").select("job_id", "match_score").orderBy(F.desc("match_score"), "job_id").limit(50)
    return top.withColumn("rank_no", F.row_number().over(W.orderBy(F.desc("match_score"), "job_id")).cast("long"))


@query("SELECT coalesce(profile_slug, '(all)') AS profile, coalesce(bucket, '(all)') AS bucket, count(*) AS n FROM (SELECT coalesce(nullif(profile_slug, ''), 'none') AS profile_slug, coalesce(quality.bucket, 'none') AS bucket FROM jobs) GROUP BY ROLLUP (profile_slug, bucket)")
def bucket_rollup(spark: SparkSession, d: str) -> DataFrame:
    slug = F.when(F.coalesce("profile_slug", F.lit("")) == "", "none").otherwise(F.col("profile_slug"))
    jobs = table(spark, d, "jobs").select(slug.alias("profile_slug"), F.coalesce("quality.bucket", F.lit("none")).alias("bucket"))
    return jobs.rollup("profile_slug", "bucket").agg(F.count("*").alias("n")).select(F.coalesce("profile_slug", F.lit("(all)")).alias("profile"), F.coalesce("bucket", F.lit("(all)")).alias("bucket"), "n")


def _tpch_join(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), "c_nationkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return orders.join(customers, "c_custkey").groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES["orders_by_nation"] = _tpch_join
SQL["orders_by_nation"] = "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
