"""Checks of incoming records, with a reason for each rejection and a flag for each weakness; decisions about probed URLs."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.dates import posted_date
from jobsieve.functions.text import clean_company, clean_text, holds_any
from jobsieve.functions.urls import Parts, is_board_detail, is_listing_page, is_people_page, normalize_url

# Words whose presence decides a rule.
GENERIC_COMPANIES = ("company", "employer", "hiring team", "job board", "recruiting team", "unknown", "web")
NOISE_URL = ("curriculum-vitae", "karrierebibel", "lebenslauf")
NOISE_TITLE = ("salary", "resume", "profile", "lebenslauf", "curriculum vitae")
ROLE_WORDS = ("ai", "analytics", "backend", "cloud", "data", "developer", "devops", "engineer", "machine learning", "ml", "python", "research", "software", "thesis", "architect", "ingenieur", "konstruktion", "mbse", "requirements", "safety", "systems", "validation", "verification")
JOB_WORDS = ("career", "careers", "job", "jobs", "jobid", "karriere", "stellen", "vacancy", "workdayjobs")
#: Parts of addresses that never hold postings.
GARBAGE = (
    "porn", "xxx", "xnxx", "xhamster", "pornhub", "xvideos", "redtube", "youporn", "tube8", "fapvid", "tubepleasure", "colliderporn", "apkpure", "play.google", "apps.apple", "microsoft.com/store", "win-rar", "download.cnet",
    "vk.com", "reddit.com", "quora.com", "stackoverflow.com", "zhihu.com", "baidu.com", "win11forum", "windowsarea", "translate.google", "deepl.com", "dict.cc", "linguee", "lemedecin", "medicaments", "smartgaming-shop", "steam", "epicgames",
    "museumexplorer", "thetrainpark", "wanderer", "tubitv", "tiktok.com", "instagram.com", "facebook.com", "twitter.com", "x.com", "youtube.com", "accounts.google", "login.microsoft", "sso.", "fintiba", "bluetooths", "copilot.microsoft",
    "hoebeginik", "ideenraum", "digitalstudioweb", "presse.", "blog.", "hilfe.",
)


@dataclass(frozen=True)
class Rules:
    """Sizes and thresholds of the checks; least scores by stage and mode."""

    trusted: tuple[str, ...] = ()
    garbage: tuple[str, ...] = GARBAGE
    title_chars: tuple[int, int] = (8, 160)
    description_chars: int = 50
    mode: str = "balanced"
    batch_least: int = 20
    final_least: int | None = None

    def least(self, stage: str) -> int:
        if stage == "batch":
            return self.batch_least
        return self.final_least if self.final_least is not None else {"strict": 55, "lenient": 25}.get(self.mode, 40)


def assess(df: DataFrame, rules: Rules, as_of: str, stage: str = "final") -> DataFrame:
    """df's job_id with accepted, score, bucket, flags and reject_reason (empty if none), and the cleaned columns.

    One projection without a shuffle; cleaned values and the URL are computed once. Values that are null count as empty.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    c = df.select(
        "job_id", clean_text(F.col("title")).alias("title"), clean_company(F.col("company")).alias("company"), clean_text(F.col("location")).alias("location"), clean_text(F.col("description")).alias("description"),
        F.lower(clean_text(F.col("source"))).alias("source"), normalize_url(F.col("url")).alias("url"), posted_date(F.col("posted_date"), now).alias("posted"),
    )
    url, size = F.col("url"), F.length("title")
    c = c.withColumns({"low_url": F.lower("url"), "low_title": F.lower("title"), "low_text": F.lower("description"), "trusted": holds_any(F.col("source"), rules.trusted), **Parts.of(url).named()})
    low, parts = F.col("low_url"), Parts.columns(url)
    # A condition that never holds keeps the optimizer from copying this expression into filters above, each copy with the cleaning below it.
    kept = F.spark_partition_id() < 0
    reason = (
        F.when(kept, "").when(~low.rlike("^https?://"), "invalid_url").when(holds_any(low, rules.garbage), "garbage_domain").when(is_people_page(url, parts), "noise_url").when(is_listing_page(F.col("title"), url, parts), "listing_page")
        .when(holds_any(low, NOISE_URL), "noise_url").when(holds_any(F.col("low_title"), NOISE_TITLE), "noise_title").when((size < rules.title_chars[0]) | (size > rules.title_chars[1]), "title_length")
        .when(F.col("location") == "", "missing_location").when((F.col("company") == "") & ~F.col("trusted"), "missing_company").otherwise("")
    )
    c = c.withColumn("reason", reason)
    chars, age = F.length("description"), now - F.col("posted")
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    # The role is looked for in the short fields first: most records need no look into their description.
    role = reduce(operator.or_, (holds_any(F.col(c), ROLE_WORDS) for c in ("low_title", "low_url", "source", "low_text")))
    tests = [
        (size.between(20, 100), 15, 6, "title_shape"), (role, 10, 0, "weak_role_signal"), ((F.col("company") != "") & ~F.lower("company").isin(*GENERIC_COMPANIES), 10, 0, "generic_company"),
        (F.col("trusted"), 10, 0, "untrusted_source"), (holds_any(low, JOB_WORDS), 10, 0, "weak_url_path"), (F.col("location") != "", 5, 0, None),
    ]
    score, flags = F.lit(35), []
    for test, yes, no, flag in tests:
        score = score + F.when(test, yes).otherwise(no)
        if flag:
            flags.append(F.when(~test, F.lit(flag)))
    score = score + F.when(chars >= rules.description_chars, 15).when(chars > 0, 5).otherwise(0)
    flags.append(F.when(chars >= rules.description_chars, None).when(chars > 0, "short_description").otherwise("missing_description"))
    score = score + F.when(F.col("posted").isNull() | (age < days(0)), 0).when(age <= days(30), 5).when(age <= days(90), 3).otherwise(0)
    flags.append(F.when(F.col("posted").isNull(), "unparsed_date").when(age < days(0), "future_date").when(age > days(90), "stale_posting"))
    scored = c.select("job_id", "title", "company", "location", "description", "url", "reason", F.when(F.col("reason") == "", score).alias("raw"), F.when(F.col("reason") == "", F.array_join(F.array_compact(F.array(*flags)), ",")).otherwise("").alias("flags"))
    least = rules.least(stage)
    value = F.coalesce("raw", F.lit(0))
    failed = F.when(F.col("reason") != "", F.col("reason")).when(value < least, f"score_below_{least}").otherwise("")
    return scored.select("job_id", (failed == "").alias("accepted"), F.least(value, F.lit(100)).alias("score"), bucket(value).alias("bucket"), "flags", failed.alias("reject_reason"), "title", "company", "location", "description", "url")


def bucket(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 55, "medium").otherwise("low")


def gate_metrics(assessed: DataFrame) -> DataFrame:
    """(reject_reason, seen): how many records each reason rejected, and how many were accepted (empty reason); partial counts add up."""
    return assessed.groupBy("reject_reason").agg(F.count("*").alias("seen"))


def merge_metrics(*parts: DataFrame) -> DataFrame:
    """The metrics of several batches together."""
    from functools import reduce

    return reduce(DataFrame.unionByName, parts).groupBy("reject_reason").agg(F.sum("seen").alias("seen"))


def probe_decision(url: Column, head: Column, get: Column, final_url: Column, drop_uncertain: bool = True) -> Column:
    """(status, keep, verified_url) of a probed URL.

    A HEAD answer below 400 is alive or redirected; 403 and 405 are asked again by GET; 403 and 429 are blocked, kept only for
    single postings of the board that blocks everybody; other answers are dead, none at all uncertain.
    """
    plain, final = normalize_url(url), normalize_url(F.coalesce(final_url, url))
    ok = F.coalesce(head < 400, F.lit(False)) | (head.isin(403, 405) & F.coalesce(get < 400, F.lit(False)))
    blocked = F.when(head.isin(403, 405), F.coalesce(get.isin(403, 429), F.lit(False))).otherwise(F.coalesce(head == 429, F.lit(False)))
    lost = head.isNull() | (head.isin(403, 405) & get.isNull())
    status = F.when(ok, F.when(final != plain, "redirected").otherwise("alive")).when(lost, "uncertain").when(blocked, "blocked").otherwise("dead")
    keep = F.when(ok, True).when(lost, not drop_uncertain).when(blocked, is_board_detail(url)).otherwise(False)
    return F.struct(status.alias("status"), keep.alias("keep"), F.when(ok, final).otherwise(plain).alias("verified_url"))
