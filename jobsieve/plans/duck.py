"""Pieces of DuckDB SQL that several queries' twins share."""

from __future__ import annotations

import re
from collections.abc import Iterable

from jobsieve.functions import dates as D
from jobsieve.functions import urls as U


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values: Iterable[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def any_of(column: str, words: Iterable[str]) -> str:
    """Whether a column holds any of the literals; false for null."""
    return f"coalesce(regexp_matches({column}, {text('|'.join(re.escape(w) for w in words))}), false)"


def url_part(column: str, group: int) -> str:
    return f"regexp_extract({column}, {text(U.SPLIT)}, {group})"


def cleaned(column: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        column = f"replace({column}, {text(entity)}, {text(plain)})"
    return rf"trim(regexp_replace(regexp_replace({column}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def company(column: str) -> str:
    c = cleaned(column)
    return rf"CASE WHEN regexp_matches({c}, '(?i)^\(via\s+(.+?)\)$') THEN trim(regexp_extract({c}, '(?i)^\(via\s+(.+?)\)$', 1)) ELSE {c} END"


def normal_url(column: str) -> str:
    """A URL in its normal form: the query's pairs without tracking keys, sorted."""
    x = f"trim({column})"
    kept = f"list_filter(string_split({url_part(x, 4)}, '&'), lambda p: contains(p, '=') AND NOT list_contains({texts(U.TRACKING_KEYS)}, lower(split_part(p, '=', 1))) AND NOT starts_with(lower(p), 'utm_'))"
    return f"""CASE WHEN trim(coalesce({column}, '')) = '' THEN '' ELSE lower({url_part(x, 1)}) || '://' || lower({url_part(x, 2)}) || coalesce(nullif(regexp_replace({url_part(x, 3)}, '/+$', ''), ''), '/')
 || CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string(list_sort({kept}), '&') END END"""


def people_page(url: str) -> str:
    return f"len(list_intersect(string_split(lower({url_part(url, 3)}), '/'), {texts(U.PEOPLE_SEGMENTS)})) > 0"


def query_keys(url: str) -> str:
    return f"list_transform(list_filter(string_split({url_part(url, 4)}, '&'), lambda p: contains(p, '=') AND split_part(p, '=', 2) <> ''), lambda p: split_part(p, '=', 1))"


def board_detail(url: str) -> str:
    path = f"lower({url_part(url, 3)})"
    return rf"(contains(lower({url_part(url, 2)}), 'glassdoor.') AND contains({path}, '/job-listing/') AND (regexp_matches({path}, '[/-]jv_|\.htm$') OR list_contains({query_keys(url)}, 'jl')))"


def listing_page(title: str, url: str) -> str:
    host, path = f"lower({url_part(url, 2)})", f"regexp_replace(lower({url_part(url, 3)}), '/+$', '')"
    named = " OR ".join(f"coalesce(regexp_matches({title}, {text(p)}), false)" for p in U.listing_titles().values())
    ends = f"regexp_matches({path}, {text('(?:' + '|'.join(U.SEARCH_ENDS) + ')$')})"
    keyed = f"len(list_intersect({query_keys(url)}, {texts(U.SEARCH_KEYS)})) > 0"
    boards = rf"""CASE WHEN contains({host}, 'linkedin.com') THEN contains({path}, '/jobs/search') OR (contains({path}, '/jobs') AND NOT contains({path}, '/view/') AND NOT regexp_matches({path}, '/jobs/\d'))
 WHEN contains({host}, 'glassdoor.') THEN regexp_matches({path}, '^/jobs|^/job-search|jobs-e')
 WHEN contains({host}, 'indeed') THEN ({path} IN ('/jobs', '/q') OR (starts_with({path}, '/jobs/') AND NOT contains({path}, 'viewjob') AND NOT contains({url}, 'rc/clk'))) AND len({query_keys(url)}) > 0 ELSE false END"""
    return f"(NOT {board_detail(url)} AND ({named} OR {ends} OR {keyed} OR {boards}))"


def _instant(year: str, month: str, day: str, hour: str, minute: str, second: str, fraction: str) -> str:
    two = lambda c: f"lpad(CASE WHEN {c} = '' THEN '0' ELSE {c} END, 2, '0')"
    return f"try_cast({year} || '-' || {two(month)} || '-' || {two(day)} || ' ' || {two(hour)} || ':' || {two(minute)} || ':' || {two(second)} || '.' || rpad(substring({fraction}, 1, 6), 6, '0') AS TIMESTAMP)"


def iso_instant(x: str) -> str:
    g = [f"regexp_extract({x}, {text(D.ISO)}, {i})" for i in range(1, 8)]
    return f"CASE WHEN regexp_matches({x}, {text(D.ISO)}) THEN {_instant(*g)} END"


def epoch_instant(x: str) -> str:
    n = f"CAST({x} AS DOUBLE)"
    return rf"CASE WHEN regexp_matches({x}, '^\d{{1,15}}$') THEN make_timestamp(CAST(trunc((CASE WHEN {n} > 1e10 THEN {n} / 1000 ELSE {n} END) * 1e6) AS BIGINT)) END"


def has(x: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def posted_date(column: str, now: str) -> str:
    x = f"trim(coalesce({column}, ''))"
    low = f"lower({x})"
    at = f"TIMESTAMP '{now}'"
    group = lambda pattern, i: f"regexp_extract({x}, {text(pattern)}, {i})"
    ymd, dmy, mail = ([group(p, i) for i in range(1, n)] for p, n in ((D.YMD, 7), (D.DMY, 4), (D.MAIL, 7)))
    month = "CASE lower(" + mail[1] + ") " + " ".join(f"WHEN '{m}' THEN '{i:02}'" for m, i in D.MONTH_NUMBERS.items()) + " ELSE '99' END"
    return f"""CASE WHEN {x} = '' THEN NULL WHEN regexp_matches({x}, '^\\d+$') THEN {epoch_instant(x)} WHEN {has(low, D.NOW_WORDS)} THEN {at} WHEN {has(low, D.YESTERDAY_WORDS)} THEN {at} - INTERVAL 1 DAY
 WHEN {has(low, D.HOUR_WORDS)} THEN {at} - INTERVAL 1 HOUR WHEN {has(low, D.MINUTE_WORDS)} THEN {at} - INTERVAL 15 MINUTE
 ELSE coalesce({iso_instant(x)}, CASE WHEN regexp_matches({x}, {text(D.MAIL)}) THEN {_instant(mail[2], month, mail[0], mail[3], mail[4], mail[5], "''")} END,
  CASE WHEN regexp_matches({x}, {text(D.YMD)}) THEN {_instant(*ymd, "''")} END, CASE WHEN regexp_matches({x}, {text(D.DMY)}) THEN {_instant(dmy[2], dmy[1], dmy[0], "''", "''", "''", "''")} END) END"""


def recent(column: str, now: str, hours: int) -> str:
    x = f"coalesce({column}, '')"
    at = f"coalesce({epoch_instant(x)}, {iso_instant(x)})" if hours > 24 else iso_instant(x)
    return f"CASE WHEN {x} = '' THEN false ELSE coalesce(TIMESTAMP '{now}' - ({at}) < INTERVAL {hours} HOUR, {has(f'lower({x})', D.RECENT_WORDS)}) END"
