import random
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from jobsieve.operators import similarity, store
from jobsieve.operators.asof import last_before
from jobsieve.streaming.breaker import Breaker, fold, fold_stream, run


def test_upsert_keeps_what_was_seen_first(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v int, first int")
    new = spark.createDataFrame([("b", None, 99), ("c", 3, 30)], "k string, v int, first int")
    got = {r[0]: (r[1], r[2]) for r in store.upsert(old, new, "k", ["v"], ["first"]).collect()}
    assert got == {"a": (1, 10), "b": (None, 20), "c": (3, 30)}


def test_insert_ignore_and_fallback(spark):
    old, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, store.insert_ignore(old, new, ["k"]).collect())) == [(1, "x"), (2, "z")]
    empty = old.where("false")
    assert store.with_fallback(empty, new).count() == 2 and store.with_fallback(old, new).count() == 1


def test_cap_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "g string, i int")
    assert {r.g: r["count"] for r in store.cap_per_group(df, ["g"], [F.col("i")], 3).groupBy("g").count().collect()} == {"a": 3, "b": 1}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == lcs(a, b)


def test_token_set_score():
    assert similarity.token_set_score("data engineer", "engineer data berlin") == 100.0
    assert similarity.token_set_score("", "x") == 0.0 and similarity.token_set_score(None, None) == 0.0
    assert 0 < similarity.token_set_score("alpha beta", "alpha gamma") < 100


def test_fuzzy_dedup(spark):
    rows = [(1, "Data engineer", "Acme", "Town"), (2, "data  engineer", "Acme", "Town"), (3, "Data engineer (m/f/x)", "Acme", "Town"), (4, "Plumber", None, None)]
    got = similarity.fuzzy_dedup(spark.createDataFrame(rows, "job_id long, title string, company string, location string")).collect()
    assert sorted((r.job_id, r.copies) for r in got) == [(1, 2), (4, 1)]


def test_fuzzy_dedup_over_places_and_title_words(spark):
    schema = "job_id long, title string, company string, location string"
    rows = [(1, "Data engineer", "Acme Pumps", "Gr.Dornbach"), (2, "Data engineer", "Acme Pumps", "Großdornbach"), (3, "Senior data engineer", "Acme Pumps", None), (4, "Planner of pumps", "Belt", "Town"), (5, "Our planner of pumps", "Other", "Town")]
    got = similarity.fuzzy_dedup(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.job_id, r.copies) for r in got) == [(1, 1), (4, 1)]
    assert similarity.fuzzy_dedup(spark.createDataFrame([], schema)).count() == 0


def test_fuzzy_dedup_against_greedy_leaders(spark):
    rng = random.Random(4)
    words = ["planner", "engineer", "senior", "pumps", "for", "data", "team", "plannre", "lead"]
    firms = ["acme pumps gmbh", "acme pmups gmbh", "acme gmbh", "belt gmbh", "belt & co", "", "gmbh", "zirkon"]
    rows = {(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))), rng.choice(firms), rng.choice(["a", "b", "c", "d", ""])) for _ in range(400)}
    rows = [dict(zip(("title", "company", "location"), r), job_id=i) for i, r in enumerate(sorted(rows, key=lambda _: rng.random()))]
    got = similarity.fuzzy_dedup(spark.createDataFrame(pd.DataFrame(rows))).collect()
    assert sorted(r.job_id for r in got) == [rows[i]["job_id"] for i in similarity.greedy_leaders(rows)]


def test_last_before_against_merge_asof(spark):
    rng = random.Random(5)
    at = lambda: datetime(2024, 1, 1 + rng.randrange(9), rng.randrange(24), rng.randrange(60))
    left = pd.DataFrame({"k": [rng.choice("ab") for _ in range(200)], "ts": [at() for _ in range(200)]}).sort_values("ts", ignore_index=True)
    right = pd.DataFrame({"k": [rng.choice("ab") for _ in range(20)], "ts": [at() for _ in range(20)]}).sort_values("ts", ignore_index=True)
    expected = pd.merge_asof(left, right.assign(m=right.ts), on="ts", by="k")
    schema = "k string, ts timestamp_ntz"
    got = last_before(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "ts", "m").toPandas()
    key = lambda df: sorted((r.k, str(r.ts), str(r.m)) for r in df.itertuples())
    assert key(got) == key(expected)


def sections_of(text, headings):
    """The same by a plain loop."""
    import re

    out, current, lines = {}, "header", []
    for line in (text or "").split("\n"):
        key = re.sub(r"[^a-z\s&]", "", line.strip().lower()).strip()
        found = next((h for h in headings if key.startswith(h)), None)
        if found is None:
            lines.append(line)
            continue
        if lines:
            out[current] = "\n".join(lines).strip()
        current, lines = found, []
    if lines:
        out[current] = "\n".join(lines).strip()
    return out


def test_sections_against_a_plain_loop(spark, monkeypatch):
    import random

    from jobsieve.operators import sections

    monkeypatch.setattr(sections, "BLOCK", 7)  # texts of several blocks
    rng = random.Random(5)
    words = ["Experience", "Skills:", "work experience 2020", "Projects", "* Education & more", "Ann", "b c", "", "  x  ", "Hobbies"]
    texts = {1: "Ann\nExperience\na\nb\nSkills:\nc\nExperience\nlater", 2: None, 3: "", 4: "Skills", 5: "Skills\nExperience\n\n"}
    texts |= {10 + i: "\n".join(rng.choice(words) for _ in range(rng.randrange(60))) for i in range(40)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(1, texts[1])], "id long, text string")
    got: dict = {}
    for r in sections.split_sections(df, "id", "text").collect():
        assert (r.id, r.section) not in got
        got[r.id, r.section] = r.content
    assert got == {(i, k): v for i, t in texts.items() for k, v in sections_of(t, sections.HEADINGS).items()}
    assert got[1, "experience"] == "later"  # a heading that comes again replaces what stood under it
    assert sections.split_sections(df.where("false"), "id", "text").count() == 0


def test_breaker_opens_probes_and_closes():
    b = Breaker(threshold=2, base=10, longest=30)
    assert b.step("query", 1000) and b.step("limit", 1000) is None and b.state == "closed"
    b.step("limit", 1000)
    assert b.state == "open" and b.until == 1010 and b.step("query", 1005) is False
    assert b.step("query", 1011) is True and b.state == "half-open" and b.step("query", 1011) is False
    b.step("limit", 1012)
    assert b.state == "open" and b.until == 1032
    b.step("success", 1040)
    assert b.state == "closed" and b.limits == 0


def test_breaker_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), datetime(2024, 1, 1, 0, i // 60, i % 60), rng.choice(["query", "success", "limit", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "engine string, ts timestamp_ntz, call_kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = fold_stream(stream).writeStream.format("memory").queryName("breaker_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted((r.engine, str(r.ts), r.call_kind, r.state, r.allowed, r.blocked_until) for r in d.collect())
    assert key(spark.table("breaker_out")) == key(fold(df))
    assert len(run(df.where("call_kind is not null").toPandas(), Breaker())) == df.where("call_kind is not null").count()
