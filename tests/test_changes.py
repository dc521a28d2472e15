"""Changes of tables, ranks, containment and texts on small cases and their edges."""

from datetime import datetime

from pyspark.sql import functions as F

from jobsieve.config import merged
from jobsieve.operators import similarity, store
from jobsieve.operators.ranking import rank_within
from jobsieve.streaming.breaker import is_limit, snapshot

NOW = datetime(2025, 6, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_status_groups_and_columns(spark):
    at = F.lit("2025-06-01").cast("timestamp_ntz")
    apps = spark.createDataFrame([(1, "saved", None, None), (2, "offer", NOW, NOW), (3, None, None, None)], "application_id int, status string, applied_at timestamp_ntz, updated_at timestamp_ntz")
    assert rows(store.change_status(apps, F.col("status") == "saved", "applied", at)) == [(1, "applied", NOW, NOW), (2, "offer", NOW, NOW), (3, None, None, None)]
    assert rows(store.change_status(apps, F.col("status") == "saved", "archived", at))[0] == (1, "archived", None, NOW)
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "g string, x int")
    new = spark.createDataFrame([("a", 9)], "g string, x int")
    assert rows(store.replace_group(old, new, "g", ["a"])) == [("a", 9), ("b", 2), (None, 3)]
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    change = spark.createDataFrame([(2, None), (3, "c")], "k int, p string")
    assert rows(store.merge_columns(base, change, "k")) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    assert store.renamed(base, ["k"], {"p": "r", "nothing": "n"}).columns == ["k", "r"]


def test_seen_again(spark):
    old = spark.createDataFrame([("u", "t", datetime(2025, 1, 1), datetime(2025, 2, 1), False), ("v", "t", datetime(2025, 1, 1), datetime(2025, 2, 1), False)], "k string, title string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, active boolean")
    new = spark.createDataFrame([("u", "new"), ("w", "fresh")], "k string, title string")
    got = rows(store.seen_again(old, new, "k", ["title"], F.lit("2025-06-01").cast("timestamp_ntz")))
    assert got == [("u", "new", datetime(2025, 1, 1), NOW, True), ("v", "t", datetime(2025, 1, 1), datetime(2025, 2, 1), False), ("w", "fresh", NOW, NOW, True)]


def test_lists_caches_and_containment(spark):
    lists = spark.createDataFrame([('["a", " b ", ""]', ["a", "b"]), ("a, b,,c ", ["a", "b", "c"]), (None, []), ("[broken", ["[broken"])], "x string, e array<string>")
    assert lists.where(store.as_list(F.col("x")) != F.col("e")).count() == 0
    now, cache = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", "3")], "n string, d string"), spark.createDataFrame([("f", "1"), ("g", "0"), ("f", "1")], "n string, d string")
    assert rows(store.changed(now, cache, ["n", "d"])) == [("g", "2"), ("h", "3")]
    texts = spark.createDataFrame([("bad thalmünde", 2), ("x", 1), ("", 1), ("talheim", 5)], "t string, n int")
    names = spark.createDataFrame([("thal",), ("x",), ("münde",), ("tal",), ("zz",)], "name string")
    assert {(r.t, r["name"]) for r in store.contained(texts, "t", names, "name").collect()} == {(t, n) for t in ("bad thalmünde", "x", "", "talheim") for n in ("thal", "x", "münde", "tal", "zz") if n in t}


def test_rank_within_against_a_window(spark):
    import random

    rng = random.Random(2)
    data = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(5)) for i in range(3000)]
    got = {r.i: r.rank_no for r in rank_within(spark.createDataFrame(data, "i int, g string, s int"), "g", [F.col("s"), F.col("i")]).collect()}
    for g in ("hot", "a", "b", None):
        for k, (i, _, _) in enumerate(sorted((x for x in data if x[1] == g), key=lambda x: (x[2], x[0])), 1):
            assert got[i] == k
    assert rank_within(spark.createDataFrame([], "i int, g string"), "g", [F.col("i")]).count() == 0


def test_ngram_cosine_against_plain_python(spark):
    import math
    import re

    def grams(text):
        words = [w for w in re.findall(r"[^\W_]{2,}", text.lower()) if w not in similarity.STOP_WORDS]
        return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    profile = "data engineer for a data team with project planning"
    docs = {1: "We plan with the data team, data team first. Project planning!", 2: "nothing alike", 3: None, 4: "", 5: profile, 6: "engineer"}
    got = {r.id: r.score for r in similarity.ngram_cosine(spark.createDataFrame(list(docs.items()), "id int, text string"), profile, "id", "text").collect()}
    own = similarity.ngrams(profile)
    for i, text in docs.items():
        tf = {g: 1 + math.log(grams(text or "").count(g)) for g in own if g in grams(text or "")}
        norm = math.sqrt(sum(v * v for v in tf.values())) * math.sqrt(sum(v * v for v in own.values()))
        assert abs(got[i] - (min(100.0, 150 * sum(v * own[g] for g, v in tf.items()) / norm) if norm else 0.0)) < 1e-9
    assert got[5] == 100.0 and similarity.hit_rate(["data team", "cook"], "a data team") == 50.0 and similarity.hit_rate([], "x") == 0.0


def test_layers_and_limits(spark):
    assert merged({"a": {"x": 1, "y": [1]}, "b": 1}, None, {"a": {"y": [2], "z": 3}}, {"b": {"c": 1}}) == {"a": {"x": 1, "y": [2], "z": 3}, "b": {"c": 1}}
    errors = spark.createDataFrame([("HTTP 429", True), ("CAPTCHA wanted", True), ("timeout", False), (None, False)], "m string, e boolean")
    assert errors.where(is_limit(F.col("m")) != F.col("e")).count() == 0
    folded = spark.createDataFrame([("a", NOW, "limit", None, "open", 100.0), ("b", NOW, "success", None, "closed", 0.0)], "engine string, ts timestamp_ntz, call_kind string, allowed boolean, state string, blocked_until double")
    assert rows(snapshot(folded, 40.0)) == [("a", "open", 60.0), ("b", "closed", 0.0)]
