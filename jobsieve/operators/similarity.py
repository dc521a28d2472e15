"""Similarity of strings and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from jobsieve.session import cut_lineage

#: Values of a block; the distinct values are compared block by block.
BLOCK = 2000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double arithmetic; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & masks.get(c, 0)
        row = (row + m) | (row - m)
    return (~row & full).bit_count()


def token_set_score(a: str | None, b: str | None) -> float:
    """0-100: similarity of two strings as sets of words, after common and differing words are put side by side."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    shared = " ".join(both)
    glue = 1 if both else 0
    la, lb = len(shared) + glue + len(only_a), len(shared) + glue + len(only_b)
    distance = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    best = 100.0 * (1 - distance / (la + lb))
    if both:
        best = max(best, 200.0 * len(shared) / (len(shared) + la), 200.0 * len(shared) / (len(shared) + lb))
    return best


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b)], dtype="float64")


def greedy_leaders(rows: list[dict], title: float = 80.0, company: float = 80.0, same_place: float = 90.0) -> list[int]:
    """Indexes of the leaders of a block in order of arrival: a row near a leader is a duplicate of it."""
    leaders: list[int] = []
    for i, r in enumerate(rows):
        for j in leaders:
            s = rows[j]
            t = token_set_score(r["title"], s["title"])
            if (t > title and token_set_score(r["company"], s["company"]) > company) or (t > same_place and r["location"] == s["location"]):
                break
        else:
            leaders.append(i)
    return leaders


def alike_candidates(x: list[str], y: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs whose token_set_score may be over `least`, and few others.

    Exact bounds: words in common make s characters of a string of l, 2 s / (s + l) is over the score only if s is over
    score / (2 - score) l; a common subsequence is no longer than the characters in common, letter by letter.
    """
    share = least / 100
    sets = [[set(v.split()) for v in side] for side in (x, y)]
    joined = [[" ".join(w) for w in side] for side in sets]
    length = [np.array([len(v) for v in side], dtype=np.float32) for side in joined]
    # The n-th occurrence of a character is a feature, so that a product counts the characters in common.
    column: dict[tuple[str, int], int] = {}
    cells: list[tuple[list[int], list[int]]] = []
    for side in joined:
        rows, columns = [], []
        for i, v in enumerate(side):
            seen: dict[str, int] = {}
            for c in v:
                n = seen[c] = seen.get(c, 0) + 1
                rows.append(i)
                columns.append(column.setdefault((c, n), len(column)))
        cells.append((rows, columns))
    letters = [np.zeros((len(side), max(1, len(column))), dtype=np.float32) for side in joined]
    for m, (rows, columns) in zip(letters, cells):
        m[rows, columns] = 1
    both = length[0][:, None] + length[1][None, :]
    found = letters[0] @ letters[1].T > share / 2 * both - 1e-3
    # Words fall into buckets; two words in one bucket only add candidates.
    buckets = 1024
    word: dict[str, int] = {}
    words = [np.zeros((len(side), buckets), dtype=np.float32) for side in sets]
    for k, side in enumerate(sets):
        for i, v in enumerate(side):
            for w in v:
                n = word.setdefault(w, len(word)) % buckets
                words[k][i, n] = words[k][i, n] + len(w) + 1 if k == 0 else 1
    found |= words[0] @ words[1].T - 1 > share / (2 - share) * np.minimum(length[0][:, None], length[1][None, :]) - 1e-3
    return np.nonzero(found)


def alike_values(values: DataFrame, least: float) -> DataFrame:
    """(v, w): all pairs of the distinct values v, each with itself too, that are more alike than `least`.

    Blocks of values are compared with each other, so that no pair is left out; the work is the square of the distinct values.
    """
    blocks = max(1, -(-values.count() // BLOCK))
    own = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    spread = values.select("v", own.alias("own"), F.explode(pairs).alias("p")).select("v", "own", "p.i", "p.j")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        i, j = int(df["i"].iloc[0]), int(df["j"].iloc[0])
        x, y = df["v"][df["own"] == i].tolist(), df["v"][df["own"] == j].tolist()
        out = []
        for a, b in zip(*(k.tolist() for k in alike_candidates(x, y, least))) if x and y else ():
            if (i < j or x[a] <= y[b]) and token_set_score(x[a], y[b]) > least:
                out.append((x[a], y[b]))
        return pd.DataFrame(out + [(b, a) for a, b in out if a != b], columns=["v", "w"], dtype="object")

    return spread.groupBy("i", "j").applyInPandas(compare, "v string, w string")


def _earlier(rows: DataFrame, title: float, same_place: float) -> DataFrame:
    """(id, key) of the judged rows that come after a judge near them in their group; only the different titles of one group are held.

    rows: group (c and a company, or p and a place), id, key, title, judged, judge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, least = None, {}, 0.0
        bits: dict[tuple[str, int], int] = {}
        forms: dict[str, tuple[int, int, set[str]]] = {}
        scores: dict[tuple[str, str], float] = {}

        def form(title: str) -> tuple[int, int, set[str]]:
            """The letters as bits (the n-th occurrence of each), their number, the words."""
            found = forms.get(title)
            if found is None:
                if len(forms) >= 100_000:
                    forms.clear()
                words = set(title.split())
                joined, mask, counts = " ".join(words), 0, {}
                for c in joined:
                    n = counts[c] = counts.get(c, 0) + 1
                    mask |= 1 << bits.setdefault((c, n), len(bits))
                found = forms[title] = (mask, len(joined), words)
            return found

        def near(name: str, titles: dict[str, tuple[int, int, set[str]]], least: float) -> bool:
            if name in titles:
                return True
            if not titles:
                return False
            mask, length, words = form(name)
            share = least / 100
            few, half = share / (2 - share), share / 2  # the bounds of alike_candidates
            for t, (m, n, w) in titles.items():
                letters = (mask & m).bit_count()
                if letters <= few * (length if length < n else n):
                    continue
                if letters <= half * (length + n):
                    shared = words & w
                    if not shared or sum(map(len, shared)) + len(shared) - 1 <= few * (length if length < n else n):
                        continue
                pair = (name, t) if name < t else (t, name)
                score = scores.get(pair)
                if score is None:
                    if len(scores) >= 1_000_000:
                        scores.clear()
                    score = scores[pair] = token_set_score(*pair)
                if score > least:
                    return True
            return False

        for batch in batches:
            out = []
            for g, id_, key, words, judged, judge in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    group, seen, least = g, {}, title if g[0] == "c" else same_place
                if judged and near(words, seen, least):
                    out.append((id_, key))
                if judge and words not in seen:
                    seen[words] = form(words)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["id", "key"])

    ordered = rows.select("group", "id", "key", "title", "judged", "judge").repartition("group").sortWithinPartitions("group", "id", "key")
    return ordered.mapInArrow(run, "id long, key long").distinct()


def fuzzy_dedup(df: DataFrame, id_col: str = "job_id", title: float = 80.0, company: float = 80.0, same_place: float = 90.0) -> DataFrame:
    """Leaders of near-identical postings, in order of id: what greedy_leaders gives over the whole table.

    Exact copies (title, company, place) are merged by a group first. A row near an earlier leader is a duplicate; near are
    rows of alike companies with alike titles, whatever their place, and rows of one place with nearly the same title.
    Rounds settle the order without one long loop: a row with no earlier open row near it leads, a row near a leader is
    dropped, the others wait. Rows meet in the groups of the companies alike to theirs, and in the group of their place.
    """
    text = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    distinct = df.select(F.col(id_col).cast("long").alias("id"), text("title").alias("title"), text("company").alias("company"), text("location").alias("location")).groupBy("title", "company", "location").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    rows = cut_lineage(distinct.withColumn("key", F.xxhash64("title", "company", "location")))
    alike = cut_lineage(alike_values(rows.where("company != ''").select(F.col("company").alias("v")).distinct(), company).where("v != w"))

    def groups(of: DataFrame, judged: bool, judge: bool) -> DataFrame:
        own = of.where("company != ''").select(F.concat(F.lit("c"), "company").alias("group"), "id", "key", "title").unionByName(of.select(F.concat(F.lit("p"), "location").alias("group"), "id", "key", "title"))
        return own.withColumns({"judged": F.lit(judged), "judge": F.lit(judge)})

    def as_judges(of: DataFrame) -> DataFrame:
        """In the groups of the other companies that are alike; the first row of a title is enough."""
        first = of.groupBy("company", "title").agg(F.min(F.struct("id", "key")).alias("x")).select(F.col("company").alias("w"), "title", "x.id", "x.key")
        return first.join(alike, "w").select(F.concat(F.lit("c"), "v").alias("group"), "id", "key", "title", F.lit(False).alias("judged"), F.lit(True).alias("judge"))

    def mark(of: DataFrame, met: DataFrame) -> DataFrame:
        met = met.select(F.col("id").alias("i"), F.col("key").alias("k"), F.lit(True).alias("met"))
        return cut_lineage(of.join(met, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").drop("i", "k"))

    done = [rows.where("title = ''").select("id", "copies")]  # a title without words is like no other
    open_rows = rows.where("title != ''")
    while not open_rows.isEmpty():
        marked = mark(open_rows, _earlier(groups(open_rows, True, True).unionByName(as_judges(open_rows)), title, same_place))
        leaders, waiting = marked.where("met is null").drop("met"), marked.where("met").drop("met")
        done.append(leaders.select("id", "copies"))
        near = _earlier(groups(waiting, True, False).unionByName(groups(leaders, False, True)).unionByName(as_judges(leaders)), title, same_place)
        open_rows = mark(waiting, near).where("met is null").drop("met")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("id", id_col)


def term_cosine(docs: DataFrame, profile: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id_col, score): cosine of log term frequencies of each text with a profile's, over the profile's words; one pass, no join."""
    counts: dict[str, int] = {}
    for w in profile:
        counts[w] = counts.get(w, 0) + 1
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t.isin(*counts))
    import math

    weight = {w: 1 + math.log(n) for w, n in sorted(counts.items())}
    size = math.sqrt(sum(v * v for v in weight.values()))
    count = lambda w: F.size(F.filter(F.col("_w"), lambda t: t == w))
    tf = [count(w) for w in weight]
    logged = [F.when(n > 0, 1 + F.log(n.cast("double"))).otherwise(F.lit(0.0)) for n in tf]
    dot = sum((x * v for x, v in zip(logged, weight.values())), F.lit(0.0))
    norm = F.sqrt(sum((x * x for x in logged), F.lit(0.0)))
    return docs.select(id_col, words.alias("_w")).select(id_col, F.when(norm == 0, F.lit(0.0)).otherwise(dot / (norm * size)).alias("score"))


#: Words that tell nothing, in English and German.
STOP_WORDS = tuple(
    "the and for with you your our are will have this that from their they who what when where which also not but all any can has its more than into about über und oder der die das den dem des ein eine einer eines einem einen mit für von auf aus bei nach "
    "zu zum zur im in an am ist sind wird werden wir sie ihr ihre ich du es er auch nicht als wie".split()
)


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.findall(r"[^\W_]{2,}", text.lower()) if w not in STOP_WORDS]


def ngrams(text: str, most: int = 3) -> dict[str, float]:
    """The 1- to 3-grams of a text without stop words, with their damped frequencies 1 + ln n."""
    import math

    words, counts = _words(text), {}
    for n in range(1, most + 1):
        for i in range(len(words) - n + 1):
            gram = " ".join(words[i : i + n])
            counts[gram] = counts.get(gram, 0) + 1
    return {g: 1 + math.log(c) for g, c in counts.items()}


def ngram_cosine(docs: DataFrame, profile: str, id_col: str, text_col: str) -> DataFrame:
    """(id_col, score): 150 x the cosine of each text with a profile over the profile's 1- to 3-grams, 100 at most; one pass, no join.

    Weights are damped frequencies; texts without any of the grams, null and empty ones have 0.
    """
    grams = ngrams(profile)
    keys = sorted(grams)
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))
    known = F.col("_w")
    pair = lambda i: F.concat_ws(" ", F.get(known, i), F.get(known, i + 1))
    triple = lambda i: F.concat_ws(" ", F.get(known, i), F.get(known, i + 1), F.get(known, i + 2))
    places = lambda short: F.when(F.size(known) > short, F.sequence(F.lit(0), F.size(known) - short - 1)).otherwise(F.array().cast("array<int>"))
    all_grams = F.filter(F.concat(known, F.transform(places(1), pair), F.transform(places(2), triple)), lambda g: g.isin(*keys))
    counted = [F.size(F.array_remove(F.col("_g"), k)) for k in keys]
    tf = [F.size("_g") - c for c in counted]
    logs = [F.when(n > 0, 1 + F.log(n.cast("double"))).otherwise(F.lit(0.0)) for n in tf]
    dot = sum((x * grams[k] for x, k in zip(logs, keys)), F.lit(0.0))
    norm = sum((x * x for x in logs), F.lit(0.0))
    size = sum(v * v for v in grams.values()) ** 0.5
    prepared = docs.select(id_col, w.alias("_w")).select(id_col, all_grams.alias("_g"))
    return prepared.select(id_col, F.when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), 150 * dot / (F.sqrt(norm) * size))).alias("score"))


def blend(a: Column, b: Column, share: float = 0.6) -> Column:
    """share x a + the rest x b; the one that there is where the other is null, 0 without both."""
    return F.when(a.isNotNull() & b.isNotNull(), share * a + (1 - share) * b).otherwise(F.coalesce(a, b, F.lit(0.0)))


def boosted(words: Column, times: int) -> Column:
    """The words of an array in a row, so many times."""
    return F.repeat(F.concat(F.array_join(words, " "), F.lit(" ")), times)


def hit_rate(terms: list[str], text: str, least: float = 75.0) -> float:
    """Per cent of the terms that are more alike than `least` to the text as sets of words."""
    return 100.0 * sum(token_set_score(t, text) > least for t in terms) / len(terms) if terms else 0.0
