import random

from jobsieve.llm.contamination import SIZES, find_leaks, leak_report, permutations_for, words


def brute(docs, items, run=12):
    index = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - run + 1):
            index.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in index.get(tuple(w[k : k + run]), ())}
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30, 60])))) for i in range(40)]
    docs = []
    for d in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 8, 40, 300, 2000]))]
        if rng.random() < 0.6:
            source = items[rng.randrange(40)][1].split()
            n = min(len(source), rng.choice([11, 12, 13, 25]))
            start = rng.randrange(len(source) - n + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = source[start : start + n]
        docs.append((d, rng.choice([" ", ", ", " *", "\n"]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    docs += [(9001, None), (9002, ""), (9003, docs[0][1]), (9003, docs[0][1])]
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, item_text string"), block_words=300).collect()}
    expected = brute(docs, items)
    assert got == expected and len(expected) > 50
    several = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, item_text string"), block_words=200, pass_words=400)
    assert {(r.doc_id, r.item_id) for r in several.collect()} == expected  # pass by pass


def test_edges_and_report(spark):
    docs = spark.createDataFrame([(1, "ß " + " ".join(f"w{i}" for i in range(12)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(12))), (2, "short item"), (3, None)], "item_id int, item_text string")
    leaks = find_leaks(docs, items)
    assert [tuple(r) for r in leaks.collect()] == [(1, 1)]
    assert {r.item_id: r.documents for r in leak_report(leaks, items).collect()} == {1: 1, 2: 0, 3: 0}
    assert find_leaks(docs.where("false"), items).count() == 0 and find_leaks(docs, items.where("false")).count() == 0


def test_permutations_reach_the_wanted_recall():
    for size in SIZES:
        b = permutations_for(size, 8, 1e-6)
        assert size <= 8 and b == 1 or (1 - 8 / size) ** b <= 1e-6
