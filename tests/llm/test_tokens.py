import base64
import random

import pytest
from pyspark.sql import functions as F

from jobsieve.llm.tokens import BytePairEncoder, RankQueue, encode_corpus, load_ranks, vocabulary_path


@pytest.fixture(scope="module")
def raw():
    with open(vocabulary_path(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(raw):
    import tiktoken

    from jobsieve.llm.tokens import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_gives_lowest_rank_and_leftmost_position():
    rng = random.Random(2)
    queue, model = RankQueue(50_256), []
    for _ in range(3000):
        if model and rng.random() < 0.45:
            rank = queue.first()
            assert (rank, queue.pop(rank)) == model.pop(model.index(min(model)))
        else:
            model.append((rng.choice([rng.randrange(50_256), rng.randrange(70)]), rng.randrange(10_000)))
            queue.push(*model[-1])
    assert (queue.first() == -1) == (not model)


def test_same_ids_as_another_encoder(raw, reference):
    encoder = BytePairEncoder(load_ranks(raw))
    rng = random.Random(4)
    texts = ["", "a", "Straße für Köln\n\n  x", "<|endoftext|> ok", "日本語 и русский 🙂🙂", "a" * 5000, "ab" * 3000, "x" * 20_001, "".join(rng.choice("abcdefgh") for _ in range(30_000)), " \t \n", "don't we'll I'D", "0" * 999]
    texts += ["".join(rng.choice("aäßéñ 中.\n'sT1") for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert reference.decode(ids) == text


def test_corpus_edges(spark, reference):
    df = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(9))
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()), key=str)
    hello = reference.encode_ordinary("Hello world")
    assert got == sorted([(1, hello), (1, hello), (2, []), (3, []), (None, reference.encode_ordinary("x"))], key=str)
    assert encode_corpus(df.where("false")).count() == 0
