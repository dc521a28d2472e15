"""Held-out test items inside a training corpus (problem 9).

Containment search with MinHash over size partitions: the queries are the items' windows of `run` words, each a set
of word shingles; the domains are the documents, where a document longer than the largest partition is cut into
overlapping stretches so that every window of `run` words lies whole in one of them. A window that is contained in a
domain of n shingles has the domain's minimum under a random permutation with probability (run - words + 1) / n, so
each size partition uses as many permutations as its upper bound needs for the chosen miss rate. A domain and an item
that share a minimum are a candidate pair, which the exact test on whole windows of `run` words then decides.

The items are a stated query set: they are taken in blocks of bounded size, each block is broadcast, and every document passes
it without a shuffle; a worker builds the index of a block once. The blocks of one pass together hold PASS_WORDS words at most;
more items are searched pass by pass, each of which is written and released before the next, so that what the driver and the
workers hold does not grow with the items.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.session import write_once

WORD = re.compile(r"[^\W_]+")
#: Upper bounds of the size partitions, in shingles.
SIZES = (8, 16, 32, 64)
#: Chance to miss a single contained window of exactly `run` words.
MISS = 1e-6
#: Words of items in one broadcast block, and in all blocks of one pass.
BLOCK_WORDS, PASS_WORDS = 500_000, 4_000_000
#: Indexes that a worker keeps.
KEPT = 4


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in folded case."""
    return WORD.findall(unicodedata.normalize("NFC", text).casefold()) if text else []


def permutations_for(size: int, contained: int, miss: float = MISS) -> int:
    """Permutations after which a contained window of `contained` shingles is missed with at most this chance."""
    share = min(1.0, contained / size)
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log1p(-share))


class Hasher:
    """64-bit hashes of words (remembered) and of shingles, the same on every machine."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, found: list[str]) -> np.ndarray:
        import xxhash

        known, out = self.known, []
        for word in found:
            h = known.get(word)
            if h is None:
                if len(known) > 300_000:
                    known.clear()
                h = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)

    @staticmethod
    def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        acc = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            acc = (acc ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        return acc


def multipliers(count: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def permuted(shingles: np.ndarray, by: np.uint64) -> np.ndarray:
    x = shingles * by
    return x ^ (x >> np.uint64(32))


class ItemIndex:
    """The minima of every item window under every permutation, sorted for search."""

    def __init__(self, items: list[tuple[int, str]], k: int, run: int, seed: int = 17):
        self.k, self.run = k, run
        self.contained = run - k + 1
        self.count = max(permutations_for(s, self.contained) for s in SIZES)
        self.by = multipliers(self.count, seed)
        hasher = Hasher()
        self.windows: dict[int, frozenset] = {}
        owners, minima = [], [[] for _ in range(self.count)]
        for item, text in items:
            w = words(text)
            if len(w) < run:
                continue
            self.windows[item] = frozenset(tuple(w[i : i + run]) for i in range(len(w) - run + 1)) | self.windows.get(item, frozenset())
            view = np.lib.stride_tricks.sliding_window_view(hasher.shingles(hasher.words(w), k), self.contained)
            owners.append(np.full(len(view), item, dtype=np.int64))
            for p in range(self.count):
                minima[p].append(permuted(view, self.by[p]).min(axis=1))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        if owners:
            owner = np.concatenate(owners)
            for p in range(self.count):
                values = np.concatenate(minima[p])
                rows = np.unique(np.rec.fromarrays([values, owner], names="v,o"))
                self.tables.append((np.ascontiguousarray(rows.v), np.ascontiguousarray(rows.o)))

    def matches(self, texts: list[str | None]) -> set[tuple[int, int]]:
        """(index of the text, item) of every text that holds `run` consecutive words of an item."""
        if not self.tables:
            return set()
        k, run, hasher = self.k, self.run, Hasher() if not hasattr(self, "hasher") else self.hasher
        self.hasher = hasher
        largest = SIZES[-1]
        parts: dict[int, list] = {s: [] for s in SIZES}
        where: dict[int, list] = {s: [] for s in SIZES}
        known = []
        for row, text in enumerate(texts):
            w = words(text)
            known.append(w)
            if len(w) < run:
                continue
            shingles = hasher.shingles(hasher.words(w), k)
            start = 0
            while True:
                part = shingles[start : start + largest]
                size = next(s for s in SIZES if s >= len(part))
                if len(part) < size:
                    part = np.concatenate([part, np.full(size - len(part), part[-1], dtype=np.uint64)])
                parts[size].append(part)
                where[size].append((row, start))
                if start + largest >= len(shingles):
                    break
                start += largest - self.contained + 1
        candidates = set()
        for size in SIZES:
            if not parts[size]:
                continue
            matrix = np.stack(parts[size])
            at = where[size]
            for p in range(permutations_for(size, self.contained)):
                minima = permuted(matrix, self.by[p]).min(axis=1)
                values, owner = self.tables[p]
                low = np.searchsorted(values, minima, "left")
                for i in np.nonzero(values[np.minimum(low, len(values) - 1)] == minima)[0]:
                    j = low[i]
                    while j < len(values) and values[j] == minima[i]:
                        candidates.add((*at[i], int(owner[j])))
                        j += 1
        found = set()
        span = largest + k - 1
        for row, start, item in candidates:
            if (row, item) in found:
                continue
            w, own = known[row][start : start + span], self.windows[item]
            if any(tuple(w[i : i + run]) in own for i in range(len(w) - run + 1)):
                found.add((row, item))
        return found


_indexes: dict[tuple, ItemIndex] = {}


def index_of(name: str, block: list[tuple[int, str]], k: int, run: int) -> ItemIndex:
    """The index of a block, built once by each worker process."""
    at = (name, k, run)
    found = _indexes.get(at)
    if found is None:
        while len(_indexes) >= KEPT:
            _indexes.pop(next(iter(_indexes)))
        found = _indexes[at] = ItemIndex(block, k, run)
    return found


def blocks_of(items: DataFrame, item_col: str, text_col: str, words_each: int) -> Iterator[list[tuple[int, str]]]:
    """The items with text in blocks of so many words, or of one item that is longer; one partition of them is fetched at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").toLocalIterator():
        block.append((row.i, row.t))
        size += row.t.count(" ") + 1
        if size >= words_each:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "item_text", run: int = 12, shingle: int = 5, block_words: int = BLOCK_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """Distinct (id_col, item_col): the document holds at least `run` consecutive words of the item.

    Items of fewer than `run` words, null and empty texts match nothing; items that repeat text all match; very long
    texts are searched whole; null ids are kept as null; with no items the result is empty.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def searched(blocks: list[list[tuple[int, str]]]) -> tuple[DataFrame, list]:
        shared = [(uuid4().hex, context.broadcast(b)) for b in blocks]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    found = {(ids[row], item) for name, block in shared for row, item in index_of(name, block.value, shingle, run).matches(texts)}
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["id", "item"])

        return source.mapInArrow(search, "id long, item long"), [b for _, b in shared]

    done: list[DataFrame] = []
    waiting: list[list[tuple[int, str]]] = []
    per_pass = max(1, pass_words // block_words)
    for block in blocks_of(items, item_col, item_text_col, block_words):
        if len(waiting) == per_pass:
            found, sent = searched(waiting)
            done.append(write_once(found))
            for b in sent:
                b.destroy()
            waiting = []
        waiting.append(block)
    done.append(searched(waiting)[0])
    kind = items.schema[item_col].dataType
    return reduce(DataFrame.union, done).distinct().select(F.col("id").alias(id_col), F.col("item").cast(kind).alias(item_col))


def leak_report(leaks: DataFrame, items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Every item with the number of documents that hold it, 0 included."""
    counts = leaks.groupBy(item_col).agg(F.count("*").alias("documents"))
    return items.select(item_col).distinct().join(counts, item_col, "left").select(item_col, F.coalesce("documents", F.lit(0)).alias("documents"))
