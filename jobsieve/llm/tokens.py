"""Byte-level BPE of whole corpora with a public vocabulary (problem 8).

Text is split by the vocabulary's pattern; each pre-token is merged with a rank queue: a bucket per merge rank
holds the linked-list positions whose pair has that rank, a bitmap of three levels with 64 bits a word marks the
buckets in use, and find-first-set on it gives the next rank. A position whose pair has changed since it was
queued is stale and skipped. The work per pre-token of n bytes is O(n log n), so a pre-token of a megabyte is
encoded as well as a word.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text before the merges of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker remembers this many pre-tokens of at most so many characters; beyond, it starts afresh (memory, not results).
CACHED, CACHED_CHARS = 200_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def load_ranks(raw: bytes) -> dict[bytes, int]:
    ranks = {}
    for line in raw.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class RankQueue:
    """Buckets of positions by rank, with a hierarchical bitmap over the buckets."""

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def first(self) -> int:
        """The lowest rank in use, -1 if none."""
        top = self.top
        if not top:
            return -1
        high = (top & -top).bit_length() - 1
        bits = self.mid[high]
        word = (high << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        return (word << 6) | ((bits & -bits).bit_length() - 1)

    def pop(self, rank: int) -> int:
        """The leftmost position of the rank's bucket."""
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word = rank >> 6
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[word >> 6] &= ~(1 << (word & 63))
                if not self.mid[word >> 6]:
                    self.top &= ~(1 << (word >> 6))
        return position


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks, queue, n = self.ranks, self.queue, len(piece)
        if n == 1:
            return [ranks[piece]]
        after = list(range(1, n + 1))  # end of the token that begins here, which is where the next one begins
        before = list(range(-1, n - 1))
        pair = [-1] * n
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2], -1)
            if rank >= 0:
                pair[i] = rank
                queue.push(rank, i)
        while (rank := queue.first()) >= 0:
            i = queue.pop(rank)
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                new = ranks.get(piece[i : after[k]], -1)
                pair[i] = new
                if new >= 0:
                    queue.push(new, i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                new = ranks.get(piece[left:k], -1)
                if new != pair[left]:
                    pair[left] = new
                    if new >= 0:
                        queue.push(new, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.known, []
        for token in self.split(text):
            found = known.get(token)
            if found is None:
                found = self.merge(token.encode("utf-8", "replace"))
                if len(token) <= CACHED_CHARS:
                    if len(known) >= CACHED:
                        known.clear()
                    known[token] = found
            ids += found
        return ids


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids): the token ids of every text, without special tokens.

    Null and empty texts both give an empty list; strings that look like special tokens are ordinary text; repeated
    rows and null ids are kept as they are; other columns are ignored. No shuffle: one pass over the two columns. The
    vocabulary (under 1 MB, a fixed public file) is read on the driver and broadcast.
    """
    with open(vocabulary or vocabulary_path(), "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BytePairEncoder(load_ranks(raw.value))
        for batch in batches:
            offsets, values = [0], []
            for text in batch.column(1):
                values += encoder.encode(text.as_py())
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return source.mapInArrow(encode, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)
