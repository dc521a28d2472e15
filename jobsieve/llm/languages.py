"""Languages of documents and of their mixed-language stretches (problem 2).

Hyperdimensional profiles: every letter has a random vector of +1 and -1; an n-gram's vector is the product of its letters'
vectors, each permuted by its place; a text's vector is the sum of its n-grams' vectors. A language's prototype bundles
the n-grams of its training texts; weighted so that what all languages share cancels. Documents and
sentences take the language whose prototype has the greatest cosine. As the cosine's numerator is a sum over n-grams, each
word's share is computed once per worker and added up, which gives the same numbers as adding the vectors first.

The prototypes are trained from a bounded sample of labelled rows; wrong labels are washed out by assigning the sample's
sentences to the prototypes and bundling again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.boilerplate import FURNITURE, page_styles

LANGUAGES = ("de", "en", "fr", "es", "nl", "it")
DIMENSIONS, GRAMS = 8192, (3, 4, 5, 6)
#: N-grams bundled into a prototype: those that tell the language best from the others; fewer keep the bundle's noise low. A
#: parameter of the model, like DIMENSIONS: rows are compared by all their n-grams.
BUNDLED = 4000
#: Labelled rows that the prototypes are trained from, and rounds of assigning and bundling again.
SAMPLE_ROWS, ROUNDS = 3000, 1
#: A sentence counts with so many words at least, and if its language leads the text's main one by so much cosine.
LEAST_WORDS, LEAD = 4, 0.04
#: A sentence of so many words whose best cosine is below this is in none of the languages.
OTHER_WORDS, OTHER_COSINE = 8, 0.025
WORD = re.compile(r"[^\W\d_]+")
UNIT = re.compile(r"(?<=[.!?…])\s+")
_NAMES = {
    "de": "de deu ger german deutsch allemand alemán aleman duits tedesco gsw", "en": "en eng english englisch anglais inglés ingles engels inglese", "fr": "fr fra fre french französisch franzoesisch français francais francés frances frans francese",
    "es": "es spa spanish spanisch espagnol español espanol spaans spagnolo castellano", "nl": "nl nld dut dutch niederländisch niederlaendisch néerlandais neerlandais neerlandés nederlands olandese vls", "it": "it ita italian italienisch italien italiano italiaans",
}
LABELS = {name: code for code, names in _NAMES.items() for name in names.split()}


def label_language(label: Column) -> Column:
    """The language that a label means, null for null, empty, other and meaningless labels."""
    head = F.element_at(F.split(F.lower(F.trim(label)), r"[-_\s(/,;]"), 1)
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(F.length(F.trim(label)) > 0, F.try_element_at(known, head))


class Profiles:
    """Letter vectors and language prototypes."""

    def __init__(self, prototypes: np.ndarray | None = None, seed: int = 11):
        self.seed = seed
        self.letters: dict[tuple[str, int], np.ndarray] = {}
        self.prototypes = prototypes
        self.words: dict[str, int] = {}
        self.rows = np.zeros((0, len(LANGUAGES) + 1), dtype=np.float32)
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(LANGUAGES) + 1), dtype=np.float32)
        self.grams: dict[str, np.ndarray] = {}

    def letter(self, c: str, place: int) -> np.ndarray:
        """A letter's vector, permuted by its place from the end of an n-gram."""
        v = self.letters.get((c, place))
        if v is None:
            base = np.random.default_rng([self.seed, ord(c)]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
            v = self.letters[c, place] = np.roll(base.astype(np.int8), place)
        return v

    def gram(self, g: str) -> np.ndarray:
        last = len(g) - 1
        v = self.letter(g[0], last).copy()
        for i in range(1, len(g)):
            v *= self.letter(g[i], last - i)
        return v

    @staticmethod
    def grams_of(word: str) -> list[str]:
        padded = f" {word} "
        grams = [padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)]
        return grams if grams and len(padded) in GRAMS else [*grams, padded]

    def bundle(self, counts: list[Counter]) -> None:
        """Prototypes from the n-gram counts of each language.

        Counts are brought to equal totals and damped, and what an n-gram weighs in all languages alike is taken off; each
        prototype bundles the n-grams with the greatest weights.
        """
        totals = [max(1, sum(c.values())) for c in counts]
        grams = sorted(set().union(*counts))
        weights = np.log1p(np.array([[c[g] * 1e5 / t for c, t in zip(counts, totals)] for g in grams], dtype=np.float64).reshape(len(grams), len(counts)))
        weights -= weights.mean(axis=1, keepdims=True)
        rows = np.zeros((len(counts), DIMENSIONS), dtype=np.float64)
        chosen = [set(np.argsort(-np.abs(weights[:, k]), kind="stable")[:BUNDLED].tolist()) for k in range(len(counts))]
        for i in sorted(set().union(*chosen)):
            v = self.gram(grams[i])
            for k in range(len(counts)):
                if i in chosen[k]:
                    rows[k] += weights[i, k] * v
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        self.prototypes = (rows / np.where(norms > 0, norms, 1.0)).astype(np.float32)
        self.words, self.rows, self.grams, self.known = {}, np.zeros((0, len(LANGUAGES) + 1), dtype=np.float32), {}, {}

    def word_row(self, word: str) -> int:
        row = self.words.get(word)
        if row is None:
            total = np.zeros(len(LANGUAGES) + 1, dtype=np.float32)
            for g in self.grams_of(word):
                s = self.grams.get(g)
                if s is None:
                    if len(self.grams) >= 200_000:
                        self.grams = {}
                    s = self.grams[g] = self.prototypes @ self.gram(g).astype(np.float32)
                total[:-1] += s
                total[-1] += 1
            row = self.words[word] = len(self.words)
            if row >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)]) if len(self.rows) else np.zeros((4096, len(LANGUAGES) + 1), dtype=np.float32)
            self.rows[row] = total
        return row

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cosines with the prototypes, number of words) of every text, from the sums over its n-grams.

        Texts that come again, like headings and list entries, are remembered.
        """
        known, fresh = self.known, []
        if len(known) > 100_000:
            known.clear()
        for text in texts:
            if text not in known:
                known[text] = len(known)
                fresh.append(text)
        if fresh:
            first = len(known) - len(fresh)
            if len(known) > len(self.values):
                grown = np.zeros((max(4096, 2 * len(known)), len(LANGUAGES) + 1), dtype=np.float32)
                grown[:first] = self.values[:first]
                self.values = grown
            if len(self.words) > 300_000:
                self.words, self.rows = {}, np.zeros((0, len(LANGUAGES) + 1), dtype=np.float32)
            ids: list[int] = []
            sizes, starts = [], []
            words, word_row = self.words, self.word_row
            for text in fresh:
                found = WORD.findall(text.lower())
                starts.append(len(ids))
                sizes.append(len(found))
                for w in found:
                    i = words.get(w)
                    ids.append(word_row(w) if i is None else i)
            sums = np.zeros((len(fresh), len(LANGUAGES) + 1), dtype=np.float32)
            full = [i for i, n in enumerate(sizes) if n]
            if full:
                sums[full] = np.add.reduceat(self.rows[ids], [starts[i] for i in full], axis=0)
            self.values[first : first + len(fresh), :-1] = sums[:, :-1] / np.sqrt(DIMENSIONS * np.maximum(1.0, sums[:, -1:]))
            self.values[first : first + len(fresh), -1] = sizes
        rows = self.values[[known[t] for t in texts]] if texts else np.zeros((0, len(LANGUAGES) + 1), dtype=np.float32)
        return rows[:, :-1], rows[:, -1].astype(np.int32)


def sentences(text: str) -> list[str]:
    """The sentences of a text's own lines, without site lines and tags."""
    lines = text.split("\n")
    out = []
    for line, style in zip(lines, page_styles(lines)):
        if style and style not in FURNITURE:
            if "<" in line:
                line = re.sub(r"<[^<>]*>", " ", line)
            out += [x for x in UNIT.split(line.strip(" \t*•-–·")) if x]
    return out


def plain_title(title: str) -> str:
    """A title without markers and remarks in brackets."""
    text = re.sub(r"[(\[{][^()\[\]{}]*[)\]}]", " ", title)
    text = re.sub(r"(?i)\b(?:m|w|f|d|x|h|v|gn)(?:\s*[/|*:]\s*(?:m|w|f|d|x|h|v|div|gn|\*)){1,3}\b", " ", text)
    return text if WORD.search(text) else title


def train(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> np.ndarray:
    """Prototypes from (label, text) rows; rows of other labels are ignored."""
    units = [(LANGUAGES.index(label), s) for label, text in rows if label in LANGUAGES for s in sentences(text or "") if len(WORD.findall(s)) >= LEAST_WORDS - 1]
    profiles = Profiles()
    assigned = [k for k, _ in units]
    words = [WORD.findall(s.lower()) for _, s in units]
    for step in range(rounds + 1):
        counts = [Counter() for _ in LANGUAGES]
        for k, own in zip(assigned, words):
            counts[k].update(own)
        grams = [Counter() for _ in LANGUAGES]
        for c, own in zip(grams, counts):
            for w, n in own.items():
                for g in Profiles.grams_of(w):
                    c[g] += n
        profiles.bundle(grams)
        if step < rounds:
            cosines, _ = profiles.cosines([s for _, s in units])
            assigned = cosines.argmax(axis=1).tolist()
    return profiles.prototypes


def describe(profiles: Profiles, text: str) -> list[tuple[str, float]]:
    """(language, confidence) of every language in which a whole sentence of the text is written, the main one first."""
    return judge(*profiles.cosines(sentences(text)))


def judge(cosines: np.ndarray, sizes: np.ndarray) -> list[tuple[str, float]]:
    """The languages of a text from its sentences' cosines and numbers of words.

    The main language is that of most words; others need a sentence that is clearly theirs. Sentences in none of the
    languages count for "other".
    """
    if not sizes.any():
        return []
    foreign = (sizes >= OTHER_WORDS) & (cosines.max(axis=1) < OTHER_COSINE)
    if foreign.any():
        rest = judge(cosines[~foreign], sizes[~foreign]) if sizes[~foreign].max(initial=0) >= LEAST_WORDS else []
        return [*rest, ("other", _other_confidence(cosines[foreign]))]
    best = cosines.argmax(axis=1)
    long = sizes >= LEAST_WORDS
    if not long.any():
        votes = (cosines * np.sqrt(sizes)[:, None]).sum(axis=0)
        long = sizes > 0
    else:
        votes = np.bincount(best, weights=sizes * long, minlength=len(LANGUAGES))
    main = int(votes.argmax())
    found = {main: _confidence(cosines[long], main)}
    other = best != main
    if other.any():
        for i in np.nonzero(other & (sizes >= LEAST_WORDS))[0]:
            k = int(best[i])
            if cosines[i, k] - cosines[i, main] >= LEAD:
                found[k] = max(found.get(k, 0.0), _confidence(cosines[i : i + 1], k))
    return [(LANGUAGES[k], round(c, 4)) for k, c in found.items()]


def _confidence(cosines: np.ndarray, k: int) -> float:
    """A softmax over the mean cosines, sharpened to the spread that sentences show."""
    x = cosines.sum(axis=0).tolist()
    scale = 40 / len(cosines)
    top = max(x)
    e = [math.exp((v - top) * scale) for v in x]
    return e[k] / sum(e)


def _other_confidence(cosines: np.ndarray) -> float:
    """1 where nothing is alike, 0.5 at the limit."""
    return round(1 - 0.5 * max(0.0, float(cosines.max(axis=1).mean())) / OTHER_COSINE, 4)


def segments(profiles: Profiles, text: str) -> list[tuple[int, str, str, float]]:
    """(number, language, text, confidence): the stretches of a text in one language."""
    units = sentences(text)
    if not units:
        return []
    spoken = describe(profiles, text)
    if not spoken:
        return []
    allowed = [LANGUAGES.index(x) for x, _ in spoken if x != "other"]
    cosines, sizes = profiles.cosines(units)
    out: list[list] = []
    for unit, row, size in zip(units, cosines, sizes):
        k = -1 if not allowed or size >= OTHER_WORDS and row.max() < OTHER_COSINE else max(allowed, key=lambda a: row[a])
        if out and (size < LEAST_WORDS or out[-1][1] == k):
            out[-1][2].append(unit)
            out[-1][3].append(row)
        else:
            out.append([len(out) + 1, k, [unit], [row]])
    return [(no, LANGUAGES[k] if k >= 0 else "other", " ".join(parts), round(_confidence(np.array(rows), k), 4) if k >= 0 else _other_confidence(np.array(rows))) for no, k, parts, rows in out]


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, title_col: str, text_col: str, label_col: str, limit: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A sample of labelled rows, spread by a hash of the id, of at most `limit` rows."""
    meant = labels.select(F.col(id_col).alias("id"), label_language(F.col(label_col)).alias("lang")).where("lang is not null").groupBy("id").agg(F.min("lang").alias("lang"))
    chosen = meant.orderBy(F.xxhash64("id"), "id").limit(limit)
    return [(r.lang, r.text) for r in df.select(F.col(id_col).alias("id"), F.concat_ws("\n", title_col, title_col, title_col, text_col).alias("text")).join(F.broadcast(chosen), "id").select("lang", "text").limit(limit).collect()]


def field_languages(df: DataFrame, prototypes: np.ndarray, id_col: str = "job_id", title_col: str = "title", text_col: str = "description") -> DataFrame:
    """(id_col, field_name, lang, confidence): the languages of every non-blank field."""
    shared = df.sparkSession.sparkContext.broadcast(prototypes)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for batch in batches:
            ids, titles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            named = [i for i, t in enumerate(titles) if t and t.strip()]
            cosines, sizes = profiles.cosines([plain_title(titles[i]) for i in named])
            for i, row, size in zip(named, cosines, sizes):
                if size:
                    k = int(row.argmax())
                    out.append((ids[i], "title", LANGUAGES[k], round(_confidence(row[None, :], k), 4)))
            flat, spans = [], []
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                if text and not text.isspace():
                    units = sentences(text)
                    spans.append((ids[i], len(flat), len(flat) + len(units)))
                    flat += units
            cosines, sizes = profiles.cosines(flat)
            for id_, a, b in spans:
                out += [(id_, "description", lang, c) for lang, c in judge(cosines[a:b], sizes[a:b])]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64()))], ["id", "field_name", "lang", "confidence"])

    return source.mapInArrow(run, "id long, field_name string, lang string, confidence double").withColumnRenamed("id", id_col)


def text_segments(df: DataFrame, prototypes: np.ndarray, id_col: str = "job_id", text_col: str = "description") -> DataFrame:
    """(id_col, segment_no, lang, segment, confidence): every stretch of every text in one language."""
    shared = df.sparkSession.sparkContext.broadcast(prototypes)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for batch in batches:
            out = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text and text.strip():
                    out += [(id_, *x) for x in segments(profiles, text)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()))], ["id", "segment_no", "lang", "segment", "confidence"])

    return source.mapInArrow(run, "id long, segment_no int, lang string, segment string, confidence double").withColumnRenamed("id", id_col)


def find_wrong_labels(df: DataFrame, labels: DataFrame, id_col: str = "job_id", title_col: str = "title", text_col: str = "description", label_col: str = "lang", prototypes: np.ndarray | None = None) -> DataFrame:
    """Distinct (id_col, field_name, lang, confidence): the languages of the fields whose label is missing or not exactly theirs.

    A record without a label that means one of the six languages is a case, as is one whose labels differ from the
    field's languages. Null and blank fields, texts without letters and texts in other languages alone are no cases; repeated rows and labels count once;
    with no labels at all every field is a case by prototypes passed in (without any, there is nothing to train from).
    """
    if prototypes is None:
        rows = training_rows(df, labels, id_col, title_col, text_col, label_col)
        prototypes = train(rows)
    found = field_languages(df, prototypes, id_col, title_col, text_col).where("lang <> 'other'").groupBy(id_col, "field_name").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.max_by("confidence", "confidence").alias("confidence"), F.collect_set(F.struct("lang", "confidence")).alias("parts"))
    meant = labels.select(F.col(id_col), label_language(F.col(label_col)).alias("label")).where("label is not null").groupBy(id_col).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    joined = found.join(meant, id_col, "left").where("labels is null or labels <> langs")
    return joined.select(id_col, "field_name", F.explode("parts").alias("p")).select(id_col, "field_name", "p.lang", "p.confidence").distinct()
