"""Variant spellings of organisations and persons as typed by people (problem 3).

Distinct spellings are parsed into forms: markup and wrappers removed, legal forms and titles dropped, merged and hyphenated
words split, abbreviations noted. Spellings of one form are one from there on. Words a typing slip apart are met in their
deletion neighbourhoods, which is exact; very long ones by MinHash banding over padded 3-grams, with as many bands as the
collision curve asks for at the least similar pair that is accepted for words of that length. Two forms mean one employer
only if every word of the shorter has a counterpart in the longer, so that it is enough to look for the word of each that
reaches fewest forms: frequent words need no limit. Texts mean the same if no word is left over on either side. Monge-Elkan similarity over all words verifies a pair: words match when equal, a
slip apart, abbreviated, or a pet form, and at least one such word must carry identity, which words do that keep company.
Star clustering - the form with most links becomes a centre and takes its neighbours - links the variants that never match
directly.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.session import cut_lineage, write_once

#: A word carries identity if this share of its forms, COMPANY_PRIOR more taken for granted, have the same second word or
#: none. Names of employers keep such company; trades, sectors and first names stand beside ever other words.
COMPANY, COMPANY_PRIOR = 0.3, 3
#: The length from which two slips are accepted, and from which words are banded; shorter ones meet in their deletion
#: neighbourhoods. Words of few syllables have too much in common for bands: with two rows nearly all words met nearly all.
LONG, BANDED = 9, 18
#: Chance to find a pair of banded words with the most slips accepted, and rows of a band.
RECALL, ROWS = 0.97, 6
#: A string of more words is a text and no name: it means the same as another only if no word is left over on either side.
NAME_WORDS = 60
#: Least mean similarity of the shorter spelling's words to their best counterparts.
ALIKE = 0.85

LEGAL = re.compile(
    r"(?<![\w.])(?:g\.?\s?m\.?\s?b\.?\s?h\.?\s*(?:&|und|u\.|\+|and)?\s*co\.?\s*k\.?g\.?(?:aa)?|ges\.?\s?m\.?b\.?h\.?|gesellschaft mit beschränkter haftung|g\.\s?m\.\s?b\.\s?h\.?|gmbh|ggmbh|mbh|aktiengesellschaft|a\.\s?g\.|ag|kommanditgesellschaft|k\.\s?g\.|kg|ohg|gbr|ug(?: \(haftungsbeschränkt\))?|e\.\s?k\.|e\.\s?v\.|"
    r"s\.\s?e\.|se|s\.\s?a\.\s?s\.|sas|sarl|s\.\s?à\.?\s?r\.\s?l\.|s\.\s?a\.|sa|s\.\s?l\.|s\.\s?r\.\s?l\.|srl|s\.\s?p\.\s?a\.|spa|b\.\s?v\.|bv|n\.\s?v\.|nv|limited|ltd\.?|l\.\s?l\.\s?c\.|llc|incorporated|inc\.?|corporation|corp\.?|plc|(?:&|und|u\.|and)\s*co\.?|& cie\.?)(?![\w])",
    re.I,
)
DROPPED = set("fa firma inh inhaber inhaberin inhaber: dr prof dipl ing med dent mag via und and et & the der die das herr frau".split())
NOBODY = re.compile(
    r"(?i)^\W*(?:web|internet|online|k\.? ?a\.?|n\.? ?[av]\.?|n/a|none|null|unknown|unbekannt|inconnue?|desconocid[oa]|onbekend|sconosciut[oa]|confidential|vertraulich|confidentiel(?:le)?|confidencial|vertrouwelijk|riservat[oa]|anonym(?:ous|er?)?(?: (?:employer|arbeitgeber|company|firma|unternehmen))?|employeur anonyme|empresa (?:anónima|confidencial)|"
    r"(?:diverse|verschiedene|various|div\.) ?(?:arbeitgeber|firmen|unternehmen|employers|companies)?|keine angabe|ohne angabe|o\.? ?a\.?|siehe (?:anzeige|beschreibung|text)|see (?:ad|description)|private(?:r)? (?:employer|anbieter|arbeitgeber)|privat|company|firma|employer|arbeitgeber|unternehmen|not (?:specified|disclosed|available)|tbd|tba|-+|\?+|x+|\.+)?\W*$"
)
#: Pet forms of first names, each with the names it stands for.
PET = {
    pet: set(names.split())
    for pet, names in (
        line.split(":")
        for line in (
            "alex:alexander alexandra;sascha:alexander;andi:andreas andrea;babsi:barbara;becky:rebekka rebecca;bekki:rebekka;benni:benjamin;ben:benjamin;basti:sebastian;bastian:sebastian;christl:christina christine;chris:christian christina christoph;tina:christina martina bettina;dani:daniel daniela;danny:daniel;doro:dorothea;dora:dorothea;"
            "elli:elisabeth;lisa:elisabeth;liesl:elisabeth;sissi:elisabeth;betty:elisabeth;franzi:franziska;fritz:friedrich;freddy:friedrich;gabi:gabriele;schorsch:georg;jörg:georg;gitti:brigitte;birgit:brigitte;brigitta:brigitte;grete:margarete;gretel:margarete;gretl:margarete;greta:margarete;heiner:heinrich;heinz:heinrich;hein:heinrich;harry:heinrich;hannes:johannes;hans:johannes;johann:johannes;jo:johannes josephine;"
            "jenny:jennifer;jen:jennifer;josi:josephine;josie:josephine;fine:josephine;kathi:katharina;kati:katharina;käthe:katharina;katja:katharina;leo:leonhard leonard;lenny:leonhard;manni:manfred;fred:manfred;max:maximilian;maxi:maximilian;matze:matthias;matti:matthias;michi:michael michaela;mike:michael;michel:michael;micha:michael;niko:nikolaus;nico:nikolaus;klaus:nikolaus;phil:philipp;lipp:philipp;"
            "rob:robert;bob:robert;bobby:robert;robbie:robert;sam:samuel;sammy:samuel;steffi:stefanie stephanie;susi:susanne;sanne:susanne;resi:theresia;theres:theresia;thea:dorothea;tom:thomas;tommy:thomas;uli:ulrike ulrich;ulli:ulrike;vroni:veronika;vera:veronika;willi:wilhelm;willy:wilhelm;bill:william;will:william;wim:wilhelm;sepp:josef;toni:anton antonia;steffen:stefan;"
            "liz:elizabeth;kate:katherine catherine;jim:james;joe:joseph;jack:john;dick:richard;rick:richard;peggy:margaret;meg:margaret;nick:nicholas;tony:anthony;andy:andrew andreas;pepe:josé;paco:francisco;lola:dolores;stb:steuerkanzlei steuerberatung steuerberater"
        ).split(";")
    )
}
_CAMEL = re.compile(r"(?<=[a-zß-ÿ]{4})(?=[A-ZÀ-Ý][a-zß-ÿ]{3})")


def fold(text: str) -> str:
    text = text.lower().replace("ß", "ss")  # an umlaut written as two letters is within a slip of the plain one
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def parse(name: str) -> list[tuple[str, bool]]:
    """(word, abbreviated by a point or hyphen) of a spelling, without legal forms, titles and wrappers; [] if it names nobody."""
    text = " ".join(html.unescape(unicodedata.normalize("NFC", name)).split())
    if NOBODY.match(text):
        return []
    if m := re.fullmatch(r"\(?\s*(?:via|über|through|powered by)\s+(.*?)\s*\)?", text, re.I):
        text = m[1]
    text = _CAMEL.sub(" ", text)
    text = LEGAL.sub(" ", text)
    words: list[tuple[str, bool]] = []
    for chunk in re.split(r"[\s,;/()|\"„“]+", text):
        pieces = [p for p in chunk.split("-") if p.strip(".&+'’ ")]
        if len(pieces) > 1 and all(len(p) >= 4 and not p.endswith(".") for p in pieces):
            parts = pieces
        elif pieces:
            parts = ["".join(pieces)] if len(pieces) > 1 else pieces
        else:
            continue
        for p in parts:
            short = "." in p or (len(pieces) > 1 and len(parts) == 1)
            word = re.sub(r"[^\w]", "", fold(p))
            if word and word not in DROPPED:
                words.append((word, short))
    return words


Word = tuple[str, bool, bool]


def slips(a: str, b: str, most: int = 2) -> int:
    """Edits with swaps of neighbours between two words; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def abbreviates(a: str, b: str) -> bool:
    if len(a) >= len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def likeness(a: tuple, b: tuple) -> float:
    """Similarity of two words."""
    x, y = a[0], b[0]
    if x == y:
        return 1.0
    if y in PET.get(x, ()) or x in PET.get(y, ()):
        return 0.95
    if (a[1] and abbreviates(x, y)) or (b[1] and abbreviates(y, x)):
        return 0.92
    if min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x)) and abs(len(x) - len(y)) >= 3:
        return 0.86
    n = min(len(x), len(y))
    if n >= 4:
        d = slips(x, y, 2)
        if d == 1:
            return 0.94
        if d == 2 and n >= 9:
            return 0.88
    return 0.0


def _merged(a: list[Word], b: list[Word]) -> list[Word]:
    """a with neighbours put together where b has them written as one word."""
    if len(a) < 2:
        return a
    long = [y[0] for y in b if len(y[0]) >= 8]
    out, i = [], 0
    while i < len(a):
        both = a[i][0] + a[i + 1][0] if i + 1 < len(a) else ""
        if both and min(len(a[i][0]), len(a[i + 1][0])) >= 4 and any(abs(len(y) - len(both)) <= 1 and slips(y, both, 1) <= 1 for y in long):
            out.append((both, False, True))
            i += 2
        else:
            out.append(a[i])
            i += 1
    return out


def same(a: list[Word], b: list[Word]) -> float:
    """Monge-Elkan similarity of two forms of (word, written in short, carries identity), 0 if they are two employers."""
    if not a or not b:
        return 0.0
    a, b = _merged(a, b), _merged(b, a)
    if len(a) > len(b):
        a, b = b, a
    pairs = sorted(((likeness(x, y), -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a: dict[int, float] = {}
    used_b: set[int] = set()
    strong, alike = False, 0
    for s, _, i, j in pairs:
        if s <= 0:
            break
        if i in used_a or j in used_b:
            continue
        used_a[i] = s
        used_b.add(j)
        least = min(len(a[i][0]), len(b[j][0]))
        if s >= 0.88 and s != 0.92 and (least >= 4 or (least == 3 and s == 1.0)):
            alike += 1
            strong = strong or a[i][2] or b[j][2]
    # Two words that carry no identity by themselves do so together if no word is left on either side.
    if len(used_a) < len(a) or not (strong or (alike >= 2 and len(a) == len(b))):
        return 0.0
    return sum(used_a.values()) / len(used_a)


def same_text(a: list[Word], b: list[Word]) -> bool:
    """Whether every word of each of two texts has a counterpart in the other: equal words first, then those that are left."""
    common = Counter(w[0] for w in a) & Counter(w[0] for w in b)

    def left(words: list[Word]) -> list[Word]:
        taken, rest = common.copy(), []
        for w in words:
            if taken[w[0]] > 0:
                taken[w[0]] -= 1
            else:
                rest.append(w)
        return rest

    a, b = left(a), left(b)
    a, b = _merged(a, b), _merged(b, a)
    if len(a) != len(b) or not all(any(likeness(x, y) > 0 for y in b) for x in a):
        return False
    pairs = sorted(((likeness(x, y), -abs(i - j), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    used_a, used_b, alike = set(), set(), any(len(w) >= 3 for w in common)
    for s, _, i, j in pairs:
        if s > 0 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            alike = alike or (s >= 0.88 and s != 0.92)
    return alike and len(used_a) == len(a)


def least_similarity(length: int, grams: int = 3) -> float:
    """Jaccard similarity of the padded q-grams of two words of this length with two letters changed, the least alike pair accepted."""
    own = length + grams - 1
    return (own - 2 * grams) / (own + 2 * grams)


def bands_for(similarity: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of `rows` rows so that a pair of this similarity collides with at least this chance: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def signature_bands(words: list[str], rows: int = ROWS, seed: int = 5) -> list[np.ndarray]:
    """The band keys of each word: as many as a word one letter shorter needs, since a pair meets in the bands that both have."""
    import xxhash

    needed = [bands_for(least_similarity(max(BANDED, len(w) - 1))) for w in words]
    most = max(needed, default=0)
    rng = np.random.default_rng(seed)
    top = bands_for(least_similarity(BANDED))
    by = rng.integers(1, 2**63, size=top * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mix = rng.integers(1, 2**63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    by = by[: most * rows]
    out = []
    for word, bands in zip(words, needed):
        padded = f"##{word}##"
        grams = np.array(list({xxhash.xxh64_intdigest(padded[i : i + 3].encode()) for i in range(len(padded) - 2)}), dtype=np.uint64)
        x = grams[None, :] * by[: bands * rows, None]
        x ^= x >> np.uint64(31)
        x = (x.min(axis=1).reshape(bands, rows) * mix).sum(axis=1, dtype=np.uint64)
        out.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return out


def deletions(word: str, twice: bool = False) -> set[str]:
    """The word and the word without each of its letters, or without any two: words as many slips apart share one of these."""
    once = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
    return once | {w[:i] + w[i + 1 :] for w in once if len(w) < len(word) for i in range(len(w))} if twice else once


def word_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct words w a typing slip apart, two from LONG letters on."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            own = batch.column(0).to_pylist()
            bands, keys, of = [], [], []
            for w in own:
                if len(w) < BANDED + 2:  # a word up to two letters longer than the others may still be slips away from one
                    found = {xxhash.xxh64_intdigest(d.encode()) - 2**63 for d in deletions(w, len(w) >= LONG)}
                    keys += found
                    bands += [-1] * len(found)
                    of += [w] * len(found)
            long = [w for w in own if len(w) >= BANDED]
            for w, found in zip(long, signature_bands(long)):
                keys += found.tolist()
                bands += range(len(found))
                of += [w] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int32()), pa.array(keys, pa.int64()), pa.array(of, pa.string())], ["band", "key", "w"])

    banded = write_once(words.select("w").mapInArrow(run, "band int, key long, w string"))
    near = F.levenshtein("w", "v", 2)
    swapped = F.array_sort(F.split("w", "")) == F.array_sort(F.split("v", ""))
    longer = F.least(F.length("w"), F.length("v")) >= LONG
    met = banded.join(banded.withColumnRenamed("w", "v"), ["band", "key"]).where("w < v")
    met = met.where((near == 1) | ((near == 2) & (longer | swapped)))
    return met.select(F.col("w").alias("a"), F.col("v").alias("b")).distinct()


def _parsed(df: DataFrame, name_col: str) -> DataFrame:
    """(name, form) of every distinct spelling that names somebody; a form is its words in order, with a point after those written in short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            forms = [" ".join(w + ("." if short else "") for w, short in parse(n)) for n in names]
            keep = [i for i, f in enumerate(forms) if f]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.string()), pa.array([forms[i] for i in keep], pa.string())], ["name", "form"])

    distinct = df.select(F.col(name_col).cast("string").alias("name")).where("name is not null").distinct()
    return distinct.mapInArrow(run, "name string, form string")


def known_words(forms: DataFrame) -> DataFrame:
    """(k, n, identity) of every whole word of the forms (form, ws): on how many forms it stands and whether it carries identity."""
    rows = forms.select(F.explode("ws").alias("k"), "ws").select("k", F.array_except("ws", F.array("k")).alias("others"))
    beside = rows.select("k", F.explode(F.when(F.size("others") == 0, F.array(F.lit(""))).otherwise(F.col("others"))).alias("v")).groupBy("k", "v").agg(F.count("*").alias("c"))
    most = lambda alone: F.coalesce(F.max(F.when((F.col("v") == "") == F.lit(alone), F.col("c"))), F.lit(0))
    together = beside.groupBy("k").agg((most(True) + most(False)).alias("together"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    return counts.join(together, "k").select("k", "n", (F.col("together") + COMPANY_PRIOR >= COMPANY * (F.col("n") + COMPANY_PRIOR)).alias("identity"))


def candidate_pairs(forms: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of forms, identity marked by *, of which every word of one may have a counterpart in the other."""
    forms = write_once(forms.select("form", F.array_distinct(F.filter(F.split("form", " "), lambda w: ~w.endswith(".") & (F.length(w) >= 3))).alias("ws")))
    vocabulary = write_once(known_words(forms))
    pairs = word_pairs(vocabulary.select(F.col("k").alias("w")).where("length(k) >= 4"))
    links = write_once(pairs.select(F.col("a").alias("k"), F.col("b").alias("l")).unionByName(pairs.select(F.col("b").alias("k"), F.col("a").alias("l"))))
    # A word reaches the forms that it stands on and those of the words a slip away.
    near = links.join(vocabulary.select(F.col("k").alias("l"), "n"), "l").groupBy("k").agg(F.sum("n").alias("near"))
    reaching = vocabulary.join(near, "k", "left").select("k", "identity", (F.col("n") + F.coalesce("near", F.lit(0))).alias("reach"))
    carrying = forms.select("form", F.explode("ws").alias("k")).join(reaching, "k")
    per_form = carrying.groupBy("form").agg(F.collect_list(F.struct("reach", "k", "identity")).alias("x"))
    marked = F.filter("x", lambda s: s["identity"])["k"]
    coded = F.array_join(F.transform(F.split("form", " "), lambda w: F.when(F.array_contains(marked, w), F.concat(w, F.lit("*"))).otherwise(w)), " ")
    ranked = write_once(per_form.select(coded.alias("form"), F.transform(F.array_sort("x"), lambda s: s["k"]).alias("ws"), marked.alias("own"), F.split("form", " ").alias("all")))
    bare = lambda w: F.rtrim(w, F.lit("."))
    whole = F.filter("all", lambda w: ~w.endswith(".") & (F.length(w) >= 4))
    joined = F.array_compact(F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda w, i: F.when((F.length(w) >= 4) & (F.length(F.get("all", i)) >= 4), F.concat(bare(F.get("all", i)), bare(w)))))
    pets = F.create_map(*[x for pet, names in sorted(PET.items()) for x in (F.lit(pet), F.array(*[F.lit(n) for n in sorted(names)]))])
    formal = lambda words: F.flatten(F.array_compact(F.transform(words, lambda w: pets[w])))
    # Every form can be found by any of its words,
    # two neighbours written together (+) included, ...
    plus = lambda words: F.transform(words, lambda w: F.concat(F.lit("+"), w))
    index = ranked.select("form", F.explode(F.array_distinct(F.concat("ws", plus(joined), formal(F.col("ws"))))).alias("k"))
    # ... and looks for others by the one that reaches fewest, up to a slip.
    rarest = ranked.select("form", F.col("ws")[0].alias("k"))
    together = rarest.select("form", F.concat(F.lit("+"), "k").alias("k"))
    looks = rarest.unionByName(together).unionByName(rarest.join(links, "k").select("form", F.col("l").alias("k")))
    looks = looks.unionByName(ranked.select("form", F.explode(F.concat(joined, formal(F.slice("ws", 1, 1)))).alias("k")))
    # Where that word has an abbreviation for counterpart, another word is met together with its first letters: one that
    # carries identity, up to a slip or pet form (~) of which either word may carry it, ...
    start = lambda w, n: F.substring(w, F.lit(1), F.lit(n))
    short = F.transform(F.filter("all", lambda w: w.endswith(".") | (F.length(w) <= 3)), lambda w: F.concat(start(w, 1), F.lit(".")))
    first, others = F.col("ws")[0], F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0)))
    starts = F.array(F.concat(start(first, 1), F.lit(".")), start(first, 4))
    us = F.array_distinct(F.concat(short, F.transform(whole, lambda w: start(w, 4))))
    pet_pairs = sorted({(x, y) for pet, names in PET.items() for n in names for x, y in ((pet, n), (n, pet))})
    kin = links.unionByName(links.sparkSession.createDataFrame(pet_pairs, "k string, l string"))
    keyed = lambda rows: rows.select("form", "w", F.explode("us").alias("u")).select("form", F.concat_ws(" ", "w", "u").alias("k"))
    tilde = lambda w: F.concat(F.lit("~"), w)
    apart = F.filter("us", lambda u: u != start(F.col("w"), 4))
    known = ranked.select("form", F.explode("own").alias("w"), us.alias("us")).select("form", "w", apart.alias("us"))
    pair_index = ranked.select("form", F.explode(F.array_distinct(F.concat("ws", joined))).alias("w"), us.alias("us")).select("form", "w", apart.alias("us"))
    pair_index = keyed(pair_index.unionByName(known.join(kin, known.w == kin.k).select("form", tilde(F.col("l")).alias("w"), "us")))
    carried, rest = F.array_intersect(others, F.col("own")), F.array_except(others, F.col("own"))
    looking = ranked.where("size(ws) > 1")
    own_looks = looking.select("form", F.explode(carried).alias("w"), starts.alias("us"))
    pair_looks = own_looks.unionByName(looking.select("form", F.explode(F.concat(joined, F.transform(rest, tilde))).alias("w"), starts.alias("us")))
    pair_looks = keyed(pair_looks.unionByName(own_looks.join(kin, own_looks.w == kin.k).select("form", F.col("l").alias("w"), "us")))
    # ... or, if those of two forms without further words do not carry it, with what the two have of each other's rarest word.
    plain = F.array_except(F.transform(F.filter("all", lambda w: F.length(bare(w)) >= 3), bare), F.concat("own", F.array(first)))
    crossed = looking.where(F.size(plain) > 1).select("form", F.explode(rest).alias("w"), starts.alias("ss"), F.array_except(us, F.array(start(first, 4))).alias("us"))
    crossed = crossed.select("form", "w", F.explode("ss").alias("s"), apart.alias("us")).select("form", "w", "s", F.explode("us").alias("u"))
    cross_index, cross_looks = (crossed.select("form", F.concat_ws(" ", F.lit("="), "w", *x).alias("k")) for x in (("u", "s"), ("s", "u")))
    index, looks = index.unionByName(pair_index).unionByName(cross_index), looks.unionByName(pair_looks).unionByName(cross_looks)
    met = looks.withColumnRenamed("form", "a").join(index.withColumnRenamed("form", "b"), "k").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def text_pairs(forms: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of forms, one a text of more than NAME_WORDS words, that share a word or what one may have for counterpart."""
    # Neighbours written together count half, so that a name of half the words may be a counterpart.
    texts = forms.where(F.size(F.split("form", " ")) > NAME_WORDS // 2)
    bare = lambda w: F.rtrim(w, F.lit("."))
    start = lambda w, n: F.substring(w, F.lit(1), F.lit(n))
    texts = texts.select("form", F.split("form", " ").alias("all"))
    joined = F.transform(F.slice("all", 2, F.size("all") - 1), lambda w, i: F.concat(bare(F.get("all", i)), bare(w)))
    # Every text can be found by its words, neighbours written together, beginnings and abbreviations, ...
    texts = write_once(texts.select("form", "all", F.transform("all", bare).alias("ws"), joined.alias("joined"), F.filter("all", lambda w: ~w.endswith(".") & (F.length(w) >= 4)).alias("whole")))
    pets = F.create_map(*[x for pet, names in sorted(PET.items()) for x in (F.lit(pet), F.array(*[F.lit(n) for n in sorted(names)]))])
    formal = lambda words: F.flatten(F.array_compact(F.transform(words, lambda w: pets[w])))
    short = F.transform(F.filter("all", lambda w: w.endswith(".") | (F.length(w) <= 3)), lambda w: F.concat(start(w, 1), F.lit(".")))
    begun = F.transform(F.filter("ws", lambda w: F.length(w) >= 4), lambda w: F.concat(start(w, 4), F.lit("-")))
    words = write_once(texts.select("form", F.explode(F.array_distinct(F.concat("ws", "joined"))).alias("k")))
    index = words.unionByName(texts.select("form", F.explode(F.array_distinct(F.concat(formal(F.col("ws")), short, begun, F.array(F.lit("^"))))).alias("k")))
    # ... and looks for others by the whole word that stands in fewest; one without such a word is compared with all texts.
    counts = words.groupBy("k").agg(F.count("*").alias("n"))
    rarest = texts.select("form", F.explode("whole").alias("k")).join(counts, "k").groupBy("form").agg(F.min(F.struct("n", "k"))["k"].alias("r"))
    seen = write_once(texts.join(rarest, "form", "left"))
    own = F.array_compact(F.transform("joined", lambda w, i: F.when((F.get("ws", i) == F.col("r")) | (F.get("ws", i + 1) == F.col("r")), w)))
    ways = write_once(seen.select("form", F.explode(F.array_distinct(F.concat(F.array(F.coalesce("r", F.lit("^"))), own))).alias("k")))
    pairs = word_pairs(words.select(F.col("k").alias("w")).where("length(k) >= 4").distinct())
    links = pairs.select(F.col("a").alias("k"), F.col("b").alias("l")).unionByName(pairs.select(F.col("b").alias("k"), F.col("a").alias("l")))
    more = F.concat(formal(F.array("r")), F.array(F.concat(start("r", 1), F.lit(".")), F.concat(start("r", 4), F.lit("-"))))
    looks = ways.unionByName(ways.join(links, "k").select("form", F.col("l").alias("k"))).unionByName(seen.where("r is not null").select("form", F.explode(more).alias("k")))
    met = looks.withColumnRenamed("form", "a").join(index.withColumnRenamed("form", "b"), "k").where("a <> b")
    met = met.where(F.greatest(F.size(F.split("a", " ")), F.size(F.split("b", " "))) > NAME_WORDS)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def decoded(form: str) -> list[Word]:
    return [((bare := w.rstrip(".*")), w.endswith(".") or len(bare) <= 3, w.endswith("*")) for w in form.split(" ")]


def verified_links(forms: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(a, b), a < b: pairs of forms that mean the same employer by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}

        def words(form: str) -> list:
            found = known.get(form)
            if found is None:
                if len(known) > 100_000:
                    known.clear()
                found = known[form] = decoded(form)
            return found

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text = [max(len(words(a[i])), len(words(b[i]))) > NAME_WORDS for i in range(len(a))]
            keep = [i for i in range(len(a)) if (same_text(words(a[i]), words(b[i])) if text[i] else same(words(a[i]), words(b[i])) >= alike)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i].replace("*", "") for i in keep], pa.string()), pa.array([b[i].replace("*", "") for i in keep], pa.string())], ["a", "b"])

    # Forms without a whole word can still be equal word for word, in any order.
    same_words = forms.select("form", F.array_join(F.array_sort(F.transform(F.split("form", " "), lambda w: F.rtrim(w, F.lit(".")))), " ").alias("key"))
    first = same_words.groupBy("key").agg(F.min("form").alias("a"))
    equal = same_words.join(first, "key").where("form > a").select("a", F.col("form").alias("b"))
    names = forms.where(F.size(F.split("form", " ")) <= NAME_WORDS)
    met = candidate_pairs(names).unionByName(text_pairs(forms))
    return met.mapInArrow(run, "a string, b string").unionByName(equal).distinct()


def star_clusters(links: DataFrame) -> DataFrame:
    """(name, centre): the spelling with most links becomes a centre and takes its free neighbours, again and again.

    Each round settles every spelling that leads its free neighbourhood, so the rounds needed grow with the length of a
    chain of ever better linked neighbours, not with the number of spellings. The best linked free spelling always leads,
    so that it ends when all are settled.
    """
    edges = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = edges.groupBy("a").agg(F.count("*").alias("d"))
    free = cut_lineage(edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b"))
    settled = None
    while True:
        lead = free.groupBy("a").agg(F.max(F.struct("d", "a")).alias("own"), F.max(F.struct(F.col("e").alias("d"), F.col("b").alias("a"))).alias("best"))
        centres = lead.where("own > best").select(F.col("a").alias("centre"))
        taken = free.join(centres, free.b == centres.centre, "left_semi").groupBy("a").agg(F.max(F.struct("e", "b"))["b"].alias("centre"))
        now = cut_lineage(centres.select(F.col("centre").alias("name"), "centre").unionByName(taken.select(F.col("a").alias("name"), "centre")))
        settled = now if settled is None else settled.unionByName(now)
        gone = now.select("name")
        free = cut_lineage(free.join(gone.withColumnRenamed("name", "a"), "a", "left_anti").join(gone.withColumnRenamed("name", "b"), "b", "left_anti").select("a", "b", "d", "e"))
        if free.isEmpty():
            break
    return settled


def link_names(df: DataFrame, name_col: str = "company") -> DataFrame:
    """(name, centre) of every spelling that has a variant, centres included; a centre is the first spelling of its form.

    Null and blank strings and strings that name nobody are in no cluster; repeated rows count once; very long strings
    are taken whole, those of more than NAME_WORDS words together with others of which no word is left over; an empty table
    gives an empty result.
    """
    names = write_once(_parsed(df, name_col))
    clusters = star_clusters(verified_links(names.select("form").distinct()))
    settled = write_once(names.join(clusters.select(F.col("name").alias("form"), F.col("centre").alias("middle")), "form", "left").select("name", "form", F.coalesce("middle", "form").alias("middle")))
    centres = settled.groupBy("middle").agg(F.min(F.when(F.col("form") == F.col("middle"), F.col("name"))).alias("centre"), F.count("*").alias("n")).where("n > 1")
    return settled.join(centres, "middle").select("name", "centre")


def variant_pairs(df: DataFrame, name_col: str = "company") -> DataFrame:
    """(company_a, company_b): pairs of different spellings of one employer, smaller by code points first."""
    clusters = write_once(link_names(df, name_col))
    a, b = clusters.select("centre", F.col("name").alias("company_a")), clusters.select("centre", F.col("name").alias("company_b"))
    return a.join(b, "centre").where("company_a < company_b").select("company_a", "company_b").distinct()
