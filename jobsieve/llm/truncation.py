"""Texts cut off by field limits or in mid-transfer (problem 1).

One pass reads every text with a stack automaton: markup elements opened in the whole text, brackets and quotation marks of
its last line by their kinds, a tag, entity, escape or multibyte sequence broken off, a mark that a cut left behind ("...",
"[read more]"). The same pass counts which word triples end a unit (a sentence with its mark, or a line with another after
it) anywhere in the corpus. Two baselines then decide the texts whose end is neither whole nor visibly broken:

* the source's field limit: lengths (in characters or bytes, without the mark) at which the source's unfinished texts
  pile up beyond chance;
* completeness: whether the last words end a unit elsewhere, stand in a slot that is filled with ever new names, or
  close a good part of all units that begin as this one (closing lines that always stand last; cuts fall anywhere).
  An end of three words or fewer may be a piece of a beginning, so it is held against all units that begin with its
  characters, and it must be whole words there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.boilerplate import FURNITURE, page_styles, style
from jobsieve.session import cut_lineage

WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
#: Brackets and quotation marks; each closing mark with those it can close.
MARK = re.compile(r"[(\[{„“«‹)\]}»›”\"]")
CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "›": "‹", "”": "“„", "“": "„"}
OPENS = "([{„“«‹"
DIGITS = re.compile(r"\d+")
UNIT = re.compile(r"(?<=[.!?…:])\s+")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr", "source"}
#: Elements whose end tag may be left out.
OPTIONAL = {"li", "p", "td", "tr", "th", "dt", "dd", "option", "tbody", "thead"}
#: A character reference, an escape (also the first half of a surrogate pair), a percent code or a multibyte sequence that is
#: broken off; bytes read in the wrong code page show as the beginnings Ã, Â, â€, â‚ and ðŸ without their last character.
BROKEN = re.compile(r"(?:&(?:[a-zA-Z]{1,8}|#\d{0,6}|#x[\da-fA-F]{0,5})?|\\(?:u[\da-fA-F]{0,3}|ud[89abAB][\da-fA-F]{2}|x[\da-fA-F]?)?|%[\da-fA-F]?|�+|[ÃÂ]|â[€‚]|ðŸ.?)$")
#: A tag or comment that is begun, however long it is by then.
BROKEN_TAG = re.compile(r"<(?:/?[a-zA-Z][^\s<>]*(?:\s|$)|/?$|!)")
CLOSING_TAG = re.compile(r"</?[a-zA-Z][^<>]*>$")
MORE = re.compile(r"(?i)[\[(]?\s*(?:leggi tutto|leggi di più|continua a leggere|read more|show more|see more|continue reading|mehr lesen|weiterlesen|mehr anzeigen|mehr erfahren|lire la suite|voir plus|leer más|ver más|seguir leyendo|lees meer|lees verder|meer tonen|truncated|gekürzt|more)\s*[\])]?$|\[(?:\.{2,}|…|\+\d+ \w+)\]$")
DOTS = re.compile(r"(\s*)(?:\.{2,}|…+)$")
WHOLE, DOTTED, OPEN, CUT = 0, 1, 2, 3
#: A limit's pile reaches from its longest text this many characters or bytes down (cuts at a word boundary).
PILE_WIDTH = 8
#: A pile holds this share of the source's unfinished texts (different ends) at least, and so many.
PILE_SHARE, PILE_LEAST = 0.15, 6
#: Open ends that close this share of the units with the same beginning, in so many different texts, are whole.
CLOSING_SHARE, CLOSING_LEAST = 0.02, 3
#: A context of two words is a slot for names if at least so many different words end a unit after it.
SLOT_WORDS = 25


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - 2**63


def open_marks(line: str) -> bool:
    """Stack automaton over brackets and quotation marks: whether one is open at the end of a line.

    A closing mark takes its own kind from the stack, and what was opened inside with it; without its kind it says nothing (a
    list marked a), b), ...). A straight quotation mark opens where none is open and blank, bracket or nothing is before it.
    """
    stack: list[str] = []
    for m in MARK.finditer(line):
        c = m[0]
        if c == '"':
            before = line[m.start() - 1] if m.start() else " "
            if '"' in stack:
                del stack[stack.index('"') :]
            elif before.isspace() or before in "([{:":
                stack.append(c)
        elif c == "“" and "„" not in stack or c in OPENS and c != "“":
            stack.append(c)
        else:
            at = len(stack) - 1
            while at >= 0 and stack[at] not in CLOSES[c]:
                at -= 1
            if at >= 0:
                del stack[at:]
    return bool(stack)


def open_structure(text: str) -> bool:
    """Whether an element of the text, or a bracket or quotation mark of its last line, is still open at the end."""
    stack: list[str] = []
    closes = False
    for m in TAG.finditer(text) if "<" in text else ():
        name = m[2].lower()
        if name in VOID or m[3]:
            continue
        if not m[1]:
            stack.append(name)
        else:
            closes = closes or name in OPTIONAL
            while stack and stack.pop() != name:
                pass
    if any(name not in OPTIONAL or closes for name in stack):
        return True
    return open_marks(text[text.rfind("\n") + 1 :])


def last_words(unit: str, n: int) -> list[str]:
    """The last n words of a unit."""
    found = WORD.findall(" ".join(unit.rsplit(None, n + 3)[-(n + 3) :]))
    return found[-n:] if len(found) >= n else WORD.findall(unit)[-n:]


def key_words(unit: str) -> tuple[str, str, str]:
    """The last three words of a unit, in lower case with digits folded, filled up with ^ in front."""
    w = [DIGITS.sub("9", x) if x[-1].isdigit() or DIGITS.search(x) else x for x in (y.lower() for y in last_words(unit, 3))]
    if len(w) >= 3:
        return w[-3], w[-2], w[-1]
    return ("^", "^", "") if not w else ("^", "^", w[0]) if len(w) == 1 else ("^", w[0], w[1])


def examine(text: str) -> tuple[int, str]:
    """(status, text without the mark of a cut): whole, trailing off in dots, open or visibly cut."""
    end = text.rstrip()
    line = end[end.rfind("\n") + 1 :]
    before = end[: len(end) - len(line)]
    if line[-1:].isalpha() or line[-1:] in "])…":
        if (m := _more(line)) and (m[0].startswith("[") or re.search(r"[\[(…]|\.\.", line[max(0, m.start() - 3) :])):
            return CUT, re.sub(r"\s*(?:\.{2,}|…+)$", "", before + line[: m.start()].rstrip())
    tag = end.rfind("<")
    if tag > end.rfind(">") and BROKEN_TAG.match(end, tag) or BROKEN.search(end, max(0, len(end) - 12)):  # none of these is longer
        return CUT, end
    closed = end
    while closed.endswith(">") and (m := CLOSING_TAG.search(closed, closed.rfind("<"))) and m.start():
        closed = closed[: m.start()].rstrip()
    if closed.endswith(("..", "…")) and (m := DOTS.search(closed, len(closed.rstrip(".… \t")))) and not closed.endswith("[…]"):
        core = closed[: m.start()]
        return (CUT if m[1] or open_structure(core if closed == end else end) else DOTTED), core
    if open_structure(end):
        return CUT, end
    return (WHOLE if closed[-1:] in '.!?»”"“' and closed else OPEN), end


def _more(line: str) -> re.Match | None:
    """A mark such as "read more" at the end of a line; none is as long as 40 characters."""
    return MORE.search(line, max(0, len(line) - 40))


def start_words(unit: str) -> str:
    head = " ".join(unit.lower().split(None, 3)[:3])
    return DIGITS.sub("9", head) if DIGITS.search(head) else head


def ends_in_furniture(text: str) -> bool:
    """Whether the last line belongs to the site; as much of the page is looked at as the style of that line depends on."""
    lines = text.rstrip().split("\n")
    at = len(lines) - 1
    while at > 0 and style(lines[at]) in ("maybe_teaser", "teaser", "label", "about") and lines[at].strip():
        at -= 1
    styles = page_styles(lines[max(0, at - 1) :])
    return styles[-1] in FURNITURE


def _units(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        if "<" in line:
            line = re.sub(r"<[^<>]*>", " ", line)
        line = line.strip()
        if line:
            yield from UNIT.split(line)


def scan(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows (kind 0: id, source, status, chars, bytes, triple, context, start, head, text, name_like), unit ends (kind 1: triple, context, n) and unit beginnings (kind 2: start, head, n).

    start is the hash of head, a beginning of three words at most; rows have head only where their last unit has no more words. text is a hash of the text.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    fields = [("kind", pa.int8()), ("id", pa.int64()), ("source", pa.string()), ("status", pa.int8()), ("chars", pa.int32()), ("bytes", pa.int32()), ("triple", pa.int64()), ("context", pa.int64()), ("start", pa.int64()), ("head", pa.string()), ("text", pa.int64()), ("name_like", pa.bool_()), ("n", pa.int64())]
    schema = "kind byte, id long, source string, status byte, chars int, bytes int, triple long, context long, start long, head string, text long, name_like boolean, n long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: Counter = Counter()
        starts: Counter = Counter()

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

        def flush() -> pa.RecordBatch:
            rows = []
            for (a, b, c), n in ends.items():
                rows.append((1, None, None, None, None, None, _hash(f"{a} {b} {c}"), _hash(f"{a} {b}"), None, None, None, None, n))
            rows += [(2, None, None, None, None, None, None, None, _hash(x), x, None, None, n) for x, n in starts.items()]
            ends.clear()
            starts.clear()
            return emit(rows)

        known: dict[str, tuple] = {}

        def keys(unit: str) -> tuple:
            found = known.get(unit)
            if found is None:
                if len(known) >= 100_000:
                    known.clear()
                found = known[unit] = (key_words(unit), start_words(unit))
            return found

        for batch in batches:
            rows = []
            for id_, src, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                if not text or text.isspace():
                    continue
                units = list(_units(text))
                if not units:
                    continue
                for unit in units[:-1]:
                    triple, start = keys(unit)
                    ends[triple] += 1
                    starts[start] += 1
                status, core = examine(text)
                if status == OPEN and ends_in_furniture(text):
                    status = WHOLE  # the page ends with a line of its site, so that the posting above it is complete
                last = units[-1]
                if status == DOTTED:
                    last = DOTS.sub("", last)
                a, b, c = key_words(last)
                start = start_words(last)
                starts[start] += 1
                if status == WHOLE:
                    ends[a, b, c] += 1
                found = last_words(core, 1)
                name_like = bool(found) and len(found[-1]) >= 4 and (found[-1][0].isupper() or found[-1].isdigit())
                rows.append((0, id_, src, status, len(core), len(core.encode("utf-8", "replace")), _hash(f"{a} {b} {c}"), _hash(f"{a} {b}"), _hash(start), start if len(last.split()) <= 3 else None, _hash(text), name_like, None))
            yield emit(rows)
            if len(ends) > 200_000:
                yield flush()
        yield flush()

    return source.mapInArrow(search, schema)


def field_limits(rows: DataFrame) -> DataFrame:
    """(source, measure, size, n): the lengths at which a source's unfinished texts pile up under its field limit."""
    from pyspark.sql import Window as W

    measures = F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("size")))
    # Copies of one text count once, else a posting that is ingested again and again would look like a limit.
    ends = rows.where(F.col("status") != WHOLE).groupBy("source", "chars", "bytes", "triple").agg(F.lit(1).alias("one"))
    by_size = ends.select("source", F.explode(measures).alias("x")).groupBy("source", "x.measure", "x.size").agg(F.count("*").alias("n"))
    group = W.partitionBy("source", "measure")  # one row per source, measure and length: bounded by the lengths of texts
    sized = by_size.withColumn("piled", F.sum("n").over(group.orderBy("size").rangeBetween(-PILE_WIDTH, 0))).withColumn("unfinished", F.sum("n").over(group))
    top = (
        sized.where(F.col("piled") >= F.greatest(F.lit(PILE_LEAST), PILE_SHARE * F.col("unfinished")))
        .groupBy("source", "measure").agg(F.max_by("size", F.struct("piled", "size")).alias("limit"), F.max("piled").alias("piled"))
    )
    return (
        by_size.join(top, ["source", "measure"]).where((F.abs(F.col("size") - F.col("limit")) <= PILE_WIDTH) & (F.col("n") >= F.greatest(F.lit(2), 0.03 * F.col("piled"))))
        .select("source", "measure", "size", "n")
    )


def closing_lines(undecided: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, triple, closing): open ends that are closing lines. starts: (start, head, begun).

    The share is one of all units with the same beginning, so that it stays as it is when the corpus grows; copies of a
    text are one text.
    """
    ends = undecided.groupBy("start", "head", "triple").agg(F.count("*").alias("closed"), F.countDistinct("text").alias("texts")).where(F.col("texts") >= CLOSING_LEAST)
    long = ends.where("head is null").join(starts.select("start", "begun"), "start")
    short = ends.where("head is not null")
    pieces = F.transform(F.sequence(F.lit(1), F.length("head")), lambda i: F.struct(F.substring("head", F.lit(1), i).alias("head"), F.substring("head", i + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]").alias("inside")))
    begun = (
        starts.where("head != ''").select(F.explode(pieces).alias("p"), "begun").groupBy("p.head", "p.inside").agg(F.sum("begun").alias("n"))
        .join(short.select("head").distinct(), "head", "left_semi").groupBy("head").agg(F.sum("n").alias("begun"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("inside"))
    )
    words = short.join(begun, "head").where(F.col("inside") < 0.5 * F.col("begun"))
    columns = ["start", "triple", "closed", "begun"]
    return long.select(columns).unionByName(words.select(columns)).where(F.col("closed") >= CLOSING_SHARE * F.col("begun")).select("start", "triple", F.lit(True).alias("closing")).distinct()


def find_truncated(df: DataFrame, id_col: str = "job_id", text_col: str = "description", source_col: str = "source") -> DataFrame:
    """Distinct ids of the texts that stop inside a word or before their last sentence or list entry is complete.

    Null and blank texts are no cases; a null source has a baseline of its own; very long texts are read whole;
    repeated rows give one id; null ids come out as null.
    """
    scanned = cut_lineage(scan(df, id_col, text_col, source_col))
    rows = scanned.where("kind = 0").withColumn("source", F.coalesce("source", F.lit("")))
    ends = scanned.where("kind = 1").groupBy("triple", "context").agg(F.sum("n").alias("n"))
    slots = ends.groupBy("context").agg(F.count("*").alias("words")).where(F.col("words") >= SLOT_WORDS).select("context", F.lit(True).alias("slot"))
    starts = scanned.where("kind = 2").groupBy("start", "head").agg(F.sum("n").alias("begun"))
    limits = field_limits(rows)
    undecided = rows.where(F.col("status").isin(DOTTED, OPEN))
    at_limit = (
        undecided.join(limits.where("measure = 'chars'").select("source", F.col("size").alias("chars"), F.lit(True).alias("by_chars")), ["source", "chars"], "left")
        .join(limits.where("measure = 'bytes'").select("source", F.col("size").alias("bytes"), F.lit(True).alias("by_bytes")), ["source", "bytes"], "left")
    )
    closing = closing_lines(undecided, starts)
    judged = at_limit.join(ends.select("triple", F.lit(True).alias("ended")), "triple", "left").join(slots, "context", "left").join(closing, ["start", "triple"], "left")
    limited = F.coalesce("by_chars", F.lit(False)) | F.coalesce("by_bytes", F.lit(False))
    complete = F.coalesce("ended", "closing", F.lit(False)) | (F.coalesce("slot", F.lit(False)) & F.col("name_like"))
    cut = rows.where(F.col("status") == CUT).select("id").unionByName(judged.where(limited | ~complete).select("id"))
    return cut.distinct().select(F.col("id").alias(id_col))


def truncation_by_source(df: DataFrame, cut: DataFrame, id_col: str = "job_id", source_col: str = "source") -> DataFrame:
    """(source, records, cut, share): how often each source truncates."""
    marked = df.select(id_col, source_col).join(cut.withColumn("is_cut", F.lit(1)), id_col, "left")
    return marked.groupBy(source_col).agg(F.count("*").alias("records"), F.coalesce(F.sum("is_cut"), F.lit(0)).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("records"), 6))
