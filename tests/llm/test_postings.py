"""The operators on postings, on small invented cases and their edges."""

from pyspark.sql import functions as F

from jobsieve.llm.boilerplate import find_boilerplate, main_text
from jobsieve.llm.canonical import map_to_references
from jobsieve.llm.residue import evidence, evidence_lines, find_residue, recurrent_lines
from jobsieve.llm.truncation import CUT, DOTTED, OPEN, WHOLE, ends_in_furniture, examine, find_truncated, key_words, start_words, truncation_by_source

WHOLE_TEXT = "We look after pumps of every kind. You will plan the work of the team. We offer a quiet desk."


def test_residue_evidence():
    cases = {
        "placeholder": ["Dear {{name}}, hello", "Start: __DATE__", "We hire for [company] now", "pay %SALARY% a year", "${city} office", "As a <job_title> you", "NaN/NaN/NaN start", "{0} of {1}", "TODO: add benefits."],
        "filler": ["Lorem ipsum dolor sit amet", "bla bla bla", "asdf", "Sample text, to be replaced", "XXXXX, then more"],
        "error": ["404 Not Found", "Error 500: oops", "Fehler beim Laden der Anzeige.", "Your session has expired. Please log in again.", "Access denied.", "Die Seite wurde nicht gefunden", "Gateway timeout after 30 ms", "We are checking your browser before we let you in"],
        "script": ["Please enable JavaScript to view this page.", "<noscript>x</noscript>", "Vous devez activer les scripts pour afficher ce contenu."],
    }
    for kind, lines in cases.items():
        for line in lines:
            assert evidence(line) == kind, line
    for line in ("We write templates with {{ }} and {}.", "You reduce error pages in our shop.", "[Teilzeit] Planer", "JavaScript is required for this role.", "<p>Text</p>", "50 % and 20 % more", "Access to the site is denied without shoes.", "C# and #teamwork", "Hacemos todo: planes y más.", ""):
        assert evidence(line) == "", line
    assert [n for n, _, _ in evidence_lines("ok\n\n404 – page gone\nfine")] == [3]


def test_residue_subtracts_what_a_host_repeats(spark):
    rows = [(i, "Planner", "Please enable JavaScript to view this page.\n" + WHOLE_TEXT, "https://a.example/1") for i in range(60)]
    rows += [(100 + i, "Planner", WHOLE_TEXT, "https://b.example/1") for i in range(60)] + [(900, "null (m/f)", "Please enable JavaScript to view this page.", "https://a.example/2"), (901, None, "  ", None), (901, None, "  ", None), (None, "x", "404 Not Found", None)]
    df = spark.createDataFrame(rows, "job_id long, title string, description string, url string").withColumn("host", F.lit(1)).withColumn("line", F.lit(2))
    got = sorted(((r.job_id, r.field_name) for r in find_residue(df).collect()), key=str)
    assert got == [(900, "description"), (900, "title"), (None, "description")]
    assert find_residue(df.where("false")).count() == 0
    assert {(r.host, r.n) for r in recurrent_lines(df).collect() if r.line.startswith("please")} == {("a.example", 61)}


def test_truncation_marks():
    assert examine("A whole sentence.")[0] == WHOLE and examine("<p>Closed.</p>")[0] == WHOLE
    assert examine("We offer a qui ...") == (CUT, "We offer a qui") and examine("We offer a qu… [leggi tutto]")[0] == CUT
    for text in ("Ends with an enti&nb", "Ends in a tag </", "<p>Closed.</p> <p>and more", "A broken byte �", "He said (and then"):
        assert examine(text)[0] == CUT, text
    long_tag = 'See <a href="https://x.example/' + "a" * 150
    for text in ("We offer (a salary. And a car and", 'He said: "', "( a ]", "A text â€", long_tag, "An escape \\ud83d", "x" * 300 + " (and " + "y" * 300 + ". Then"):
        assert examine(text)[0] == CUT, text
    for text in ("a) one b) two c) three.", 'He said "yes".', "„Quote“ ends.", "“Quote” ends.", 'A 5" pipe.', "A («b») c."):
        assert examine(text)[0] == WHOLE, text
    assert examine("x < y and z")[0] == OPEN
    assert key_words("one two " + "w" * 200 + " !") == ("one", "two", "w" * 200) and start_words("A" * 100 + " b c d") == "a" * 100 + " b c"
    assert ends_in_furniture("We plan.\nSimilar jobs\n" + "\n".join(f"Planner {i} – Town" for i in range(40))) and not ends_in_furniture("We plan.\nPlanner – Town")
    assert examine("and so on…")[0] == DOTTED and examine("No mark at all")[0] == OPEN


def test_truncation_by_source_limit_and_completeness(spark):
    import random

    rng = random.Random(6)
    body = [" ".join(rng.choice(["pumps", "plans", "teams", "desks", "tools", "tasks", "rooms"]) for _ in range(40)) + ". " + WHOLE_TEXT for _ in range(40)]
    rows = [(i, t[: 120 - i % 2].rstrip() if i < 20 else t, "limited") for i, t in enumerate(body)] + [(100 + i, t, "free") for i, t in enumerate(body)]
    rows += [(900, "You will plan the work of the team. We offer a quiet desk", "free"), (901, WHOLE_TEXT + " We offer a qui", "free"), (902, None, "free"), (903, " ", None)]
    df = spark.createDataFrame(rows, "job_id long, description string, source string").withColumn("chars", F.lit(1)).withColumn("kind", F.lit("clash"))
    got = {r.job_id for r in find_truncated(df).collect()}
    assert got == {*range(20), 901}
    shares = {r.source: r.cut for r in truncation_by_source(df, find_truncated(df)).collect()}
    assert shares["limited"] == 20 and shares["free"] == 1
    assert find_truncated(df.where("false")).count() == 0


def test_truncation_inside_the_first_words_of_a_unit(spark):
    pieces = ["Wir freuen u", "Wir biet", "Neben der Vergütu", "Dal primo g"]
    units = ["Wir freuen uns auf Post.", "Wir bieten ruhige Arbeit.", "Neben der Vergütung gibt es Obst.", "Dal primo giorno si lavora."]
    rows = [(1000 * i + j, f"Angebot {chr(97 + j % 26)}{chr(97 + j // 26)} steht hier. {' '.join(units)}", "s") for i in range(2) for j in range(60)]
    rows += [(10_000 + 10 * i + j, f"Text {chr(97 + j)} hat {'viele ' * (7 * i + 11 * j)}Seiten. {p}", f"s{i}{j}") for i, p in enumerate(pieces) for j in range(5)]
    rows += [(20_000 + j, f"Text {chr(97 + j)} hat {'rote ' * 13 * j}Seiten. Kennziffer K{j}", f"t{j}") for j in range(5)]
    rows += [(30_000 + j, "Immer ein Text. Danach sieht der Planer je", f"u{j}") for j in range(5)]
    df = spark.createDataFrame(rows, "job_id long, description string, source string")
    got = {r.job_id for r in find_truncated(df).collect()}
    assert got == {10_000 + 10 * i + j for i in range(4) for j in range(5)} | {30_000 + j for j in range(5)}


def test_boilerplate(spark):
    page = "Home · Find jobs · Employers · Salaries\nWe use cookies to make this site better.\n\n" + WHOLE_TEXT + "\nYour tasks\n* Plan the work\nPrint\nSimilar jobs\nPlanner for pumps – Town | 3 days ago\nEngineer , Other Town\nPrivacy / Terms / Contact us\n© 2024 Site - all rights reserved"
    rows = [(i, page, "https://s.example/1") for i in range(150)] + [(500 + i, WHOLE_TEXT + "\nYour tasks\n* Plan the work", "https://t.example/1") for i in range(150)] + [(900, None, None), (901, "", "https://s.example/2"), (902, "Print", "https://t.example/3")]
    df = spark.createDataFrame(rows, "job_id long, description string, url string").withColumn("host", F.lit("clash"))
    got = {}
    for r in find_boilerplate(df).collect():
        got.setdefault(r.job_id, set()).add(r.line_no)
    assert got[0] == {1, 2, 7, 8, 9, 10, 11, 12} and set(got) == set(range(150))
    body = {r.job_id: r.main_text for r in main_text(df).collect()}
    assert body[0] == "\n" + WHOLE_TEXT + "\nYour tasks\n* Plan the work" and body[900] is None and body[901] == ""
    assert find_boilerplate(df.where("false")).count() == 0


def _site(n: int) -> list[tuple]:
    """Pages of a site in a language that no list has: the site's lines stay, the posting's change."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lu", "mi", "to", "ve", "sa", "ri"]) for _ in range(3))
    rows = []
    for i in range(n):
        body = [" ".join(word() for _ in range(14)) + "." for _ in range(3)]
        items = [f"* {word()} {word()}" for _ in range(3)]
        top = ["Etusivu | Avoimet paikat | Yritykset | Kirjaudu", "Hyväksy kaikki"] if i % 5 else ["Hyväksy kaikki"]
        end = ["Tulosta", "Tallenna paikka"] if i % 3 else ["Tallenna paikka"]
        rows.append((i, "\n".join([*top, body[0], "Tehtävät", *items, "Tarjoamme", body[1], body[2], *end, "© 2024 Työpolku - kaikki oikeudet pidätetään"]), "https://tyopolku.example/1"))
    return rows


def test_boilerplate_of_a_site_without_lists_and_without_the_tree(spark, monkeypatch):
    from jobsieve.llm import boilerplate

    rows = _site(200)
    df = spark.createDataFrame(rows, "job_id long, description string, url string")
    site = {"Etusivu | Avoimet paikat | Yritykset | Kirjaudu", "Hyväksy kaikki", "Tulosta", "Tallenna paikka", "© 2024 Työpolku - kaikki oikeudet pidätetään"}

    def removed(frame, **settings):
        lines = {r[0]: r[1].split("\n") for r in rows}
        return {(r.job_id, lines[r.job_id][r.line_no - 1]) for r in find_boilerplate(frame, **settings).collect()}

    got = removed(df)
    wanted = {(i, x) for i, text, _ in rows for x in text.split("\n") if x in site}
    assert {x for _, x in got} <= site  # neither headings, which recur as often, nor the posting
    assert len(got & wanted) >= 0.6 * len(wanted)  # the rest always stands beside the posting, as its own closing line would
    assert {"Etusivu | Avoimet paikat | Yritykset | Kirjaudu", "Tallenna paikka", "© 2024 Työpolku - kaikki oikeudet pidätetään"} <= {x for _, x in got}
    # Beyond the size that is sent to the workers, tables are joined, with the same result.
    assert removed(df, sent_rows=0) == got
    # A posting copied until it holds a third of the site's pages stays whole.
    copies = spark.createDataFrame([*rows, *[(1000 + i, rows[7][1], rows[7][2]) for i in range(100)]], "job_id long, description string, url string")
    assert {x.line_no for x in find_boilerplate(copies).where("job_id = 1005").collect()} == {x.line_no for x in find_boilerplate(df).where("job_id = 7").collect()}
    # Without the evidence of the tree nothing is removed, listed or not.
    import numpy as np

    monkeypatch.setattr(boilerplate, "branch_evidence", lambda t, *_: np.zeros(len(t.n)))
    assert removed(df) == set()


def test_residue_triggers_cover_the_patterns():
    from jobsieve.llm import residue

    assert residue.needed("(?i)ab(?:cd|e)f?|xyz") == {"abcd", "abe", "xyz"} and residue.needed(r"x{3,}\b") == {"xxx"} and residue.needed(r"\d+ foo\w*") == {" foo"}
    lines = ["enim minim veniam quis nostrud ullamco nisi", "Test, test, test", "bla-bla", "Bitte versuchen Sie es später", "Turn it on in your browser", "Code 429", "Beschreibung kommt hier", "Excepteur sint occaecat cupidatat non proident, sunt in culpa", "Vous devez activer les scripts"]
    for line in lines:
        for text in (line, line + "\n" + WHOLE_TEXT):  # short and long
            assert [no for no, _, _ in evidence_lines(text)] == [1], text


def test_residue_without_the_subtraction(spark):
    notice = "Please enable JavaScript to view this page."
    rows = [(i, f"{notice}\nWe look after {i} pumps in {i + 1} halls of the plant number {chr(97 + i % 26)}{chr(97 + i // 26)}.", "https://a.example/1") for i in range(60)]
    # An error page between the lines that the site writes on every page: the error is the rarest of them.
    rows += [(100 + i, "Home | Jobs\nWe plan rooms of kind " + chr(97 + i) + ".\nTerms", "https://b.example/1") for i in range(20)] + [(200 + i, "Home | Jobs\n404 Not Found\nTerms", "https://b.example/2") for i in range(5)]
    df = spark.createDataFrame(rows, "job_id long, description string, url string")
    ids = lambda **k: {r.job_id for r in find_residue(df, fields=["description"], **k).collect()}
    assert ids() == set(range(200, 205))
    assert ids(subtract=False) == set(range(60)) | set(range(200, 205))


def test_canonical(spark):
    places = spark.createDataFrame([(1, "Großdornbach", None), (2, "Neustett an der Ohle", None), (3, "Neustett an der Wipfe", None), (4, "Bad Thalmünde", "Thal Spa"), (5, "Château-Morvelle", None)], "place_id int, place_name string, alt_name string")
    types = spark.createDataFrame([(1, "Full-time", "Vollzeit|temps plein"), (2, "Part-time", "Teilzeit"), (3, "Internship", "Praktikum|stage")], "type_id int, type_name string, alt_names string")
    cases = {
        "Großdornbach": None, "  großdornbach ": 1, "Grossdornbach": 1, "80123 Großdronbach, DE": 1, "Neustett a. d. Ohle": 2, "Neustett an der Wipfee": 3, "Neustett": -1, "B. Thalmünde": 4, "thal spa": 4, "Bad Thalmuende und Umgebung": 4, "Chateau Morvelle": 5, "Remote": -1, "": None, " ": None, None: None, "x" * 5000: -1,
    }
    kinds = {"Vollzeit": 1, "FT": 1, "Teilz.": 2, "[part-time] (m/f)": 2, "stgae": 3, "Stufe 2": -1, "Prakt. gesucht": 3, "temps plein / 35 hrs": 1, "???": -1}
    rows = [(i, p, None) for i, p in enumerate(cases)] + [(100 + i, None, k) for i, k in enumerate(kinds)] + [(0, "Großdornbach", None)]
    df = spark.createDataFrame(rows, "job_id long, location string, job_type string").withColumn("raw", F.lit("clash")).withColumn("ref_id", F.lit(7))
    got = {(r.job_id, r.field_name): r.ref_id for r in map_to_references(df, places, types).collect()}
    for i, (value, expected) in enumerate(cases.items()):
        assert got.get((i, "location")) == expected, value
    for i, (value, expected) in enumerate(kinds.items()):
        assert got.get((100 + i, "job_type")) == expected, value
    assert map_to_references(df.where("false"), places, types).count() == 0
    from jobsieve.llm.canonical import map_values, reference_names

    names = reference_names(places, types)
    rows_of = lambda frame: {tuple(r) for r in frame.collect()}
    assert rows_of(map_values(df, names, sent_names=0)) == rows_of(map_values(df, names))  # joined instead of sent
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("jobsieve_")]
    assert {r.ref_id for r in map_to_references(df, places.where("false"), types.where("false")).collect()} == {-1}
