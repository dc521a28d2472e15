import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsieve.llm import languages as L
from jobsieve.llm import names as N
from jobsieve.llm import personal as P

TEXTS = {
    "de": "Wir suchen für unser Team einen Planer. Sie arbeiten eng mit der Werkstatt zusammen und prüfen jede Woche die Pläne. Das Gehalt ist gut und der Arbeitsplatz ist ruhig.",
    "en": "We are looking for a planner for our team. You work closely with the workshop and check the plans every week. The salary is good and the desk is quiet.",
    "fr": "Nous cherchons pour notre équipe une personne qui planifie. Vous travaillez avec l'atelier et vous vérifiez les plans chaque semaine. Le salaire est bon et le bureau est calme.",
    "es": "Buscamos para nuestro equipo una persona que planifique. Trabajas con el taller y compruebas los planes cada semana. El sueldo es bueno y el puesto es tranquilo.",
    "nl": "Wij zoeken voor ons team een planner. Je werkt nauw samen met de werkplaats en controleert elke week de plannen. Het salaris is goed en de werkplek is rustig.",
    "it": "Cerchiamo per la nostra squadra una persona che pianifichi. Lavori con l'officina e controlli i piani ogni settimana. Lo stipendio è buono e il posto è tranquillo.",
}


@pytest.fixture(scope="module")
def prototypes():
    return L.train([(k, t) for k, t in TEXTS.items() for _ in range(3)])


def test_word_sums_equal_the_cosine_of_whole_vectors(prototypes):
    profiles = L.Profiles(prototypes)
    text = "der werkstatt"
    grams = [g for w in text.split() for g in L.Profiles.grams_of(w)]
    vector = np.sum([profiles.gram(g).astype(float) for g in grams], axis=0)
    expected = prototypes @ vector / np.sqrt(L.DIMENSIONS * len(grams))
    assert np.allclose(profiles.cosines([text])[0][0], expected, atol=1e-3)


def test_held_out_sentences(prototypes):
    profiles = L.Profiles(prototypes)
    held_out = {"de": "Die Werkstatt prüft jede Woche das Gehalt für unser Team", "en": "The workshop is looking for the salary every week", "fr": "Le bureau de notre équipe est bon pour chaque personne", "es": "El taller es bueno para nuestro puesto cada semana", "nl": "Het team zoekt elke week een goed salaris voor de werkplaats", "it": "La nostra officina è tranquilla ogni settimana per il posto"}
    for lang, text in held_out.items():
        assert L.LANGUAGES[int(profiles.cosines([text])[0][0].argmax())] == lang


def test_mixed_text_and_segments(prototypes):
    profiles = L.Profiles(prototypes)
    text = TEXTS["de"] + " " + TEXTS["en"].split(". ")[1] + "."
    assert {lang for lang, _ in L.describe(profiles, text)} == {"de", "en"}
    assert [lang for _, lang, _, _ in L.segments(profiles, text)] == ["de", "en"]
    assert L.describe(profiles, "") == [] and L.describe(profiles, "123 456") == []


def test_labels_and_cases(spark, prototypes):
    labels = spark.createDataFrame([(1, "de-DE"), (1, "German"), (2, "fr"), (3, "xx"), (3, None), (4, ""), (9, "en")], "job_id long, lang string")
    got = {(r.job_id, r.l) for r in labels.select("job_id", L.label_language(F.col("lang")).alias("l")).distinct().collect()}
    assert got == {(1, "de"), (2, "fr"), (3, None), (4, None), (9, "en")}
    jobs = spark.createDataFrame([(1, "Wir suchen einen Planer (m/w/d)", TEXTS["de"]), (2, None, TEXTS["en"]), (3, " ", TEXTS["it"]), (5, "123", None), (5, "123", None)], "job_id long, title string, description string").withColumn("lang", F.lit("clash"))
    found = sorted((r.job_id, r.field_name, r.lang) for r in L.find_wrong_labels(jobs, labels, prototypes=prototypes).collect())
    assert found == [(2, "description", "en"), (3, "description", "it")]
    assert L.find_wrong_labels(jobs.where("false"), labels, prototypes=prototypes).count() == 0
    assert L.find_wrong_labels(jobs, labels.where("false")).select("job_id").distinct().count() >= 1


def test_other_languages_are_not_forced_into_one_of_the_six():
    cosines = np.array([[0.2, 0.01, 0, 0, 0, 0], [0.01, 0.012, 0, 0, 0, 0], [0.015, 0.0, 0, 0, 0, 0]], dtype=np.float32)
    sizes = np.array([9, 10, 12])
    assert [x for x, _ in L.judge(cosines, sizes)] == ["de", "other"]
    assert [x for x, _ in L.judge(cosines[1:], sizes[1:])] == ["other"] and L.judge(cosines[1:], sizes[1:])[0][1] > 0.5
    assert [x for x, _ in L.judge(cosines[1:2], np.array([3]))] == ["en"]  # too short to tell


SAME = [
    ["Kroilkfal Kanmergra Software GmbH & Co. KG", "KROILKFAL KANMERGRA SOFTWARE GMBH & CO. KG", "Kroilkfal SW GmbH und Co. KG", "KroilkfalKanmergra Software", "Kanmergra Kroilkfal Software", "(via Kroilkfal Kanmergra Software)", "Kroilkfal K. Software", "Kroilkfla Kanmergra Software", "Fa. Kroilkfal Kanmergra"],
    ["Gärtnerei Rebekka Osriktanzi", "Gaertnerei Rebekka Osriktanzi", "Gärtn. Becky Osriktanzi", "Osriktanzi Rebekka, Gärtnerei", "Gärtnerei R. Osriktanzi", "Gärtnerei Dr. Rebekka Osriktanzi"],
    ["Lembalem Lutorsto Logistik B.V.", "Lembalem Lutorsto Log. BV"],
]
OTHERS = ["Lembalem Wergrazi Pharma AG", "Gärtnerei Rebekka Vinriktan", "Nihelhur Kanmergra Handel SE", "Web", "web", "k. A.", "", None]


def test_name_variants(spark):
    rows = [(n,) for group in SAME for n in group] + [(n,) for n in OTHERS] + [(SAME[0][0],)] * 5
    df = spark.createDataFrame(rows, "company string").withColumn("name", F.lit("clash")).withColumn("words", F.lit(1))
    got = {(r.company_a, r.company_b) for r in N.variant_pairs(df).collect()}
    assert got == {(a, b) for group in SAME for a in group for b in group if a < b}
    assert N.variant_pairs(df.where("false")).count() == 0
    text = " ".join(f"word{i}" for i in range(3000))
    long = spark.createDataFrame([(text,), (text.upper(),), (text + " more",), ("word1 Zirkonfal",)], "company string")
    assert {(r.company_a, r.company_b) for r in N.variant_pairs(long).collect()} == {(min(text, text.upper()), max(text, text.upper()))}


def test_frequent_words_need_no_limit(spark):
    import random

    rng = random.Random(8)
    invented = lambda: "".join(rng.choice("bdfgklmnprstvwz") + rng.choice("aeiou") for _ in range(6))
    many = [f"Zirkonfal Software {invented().title()}" for _ in range(300)]  # one employer in 300 forms
    trades = ["Software", "Bakery", "Garden", "Paint", "Pumps", "Legal"]
    others = [*(f"{invented()} {t}" for t in trades for _ in range(400)), *(f"Annegret {invented()} {t}" for t in trades for _ in range(40))]
    rows = [*many, "Zirkonfal SW", "Zirkonfla Software", *others, "Annegret Q. Paint", "Annegret Quartzen Paint", "Legal", "TUV Garden", "TUV Bakery", "TUV"]
    forms = N._parsed(spark.createDataFrame([(n,) for n in rows], "company string"), "company").select("form").distinct()
    pairs = {(r.a.replace("*", ""), r.b.replace("*", "")) for r in N.candidate_pairs(forms).collect()}
    form = lambda n: " ".join(w + ("." if s else "") for w, s in N.parse(n))
    met = lambda x, y: (min(form(x), form(y)), max(form(x), form(y))) in pairs
    assert all(met(n, "Zirkonfal SW") and met(n, "Zirkonfla Software") for n in many)
    assert met("Annegret Q. Paint", "Annegret Quartzen Paint")
    assert len(pairs) < 4 * len(rows)  # nothing like all pairs of a trade
    links = {(r.a, r.b) for r in N.verified_links(forms).collect()}
    linked = lambda x, y: (min(form(x), form(y)), max(form(x), form(y))) in links
    assert all(linked(n, "Zirkonfla Software") for n in many) and linked("Annegret Q. Paint", "Annegret Quartzen Paint")
    assert not [x for x in links if form("Legal") in x]  # a trade alone names nobody
    assert linked("TUV", "TUV Garden")  # a word of three letters is a key too


def test_a_trade_and_a_letter_are_no_key(spark):
    """Employers of one trade, many with a word in short, are not compared with each other (F1); their own variants are met."""
    import random

    rng = random.Random(4)
    invented = lambda: "".join(rng.choice("bdfgklmnprstvwz") + rng.choice("aeiou") for _ in range(5))
    two = [(invented(), invented()) for _ in range(600)]
    full, brief = [f"{a} {b} Software" for a, b in two], [f"{a} {b[0].upper()}. Software" for a, b in two[:300]]
    forms = N._parsed(spark.createDataFrame([(n,) for n in full + brief], "company string"), "company").select("form").distinct()
    pairs = {(r.a.replace("*", ""), r.b.replace("*", "")) for r in N.candidate_pairs(forms).collect()}
    form = lambda n: " ".join(w + ("." if s else "") for w, s in N.parse(n))
    assert all(tuple(sorted((form(x), form(y)))) in pairs for x, y in zip(full, brief))
    assert len(pairs) < 1.2 * len(brief)


def test_two_slips_in_long_words_are_all_found(spark):
    words = {"zirkonfalmer", *("zirkonfalmer"[:i] + "zirkonfalmer"[i + 1 : j] + "zirkonfalmer"[j + 1 :] for j in range(12) for i in range(j))}
    got = {(r.a, r.b) for r in N.word_pairs(spark.createDataFrame([(w,) for w in sorted(words)], "w string")).collect()}
    assert {x for p in got if "zirkonfalmer" in p for x in p} == words


def test_texts_with_slips_and_abbreviations_are_linked(spark):
    """Strings of more than NAME_WORDS words have their slips, abbreviations and joined words like others (F2)."""
    words = [f"{x}{y}lmer" for x in ("zirk", "brun", "kalt", "vest", "dorm", "pelk", "hurs", "grim") for y in ("ona", "ebi", "uku", "afo", "ire", "osa", "uti", "eko")]
    assert len(words) > N.NAME_WORDS
    text, unlike = " ".join(words), " ".join([*words[1:], "Quartzbau"])
    rows = [text, text.replace("brunuku", "brnuuku"), " ".join([*words[:9], "B.", *words[10:]]), " ".join([words[0] + words[1], *words[2:]]), " ".join(words[::-1]).replace("kaltona", "kalton"), unlike]
    got = {(r.a, r.b) for r in N.verified_links(spark.createDataFrame([(" ".join(w + ("." if s else "") for w, s in N.parse(n)),) for n in rows], "form string")).collect()}
    form = lambda n: " ".join(w + ("." if s else "") for w, s in N.parse(n))
    assert all(tuple(sorted((form(text), form(x)))) in got for x in rows[1:5])
    assert not [x for x in got if form(unlike) in x]


def test_star_clusters_settle_long_chains(spark):
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(64)], "a string, b string")
    assert {r["name"] for r in N.star_clusters(links).collect()} == {f"n{i:02}" for i in range(65)}


def test_collision_curve_and_slips():
    b = N.bands_for(0.5, 0.98, 4)
    assert 1 - (1 - 0.5**4) ** b >= 0.98 > 1 - (1 - 0.5**4) ** (b - 1)
    assert N.slips("abcdef", "abdcef") == 1 and N.slips("abc", "abc") == 0 and N.slips("abcdefgh", "zzzzzzzz") == 3


def test_recall_of_slips_against_brute_force(spark):
    """At least 0.95 for words of each length from 4 to 14 and each kind of slip that the verification accepts."""
    import random

    rng = random.Random(3)
    letters = "abcdefghijklmnoprstuvwz"
    near: dict[tuple[int, str], set] = {}
    words = set()
    for length in range(4, 15):
        for _ in range(60):
            w = "".join(rng.choice(letters) for _ in range(length))
            i = rng.randrange(length - 1)
            edits = {"changed": w[:i] + rng.choice(letters) + w[i + 1 :], "dropped": w[:i] + w[i + 1 :], "added": w[:i] + rng.choice(letters) + w[i:], "swapped": w[:i] + w[i + 1] + w[i] + w[i + 2 :]}
            if length >= N.LONG:
                j = rng.randrange(length - 2)
                edits["two"] = (x := w[:i] + rng.choice(letters) + w[i + 1 :])[:j] + rng.choice(letters) + x[j + 1 :]
            for kind, v in edits.items():
                if v != w and len(v) >= 4 and N.slips(w, v) <= (2 if min(len(v), len(w)) >= N.LONG else 1):
                    near.setdefault((length, kind), set()).add((min(w, v), max(w, v)))
                    words |= {w, v}
    got = {(r.a, r.b) for r in N.word_pairs(spark.createDataFrame([(w,) for w in sorted(words)], "w string")).collect()}
    for case, pairs in near.items():
        assert len(pairs & got) >= 0.95 * len(pairs), (case, len(pairs & got), len(pairs))


TEXT = "Frau Brandmoor ist unter +49 (0)30 23125-007 erreichbar, Mail liv.holtvik+jobs@inbox.example oder amara [at] nord [dot] example. Ich wohne in der Nähe: Lindwurmsteig 9a, 79048 Bad Thalm. Steuer-ID 06 487 307 095. Kennziffer 2023-3715-11. Das Gespräch mit Vorstig, Liv hat mir gefallen. Wir haben 4087 Maschinen, Version 20.54.0, Auftrag 16922038."
TRUE = {("NAME", "Brandmoor"), ("PHONE", "+49 (0)30 23125-007"), ("EMAIL", "liv.holtvik+jobs@inbox.example"), ("EMAIL", "amara [at] nord [dot] example"), ("ADDRESS", "Lindwurmsteig 9a, 79048 Bad Thalm"), ("ID_NUMBER", "06 487 307 095"), ("NAME", "Vorstig, Liv")}


def test_personal_data(spark):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, None), (3, ""), (4, "Nothing here at all."), (None, "Write to a.b@c.example")], "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("id", F.lit(1))
    places = spark.createDataFrame([("Bad Thalm",)], "place_name string")
    got = P.find_personal(df, places).collect()
    assert {(r.kind, r.found_text) for r in got if r.doc_id == 1} == TRUE
    assert {(r.kind, r.found_text) for r in got if r.doc_id is None} == {("EMAIL", "a.b@c.example")} and len(got) == len(TRUE) + 1
    clean = {r.doc_id: r.redacted for r in P.redact(df, places).collect()}
    assert clean[2] is None and clean[3] == "" and clean[4] == "Nothing here at all."
    assert clean[1].startswith("Frau [NAME] ist unter [PHONE] erreichbar, Mail [EMAIL] oder [EMAIL]. Ich wohne in der Nähe: [ADDRESS]. Steuer-ID [ID_NUMBER]. Kennziffer 2023-3715-11.")
    assert P.find_personal(df.where("false")).count() == 0


def test_names_in_free_text_and_towns_of_any_list(spark):
    text = "Yesterday Anna Müller met the team and Peter Schmidt left. The Anna Straße 5 and the Maria Hotel stayed. Thomas Weber GmbH won."
    df = spark.createDataFrame([(1, text)] + [(10 + i, f"Frau Claudia Berg{chr(97 + i)} hat angerufen, dann ging Laura Tal{chr(97 + i)} heim.") for i in range(20)], "doc_id long, text string")
    got = {r.found_text for r in P.find_personal(df).where("doc_id = 1 and kind = 'NAME'").collect()}
    assert got == {"Anna Müller", "Peter Schmidt"}
    towns = P.Towns(("Neustett", "Neustett an der Ohle", "Ohle"))
    assert towns.tail(" in 12345 Neustett an der Ohle, dort", 0) == (30, True) and towns.tail(", Ohle 12345.", 0) == (12, True) and towns.tail(" 12345 Weiler", 0) == (13, False) and towns.tail(" dort", 0) is None
    places = spark.createDataFrame([("A",), ("B",)], "place_name string")
    assert P.town_names(places) == ("A", "B")
    import pytest

    with pytest.raises(ValueError):
        P.town_names(places, most=1)


def test_check_digits():
    assert P.valid("dni", "12345678Z") and not P.valid("dni", "12345678A") and P.valid("dni", "X1234567L")
    assert P.valid("nine", "111222333") and not P.valid("nine", "111222334") and P.valid("tax", "86 095 742 719") and P.valid("long", "9434765919") and not P.valid("card", "C01X00T47")


def test_the_corpus_decides_about_the_labelers():
    # The second labeler is wrong in most of its votes here, whatever is assumed of it.
    patterns = np.array([(1, 0, 1, 0, 1, 0, 1), (1, 1, -1, 0, -1, -1, 0), (1, 0, -1, 0, -1, -1, 0), (1, 1, 1, 0, 1, 0, 1)])
    posterior, right = P.reliabilities(patterns, np.array([500.0, 400.0, 300.0, 20.0]))
    assert posterior[0] > 0.95 > 0.05 > posterior[1]
    assert right[1, 0] <= 0.55 < P.ASSUMED[1] and right[2, 0] > P.ASSUMED[2]


def test_votes_round_trip_and_em():
    import itertools

    for votes in itertools.islice(itertools.product((-1, 0, 1), repeat=len(P.LABELERS)), 0, 2187, 7):
        assert P.decode(P.encode(votes, 5)) == (votes, 5)
    patterns = np.array([(1, 1, 1, 0, 0, 0), (1, 0, -1, 0, 0, -1)])
    posterior, right = P.reliabilities(patterns, np.array([500.0, 100.0]))
    assert posterior[0] > 0.95 > 0.1 > posterior[1] and (right > 0.5).all()
