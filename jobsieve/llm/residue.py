"""Template residue, filler and messages of a failing site (problem 5).

All lines of all records are normalised (lower case, numbers folded, tags dropped) and counted by host; lines that recur
on a host are its boilerplate and are subtracted. What is left of a record is its residual: a record is a case if its
residual holds evidence - an unfilled placeholder, filler, a message of the site or its software, a notice that scripts are
required. A notice that a site carries on every page is thus no evidence against a page that also holds a posting. Of a
record whose lines all recur (a site's error page, a posting that was copied again and again) the rarest lines are left.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.lines import TAG, counted, host, key, normalised
from jobsieve.session import write_once

#: A line found on n of a host's m records is boilerplate from n / (m + PRIOR_RECORDS) >= RECURRENT_SHARE on.
RECURRENT_SHARE, PRIOR_RECORDS = 0.05, 20

# Words that name a slot of a posting, in the six languages; a bracketed word of these is a slot left unfilled.
SLOTS = (
    "name vorname nachname firma firmenname company employer arbeitgeber unternehmen organisation ort arbeitsort standort stadt city location place office address adresse title titel jobtitel jobtitle "
    "stellentitel stellenbezeichnung position role rolle job stelle stellen abteilung department division team teamgrösse teamgröße gehalt salary lohn wage pay datum date eintrittsdatum startdatum kontakt contact "
    "ansprechpartner ansprechpartnerin manager recruiter candidate bewerber applicant kennziffer referenz reference nummer number email mail phone telefon link url text beschreibung description benefits aufgaben tasks "
    "entreprise société ville lieu poste intitulé salaire nom prénom service date_debut empresa ciudad puesto salario nombre lugar fecha departamento bedrijf bedrijfsnaam plaats functie naam salaris afdeling azienda città "
    "luogo ruolo stipendio nome reparto"
).split()
FILLS = "insert einfügen einsetzen eintragen ergänzen ausfüllen hier here fill enter your ihr ihre tbd todo insérer ici insertar aquí invoegen inserire qui xxx".split()
HTML = set("a abbr address article aside b base blockquote body br button caption code col dd details div dl dt em figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label legend li link main mark meta nav object ol option p param pre q s script section select small source span strong style sub summary sup table tbody td textarea tfoot th thead time title tr u ul video noscript".split())
LATIN = re.compile(r"(?i)^(lorem|ipsum|dolor|dolem|sit|sitam|amet|consect\w*|consequa\w*|adipis\w*|elit|sed|sedem|eiusmod|temp[ou]r?s?|incid\w*|labor\w*|magn[ai]s?|aliqu\w*|enim|minim|veniam|quis|nostrud|ullamco|nisi|commodo|duis|aute|irure|vel[oi][rt]|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidat\w*|proident|sunt|culpa|officia|deserunt|mollit|felis|lacus|urna|morbi|porta|rutrum|vitae|auctor|fermen\w*|acum\w*|et|ut|in|non|ac|nec|eu|at)$")

_ID = r"[^\W\d_](?:[\w.\- ]{0,38}\w)?"
DOUBLE = re.compile(rf"\{{\{{\s*{_ID}\s*\}}\}}|\{{%\s*{_ID}\s*%\}}|<%=?\s*{_ID}\s*%>|\$\{{\s*{_ID}\s*\}}|\[\[\s*{_ID}\s*\]\]|<<\s*{_ID}\s*>>|«{_ID}»|@@{_ID}@@|%%{_ID}%%|__[^\W_](?:[\w. ]{{0,38}}[^\W_])?__|\|\*\s*{_ID}\s*\*\||\{{\d\}}|%\(\w+\)s|\[object Object\]")
SINGLE = re.compile(rf"\{{\s*({_ID})\s*\}}|(?<!\[)\[\s*({_ID})\s*\](?!\])|(?<!<)<\s*({_ID})\s*>(?!>)|#({_ID})#|%({_ID})%")
UNSET = re.compile(r"\bundefined undefined\b|\bTODO\s*:|\bFIXME\b|\bTBD\b|\bNaN\b|\bnull null\b|^\W*(?:undefined|null|none|nil)\s*(?:\([^)]*\))?\W*$|(?:\b(?:join|at|for|to|from|with|by|in|of|is|bei|für|an|von|mit|chez|pour|voor|bij|per|presso|en|con|para)|:)\s+(?:undefined|null)\b(?!\s+(?:und|and|or|oder|bis|to)\b)")
FILLER = re.compile(
    r"(?i)\bx{3,}\b(?:\W|$)|\b(?:asdf|jklö|qwertz?y?)\b|\b(bla|test|muster|text|dummy|foo|xx|lorem|blindtext|platzhalter|beispiel)(?:\W+\1\b){1,}|\bblindtext\b|\b(?:lorem|ipsum)\b|\b(?:mustertitel|mustertext|beispieltext|dummytext|fülltext)\b"
    r"|\b(?:sample|dummy|placeholder|filler|example) text\b|\bto be replaced before\b|\b(?:text|description|content|copy|beschreibung) (?:goes|comes|kommt|steht) (?:here|hier)\b|\bhier (?:steht|kommt|folgt) (?:später |noch |bald )?(?:der|ihr|dein|ein) (?:\w+)?text\b"
    r"|\btexto? (?:aquí|de relleno|de ejemplo|de prueba)\b|\btexte (?:ici|d'exemple|factice)\b|\bvoorbeeldtekst\b|\btesto (?:di prova|segnaposto|di esempio)\b|\bbitte ignorieren\b|\bplease ignore\b|^untitled(?: \w+)?$|^(?:unbenannt|sans titre|sin título|zonder titel|senza titolo)\b"
)
_MISS = r"(?:not (?:be )?found|could(?: not|n't) be found|does(?: not|n't) exist|no longer (?:exists?|available)|nicht gefunden|existiert nicht|nicht (?:mehr )?verfügbar|introuvable|n'existe pas|non trouvée|no (?:se ha )?encontrad[ao]|no disponible|no existe|niet gevonden|bestaat niet|niet beschikbaar|non trovat[ao]|non (?:è )?disponibile|non esiste|gone)"
_PAGE = r"(?:page|site|address|url|resource|seite|adresse|ressource|página|dirección|pagina|adres|indirizzo)"
MESSAGE = re.compile(
    r"(?i)^\W*(?:"
    r"(?:http(?: status| error)?|error|fehler(?:code)?|erreur|errore|fout(?:code)?|código(?: de error)?|codice(?: errore)?|statu[st]?(?:code)?|code)\s*:?\s*\(?[1-5]\d\d\b\)?"
    r"|\(?[45]\d\d\)?\s*[–—:|-]?\s*(?:error|not found|forbidden|bad gateway|bad request|service (?:temporarily )?unavailable|unauthori[sz]ed|gateway time-?out|internal server error|too many requests|page gone|gone|seite nicht gefunden|zugriff verweigert|accès refusé|acceso denegado|toegang geweigerd|accesso negato|page introuvable|pagina niet gevonden|pagina non trovata|página no encontrada)"
    r"|error\W*$|fehler\W*$|erreur\W*$|(?:page |file )?not found\W*$|forbidden\W*$|loading\W*$|redirecting\W*$"
    r"|(?:access (?:is )?denied|zugriff (?:ist )?verweigert|accès refusé|acceso denegado|toegang geweigerd|accesso negato)\W*(?:$|[.:!])"
    r"|your (?:request|access|ip|connection) (?:was|has been|is) (?:blocked|denied|refused|rejected)|you (?:have been|are|were) blocked|you are not (?:permitted|allowed|authori[sz]ed) to (?:open|view|access|see)|(?:ihre|deine) anfrage wurde (?:blockiert|abgelehnt|gesperrt)"
    r"|service (?:temporarily )?unavailable\b|(?:the |our )?server (?:is|was) (?:temporarily |currently )?(?:unable|unavailable|down|busy|overloaded)|internal server error\b|bad gateway\b|gateway time-?out\b|(?:backend |upstream |database )?connection (?:dropped|reset|refused|timed out|lost|closed|failed)|der server (?:antwortet nicht|ist)|le serveur (?:ne répond|est)|el servidor no|de server reageert|il server non"
    r"|too many requests\b|slow down and try|rate limit exceeded"
    r"|(?:your |the )?session (?:has )?(?:expired|timed out)|(?:ihre|deine) sitzung ist abgelaufen|votre session (?:a )?expir|(?:tu|su) sesión (?:ha )?(?:caducado|expirado)|(?:je|uw) sessie is verlopen|la (?:tua |sua )?sessione è scaduta|bitte melde(?:n sie)? (?:sich|dich) (?:erneut|wieder) an|please (?:log|sign) in again"
    r"|(?:bitte )?bestätige(?:n sie)?,? dass (?:sie|du) (?:kein|ein mensch)|(?:please )?(?:verify|confirm|prove)(?: that)? you(?:'re| are) (?:not a|a? ?human)|(?:confirme[rz]?|veuillez confirmer|confirma|bevestig|conferma)\b.{0,40}\brobot|i'?m not a robot|complete the captcha"
    r"|(?:we are |we're )?checking (?:your|the) (?:browser|connection)|(?:just )?(?:one|a) moment,? please|just a moment|attention required|please wait while|einen moment bitte|un moment,? s'il|un momento,? por favor|een moment(?:je)? (?:geduld|alstublieft)|un attimo,? per favore"
    r"|wartungsarbeiten\b\W|(?:scheduled |planned )?maintenance\W*(?:$|:|in progress|mode)|(?:the |this |our )?(?:site|page|service|seite|website|webseite) (?:is |ist )?(?:currently |temporarily |derzeit |gerade )?(?:under|down for|in|wegen) (?:maintenance|construction|wartung)|wir sind in kürze wieder|we(?:'ll| will) be back (?:soon|shortly)|(?:site|page) en maintenance|en mantenimiento\b|(?:de )?site is in onderhoud|sito in manutenzione"
    r"|(?:please )?(?:enable|activate|turn on|switch on|allow) (?:java)?scripts?\b|(?:bitte )?(?:aktiviere(?:n sie)? |schalte(?:n sie)? )?javascript (?:aktivieren|einschalten|ist .{0,30}(?:deaktiviert|ausgeschaltet|abgeschaltet))|(?:this|the|our) (?:application|app|site|page|website) (?:needs|requires) (?:java)?scripts?|you need (?:to enable )?(?:java)?scripts? to|(?:java)?scripts? (?:is|are|must be) (?:disabled|enabled|turned off|deactivated)|(?:schakel|zet) javascript|turn (?:it|them|scripts?) on in your (?:settings|browser)"
    r"|(?:render|type|reference|syntax|runtime|value|key|null\w*)(?:error|exception)\b|\w+exception\b\W|traceback \(most|uncaught |stack trace|fatal error|segmentation fault"
    r"|(?:fehler beim |error (?:while )?|erreur (?:lors du|de) |error al |fout bij het |errore durante il )(?:laden|loading|chargement|cargar|caricamento)|(?:failed|unable) to load|could not load"
    r"|(?:oops\W+)?(?:something|etwas) (?:went wrong|ist schiefgelaufen|ist schief gegangen)|oops\b|ups\b\W|hoppla\b|une erreur (?:est survenue|s'est produite)|se ha producido un error|er is (?:een fout|iets mis)|si è verificato un errore|(?:ein|es ist ein) fehler (?:ist )?aufgetreten|an error (?:has )?occurred"
    r"|reload the page|please (?:reload|refresh)|(?:please )?(?:try|come back) again later|veuillez réessayer|bitte versuchen sie es (?:später|erneut)|(?:por favor,? )?inténtelo? de nuevo|probeer het later|riprova più tardi"
    r")"
)
MISSING = re.compile(rf"(?i)^\W*(?:[\w'’-]+\s+){{0,5}}{_PAGE}\b(?:\s+[\w'’-]+){{0,5}}?\s+{_MISS}\b")
SCRIPTS = re.compile(r"(?i)^.{0,40}\b(?:activer|activez|active[nr]?|inschakelen|attiva(?:re)?|habilit\w+)\b (?:les |los |il |el )?(?:java)?scripts?\b")
NOSCRIPT = re.compile(r"(?i)<noscript\b")
#: One bit for each pattern, so that a line is only tested for those whose strings it has.
DOUBLE_BIT, SINGLE_BIT, UNSET_BIT, FILLER_BIT, LATIN_BIT, MESSAGE_BIT, MISSING_BIT, SCRIPTS_BIT, NOSCRIPT_BIT = (1 << i for i in range(9))
ALL_BITS = (1 << 9) - 1
SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def _slot(content: str, angle: bool) -> bool:
    """Whether a single-bracketed word names a slot."""
    words = re.split(r"[\s_.\-]+", content.lower())
    if angle and len(words) == 1 and words[0] in HTML:
        return False
    return "_" in content or bool(re.search(r"[^\W\d]\.[^\W\d]", content)) or any(w in FILLS for w in words) or any(w in SLOTS for w in words)


def placeholder(line: str, bits: int = ALL_BITS) -> bool:
    if bits & DOUBLE_BIT and DOUBLE.search(line):
        return True
    return bool(bits & SINGLE_BIT) and any(_slot(next(filter(None, m.groups())), m[0][0] == "<") for m in SINGLE.finditer(line))


def pseudo_latin(sentence: str) -> bool:
    words = re.findall(r"[^\W\d_]+", sentence)
    known = [w for w in words if LATIN.match(w)] if len(words) >= 4 else []
    return len(known) >= max(1, 0.6 * len(words)) and any(len(w) >= 5 for w in known)


def evidence(line: str, bits: int = ALL_BITS) -> str:
    """The kind of evidence in a line: placeholder, filler, script, error, or '' for none; bits: the patterns that can match."""
    if bits & NOSCRIPT_BIT and NOSCRIPT.search(line):
        return "script"
    if bits & (DOUBLE_BIT | SINGLE_BIT) and placeholder(line, bits) or bits & UNSET_BIT and UNSET.search(line):
        return "placeholder"
    if not bits >= FILLER_BIT:
        return ""
    for sentence in SENTENCE.split(TAG.sub(" ", line).strip()):
        if bits & FILLER_BIT and FILLER.search(sentence) or bits & LATIN_BIT and pseudo_latin(sentence):
            return "filler"
        if bits & MESSAGE_BIT and MESSAGE.search(sentence) or bits & MISSING_BIT and MISSING.search(sentence):
            return "script" if "script" in sentence.lower() else "error"
        if bits & SCRIPTS_BIT and SCRIPTS.search(sentence):
            return "script"
    return ""


_remembered = lru_cache(maxsize=150_000)(evidence)


def needed(pattern: str) -> set[str]:
    """Strings in lower case of which any match of the pattern holds at least one, as long as the pattern allows."""
    return _needed(list(parser.parse(pattern)))


def _needed(items: list) -> set[str] | None:
    """The best set of a sequence of parsed elements: the one whose shortest string is longest."""
    best: set[str] | None = None
    run = {""}

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and "" not in found and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = found

    for op, value in items:
        own: set[str] | None = None
        if op is parser.LITERAL:
            own = {chr(value).lower()}
        elif op is parser.IN and all(k is parser.LITERAL for k, _ in value) and len(value) <= 4:
            own = {chr(v).lower() for _, v in value}
        elif op is parser.SUBPATTERN:
            whole = _exact(list(value[3]))
            own, inner = whole, _needed(list(value[3]))
            offer(inner)
        elif op is parser.BRANCH:
            whole = _exact([(op, value)])
            own = whole
            parts = [_needed(list(x)) for x in value[1]]
            if all(parts):
                offer(set().union(*parts))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            if value[0] >= 1:
                offer(_needed(list(value[2])))
                own = _exact(list(value[2]) * value[0]) if value[0] <= 4 else None
                if own is not None and value[1] != value[0]:
                    # More of the same may follow, so that the run ends here.
                    if len(run) * len(own) <= 64:
                        offer({a + b for a in run for b in own})
                    run, own = own, {""}
        elif op is parser.AT or op in (parser.ASSERT, parser.ASSERT_NOT):
            own = {""}
        if own is not None and len(run) * len(own) <= 64:
            run = {a + b for a in run for b in own}
        else:
            offer(run)
            run = own if own is not None else {""}
    offer(run)
    return best


def _exact(items: list) -> set[str] | None:
    """All strings that a short pattern matches, None if they are not a few fixed ones."""
    run = {""}
    for op, value in items:
        if op is parser.LITERAL:
            own = {chr(value).lower()}
        elif op is parser.IN and all(k is parser.LITERAL for k, _ in value) and len(value) <= 4:
            own = {chr(v).lower() for _, v in value}
        elif op is parser.SUBPATTERN:
            own = _exact(list(value[3]))
        elif op is parser.BRANCH:
            parts = [_exact(list(x)) for x in value[1]]
            own = None if any(p is None for p in parts) else set().union(*parts)
        elif op is parser.MAX_REPEAT and value[:2] == (0, 1):
            own = _exact(list(value[2]))
            own = None if own is None else own | {""}
        elif op is parser.AT:
            own = {""}
        else:
            own = None
        if own is None or len(run) * len(own) > 64:
            return None
        run = {a + b for a in run for b in own}
    return run


def triggers() -> dict[int, set[str]]:
    """For each pattern (its bit) the strings of which a line with its evidence holds at least one, derived from the pattern."""
    patterns = {DOUBLE_BIT: DOUBLE, SINGLE_BIT: SINGLE, UNSET_BIT: UNSET, FILLER_BIT: FILLER, MESSAGE_BIT: MESSAGE, MISSING_BIT: MISSING, SCRIPTS_BIT: SCRIPTS, NOSCRIPT_BIT: NOSCRIPT}
    out = {bit: needed(p.pattern) for bit, p in patterns.items()}
    # A sentence is pseudo-Latin only with one of its longer words; a stem stands for all words that go on from it.
    words = LATIN.pattern[LATIN.pattern.index("(", 4) + 1 : -2].split("|")
    out[LATIN_BIT] = {x for w in words for x in needed(w) if len(x) >= 5 or w.endswith("*")}
    if not all(out.values()):
        raise ValueError("a pattern has no string that all its matches hold")
    return out


@lru_cache(maxsize=1)
def _automaton():
    try:
        import ahocorasick
    except ImportError:
        return None  # every line is then looked at, with the same result
    automaton = ahocorasick.Automaton()
    for group, words in triggers().items():
        for word in words:
            automaton.add_word(word, group | automaton.get(word, 0))
    automaton.make_automaton()
    return automaton


def evidence_lines(text: str | None) -> list[tuple[int, str, str]]:
    """(line number from 1, line, kind) of every line of a text that holds evidence."""
    if not text or not text.strip():
        return []
    automaton = _automaton()
    lines = text.split("\n")
    lower = text.lower()
    if automaton is None or len(lower) != len(text):
        return [(i + 1, line, kind) for i, line in enumerate(lines) if (kind := _remembered(line))]
    wanted: dict[int, int] = {}
    at, end = 0, len(lines[0]) + 1
    for position, group in automaton.iter(lower):
        while end <= position:
            at += 1
            end += len(lines[at]) + 1
        wanted[at] = wanted.get(at, 0) | group
    return [(i + 1, lines[i], kind) for i, groups in wanted.items() if (kind := _remembered(lines[i], groups))]


def find_evidence(df: DataFrame, id_col: str, fields: list[str], url_col: str) -> DataFrame:
    """Fields with evidence (kind 0: id, field, host, evidence[], lines[]: keys of all their lines) and counts of all lines of all fields by host (kind 1: line, n).

    evidence[i] is the kind of evidence in the i-th line that is not blank, empty for none. Hosts are counted as lines too.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), host(F.col(url_col)).alias("host"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)])
    kinds = [("kind", pa.int8()), ("id", pa.int64()), ("field_name", pa.string()), ("host", pa.int64()), ("evidence", pa.list_(pa.string())), ("lines", pa.list_(pa.int64())), ("line", pa.int64()), ("n", pa.int64())]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            out: list[tuple] = []
            keys: list[int] = []
            ids, hosts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns = [batch.column(2 + k).to_pylist() for k in range(len(fields))]
            for i, host_ in enumerate(hosts):
                of_host = key(host_)
                own: set[int] = {of_host}
                for k, name in enumerate(fields):
                    text = columns[k][i]
                    if not text or text.isspace():
                        continue
                    found = {no: kind for no, _, kind in evidence_lines(text)}
                    lines, marks = [], []
                    for no, line in enumerate(text.split("\n"), 1):
                        form = known.get(line)
                        if form is None:
                            if len(known) >= 150_000:
                                known.clear()
                            form = known[line] = normalised(line)
                        if form:
                            lines.append(key(host_, f"{k} {form}"))
                            marks.append(found.get(no, ""))
                    own.update(lines)
                    if found:
                        out.append((0, ids[i], name, of_host, marks, lines, None, None))
                keys.extend(own)
            yield emit(out)
            distinct, n = counted(keys)
            empty = pa.nulls(len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(distinct), dtype=np.int8)), *[empty.cast(t) for _, t in kinds[1:6]], pa.array(distinct), pa.array(n.astype(np.int64))], [n_ for n_, _ in kinds])

    return source.mapInArrow(search, "kind byte, id long, field_name string, host long, evidence array<string>, lines array<long>, line long, n long")


def find_residue(df: DataFrame, id_col: str = "job_id", fields: list[str] | None = None, url_col: str = "url", subtract: bool = True) -> DataFrame:
    """Distinct (id_col, field_name, kind) of the fields that hold template residue, filler or messages of the site.

    Null, empty and blank fields are no cases; a line that recurs on its host is boilerplate and no evidence, unless all
    lines of the field do and none is rarer; very long texts are read whole; repeated rows give one row; null ids come out as null. Without
    subtract every line with evidence counts.
    """
    fields = fields or ["title", "description"]
    scanned = write_once(find_evidence(df, id_col, fields, url_col))
    found = scanned.where("kind = 0").select("id", "field_name", "host", "evidence", "lines").withColumn("sign", F.xxhash64("evidence", "lines"))
    if not subtract:
        return found.select(F.col("id").alias(id_col), "field_name", F.explode(F.filter("evidence", lambda e: e != "")).alias("kind")).distinct()
    counts = scanned.where("kind = 1").select("line", "n").groupBy("line").agg(F.sum("n").alias("n"))
    cells = found.select("id", "field_name", "sign", "host", F.explode(F.arrays_zip("evidence", "lines")).alias("x")).select("id", "field_name", "sign", "host", F.col("x.evidence").alias("evidence"), F.col("x.lines").alias("line"))
    # Only lines and hosts of the fields with evidence are looked up; the counts are over all rows.
    wanted = write_once(counts.join(cells.select("line").unionByName(found.select(F.col("host").alias("line"))).distinct(), "line", "left_semi"))
    records = wanted.select(F.col("line").alias("host"), F.col("n").alias("records"))
    judged = cells.join(wanted, "line").join(records, "host").withColumn("left", F.col("n") < RECURRENT_SHARE * (F.col("records") + PRIOR_RECORDS))
    whole = judged.groupBy("id", "field_name", "sign").agg(F.max("left").alias("any_left"), F.min("n").alias("rarest"), F.collect_set(F.when(F.col("evidence") != "", F.struct("evidence", "left", "n"))).alias("marks"))
    stands = whole.select("id", "field_name", F.explode(F.filter("marks", lambda m: m["left"] | (~F.col("any_left") & (m["n"] == F.col("rarest"))))).alias("m"))
    return stands.select(F.col("id").alias(id_col), "field_name", F.col("m.evidence").alias("kind")).distinct()


def recurrent_lines(df: DataFrame, url_col: str = "url", text_col: str = "description", share: float = RECURRENT_SHARE) -> DataFrame:
    """(host, line, n, records): every normalised line that is boilerplate of its host; keys are counted, texts are fetched for those alone."""
    source = df.select(host(F.col(url_col)).alias("host"), F.col(text_col).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            for host_, text in zip(*(c.to_pylist() for c in batch.columns)):
                keys.extend({key(host_), *(key(host_, n) for x in (text or "").split("\n") if (n := normalised(x)))})
            distinct, n = counted(keys)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n.astype(np.int64))], ["line", "n"])

    counts = write_once(source.mapInArrow(search, "line long, n long").groupBy("line").agg(F.sum("n").alias("n")).where("n > 1"))
    records = df.groupBy(host(F.col(url_col)).alias("host")).agg(F.count("*").alias("records"))
    least = records.agg(F.min("records").alias("r")).select((share * (F.col("r") + PRIOR_RECORDS)).alias("least"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {(key(h, n), h, n) for h, text in zip(*(c.to_pylist() for c in batch.columns)) for x in (text or "").split("\n") if (n := normalised(x))}
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["key", "host", "text"])

    kept = counts.join(F.broadcast(least)).where("n >= least").select("line", "n")
    texts = source.mapInArrow(named, "key long, host string, text string").join(kept, F.col("key") == F.col("line"), "left_semi").distinct()
    return texts.join(kept, F.col("key") == F.col("line")).join(records, "host").where(F.col("n") >= share * (F.col("records") + PRIOR_RECORDS)).select("host", F.col("text").alias("line"), "n", "records")
