"""Personal data in free text, found and replaced (problem 10).

Weak supervision: patterns and gazetteers propose spans, and labelers of four sorts - patterns (form), gazetteers (first
names, towns), context (words before and after) and plausibility (lengths, check digits) - vote for or against each span or
abstain. Expectation-maximisation over the counts of all vote patterns in the corpus estimates how reliable each labeler is,
from a prior worth a few votes; a logistic classifier over the votes and over features that no labeler looks at is then
trained on the posteriors and decides every span. Patterns are few whatever the size of the corpus, so only their counts reach
the driver. Overlapping spans are settled in favour of the more certain, then the longer one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.session import write_once

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
LABELERS = ("form", "strict", "before", "after", "gazetteer", "against", "plausible")
#: How often a labeler's votes are taken to be right before the corpus is seen, and how many votes that counts for.
ASSUMED = (0.7, 0.9, 0.95, 0.8, 0.95, 0.998, 0.75)
PRIOR_VOTES = 30.0
#: What the classifier sees besides the votes: one bit each.
FEATURES = ("starts a line", "ends a line", "three words or more", "capitals only", "over 25 characters", "digits inside")
#: Rows of the gazetteer of towns that are sent to all workers at most; a longer list is refused.
TOWNS = 2_000_000

# First names, a gazetteer of moderate size in the six languages.
FIRST_NAMES = set(
    "aline amara ana andrea andreas anna anna-lena anne anton antonio arthur bastian beatriz benjamin bernd bianca callum camille carla carlos carlotta carmen caroline charlotte chiara christian christina clara claire claudia daan daniel david deniz diego dirk elena elisa elisabeth emil emily emma eric eva felix fernando "
    "francesca francesco francisco frank franz frederik friedrich gabriel george giorgia giulia giovanni hannah hans harriet heike helen helena hugo ilka ines inga isabel ivan jack jan jana jannik javier jean jean-luc jeanne jens jessica joan johan johannes john jonas jorge josé juan julia julian julien karin karl katharina "
    "katrin kenji klaus lars laura lea lena leon leonie liam linda lisa liv lorenzo louis luca lucas lucia ludwig luis luisa lukas maja manuel marco maren maria marie mario markus marta martin mateo matteo matthias max maximilian mehmet mia michael miguel mila mohamed monika nadia nicolas nils nina noah noemi nora oksana olga "
    "oliver oscar owen pablo paolo patricia paul paula peter petra philipp pierre pieter rasmus robert ronja rosa samuel sandra sanne sara sarah saskia sebastian silvia simon sofia sophie stefan stefanie susanne svenja sven thomas tilman tim tomasz ulrike ute vera victor vincent vivian werner william yusuf".split()
)
# Words that begin sentences and are no family names.
STARTERS = set(
    "ich in die der das den dem des ein eine einen wenn sie du wir ihr unser unsere nach vom von neben zusammen an am seit während meine mein sichere gute idealerweise vielen mit für zum zur auf bei es er als aber und you we my the at our for together besides after every ideally when if i it this that a an with to on sound "
    "close care in reports good thirty two flexible fresh paid vous nous je mes mon pour dans à avec idéalement depuis chaque quand un une le la les en au sur notre merci bonne el los las mi mis te se he has con de cada lo desde nuestro nuestra buen además cuando después ik je jij wij mijn het een op voor na naast bij als samen elke "
    "goede il lo gli mio mia ho hai con per nel nella idealmente ogni quando dopo oltre siamo tu ti da al dal buona telefonat lebenslauf curriculum notiz profil profile note".split()
)

# ---------------------------------------------------------------- e-mail
_L = r"[A-Za-z0-9ÄÖÜäöüß][A-Za-z0-9ÄÖÜäöüß._%+\-]*"
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|ät|AT|@|arroba|chiocciola|arobase|apenstaartje)\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|point|punto|DOT|PUNKT|\.)\s?[\])}>]\s?)"
_D = r"[A-Za-z0-9ÄÖÜäöüß](?:[A-Za-z0-9ÄÖÜäöüß\-]*[A-Za-z0-9ÄÖÜäöüß])?"
EMAIL = re.compile(rf"(?<![\w.+\-])({_L}{_AT}{_D}(?:{_DOT}{_D})+|{_L}\s(?:at|AT|ät|arroba)\s{_D}(?:\s(?:dot|DOT|punkt|punto|point)\s{_D})+)(?![\w@])")
EMAIL_STRICT = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}")

# ---------------------------------------------------------------- phone
_S = r"[ \-./ –]{1,3}"
PHONE = re.compile(
    rf"(?<![\w+/.,\-(])((?:\+|00)\d{{1,3}}(?:{_S})?(?:\(0\)(?:{_S})?)?(?:\(\d{{1,5}}\)(?:{_S})?)?\d+(?:{_S}\d+){{0,6}}|\(\+?\d{{2,5}}\)(?:{_S})?\d+(?:{_S}\d+){{0,5}}|0\d{{1,6}}(?:{_S}\d+){{1,6}}|0\d{{8,11}}|1[\-. ]\(?\d{{3}}\)?[\-. ]\d{{3}}[\-. ]\d{{4}}|\d{{3}}[\-. ]\d{{3}}[\-. ]\d{{4}})(?!\w|[./,\-]\d)"
)
PHONE_BEFORE = re.compile(r"(?i)(?:\btel(?:\.|efon|éfono|efono|efoon|éphone|ephone)?|\bphone|\bfon|\bmobil\w*|\bhandy|\bcell|\bfax|\bcall|\bring|\bat|\bon|\bunter|rufen sie|\brufe?n?|\bau|\ben el|\bal|\bop|\bnummer|\bnumber|\bnuméro|\bnúmero|\bnumero|appelez(?: le| au)?|\bllame?n?(?: al)?|\bbel(?:len)?|\bchiam\w+|\boder|\bor|\bou|\bo|\bof|\bunder|\ble)\s*[:.]?\s*$")

# ---------------------------------------------------------------- identity numbers
ID_SHAPES = (
    ("cf", re.compile(r"(?<!\w)([A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?!\w)"), True),
    ("nino", re.compile(r"(?<!\w)([A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?!\w)"), True),
    ("nir", re.compile(r"(?<![\w.])([1278](?: ?\d{2}){3} ?\d{3} ?\d{3}(?: ?\d{2})?)(?![\w]|[ .]\d)"), True),
    ("pension", re.compile(r"(?<!\w)(\d{2} ?\d{6} ?[A-Z] ?\d{3})(?!\w)"), True),
    ("dni", re.compile(r"(?<!\w)(\d{8}[- ]?[A-Z]|[XYZ][- ]?\d{7}[- ]?[A-Z])(?!\w)"), True),
    ("health", re.compile(r"(?<!\w)([A-Z]\d{9})(?!\w)"), True),
    ("card", re.compile(r"(?<!\w)([A-Z](?=[A-Z0-9]*\d)[A-Z0-9]{8})(?!\w)"), False),
    ("tax", re.compile(r"(?<![\w/])(\d{2}([ /]?)\d{3}\2\d{3}\2\d{3})(?![\w/]|[ ]\d)"), False),
    ("ssn", re.compile(r"(?<![\w\-])(\d{3}([ \-])\d{2}\2\d{4})(?![\w\-])"), False),
    ("nine", re.compile(r"(?<![\w.,/\-+])(?<!\d[ /])(\d{9}|\d{4}\.\d{2}\.\d{3}|\d{3}[. ]\d{3}[. ]\d{3})(?![\w]|[.,/\-]\d)"), False),
    ("long", re.compile(r"(?<![\w.,/\-+])(?<!\d[ /])(\d{2}[ /]?\d{8}[ /]?\d{2}|\d{10,12})(?![\w]|[.,/\-]\d)"), False),
)
ID_LABEL = re.compile(
    r"(?i)(?:krankenversichert\w*|versicherten?-?(?:nummer|nr)|krankenkassen?\w*|kvnr|steuer(?:identifikations)?-?(?:nummer|id|nr)\w*|steuer-id\w*|id-?nr|idnr|\btin\b|rentenversicherung\w*|sozialversicherung\w*|\bsv-?(?:nummer|nr)|personalausweis\w*|ausweis\w*|\bperso\b[\w\-]*|reisepass\w*|\bpass(?:nummer|-?nr|port)?\b|passport|"
    r"social security|\bssn\b|national insurance|\bni(?:no)?\b|tax (?:id|number|ref)|\butr\b|\bnhs\b|identity card|driving licen[cs]e|sécurité sociale|\bnir\b|numéro fiscal|\bnif\b|carte d'identité|carte nationale|passeport|\bdni\b|\bnie\b|seguridad social|pasaporte|burgerservicenummer|\bbsn\b|sofinummer|paspoort\w*|identiteits\w*|rijbewijs\w*|codice fiscale|\bc\.?\s?f\.|passaporto|carta d'identità|tessera sanitaria|partita iva)"
    r"[\s.:#°]*(?:(?:number|nummer|nr|no|num|numéro|número|numero|n)\b[\s.:#°º]*)?(?:(?:is|ist|lautet|est|es|è|:)\s*)?[\s:#(]*$"
)
# ---------------------------------------------------------------- words against
AGAINST = re.compile(
    r"(?i)(?:kennziffer|kennz\.|referenz(?:nummer|nr)?|reference(?: number| no)?|\bref|référence|referencia|referentie|riferimento|auftrag\w*|bestell\w*|order|commande|pedido|bestelling|ordine|rechnung\w*|invoice|facture|factura|factuur|fattura|version|release|build|artikel\w*|article|ticket|vorgang\w*|aktenzeichen|kundennummer|customer (?:number|no)|serien\w*|serial|isbn|iban|konto\w*|account)"
    r"[\s.:#°]*(?:(?:number|nummer|nr|no|num|n)\b[\s.:#°º]*)?(?:(?:is|ist|lautet|est|es|è|:)\s*)?[\s:#(]*$"
)

# ---------------------------------------------------------------- address
_C = r"[A-ZÄÖÜÀ-Ý][\wÄÖÜäöüßÀ-ÿ'’\-]*"
_NO = r"\d{1,4}(?:\s?[a-zA-Z](?![\w]))?(?:\s?[\-/]\s?\d{1,3}[a-z]?)?"
_STREET_DE = (
    rf"(?:(?:(?:Am|An\sder|An\sden|Im|In\sder|Zum|Zur|Auf\sdem|Auf\sder|Unter\sden|Hinter\sdem|Vor\sdem|Beim)\s{_C}(?:\s{_C})?)"
    rf"|(?:(?:Alte|Neue|Kleine|Große|Obere|Untere|Lange|Breite|Hohe)[rsnm]?\s)?[A-ZÄÖÜ][\wÄÖÜäöüß\-]*(?:gasse|straße|strasse|str\.|weg|steig|stieg|winkel|platz|ufer|allee|ring|damm|hof|garten|pfad|chaussee|markt|graben|wall|zeile|steg|kamp|twiete|redder|bogen|stock|berg|brücke|tor|park|anger|hain|grund|rain|höhe|feld)"
    rf"|{_C}\s(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Ring|Damm|Steig|Chaussee|Markt))"
)
_STREET_NL = r"(?:(?:Oude|Nieuwe|Grote|Kleine|Lange)\s)?[A-Z][\wÀ-ÿ'\-]*(?:straat|laan|weg|plein|gracht|kade|singel|dijk|pad|steeg|dreef|baan|plantsoen|wal|hof|markt)"
_STREET_EN = rf"(?:{_C}\s){{1,3}}(?:(?:Lane|Street|Road|Avenue|Court|Drive|Way|Close|Square|Terrace|Place|Gardens|Hill|Row|Walk|Mews|Crescent|Boulevard|Grove|Green|Yard|Parade|Quay)\b|St\b\.?|(?:Rd|Ave|Ct|Dr|Sq|Pl|Blvd)\b(?:\.(?=[,;]))?)"
_OF = r"(?:de la|de l'|de l’|du|des|de los|de las|del|della|delle|dei|degli|dello|dell'|de|di|d'|d’|da|al|la|las|los|el|les|le)"
_WORDS = rf"(?:\s?{_OF}\s?)?{_C}(?:(?:\s{_OF}\s?|\s){_C}){{0,3}}"
HOUSE = re.compile(rf"(?<![\w.,:/\-])\d{{1,4}}(?!\d|[.,:]\d)")
HOUSE_REST = re.compile(_NO)
# Streets that end where a house number begins, and those that begin after one.
STREETS_BEFORE = (
    re.compile(rf"(?<![\w])({_STREET_DE})\s$"), re.compile(rf"(?<![\w])({_STREET_NL})\s$"),
    re.compile(rf"(?<![\w])((?i:calle|c/|avenida|avda\.?|plaza|paseo|camino|carretera|ronda|travesía|via|viale|piazza|corso|largo|vicolo|piazzale|strada|contrada)\s{_WORDS}),?\s(?:n[.º°]\s)?$"),
)
STREETS_AFTER = (
    re.compile(rf"\d{{1,4}}(?:\s?[a-zA-Z](?![\w]))?(?:\s?[\-/]\s?\d{{1,3}}[a-z]?)?\s{_STREET_EN}"),
    re.compile(rf"\d{{1,4}}(?:\s?[a-zA-Z](?![\w])|\s(?:bis|ter))?,?\s(?i:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|square|passage|sentier|faubourg|ruelle)\s{_WORDS}"),
)
STREET_LOOK = 80
_CODE = r"(?:(?:[A-Z]{1,2}-\s?)?\d{4,5}(?:\s?[A-Z]{2}(?![\w]))?)"
_JOIN = r"(?:an der|an den|am|im|ob der|bei|in der|auf der|aan de|aan den|op de|am|sur|sous|lès|les|la|le|de la|de los|del|de|di|a\. d\.|upon|on|under)"
TOWN = rf"{_C}(?:\s{_JOIN}\s{_C})?"
ADDRESS_BEFORE = re.compile(r"(?i)(?:\bwohn\w*(?: ich)?(?: in der nähe)?|anschrift(?: lautet| ist)?|adresse(?: lautet| ist| est)?|\bpost(?: bitte)? an|address(?: is)?|i live at|lives? at|forms to|send .{0,20} to|dossier au|habite(?: au)?|\bau|vivo en|dirección(?: es)?|\ben|abito in|indirizzo(?: è)?|woon(?:t)? op|adres(?: is)?|\bop|\bin|\ban|:|,)\s*$")

# ---------------------------------------------------------------- names
_G = r"[A-ZÀ-ÝÄÖÜ][a-zà-ÿäöüß]+(?:-[A-ZÀ-ÝÄÖÜ][a-zà-ÿäöüß]+)*"
_F = r"(?:[ODL]['’])?[A-ZÀ-ÝÄÖÜ][a-zà-ÿäöüß]+(?:[A-Z][a-z]+)?(?:-(?:[ODL]['’])?[A-ZÀ-ÝÄÖÜ][a-zà-ÿäöüß]+)*"
_K = r"(?:[ODL]['’])?[A-ZÀ-ÝÄÖÜ]{2,}(?:-[A-ZÀ-ÝÄÖÜ]{2,})*"
_P = r"(?:(?:de la|de los|de las|del|de|della|dalla|di|da|dos|du|van der|van den|van de|van|von der|von|vom|zu|zur|ter|ten|le|la|el|Mac|Mc)\s)"
_PK = r"(?:(?:DE LA|DE LOS|DEL|DE|DELLA|DI|DA|VAN DER|VAN DEN|VAN DE|VAN|VON DER|VON|ZU|TER|TEN|LE|LA)\s)"
NAME_FORMS = tuple(
    (name, re.compile(pattern))
    for name, pattern in (
        ("turned", rf"({_P}?{_F},\s{_G}(?:\s[A-Z]\.)?)(?![\w])"),
        ("caps_turned", rf"({_PK}?{_K},?\s{_G})(?![\w])"),
        ("caps", rf"({_K}\s(?:[A-Z]\.\s)?{_PK}?{_K})(?![\w])"),
        ("full", rf"({_G}\s(?:[A-Z]\.\s)?{_P}?{_F})(?![\w])"),
        ("initial", rf"((?:[A-Z]\.[\s-]?){{1,2}}{_P}?{_F})(?![\w])"),
        ("short", rf"({_G}\s[A-Z]\.)(?![\w])"),
    )
)
FAMILY = re.compile(rf"({_P}?{_F}|{_PK}?{_K})(?![\w])")
TITLE = r"(?:(?:Dr|Prof|Dipl|Ing|Mag|Med|Dott|Dra|Ir|Drs|M\.?\s?Sc|B\.?\s?A)\.?(?:[\s-]?(?:Ing|med|phil|rer|nat|h\.c)\.?)*\s+)*"
SALUTATION = re.compile(rf"(?<![\w])(?:Herrn?|Frau|Fr\.|Hr\.|Mr|Mrs|Ms|Miss|Mx|Sir|Madam|Madame|Mme|Mademoiselle|Mlle|Monsieur|M\.|(?i:señora?|señorita|sra?|srta|don|doña)\.?|(?i:mevrouw|mevr|meneer|mijnheer|dhr|de heer|heer)\.?|(?i:signora?|signorina|sig\.ra|sig)\.?)\.?\s+{TITLE}")
LEAD = re.compile(
    r"(?<!\w)(?=[AaKkCcVvTtSsJjUuIiRrGgFfOoMmNnBbLlEe])(?:(?:[Aa]nsprech(?:partner(?:in)?|person)|[Kk]ontakt(?:person)?|[Cc]ontact(?: person)?|[Vv]otre contact|[Tt]u contacto|[Ss]u contacto|[Jj]e contactpersoon|[Uu]w contactpersoon|[Cc]ontactpersoon|[Ii]l tuo contatto|[Rr]eferente|[Rr]eferen[cz]e?|[Rr]éférence|[Rr]eferencia|[Rr]eferentie|[Rr]eferenza|[Ss]igned(?: by)?|[Gg]ezeichnet|[Gg]ez\.|[Uu]nterzeichnet|[Ss]igné(?:e)?(?: par)?|[Ff]irmado(?: por)?|[Gg]etekend|[Oo]ndertekend|[Ff]irmato(?: da)?|"
    r"[Mm]ein Name|[Mm]y name|[Jj]e m'appelle|[Mm]e llamo|[Ii]k heet|[Mm]i chiamo|[Nn]ame|[Nn]om|[Nn]ombre|[Nn]aam|[Nn]ome|[Vv]orgesetzter?|[Bb]ewerber(?:in)?|[Aa]pplicant)(?:\s(?:is|ist|est|es|è|war|was))?\s*[:,]?\s+"
    r"|(?:[Gg]espräch mit|[Tt]alk with|[Ee]ntretien avec|[Cc]onversación con|[Gg]esprek met|[Cc]olloquio con|[Aa]ccording to|[Ll]aut|[Ss]elon|[Ss]egún|[Vv]olgens|[Ss]econdo)\s+)" + TITLE
)
# What a salutation and a lead-in need at least.
SALUTED = ("Herr", "Frau", "Fr. ", "Hr. ", "Mr", "Ms ", "Ms.", "Miss ", "Mx", "Sir ", "Madam", "Mme", "Mlle", "Mademoiselle", "Monsieur", "M. ", "eñor", "EÑOR", "Sra", "sra", "SRA", "Srta", "srta", "Sr ", "Sr.", "sr ", "sr.", "SR ", "Don ", "don ", "oña ", "evrouw", "EVROUW", "evr.", "evr ", "eneer", "ENEER", "ijnheer", "hr. ", "hr ", "eer ", "ignor", "IGNOR", "Sig.", "sig.", "Sig ")
LED = ("ansprech", "kontakt", "contact", "contacto", "contatto", "referen", "référen", "signed", "gezeichnet", "gez.", "signé", "firmad", "firmat", "getekend", "name ", "name:", "nom ", "nom:", "nombre", "m'appelle", "llamo", "ik heet", "chiamo", "naam", "nome", "vorgesetz", "bewerber", "applicant", "gespräch mit", "talk with", "entretien avec", "conversación con", "gesprek met", "colloquio con", "according to", "laut ", "selon ", "según ", "volgens ", "secondo ")
ENDING_LEAD = re.compile(r"(?i)(?:laut|selon|según|volgens|secondo|according to|gespräch mit|talk with|entretien avec|conversación con|gesprek met|colloquio con)\s+$")
NAME_AFTER = re.compile(r"^\s*(?:[,.;:()\n]|$|(?:hat|ist|war|has|is|was|went|filed|unter|at|au|en el|al|op|a|est|es|è|heeft|ha)\b|Tel\b)")
PLACE_WORDS = re.compile(r"(?:Projekt|project|projet|proyecto|progetto|plan|Plan|machine|Anlage|crew|Gruppe|near|yard at|Lager bei|Hof in|road to|Weg nach)\s+$")


CODE_BEFORE = re.compile(rf"[,;]?\s(?:in\s)?{_CODE}\s")
TOWN_FORM = re.compile(TOWN)
TOWN_BEFORE = re.compile(r",?\s(?:in\s)?(?=[A-ZÄÖÜÀ-Ý])")
CODE_AFTER = re.compile(r",?\s(?:[A-Z]{1,2}[\s\-])?\d{4,5}(?!\d)")


class Towns:
    """Names of towns by their first word, longest first."""

    def __init__(self, names: tuple[str, ...] = ()):
        self.by: dict[str, list[str]] = {}
        for name in sorted(names, key=len, reverse=True):
            if name.strip():
                self.by.setdefault(name.split()[0], []).append(name)

    def at(self, text: str, start: int) -> list[int]:
        """The ends of the town names that may stand at this place: listed ones first, then the one by its form."""
        m = re.compile(r"\S+").match(text, start)
        first = m[0].rstrip(",.;:)") if m else ""
        found = [start + len(n) for n in self.by.get(first, ()) if text.startswith(n, start)]
        form = TOWN_FORM.match(text, start)
        return [*found, *([form.end()] if form else [])]

    def tail(self, text: str, start: int) -> tuple[int, bool] | None:
        """(end, listed) of postcode and town, in either order, behind a street."""
        if m := CODE_BEFORE.match(text, start):
            for end in self.at(text, m.end()):
                return end, self.listed(text[m.end() : end])
        if m := TOWN_BEFORE.match(text, start):
            for end in self.at(text, m.end()):
                if c := CODE_AFTER.match(text, end):
                    return c.end(), self.listed(text[m.end() : end])
        return None

    def listed(self, name: str) -> bool:
        return name in self.by.get(name.split()[0], ())


GIVEN = {n.title() for n in FIRST_NAMES}
FREE = re.compile(rf"(?<![\w'’.\-])(?=(({_G}) ((?:[A-Z]\. )?{_P.replace(chr(92) + 's', ' ')}?{_F}))(?![\w]))")
#: Endings of words that are streets, companies or places and no family names.
NO_FAMILY = re.compile(r"(?i)(?:straße|strasse|gasse|weg|platz|allee|schule|klinik|stiftung|verlag|haus|hotel|gruppe|group|street|road|avenue|university|college|foundation)$")


AT_SIGNS = ("[at", "(at", "{at", "<at", "[ät", "(ät", "[ at", "( at", " at ", " ät ", "arroba", "chiocciola", "arobase", "apenstaartje")
DIGIT_RUN = re.compile(r"\d(?:[^\w\n]{0,3}[A-Z]?[^\w\n]{0,3}\d){5,}")
CODE_RUN = re.compile(r"(?<!\w)[A-Z][A-Z0-9]{8,15}(?!\w)")


def _joined(zones: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zones):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _within(pattern: re.Pattern, text: str, zones: list[tuple[int, int]]) -> Iterator[re.Match]:
    for a, b in zones:
        yield from pattern.finditer(text, a, b)


def _streets(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of every street with its house number."""
    for m in HOUSE.finditer(text):
        at = m.start()
        before = text[max(0, at - STREET_LOOK) : at]
        words = before.split()[-2:] if before[-1:].isspace() else []
        if words and words[-1].lower() in ("n.", "nº", "n°"):
            words.pop()
        if words and words[-1][0].isupper() and len(words[-1]) > 2:
            for k, pattern in enumerate(STREETS_BEFORE):
                if s := pattern.search(before):
                    yield k, at - len(before) + s.start(1), HOUSE_REST.match(text, at).end()
        for k, pattern in enumerate(STREETS_AFTER, len(STREETS_BEFORE)):
            if s := pattern.match(text, at):
                yield k, at, s.end()


def _before(text: str, at: int, size: int = 48) -> str:
    return text[max(0, at - size) : at]


def valid(shape: str, span: str) -> bool:
    """Whether the check digits of an identity number of this shape are right, for the shapes that have some."""
    d = re.sub(r"\D", "", span)
    if shape == "dni":
        number = d if span[0].isdigit() else str("XYZ".index(span[0])) + d
        return span[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23]
    if shape == "nir":
        return len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])
    if shape == "nine":
        return sum(int(c) * w for c, w in zip(d, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0
    if shape == "tax" or (shape == "long" and len(d) == 11):
        rest = 10
        for c in d[:10]:
            total = (int(c) + rest) % 10 or 10
            rest = total * 2 % 11
        return (11 - rest) % 10 == int(d[10])
    if shape == "long" and len(d) == 10:
        return (11 - sum(int(c) * w for c, w in zip(d, range(10, 1, -1))) % 11) % 11 == int(d[9])
    return False


def features(text: str, start: int, end: int) -> int:
    span = text[start:end]
    bits = (not text[:start].rstrip(" \t") or text[:start].rstrip(" \t").endswith("\n")) if start < 40 else text[start - 40 : start].rstrip(" \t").endswith("\n")
    after = text[end : end + 40].lstrip(" \t.,;")
    found = (bits, not after or after.startswith("\n"), len(span.split()) >= 3, span.isupper(), len(span) > 25, any(c.isdigit() for c in span))
    return sum(1 << i for i, f in enumerate(found) if f)


NO_TOWNS = Towns()


@lru_cache(maxsize=1)
def _automata():
    """Automata over the strings that salutations, first names (as they stand), lead-ins and spelled addresses (in lower case) need."""
    try:
        import ahocorasick
    except ImportError:
        return None  # the patterns are then searched for in the whole text, with the same result
    plain, low = ahocorasick.Automaton(), ahocorasick.Automaton()
    for automaton, groups in ((plain, (("salutation", SALUTED), ("given", {n + " " for n in GIVEN}))), (low, (("lead", LED), ("at", AT_SIGNS)))):
        for kind, words in groups:
            for w in words:
                automaton.add_word(w, (kind, len(w)))
        automaton.make_automaton()
    return plain, low


def _beginnings(text: str, hits: list[tuple[int, int]], back: int) -> list[int]:
    """Where the words of these hits (end, length) begin, and the `back` words before each."""
    out: set[int] = set()
    for end, size in hits:
        at = end - size + 1
        for _ in range(back + 1):
            while at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_'’"):
                at -= 1
            out.add(at)
            if at == 0 or text[at - 1] not in " \t":
                break
            at -= 1
    return sorted(out)


def _found_at(pattern: re.Pattern, text: str, hits: list[tuple[int, int]] | None, back: int) -> Iterator[re.Match]:
    """The matches of a pattern that begins at a word, from those of its strings that were hit; in the whole text without hits."""
    if hits is None:
        yield from pattern.finditer(text)
        return
    past = -1
    for at in _beginnings(text, hits, back) if hits else ():
        if at >= past and (m := pattern.match(text, at)):
            past = m.end()
            yield m


def candidates(text: str, towns: Towns = NO_TOWNS) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes of LABELERS) of every span that is proposed; votes are 1, 0 or -1."""
    out: list[tuple[str, int, int, tuple[int, ...]]] = []
    low = text.lower()
    hits: dict[str, list[tuple[int, int]] | None] = {"salutation": [], "given": [], "lead": [], "at": []}
    automata = _automata()
    if automata is None:
        hits = dict.fromkeys(hits)
    else:
        for automaton, own in zip(automata, (text, low)):
            for end, (kind, size) in automaton.iter(own):
                hits[kind].append((end, size))
        if len(low) != len(text):
            hits["lead"] = None  # places in the lower-case text are not those in the text
    if "@" in text or hits["at"] is None or hits["at"]:
        for m in EMAIL.finditer(text):
            span = m[1]
            strict = 1 if EMAIL_STRICT.fullmatch(span) else 0
            top = re.split(r"[^A-Za-zäöüß]+", span)[-1]
            before = 1 if re.search(r"(?i)(?:mail|schreiben sie an|write to|écrivez à|escribe a|schrijf naar|scrivi a|an|to|à|a|naar|[(,:])\s*$", _before(text, m.start(1))) else 0
            out.append(("EMAIL", m.start(1), m.end(1), (1 if len(top) >= 2 else -1, strict, before, 0, 1 if re.search(r"(?i)(?:com|org|net|de|eu|fr|es|it|nl|uk|example|invalid|test|info|io)$", span) else 0, 0, 1 if re.match(r"[^\W\d_]", span) else 0)))
    # Numbers and streets are only looked for around runs of digits, which few stretches of a text have.
    zones = [(max(0, m.start() - 12), min(len(text), m.end() + 40)) for m in DIGIT_RUN.finditer(text)]
    zones += [(max(0, m.start() - 2), min(len(text), m.end() + 4)) for m in CODE_RUN.finditer(text)]
    if zones:
        zones = _joined(zones)
        for m in _within(PHONE, text, zones):
            span = m[1]
            n = sum(c.isdigit() for c in span)
            if not 7 <= n <= 15:
                continue
            before = _before(text, m.start(1))
            against = -1 if AGAINST.search(before) or ID_LABEL.search(before) else 0
            labelled = -1 if ID_LABEL.search(before) else 0
            strict = 1 if re.match(r"\+|\(", span) or (span.startswith("00") and n >= 11) or re.fullmatch(r"(?:1[\-. ])?\(?\d{3}\)?[\-. ]\d{3}[\-. ]\d{4}", span) or re.fullmatch(rf"0[1-9]\d{{0,5}}(?:{_S}\d+){{1,5}}|0[1-9]\d{{8,10}}", span) else 0
            odd = -1 if re.match(r"0000|000[ \-]", span) else 1
            out.append(("PHONE", m.start(1), m.end(1), (odd, strict, -1 if against else 1 if PHONE_BEFORE.search(before) else 0, 0, labelled, against, 1 if 9 <= n <= 13 else 0)))
        for name, pattern, telling in ID_SHAPES:
            for m in _within(pattern, text, zones):
                span = m[1]
                if sum(c.isdigit() for c in span) < 2:
                    continue
                before = _before(text, m.start(1), 60)
                labelled = ID_LABEL.search(before)
                against = -1 if AGAINST.search(before) or (not labelled and PHONE_BEFORE.search(before)) else 0
                out.append(("ID_NUMBER", m.start(1), m.end(1), (1 if telling else 0 if labelled else -1, 1 if telling else 0, 1 if labelled else -1, 0, 0, against, 1 if valid(name, span) else 0)))
    for k, start, end in _streets(text):
        t = towns.tail(text, end)
        span = text[start:end]
        before = 1 if ADDRESS_BEFORE.search(_before(text, start)) else 0
        named = 1 if t and t[1] else 0
        halls = -1 if re.match(r"(?i)(?:halle|hall|raum|room|seite|kapitel|im projekt|in halle|zum projekt)\b", span) or re.search(r"(?i)projekt|project", span) else 0
        prep = 0 if k == 0 and re.match(r"(?:Am|An|Im|In|Zum|Zur|Auf|Unter|Hinter|Vor|Beim)\s", span) and not re.search(r"(?:gasse|straße|strasse|str\.|weg|steig|winkel|platz|ufer|allee|ring|damm|stock|berg|hof|tor|markt|graben|park|hain|grund)\b", span) else 1
        number = re.search(r"\d+", span)
        out.append(("ADDRESS", start, t[0] if t else end, (1, prep, before, 1 if t else 0, named, halls, 1 if number and len(number[0]) <= 3 else 0)))
    seen: set[tuple[int, int]] = set()

    def propose(at: int, salutation: bool, ending: bool) -> None:
        for name, form in NAME_FORMS:
            m = form.match(text, at)
            if not m:
                continue
            span, end = m[1], m.end(1)
            words = [w for w in re.split(r"[\s,]+", span) if w]
            if words[0].lower() in STARTERS and words[0].lower() not in FIRST_NAMES and not re.match(_P, span) and not re.match(_PK, span):
                continue
            given = [w for w in words if w.lower() in FIRST_NAMES]
            if name == "full":
                last = words[-1].lower()
                short = re.match(rf"{_G}\s[A-Z]\.", span)
                if last in STARTERS or (short and not ending and re.match(r"\s+[a-zà-ÿ]", text[end : end + 3]) and not NAME_AFTER.match(text[end : end + 12])) or (short and not ending and re.match(r"\s+[a-zà-ÿ]", text[end : end + 3])):
                    if salutation or not short:
                        continue
                    end = at + short.end()
                    span = text[at:end]
                    name = "short"
            if name == "caps" and not given and salutation:
                continue
            if salutation and name in ("full", "caps_turned", "turned", "short") and not given:
                continue
            add(at, end, name, bool(given), salutation, True)
            return
        if salutation:
            m = FAMILY.match(text, at)
            if m and m[1].lower() not in STARTERS:
                add(at, m.end(1), "family", False, True, True)

    def add(start: int, end: int, form: str, given: bool, salutation: bool, led: bool) -> None:
        if (start, end) in seen:
            return
        seen.add((start, end))
        after = text[end : end + 40]
        contact = 1 if NAME_AFTER.match(after) or (led and re.match(r"\s*\n|\s+[A-ZÄÖÜ]", after)) else -1 if led else 0
        against = -1 if PLACE_WORDS.search(_before(text, start)) or re.match(r"\s+(?:crew|machine|plan|GmbH|AG|KG|SE|Ltd|Inc|B\.V|S\.A|Consulting|Engineering|Logistik|Software|Straße|Street)\b", after) else 0
        if against and not led:
            return  # a company, project or place that bears a person's name
        words = [w for w in re.split(r"[\s,]+", text[start:end]) if w]
        plausible = 1 if len(words) > 1 and words[-1].lower() not in STARTERS and words[0].lower() not in STARTERS else 0
        out.append(("NAME", start, end, (1 if form != "family" else 0, 1 if salutation else 0, 1 if led else 0, contact, 1 if given else 0, against, plausible)))

    for m in _found_at(SALUTATION, text, hits["salutation"], 1):
        propose(m.end(), True, False)
    for m in _found_at(LEAD, text, hits["lead"], 2):
        at = m.end()
        s = None if text.startswith("M. ", at) else SALUTATION.match(text, at)  # after a lead-in M. is an initial
        propose(s.end() if s else at, bool(s), bool(ENDING_LEAD.search(m[0])))
    # Names in free text: a first name of the gazetteer and a family name behind it, where nothing else was proposed.
    if hits["given"] is None or hits["given"]:
        taken = list(seen)
        for m in FREE.finditer(text) if hits["given"] is None else filter(None, (FREE.match(text, at) for at in _beginnings(text, hits["given"], 0))):
            start, end = m.start(1), m.end(1)
            if m[2] not in GIVEN or any(start < b and a < end for a, b in taken):
                continue
            family = m[3].split(" ")[-1]
            if family.lower() in STARTERS or m[3].split(" ")[0].lower() in STARTERS or NO_FAMILY.search(family):
                continue
            add(start, end, "full", True, False, False)
    return out


def encode(votes: tuple[int, ...], bits: int = 0) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code << len(FEATURES) | bits


def decode(code: int) -> tuple[tuple[int, ...], int]:
    """The votes and the features of a code."""
    bits = code & ((1 << len(FEATURES)) - 1)
    code >>= len(FEATURES)
    out = []
    for _ in LABELERS:
        out.append(code % 3 - 1)
        code //= 3
    return tuple(reversed(out)), bits


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (posterior of each pattern, how often each labeler's votes for and against are right).

    Votes are taken as independent given the truth; a labeler that votes is right with a probability of its own, which
    starts at ASSUMED. What is assumed counts for PRIOR_VOTES votes, so that labelers that hardly ever vote keep it and
    the corpus decides about all others; a labeler that is right less than half of the time is one that tells nothing.
    """
    votes = patterns != 0
    yes = patterns > 0
    assumed = np.array(ASSUMED[: patterns.shape[1]])
    right = np.stack([assumed, assumed], axis=1)  # of votes for, and of votes against
    share = prior
    posterior = np.full(len(patterns), share)
    for _ in range(rounds):
        log_true = np.log(share) + (votes * np.where(yes, np.log(right[:, 0]), np.log(1 - right[:, 1]))).sum(axis=1)
        log_false = np.log(1 - share) + (votes * np.where(yes, np.log(1 - right[:, 0]), np.log(right[:, 1]))).sum(axis=1)
        posterior = 1 / (1 + np.exp(np.clip(log_false - log_true, -50, 50)))
        w = posterior * counts
        share = np.clip((w.sum() + PRIOR_VOTES * prior) / (counts.sum() + PRIOR_VOTES), 0.02, 0.9)
        for j in range(patterns.shape[1]):
            plus, minus = votes[:, j] & yes[:, j], votes[:, j] & ~yes[:, j]
            right[j, 0] = np.clip((w[plus].sum() + PRIOR_VOTES * assumed[j]) / (counts[plus].sum() + PRIOR_VOTES), 0.5, 0.998)
            right[j, 1] = np.clip(((counts - w)[minus].sum() + PRIOR_VOTES * assumed[j]) / (counts[minus].sum() + PRIOR_VOTES), 0.5, 0.998)
    return posterior, right


def train_classifier(x: np.ndarray, counts: np.ndarray, posterior: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model over the columns of x and a constant, fitted to the posteriors by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.sqrt(counts / counts.sum())
    theta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weights * (p - posterior)) + ridge * theta
        hessian = (x * (weights * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return theta


def columns_of(codes: list[int]) -> np.ndarray:
    """Votes for, votes against and features of codes, as columns of the classifier."""
    own = [decode(c) for c in codes]
    votes = np.array([v for v, _ in own])
    bits = np.array([[b >> i & 1 for i in range(len(FEATURES))] for _, b in own])
    return np.hstack([votes > 0, votes < 0, bits]).astype(float)


def fit(counts: list[tuple[str, int, int]]) -> dict[tuple[str, int], float]:
    """Probability of every (kind, code) from the corpus counts."""
    table = {}
    for kind in KINDS:
        own = [(code, n) for k, code, n in counts if k == kind]
        if not own:
            continue
        by_votes: dict[tuple[int, ...], float] = {}
        for code, n in own:
            votes = decode(code)[0]
            by_votes[votes] = by_votes.get(votes, 0.0) + n
        posterior, _ = reliabilities(np.array(list(by_votes)), np.array(list(by_votes.values())))
        of = dict(zip(by_votes, posterior))
        x = columns_of([code for code, _ in own])
        n = np.array([c for _, c in own], dtype=float)
        theta = train_classifier(x, n, np.array([of[decode(code)[0]] for code, _ in own]))
        for (code, _), p in zip(own, 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1])))):
            table[kind, code] = float(p)
    return table


def settle(found: list[tuple[str, int, int, int]], table: dict[tuple[str, int], float], least: float = 0.5) -> list[tuple[str, int, int]]:
    """The accepted spans of a text, without overlaps, in order."""
    scored = sorted(((table.get((k, code), 0.0), e - s, k, s, e) for k, s, e, code in found), key=lambda x: (-(x[0] >= 0.5), -x[1] if x[0] >= 0.5 else 0, -x[0], x[3]))
    taken: list[tuple[str, int, int]] = []
    for p, _, kind, s, e in scored:
        if p >= least and all(e <= a or s >= b for _, a, b in taken):
            taken.append((kind, s, e))
    return sorted(taken, key=lambda x: x[1])


def scan(df: DataFrame, id_col: str, text_col: str, towns: tuple[str, ...], keep_text: bool = False) -> DataFrame:
    """(id, kind[], found_text[], start[], stop[], code[]) of every text with a proposed span; with keep_text of every row, and its text."""
    shared = df.sparkSession.sparkContext.broadcast(towns)
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Towns(shared.value)
        for batch in batches:
            ids, rows, texts = [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = candidates(text, names) if text else []
                if found or keep_text:
                    ids.append(id_)
                    rows.append(found_columns(text, found))
                    texts.append(text)
            columns = [pa.array(c, t) for c, t in zip(([r[i] for r in rows] for i in range(5)), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, *([pa.array(texts, pa.string())] if keep_text else [])], ["id", "kind", "found_text", "start", "stop", "code", *(["text"] if keep_text else [])])

    return source.mapInArrow(run, "id long, kind array<string>, found_text array<string>, start array<int>, stop array<int>, code array<int>" + (", text string" if keep_text else ""))


def found_columns(text: str, found: list[tuple[str, int, int, tuple[int, ...]]]) -> tuple[list, ...]:
    return [f[0] for f in found], [text[f[1] : f[2]] for f in found], [f[1] for f in found], [f[2] for f in found], [encode(f[3], features(text, f[1], f[2])) for f in found]


def vote_counts(scanned: DataFrame) -> list[tuple[str, int, int]]:
    """(kind, code, count) over the whole corpus: at most 5 x 3^7 x 2^6 rows, of which a few hundred occur."""
    pairs = scanned.select(F.explode(F.arrays_zip("kind", "code")).alias("x"))
    return [(r.kind, r.code, r.n) for r in pairs.groupBy(F.col("x.kind").alias("kind"), F.col("x.code").alias("code")).agg(F.count("*").alias("n")).collect()]


def town_names(places: DataFrame | None, name_col: str = "place_name", most: int = TOWNS) -> tuple[str, ...]:
    """The gazetteer of towns; a list of more than `most` names is refused, for it goes to all workers."""
    if places is None:
        return ()
    names = places.select(name_col).where(f"{name_col} is not null").distinct()
    if names.count() > most:
        raise ValueError(f"a gazetteer of over {most} towns does not fit on every worker")
    return tuple(r[0] for r in names.orderBy(name_col).collect())


def find_personal(df: DataFrame, places: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (id_col, kind, found_text) of the personal data in every text, exactly as it stands there.

    Null and empty texts hold nothing; very long texts are read whole; repeated rows and repeated finds give one row; null
    ids come out as null; without a list of places towns are recognised by their form alone.
    """
    scanned = write_once(scan(df, id_col, text_col, town_names(places)))
    shared = df.sparkSession.sparkContext.broadcast(fit(vote_counts(scanned)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                by = {(s, e): t for s, e, t in zip(row["start"], row["stop"], row["found_text"])}
                for kind, s, e in settle(list(zip(row["kind"], row["start"], row["stop"], row["code"])), shared.value):
                    out.append((row["id"], kind, by[s, e]))
            out = list(dict.fromkeys(out))
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["id", "kind", "found_text"])

    return scanned.mapInArrow(run, "id long, kind string, found_text string").withColumnRenamed("id", id_col).distinct()


def redact(df: DataFrame, places: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, redacted): every text with each find replaced by [KIND]; null stays null, the rest is unchanged."""
    scanned = write_once(scan(df, id_col, text_col, town_names(places), keep_text=True))
    shared = df.sparkSession.sparkContext.broadcast(fit(vote_counts(scanned)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["text"]
                if text:
                    parts, at = [], 0
                    for kind, s, e in settle(list(zip(row["kind"], row["start"], row["stop"], row["code"])), own):
                        parts += [text[at:s], f"[{kind}]"]
                        at = e
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "redacted"])

    return scanned.mapInArrow(run, "id long, redacted string").withColumnRenamed("id", id_col)
