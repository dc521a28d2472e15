"""Site lines mixed with the main content of pages (problem 6).

A site style tree over the lines of same-host pages. The distinct pages of a host are merged: every line is a content node of its
host (the line in normal form) below a presentation node (the form of the line: its length, separators, marks at its ends).
A content node found on n of a host's m pages has the entropy log n / log m over the pages, in base m, and the importance
1 minus that (on more than BASE pages 1 + log(n / m) / log BASE, which keeps what a share of the pages means). The importance of a branch is composed of the node's own and of the nodes on both sides of it: site furniture
stands among nodes that recur or have the form of furniture, while a heading of the posting recurs just as much, but its
branch continues into lines that are found once. Presentation nodes have the importance that their lines have on average,
first on their own host, then on all hosts, so that lines with ever new content (teasers, breadcrumbs) and small hosts are
judged by what is known of their form; counts weigh in continuously, there is no least size of a host or a line.

Lists of words in six languages (menu entries, buttons, cookie notices) enter as a prior: a line of a listed form is removed
on little evidence of the tree, other lines need the tree alone. Without the tree nothing is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from jobsieve.llm.lines import SENT_ROWS, host, key, looked_up, normalised
from jobsieve.session import write_once

#: Evidence of the tree (0 content, 1 furniture) from which on a line is removed if no list has its form; its steepness and
#: the weight of the lists, in logits: a listed line is removed from THRESHOLD - LISTED / STEEPNESS on.
THRESHOLD, STEEPNESS, LISTED = 0.45, 14.0, 5.5
#: Share of the form, against the entropy, in what a line tells its neighbours; share of the form in a presentation node;
#: share of the sides, against the node itself, in a content node.
FORM_TOLD, FORM_OWN, SIDES = 0.6, 0.5, 0.5
#: Pages from which on a node's entropy depends on the share of the pages that have it alone, and not on their number as well.
BASE = 1000.0
#: Pages that the presentation node counts for beside a content node's own, and all hosts beside one host.
CONTENT_PRIOR, HOST_PRIOR = 2.0, 20.0
#: What a side without neighbours is taken for.
NEUTRAL_CONTENT, NEUTRAL_FORM = 0.2, 0.3

_NAV = (
    "home|start|startseite|inicio|accueil|menu|menü|menú|find jobs|jobs|stellen|stellensuche|jobsuche|stellenangebote|empleos|ofertas|offres|offres d'emploi|vacatures|offerte|offerte di lavoro|employers|companies|arbeitgeber|unternehmen|empresas|employeurs|entreprises|"
    "werkgevers|bedrijven|aziende|career advice|ratgeber|karriereratgeber|consejos|conseils|loopbaantips|consigli|salaries|salary|gehaltsvergleich|gehalt|gehälter|salarios|sueldos|salaires|salarissen|stipendi|saved|saved jobs|merkliste|merkzettel|guardados|favoritos|"
    "favoris|bewaard|favorieten|preferiti|salvati|sign in|log in|login|sign up|register|anmelden|einloggen|registrieren|entrar|iniciar sesión|registrarse|connexion|se connecter|s'inscrire|inloggen|registreren|accedi|registrati|post a job|stelle inserieren|job inserieren|publicar oferta|"
    "publier une offre|vacature plaatsen|pubblica annuncio|jobletter|newsletter|für firmen|für arbeitgeber|for employers|para empresas|pour les entreprises|voor bedrijven|per le aziende|search|suche|buscar|recherche|zoeken|cerca|skip to content|zum inhalt|back to top|nach oben|my account|mein konto|mi cuenta|mon compte|mijn account|il mio account|help|hilfe|ayuda|aide|faq|blog"
)
_LEGAL = (
    "imprint|impressum|legal notice|privacy|privacy policy|datenschutz|datenschutzerklärung|terms|terms of use|terms of service|agb|nutzungsbedingungen|accessibility|barrierefreiheit|contact|contact us|kontakt|press|presse|sitemap|cookie settings|cookie-einstellungen|cookies|cookie policy|"
    "aviso legal|privacidad|condiciones|contacto|accesibilidad|prensa|mentions légales|confidentialité|conditions|accessibilité|colofon|voorwaarden|toegankelijkheid|pers|note legali|condizioni|contatti|accessibilità|stampa"
)
_ABOUT = r"(?:about|über|sobre|à propos de|à propos d'|over|chi siamo|su|informazioni su)"
NAV_ITEM, LEGAL_ITEM = set(_NAV.split("|")), set(_LEGAL.split("|"))
ABOUT_ITEM = re.compile(rf"(?i)^{_ABOUT}\s?\S+(?: \S+){{0,3}}$")
SEPARATOR = re.compile(r"\s+[·|›»>/•–\-]\s+|\s{2,}|\t")
CRUMB = re.compile(r"\s+[›»>/]\s+")
COPYRIGHT = re.compile(r"(?i)^\W*(?:©|\(c\)|copyright)\s*.{0,60}\d{4}|^.{0,60}(?:all rights reserved|alle rechte vorbehalten|todos los derechos reservados|tous droits réservés|alle rechten voorbehouden|tutti i diritti riservati)\W*$")
COOKIE = re.compile(
    r"(?i)^(?:(?:we|this (?:web)?site|our (?:web)?site|wir|diese (?:web)?seite|unsere (?:web)?seite|usamos|utilizamos|este sitio|nous|ce site|wij|we|deze (?:web)?site|usiamo|utilizziamo|questo sito)\b.{0,40}\bcookies?\b.{0,160}"
    r"|(?:by clicking|mit (?:einem )?klick auf|mit dem klick auf|durch klicken|indem (?:du|sie)|al hacer clic|al pulsar|al aceptar|en cliquant|door (?:te klikken|op)|cliccando|facendo clic).{0,160}"
    r"|(?:accept|allow|agree to) (?:all|cookies|and close)(?: cookies)?|(?:alle|cookies)(?: cookies)? (?:akzeptieren|zulassen|annehmen)|akzeptieren|aceptar(?: todo| todas| cookies)?|tout accepter|accepter(?: tout| et fermer)?|alles? (?:accepteren|toestaan)|accepteren|accetta(?: tutto| tutti)?"
    r"|reject (?:all|non-essential|optional)(?: cookies)?|decline(?: all)?|only (?:necessary|essential)(?: cookies)?|nur (?:notwendige|erforderliche|essenzielle)(?: cookies)?(?: akzeptieren)?|(?:alle )?ablehnen|rechazar(?: todo)?|solo necesarias|continuer sans accepter|(?:tout )?refuser|(?:alles )?weigeren|alleen noodzakelijke(?: cookies)?|rifiuta(?: tutto)?|solo necessari"
    r"|(?:manage|cookie) (?:preferences|settings|options)|(?:cookie-?)?einstellungen(?: verwalten| anpassen)?|(?:gestionar|configurar) (?:preferencias|cookies)|(?:gérer|paramétrer) (?:mes |les )?(?:préférences|cookies)|personnaliser|voorkeuren beheren|cookie-?instellingen|gestisci (?:le )?preferenze|personalizza)\W*$"
)
BUTTON = re.compile(
    r"(?i)^(?:share|teilen|compartir|partager|deel|delen|condividi)\b(?:[^.!?]{0,60})$"
    r"|^(?:print|print (?:ad|job|page|this page)|drucken|seite drucken|imprimir(?: oferta)?|imprimer|(?:af)?drukken|printen|stampa(?: annuncio)?)\W*$"
    r"|^(?:save|bookmark)(?: this)?(?: job| ad| posting| search)?\W*$|^(?:job|stelle|anzeige) (?:merken|speichern)\W*$|^merken\W*$|^guardar(?: oferta| empleo| anuncio)?\W*$|^(?:enregistrer|sauvegarder)(?: l'offre| cette offre)?\W*$|^(?:vacature )?bewaren\W*$|^bewaar(?: deze)?(?: vacature)?\W*$|^salva(?: annuncio| offerta)?\W*$"
    r"|^(?:report|flag)(?: this)?(?: ad| job| posting| listing)\W*$|^(?:diese )?(?:anzeige|stelle) melden\W*$|^denunciar(?: este)?(?: anuncio| oferta)?\W*$|^signaler(?: l'annonce| cette annonce| cette offre)?\W*$|^meld (?:deze )?(?:advertentie|vacature)\W*$|^segnala(?: questo)?(?: annuncio)?\W*$"
    r"|^(?:apply|apply now|apply here|quick apply|easy apply|one-click apply|jetzt bewerben|hier bewerben|online bewerben|schnellbewerbung|inscribirme|inscríbete|postular(?:me)?|solicitar(?: empleo)?|postuler(?: maintenant)?|je postule|solliciteer(?: nu| direct)?|nu solliciteren|candidati(?: ora| subito)?|invia candidatura)\W*$"
    r"|^(?:copy link|link kopieren|copiar enlace|copier le lien|link kopiëren|copia link|follow (?:us|company)|folge uns|seguir empresa|show (?:map|more jobs)|karte anzeigen|zurück(?: zur übersicht| zur suche)?|back to (?:results|search|overview)|volver|retour(?: aux résultats)?|terug(?: naar overzicht)?|torna ai risultati|load more|mehr laden|next|previous|weiter)\W*$"
)
COUNTER = re.compile(r"(?i)^\d[\d.,]* (?:new |neue |nieuwe )?(?:jobs?|stellen|positions|vacancies|ofertas|empleos|offres|vacatures|offerte|annunci)\b[^.!?]{0,40}(?:yesterday|today|this week|gestern|heute|seit|diese woche|ayer|hoy|hier|aujourd'hui|semaine|gisteren|vandaag|ieri|oggi)\W*$|^\d+ (?:people|personen|personas|personnes|mensen|persone) (?:viewed|haben|han|ont|bekeken|hanno)\b[^.!?]{0,60}$")
MAILING = re.compile(
    r"(?i)^(?:get|receive|erhalte|recibe|reciba|recevez|ontvang|ricevi)\b[^.!?]{0,60}\b(?:mail|e-?mail|inbox|posteingang|correo|courriel|post)\b[^.!?]{0,30}$|^(?:keine (?:stelle|jobs?)|never miss|no te pierdas|ne manquez|mis geen|non perdere)\b[^.!?]{0,80}$|^(?:subscribe|abonniere|suscríbete|abonnez-vous|abonneer|iscriviti)\b[^.!?]{0,60}(?:newsletter|jobletter|alert|mail)[^.!?]{0,20}$|^(?:create|set up) (?:a )?job alert\W*$|^(?:jobalarm|jobagent|suchauftrag) [^.!?]{0,30}$"
    r"|^(?:create|erstelle|erstellen sie|crea|créez|crée|maak|lege?)\b.{0,40}\b(?:profile?|profil|perfil|profiel|profilo|account|konto|lebenslauf)\b.{0,50}$|^(?:upload|lade)\b.{0,20}\b(?:cv|resume|lebenslauf)\b.{0,30}$|^(?:download|get|hol dir|lade|descarga|téléchargez) .{0,20}\bapp\b.{0,20}$"
)
TEASERS = re.compile(
    r"(?i)^(?:(?:similar|related|more|other|recommended|nearby|further) (?:jobs?|positions|vacancies|postings|openings)\b[^.!?]{0,30}|jobs (?:you might like|near you|like this)|people also (?:viewed|searched)\b.{0,20}|(?:you may|you might) also (?:like|be interested in)\b.{0,20}|recommended for you|recently viewed\b.{0,20}"
    r"|(?:ähnliche|weitere|passende|andere|empfohlene|mehr) (?:jobs?|stellen|stellenangebote|anzeigen)\b[^.!?]{0,30}|das könnte (?:dich|sie) auch interessieren|andere (?:suchten|sahen|interessierten)\b.{0,30}|zuletzt angesehen"
    r"|(?:empleos|ofertas|trabajos) (?:parecid|similar|relacionad|recomendad)\w*\b.{0,20}|también te puede interesar|otros (?:usuarios|candidatos)\b.{0,30}|offres? (?:similaires?|d'emploi similaires?|recommandées?)|à voir aussi|vous (?:aimerez|pourriez) (?:aussi|aimer)\b.{0,30}|ces offres\b.{0,40}"
    r"|(?:vergelijkbare|soortgelijke|andere|meer) (?:vacatures|banen|functies)\b.{0,20}|anderen bekeken ook|misschien ook interessant\b.{0,20}|(?:offerte|annunci|lavori) (?:simil|correlat|consigliat)\w*|potrebbe(?:ro)? (?:anche )?interessarti\b.{0,20}|altri hanno (?:visto|visualizzato)\b.{0,20})\W*$"
)
AGO = re.compile(r"(?i)(?:\bvor \d+ (?:tag|stunde|woche|monat|minute)\w*|\b\d+ (?:day|hour|week|month|minute)s? ago|\bil y a \d+ (?:jour|heure|semaine|mois|minute)s?|\bhace \d+ (?:día|hora|semana|mes|minuto)\w*|\b\d+ (?:giorn|or|settiman|mes|minut)\w+ fa|\b\d+ (?:dag|uur|uren|week|weken|maand|minu)\w* geleden)$")
TEASER = re.compile(r"^[^.!?…]{3,110}?(?:\([^()]{1,20}\))?\s+[,–|·\-]\s+[^\s.!?…][^.!?…]{1,70}$")
BULLET = re.compile(r"^(?:[-*•–·▪◦‣]|\d{1,2}[.)])\s")


def ends_sentence(text: str) -> bool:
    """Whether one of . ! ? … : stands behind the last letter or digit."""
    for c in reversed(text):
        if c in ".!?…:":
            return True
        if c.isalnum() or c == "_":
            return False
    return False



FURNITURE = ("copyright", "crumb", "bar", "nav", "legal", "cookie", "button", "counter", "mailing", "teasers", "teaser")


@lru_cache(maxsize=150_000)
def style(line: str) -> str:
    """The presentation of a line on its own."""
    text = line.strip()
    lower = text.lower()
    if lower in NAV_ITEM:
        return "nav"
    if lower in LEGAL_ITEM:
        return "legal"
    if len(text) > 260:
        return "sentence"
    if COPYRIGHT.search(text):
        return "copyright"
    if BULLET.match(text):
        return "item"
    if COOKIE.match(text):
        return "cookie"
    if TEASERS.match(text):
        return "teasers"
    if BUTTON.match(text):
        return "button"
    if COUNTER.match(text):
        return "counter"
    if MAILING.match(text):
        return "mailing"
    if AGO.search(text) and SEPARATOR.search(text):
        return "teaser"
    if not ends_sentence(text):
        parts = [p.strip().lower() for p in SEPARATOR.split(text) if p.strip()]
        if len(parts) >= 2 and all(len(p.split()) <= 6 for p in parts):
            known = sum(p in NAV_ITEM or p in LEGAL_ITEM or bool(ABOUT_ITEM.match(p)) for p in parts)
            if known >= max(2, 0.5 * len(parts)):
                return "bar"
            if CRUMB.search(text) and len(parts) >= 3 and parts[0] in NAV_ITEM:
                return "crumb"
            if CRUMB.search(text) and len(parts) >= 2 and parts[0] in NAV_ITEM and known >= 1:
                return "crumb"
        if TEASER.match(text):
            return "maybe_teaser"
        if ABOUT_ITEM.match(text):
            return "about"
        return "label"
    return "sentence"


def page_styles(lines: list[str]) -> list[str]:
    """The presentation of every line of a page, by its own form and its neighbours'; '' for empty lines."""
    styles = [style(x) if x and not x.isspace() else "" for x in lines]
    n = len(styles)
    # A teaser list: its heading and the lines of the form title - place that follow it, or touch a dated teaser.
    for i, s in enumerate(styles):
        if s in ("teasers", "teaser"):
            j = i + 1
            while j < n and styles[j] in ("maybe_teaser", "teaser"):
                styles[j] = "teaser"
                j += 1
            if j == n - 1 and j > i and styles[j] == "label" and not lines[j].rstrip().endswith((".", "!", "?")):
                styles[j] = "teaser"  # the list was broken off in its last line
            j = i - 1
            while s == "teaser" and j >= 0 and styles[j] == "maybe_teaser":
                styles[j] = "teaser"
                j -= 1
    for i, s in enumerate(styles):
        if s == "about":
            around = {styles[i - 1] if i else "", styles[i + 1] if i + 1 < n else ""}
            styles[i] = "legal" if around & {"legal", "nav"} else "label"
        elif s == "maybe_teaser":
            styles[i] = "label"
    return styles


SEPARATED = re.compile(r"\s+[·|›»>/•–\-,]\s+|\s{2,}|\t")


def form(line: str) -> int:
    """The presentation node of a line, from marks and lengths alone, whatever its language."""
    text = line.strip()
    if BULLET.match(text):
        return 0
    if text.startswith("<"):
        return 1
    words = len(text.split())
    if ends_sentence(text):
        return (2 if words <= 3 else 3 if words < 12 else 4) + (3 if text.endswith(":") else 0)
    separators = min(4, len(SEPARATED.findall(text)))
    size = 0 if words <= 1 else 1 if words <= 3 else 2 if words <= 6 else 3 if words <= 12 else 4
    start = 0 if text[0].isalpha() else 1 if text[0].isdigit() else 2
    return 8 + (separators * 5 + size) * 3 + start


def _told() -> np.ndarray:
    """How much each form looks like site furniture before any page is seen."""
    out = np.zeros(FORMS)
    out[:8] = (0.03, 0.1, 0.2, 0.3, 0.1, 0.2, 0.3, 0.1)
    for separators in range(5):
        for size, plain in enumerate((0.5, 0.45, 0.4, 0.35, 0.1)):
            for start in range(3):
                out[8 + (separators * 5 + size) * 3 + start] = 0.85 if separators else plain + (0.15 if start else 0.0)
    return out


FORMS = 8 + 75
TOLD = _told()
STYLES = ("", *FURNITURE)


def page_nodes(df: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    """(id, host, line_no[], nodes[], forms[], listed[]) of every page that is not blank; the last node is the host itself."""
    source = df.select(F.col(id_col).cast("long").alias("id"), host(F.col(url_col)).alias("host"), F.col(text_col).alias("text"))
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {s: i for i, s in enumerate(STYLES)}
        known: dict[str, tuple[str, int]] = {}
        for batch in batches:
            out: list[tuple] = []
            for id_, host_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                if not text or text.isspace():
                    continue
                lines = text.split("\n")
                styles = page_styles(lines)
                numbers, nodes, forms, listed = [], [], [], []
                for i, s in enumerate(styles):
                    if not s:
                        continue
                    line = lines[i]
                    node = known.get(line)
                    if node is None:
                        if len(known) >= 150_000:
                            known.clear()
                        node = known[line] = (normalised(line), form(line))
                    numbers.append(i + 1)
                    nodes.append(key(host_, node[0]))
                    forms.append(node[1])
                    listed.append(rank.get(s, 0))
                nodes.append(key(host_))
                out.append((id_, nodes[-1], numbers, nodes, forms, listed))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), ints, longs, ints, ints))], ["id", "host", "line_no", "nodes", "forms", "listed"])

    return source.mapInArrow(run, "id long, host long, line_no array<int>, nodes array<long>, forms array<int>, listed array<int>")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One of each page that is the same line by line on its host: copies of a posting are no lines of the site."""
    names = ("id", "host", "line_no", "nodes", "forms", "listed")
    return pages.groupBy(F.xxhash64("nodes").alias("sign")).agg(F.any_value(F.struct(*names)).alias("p")).select("p.*")


def node_counts(pages: DataFrame) -> DataFrame:
    """(key, n): on how many pages each node is found, for nodes found on more than one; hosts are nodes too."""
    nodes = pages.select(F.explode(F.array_distinct("nodes")).alias("key"))
    return nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


class Tree:
    """A batch of pages with counts, as flat arrays over their lines."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.id, self.host = column("id"), column("host").to_numpy(zero_copy_only=False)
        offsets = column("line_no").offsets.to_numpy()
        self.size = np.diff(offsets)
        self.page = np.repeat(np.arange(len(self.size)), self.size)
        flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
        self.line_no, self.form, self.listed = flat("line_no"), flat("forms"), flat("listed")
        node, n = flat("nodes"), flat("nodes_n")
        hosts = np.cumsum(self.size + 1) - 1  # the node of the host ends each list
        lines = np.ones(len(node), dtype=bool)
        lines[hosts] = False
        self.node, self.n = node[lines], np.nan_to_num(n[lines], nan=1.0)
        m = np.maximum(np.nan_to_num(n[hosts], nan=1.0), 2.0)[self.page]
        self.entropy = np.clip(1 + np.log(self.n / m) / np.log(np.minimum(m, BASE)), 0.0, 1.0)
        self.told = TOLD[self.form]
        own = FORM_TOLD * self.told + (1 - FORM_TOLD) * self.entropy
        first = np.concatenate([[True], self.page[1:] != self.page[:-1]]) if len(self.page) else np.zeros(0, dtype=bool)
        last = np.concatenate([first[1:], [True]]) if len(self.page) else first
        self.before = np.where(first, 0.0, np.concatenate([[0.0], own[:-1]])) if len(own) else own
        self.after = np.where(last, 0.0, np.concatenate([own[1:], [0.0]])) if len(own) else own
        self.has_before, self.has_after = ~first, ~last

    def presentation(self) -> np.ndarray:
        """The node of a line's form on its host."""
        return presentation_key(self.host[self.page], self.form)


def presentation_key(host_: np.ndarray, form_: np.ndarray) -> np.ndarray:
    x = host_.astype(np.int64).view(np.uint64) ^ ((form_.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def sides(counted_pages: DataFrame) -> DataFrame:
    """(kind, key, form, before, befores, after, afters, n): what stands on both sides of content nodes (kind 0, those found more than once), of forms on a host (1) and on all hosts (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tree(batch)
            parts = []
            for kind, mask, keys in ((0, t.n > 1, t.node), (1, slice(None), t.presentation()), (2, slice(None), t.form.astype(np.int64))):
                distinct, first, at = np.unique(keys[mask], return_index=True, return_inverse=True)
                sums = [np.bincount(at, weights=w[mask].astype(float), minlength=len(distinct)) for w in (t.before, t.has_before, t.after, t.has_after, np.ones(len(t.n)))]
                parts.append([np.full(len(distinct), kind, dtype=np.int8), distinct, t.form[mask][first].astype(np.int32), *sums])
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "form", "before", "befores", "after", "afters", "n"])

    emitted = counted_pages.mapInArrow(run, "kind byte, key long, form int, before double, befores double, after double, afters double, n double")
    return emitted.groupBy("kind", "key").agg(F.min("form").alias("form"), *[F.sum(c).alias(c) for c in ("before", "befores", "after", "afters", "n")])


def side_score(neutral: float) -> Column:
    """The lower of the two sides' means; a side that is nearly always the border of the page says nothing."""
    a, b = (F.col("before") + neutral) / (F.col("befores") + 1), (F.col("after") + neutral) / (F.col("afters") + 1)
    no_before, no_after = F.col("befores") < 0.05 * F.col("n"), F.col("afters") < 0.05 * F.col("n")
    return F.when(no_before & no_after, F.least(a, b)).when(no_before, b).when(no_after, a).otherwise(F.least(a, b))


def importance(counted_pages: DataFrame) -> DataFrame:
    """(key, score, seen): how little important the branches of content nodes and of forms on a host are, and on how many lines that rests."""
    seen = write_once(sides(counted_pages))
    # There are FORMS forms at most, so that this is a bounded look at the driver.
    everywhere = {r.form: (r.score, r.n) for r in seen.where("kind = 2").select("form", side_score(NEUTRAL_FORM).alias("score"), "n").collect()}
    whole = F.create_map(*[F.lit(x) for form_, (score, _) in sorted(everywhere.items()) for x in (form_, float(score))]) if everywhere else F.create_map().cast("map<int,double>")
    contents = seen.where("kind = 0").select("key", side_score(NEUTRAL_CONTENT).alias("score"), F.col("n").alias("seen"))
    forms = seen.where("kind = 1").select("key", ((F.col("n") * side_score(NEUTRAL_FORM) + HOST_PRIOR * whole[F.col("form")]) / (F.col("n") + HOST_PRIOR)).alias("score"), F.col("n").alias("seen"))
    return contents.unionByName(forms)


def judged(counted_pages: DataFrame, score: DataFrame, sent_rows: int) -> DataFrame:
    """(id, line_no, style) of the lines that are removed."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tree(batch)
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(t.size)]).astype(np.int32)), pa.array(t.presentation()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "shapes"])

    pages = counted_pages.mapInArrow(keyed, StructType([*counted_pages.schema.fields, StructField("shapes", ArrayType(LongType()))]))
    found = looked_up(pages, ["nodes", "shapes"], score, ["score", "seen"], sent_rows)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tree(batch)
            flat = lambda name: batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
            lines = np.ones(int((t.size + 1).sum()), dtype=bool)
            lines[np.cumsum(t.size + 1) - 1] = False
            evidence = branch_evidence(t, flat("nodes_score")[lines], flat("nodes_seen")[lines], flat("shapes_score"))
            out = np.nonzero(STEEPNESS * (evidence - THRESHOLD) + LISTED * (t.listed > 0) >= 0)[0]
            styles = [STYLES[i] or "tree" for i in t.listed[out]]
            yield pa.RecordBatch.from_arrays([t.id.take(pa.array(t.page[out])), pa.array(t.line_no[out].astype(np.int32)), pa.array(styles, pa.string())], ["id", "line_no", "style"])

    return found.mapInArrow(decide, "id long, line_no int, style string")


def branch_evidence(t: Tree, score: np.ndarray, seen: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """How little important each line's branch is, from 0 to 1."""
    base = FORM_OWN * t.told + (1 - FORM_OWN) * np.nan_to_num(shape, nan=0.0)
    known = ~np.isnan(score)
    score, seen = np.where(known, score, 0.0), np.where(known, seen, 0.0)
    own = SIDES * score + (1 - SIDES) * t.entropy * np.minimum(1.0, 2 * score)
    evidence = (seen * own + CONTENT_PRIOR * base) / (seen + CONTENT_PRIOR)
    return np.where((t.size > 1)[t.page], evidence, 0.0)  # the only line of a page is a tree without branches


def find_boilerplate(df: DataFrame, id_col: str = "job_id", text_col: str = "description", url_col: str = "url", sent_rows: int = SENT_ROWS) -> DataFrame:
    """Distinct (id_col, line_no, style) of the non-empty lines that are not part of the main content.

    Lines are split at \\n and counted from 1, empty lines included. style is the listed form of the line or "tree" for lines
    that the tree alone removed. Null and blank texts give nothing; records without a host are one site; repeated rows give
    their lines once; null ids come out as null.
    """
    pages = write_once(page_nodes(df, id_col, text_col, url_col))
    merged = write_once(distinct_pages(pages))
    counts = write_once(node_counts(merged))
    score = importance(looked_up(merged, ["nodes"], counts, ["n"], sent_rows))
    return judged(looked_up(pages, ["nodes"], counts, ["n"], sent_rows), score, sent_rows).withColumnRenamed("id", id_col).distinct()


def main_text(df: DataFrame, id_col: str = "job_id", text_col: str = "description", url_col: str = "url") -> DataFrame:
    """(id_col, main_text): each record's text without the lines that are not part of the main content."""
    lines = find_boilerplate(df, id_col, text_col, url_col).groupBy(id_col).agg(F.collect_set("line_no").alias("out"))
    kept = df.select(id_col, text_col).join(lines, id_col, "left")
    split = F.split(F.col(text_col), "\n")
    body = F.transform(F.filter(F.transform(split, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("no"))), lambda s: ~F.coalesce(F.array_contains(F.col("out"), s["no"].cast("int")), F.lit(False))), lambda s: s["x"])
    return kept.select(id_col, F.when(F.col(text_col).isNotNull(), F.array_join(body, "\n")).alias("main_text"))
