"""The main text of HTML pages by selectors."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Where pages keep a posting, the most telling first: (attribute, part of its value), or a tag.
PLACES = (
    ("class", "job-description"), ("class", "jobDescription"), ("class", "job_description"), ("class", "posting-description"), ("class", "job-detail"), ("class", "jobDetail"), ("class", "vacancy-description"), ("id", "job-description"), ("id", "jobDescription"), ("data-testid", "description"),
    ("data-testid", "job"), (".", "job-posting-section"), (".", "job-content"), (".", "posting-content"), (".", "content-section"), ("tag", "article"), ("role", "main"), ("tag", "main"), (".", "content"), ("tag", "body"),
)
DROPPED = {"script", "style", "nav", "footer", "header", "noscript"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SPACE = re.compile(r"[ \t\n\r\f\v]+")


class _Page(HTMLParser):
    """Elements as (tag, attributes, first piece of text, behind the last one) in the order of their start tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.elements: list[list] = []
        self.open: list[int] = []
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        if tag not in EMPTY:
            self.open.append(len(self.elements))
            self.elements.append([tag, {k: v or "" for k, v in attrs}, len(self.pieces), None])

    def handle_endtag(self, tag):
        if not any(self.elements[i][0] == tag for i in self.open):
            return
        while self.open:
            e = self.elements[self.open.pop()]
            e[3] = len(self.pieces)
            if e[0] in DROPPED:
                self.dropped -= 1
            if e[0] == tag:
                return

    def handle_data(self, data):
        if not self.dropped and data.strip(" \t\n\r\f\v"):
            self.pieces.append(data)


def main_text(html: str | None, least: int = 200) -> str | None:
    """The text of the first place of at least `least` characters, squeezed; null if no place has so many."""
    if not html:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    for kind, value in PLACES:
        for tag, attrs, start, end in page.elements:
            if tag == value if kind == "tag" else value in attrs.get("class", "").split() if kind == "." else value == attrs.get(kind) if kind == "role" else value in attrs.get(kind, ""):
                text = SPACE.sub(" ", " ".join(page.pieces[start:end])).strip(" ")
                if len(text) >= least:
                    return text
                break  # only the first element of a selector is looked at
    return None


@F.pandas_udf(StringType())
def html_main_text(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action="ignore").astype(object).where(lambda s: s.notna(), None)
