"""Pages: anchors, headings, declared events and visible text through a tolerant parser, in Arrow batches."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Elements whose text nobody sees; elements that never close.
HIDDEN = ("script", "style", "noscript", "template", "svg", "head")
VOID = ("br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track")
# Kinds of declared events that are trusted.
EVENTS = ("ExhibitionEvent", "VisualArtsEvent")
# Parts of an address that make a plain event a show.
EVENT_PATHS = ("exhibition", "ausstellung", "exposition", "mostra", "mostre", "exposicion", "tentoonstelling", "utstallning", "utställning", "nayttely", "wystawa")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.text: list[str] = []
        self.anchors: list[dict] = []
        self.open: list[dict] = []
        self.headings: list[str] = []
        self.heading: list[str] | None = None
        self.blocks: list[str] = []
        self.block: list[str] | None = None
        self.title: list[str] | None = None
        self.titles: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title":
            self.title = []
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.block = []
        if tag in HIDDEN:
            self.hidden += 1
        if tag in ("h1", "h2", "h3"):
            self.heading = []
        if tag == "a" and a.get("href"):
            self.open.append({"href": a["href"], "label": a.get("aria-label") or a.get("title") or "", "text": [], "times": []})
        if tag == "time" and self.open and a.get("datetime"):
            self.open[-1]["times"].append(a["datetime"])

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None:
            self.titles.append(" ".join("".join(self.title).split()))
            self.title = None
        if tag == "script" and self.block is not None:
            self.blocks.append("".join(self.block))
            self.block = None
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in ("h1", "h2", "h3") and self.heading is not None:
            self.headings.append(" ".join("".join(self.heading).split()))
            self.heading = None
        if tag == "a" and self.open:
            self.anchors.append(self.open.pop())

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        if self.block is not None:
            self.block.append(data)
        if self.hidden:
            return
        data = data.replace("\xad", "")
        self.text.append(data)
        if self.heading is not None:
            self.heading.append(data)
        for a in self.open:
            a["text"].append(data)


def resolve_href(base: str | None, href: str) -> str | None:
    """Absolute http(s) URL without fragment, or null for what isn't a page."""
    href = href.strip()
    if not href or href.startswith("#") or href.split(":", 1)[0].lower() in ("javascript", "mailto", "tel", "data"):
        return None
    try:
        url = urldefrag(urljoin(base or "", href))[0]
        return url if urlparse(url).scheme in ("http", "https") else None
    except ValueError:
        return None


def _objects(value):
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _objects(v)
    elif isinstance(value, list):
        for v in value:
            yield from _objects(v)


def _string(v) -> str | None:
    if isinstance(v, list):
        v = v[0] if v else None
    if isinstance(v, dict):
        v = v.get("@value") or v.get("name")
    return v if isinstance(v, str) else None


def declared(blocks: list[str], base: str | None) -> list[dict]:
    """Events declared in JSON blocks; a broken block is skipped and the rest kept."""
    out = []
    for b in blocks:
        try:
            data = json.loads(b)
        except ValueError:
            continue
        for o in _objects(data):
            kinds = o.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            name, url = _string(o.get("name")), resolve_href(base, _string(o.get("url")) or "")
            shown = any(k in EVENTS for k in kinds) or ("Event" in kinds and any(p in urlparse(url or "").path.lower() for p in EVENT_PATHS))
            if name and shown:
                out.append({"title": name, "url": url, "start": (_string(o.get("startDate")) or "")[:10] or None, "end": (_string(o.get("endDate")) or "")[:10] or None})
    return out


def read_page(html: str | None, base: str | None) -> dict:
    """title, headings, text, anchors and declared events of a page; all empty for a null one."""
    p = _Page()
    p.feed(html or "")
    p.close()
    anchors = []
    for n, a in enumerate(p.anchors + p.open[::-1]):
        text = " ".join("".join(a["text"]).split())
        anchors.append({"href": resolve_href(base, a["href"]), "text": text, "title": a["label"] if len(a["label"]) >= 4 else text, "times": a["times"][:8], "pos": n})
    return {"title": p.titles[0] if p.titles else None, "headings": p.headings, "text": " ".join("".join(p.text).split()), "anchors": anchors, "events": declared(p.blocks, base)}


PAGE = "struct<title string, headings array<string>, text string, anchors array<struct<href string, text string, title string, times array<string>, pos int>>, events array<struct<title string, url string, start string, end string>>>"


def page(html: Column, base: Column) -> Column:
    """What ``read_page`` tells of a page, as a struct."""
    return pandas_udf(_pages, PAGE)(html, base)


def _pages(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h, b) for h, b in zip(html, base)], columns=["title", "headings", "text", "anchors", "events"])


# Path parts that are a way of looking at a listing, and sections that a programme lives in.
VIEWS = (
    "list", "lista", "liste", "listing", "page", "sida", "seite", "pagina", "paged", "month", "week", "day", "today",
    "upcoming", "past", "archive", "all", "calendar", "kalender", "grid", "map", "photo", "elenco", "liste-view", "agenda",
)
CONTAINERS = (
    "event", "events", "evenemang", "eventi", "veranstaltungen", "evenementen", "evenements", "exhibition", "exhibitions", "utstallningar",
    "ausstellungen", "mostre", "expositions", "whats-on", "what-s-on", "programme", "program", "programs", "programmes", "kalendarium",
    "permanent", "permanent-exhibitions", "permanent-exhibition", "dauerausstellung", "fasta-utstallningar", "basutstallningar", "vaste-collectie",
)
VIEWS_AND_CONTAINERS = (*VIEWS, *CONTAINERS)


def is_navigation(url: Column, source: Column) -> Column:
    """Whether a link leads to the same page, or only to views, containers and numbers below it."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[?#].*$", ""), r"/+$", "")
    parts = F.filter(F.split(F.regexp_replace(clean(url), r"^https?://[^/]+", ""), "/"), lambda s: s != "")
    return (clean(url) == clean(source)) | F.forall(parts, lambda s: s.isin(*VIEWS_AND_CONTAINERS) | s.rlike(r"^\d+$"))
