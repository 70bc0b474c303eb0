"""Cards of listing pages: anchors with the text around them, and the words that tell shows from everything else."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.html import HIDDEN, VOID, resolve_href

# Parts of a path that name its entries as shows, and parts that name some kind of entry.
STRONG_PATHS = (
    "exhibition", "ausstellung", "exposition", "mostra", "mostre", "exposicion", "exposicao", "tentoonstelling", "on-view", "utstilling",
    "utstallning", "utställning", "udstilling", "nayttely", "näyttely", "wystawa", "vystava", "výstava", "kiallitas", "kiállítás", "sergi",
    "izlozba", "izložba", "razstava", "naroda", "vystavka", "выставка", "permanent", "dauerausstellung", "basutstallning", "basutställning",
)
WEAK_PATHS = ("whats-on", "what-s-on", "display", "event", "programme", "program", "calendar", "agenda")
# Words of links that are navigation, commerce, archives or staff.
SKIP_WORDS = (
    "cookie", "privacy", "newsletter", "subscribe", "donate", "membership", "shop", "tickets", "book now", "buy", "gift", "search", "menu",
    "accessibility", "terms", "contact", "press", "jobs", "careers", "view all", "see all", "show all", "load more", "next", "previous",
    "filter", "sort", "sign in", "log in", "register", "français", "deutsch", "biljett", "biljetter", "köp biljett", "entré", "öppettider", "kontakt",
    "tidigare", "past exhibition", "previous exhibition", "archive", "arkiv", "archiv", "sarchiv", "team ", "unser team", "mitarbeiter", "staff",
    "medarbetare", "personal", "vergangene", "vroegere", "mostre passate", "exposiciones anteriores", "expositions passées", "aiemmat",
    "tulevat", "upcoming exhibition", "kommande", "kommende", "à venir", "proximas", "próximas", "prossime",
)
# Kinds of entries that aren't shows.
OTHER_KINDS = (
    "guided tour", "guided visit", "workshop", "concert", "lecture", "screening", "conference", "performance", "reading", "masterclass",
    "symposium", "seminar", "webinar", "course", "family activity", "introduction to the exhibition", "introduktion till utställningen",
    "curator's tour", "curator tour", "artist talk", "gallery talk", "einführung in die ausstellung", "visite commentée",
    "visite guidée", "atelier", "rencontre", "projection", "spectacle", "führung", "vortrag", "werkstatt", "rondleiding", "lezing",
)
# Labels of buttons that stand in for a title.
BUTTONS = (
    "find out more", "read more", "learn more", "see more", "more info", "more information", "discover", "explore", "view", "details",
    "en savoir plus", "découvrir", "decouvrir", "plus d'infos", "mehr erfahren", "weiterlesen", "meer info", "lees meer",
    "saber más", "scopri", "ver más", "läs mer",
)
# What a label says of the link before it names anything.
AFFORDANCES = (
    "gå till sidan ", "ga till sidan ", "gå till ", "läs om ", "las om ", "go to page ", "go to ", "read about ", "read more about ", "more about ",
    "link to ", "navigate to ", "visit page ", "zur seite ", "mehr über ", "mehr ueber ", "aller à la page ", "en savoir plus sur ",
    "ga naar ", "lees over ", "siirry sivulle ", "gå til siden ",
)
# Kinds before a title, adjectives of permanence behind the kind, and tails behind a title.
KINDS = ("Youth exhibition", "Exhibition", "Ausstellung", "Exposition", "Mostra", "Tentoonstelling", "Display", "Event", "Teens")
ADJECTIVES = ("permanente", "permanenta", "permanentes", "permanenti", "permanent", "dauerhaft", "stała", "stálá")
TAILS = (" Until ", " From ", " Now on", " Nu te zien", " Verwacht", " FREE", ": Plan your visit", " Plan your visit", " Book now", " Book tickets")
# Words and paths of shows without an end, and phrases that mean the contrary.
PERMANENT = (
    "permanent", "dauerausstellung", "ständige ausstellung", "standige ausstellung", "basutställning", "basutstallning", "fast utställning", "fasta utställningar",
    "fast udstilling", "faste udstillinger", "fast utstilling", "faste utstillinger", "perusnäyttely", "pysyvä näyttely", "vaste collectie", "vaste opstelling",
    "wystawa stała", "stała wystawa", "stálá expozice", "stálá výstava", "állandó kiállítás", "постоянная экспозиция", "постоянная выставка",
)
CLOSED = ("permanently closed", "permanent closure", "permanently shut", "permanent stängt", "dauerhaft geschlossen", "définitivement fermé")
PERMANENT_PATHS = (
    "permanent", "dauerausstellung", "basutstallning", "basutställning", "fasta-utstallningar", "fast-utstallning", "faste-udstillinger",
    "vaste-collectie", "vaste-opstelling", "wystawa-stala", "stala-wystawa",
)
# Words and paths of pages on which a museum describes itself.
INFO_WORDS = (
    "museum information", "museiinformation", "museumsinformation", "about the museum", "about us", "about", "visit", "plan your visit",
    "what we offer", "what to see", "see and do", "things to see", "om museet", "om oss", "besök", "besok", "besøk", "vieraile",
    "besuch", "besuchen", "über uns", "uber uns", "informationen", "visiter", "visite", "à propos", "a propos", "informations",
    "visita", "visitar", "informazioni", "información", "informacion", "bezoek", "over het museum", "over ons",
)
INFO_PATHS = ("/visit", "/en/visit", "/plan-your-visit", "/about", "/en/about", "/museiinformation", "/om-museet", "/besok", "/besuch", "/visite", "/bezoek", "/visita", "/informazioni")
#: Times read of one card.
MOST_TIMES = 8


class _Tree(HTMLParser):
    """Visible pieces of text and, for each open element, the piece at which it began."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.size = [0]  # letters before each piece
        self.elements: list[list] = []  # tag, parent, first piece, end, attributes
        self.open: list[int] = []
        self.hidden = 0
        self.times: list[tuple[int, str]] = []  # element, datetime
        self.title: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        a = dict(attrs)
        if tag == "title" and self.title is None:
            self.title = []
        self.elements.append([tag, self.open[-1] if self.open else -1, len(self.pieces), None, a])
        if tag == "time" and a.get("datetime"):
            self.times.append((len(self.elements) - 1, a["datetime"]))
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[k]][0] == tag:
                for e in self.open[k:]:
                    self.elements[e][3] = len(self.pieces)
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.title is not None and self.open and self.elements[self.open[-1]][0] == "title":
            self.title.append(data)
        if not self.hidden and (piece := " ".join(data.replace("\xad", "").split())):
            self.pieces.append(piece)
            self.size.append(self.size[-1] + len(piece) + 1)

    def end_of(self, e: int) -> int:
        return len(self.pieces) if self.elements[e][3] is None else self.elements[e][3]

    def text(self, e: int) -> str:
        return " ".join(self.pieces[self.elements[e][2] : self.end_of(e)])

    def letters(self, e: int) -> int:
        return max(0, self.size[self.end_of(e)] - self.size[self.elements[e][2]] - 1)


def read_cards(html: str | None, base: str | None) -> tuple[str, list[dict]]:
    """(heading, cards) of a page: its title with its first heading, and every link to a page.

    A card has the link's own text, a label (for readers of screens, else a heading in it, else the text), the text of
    the largest element around the link that is at most three times its text, or 300 letters, and that element's times.
    """
    t = _Tree()
    t.feed(html or "")
    t.close()
    named = {"title": " ".join("".join(t.title or ()).split())}
    heads: dict[int, str] = {}
    times: dict[int, list[str]] = {}
    for e, (tag, parent, *_) in enumerate(t.elements):
        if tag in ("h1", "h2") and "head" not in named and t.text(e):
            named["head"] = t.text(e)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and len(t.text(e)) >= 4:
            while parent >= 0:
                if t.elements[parent][0] == "a":
                    heads.setdefault(parent, t.text(e))
                    break
                parent = t.elements[parent][1]
    for e, when in t.times:
        while e >= 0:  # a card's times are those below it
            if len(own := times.setdefault(e, [])) < MOST_TIMES:
                own.append(when[:10])
            e = t.elements[e][1]
    cards = []
    for e, (tag, parent, _, _, a) in enumerate(t.elements):
        href = resolve_href(base, a["href"]) if tag == "a" and a.get("href") else None
        if not href:
            continue
        text, card, most = t.text(e), e, max(3 * t.letters(e), 300)
        while parent >= 0 and t.letters(parent) <= most:
            card = parent if t.letters(parent) > t.letters(card) or times.get(parent) and not times.get(card) else card
            parent = t.elements[parent][1]
        label = next((x for k in ("aria-label", "title") if len(x := (a.get(k) or "").strip()) >= 4), None) or heads.get(e) or text
        cards.append({"pos": len(cards), "href": href, "text": text, "label": label, "context": t.text(card), "times": times.get(card, [])})
    return " ".join(named.values()).strip(), cards


def page_cards(pages: DataFrame) -> DataFrame:
    """(page_id, url, heading, pos, href, text, label, context, times): the cards of pages (page_id, url, html).

    Each page is parsed once, in Arrow batches; a null page has no cards.
    """
    names = ["page_id", "url", "heading", "pos", "href", "text", "label", "context", "times"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for pid, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                heading, cards = read_cards(html, url)
                for c in cards:
                    for column, v in zip(out, (pid, url, heading, c["pos"], c["href"], c["text"], c["label"], c["context"], c["times"])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    schema = "page_id bigint, url string, heading string, pos int, href string, text string, label string, context string, times array<string>"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-case text holds one of the words; false for a null one."""
    return F.coalesce(c.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def path_of(url: Column) -> Column:
    """Path of a URL in lower case, without slashes at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://[^/?#]*|[?#].*$", ""), r"^/+|/+$", "")


def path_sections(path: Column) -> Column:
    """Parts of a path before its last one, joined; empty for a flat path."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def names_permanent(text: Column) -> Column:
    """Whether a text says that a show has no end."""
    low = F.lower(text)
    return has_any(low, PERMANENT) & ~has_any(low, CLOSED)


def is_other_kind(text: Column) -> Column:
    return has_any(F.lower(text), OTHER_KINDS)


# Shapes of dates, told only far enough to cut a title before them.
_FIRST_DATE = r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}\.?(?:er|st|nd|rd|th|º|°)?\s+(?:de\s+)?\p{L}{3,12}\.?\s+(?:de\s+)?\d{4}|\p{Lu}\p{L}{2,11}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}"


def first_date_at(text: Column) -> Column:
    """Position (from 1) of the first date-like stretch of a text; 0 if there is none."""
    return F.regexp_instr(text, F.lit(_FIRST_DATE))


def clean_title(text: Column) -> Column:
    """A title without tags, the kind and venue before it, what the link does, dates and badges behind it.

    What stands before a title goes only if four letters are left, what stands behind it only from the fifth on.
    """
    out = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>?", " "), r"\s+", " "))
    out = F.regexp_replace(out, rf"^.*(?:{'|'.join(KINDS)})(?![\p{{L}}'])[\s:–—-]*(?=.{{4}})", "")
    out = F.regexp_replace(out, rf"(?i)^(?:{'|'.join(ADJECTIVES)}) [\s:–—-]*(?=.{{4}})", "")
    out = F.regexp_replace(out, rf"(?i)^(?:{'|'.join(AFFORDANCES)})\s*(?=.{{4}})", "")
    out = F.regexp_replace(out, rf"^(.{{4,}}?)(?:{_FIRST_DATE}).*$", "$1")
    out = F.regexp_replace(out, rf"^(.{{4,}}?)(?:{'|'.join(TAILS)}).*$", "$1")
    return F.regexp_replace(out, r"^[\s,;:–—-]+|[\s,;:–—-]+$", "")


def title_from_slug(path: Column) -> Column:
    """The last part of a path as words; empty if it has no letter."""
    slug = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[a-z]{2,5}$|^\d{4}[-_.]\d{2}[-_.]\d{2}[-_.]*", ""), r"[-_+.]+", " "))
    return F.when(slug.rlike(r"\p{L}"), F.concat(F.upper(F.substring(slug, 1, 1)), F.substring(slug, 2, 400))).otherwise("")
