"""Entries of wiki list pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# Sections without entries; namespaces that aren't articles.
SKIPPED = ("see also", "references", "external links", "notes", "sources", "bibliography", "further reading")
NAMESPACES = ("file", "image", "category", "template", "wikipedia", "help", "portal", "user", "special", "talk")
_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")
_HEAD = re.compile(r"^(={2,6})\s*(.*?)\s*\1\s*$")


def strip_templates(s: str) -> str:
    """Text without {{...}}, nested ones included; an unclosed one is kept."""
    out, depth, keep, i = [], 0, 0, 0
    while i < len(s):
        if s.startswith("{{", i):
            if not depth:
                keep = i
            depth += 1
            i += 2
        elif s.startswith("}}", i) and depth:
            depth -= 1
            i += 2
        else:
            if not depth:
                out.append(s[i])
            i += 1
    return "".join(out) + (s[keep:] if depth else "")


def clean(s: str) -> str:
    s = re.sub(r"<!--.*?-->", "", s, flags=re.S)
    s = re.sub(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<gallery.*?</gallery>", "", s, flags=re.S | re.I)
    s = strip_templates(s)
    s = re.sub(r"\[https?://\S+\s*([^\]]*)\]", r"\1", s)
    return re.sub(r"</?[a-zA-Z][^>]*>", "", s)


def plain(s: str) -> str:
    s = _LINK.sub(lambda m: m.group(2) if m.group(2) is not None else m.group(1), s)
    return " ".join(re.sub(r"'{2,}", "", s).split())


def cells_of(line: str, mark: str = "||") -> list[str]:
    """Parts of a table line between marks that don't stand in a link or a template."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(line):
        two = line[i : i + 2]
        if two in ("[[", "{{"):
            depth, i = depth + 1, i + 2
        elif two in ("]]", "}}"):
            depth, i = max(0, depth - 1), i + 2
        elif not depth and line.startswith(mark, i):
            out.append(line[start:i])
            i = start = i + len(mark)
        else:
            i += 1
    return [*out, line[start:]]


def cell(text: str) -> str:
    """What a cell holds, without attributes before a single bar outside links."""
    return cells_of(text, "|")[-1].strip()


def is_article(title: str) -> bool:
    return title.split(":", 1)[0].strip().lower() not in NAMESPACES if ":" in title else True


def entries(text: str | None) -> list[dict]:
    """(title, locality) of the bullets and table rows of a list page, first one of a title only.

    A heading, or a bullet with deeper bullets below it, is the locality of what follows it.
    """
    out: list[dict] = []
    seen: set[str] = set()
    section: str | None = None
    skip = False
    groups: dict[int, str] = {}
    lines = clean(text or "").splitlines()
    header: list[str] = []
    row: list[str] | None = None

    def add(raw: str, place: str | None) -> None:
        links = [m.group(1).strip() for m in _LINK.finditer(raw) if is_article(m.group(1))]
        title = links[0] if links and raw.strip().startswith("[[") else plain(re.split(r"\s[–—-]\s|,\s", raw, maxsplit=1)[0])
        if title and title.lower() not in seen and not title.lower().startswith("list of"):
            seen.add(title.lower())
            out.append({"title": title, "locality": place})

    def end_row() -> None:
        nonlocal row
        if row:
            names = [i for i, h in enumerate(header) if re.search(r"name|museum", h, re.I)]
            places = [i for i, h in enumerate(header) if re.search(r"city|town|location|place", h, re.I)]
            n = names[0] if names else 0
            if n < len(row):
                add(row[n], plain(row[places[0]]) if places and places[0] < len(row) else section)
        row = None

    table = False
    for i, line in enumerate(lines):
        if h := _HEAD.match(line):
            section, skip, groups = plain(h.group(2)) or None, plain(h.group(2)).lower() in SKIPPED, {}
            continue
        if skip:
            continue
        if line.startswith("{|"):
            table, header, row = True, [], None
        elif line.startswith("|}"):
            end_row()
            table = False
        elif table and line.startswith("|-"):
            end_row()
            row = []
        elif table and line.startswith("!"):
            header += [plain(c.split("|")[-1]) for c in re.split(r"!!", line[1:])]
        elif table and line.startswith("|"):
            row = (row or []) + [cell(c) for c in cells_of(line[1:])]
        elif line.startswith("*"):
            depth = len(line) - len(line.lstrip("*"))
            body = line[depth:].strip()
            below = lines[i + 1] if i + 1 < len(lines) else ""
            if below.startswith("*" * (depth + 1)):
                groups = {k: v for k, v in groups.items() if k < depth} | {depth: plain(body)}
                continue
            place = next((groups[k] for k in sorted(groups, reverse=True) if k < depth), section)
            add(body, place)
    end_row()
    return out


def list_entries(c: Column) -> Column:
    return pandas_udf(_lists, "array<struct<title string, locality string>>")(c)


def _lists(texts: pd.Series) -> pd.Series:
    return pd.Series([entries(t) for t in texts])
