"""Date ranges told in prose, as an Arrow function, and rules on ranges as Column expressions."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Month names by their first letters in the languages the sources use, month by month.
MONTHS = (
    "jan gen ene янв ιαν", "feb fév fev фев φεβ", "mar mär мар μαρ", "apr avr abr апр απρ", "may mai mag maj май маи μαϊ μάι", "jun juin giu июн ιουν", "jul juil lug июл ιουλ",
    "aug août aou ago авг αυγ", "sep set сен σεπ", "oct okt ott out окт οκτ", "nov ноя νοε", "dec dez déc dic дек δεκ",
)
_MONTH = {w: i + 1 for i, line in enumerate(MONTHS) for w in line.split()}
# Words for a show without an end, and for an open end or start before a single date.
ONGOING = ("permanent", "ongoing", "dauerausstellung", "permanente", "permanenti", "постоянная", "常設", "常设")
UNTIL = ("until", "through", "bis", "jusqu", "hasta", "fino al", "до", "tot", "έως")
SINCE = ("from", "since", "ab", "seit", "dès", "depuis", "desde", "dal", "с", "vanaf", "από")

_NAME = r"([^\W\d_]{3,12})\.?"
_PATTERNS = (
    ("ymd", re.compile(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b")),
    ("dmy", re.compile(r"\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b")),
    ("d name y", re.compile(rf"\b(\d{{1,2}})\.?(?:er|º|°)?\s+(?:de\s+)?{_NAME}\s+(?:de\s+)?(\d{{4}})\b")),
    ("name d y", re.compile(rf"\b{_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b")),
    ("d name", re.compile(rf"\b(\d{{1,2}})\.?\s+(?:de\s+)?{_NAME}\b")),
)


def month_of(word: str) -> int | None:
    """Month of a name by its first four or three letters."""
    w = word.lower()
    return _MONTH.get(w[:4]) or _MONTH.get(w[:3])


def make_day(y: int, m: int, d: int) -> date | None:
    """A day between 1900 and 2200 that exists."""
    if not 1900 <= y <= 2200:
        return None
    try:
        return date(y, m, d)
    except ValueError:
        return None


def find_days(text: str) -> list[tuple[int, date]]:
    """(offset, day) of every date, patterns in order of trust; a date without a year borrows the last year found."""
    taken: list[tuple[int, int]] = []
    found: list[tuple[int, date]] = []
    bare: list[tuple[int, int, int]] = []
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            g = m.groups()
            if kind == "ymd":
                day = make_day(int(g[0]), int(g[1]), int(g[2]))
            elif kind == "dmy":
                day = make_day(int(g[2]), int(g[1]), int(g[0]))
            else:
                number, name = (g[1], g[0]) if kind == "name d y" else (g[0], g[1])
                month = month_of(name)
                if month is None:
                    continue
                if kind == "d name":
                    bare.append((m.start(), month, int(number)))
                    taken.append(m.span())
                    continue
                day = make_day(int(g[2]), month, int(number))
            if day:
                found.append((m.start(), day))
                taken.append(m.span())
    if found:
        year = max(found)[1].year
        found += [(at, day) for at, month, d in bare if (day := make_day(year, month, d))]
    return sorted(found)


def parse_range(text: str | None) -> tuple[date | None, date | None, bool]:
    """(start, end, permanent) of a text; all empty if it tells no date."""
    if not text:
        return None, None, False
    low = text.lower()
    days = find_days(text)
    if any(w in low for w in ONGOING):
        return (days[0][1] if days else None), None, True
    if not days:
        return None, None, False
    if len(days) == 1:
        at, day = days[0]
        lead = low[max(0, at - 24) : at]
        if any(re.search(rf"(?:^|\W){re.escape(w)}", lead) for w in UNTIL):
            return None, day, False
        if any(re.search(rf"(?:^|\W){re.escape(w)}\W", lead) for w in SINCE):
            return day, None, False
        return day, day, False
    only = [d for _, d in days]
    return min(only), max(only), False


def date_range(c: Column | str) -> Column:
    """struct<start, end, permanent> of a text; never null itself."""
    return pandas_udf(_ranges, "struct<start date, end date, permanent boolean>")(c)


def _ranges(texts: pd.Series) -> pd.DataFrame:
    got = [parse_range(t) for t in texts]
    return pd.DataFrame({"start": [g[0] for g in got], "end": [g[1] for g in got], "permanent": [g[2] for g in got]})


def day_of(c: Column) -> Column:
    """Day in the first ten characters of a text, or null."""
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def open_end(end: Column, today: Column) -> Column:
    """Whether an end lies so far ahead that it means none."""
    return F.coalesce(F.datediff(end, today) > 3652.5, F.lit(False))
