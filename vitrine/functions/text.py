"""Text functions as Column expressions; everything stays in the JVM.

Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decomposition leaves alone and what a plain keyboard types for them.
ONE_LETTER = {"ς": "σ", "ħ": "h", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "ı": "i", "ŧ": "t", "ĸ": "k", "ŋ": "n", "ə": "e"}
TWO_LETTERS = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}


@lru_cache(1)
def _accent_table() -> tuple[str, str]:
    """Every composed letter and its base letter, derived from the Unicode database at plan time."""
    src, dst = [], []
    for c in range(0xC0, min(sys.maxunicode, 0x2FFFF)):
        ch = chr(c)
        if 0xAC00 <= c <= 0xD7A3 or not unicodedata.decomposition(ch) or unicodedata.decomposition(ch).startswith("<"):
            continue
        base = [x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != ch and c < 0x10000:
            src.append(ch)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    src, dst = _accent_table()
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), src, dst)


def fold(c: Column) -> Column:
    """Comparable form: no accents, lower case, everything but letters and digits as single blanks."""
    out = F.lower(strip_accents(c))
    for k, v in TWO_LETTERS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.translate(out, "".join(ONE_LETTER), "".join(ONE_LETTER.values()))
    out = F.regexp_replace(F.regexp_replace(out, r"\p{Mn}+", ""), r"[^\p{L}\p{Nd}]+", " ")
    return F.trim(out)


def tokens(c: Column) -> Column:
    """Distinct words of the folded text in order of appearance; none for an empty text."""
    return F.array_distinct(F.filter(F.split(fold(c), " "), lambda w: w != ""))


def compact_key(c: Column) -> Column:
    """Lower case, letters and digits alone, accents kept."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "")


def clean_name(c: Column) -> Column:
    """Named and numeric entities of markup resolved, format characters dropped, blanks collapsed."""
    out = c
    for name, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&eacute;", "é"), ("&egrave;", "è"), ("&uuml;", "ü"), ("&ouml;", "ö"), ("&auml;", "ä")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    out = F.regexp_replace(out, r"\p{Cf}+", "")
    return F.trim(F.regexp_replace(out, r"[\p{Cc}  \p{Zs}]+", " "))


def slug(c: Column) -> Column:
    """ASCII key of a text; a digest where nothing ASCII is left; 'unknown' for a blank or null text."""
    words = F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9 ]+", ""), r" +", " "))
    dashed = F.replace(words, F.lit(" "), F.lit("-"))
    digest = F.concat(F.lit("x-"), F.substring(F.sha2(F.trim(c), 256), 1, 16))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").when(dashed == "", digest).otherwise(dashed)


def storage_key(prefix: str, country: Column, name: Column) -> Column:
    return F.concat(F.lit(prefix + "/"), slug(country), F.lit("/"), slug(name), F.lit(".json"))


def repair_utf8(c: Column) -> Column:
    """Text of bytes with one U+FFFD for each run of bad bytes."""
    return F.regexp_replace(F.make_valid_utf8(c), "�+", "�")


def site_host(c: Column) -> Column:
    """Lower-case host of an http(s) URL without port and leading www.; null without a scheme."""
    host = F.lower(F.regexp_extract(c, r"(?i)^https?://([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def usable_url(c: Column) -> Column:
    """Whether a text is an http or https URL with a host and without white space; false for null."""
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#\s]+") & ~c.rlike(r"[\s\p{Z}\p{Cc}]"), F.lit(False))


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def known_country(c: Column) -> Column:
    """Null for an empty country or the word unknown in any case."""
    return F.when(F.lower(F.trim(c)).isin("", "unknown"), F.lit(None)).otherwise(c)


def entity_id(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def identity(wikidata_id: Column, normalized: Column, country: Column) -> Column:
    """Row identity: the external id, or else name and country."""
    return F.coalesce(filled(wikidata_id), F.concat(normalized, F.lit("|"), F.coalesce(country, F.lit(""))))


def title_from_slug(path: Column) -> Column:
    """Title told by the last segment of a path; null if digits alone or shorter than three letters are left."""
    last = F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)
    s = F.regexp_replace(last, r"\.[a-zA-Z0-9]{1,5}$", "")
    s = F.regexp_replace(s, r"^(19|20)\d{2}[-_]\d{1,2}[-_]\d{1,2}[-_]", "")
    s = F.regexp_replace(s, r"(?<=[^\d])[-_]\d{1,2}$", "")
    words = F.filter(F.split(F.translate(s, "-_+", "   "), " +"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")
    return F.when((F.length(title) >= 3) & ~title.rlike(r"^[\d ]+$"), title)


def run_label(start: Column, end: Column, permanent: Column) -> Column:
    """A run as people read it."""
    day = lambda c: F.date_format(c, "d MMM yyyy")
    return F.when(permanent, "permanent").when(start.isNull() & end.isNull(), "").when(end.isNull(), F.concat(F.lit("from "), day(start))).when(start.isNull(), F.concat(F.lit("until "), day(end))).otherwise(F.concat(day(start), F.lit(" – "), day(end)))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
