"""Visually identical text with different characters: a confusables skeleton.

``skeleton`` decomposes a text, replaces every character by the prototype of its look-alikes and decomposes
again. Texts that look alike have equal skeletons. Case, visible accents and visible punctuation stay
different; width, fonts, ligatures, invisible characters and kinds of spaces don't.

The prototypes of letters and digits are those of the public confusables data, which the session's own Unicode
library holds (``prototypes``): whatever it maps, to one character or several ("m" and "rn"). Without it, as in
functions that run where there is no session, LOOKALIKES stands in. Marks follow MARKS: the public data also equate
kinds of dashes and quotes that a reader tells apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import cut

# Look-alike letters, each before the Latin letter that stands for it.
LOOKALIKES = (
    "АA ВB СC ЕE НH Іl ЈJ КK МM ОO РP ЅS ТT ХX ҮY ԌG ԚQ ԜW ѴV Ӏl "  # Cyrillic capitals
    "аa сc ԁd еe һh іi јj оo рp ԛq ѕs ѵv ԝw хx уy үy ԍg ӏl ҽe "  # Cyrillic small letters
    "ΑA ΒB ΕE ΖZ ΗH Ιl ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϜF ϹC οo νv ϲc ϳj "  # Greek
    "ՕO ՏS ԼL օo ոn սu հh ցg զq "  # Armenian
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ "  # Cherokee
    "ꓐB ꓚC ꓓD ꓰE ꓖG ꓧH ꓲl ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ "  # Lisu
    "Il ıi ɡg ɑa ʋv ǀl"  # Latin
)

# Look-alike marks and strokes, each after its prototype.
MARKS = ("'’‘ʼʹ′＇‛ˈ", "-‐‑‒−﹣", "–﹘", ",‚", ".․", ":∶ː", "/∕⁄", "~∼˜", "|∣", "·∙⋅・･")

_KEEP_APART = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>")
_IGNORED = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}


def _invisible(ch: str) -> bool:
    c = ord(ch)
    return unicodedata.category(ch) == "Cf" or c in _IGNORED or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or 0x180B <= c <= 0x180D


def _unfold(ch: str) -> str:
    """Decomposition of one character that leaves its look unchanged."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    parts = d.split()
    if parts[0] in _KEEP_APART:
        return ch
    if parts[0].startswith("<"):
        parts = parts[1:]
        if len(parts) > 1 and parts[0] == "0020":  # a spacing accent is not a blank with an accent
            return ch
    return "".join(_unfold(chr(int(p, 16))) for p in parts)


class _Unfolded(dict):
    """First decomposition, character by character, as characters are met."""

    def __missing__(self, c: int) -> str | None:
        ch = chr(c)
        if _invisible(ch):
            to = None
        elif unicodedata.category(ch) == "Zs":
            to = " "
        else:
            to = "".join(x for x in _unfold(ch) if not _invisible(x))
        self[c] = to
        return to


_FIRST = _Unfolded()
_THEN = {ord(p[0]): p[1] for p in LOOKALIKES.split()} | {ord(x): m[0] for m in MARKS for x in m[1:]}


def prototypes(spark: SparkSession) -> dict[int, str]:
    """Prototypes of all letters and digits that don't decompose, by the public confusables data of the session's library."""
    ranges = (range(0x21, 0xD800), range(0xF900, 0x10000), range(0x10000, 0x1FC00))
    chars = [ch for r in ranges for ch in map(chr, r) if unicodedata.category(ch)[0] in "LN" and _unfold(ch) == ch]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    alike = checker.getSkeleton(0, "\n".join(chars)).split("\n")
    return {ord(ch): to for ch, to in zip(chars, alike, strict=True) if to != ch} | {c: to for c, to in _THEN.items() if unicodedata.category(chr(c))[0] not in "LN"}


def skeleton(text: str | None, table: dict[int, str] = _THEN) -> str | None:
    """The consistent form of a text; null stays null, a text of invisible characters alone becomes empty.

    Outer blanks can't be seen and are dropped; inner ones count, each as a plain blank.
    """
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFD", text.translate(_FIRST))
        return unicodedata.normalize("NFD", text.translate(table)).strip()
    return text.translate(table).strip()


def entry_forms(museums: DataFrame) -> DataFrame:
    """(id, entry, form) of every name and alias, each string once a row; null and blank entries are left out."""
    table = museums.sparkSession.sparkContext.broadcast(prototypes(museums.sparkSession))  # as long as the public data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([skeleton(t, table.value) for t in b.column("entry").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("entry"), out], ["id", "entry", "form"])

    each = museums.filter("id IS NOT NULL").select(
        "id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("entry")
    )
    return each.filter("entry IS NOT NULL").mapInArrow(run, "id bigint, entry string, form string").filter("form <> ''")


def lookalike_pairs(entries: DataFrame, salts: int = 8) -> DataFrame:
    """(id_a < id_b): rows with entries of equal form that aren't the same string.

    The work is on classes: distinct strings of a form are paired, then expanded to the rows that hold them,
    so a form that fills a third of the rows costs no more than its result. Forms with one spelling are
    dropped by their minimum and maximum before any pair is made, and the expansion is salted.
    """
    strings = entries.groupBy("form", "entry").agg(F.count(F.lit(1)).alias("n"))
    several = strings.groupBy("form").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi")).filter("lo <> hi").select("form")
    classes = strings.join(several, "form", "left_semi").select("form", "entry")
    members = entries.join(several, "form", "left_semi").select("id", "entry", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    a = classes.withColumnRenamed("entry", "s1")
    b = classes.withColumnRenamed("entry", "s2")
    pairs = a.join(b, "form").filter("s1 < s2").select("s1", "s2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    left = pairs.join(members.select(F.col("id").alias("a"), F.col("entry").alias("s1"), "salt"), ["s1", "salt"]).select("a", "s2", "salt")
    right = members.select(F.col("id").alias("b"), F.col("entry").alias("s2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    return left.join(right, ["s2", "salt"]).filter("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def p1_found(museums: DataFrame) -> DataFrame:
    """Rows whose names or aliases look the same and are written with different characters."""
    return lookalike_pairs(cut(entry_forms(museums)))
