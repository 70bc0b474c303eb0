"""Rules on titles, countries, addresses, robots files and links, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import filled

# Words that make an article a venue, and families of words that make it something else.
VENUE = r"\b(museums?|museo|musée|galler(y|ies)|science cent(re|er)|planetarium|historic house|art cent(re|er)|memorial hall|heritage cent(re|er))\b"
REJECTS = (
    ("person", r"\b(born|artist|painter|sculptor|curator|politician|historian|architect)\b"), ("organisation", r"\b(company|association|foundation|university|publisher)\b"),
    ("work", r"\b(painting|sculpture|novel|film|album|song|book)\b"), ("event", r"\b(battle|festival|award|competition|election)\b"),
)
LIFE_SPAN = r"\(\s*(born\s+)?\d{4}\s*([–-]\s*\d{2,4}\s*)?\)"


def classify(title: Column, namespace: Column, is_disambiguation: Column, description: Column) -> Column:
    """struct<decision, reason> of an article: accept, reject or unsure, tests in order."""
    text = F.lower(F.concat_ws(" ", title, description))
    kind = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    out = F.when(namespace != 0, kind("reject", "namespace")).when(is_disambiguation, kind("reject", "disambiguation")).when(F.lower(title).rlike("^lists? of "), kind("reject", "list"))
    out = out.when(text.rlike(VENUE), kind("accept", "venue"))
    for name, p in REJECTS:
        out = out.when(text.rlike(p), kind("reject", name))
    return out.when(F.coalesce(description, F.lit("")).rlike(LIFE_SPAN), kind("reject", "life span")).otherwise(kind("unsure", "no evidence"))


def canonical_country(c: Column, spellings: dict[str, str]) -> Column:
    """Country of a spelling, with or without a leading "the"; null for an unknown one. ``spellings``: lower case -> name."""
    table = F.create_map(*(F.lit(x) for kv in spellings.items() for x in kv))
    low = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.regexp_replace(low, r"^the\s+", "")))


def country_in_title(title: Column, spellings: dict[str, str]) -> Column:
    """Country after the last " in ", else " at ", else " of "."""
    tail = lambda w: canonical_country(F.regexp_extract(title, rf"(?i)^.*\s{w}\s+(.+)$", 1), spellings)
    return F.coalesce(tail("in"), tail("at"), tail("of"))


def country_in_description(description: Column, spellings: dict[str, str]) -> Column:
    """Country after the last comma, else after the last " in "."""
    bare = F.regexp_replace(description, r"[.\s]+$", "")
    return F.coalesce(canonical_country(F.element_at(F.split(bare, ","), -1), spellings), canonical_country(F.regexp_extract(bare, r"(?i)^.*\sin\s+(.+)$", 1), spellings))


def street_line(a: Column) -> Column:
    return F.nullif(F.concat_ws(" ", filled(a.house_number), filled(a.road)), F.lit(""))


def locality_of(a: Column) -> Column:
    """Town of an address by precedence."""
    return F.coalesce(*(filled(a[f]) for f in ("city", "town", "village", "borough", "suburb", "state")))


def geocode_query(name: Column, locality: Column, country: Column) -> Column:
    """Distinct filled parts, joined; parts that differ in case alone count once."""
    parts = F.filter(F.array(name, locality, country), lambda x: x.isNotNull() & (F.trim(x) != ""))
    first = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, lambda y: F.lower(F.trim(y))), F.lower(F.trim(x))) == i + 1)
    return F.array_join(F.transform(first, lambda x: F.trim(x)), ", ")


def address_line(a: Column) -> Column:
    """An address on one line: street, postcode and town, country; null for an empty one."""
    town = F.nullif(F.concat_ws(" ", filled(a.postcode), locality_of(a)), F.lit(""))
    return F.nullif(F.concat_ws(", ", street_line(a), town, filled(a.country)), F.lit(""))


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, prefix, allow) for all agents, from robots files (host, text): the groups of "*" alone, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for host, text in zip(b.column("host").to_pylist(), b.column("text").to_pylist()):
                mine = naming = False
                for line in (text or "").splitlines():
                    name, _, value = line.split("#", 1)[0].partition(":")
                    name, value = name.strip().lower(), value.strip()
                    if name == "user-agent":
                        mine, naming = (mine and naming) or value == "*", True
                    elif name in ("allow", "disallow"):
                        naming = False
                        if mine and value:
                            rows.append((host, value, name == "allow"))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_()))], ["host", "prefix", "allow"])

    return files.select("host", "text").mapInArrow(run, "host string, prefix string, allow boolean")


def allowed_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed): longest matching prefix wins, an allow wins a draw. rules: host, prefix, allow."""
    hit = paths.join(rules.filter("prefix <> ''"), "host", "left").withColumn("n", F.when(F.col("path").startswith(F.col("prefix")), F.length("prefix")))
    g = hit.groupBy("host", "path").agg(F.max(F.when(F.col("allow"), F.col("n"))).alias("a"), F.max(F.when(~F.col("allow"), F.col("n"))).alias("d"))
    return g.select("host", "path", (F.coalesce("a", F.lit(-1)) >= F.coalesce("d", F.lit(-1))).alias("allowed"))


def link_score(text: Column, path: Column) -> Column:
    """How likely a link leads to the programme: words of the label twice, "current" twice, the path, and few steps."""
    low = F.lower(text)
    score = F.when(low.rlike(r"exhibition|what.?s on|programme|ausstellung|exposition|mostr[ae]|exposici[oó]n|выставк|展覧会|展览"), 2).otherwise(0)
    score = score + F.when(low.rlike(r"current|now|aktuell|en cours|in corso|actual"), 2).otherwise(0) + F.when(F.lower(path).rlike(r"exhibition|whats-on|ausstellung|exposition|mostre|exposicion"), 1).otherwise(0)
    steps = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    return F.when(low.rlike(r"past|archiv|vergangen|passé|passat|anterior"), F.lit(-1)).otherwise(score + F.when((score > 0) & (steps <= 1), 1).otherwise(0))


def strong_only(candidates: DataFrame, page: str, strong: str) -> DataFrame:
    """Candidates of a page; if any is strong, its weak ones go."""
    any_strong = candidates.groupBy(page).agg(F.max(strong).alias("_any"))
    return candidates.join(any_strong, page).filter(F.col(strong) | ~F.col("_any")).drop("_any")
