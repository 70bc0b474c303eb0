"""Named data-quality checks; each yields findings (check, severity, subject)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.geo import haversine_km, usable
from vitrine.functions.html import is_navigation
from vitrine.functions.rules import canonical_country, country_in_description
from vitrine.functions.text import compact_key, known_country, usable_url

# Labels that are buttons, not titles.
BOILERPLATE = ("read more", "more info", "learn more", "more", "view", "details", "tickets", "book now", "book tickets", "mehr", "weiterlesen", "en savoir plus", "lire la suite", "plus d'infos", "ver más", "leer más", "scopri di più", "buy tickets", "see all", "view all")
# Words that tell a venue from what merely sounds like one.
KEEPERS = "museum|museo|musée|musee|gallery|galerie|galleria|collection|muzeum|музей|博物館|美術館|資料館"
OTHERS = r"\b(school|hotel|restaurant|railway station|football club|record label|album|film|song|novel)\b"


def _find(rows: DataFrame, when: Column, check: str, severity: str) -> DataFrame:
    return rows.filter(F.coalesce(when, F.lit(False))).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col("id").cast("string").alias("subject"))


def audit_museums(museums: DataFrame, countries: DataFrame) -> DataFrame:
    """Findings on museums. ``countries``: name; a fixed reference list.

    Everything but duplicates and outliers is one scan with a generated list of checks.
    """
    lat, lon = F.col("location.lat"), F.col("location.lon")
    there = lat.isNotNull() & lon.isNotNull()
    possible = lat.between(-90, 90) & lon.between(-180, 180)
    zero = haversine_km(lat, lon, F.lit(0.0), F.lit(0.0)) < 1
    known = F.broadcast(countries.select(F.lower("name").alias("known")).distinct())
    m = museums.join(known, F.lower(F.trim("country")) == F.col("known"), "left")
    name = F.coalesce("name", F.lit(""))
    checks = [
        ("no-coordinates", "warning", ~there), ("impossible-coordinates", "error", there & ~possible), ("null-island", "error", there & possible & zero),
        ("unknown-country", "warning", F.col("country").isNotNull() & F.col("known").isNull()),
        ("suspicious-name", "error", (F.trim(name) == "") | name.rlike(r"\[\[|\]\]|\{\{|\}\}|<[a-zA-Z/]")),
        ("no-classes", "info", (F.size("classes") == 0) & F.array_contains("sources", "wikidata")),
        ("not-a-museum", "error", F.lower("description").rlike(OTHERS) & ~F.lower(F.concat_ws(" ", "name", "description")).rlike(KEEPERS)),
        ("unusable-url", "warning", (F.coalesce("website", F.lit("")) != "") & ~usable_url(F.col("website"))),
        ("unusable-url", "warning", (F.coalesce("wikipedia_url", F.lit("")) != "") & ~usable_url(F.col("wikipedia_url"))),
    ]
    each = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"))) for n, s, c in checks)))).alias("f")
    simple = m.select(F.col("id").cast("string").alias("subject"), each).select("f.check", "f.severity", "subject")
    return simple.unionByName(duplicates(museums)).unionByName(outliers(museums))


# Countries that are also a part of another one.
ALSO_PARTS = {"Georgia": ("United States",), "Luxembourg": ("Belgium",), "Mexico": ("Mexico",)}


def contradictions(museums: DataFrame, spellings: dict[str, str]) -> DataFrame:
    """Rows whose country and description name different countries; a name that is also a part of the country doesn't contradict it."""
    stated, told = canonical_country(F.col("country"), spellings), country_in_description(F.col("description"), spellings)
    part = F.lit(False)
    for name, of in ALSO_PARTS.items():
        part = part | ((told == name) & stated.isin(*of))
    return _find(museums, (stated != told) & ~part, "country-contradicts-description", "error")


def in_report_order(findings: DataFrame) -> DataFrame:
    """Errors first, then warnings, then notes; by check, then subject."""
    return findings.orderBy(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2), "check", "subject")


def duplicates(museums: DataFrame) -> DataFrame:
    """Groups of two or more rows of one compact name in one known country; the subject is the key."""
    k = F.concat(compact_key(F.col("name")), F.lit("|"), compact_key(known_country(F.col("country"))))
    g = museums.select(k.alias("key")).filter("key IS NOT NULL AND key NOT LIKE '|%'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.select(F.lit("duplicate-record").alias("check"), F.lit("warning").alias("severity"), F.col("key").alias("subject"))


def duplicate_groups(museums: DataFrame) -> DataFrame:
    """(key, rows, names) of the groups ``duplicates`` tells of; names distinct, sorted and joined."""
    k = F.concat(compact_key(F.col("name")), F.lit("|"), compact_key(known_country(F.col("country"))))
    g = museums.select(k.alias("key"), "name").filter("key IS NOT NULL AND key NOT LIKE '|%'").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("name")).alias("names"))
    return g.filter("rows > 1").select("key", "rows", F.array_join("names", " / ").alias("names"))


def navigation_listings(exhibitions: DataFrame) -> DataFrame:
    """(exhibition_id): listings whose link only leads around the page it was read from; permanent ones are left alone."""
    e = exhibitions.filter("url IS NOT NULL AND NOT coalesce(permanent, false)")
    return e.filter(is_navigation(F.col("url"), F.coalesce("source_page", F.lit("")))).select("exhibition_id").distinct()


def outliers(museums: DataFrame, least: int = 30) -> DataFrame:
    """Rows farther from their country's per-axis upper median than twice the lower-rank 99th percentile, 500 km at least.

    Order statistics are exact and no country is sorted: rows are counted in bins, the bin that holds the rank is found
    among the counts, and only the distinct values of that bin are ranked.
    """
    m = museums.select("id", known_country(F.col("country")).alias("country"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon")).filter(usable(F.col("lat"), F.col("lon")) & F.col("country").isNotNull())
    whole = Window.partitionBy("country")

    def at_rank(rows: DataFrame, value: str, rank: Column, width: float) -> DataFrame:
        """(country, value) of the value at a rank (from 0, in terms of ``n``) of each country with ``least`` rows."""
        binned = rows.select("country", value, F.floor(F.col(value) / width).alias("bin"))
        bins = binned.groupBy("country", "bin").agg(F.count(F.lit(1)).alias("c"))
        bins = bins.withColumns({"n": F.sum("c").over(whole), "before": F.sum("c").over(whole.orderBy("bin")) - F.col("c")})
        held = bins.filter((F.col("n") >= least) & (rank >= F.col("before")) & (rank < F.col("before") + F.col("c"))).select("country", "bin", (rank - F.col("before")).alias("k"))
        values = binned.join(held, ["country", "bin"]).groupBy("country", value, "k").agg(F.count(F.lit(1)).alias("c"))
        values = values.withColumn("before", F.sum("c").over(whole.orderBy(value)) - F.col("c"))
        return values.filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("c"))).select("country", value)

    half = F.floor(F.col("n") / 2)
    mid = at_rank(m, "lat", half, 0.01).withColumnRenamed("lat", "mlat").join(at_rank(m, "lon", half, 0.01).withColumnRenamed("lon", "mlon"), "country")
    d = m.join(mid, "country").withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")))
    p = at_rank(d.select("id", "country", "d"), "d", F.floor((F.col("n") - 1) * 0.99), 1.0).withColumnRenamed("d", "p99")
    out = d.join(p, "country").filter(F.col("d") > F.greatest(F.col("p99") * 2, F.lit(500.0)))
    return out.select(F.lit("coordinates-far-from-country").alias("check"), F.lit("warning").alias("severity"), F.col("id").cast("string").alias("subject"))


def audit_exhibitions(exhibitions: DataFrame, today: date) -> DataFrame:
    """Findings on listings, once a listing and check."""
    e = exhibitions.withColumn("id", F.col("exhibition_id"))
    t = F.lit(today)
    far = lambda c: F.abs(F.datediff(F.col(c), t)) > 3650
    permanent = F.coalesce("permanent", F.lit(False))
    found = [
        _find(e, F.col("ends_on") < F.col("starts_on"), "exhibition-ends-before-it-starts", "error"),
        _find(e, F.coalesce(far("starts_on"), F.lit(False)) | F.coalesce(far("ends_on"), F.lit(False)), "exhibition-dates-implausible", "warning"),
        _find(e, permanent & F.col("ends_on").isNotNull(), "exhibition-permanent-but-ends", "error"),
        _find(e, F.lower(F.trim("title")).isin(*BOILERPLATE), "exhibition-title-is-boilerplate", "error"),
        _find(e, F.datediff(t, F.to_date("scraped_at")) > 30, "exhibition-scrape-stale", "warning"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def report(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("findings"))


# Severities from light to heavy.
SEVERITIES = ("info", "warning", "error")


def at_least(findings: DataFrame, severity: str, check: str = "") -> DataFrame:
    """Findings of a severity or a heavier one, of one check or all."""
    hit = findings.filter(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(severity) :]))
    return hit.filter(F.col("check") == check) if check else hit


def exit_status(findings: DataFrame, fail_on: str) -> int:
    """1 if there is a finding of ``fail_on`` or heavier."""
    return int(not at_least(findings, fail_on).isEmpty())


def shares(findings: DataFrame, exhibitions: DataFrame) -> DataFrame:
    """``report`` with the share of all listings in percent."""
    total = exhibitions.agg(F.count_distinct("exhibition_id").alias("total"))  # one row
    return report(findings).crossJoin(F.broadcast(total)).select("check", "severity", "findings", F.round(F.lit(100.0) * F.col("findings") / F.nullif("total", F.lit(0)), 3).alias("share"))


def samples(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first n findings of each check, by subject."""
    w = Window.partitionBy("check").orderBy("subject")
    return findings.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("check", "severity", "subject", "rn")
