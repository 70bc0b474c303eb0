"""Queries over texts and pages: dates in prose, listing pages, list entries, catalogue tree, tagged elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import cards, wikitext
from vitrine.functions.dates import date_range
from vitrine.operators import listings
from vitrine.operators.search import placed
from vitrine.sources import readers
from vitrine.session import table


def _escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _ranges(s, d):
    """First date range of every document."""
    r = table(s, d, "documents").select("doc_id", date_range("text").alias("r"))
    return r.select("doc_id", F.col("r.start").cast("string").alias("starts_on"), F.col("r.end").cast("string").alias("ends_on"), F.col("r.permanent").alias("permanent")).filter("starts_on IS NOT NULL OR ends_on IS NOT NULL OR permanent")


def _page_of(s, d):
    """Listings as cards of pages, some twenty to a page, between navigation and other links: page_id, url, html."""
    e = table(s, d, "exhibitions").filter("url IS NOT NULL").select("exhibition_id", "url", "title", "starts_on", "ends_on").distinct()
    time = lambda c: F.coalesce(F.format_string('<time datetime="%s">', F.col(c).cast("string")), F.lit(""))
    card = F.concat(F.lit('<article><a href="'), _escape(F.col("url")), F.lit('#top"><h3>'), _escape(F.coalesce("title", F.lit(""))), F.lit("</h3>"), F.when(F.col("starts_on").isNotNull(), time("starts_on")).otherwise(""), F.when(F.col("ends_on").isNotNull(), time("ends_on")).otherwise(""), F.lit('</a><a href="mailto:x@y.example">mail</a></article>'))
    # ids are dense: a page has twenty listings and their repeats
    pages = e.groupBy(F.floor(F.col("exhibition_id") / 20).alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(card)), "\n").alias("cards"))
    head = "<html><head><title>What's on</title></head><body><script>var a='<a href=/no>no</a>'</script><nav><a href='https://n.example/'>Home</a></nav><h1>Shows</h1><p>" + "The house by the river shows what its people made, kept and traded. " * 6 + "</p>"
    return pages.select("page_id", F.lit("https://n.example/exhibitions/").alias("url"), F.concat(F.lit(head), "cards", F.lit("</body></html>")).alias("html"))


def _pages(s, d):
    """The cards of those pages, read back: link, title and machine-readable run."""
    a = cards.page_cards(_page_of(s, d)).filter("href <> 'https://n.example/'")
    two = F.size("times") >= 2
    return a.select(F.col("href"), F.trim("text").alias("title"), F.when(two, F.array_min("times")).alias("first_day"), F.when(two, F.array_max("times")).alias("last_day"))


def _shows(s, d):
    """Every source page as a page of its own site: candidates, runs and admission of all listings, merged by title."""
    p = _page_of(s, d).select("page_id", "url", F.regexp_replace("html", 'href="https?://[^/"]+/', 'href="https://n.example/exhibitions/').alias("html"))
    today = F.lit("2026-06-01").cast("date")
    found = listings.admitted(listings.with_runs(listings.candidates(cards.page_cards(p)), today), today)
    return listings.merged_titles(found, "page_id").select("page_id", "title", "href", "permanent", F.col("starts_on").cast("string").alias("starts_on"), F.col("ends_on").cast("string").alias("ends_on"))


def _lists(s, d):
    """Every museum as a bullet of a list page, read back: title and the town it stands under."""
    m = table(s, d, "museums").filter("name IS NOT NULL AND locality IS NOT NULL").select("id", F.trim(F.regexp_replace("name", r"[\[\]{}|<>'\s]+", " ")).alias("t"), F.trim(F.regexp_replace("locality", r"[\[\]{}|<>'\s=]+", " ")).alias("l")).filter("t <> '' AND l <> ''")
    body = F.concat(F.lit("== "), F.col("l"), F.lit(" ==\n* [["), F.col("t"), F.lit("]] {{cite|{{x}}}} <ref>a</ref>\n== See also ==\n* [[Other]]\n"))
    return m.select("id", F.explode(wikitext.list_entries(body)).alias("e")).select("id", "e.title", "e.locality")


def _tree(s, d):
    """The catalogue as a graph: source, country, town; countries are handed down to towns."""
    m = table(s, d, "museums").filter("country IS NOT NULL AND trim(locality) <> ''")
    top = m.select(F.explode("sources").alias("s"), "country").distinct().select(F.concat(F.lit("s:"), "s").alias("parent"), F.concat(F.lit("c:"), "country").alias("child"), F.col("country").alias("hint"))
    low = m.select("country", "locality").distinct().select(F.concat(F.lit("c:"), "country").alias("parent"), F.concat(F.lit("t:"), "locality").alias("child"), F.lit(None).cast("string").alias("hint"))
    roots = m.select(F.explode("sources").alias("s")).distinct().select(F.concat(F.lit("s:"), "s").alias("node"), F.lit(None).cast("string").alias("hint"))
    w = readers.walk(top.unionByName(low), roots)
    return w.select("node", F.col("depth").cast("bigint").alias("depth"), "hint")


def _elements(s, d):
    """Raw records as map elements, projected to venues."""
    r = table(s, d, "source_records")
    e = r.select(F.lit("node").alias("type"), F.col("record_id").alias("id"), "location.lat", "location.lon", F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), F.map_concat(F.map_filter("tags", lambda k, v: ~k.isin("name", "website")), F.map_from_arrays(F.array(F.lit("name"), F.lit("website")), F.array(F.coalesce("name", F.lit("")), F.coalesce("website", F.lit(""))))).alias("tags"))
    v = readers.tagged_venues(e)
    return v.select("element", "name", "lat", "lon", "website", "verified")


QUERIES = {
    "document_dates": _ranges,
    "listing_pages": _pages,
    "listing_shows": _shows,
    "list_entries": _lists,
    "catalogue_tree": _tree,
    "tagged_venues": _elements,
    "geojson_points": lambda s, d: placed(table(s, d, "museums")).select("id", "lat", "lon"),
}

SQL = {
    "listing_pages": """
SELECT url AS href, coalesce(trim(regexp_replace(title, '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')), '') AS title,
  CASE WHEN starts_on IS NOT NULL AND ends_on IS NOT NULL THEN CAST(least(starts_on, ends_on) AS VARCHAR) END AS first_day,
  CASE WHEN starts_on IS NOT NULL AND ends_on IS NOT NULL THEN CAST(greatest(starts_on, ends_on) AS VARCHAR) END AS last_day
FROM (SELECT DISTINCT exhibition_id, url, title, starts_on, ends_on FROM exhibitions WHERE url IS NOT NULL)""",
    "list_entries": """
WITH m AS (SELECT id, trim(regexp_replace(name, '[\\[\\]{}|<>''\\s]+', ' ', 'g')) AS t, trim(regexp_replace(locality, '[\\[\\]{}|<>''\\s=]+', ' ', 'g')) AS l FROM museums WHERE name IS NOT NULL AND locality IS NOT NULL),
s AS (SELECT id, regexp_replace(regexp_replace(t, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', ''), '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '') AS title,
  trim(regexp_replace(l, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS locality FROM m WHERE t <> '' AND l <> '')
SELECT id, title, locality FROM s""",
    "catalogue_tree": """
WITH m AS (SELECT country, locality, sources FROM museums WHERE country IS NOT NULL AND trim(locality) <> ''),
s AS (SELECT DISTINCT unnest(sources) AS s, country FROM m),
t AS (SELECT locality, min(country) AS hint FROM m WHERE country IN (SELECT country FROM s) GROUP BY 1)
SELECT DISTINCT 's:' || s AS node, CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS hint FROM s
UNION ALL SELECT DISTINCT 'c:' || country, 1, country FROM s
UNION ALL SELECT 't:' || locality, 2, hint FROM t""",
    "tagged_venues": """
SELECT 'node/' || record_id AS element, name, location.lat AS lat, location.lon AS lon, nullif(website, '') AS website, false AS verified FROM source_records
WHERE (tags['tourism'] IN ('museum', 'gallery') OR tags['amenity'] = 'arts_centre' OR tags['historic'] = 'museum') AND name <> ''""",
    "geojson_points": "SELECT id, location.lat AS lat, location.lon AS lon FROM museums WHERE location.lat BETWEEN -90 AND 90 AND location.lon BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lon = 0)",
}
