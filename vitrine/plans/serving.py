"""Queries of point reads, matches, resolution, reference folds and the next reads of sites, with their SQL."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from vitrine.functions.text import site_host
from vitrine.operators import lookup, quality, resolve, schedule, search, wiki
from vitrine.plans.catalogue import SQL as CATALOGUE_SQL
from vitrine.plans.catalogue import _HOST, _KNOWN, _LATEST, _fold, _grams, _km, _ok, _sim
from vitrine.plans.states import SPELLINGS, SPLIT, _canon
from vitrine.session import table

TODAY, NOW = date(2026, 6, 1), datetime(2026, 6, 1, tzinfo=timezone.utc)
LAT, LON, KM = 51.5, -3.0, 50.0


def _one(s, d):
    m = table(s, d, "museums")
    return lookup.museum_by(m, str(m.agg(F.min("id")).first()[0])).select("id", "name", "country")


def _page(s, d):
    m = table(s, d, "museums").filter("country = 'Germany'").select("id", "name", "sitelinks")
    return lookup.page_of(m, [F.desc_nulls_last("sitelinks"), F.col("id")], 50, 20)


def _resolved(s, d):
    p = table(s, d, "places").select("query", "found", "location.lat", "location.lon", "radius_km", "resolved_at")
    at = F.lit(SPLIT).cast("timestamp")
    out = lookup.resolve_places(p, p.filter(F.col("resolved_at") < at), p.filter((F.col("resolved_at") >= at) & F.col("found")), table(s, d, "museums"), 0.6)
    return out.select("query", "tier", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("radius_km", 3).alias("radius_km"))


def _hits(s, d):
    g = lookup.first_hits(table(s, d, "gazetteer").filter("lower(name) LIKE '%ber%'"), [F.length("name"), F.col("entry_id")], "entry_id", "name")
    m = lookup.first_hits(table(s, d, "museums").filter("lower(name) LIKE '%salt%'"), [F.desc_nulls_last("sitelinks"), F.col("id")], "id", "name")
    e = lookup.first_hits(table(s, d, "exhibitions").filter("lower(title) LIKE '%licht%'").select("exhibition_id", "title").distinct(), [F.col("exhibition_id"), F.col("title")], "exhibition_id", "title")
    return lookup.merged_hits(g, m, e)


def _classes(s, d):
    m = table(s, d, "museums")
    rows = m.select(F.col("id").alias("item"), F.posexplode("classes").alias("n", "class_id"))
    labels = rows.select("class_id", F.initcap("class_id").alias("label")).distinct()
    return wiki.class_labels(rows, labels).select("item", F.array_join("classes", "|").alias("classes"))


def _restated(s, d):
    r = table(s, d, "source_records").select("wikidata_id", F.col("name").alias("label"), "country", F.lit(None).cast("string").alias("description"), "locality", F.array("source").alias("classes"), F.lit(3).alias("sitelinks"))
    return wiki.restate(table(s, d, "museums"), r).select("id", "name", "country", "locality", F.array_join("classes", "|").alias("classes"), F.array_join("aliases", "|").alias("aliases"), "sitelinks")


def _items(s, d):
    r = table(s, d, "source_records").filter("tags IS NOT NULL")
    first = r.select(F.col("record_id").alias("item"), F.lit(1).alias("n"), F.col("tags").alias("values"))
    then = r.select(F.col("record_id").alias("item"), F.lit(2).alias("n"), F.create_map(F.lit("tourism"), F.lit("checked"), F.lit("visits"), F.concat((F.col("record_id") % 7).cast("string"), F.lit(".0"))).alias("values"))
    out = wiki.merged_item(first.unionByName(then))
    return out.select("item", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e.key, e.value)), "|").alias("parts"), wiki.number_of(F.col("values"), "visits").alias("visits"))


def _next(s, d):
    states = schedule.latest(table(s, d, "site_scrapes"))
    read = states.filter("last_attempt_at IS NOT NULL").select("site", F.when(F.col("consecutive_failures") > 0, "failed").when(F.col("last_change_at") == F.col("last_attempt_at"), "changed").otherwise("unchanged").alias("outcome"))
    closes = search.soonest_close(table(s, d, "exhibitions"), TODAY).select("site", F.col("closes").cast("date").alias("closes"))
    out = schedule.next_reads(states.select("site", "interval_hours", F.greatest(F.col("consecutive_failures") - 1, F.lit(0)).alias("failures")), read, closes, NOW)
    return out.select("site", F.round("interval_hours", 6).alias("interval_hours"), "failures", "parked", F.unix_seconds("due_at").alias("due_s"), "reason")


QUERIES = {
    "museum_by_id": _one,
    "targets_near": lambda s, d: lookup.targets_near(table(s, d, "museums"), site_host(F.col("website")), LAT, LON, KM).select("site", "id", "name", F.round("distance_km", 4).alias("distance_km")),
    "museums_page": _page,
    "show_matches": lambda s, d: lookup.show_matches(table(s, d, "museums"), table(s, d, "exhibitions")),
    "show_counts": lambda s, d: lookup.show_counts(lookup.show_matches(table(s, d, "museums"), table(s, d, "exhibitions"))),
    "exhibition_spots": lambda s, d: lookup.spots(table(s, d, "exhibitions")),
    "days_left": lambda s, d: lookup.running_labels(table(s, d, "exhibitions"), TODAY),
    "resolved_places": _resolved,
    "merged_hits": _hits,
    "to_scrape": lambda s, d: lookup.to_scrape(table(s, d, "museums"), site_host(F.col("website")), (LAT, LON, KM)),
    "class_labels": _classes,
    "country_counts": lambda s, d: wiki.country_counts(table(s, d, "source_records").select("country", F.col("record_id").alias("item")), table(s, d, "gazetteer").filter("kind = 'country'").select(F.col("other_names")[0].alias("country"), F.col("name").alias("label"))),
    "restated": _restated,
    "item_maps": _items,
    "country_contradictions": lambda s, d: quality.contradictions(table(s, d, "museums"), SPELLINGS),
    "next_reads": _next,
    "repaired_positions": lambda s, d: resolve.repaired_positions(table(s, d, "museums"), table(s, d, "places").select("query", "found", "location.lat", "location.lon")).select("id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "tier"),
    "country_codes": lambda s, d: search.country_codes(table(s, d, "gazetteer")),
    "nearby_many": lambda s, d: search.nearby_many(table(s, d, "museums"), table(s, d, "places").select(F.col("place_id").alias("key"), "location.lat", "location.lon"), 2.0).select("key", "id", F.round("distance_km", 4).alias("distance_km")),
    "search_many": lambda s, d: search.search_many(table(s, d, "museums"), table(s, d, "places").select(F.col("place_id").alias("key"), F.col("query").alias("text"))).select("key", "rank", "id", F.round("sim", 4).alias("sim")),
}

_PLACEMENTS = CATALOGUE_SQL["town_placements"]
_SPOT = f"SELECT *, location.lat AS lat, location.lon AS lon FROM {{t}} WHERE {_ok()}"
_MATCH = f"""
WITH m AS (SELECT id, nullif(wikidata_id, '') AS wid, {_fold('name')} AS n FROM museums),
e AS (SELECT DISTINCT exhibition_id, nullif(museum_wikidata_id, '') AS wid, {_fold('museum')} AS n FROM exhibitions),
j AS (SELECT m.id, exhibition_id FROM e JOIN m ON m.wid = e.wid UNION SELECT m.id, exhibition_id FROM e JOIN m ON m.n = e.n WHERE e.wid IS NULL AND e.n <> '')"""

SQL = {
    "museum_by_id": "SELECT id, name, country FROM museums WHERE id = (SELECT min(id) FROM museums)",
    "targets_near": f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY coalesce(sitelinks, 0) DESC, id) AS rn FROM (SELECT id, name, sitelinks, lat, lon, {_HOST} AS site FROM ({_SPOT.format(t='museums')}) p) x WHERE site IS NOT NULL)
SELECT site, id, name, round({_km(str(LAT), str(LON), 'lat', 'lon')}, 4) AS distance_km FROM t WHERE rn = 1 AND {_km(str(LAT), str(LON), 'lat', 'lon')} <= {KM} ORDER BY {_km(str(LAT), str(LON), 'lat', 'lon')}, site LIMIT 500""",
    "museums_page": "WITH g AS (SELECT id, name, sitelinks FROM museums WHERE country = 'Germany'), n AS (SELECT count(*) AS total FROM g) SELECT g.*, total, total > 70 AS has_more FROM g, n ORDER BY sitelinks DESC NULLS LAST, id LIMIT 50 OFFSET 20",
    "show_matches": _MATCH + " SELECT id, exhibition_id FROM j",
    "show_counts": _MATCH + " SELECT id, count(DISTINCT exhibition_id) AS shows FROM j GROUP BY id",
    "exhibition_spots": f"SELECT CAST(floor(lat * 10000 + 0.5) AS BIGINT) AS lat4, CAST(floor(lon * 10000 + 0.5) AS BIGINT) AS lon4, count(*) AS rows, count(DISTINCT museum) AS venues FROM ({_SPOT.format(t='exhibitions')}) p GROUP BY 1, 2",
    "repaired_positions": f"""
WITH l AS (SELECT id, lower(trim(locality)) AS q FROM museums WHERE NOT {_ok()} AND trim(locality) <> ''),
k AS (SELECT lower(trim(query)) AS q, min(struct_pack(lat := location.lat, lon := location.lon)) AS a FROM places WHERE found AND {_ok()} GROUP BY 1),
one AS (SELECT id, a.lat AS lat, a.lon AS lon FROM l JOIN k ON k.q = l.q),
p AS ({_PLACEMENTS})
SELECT id, round(lat, 8) AS lat, round(lon, 8) AS lon, 0 AS tier FROM one
UNION ALL SELECT id, lat, lon, tier FROM p WHERE id IN (SELECT id FROM museums WHERE NOT {_ok()}) AND id NOT IN (SELECT id FROM one)""",
    "country_codes": "SELECT name, min(code) AS code FROM (SELECT name, unnest(other_names) AS code FROM gazetteer WHERE kind = 'country') x WHERE regexp_matches(code, '^[A-Z]{2}$') GROUP BY name",
    "days_left": f"""
WITH e AS (SELECT DISTINCT exhibition_id, date_diff('day', DATE '{TODAY}', ends_on) AS n FROM exhibitions)
SELECT exhibition_id, CASE WHEN n IS NULL THEN 'no end' WHEN n < 0 THEN 'over' WHEN n = 0 THEN 'last day' WHEN n = 1 THEN '1 day left' WHEN n <= 14 THEN n || ' days left'
  WHEN n <= 60 THEN CAST(round(n / 7.0) AS INT) || ' weeks left' ELSE 'open' END AS label FROM e GROUP BY ALL""",
    "resolved_places": f"""
WITH p AS (SELECT lower(trim(query)) AS query, found, location.lat AS lat, location.lon AS lon, radius_km, resolved_at < TIMESTAMPTZ '{SPLIT} 00:00:00+00' AS old FROM places WHERE trim(query) <> ''),
q AS (SELECT DISTINCT query FROM p),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY found DESC NULLS LAST, lat DESC NULLS LAST, lon DESC NULLS LAST, radius_km DESC NULLS LAST) AS rn FROM p WHERE old) WHERE rn = 1),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY lat DESC NULLS LAST, lon DESC NULLS LAST, radius_km DESC NULLS LAST) AS rn FROM p WHERE NOT old AND found) WHERE rn = 1 AND query NOT IN (SELECT query FROM c)),
r AS (SELECT query, {_fold('query')} AS f FROM q WHERE query NOT IN (SELECT query FROM c) AND query NOT IN (SELECT query FROM g)),
t AS (SELECT country, {_fold('locality')} AS town, lat, lon FROM ({_SPOT.format(t='museums')}) s WHERE country IS NOT NULL),
o AS (SELECT country, town, count(*) AS members, avg(lat) AS clat, avg(lon) AS clon FROM t WHERE town <> '' GROUP BY 1, 2),
w AS (SELECT o.*, max({_km('lat', 'lon', 'clat', 'clon')}) AS spread FROM t JOIN o ON o.country = t.country AND o.town = t.town GROUP BY ALL),
a AS (SELECT query, list_distinct({_grams('f')}) AS ga FROM r WHERE f <> ''), b AS (SELECT w.*, list_distinct({_grams('town')}) AS gb FROM w),
m AS (SELECT query, clat, clon, spread, row_number() OVER (PARTITION BY query ORDER BY {_sim('ga', 'gb')} DESC, members DESC, country DESC, town DESC) AS rn FROM a, b WHERE len(ga) > 0 AND len(gb) > 0 AND {_sim('ga', 'gb')} >= 0.6)
SELECT query, CASE WHEN found THEN 'cache' ELSE 'none' END AS tier, round(lat, 6) AS lat, round(lon, 6) AS lon, round(radius_km, 3) AS radius_km FROM c
UNION ALL SELECT query, 'geocoder', round(lat, 6), round(lon, 6), round(radius_km, 3) FROM g
UNION ALL SELECT query, 'town', round(clat, 6), round(clon, 6), round(greatest(2, least(25, spread)), 3) FROM m WHERE rn = 1
UNION ALL SELECT query, 'none', NULL, NULL, NULL FROM r WHERE query NOT IN (SELECT query FROM m)""",
    "merged_hits": """
SELECT 'place' AS kind, rank, key, label FROM (SELECT row_number() OVER (ORDER BY length(name), entry_id) AS rank, CAST(entry_id AS VARCHAR) AS key, name AS label FROM gazetteer WHERE lower(name) LIKE '%ber%') WHERE rank <= 5
UNION ALL SELECT 'museum', rank, key, label FROM (SELECT row_number() OVER (ORDER BY sitelinks DESC NULLS LAST, id) AS rank, CAST(id AS VARCHAR) AS key, name AS label FROM museums WHERE lower(name) LIKE '%salt%') WHERE rank <= 5
UNION ALL SELECT 'show', rank, key, label FROM (SELECT row_number() OVER (ORDER BY exhibition_id, title) AS rank, CAST(exhibition_id AS VARCHAR) AS key, title AS label FROM (SELECT DISTINCT exhibition_id, title FROM exhibitions WHERE lower(title) LIKE '%licht%')) WHERE rank <= 5""",
    "to_scrape": f"SELECT id, name, {_HOST} AS site FROM ({_SPOT.format(t='museums')}) p WHERE {_HOST} IS NOT NULL AND {_km(str(LAT), str(LON), 'lat', 'lon')} <= {KM} ORDER BY sitelinks DESC NULLS LAST, id LIMIT 5000",
    "class_labels": """
WITH r AS (SELECT id AS item, unnest(classes) AS c, generate_subscripts(classes, 1) AS n FROM museums),
f AS (SELECT item, c, min(n) AS n FROM r WHERE c IS NOT NULL GROUP BY 1, 2),
w AS (SELECT DISTINCT c, array_to_string(list_transform(string_split(lower(c), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM r)
SELECT item, array_to_string(list(label ORDER BY n, f.c), '|') AS classes FROM f JOIN w ON w.c = f.c GROUP BY item""",
    "country_counts": """
WITH l AS (SELECT other_names[1] AS country, min(name) AS label FROM gazetteer WHERE kind = 'country' AND len(other_names) > 0 GROUP BY 1),
n AS (SELECT country, count(DISTINCT record_id) AS museums FROM source_records GROUP BY 1)
SELECT n.country, museums, coalesce(label, n.country) AS label FROM n LEFT JOIN l ON l.country = n.country""",
    "restated": """
WITH d AS (SELECT * FROM (SELECT wikidata_id AS wid, name AS label, country AS c, locality AS l, [source] AS k, row_number() OVER (PARTITION BY wikidata_id ORDER BY name DESC NULLS LAST, country DESC NULLS LAST, locality DESC NULLS LAST, source DESC) AS rn FROM source_records WHERE wikidata_id <> '') WHERE rn = 1),
m AS (SELECT * FROM museums LEFT JOIN d ON wid = wikidata_id)
SELECT id, coalesce(nullif(label, ''), name) AS name, coalesce(nullif(c, ''), country) AS country, coalesce(nullif(locality, ''), l) AS locality,
  array_to_string(CASE WHEN len(coalesce(classes, [])) > 0 THEN classes ELSE coalesce(k, []) END, '|') AS classes,
  array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(aliases, []), lambda a: a <> coalesce(nullif(label, ''), '')), CASE WHEN nullif(label, '') <> name THEN [name] ELSE [] END))), '|') AS aliases,
  CASE WHEN wid IS NULL THEN sitelinks ELSE greatest(sitelinks, 3) END AS sitelinks FROM m""",
    "item_maps": """
WITH r AS (SELECT record_id AS item, map_concat(tags, MAP {'tourism': 'checked', 'visits': (record_id % 7) || '.0'}) AS v, record_id % 7 AS visits FROM source_records WHERE tags IS NOT NULL)
SELECT item, array_to_string(list_sort(list_transform(map_entries(v), lambda e: e.key || '=' || e.value)), '|') AS parts, visits FROM r""",
    "country_contradictions": f"""
WITH k AS (SELECT id, {_canon('country')} AS stated, regexp_replace(description, '[.\\s]+$', '') AS bare FROM museums),
t AS (SELECT id, stated, coalesce({_canon("string_split(bare, ',')[-1]")}, {_canon("regexp_extract(bare, '(?i)^.*\\sin\\s+(.+)$', 1)")}) AS told FROM k)
SELECT 'country-contradicts-description' AS "check", 'error' AS severity, CAST(id AS VARCHAR) AS subject FROM t WHERE stated <> told""",
    "next_reads": f"""
WITH {_LATEST},
c AS (SELECT site, CAST(min(ends_on) AS TIMESTAMP) AS closes FROM exhibitions WHERE retired_at IS NULL AND NOT coalesce(permanent, false) AND site IS NOT NULL AND ends_on >= DATE '{TODAY}' GROUP BY site),
s AS (SELECT l.site, closes, consecutive_failures AS f, coalesce(interval_hours, 0) <= 0 AS first, CASE WHEN coalesce(interval_hours, 0) <= 0 THEN 168.0 ELSE interval_hours END AS h,
  CASE WHEN consecutive_failures > 0 THEN 'failed' WHEN last_change_at = last_attempt_at THEN 'changed' ELSE 'unchanged' END AS outcome FROM latest l LEFT JOIN c ON c.site = l.site WHERE last_attempt_at IS NOT NULL),
i AS (SELECT *, CASE WHEN outcome = 'failed' OR first THEN h ELSE greatest(48.0, least(1440.0, h * CASE WHEN outcome = 'changed' THEN 0.5 ELSE 1.5 END)) END AS iv, CASE WHEN outcome = 'failed' THEN f ELSE 0 END AS n FROM s),
w AS (SELECT *, CASE WHEN n >= 6 THEN 1440.0 WHEN n > 0 THEN 12.0 * pow(2, least(n - 1, 5)) ELSE iv END AS wait FROM i),
u AS (SELECT *, epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00') + floor(wait) * 3600 + floor((wait - floor(wait)) * 60) * 60 AS usual, epoch(closes) + 86400 AS again FROM w),
p AS (SELECT *, coalesce(n = 0 AND again > epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00') AND again < usual, false) AS pulled FROM u)
SELECT site, round(iv, 6) AS interval_hours, CAST(n AS BIGINT) AS failures, n >= 6 AS parked, CAST(CASE WHEN pulled THEN again ELSE usual END AS BIGINT) AS due_s,
  CASE WHEN n >= 6 THEN 'parked after ' || n || ' failures' WHEN n > 0 THEN 'failure ' || n WHEN pulled THEN 'a show closes ' || strftime(closes, '%Y-%m-%d') WHEN first THEN 'first read' ELSE outcome END AS reason FROM p""",
    "nearby_many": f"""
WITH p AS (SELECT place_id AS key, location.lat AS qlat, location.lon AS qlon FROM places WHERE {_ok()}), m AS ({_SPOT.format(t='museums')})
SELECT key, id, round({_km('qlat', 'qlon', 'lat', 'lon')}, 4) AS distance_km FROM p, m WHERE abs(qlat - lat) < 0.1 AND {_km('qlat', 'qlon', 'lat', 'lon')} <= 2""",
    "search_many": f"""
WITH p AS (SELECT place_id AS key, list_distinct({_grams('f')}) AS a FROM (SELECT place_id, {_fold('query')} AS f FROM places) x WHERE f <> ''), d AS (SELECT DISTINCT a FROM p),
m AS (SELECT id, list_distinct({_grams('f')}) AS b FROM (SELECT id, {_fold('name')} AS f FROM museums) x WHERE f <> ''), n AS (SELECT DISTINCT b FROM m),
s AS (SELECT a, b, {_sim('a', 'b')} AS sim FROM d, n WHERE len(a) <= 2 * len(b) AND len(b) <= 2 * len(a) AND {_sim('a', 'b')} >= 0.5),
r AS (SELECT key, id, sim, row_number() OVER (PARTITION BY key ORDER BY sim DESC, id) AS rank FROM p JOIN s ON s.a = p.a JOIN m ON m.b = s.b)
SELECT key, rank, id, round(sim, 4) AS sim FROM r WHERE rank <= 5""",
}
