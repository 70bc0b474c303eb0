"""Catalogue queries and the SQL each one is held against."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from vitrine.functions import fuzzy, geo
from vitrine.functions.html import VIEWS_AND_CONTAINERS
from vitrine.functions import text as tx
from vitrine.operators import quality, resolve, schedule, search
from vitrine.session import table

TODAY, NOW = date(2026, 6, 1), datetime(2026, 6, 1, tzinfo=timezone.utc)
LAT, LON, KM = 51.5, -3.0, 50.0


def _t(s, d, *names):
    return [table(s, d, n) for n in names]


def _normal(museums):
    return museums.withColumn("normalized", tx.fold(F.col("name")))


def _text_keys(s, d):
    m = table(s, d, "museums")
    n = F.col("name")
    return m.select("id", tx.fold(n).alias("folded"), F.size(tx.tokens(n)).cast("bigint").alias("words"), tx.site_host(F.col("website")).alias("host"), tx.usable_url(F.col("website")).alias("usable"), tx.identity(F.col("wikidata_id"), tx.fold(n), tx.known_country(F.col("country"))).alias("identity"))


def _places_near_names(s, d):
    p = table(s, d, "places").select(F.col("place_id").alias("key"), F.col("query").alias("text")).filter("text IS NOT NULL")
    g = table(s, d, "gazetteer").select(F.col("entry_id").alias("key"), F.col("name").alias("text"))
    return fuzzy.similar_pairs(p, g, 0.5).select(F.col("left_key").alias("place_id"), F.col("right_key").alias("entry_id"), F.round("sim", 4).alias("sim"))


def _countries(s, d):
    return table(s, d, "gazetteer").filter("kind = 'country'").select("name")


def _site():
    return tx.site_host(F.col("website"))


def _upsert(s, d):
    out = resolve.upsert(_normal(table(s, d, "museums")), resolve.as_catalogue(table(s, d, "source_records")))
    return out.select("identity", "name", "wikidata_id", "country", "locality", "website", F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", "|").alias("sources"), "verified", "sitelinks", F.col("location.lat").alias("lat"), "street", "postcode", "wikipedia_url", "page_id", F.unix_micros("updated_at").alias("updated_us"), "search_text")


def _merged(s, d):
    m = _normal(table(s, d, "museums"))
    out = resolve.apply_merges(m, resolve.same_name_merges(m))
    return out.select("id", "name", "wikidata_id", "website", F.size("aliases").cast("bigint").alias("n_aliases"), F.array_join("sources", "|").alias("sources"), "verified", "sitelinks")


def _retire(s, d):
    e = table(s, d, "exhibitions")
    reads = schedule.latest(table(s, d, "site_scrapes")).select("site", F.col("last_success_at").alias("began"), F.col("found_count").alias("found")).filter("began IS NOT NULL")
    return schedule.retire_unseen(e, reads)


def _entities(s, d):
    return resolve.entities(table(s, d, "museums"))


def _enriched(s, d):
    m = table(s, d, "museums").select("id", "name", "website", "locality")
    rich = table(s, d, "source_records").select(F.col("record_id").alias("id"), "name", "website", "locality")
    return resolve.fold_enriched(m, rich, "id", ["website", "locality"])


def _bucket(s, d):
    e = table(s, d, "events")
    return schedule.token_bucket(e.select(F.col("user_id").alias("client"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")), 1 / 3600, 3.0)


QUERIES = {
    "nearby": lambda s, d: search.nearby(table(s, d, "museums"), LAT, LON, KM),
    "nearby_verified": lambda s, d: search.nearby(table(s, d, "museums"), LAT, LON, KM, verified=True, limit=20, offset=5),
    "points_in_box": lambda s, d: search.in_box(table(s, d, "museums"), 40.0, -10.0, 55.0, 20.0),
    "search_museums": lambda s, d: search.search_museums(table(s, d, "museums"), "musem of glas sosozaicombe"),
    "search_exhibitions": lambda s, d: search.search_exhibitions(table(s, d, "exhibitions"), "Permanent colection", TODAY),
    "exhibitions_near": lambda s, d: search.exhibitions_near(table(s, d, "exhibitions"), LAT, LON, KM, TODAY),
    "exhibitions_in_june": lambda s, d: search.between_days(table(s, d, "exhibitions"), TODAY, date(2026, 6, 30)),
    "soonest_close": lambda s, d: search.soonest_close(table(s, d, "exhibitions"), TODAY),
    "catalogue_counts": lambda s, d: search.counts(table(s, d, "museums")),
    "unplaced_museums": lambda s, d: search.unplaced(table(s, d, "museums"), "germany", "museum"),
    "area_coverage": lambda s, d: search.coverage(table(s, d, "museums"), table(s, d, "site_scrapes"), _site(), LAT, LON, KM),
    "town_places": lambda s, d: search.town_places(table(s, d, "museums")).select("country", "town", "members", F.round("clat", 8).alias("clat"), F.round("clon", 8).alias("clon"), F.round("spread_km", 3).alias("spread_km")),
    "locality_place": lambda s, d: search.locality_place(table(s, d, "museums"), "Sibingen Germany"),
    "site_targets": lambda s, d: search.site_targets(table(s, d, "museums"), _site()),
    "text_keys": _text_keys,
    "grid_cells": lambda s, d: search.placed(table(s, d, "museums")).groupBy(geo.cell_label(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count(F.lit(1)).alias("museums")),
    "places_near_names": _places_near_names,
    "upsert_catalogue": _upsert,
    "promote_ids": lambda s, d: resolve.promote_ids(_normal(table(s, d, "museums")), resolve.as_catalogue(table(s, d, "source_records"))),
    "same_name_merges": lambda s, d: resolve.same_name_merges(_normal(table(s, d, "museums"))),
    "merged_rows": _merged,
    "alias_merges": lambda s, d: resolve.alias_merges(_normal(table(s, d, "museums"))),
    "name_variant_merges": lambda s, d: resolve.name_variant_merges(_normal(table(s, d, "museums"))),
    "exhibition_merges": lambda s, d: resolve.exhibition_merges(table(s, d, "exhibitions")),
    "town_placements": lambda s, d: resolve.town_placements(table(s, d, "museums")).select("id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "tier"),
    "entities": _entities,
    "entity_rows": lambda s, d: resolve.merged_entities(table(s, d, "museums")).select("id", "name", "country", "locality", "website", F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", "|").alias("sources"), "sitelinks", "verified"),
    "duplicate_groups": lambda s, d: quality.duplicate_groups(table(s, d, "museums")),
    "report_shares": lambda s, d: quality.shares(quality.audit_exhibitions(table(s, d, "exhibitions"), TODAY), table(s, d, "exhibitions")),
    "navigation_listings": lambda s, d: quality.navigation_listings(table(s, d, "exhibitions")),
    "enriched_fold": _enriched,
    "audit_museums": lambda s, d: quality.audit_museums(table(s, d, "museums"), _countries(s, d)),
    "audit_report": lambda s, d: quality.report(quality.audit_museums(table(s, d, "museums"), _countries(s, d)).unionByName(quality.audit_exhibitions(table(s, d, "exhibitions"), TODAY))),
    "audit_exhibitions": lambda s, d: quality.audit_exhibitions(table(s, d, "exhibitions"), TODAY),
    "audit_samples": lambda s, d: quality.samples(quality.audit_exhibitions(table(s, d, "exhibitions"), TODAY)),
    "schedule": lambda s, d: schedule.schedule(schedule.attempts(table(s, d, "site_scrapes"))),
    "due_sites": lambda s, d: schedule.due(schedule.latest(table(s, d, "site_scrapes")), NOW),
    "sweep_status": lambda s, d: schedule.status(schedule.latest(table(s, d, "site_scrapes")), NOW),
    "retired_listings": _retire,
    "site_fingerprints": lambda s, d: schedule.fingerprints(table(s, d, "exhibitions")),
    "new_sites": lambda s, d: schedule.discover(table(s, d, "museums").select(_site().alias("site")), schedule.latest(table(s, d, "site_scrapes"))),
    "request_budget": _bucket,
}

# -- SQL ------------------------------------------------------------------------------------------------------------


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def _ok(lat: str = "location.lat", lon: str = "location.lon") -> str:
    return f"coalesce({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 AND NOT ({lat} = 0 AND {lon} = 0), false)"


def _fold(x: str) -> str:
    out = f"lower(strip_accents({x}))"
    for k, v in (*tx.TWO_LETTERS.items(), *tx.ONE_LETTER.items()):
        out = f"replace({out}, '{k}', '{v}')"
    return f"trim(regexp_replace(strip_accents({out}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


def _grams(x: str) -> str:
    return (
        f"flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', CAST(i AS BIGINT), 3))))"
    )


def _sim(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both} / nullif(CAST(len({a}) + len({b}) - {both} AS DOUBLE), 0), 0.0)"


_P = f"SELECT *, location.lat AS lat, location.lon AS lon FROM museums WHERE {_ok()}"
_HOST = "nullif(regexp_replace(lower(regexp_extract(website, '(?i)^https?://([^/:?#]+)', 1)), '^www\\.', ''), '')"
_KNOWN = "CASE WHEN lower(trim(country)) IN ('', 'unknown') THEN NULL ELSE country END"
_NEAR = f"SELECT id, name, coalesce(country, '') AS country, round({_km(str(LAT), str(LON), 'lat', 'lon')}, 4) AS distance_km, verified FROM ({_P}) p WHERE {_km(str(LAT), str(LON), 'lat', 'lon')} <= {KM}"
_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY coalesce(epoch_us(last_attempt_at), -1) DESC, epoch_us(loaded_at) DESC) AS rn
  FROM site_scrapes WHERE site IS NOT NULL) WHERE rn = 1)"""
_MUS = f"m AS (SELECT * EXCLUDE (normalized), {_fold('name')} AS normalized, nullif(wikidata_id, '') AS wid FROM museums)"
_BOIL = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.BOILERPLATE)
_URL_OK = "regexp_matches(lower({u}), '^https?://[^/?#\\s]+') AND NOT regexp_matches({u}, '[\\s\\p{{Z}}\\p{{Cc}}]')"

_AUDIT_E = f"""
SELECT DISTINCT "check", severity, CAST(exhibition_id AS VARCHAR) AS subject FROM (
  SELECT exhibition_id, 'exhibition-ends-before-it-starts' AS "check", 'error' AS severity FROM exhibitions WHERE ends_on < starts_on
  UNION ALL SELECT exhibition_id, 'exhibition-dates-implausible', 'warning' FROM exhibitions WHERE abs(date_diff('day', DATE '{TODAY}', starts_on)) > 3650 OR abs(date_diff('day', DATE '{TODAY}', ends_on)) > 3650
  UNION ALL SELECT exhibition_id, 'exhibition-permanent-but-ends', 'error' FROM exhibitions WHERE permanent AND ends_on IS NOT NULL
  UNION ALL SELECT exhibition_id, 'exhibition-title-is-boilerplate', 'error' FROM exhibitions WHERE lower(trim(title)) IN ({_BOIL})
  UNION ALL SELECT exhibition_id, 'exhibition-scrape-stale', 'warning' FROM exhibitions WHERE date_diff('day', CAST(scraped_at AT TIME ZONE 'UTC' AS DATE), DATE '{TODAY}') > 30)
"""
_AUDIT_M = f"""
WITH a AS (SELECT *, location.lat AS lat, location.lon AS lon FROM museums),
simple AS (
  SELECT id, 'no-coordinates' AS "check", 'warning' AS severity FROM a WHERE lat IS NULL OR lon IS NULL
  UNION ALL SELECT id, 'impossible-coordinates', 'error' FROM a WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
  UNION ALL SELECT id, 'null-island', 'error' FROM a WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND {_km('lat', 'lon', '0.0', '0.0')} < 1
  UNION ALL SELECT id, 'unknown-country', 'warning' FROM a WHERE country IS NOT NULL AND lower(trim(country)) NOT IN (SELECT lower(name) FROM gazetteer WHERE kind = 'country')
  UNION ALL SELECT id, 'suspicious-name', 'error' FROM a WHERE trim(coalesce(name, '')) = '' OR regexp_matches(name, '\\[\\[|\\]\\]|\\{{\\{{|\\}}\\}}|<[a-zA-Z/]')
  UNION ALL SELECT id, 'no-classes', 'info' FROM a WHERE len(classes) = 0 AND list_contains(sources, 'wikidata')
  UNION ALL SELECT id, 'not-a-museum', 'error' FROM a WHERE regexp_matches(lower(description), '{quality.OTHERS}') AND NOT regexp_matches(lower(concat_ws(' ', name, description)), '{quality.KEEPERS}')
  UNION ALL SELECT id, 'unusable-url', 'warning' FROM a WHERE coalesce(website, '') <> '' AND NOT ({_URL_OK.format(u='website')})
  UNION ALL SELECT id, 'unusable-url', 'warning' FROM a WHERE coalesce(wikipedia_url, '') <> '' AND NOT ({_URL_OK.format(u='wikipedia_url')})),
k AS (SELECT regexp_replace(lower(name), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g') || '|' || regexp_replace(lower({_KNOWN}), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g') AS key FROM museums),
dup AS (SELECT key FROM k WHERE key IS NOT NULL AND key NOT LIKE '|%' GROUP BY key HAVING count(*) > 1),
p AS (SELECT id, {_KNOWN} AS country, lat, lon FROM a WHERE {_ok('lat', 'lon')} AND {_KNOWN} IS NOT NULL),
md AS (SELECT country, list_sort(list(lat))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mlat, list_sort(list(lon))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mlon FROM p GROUP BY country HAVING count(*) >= 30),
d AS (SELECT p.*, {_km('p.lat', 'p.lon', 'mlat', 'mlon')} AS d FROM p JOIN md ON md.country = p.country),
q AS (SELECT country, list_sort(list(d))[CAST(floor((count(*) - 1) * 0.99) AS BIGINT) + 1] AS p99 FROM d GROUP BY country)
SELECT "check", severity, CAST(id AS VARCHAR) AS subject FROM simple
UNION ALL SELECT 'duplicate-record', 'warning', key FROM dup
UNION ALL SELECT 'coordinates-far-from-country', 'warning', CAST(id AS VARCHAR) FROM d JOIN q ON q.country = d.country WHERE d > greatest(2 * p99, 500)
"""
_CAT = f"""
b AS (
  SELECT id, wikidata_id, name, {_fold('name')} AS normalized, {_KNOWN} AS country, locality, website, aliases, sources, verified, location, sitelinks, 0 AS side, street, postcode, wikipedia_url, page_id, updated_at FROM museums
  UNION ALL SELECT record_id, wikidata_id, name, {_fold('name')}, {_KNOWN}, locality, website, other_names, [source], false, location, 0, 1, tags['addr:street'], tags['addr:postcode'], NULL, NULL, fetched_at FROM source_records),
u AS (SELECT *, coalesce(nullif(wikidata_id, ''), normalized || '|' || coalesce(country, '')) AS identity, side * 1000000000000 + id AS ord FROM b)
"""

_KEY = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"
#: Rounds in which rows join entities: as many as the SQL unrolls.
_ROUNDS = range(6)
_JOINED = ", ".join(
    f"""s{i} AS (SELECT key, min(e) AS e FROM k JOIN l{i} ON l{i}.id = k.id GROUP BY key HAVING count(DISTINCT e) = 1),
l{i + 1} AS (SELECT * FROM l{i} UNION ALL SELECT k.id, min(s{i}.e) FROM k JOIN s{i} ON s{i}.key = k.key WHERE k.id NOT IN (SELECT id FROM l{i}) GROUP BY k.id HAVING count(DISTINCT s{i}.e) = 1)"""
    for i in _ROUNDS
)
_ENTITIES = f"""
WITH RECURSIVE ids AS (SELECT id, max(nullif(wikidata_id, '')) AS wid FROM museums WHERE id IS NOT NULL GROUP BY id),
n AS (SELECT id, {_KNOWN} AS c, unnest(list_concat([name], aliases)) AS called FROM museums WHERE id IS NOT NULL),
k AS (SELECT DISTINCT id, {_KEY.format(x='called')} || '|' || {_KEY.format(x='c')} AS key FROM n WHERE c IS NOT NULL AND {_KEY.format(x='called')} <> ''),
l0 AS (SELECT id, wid AS e FROM ids WHERE wid IS NOT NULL),
{_JOINED},
r AS (SELECT id, key FROM k WHERE id NOT IN (SELECT id FROM l6) AND key NOT IN (SELECT key FROM k JOIN l6 ON l6.id = k.id)),
x AS (SELECT DISTINCT a.id AS a, b.id AS b FROM r a JOIN r b ON a.key = b.key),
w AS (SELECT a AS node, a AS seen FROM x UNION SELECT w.node, x.b FROM w JOIN x ON x.a = w.seen),
c AS (SELECT node, min(seen) AS low FROM w GROUP BY node),
o AS (SELECT ids.id, coalesce('w' || l6.e, 'c' || CAST(coalesce(c.low, ids.id) AS VARCHAR)) AS e FROM ids LEFT JOIN l6 ON l6.id = ids.id LEFT JOIN c ON c.node = ids.id)
SELECT id AS node, min(id) OVER (PARTITION BY e) AS label FROM o"""

SQL = {
    "nearby": f"WITH n AS ({_NEAR}) SELECT id, name, country, distance_km, (SELECT count(*) FROM n) AS total FROM n ORDER BY distance_km, id LIMIT 500",
    "nearby_verified": f"WITH n AS ({_NEAR}), v AS (SELECT * FROM n WHERE verified) SELECT id, name, country, distance_km, (SELECT count(*) FROM v) AS total FROM v ORDER BY distance_km, id LIMIT 20 OFFSET 5",
    "points_in_box": f"SELECT id, lat, lon FROM ({_P}) p WHERE lat BETWEEN 40 AND 55 AND lon BETWEEN -10 AND 20 ORDER BY sitelinks DESC, id LIMIT 40000",
    "search_museums": f"""
WITH q AS (SELECT 'musem of glas sosozaicombe' AS q), g AS (SELECT q, list_distinct({_grams('q')}) AS qt FROM q),
n AS (SELECT id, name, {_fold('name')} AS n, list_transform(aliases, lambda a: {_fold('a')}) AS al, {_fold('locality')} AS town, sitelinks, {_ok()} AS located FROM museums),
v AS (SELECT n.*, trim(concat_ws(' ', n, array_to_string(list_sort(list_distinct(al)), ' '), town)) AS st FROM n),
t AS (SELECT v.*, q, qt, {_grams('n')} AS ot, list_distinct({_grams('n')}) AS gt, list_distinct({_grams('st')}) AS sg FROM v, g),
w AS (SELECT *, {_sim('gt', 'qt')} AS sim, {_sim('sg', 'qt')} AS whole, coalesce(list_max(flatten(list_transform(list_filter(range(1, len(ot) + 1), lambda i: list_contains(qt, ot[i])),
  lambda i: list_transform(list_filter(range(i, len(ot) + 1), lambda j: list_contains(qt, ot[j])), lambda j: {_sim('qt', 'list_distinct(ot[i:j])')})))), 0.0) AS ws FROM t)
SELECT id, name, round(CASE WHEN n = q THEN 3.0 WHEN list_contains(al, q) THEN 2.5 WHEN starts_with(n, q) THEN 1.5 WHEN contains(n, q) THEN 0.75 ELSE 0.0 END
  + 0.7 * sim + 0.3 * ws + CASE WHEN length(town) >= 4 AND contains(' ' || q || ' ', ' ' || town || ' ') THEN 0.4 ELSE 0.0 END
  + 0.2 * ln(1 + greatest(coalesce(sitelinks, 0), 0)) + CASE WHEN located THEN 0.01 ELSE 0.0 END, 4) AS score
FROM w WHERE sim >= 0.3 OR starts_with(n, q) OR list_contains(al, q) OR ws >= 0.55 OR whole >= 0.3
ORDER BY score DESC, length(n), name, id LIMIT 50""",
    "search_exhibitions": f"""
WITH q AS (SELECT 'permanent colection' AS q), e AS (SELECT DISTINCT exhibition_id, title, museum, ends_on, lower(title) AS t, q FROM exhibitions, q WHERE ends_on IS NULL OR ends_on >= DATE '{TODAY}'),
s AS (SELECT *, {_sim(f"list_distinct({_grams('t')})", f"list_distinct({_grams('q')})")} AS sim,
  CASE WHEN t = q THEN 3.0 WHEN starts_with(t, q) THEN 1.5 WHEN contains(t, q) THEN 0.75 WHEN contains(lower(museum), q) THEN 0.5 ELSE 0.0 END AS kind FROM e),
f AS (SELECT DISTINCT exhibition_id, title, ends_on, round(kind + sim, 4) AS score FROM s WHERE sim >= 0.3 OR kind > 0)
SELECT exhibition_id, title, score FROM f ORDER BY score DESC, ends_on ASC NULLS LAST, exhibition_id LIMIT 50""",
    "exhibitions_near": f"""
SELECT DISTINCT exhibition_id, title, CAST(ends_on AS VARCHAR) AS ends_on, round({_km(str(LAT), str(LON), 'location.lat', 'location.lon')}, 4) AS distance_km
FROM exhibitions WHERE retired_at IS NULL AND {_ok()} AND {_km(str(LAT), str(LON), 'location.lat', 'location.lon')} <= {KM}
  AND (ends_on IS NULL OR ends_on >= DATE '{TODAY}') AND (starts_on IS NULL OR starts_on <= DATE '{TODAY}')""",
    "exhibitions_in_june": "SELECT DISTINCT exhibition_id FROM exhibitions WHERE coalesce(permanent, false) OR ((starts_on IS NULL OR starts_on <= DATE '2026-06-30') AND (ends_on IS NULL OR ends_on >= DATE '2026-06-01'))",
    "soonest_close": f"SELECT site, CAST(min(ends_on) AS VARCHAR) AS closes FROM exhibitions WHERE retired_at IS NULL AND NOT coalesce(permanent, false) AND site IS NOT NULL AND ends_on >= DATE '{TODAY}' GROUP BY site",
    "catalogue_counts": f"SELECT count(*) AS total, count_if({_ok()}) AS placed, count_if(verified) AS verified, count_if(coalesce(website, '') <> '') AS with_website, count(DISTINCT country) AS countries, epoch_us(max(updated_at)) AS newest FROM museums",
    "unplaced_museums": f"SELECT id, name, sitelinks FROM museums WHERE NOT {_ok()} AND lower(country) = 'germany' AND contains(lower(name), 'museum')",
    "area_coverage": f"""
WITH a AS (SELECT id, {_HOST} AS site FROM ({_P}) p WHERE {_km(str(LAT), str(LON), 'lat', 'lon')} <= {KM}),
s AS (SELECT site, max(last_success_at) AS last FROM site_scrapes GROUP BY site)
SELECT count(*) AS museums, count(a.site) AS with_site, count(DISTINCT CASE WHEN last IS NOT NULL THEN a.site END) AS sites_read, epoch_us(max(last)) AS last_read FROM a LEFT JOIN s ON s.site = a.site""",
    "town_places": f"""
WITH t AS (SELECT country, {_fold('locality')} AS town, lat, lon FROM ({_P}) p WHERE country IS NOT NULL), m AS (SELECT * FROM t WHERE town <> ''),
c AS (SELECT country, town, count(*) AS members, avg(lat) AS clat, avg(lon) AS clon FROM m GROUP BY 1, 2)
SELECT c.country, c.town, any_value(members) AS members, round(any_value(clat), 8) AS clat, round(any_value(clon), 8) AS clon, round(max({_km('lat', 'lon', 'clat', 'clon')}), 3) AS spread_km
FROM m JOIN c ON c.country = m.country AND c.town = m.town GROUP BY 1, 2""",
    "locality_place": f"""
WITH q0 AS (SELECT {_fold("'Sibingen Germany'")} AS q),
t AS (SELECT country, {_fold('locality')} AS town, lat, lon FROM ({_P}) p WHERE country IS NOT NULL), m AS (SELECT * FROM t WHERE town <> ''),
o AS (SELECT country, town, count(*) AS members, avg(lat) AS clat, avg(lon) AS clon FROM m GROUP BY 1, 2),
w AS (SELECT o.*, {_fold('o.country')} AS c, max({_km('lat', 'lon', 'clat', 'clon')}) AS spread FROM m JOIN o ON o.country = m.country AND o.town = m.town GROUP BY ALL),
n AS (SELECT DISTINCT c FROM w, q0 WHERE contains(' ' || q || ' ', ' ' || c || ' ') ORDER BY length(c) DESC, c LIMIT 1),
q AS (SELECT trim(regexp_replace(replace(' ' || q || ' ', ' ' || coalesce((SELECT c FROM n), chr(0)) || ' ', ' '), ' +', ' ', 'g')) AS q FROM q0),
s AS (SELECT w.*, greatest({_sim(f"list_distinct({_grams("string_split(town, ' ')[1]")})", f"list_distinct({_grams("string_split(q, ' ')[1]")})")}, {_sim(f"list_distinct({_grams('town')})", f"list_distinct({_grams('q')})")}) AS score FROM w, q WHERE c = (SELECT c FROM n) OR NOT EXISTS (SELECT 1 FROM n))
SELECT country, town, members, round(score, 4) AS score, round(clat, 5) AS lat, round(clon, 5) AS lon, round(greatest(2.0, least(25.0, spread)), 3) AS radius_km FROM s WHERE score >= 0.45 ORDER BY s.score DESC, members DESC, country, town LIMIT 1""",
    "request_budget": """
WITH e AS (SELECT user_id AS client, list({'t': CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT)::DOUBLE, 'k': 0.0::DOUBLE, 'ok': 0::BIGINT, 'bad': 0::BIGINT} ORDER BY ts) AS l FROM events GROUP BY 1),
r AS (SELECT client, list_reduce(l, lambda a, x: {'t': x.t,
  'k': CASE WHEN least(3.0, a.k + CASE WHEN a.t < 0 THEN 0.0 ELSE (x.t - a.t) / 3600 END) >= 1 THEN least(3.0, a.k + CASE WHEN a.t < 0 THEN 0.0 ELSE (x.t - a.t) / 3600 END) - 1 ELSE least(3.0, a.k + CASE WHEN a.t < 0 THEN 0.0 ELSE (x.t - a.t) / 3600 END) END,
  'ok': a.ok + CASE WHEN least(3.0, a.k + CASE WHEN a.t < 0 THEN 0.0 ELSE (x.t - a.t) / 3600 END) >= 1 THEN 1 ELSE 0 END,
  'bad': a.bad + CASE WHEN least(3.0, a.k + CASE WHEN a.t < 0 THEN 0.0 ELSE (x.t - a.t) / 3600 END) >= 1 THEN 0 ELSE 1 END}, {'t': -1.0::DOUBLE, 'k': 3.0::DOUBLE, 'ok': 0::BIGINT, 'bad': 0::BIGINT}) AS s FROM e)
SELECT client, s.ok AS allowed, s.bad AS refused FROM r""",
    "site_targets": f"""
SELECT site, id, name FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY coalesce(sitelinks, 0) DESC, id) AS rn FROM (SELECT id, name, sitelinks, {_HOST} AS site FROM ({_P}) p) x WHERE site IS NOT NULL) WHERE rn = 1""",
    "text_keys": f"""
SELECT id, {_fold('name')} AS folded, len(list_distinct(list_filter(string_split({_fold('name')}, ' '), lambda w: w <> ''))) AS words, {_HOST} AS host,
  coalesce({_URL_OK.format(u='website')}, false) AS usable, coalesce(nullif(wikidata_id, ''), {_fold('name')} || '|' || coalesce({_KNOWN}, '')) AS identity FROM museums""",
    "grid_cells": f"SELECT printf('%.2f,%.2f', round(lat / 0.25) * 0.25 + 0.0, round(lon / 0.25) * 0.25 + 0.0) AS cell, count(*) AS museums FROM ({_P}) p GROUP BY 1",
    "places_near_names": f"""
WITH p AS (SELECT place_id, list_distinct({_grams('query')}) AS a FROM places WHERE query IS NOT NULL), g AS (SELECT entry_id, list_distinct({_grams('name')}) AS b FROM gazetteer)
SELECT place_id, entry_id, round({_sim('a', 'b')}, 4) AS sim FROM p, g WHERE len(a) > 0 AND len(b) > 0 AND {_sim('a', 'b')} >= 0.5""",
    "upsert_catalogue": f"""
WITH {_CAT}
SELECT identity, arg_max(name, ord) AS name, arg_max(wikidata_id, ord) FILTER (WHERE wikidata_id <> '') AS wikidata_id, arg_max(country, ord) FILTER (WHERE country <> '') AS country,
  arg_max(locality, ord) FILTER (WHERE locality <> '') AS locality, arg_max(website, ord) FILTER (WHERE website <> '') AS website,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list(aliases)), lambda x: x <> ''))), '|') AS aliases,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list(sources)), lambda x: x <> ''))), '|') AS sources,
  bool_or(verified) AS verified, max(sitelinks) AS sitelinks, arg_max(location.lat, ord) FILTER (WHERE {_ok()}) AS lat,
  arg_max(street, ord) FILTER (WHERE street <> '') AS street, arg_max(postcode, ord) FILTER (WHERE postcode <> '') AS postcode, arg_max(wikipedia_url, ord) FILTER (WHERE wikipedia_url <> '') AS wikipedia_url,
  arg_max(page_id, ord) FILTER (WHERE page_id > 0) AS page_id, epoch_us(max(updated_at)) AS updated_us,
  {_fold("concat_ws(' ', arg_max(name, ord), array_to_string(list_sort(list_distinct(list_filter(flatten(list(aliases)), lambda x: x <> ''))), ' '), arg_max(locality, ord) FILTER (WHERE locality <> ''))")} AS search_text
FROM u WHERE identity IS NOT NULL GROUP BY identity""",
    "promote_ids": f"""
WITH {_CAT}, n AS (SELECT normalized, country, min(wikidata_id) AS wikidata_id FROM u WHERE side = 1 AND wikidata_id <> '' AND normalized <> '' GROUP BY 1, 2),
o AS (SELECT normalized, {_KNOWN.replace('country', 'c0')} AS k, c0 AS country, min(id) AS id FROM (SELECT id, {_fold('name')} AS normalized, country AS c0, wikidata_id FROM museums) x WHERE coalesce(wikidata_id, '') = '' AND normalized <> '' GROUP BY 1, 2, 3)
SELECT o.id, n.wikidata_id FROM o JOIN n ON o.normalized = n.normalized AND o.country = n.country WHERE n.wikidata_id NOT IN (SELECT wikidata_id FROM museums WHERE wikidata_id <> '')""",
    "same_name_merges": f"""
WITH {_MUS}, k AS (SELECT normalized, country, min(id) AS keeper FROM m WHERE wid IS NOT NULL AND normalized <> '' GROUP BY 1, 2)
SELECT m.id AS victim, keeper FROM m JOIN k ON k.normalized = m.normalized AND k.country = m.country WHERE m.wid IS NULL""",
    "merged_rows": f"""
WITH {_MUS}, k AS (SELECT normalized, country, min(id) AS keeper FROM m WHERE wid IS NOT NULL AND normalized <> '' GROUP BY 1, 2),
j AS (SELECT m.*, coalesce(CASE WHEN wid IS NULL THEN keeper END, m.id) AS dest FROM m LEFT JOIN k ON k.normalized = m.normalized AND k.country = m.country),
o AS (SELECT *, CASE WHEN dest = id THEN 1000000000000 ELSE 0 END - id AS ord FROM j)
SELECT dest AS id, arg_max(name, ord) AS name, arg_max(wikidata_id, ord) FILTER (WHERE wikidata_id <> '') AS wikidata_id, arg_max(website, ord) FILTER (WHERE website <> '') AS website,
  len(list_distinct(flatten(list(list_concat(aliases, CASE WHEN dest <> id THEN [name] ELSE [] END))))) AS n_aliases,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list(sources)), lambda x: x <> ''))), '|') AS sources, bool_or(coalesce(verified, false)) AS verified, max(sitelinks) AS sitelinks
FROM o GROUP BY dest""",
    "alias_merges": f"""
WITH {_MUS}, a AS (SELECT DISTINCT id, country, {_fold('called')} AS called FROM (SELECT id, country, unnest(aliases) AS called FROM m) x WHERE country IS NOT NULL),
s AS (SELECT country, called, min(id) AS keeper FROM a WHERE called <> '' GROUP BY 1, 2 HAVING count(*) = 1),
c AS (SELECT v.id AS victim, min(s.keeper) AS keeper FROM m v JOIN s ON s.country = v.country AND s.called = v.normalized JOIN m k ON k.id = s.keeper
  WHERE v.id <> k.id AND (v.wid IS NULL OR k.wid IS NULL) AND (NOT ({_ok('v.location.lat', 'v.location.lon')} AND {_ok('k.location.lat', 'k.location.lon')})
    OR {_km('v.location.lat', 'v.location.lon', 'k.location.lat', 'k.location.lon')} <= 1.0) GROUP BY v.id)
SELECT victim, keeper FROM c WHERE keeper NOT IN (SELECT victim FROM c)""",
    "name_variant_merges": f"""
WITH {_MUS}, n AS (SELECT id, coalesce(sitelinks, 0) AS s, location.lat AS lat, location.lon AS lon, list_sort(list_filter(string_split(normalized, ' '), lambda w: length(w) > 2)) AS w FROM m WHERE {_ok()}),
x AS (SELECT id, s, lat, lon, array_to_string(w, ' ') AS w FROM n WHERE len(w) >= 2),
c AS (SELECT b.id AS victim, min(a.id) AS keeper FROM x a JOIN x b ON a.w = b.w AND (a.s > b.s OR (a.s = b.s AND a.id < b.id)) WHERE {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 0.15 GROUP BY b.id)
SELECT victim, keeper FROM c WHERE keeper NOT IN (SELECT victim FROM c)""",
    "exhibition_merges": """
WITH e AS (SELECT DISTINCT url, lower(trim(title)) AS title, museum, starts_on, ends_on FROM exhibitions WHERE NOT coalesce(permanent, false) AND museum IS NOT NULL AND trim(title) <> '')
SELECT museum, title, count(DISTINCT url) AS listings, (array_agg(url ORDER BY coalesce(starts_on, DATE '0001-01-01'), url))[1] AS url, CAST(min(starts_on) AS VARCHAR) AS starts_on, CAST(max(ends_on) AS VARCHAR) AS ends_on
FROM e GROUP BY museum, title HAVING count(DISTINCT url) > 1""",
    "town_placements": f"""
WITH t AS (SELECT id, country, {_fold('locality')} AS town, CASE WHEN {_ok()} AND NOT coalesce(location_approximate, false) THEN location.lat END AS lat, CASE WHEN {_ok()} AND NOT coalesce(location_approximate, false) THEN location.lon END AS lon FROM museums WHERE country IS NOT NULL),
m AS (SELECT *, string_split(town, ' ')[1] AS head FROM t WHERE town <> ''),
c1 AS (SELECT country, town, avg(lat) AS clat, avg(lon) AS clon FROM m WHERE lat IS NOT NULL GROUP BY 1, 2),
g1 AS (SELECT c1.country, c1.town, any_value(clat) AS clat, any_value(clon) AS clon FROM m JOIN c1 ON c1.country = m.country AND c1.town = m.town WHERE lat IS NOT NULL GROUP BY 1, 2 HAVING max({_km('lat', 'lon', 'clat', 'clon')}) <= 50),
c2 AS (SELECT country, head, avg(lat) AS clat, avg(lon) AS clon FROM m WHERE lat IS NOT NULL GROUP BY 1, 2),
g2 AS (SELECT c2.country, c2.head, any_value(clat) AS clat, any_value(clon) AS clon FROM m JOIN c2 ON c2.country = m.country AND c2.head = m.head WHERE lat IS NOT NULL GROUP BY 1, 2 HAVING max({_km('lat', 'lon', 'clat', 'clon')}) <= 50),
one AS (SELECT id, clat, clon, 1 AS tier FROM m JOIN g1 ON g1.country = m.country AND g1.town = m.town WHERE lat IS NULL)
SELECT id, round(clat, 8) AS lat, round(clon, 8) AS lon, tier FROM (SELECT * FROM one
  UNION ALL SELECT m.id, g2.clat, g2.clon, 2 FROM m JOIN g2 ON g2.country = m.country AND g2.head = m.head WHERE m.lat IS NULL AND length(m.head) >= 4 AND m.id NOT IN (SELECT id FROM one)) z""",
    "entities": _ENTITIES,
    "entity_rows": f"""
WITH e AS ({_ENTITIES}), m AS (SELECT museums.*, label, {_KNOWN} AS kc, CASE WHEN list_contains(sources, 'wikidata') THEN 0 ELSE 1000000000000 END + id AS co FROM museums JOIN e ON node = id),
g AS (SELECT label, arg_min(name, id) FILTER (WHERE name <> '') AS name, arg_min(kc, co) FILTER (WHERE kc <> '') AS country, arg_min(locality, id) FILTER (WHERE locality <> '') AS locality, arg_min(website, id) FILTER (WHERE website <> '') AS website,
  list_sort(list_distinct(list_filter(flatten(list(list_concat([name], aliases))), lambda x: x <> ''))) AS called, array_to_string(list_sort(list_distinct(list_filter(flatten(list(sources)), lambda x: x <> ''))), '|') AS sources,
  max(sitelinks) AS sitelinks, bool_or(coalesce(verified, false)) AS verified FROM m GROUP BY label)
SELECT label AS id, name, country, locality, website, array_to_string(list_filter(called, lambda x: name IS NULL OR x <> name), '|') AS aliases, sources, sitelinks, verified FROM g""",
    "duplicate_groups": f"""
WITH k AS (SELECT name, {_KEY.format(x='name')} || '|' || {_KEY.format(x=_KNOWN)} AS key FROM museums)
SELECT key, count(*) AS rows, array_to_string(list_sort(list_distinct(list(name))), ' / ') AS names FROM k WHERE key IS NOT NULL AND key NOT LIKE '|%' GROUP BY key HAVING count(*) > 1""",
    "report_shares": f'SELECT "check", severity, count(*) AS findings, round(100.0 * count(*) / (SELECT count(DISTINCT exhibition_id) FROM exhibitions), 3) AS share FROM ({_AUDIT_E}) f GROUP BY 1, 2',
    "navigation_listings": """
WITH e AS (SELECT DISTINCT exhibition_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS u, regexp_replace(regexp_replace(lower(source_page), '[?#].*$', ''), '/+$', '') AS p FROM exhibitions WHERE url IS NOT NULL AND NOT coalesce(permanent, false)),
s AS (SELECT exhibition_id, u, p, list_filter(string_split(regexp_replace(u, '^https?://[^/]+', ''), '/'), lambda x: x <> '') AS parts FROM e)
SELECT DISTINCT exhibition_id FROM s WHERE coalesce(u = p, false) OR len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ("""
    + ", ".join(f"'{x}'" for x in VIEWS_AND_CONTAINERS)
    + """))) = 0""",
    "enriched_fold": """
SELECT coalesce(e.record_id, m.id) AS id, CASE WHEN e.record_id IS NULL THEN m.name ELSE e.name END AS name,
  CASE WHEN e.record_id IS NULL THEN m.website ELSE coalesce(nullif(e.website, ''), m.website) END AS website,
  CASE WHEN e.record_id IS NULL THEN m.locality ELSE coalesce(nullif(e.locality, ''), m.locality) END AS locality
FROM museums m FULL OUTER JOIN source_records e ON e.record_id = m.id""",
    "audit_museums": _AUDIT_M,
    "audit_exhibitions": _AUDIT_E,
    "audit_report": f'SELECT "check", severity, count(*) AS findings FROM (({_AUDIT_M}) UNION ALL ({_AUDIT_E})) f GROUP BY 1, 2',
    "audit_samples": f'SELECT * FROM (SELECT "check", severity, subject, row_number() OVER (PARTITION BY "check" ORDER BY subject) AS rn FROM ({_AUDIT_E}) f) WHERE rn <= 5',
    "schedule": """
WITH e AS (SELECT site, last_attempt_at AS ts, min(CASE WHEN consecutive_failures > 0 THEN 'failed' WHEN last_change_at = last_attempt_at THEN 'changed' ELSE 'unchanged' END) AS outcome
  FROM site_scrapes WHERE site IS NOT NULL AND last_attempt_at IS NOT NULL GROUP BY 1, 2),
g AS (SELECT site, coalesce(list(CASE WHEN outcome = 'changed' THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END ORDER BY ts) FILTER (WHERE outcome <> 'failed'), []) AS f, max(ts) FILTER (WHERE outcome <> 'failed') AS good FROM e GROUP BY site),
s AS (SELECT g.site, CASE WHEN len(f) < 2 THEN 168.0::DOUBLE ELSE list_reduce(f[2:], lambda a, x: greatest(48.0::DOUBLE, least(1440.0::DOUBLE, a * x)), 168.0::DOUBLE) END AS iv,
  (SELECT count(*) FROM e WHERE e.site = g.site AND outcome = 'failed' AND (good IS NULL OR ts > good)) AS failures FROM g)
SELECT site, iv AS interval_hours, failures, failures >= 6 AS parked, CASE WHEN failures >= 6 THEN 1440.0 WHEN failures > 0 THEN 12.0 * pow(2, least(failures - 1, 5)) ELSE iv END AS wait_hours FROM s""",
    "due_sites": f"WITH {_LATEST} SELECT site, last_attempt_at IS NULL AS never, epoch_us(next_due_at) AS due_us FROM latest WHERE parked_reason IS NULL AND coalesce(next_due_at <= TIMESTAMPTZ '2026-06-01 00:00:00+00', true)",
    "sweep_status": f"""WITH {_LATEST} SELECT count(*) AS sites, count_if(last_attempt_at IS NULL) AS never_read, count_if(parked_reason IS NOT NULL) AS parked,
  count_if(parked_reason IS NULL AND next_due_at <= TIMESTAMPTZ '2026-06-01 00:00:00+00') AS due, count_if(consecutive_failures > 0) AS failing, round(quantile_cont(interval_hours, 0.5) FILTER (WHERE parked_reason IS NULL), 4) AS median_hours FROM latest""",
    "retired_listings": f"""WITH {_LATEST} SELECT DISTINCT exhibition_id FROM exhibitions e JOIN latest l ON l.site = e.site
WHERE e.retired_at IS NULL AND e.source = 'scraped' AND l.found_count > 0 AND l.last_success_at IS NOT NULL AND e.last_seen_at < l.last_success_at""",
    "site_fingerprints": """
WITH h AS (SELECT DISTINCT site, sha256(concat_ws(chr(0), url, coalesce(title, ''), coalesce(CAST(starts_on AS VARCHAR), ''), coalesce(CAST(ends_on AS VARCHAR), ''))) AS h FROM exhibitions WHERE site IS NOT NULL)
SELECT site, count(*) AS listings, CAST(sum(CAST(('0x' || substring(h, 1, 12))::BIGINT AS DECIMAL(38,0))) AS VARCHAR) AS low, CAST(sum(CAST(('0x' || substring(h, 13, 12))::BIGINT AS DECIMAL(38,0))) AS VARCHAR) AS high FROM h GROUP BY site""",
    "new_sites": f"SELECT DISTINCT site FROM (SELECT {_HOST} AS site FROM museums) m WHERE site IS NOT NULL AND site NOT IN (SELECT site FROM site_scrapes WHERE site IS NOT NULL)",
}
