"""Queries of state writes and title rules, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from vitrine.functions import rules
from vitrine.operators import state
from vitrine.operators.search import placed
from vitrine.functions.text import site_host
from vitrine.session import table

SPLIT, NOW = "2026-05-01", datetime(2026, 6, 1, tzinfo=timezone.utc)
# Countries of the reference list, as lower-case spellings.
COUNTRIES = ("United Kingdom", "United States", "Ireland", "Canada", "Australia", "New Zealand", "Fiji", "Germany", "Austria", "Switzerland", "France", "Belgium", "Spain", "Mexico", "Italy", "Netherlands", "Sweden", "Norway", "Russia", "Greece", "Japan")
SPELLINGS = {c.lower(): c for c in COUNTRIES} | {"uk": "United Kingdom", "usa": "United States", "holland": "Netherlands"}


def _exhibitions(s, d):
    e = table(s, d, "exhibitions")
    at = F.lit(SPLIT).cast("timestamp")
    out = state.upsert_exhibitions(e.filter(F.col("loaded_at") < at), e.filter(F.col("loaded_at") >= at))
    return out.select("url", "title", "site", F.col("starts_on").cast("string").alias("starts_on"), F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), F.col("retired_at").isNull().alias("live"))


def _places(s, d):
    p = table(s, d, "places")
    at = F.lit(SPLIT).cast("timestamp")
    out = state.save_places(p.filter(F.col("resolved_at") < at), p.filter(F.coalesce(F.col("resolved_at") >= at, F.lit(True))))
    return out.select("query", "display_name", "found", F.unix_micros("resolved_at").alias("resolved_us"))


def _states(s, d):
    out = state.scrape_states(table(s, d, "site_scrapes"))
    return out.select("site", F.unix_micros("last_attempt_at").alias("attempt_us"), F.unix_micros("last_success_at").alias("success_us"), F.unix_micros("last_change_at").alias("change_us"), "fingerprint")


def _turns(s, d):
    m = placed(table(s, d, "museums")).withColumn("site", site_host(F.col("website"))).filter("site IS NOT NULL").groupBy("site").agg(F.max_by(F.struct("lat", "lon", "sitelinks"), F.struct(F.coalesce("sitelinks", F.lit(0)), -F.col("id"))).alias("t")).select("site", "t.*")
    asked = placed(table(s, d, "places")).select("lat", "lon")
    corner = table(s, d, "areas").select(F.col("ring")[0].alias("r")).select(state.cell_label(F.col("r.lat"), F.col("r.lon")).alias("cell"), F.lit(NOW).alias("scraped_at"))
    return state.area_queue(asked, corner.distinct(), m, NOW).select(F.col("turn").cast("bigint").alias("turn"), "cell", "site")


def _titles(s, d):
    m = table(s, d, "museums")
    c = rules.classify(F.col("name"), F.lit(0), F.lit(False), F.col("description"))
    return m.select("id", c.alias("c"), rules.country_in_description(F.col("description"), SPELLINGS).alias("told"), rules.canonical_country(F.col("country"), SPELLINGS).alias("country")).select("id", "c.decision", "c.reason", "told", "country")


QUERIES = {"exhibition_upsert": _exhibitions, "place_cache": _places, "scrape_states": _states, "area_turns": _turns, "title_rules": _titles}


def _canon(x: str) -> str:
    pick = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPELLINGS.items())
    low = f"lower(trim({x}))"
    return f"coalesce(CASE {low} {pick} END, CASE regexp_replace({low}, '^the\\s+', '') {pick} END)"


_T = "lower(concat_ws(' ', name, description))"
SQL = {
    "exhibition_upsert": f"""
WITH b AS (SELECT *, CASE WHEN loaded_at < TIMESTAMPTZ '{SPLIT} 00:00:00+00' THEN 0 ELSE 1 END AS side FROM exhibitions WHERE url <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY side DESC, scraped_at DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM b),
g AS (SELECT url, min(first_seen_at) AS f, max(last_seen_at) AS l FROM b GROUP BY url)
SELECT r.url, title, site, CAST(starts_on AS VARCHAR) AS starts_on, epoch_us(f) AS first_us, epoch_us(l) AS last_us, (side = 1 OR retired_at IS NULL) AS live FROM r JOIN g ON g.url = r.url WHERE rn = 1""",
    "place_cache": """
SELECT query, display_name, found, epoch_us(resolved_at) AS resolved_us FROM (SELECT lower(trim(query)) AS query, display_name, found, resolved_at,
  row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY resolved_at DESC NULLS LAST, place_id DESC) AS rn FROM places WHERE query IS NOT NULL) WHERE rn = 1""",
    "scrape_states": """
WITH s AS (SELECT site, max(last_attempt_at) AS a, max(last_success_at) AS s, max(last_change_at) AS c FROM site_scrapes WHERE site IS NOT NULL GROUP BY site),
f AS (SELECT site, fingerprint, row_number() OVER (PARTITION BY site ORDER BY last_attempt_at DESC NULLS LAST, loaded_at DESC) AS rn FROM site_scrapes WHERE consecutive_failures = 0 AND fingerprint <> '')
SELECT s.site, epoch_us(a) AS attempt_us, epoch_us(s.s) AS success_us, epoch_us(c) AS change_us, fingerprint FROM s LEFT JOIN f ON f.site = s.site AND rn = 1""",
    "area_turns": """
WITH m AS (SELECT *, nullif(regexp_replace(lower(regexp_extract(website, '(?i)^https?://([^/:?#]+)', 1)), '^www\\.', ''), '') AS site, location.lat AS lat, location.lon AS lon FROM museums
  WHERE location.lat BETWEEN -90 AND 90 AND location.lon BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lon = 0)),
t AS (SELECT site, sitelinks, printf('%.2f,%.2f', round(lat / 0.25) * 0.25 + 0.0, round(lon / 0.25) * 0.25 + 0.0) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY coalesce(sitelinks, 0) DESC, id) AS rn FROM m WHERE site IS NOT NULL) WHERE rn = 1),
c AS (SELECT DISTINCT printf('%.2f,%.2f', round(location.lat / 0.25) * 0.25 + 0.0, round(location.lon / 0.25) * 0.25 + 0.0) AS cell FROM places WHERE location.lat BETWEEN -90 AND 90 AND location.lon BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lon = 0)),
x AS (SELECT printf('%.2f,%.2f', round(ring[1].lat / 0.25) * 0.25 + 0.0, round(ring[1].lon / 0.25) * 0.25 + 0.0) AS cell FROM areas)
SELECT * FROM (SELECT row_number() OVER (PARTITION BY t.cell ORDER BY sitelinks DESC NULLS LAST, site) AS turn, t.cell, site FROM t JOIN c ON c.cell = t.cell WHERE t.cell NOT IN (SELECT cell FROM x)) WHERE turn <= 120""",
    "title_rules": f"""
WITH k AS (SELECT id, name, description, country, regexp_replace(description, '[.\\s]+$', '') AS bare,
  CASE WHEN regexp_matches(lower(name), '^lists? of ') THEN 'reject|list' WHEN regexp_matches({_T}, '{rules.VENUE}') THEN 'accept|venue' {' '.join(f"WHEN regexp_matches({_T}, '{p}') THEN 'reject|{n}'" for n, p in rules.REJECTS)}
  WHEN regexp_matches(coalesce(description, ''), '{rules.LIFE_SPAN}') THEN 'reject|life span' ELSE 'unsure|no evidence' END AS k FROM museums)
SELECT id, string_split(k, '|')[1] AS decision, string_split(k, '|')[2] AS reason, coalesce({_canon("string_split(bare, ',')[-1]")}, {_canon("regexp_extract(bare, '(?i)^.*\\sin\\s+(.+)$', 1)")}) AS told, {_canon('country')} AS country FROM k""",
}
