"""Queries of the problems on texts and entities, and the SQL they are held against."""

from __future__ import annotations

from vitrine.llm import bpe, canonical, confusables, matching, packing, sentences, survivorship, variants
from vitrine.plans.catalogue import _fold
from vitrine.session import table


def _t(s, d, *names):
    return [table(s, d, n) for n in names]


QUERIES = {
    "p1_found": lambda s, d: confusables.p1_found(*_t(s, d, "museums")),
    "p1_forms": lambda s, d: confusables.entry_forms(*_t(s, d, "museums")),
    "p7_found": lambda s, d: survivorship.p7_found(*_t(s, d, "merge_groups", "museums")),
    "p7_rows": lambda s, d: survivorship.p7_rows(*_t(s, d, "merge_groups", "museums")),
    "p4_found": lambda s, d: variants.p4_found(*_t(s, d, "museums", "places")),
    "p5_found": lambda s, d: matching.p5_found(*_t(s, d, "museums", "source_records", "gazetteer")),
    "p5_matches": lambda s, d: matching.p5_matches(*_t(s, d, "museums", "source_records", "gazetteer")),
    "p6_found": lambda s, d: canonical.p6_found(*_t(s, d, "museums", "places", "gazetteer")),
    "p10_found": lambda s, d: sentences.split_documents(*_t(s, d, "documents"), vocabulary=bpe.path_of("byte_bpe_multi_50k.tiktoken")),
    "p9_containers": lambda s, d: packing.p9_containers(*_t(s, d, "documents")),
    "p9_fill": lambda s, d: packing.p9_fill(*_t(s, d, "documents")),
    "p8_ids": lambda s, d: bpe.encode(*_t(s, d, "documents")),
}

_P7 = """
WITH m AS (
  SELECT DISTINCT g.group_id, g.museum_id, website, description, location, coalesce(location_approximate, false) AS approx, sources, updated_at
  FROM merge_groups g JOIN museums m ON m.id = g.museum_id),
site AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY updated_at DESC NULLS LAST, museum_id) AS rn FROM m
  WHERE (starts_with(website, 'http://') AND contains(website[8:], '.')) OR (starts_with(website, 'https://') AND contains(website[9:], '.'))),
dsc AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY length(description) DESC, museum_id) AS rn,
    count(*) OVER (PARTITION BY group_id, length(description)) AS n FROM m
  WHERE regexp_matches(description, '[\\p{L}\\p{Nd}]')
    AND lower(trim(description)) NOT IN ('n/a', 'na', 'none', 'null', 'nil', 'todo', 'tbd', 'tba', 'unknown', 'no description', 'description', 'placeholder', 'not available', 'coming soon', 'test')),
loc AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY approx, updated_at DESC NULLS LAST, museum_id) AS rn FROM m
  WHERE location.lat BETWEEN -90 AND 90 AND location.lon BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lon = 0)),
srcn AS (SELECT *, len(list_distinct(list_transform(sources, lambda x: lower(trim(x))))) AS k FROM m),
src AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY k DESC, museum_id) AS rn, count(*) OVER (PARTITION BY group_id, k) AS n FROM srcn)
"""

# -- p6: the same rules written out again; levenshtein counts bytes there, so each letter becomes one byte first
def _p6_strip(x: str) -> str:
    out = f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    out = f"regexp_replace({out}, '^\\((.*)\\)$', '\\1')"
    for _ in range(2):
        for p in (
            "^\\d{2,7}\\s+", "^\\d+\\s*(st|nd|rd|th|e|er|º|ª|°|\\.)?\\s*(bezirk|arrondissement|ward|district|distrito|quartiere|stadtteil)\\s*,\\s*",
            "^(the )?(municipality|city|town|centre|center|district|province|region|commune) of\\s+", "^(greater|near|around|in|museums? in|museum near|close to)\\s+",
            "\\s+(municipality|stadt|city|town|district)$", "\\s*\\((country|district|city|town|region|state)\\)$",
        ):
            out = f"regexp_replace({out}, '{p}', '')"
    return f"trim({out})"


def _p6_key(x: str) -> str:
    out = f"lower(trim({x}))"
    for p, full in (("^up\\.?\\s+", "upper "), ("^lr\\.?\\s+", "lower "), ("^st\\.?\\s+", "saint "), ("^ste\\.?\\s+", "sainte "), ("^b\\.\\s*(\\p{L}{3})", "bad \\1"), ("^s\\.\\s*(\\p{L}{3})", "san \\1"), ("^m\\.?te\\.?\\s+", "monte "), ("^mt\\.?\\s+", "mount "), ("^n\\.\\s+(\\p{L}{3})", "new \\1")):
        out = f"regexp_replace({out}, '{p}', '{full}')"
    return f"replace({_fold(out)}, ' ', '')"


# the last letter pair struck twice, letter by letter, as the patterns there know no back reference
_SQUEEZE = "array_to_string(list_transform(list_filter(range(1, length(o.key) + 1), lambda i: i = 1 OR o.key[i] <> o.key[i - 1]), lambda i: o.key[i]), '')"


def _p6_map(name: str, keys: str, refs: str) -> str:
    """CTEs that map the keys of one CTE to the names of another: equal, or else within two errors."""
    byte = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: chr(33 + unicode(x) % 93)), '')"
    swapped = "length(key) = length(rkey) AND list_sort(string_split(key, '')) = list_sort(string_split(rkey, ''))"
    return f"""{name}_n AS (SELECT DISTINCT key AS rkey, kind FROM {refs}),
{name}_e AS (SELECT k.key, kind, rkey, 0 AS cost FROM {keys} k JOIN {name}_n ON rkey = k.key),
{name}_o AS (SELECT key, {byte('key')} AS b FROM {keys} WHERE key NOT IN (SELECT rkey FROM {name}_n)),
{name}_l AS (SELECT key, kind, rkey, levenshtein(b, {byte('rkey')}) AS d FROM {name}_o, {name}_n WHERE length(rkey) >= 4 AND length(key) >= 3 AND abs(length(key) - length(rkey)) <= 2 AND regexp_matches(key, '\\p{{L}}')),
{name} AS (SELECT * FROM {name}_e
  UNION SELECT key, kind, rkey, CASE WHEN d = 2 AND NOT ({swapped}) THEN 2 ELSE 1 END FROM {name}_l WHERE d = 1 OR (d = 2 AND (({swapped}) OR length(rkey) >= 6))
  UNION SELECT o.key, kind, rkey, 1 FROM {name}_o o JOIN {name}_n ON rkey = {_SQUEEZE} WHERE length(o.key) BETWEEN 3 AND 4 AND rkey <> o.key)"""


_MARK = "^(.*\\S)\\s*(,|\\s[-–—]\\s?|\\s?[-–—]\\s)\\s*([^,]+)$"
_POS = "CASE WHEN location.lat BETWEEN -90 AND 90 AND location.lon BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lon = 0) THEN location.{} END AS {}"
_P6 = f"""
WITH v AS (
  SELECT 'country' AS field, id AS record_id, country AS raw, NULL AS ctx, {_POS.format('lat', 'lat')}, {_POS.format('lon', 'lon')} FROM museums
  UNION ALL SELECT 'locality', id, locality, country, {_POS.format('lat', 'lat')}, {_POS.format('lon', 'lon')} FROM museums
  UNION ALL SELECT 'query', place_id, query, regexp_replace(string_split(display_name, ',')[-1], '^ +', ''), {_POS.format('lat', 'lat')}, {_POS.format('lon', 'lon')} FROM places),
rows AS (SELECT * FROM v WHERE record_id IS NOT NULL AND trim(raw) <> '' AND NOT EXISTS (SELECT 1 FROM gazetteer g WHERE g.name = v.raw AND (field = 'query' OR (field = 'country' AND kind = 'country') OR (field = 'locality' AND kind = 'town')))),
refs AS (SELECT DISTINCT entry_id, kind, country, lat, lon, {_p6_key('n')} AS key FROM (SELECT entry_id, kind, country, lat, lon, unnest(list_concat([name], coalesce(other_names, []))) AS n FROM gazetteer WHERE entry_id IS NOT NULL) x WHERE {_p6_key('n')} <> ''),
lands AS (SELECT * FROM refs WHERE kind = 'country'), known AS (SELECT DISTINCT key AS tail, country AS tail_country FROM lands),
base AS (SELECT field, raw, {_p6_strip('raw')} AS s FROM (SELECT DISTINCT field, raw FROM rows) d WHERE {_p6_strip('raw')} <> ''),
m0 AS (SELECT field, raw, regexp_extract(s, '{_MARK}', 1) AS core, {_p6_key(f"regexp_extract(s, '{_MARK}', 3)")} AS tail FROM base WHERE regexp_matches(s, '{_MARK}')),
marked AS (SELECT * FROM m0 WHERE tail <> ''), mk AS (SELECT DISTINCT tail AS key FROM marked),
{_p6_map('mt', 'mk', 'lands')},
loose AS (SELECT key AS tail, arg_min(rkey, cost || '|' || rkey) AS rkey FROM mt GROUP BY key),
l0 AS (SELECT field, raw, w, unnest(range(1, len(w))) AS i FROM (SELECT field, raw, string_split(s, ' ') AS w FROM base WHERE field <> 'country') x),
l1 AS (SELECT field, raw, array_to_string(w[1:len(w) - i], ' ') AS core, {_p6_key("array_to_string(w[len(w) - i + 1:], ' ')")} AS tail FROM l0),
ended AS (SELECT field, raw, core, l1.tail, tail_country FROM l1 JOIN known ON known.tail = l1.tail
  UNION SELECT field, raw, core, marked.tail, tail_country FROM marked JOIN loose ON loose.tail = marked.tail JOIN known ON known.tail = loose.rkey),
cores AS (SELECT field, raw, {_p6_key('s')} AS key, '' AS tail, NULL AS tail_country FROM base UNION SELECT field, raw, {_p6_key(_p6_strip('core'))}, tail, tail_country FROM ended),
ck AS (SELECT DISTINCT key FROM cores WHERE key <> ''),
{_p6_map('cm', 'ck', 'refs')},
named AS (SELECT c.field, c.raw, c.tail, c.tail_country, m.kind, m.rkey, m.cost FROM cores c JOIN cm m ON m.key = c.key
  WHERE (field = 'query' OR (field = 'country' AND kind = 'country') OR (field = 'locality' AND kind = 'town')) AND NOT (kind = 'country' AND tail <> '')),
scored AS (SELECT n.field, n.raw, r.entry_id, r.country, r.lat, r.lon, (cost + CASE WHEN coalesce(tail <> '' AND r.country <> tail_country, false) THEN 1 ELSE 0 END) * 10000 + CASE WHEN n.kind = 'town' THEN 0 ELSE 5000 END + length(tail) AS score
  FROM named n JOIN refs r ON r.key = n.rkey AND r.kind = n.kind),
opts AS (SELECT DISTINCT s.* FROM scored s JOIN (SELECT field, raw, min(score) AS low FROM scored GROUP BY 1, 2) b ON b.field = s.field AND b.raw = s.raw AND s.score = b.low),
got AS (SELECT rows.field, record_id, entry_id, row_number() OVER (PARTITION BY rows.field, record_id, rows.raw ORDER BY CASE WHEN o.country = ctx THEN 0 ELSE 1 END,
  coalesce(pow(o.lat - rows.lat, 2) + pow((o.lon - rows.lon) * cos(radians(rows.lat)), 2), 1e9), entry_id) AS rn FROM rows LEFT JOIN opts o ON o.field = rows.field AND o.raw = rows.raw)
SELECT DISTINCT field, record_id, coalesce(entry_id, -1) AS entry_id FROM got WHERE rn = 1"""

SQL = {
    "p6_found": _P6,
    "p7_found": _P7
    + """SELECT group_id, 'website' AS field, museum_id FROM site WHERE rn = 1
UNION ALL SELECT group_id, 'description', museum_id FROM dsc WHERE rn = 1 AND n = 1
UNION ALL SELECT group_id, 'location', museum_id FROM loc WHERE rn = 1
UNION ALL SELECT group_id, 'sources', museum_id FROM src WHERE rn = 1 AND n = 1""",
    "p7_rows": _P7
    + """SELECT g.group_id, site.website, dsc.description, loc.location.lat AS lat, loc.location.lon AS lon,
  array_to_string(src.sources, '|') AS sources
FROM (SELECT DISTINCT group_id FROM m) g
LEFT JOIN site ON site.group_id = g.group_id AND site.rn = 1
LEFT JOIN dsc ON dsc.group_id = g.group_id AND dsc.rn = 1 AND dsc.n = 1
LEFT JOIN loc ON loc.group_id = g.group_id AND loc.rn = 1
LEFT JOIN src ON src.group_id = g.group_id AND src.rn = 1 AND src.n = 1""",
}
