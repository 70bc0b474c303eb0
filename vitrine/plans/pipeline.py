"""Queries of the two general pipeline problems (2 and 3)."""

from __future__ import annotations

from vitrine.operators import ledger, spatial
from vitrine.session import table

QUERIES = {
    "p2_found": lambda s, d: ledger.p2_found(*(table(s, d, t) for t in ("museums", "site_scrapes", "run_log", "run_items"))),
    "p2_states": lambda s, d: ledger.p2_states(*(table(s, d, t) for t in ("museums", "site_scrapes", "run_log", "run_items"))),
    "p3_found": lambda s, d: spatial.p3_found(*(table(s, d, t) for t in ("museums", "exhibitions", "areas"))),
}

SQL = {
    "p2_found": """
WITH marks AS (SELECT task, max(read_until) AS mark FROM run_log WHERE status = 'succeeded' GROUP BY task),
v AS (
  SELECT 'reindex' AS task, CAST(id AS VARCHAR) AS record_key, updated_at AS version, loaded_at FROM museums
  UNION ALL SELECT 'listing', site, last_change_at, loaded_at FROM site_scrapes),
newest AS (SELECT task, record_key, max(version) AS newest FROM v WHERE record_key IS NOT NULL GROUP BY 1, 2),
done AS (
  SELECT task, record_key, max(version) AS done FROM (
    SELECT v.task, record_key, version FROM v JOIN marks ON v.task = marks.task WHERE loaded_at <= mark
    UNION ALL SELECT DISTINCT l.task, i.record_key, i.version_at FROM run_items i JOIN run_log l ON l.run_no = i.run_no)
  GROUP BY 1, 2)
SELECT n.task, n.record_key FROM newest n LEFT JOIN done d ON d.task = n.task AND d.record_key = n.record_key
WHERE newest IS NOT NULL AND (done IS NULL OR newest > done)
""",
    "p2_states": """
WITH marks AS (SELECT task, max(read_until) AS mark FROM run_log WHERE status = 'succeeded' GROUP BY task),
v AS (
  SELECT 'reindex' AS task, CAST(id AS VARCHAR) AS record_key, updated_at AS version, loaded_at FROM museums
  UNION ALL SELECT 'listing', site, last_change_at, loaded_at FROM site_scrapes),
items AS (
  SELECT v.task, record_key, version, coalesce(loaded_at <= mark, false) AS done FROM v LEFT JOIN marks ON v.task = marks.task WHERE record_key IS NOT NULL AND version IS NOT NULL
  UNION ALL SELECT l.task, i.record_key, i.version_at, true FROM run_items i JOIN run_log l ON l.run_no = i.run_no WHERE l.task IS NOT NULL AND i.record_key IS NOT NULL AND i.version_at IS NOT NULL),
each AS (SELECT task, record_key, version, bool_or(done) AS done FROM items GROUP BY ALL)
SELECT task, CASE WHEN done THEN 'done' ELSE 'pending' END AS state, count(*) AS items FROM each GROUP BY ALL
""",
    "p3_found": """
WITH m AS (
  SELECT DISTINCT id, location.lat AS lat, location.lon AS lon FROM museums
  WHERE id IS NOT NULL AND location.lat BETWEEN -90 AND 90 AND location.lon BETWEEN -180 AND 180
    AND NOT (location.lat = 0 AND location.lon = 0) AND NOT coalesce(location_approximate, false)),
banded AS (SELECT *, CAST(floor(lat / 0.001) AS BIGINT) AS band FROM m),
probe AS (SELECT *, band + o AS b FROM banded, (VALUES (-1), (0), (1)) t(o)),
near AS (
  SELECT DISTINCT 'near' AS kind, a.id AS key_a, b.id AS key_b FROM probe a JOIN banded b ON a.b = b.band AND a.id < b.id
  WHERE 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 100),
e AS (
  SELECT DISTINCT exhibition_id, location.lat AS lat, location.lon AS lon FROM exhibitions
  WHERE exhibition_id IS NOT NULL AND location.lat BETWEEN -90 AND 90 AND location.lon BETWEEN -180 AND 180
    AND NOT (location.lat = 0 AND location.lon = 0)),
edges AS (
  SELECT area_id, n, ring[i].lat AS ay, ring[i].lon AS ax, ring[i % n + 1].lat AS by_, ring[i % n + 1].lon AS bx
  FROM (SELECT area_id, ring, len(ring) AS n, unnest(range(1, len(ring) + 1)) AS i FROM areas)),
box AS (SELECT area_id, min(ay) AS s, max(ay) AS n, min(ax) AS w, max(ax) AS e FROM edges GROUP BY 1),
cand AS (
  SELECT e.exhibition_id, e.lat, e.lon + t.o AS x, box.area_id FROM e, (VALUES (0), (360), (-360)) t(o), box
  WHERE e.lat BETWEEN box.s AND box.n AND e.lon + t.o BETWEEN box.w AND box.e),
held AS (
  SELECT c.exhibition_id, c.area_id FROM cand c JOIN edges g ON g.area_id = c.area_id
  WHERE (g.ay > c.lat) <> (g.by_ > c.lat) AND c.x < (g.bx - g.ax) * (c.lat - g.ay) / (g.by_ - g.ay) + g.ax
  GROUP BY c.exhibition_id, c.area_id, c.lat, c.x HAVING count(*) % 2 = 1)
SELECT kind, key_a, key_b FROM near
UNION SELECT 'area', exhibition_id, CAST(area_id AS BIGINT) FROM held
""",
}
