from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vitrine.operators import quality, resolve, schedule, search
from vitrine.sources import readers, sinks

ROW = "id bigint, wikidata_id string, name string, normalized string, country string, locality string, description string, website string, aliases array<string>, sources array<string>, classes array<string>, verified boolean, location struct<lat: double, lon: double>, sitelinks int, location_approximate boolean"


def rows(spark, *items):
    base = dict(wikidata_id=None, name="n", normalized="n", country="Spain", locality=None, description=None, website=None, aliases=[], sources=["osm"], classes=[], verified=False, location=None, sitelinks=0, location_approximate=False)
    return spark.createDataFrame([{**base, **i} for i in items], ROW)


def test_upsert_policies(spark):
    old = rows(spark, dict(id=1, wikidata_id="Q1", name="Old", website="http://a.example", aliases=["x"], sitelinks=3, location=(1.0, 2.0)))
    new = rows(spark, dict(id=9, wikidata_id="Q1", name="New", website="", aliases=["", "y"], verified=True, sources=["w"], sitelinks=1), dict(id=10, wikidata_id="", name="Other", normalized="other", country="Unknown"))
    got = {r.identity: r for r in resolve.upsert(old, new).collect()}
    r = got["Q1"]
    assert (r.name, r.website, r.aliases, r.sources, r.verified, r.sitelinks, r.location.lat) == ("New", "http://a.example", ["x", "y"], ["osm", "w"], True, 3, 1.0)
    assert set(got) == {"Q1", "other|"} and resolve.upsert(old.limit(0), new.limit(0)).count() == 0
    again = resolve.upsert(old, old.union(old)).collect()
    assert len(again) == 1


def test_merges(spark):
    m = rows(
        spark, dict(id=1, wikidata_id="Q1", normalized="glass museum", aliases=["Verre"], location=(10.0, 10.0), sitelinks=5), dict(id=2, normalized="glass museum"),
        dict(id=3, normalized="verre", location=(10.0, 10.001)), dict(id=4, normalized="verre", location=(11.0, 10.0)), dict(id=5, normalized="museum glass", location=(10.0005, 10.0)),
    )
    assert {tuple(r) for r in resolve.same_name_merges(m).collect()} == {(2, 1)}
    assert {tuple(r) for r in resolve.alias_merges(m).collect()} == {(3, 1)}
    assert {tuple(r) for r in resolve.name_variant_merges(m).collect()} == {(5, 1)}
    merged = {r.id: r for r in resolve.apply_merges(m, resolve.same_name_merges(m)).collect()}
    assert set(merged) == {1, 3, 4, 5}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 11), (20, 20), (4, 5), (9, 5)], "a bigint, b bigint")
    got = dict((r.node, r.label) for r in resolve.components(e).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 1, 10: 10, 11: 10, 20: 20}


def test_placements(spark):
    m = rows(spark, dict(id=1, locality="Dover Town", location=(51.0, 1.0)), dict(id=2, locality="dover town"), dict(id=3, locality="Dover Harbour"), dict(id=4, locality=""), dict(id=5, locality="Far", location=(0.5, 0.5)), dict(id=6, locality="Far", location=(5.0, 5.0)), dict(id=7, locality="far"))
    assert {(r.id, r.tier) for r in resolve.town_placements(m).collect()} == {(2, 1), (3, 2)}


def test_search_and_paging(spark):
    m = rows(spark, *(dict(id=i, name=f"m{i}", location=(50.0 + i / 1000, 1.0)) for i in range(25)), dict(id=99, name="none"))
    pages = [[r.id for r in search.nearby(m, 50.0, 1.0, 20, limit=10, offset=o).collect()] for o in (0, 10, 20)]
    assert sum(pages, []) == list(range(25)) and search.nearby(m, 50.0, 1.0, 20).first().total == 25
    found = rows(spark, dict(id=1, name="Kunstmuseum Zürich"), dict(id=2, name="National Museum Zurich"), dict(id=3, name="Vikingr", aliases=["kunst"]))
    assert search.search_museums(found, "kunstmusem zurich").first().id == 1
    assert search.search_museums(found, "kunst").first().id == 3


def test_schedule_vectors(spark):
    t = lambda d: datetime(2026, 8, d)
    ev = [("new", t(1), "changed"), ("slow", t(1), "changed"), ("slow", t(2), "unchanged"), ("fast", t(1), "unchanged"), ("fast", t(2), "changed")]
    ev += [("top", t(d), "unchanged") for d in range(1, 21)] + [("low", t(d), "changed") for d in range(1, 12)] + [("dead", t(d), "failed") for d in range(1, 7)] + [("ill", t(1), "failed"), ("ill", t(2), "failed")]
    got = {r.site: r for r in schedule.schedule(spark.createDataFrame(ev, "site string, ts timestamp, outcome string")).collect()}
    assert {k: v.interval_hours for k, v in got.items()} == {"new": 168, "slow": 252, "fast": 84, "top": 1440, "low": 48, "dead": 168, "ill": 168}
    assert got["dead"].parked and got["dead"].wait_hours == 1440 and got["ill"].wait_hours == 24 and not got["ill"].parked


def test_token_bucket_and_retire(spark):
    r = spark.createDataFrame([("a", float(i) / 100) for i in range(60)] + [("b", 1.0)], "client string, at double")
    got = {x.client: (x.allowed, x.refused) for x in schedule.token_bucket(r).collect()}
    assert got["b"] == (1, 0) and got["a"][0] in (35, 36) and sum(got["a"]) == 60
    e = spark.createDataFrame([(1, "s", None, "scraped", datetime(2026, 1, 1)), (2, "s", None, "submitted", datetime(2026, 1, 1)), (3, "s", None, "scraped", datetime(2026, 1, 3)), (4, "z", None, "scraped", datetime(2026, 1, 1))], "exhibition_id bigint, site string, retired_at timestamp, source string, last_seen_at timestamp")
    reads = spark.createDataFrame([("s", datetime(2026, 1, 2), 3), ("z", datetime(2026, 1, 2), 0)], "site string, began timestamp, found int")
    assert [x.exhibition_id for x in schedule.retire_unseen(e, reads).collect()] == [1]


def test_audit_exhibitions(spark):
    d = [(1, date(2026, 2, 1), date(2026, 1, 1), False, "x"), (2, date(1990, 1, 1), None, False, "x"), (3, None, date(2026, 2, 1), True, "x"), (4, None, None, None, " Read More "), (4, None, None, None, " Read More ")]
    e = spark.createDataFrame([(*x, datetime(2026, 5, 30)) for x in d], "exhibition_id bigint, starts_on date, ends_on date, permanent boolean, title string, scraped_at timestamp")
    assert {(r.check, r.subject) for r in quality.audit_exhibitions(e, date(2026, 6, 1)).collect()} == {("exhibition-ends-before-it-starts", "1"), ("exhibition-dates-implausible", "2"), ("exhibition-permanent-but-ends", "3"), ("exhibition-title-is-boilerplate", "4")}


def test_sources_and_sinks(spark, tmp_path):
    msg = spark.createDataFrame([('{"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "raw/a+b%2F1.json"}}}]}',), ("{bad",), (None,)], "value string")
    assert [tuple(r) for r in readers.notified_keys(msg).collect()] == [("b", "raw/a b/1.json")]
    edges = spark.createDataFrame([("r", "a", None), ("a", "b", "Kent"), ("b", "r", None), ("b", "c", None), ("r", "c", "Essex")], "parent string, child string, hint string")
    got = {r.node: (r.depth, r.hint) for r in readers.walk(edges, spark.createDataFrame([("r", None)], "node string, hint string")).collect()}
    assert got == {"r": (0, None), "a": (1, None), "c": (1, "Essex"), "b": (2, "Kent")}
    assert spark.range(1).select(readers.point_of(F.lit("Point(2.5 -1)")).alias("p")).first().p == (-1.0, 2.5)
    k = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    path = str(tmp_path / "store")
    assert sinks.insert_absent(k, path, "k") == 2 and sinks.insert_absent(k, path, "k") == 0
    for v in "123":
        left = sinks.snapshot(k, str(tmp_path / "snap"), v, keep=2)
    assert left == ["2", "3"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"x": 1}')
    (tmp_path / "j" / "b.json").write_text("{nope")
    j = readers.json_objects(spark, str(tmp_path / "j"), "x int").cache()
    assert j.count() == 2 and j.filter("_corrupt_record IS NOT NULL").count() == 1


def test_ids_are_promoted_once(spark):
    schema = "id bigint, wikidata_id string, normalized string, country string"
    old = spark.createDataFrame([(1, None, "a", "Spain"), (2, "", "a", "Spain"), (3, "Q9", "b", "Spain"), (4, None, "c", "Spain"), (5, None, "", "Spain"), (6, None, "d", None)], schema)
    new = spark.createDataFrame([(10, "Q1", "a", "Spain"), (11, "Q2", "a", "Spain"), (12, "Q9", "c", "Spain"), (13, "Q3", "", "Spain"), (14, "Q4", "a", "France"), (15, None, "a", "Spain"), (16, "Q5", "d", None)], schema)
    assert [tuple(r) for r in resolve.promote_ids(old, new).collect()] == [(1, "Q1")]  # Q9 is held already
