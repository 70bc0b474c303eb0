import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vitrine.functions import fuzzy, geo, html, rules, text, wikitext
from vitrine.operators import lookup, quality, resolve, schedule, search, state, wiki
from vitrine.sources import readers, sinks
from vitrine.sources.paged import PagedSource

NOW = datetime(2026, 6, 1)


def test_point_reads_and_pages(spark):
    m = spark.createDataFrame([(1, "Q1", "a", 3), (2, None, "b", None), (3, "Q3", "c", 9)], "id bigint, wikidata_id string, name string, sitelinks int")
    assert [r.id for r in lookup.museum_by(m, "2").collect()] == [2] and [r.id for r in lookup.museum_by(m, "Q3").collect()] == [3] and lookup.museum_by(m, "Q9").isEmpty()
    page = lookup.page_of(m.select("id", "name"), [F.desc("id")], 2)
    assert [(r.id, r.total, r.has_more) for r in page.collect()] == [(3, 3, True), (2, 3, True)]
    got = json.loads(lookup.response(page, limit=2))
    assert got["count"] == 2 and got["total"] == 3 and got["has_more"] and got["limit"] == 2 and got["items"][0] == {"id": 3, "name": "c"}
    assert json.loads(lookup.response(lookup.page_of(m.limit(0), [F.col("id")], 5)))["items"] == []
    for bad in (dict(radius_km=51), dict(limit=0), dict(offset=-1), dict(lat=91), dict(query="x" * 201)):
        with pytest.raises(ValueError):
            search.check_limits(**bad)


def test_shows_match_by_id_or_by_name(spark):
    m = spark.createDataFrame([(1, "Q1", "Musée A"), (2, "", "Other"), (3, None, "other!")], "id bigint, wikidata_id string, name string")
    e = spark.createDataFrame([(10, "Q1", "wrong name"), (11, None, "MUSEE A"), (12, "", "Other"), (13, "Q9", "Other"), (14, None, None), (10, "Q1", "wrong name")], "exhibition_id bigint, museum_wikidata_id string, museum string")
    got = lookup.show_matches(m, e)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10), (1, 11), (2, 12), (3, 12)]
    assert sorted(tuple(r) for r in lookup.show_counts(got).collect()) == [(1, 2), (2, 1), (3, 1)]


def test_labels_and_orders(spark):
    days = [None, -1, 0, 1, 14, 15, 60, 61]
    df = spark.createDataFrame([(i, None if n is None else date.fromordinal(date(2026, 6, 1).toordinal() + n)) for i, n in enumerate(days)], "exhibition_id int, ends_on date")
    assert [r.label for r in lookup.running_labels(df, date(2026, 6, 1)).orderBy("exhibition_id").collect()] == ["no end", "over", "last day", "1 day left", "14 days left", "2 weeks left", "9 weeks left", "open"]
    rows = spark.createDataFrame([(1, None, 1.0, "a"), (2, date(2026, 7, 1), 5.0, "b"), (3, date(2026, 7, 1), 2.0, "c")], "exhibition_id int, ends_on date, distance_km double, museum string")
    assert [r.exhibition_id for r in lookup.closing_order(rows).collect()] == [3, 2, 1]
    f = spark.createDataFrame([("b", "info", "1"), ("z", "error", "2"), ("a", "error", "3"), ("a", "warning", "1")], "check string, severity string, subject string")
    assert [r.subject + r.check for r in quality.in_report_order(f).collect()] == ["3a", "2z", "1a", "1b"]


def test_places_resolve_in_tiers(spark):
    asked = spark.createDataFrame([(q,) for q in ("Ath ", "ath", "Bree", "gone", "Cinei", "xyz", "", None)], "query string")
    cache = spark.createDataFrame([("ATH", True, 1.0, 2.0, 3.0), ("gone", False, None, None, None)], "query string, found boolean, lat double, lon double, radius_km double")
    coded = spark.createDataFrame([("bree", 5.0, 6.0, 7.0), ("ath", 9.0, 9.0, 9.0)], "query string, lat double, lon double, radius_km double")
    m = spark.createDataFrame([("Belgium", "Ciney", (50.0, 5.0)), ("Belgium", "Ciney", (50.2, 5.0)), ("Belgium", None, None)], "country string, locality string, location struct<lat: double, lon: double>")
    got = {r.query: r for r in lookup.resolve_places(asked, cache, coded, m).collect()}
    assert {k: r.tier for k, r in got.items()} == {"ath": "cache", "gone": "none", "bree": "geocoder", "cinei": "town", "xyz": "none"}
    assert got["ath"].lat == 1.0 and abs(got["cinei"].lat - 50.1) < 1e-9 and got["xyz"].lat is None


def test_editions_and_prunes(spark):
    e = wiki.editions(spark).collect()
    assert e[0].lang == "en" and e[0].source == "wikipedia" and len(e) == 18 and all(":" in r.root for r in e)
    df = spark.createDataFrame([(t,) for t in ("Category:Museum directors", "Category:Film museums", "Category:Collections of the Louvre", "Kategorie:Museum in Wien", "Category:Works by X")], "t string")
    assert [r[0] for r in df.select(wiki.skips_category(F.col("t"))).collect()] == [True, False, True, False, True]
    edges = spark.createDataFrame([("r", "Category:A museums", None), ("Category:A museums", "Category:Museum staff", None), ("Category:Museum staff", "Category:B museums", None)], "parent string, child string, hint string")
    assert {r.node for r in wiki.walk_categories(edges, spark.createDataFrame([("r", None)], "node string, hint string")).collect()} == {"r", "Category:A museums"}
    lists = spark.createDataFrame([("L", "L1", True), ("L", "Museum", False), ("L1", "L", True), ("L1", "L2", True)], "page string, title string, is_list boolean")
    assert {(r.page, r.depth) for r in wiki.nested_lists(lists, spark.createDataFrame([("L",)], "page string")).collect()} == {("L", 0), ("L1", 1), ("L2", 2)}


def test_page_metadata_follows_redirects(spark):
    pair = "`from` string, `to` string"
    pages = spark.createDataFrame([("C", 7, {"wikibase-shortdesc": "a museum", "wikibase_item": "Q7"}, [(1.0, 2.0)]), ("D", 8, {"disambiguation": ""}, [])], "title string, page_id bigint, props map<string,string>, coordinates array<struct<lat: double, lon: double>>")
    t = spark.createDataFrame([("c_",), ("D",), ("none",), ("loop",)], "title string")
    got = {r.requested: r for r in wiki.page_metadata(t, spark.createDataFrame([("c_", "A")], pair), spark.createDataFrame([("A", "B"), ("B", "C"), ("loop", "pool"), ("pool", "loop")], pair), pages).collect()}
    assert set(got) == {"c_", "D"} and (got["c_"].page_id, got["c_"].description, got["c_"].wikidata_id, got["c_"].lat, got["c_"].is_disambiguation) == (7, "a museum", "Q7", 1.0, False) and got["D"].is_disambiguation


def test_folds_of_reference_answers(spark):
    rows = spark.createDataFrame([("Q1", 2, "c1"), ("Q1", 1, "c2"), ("Q1", 3, "c1"), ("Q2", 1, "cx")], "item string, n int, class_id string")
    assert [tuple(r) for r in wiki.class_labels(rows, spark.createDataFrame([("c1", "art"), ("c2", "house")], "class_id string, label string")).collect()] == [("Q1", ["house", "art"])]
    b = spark.createDataFrame([("Q1", 1, {"itemLabel": "", "alt": "x"}), ("Q1", 2, {"itemLabel": "A", "coord": "Point(2 1)", "alt": "y"}), ("Q1", 3, {"itemLabel": "B", "alt": "x"})], "item string, n int, b map<string,string>")
    r = readers.fold_bindings(b).collect()[0]
    assert (r.itemLabel, r.coord, r.aliases, r.website) == ("A", "Point(2 1)", ["x", "y"], None)
    v = spark.createDataFrame([("en", "accept", "venue"), ("en", "reject", "person"), ("en", "reject", "person"), ("en", "unsure", "none"), ("de", "accept", "venue")], "source string, decision string, reason string")
    assert {r.source: (r.visited, r.emitted, r.rejected, r.by_reason) for r in wiki.crawl_counts(v).collect()} == {"en": (4, 1, 2, "person=2"), "de": (1, 1, 0, "")}
    parts = spark.createDataFrame([("i", 1, {"a": "1", "visits": "x"}), ("i", 2, {"visits": "7.0", "latitude": "1.5", "longitude": "2"})], "item string, n int, values map<string,string>")
    m = wiki.merged_item(parts).select("values", wiki.number_of(F.col("values"), "visits").alias("v"), wiki.number_of(F.col("values"), "a").alias("a"), wiki.number_of(F.col("values"), "none").alias("z"), wiki.point_in(F.col("values")).alias("p")).collect()[0]
    assert m["values"] == {"a": "1", "visits": "7.0", "latitude": "1.5", "longitude": "2"} and (m.v, m.a, m.z) == (7, 1, None) and (m.p.lat, m.p.lon) == (1.5, 2.0)
    a = spark.createDataFrame([("1.5", "x", "way", {"contact:website": "https://a.example"})], "lat string, lon string, osm_type string, extratags map<string,string>").select(F.struct("*").alias("a")).select(wiki.geocoder_answer(F.col("a")).alias("g")).collect()[0].g
    assert (a.lat, a.lon, a.website, a.kind) == (1.5, None, "https://a.example", "W")


def test_next_reads(spark):
    states = spark.createDataFrame([("new", None, 0), ("calm", 168.0, 0), ("busy", 60.0, 0), ("down", 168.0, 2), ("gone", 168.0, 5), ("closing", 168.0, 0), ("past", 168.0, 0)], "site string, interval_hours double, failures int")
    read = spark.createDataFrame([("new", "changed"), ("calm", "unchanged"), ("busy", "changed"), ("down", "failed"), ("gone", "failed"), ("closing", "unchanged"), ("past", "unchanged")], "site string, outcome string")
    closes = spark.createDataFrame([("closing", date(2026, 6, 3)), ("past", date(2026, 5, 1)), ("down", date(2026, 6, 1))], "site string, closes date")
    got = {r.site: r for r in schedule.next_reads(states, read, closes, NOW).collect()}
    hours = {k: (r.due_at - NOW).total_seconds() / 3600 for k, r in got.items()}
    assert hours == {"new": 168, "calm": 252, "busy": 48, "down": 48, "gone": 1440, "closing": 72, "past": 252}
    assert got["gone"].parked and got["closing"].reason == "a show closes 2026-06-03" and got["new"].reason == "first read" and got["down"].failures == 3
    reads = spark.createDataFrame([("a", False, False, 0, None), ("b", True, True, 0, None), ("c", True, False, 4, "f"), ("d", True, False, 5, "g")], "site string, reached boolean, not_modified boolean, found int, fingerprint string")
    out = schedule.read_outcomes(reads, spark.createDataFrame([("c", "f"), ("d", "old")], "site string, fingerprint string"))
    assert {r.site: r.outcome for r in out.collect()} == {"a": "failed", "b": "unchanged", "c": "unchanged", "d": "changed"}
    assert {r.outcome: (r.sites, r.found) for r in schedule.sweep_totals(out).collect()} == {"failed": (1, 0), "unchanged": (2, 4), "changed": (1, 5)}
    s = spark.createDataFrame([("a", None, None, None), ("b", None, datetime(2026, 5, 1), datetime(2026, 5, 2)), ("c", "x", None, None), ("d", None, NOW, datetime(2026, 7, 1))], "site string, parked_reason string, last_attempt_at timestamp, next_due_at timestamp")
    assert [tuple(r) for r in schedule.sweep_plan(s, NOW, 1, 0, 10).collect()] == [("a", "never read"), ("b", "due")] and len(schedule.sweep_plan(s, NOW, 1, 0, 1).collect()) == 1


def test_contradictions(spark):
    names = {"france": "France", "georgia": "Georgia", "united states": "United States"}
    m = spark.createDataFrame([(1, "France", "museum in Atlanta, Georgia"), (2, "United States", "museum in Atlanta, Georgia"), (3, "France", "museum in Paris, France."), (4, None, "museum, France"), (5, "France", None)], "id bigint, country string, description string")
    assert [r.subject for r in quality.contradictions(m, names).collect()] == ["1"]


def test_keys_and_parts(spark):
    df = spark.createDataFrame([("http://x.example/entity/Q42", "Côte d'Ivoire", "Musée A", "abcdef", ("12", "Main St", None, "Bree", None))], "u string, c string, n string, t string, a struct<house_number: string, road: string, city: string, town: string, village: string>")
    df = df.withColumn("a", F.struct("a.*", *(F.lit(None).cast("string").alias(x) for x in ("borough", "suburb", "state"))))
    r = df.select(text.entity_id(F.col("u")).alias("e"), text.storage_key("raw", F.col("c"), F.col("n")).alias("k"), text.truncate(F.col("t"), 4).alias("t"), rules.street_line(F.col("a")).alias("s"), rules.locality_of(F.col("a")).alias("l"), geo.radius_for_bbox(F.lit(50.0), F.lit(50.2), F.lit(5.0), F.lit(5.1)).alias("km")).collect()[0]
    assert (r.e, r.t, r.s, r.l) == ("Q42", "abc…", "12 Main St", "Bree") and r.k.startswith("raw/") and r.k.endswith(".json") and 11 < r.km < 11.2


def test_sources_and_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, n string"), spark.createDataFrame([(2,)], "id int")
    assert {(r.id, r.n, r.source) for r in readers.union_sources({"a": a, "b": b}).collect()} == {(1, "x", "a"), (2, None, "b")}
    assert readers.union_sources({"a": a, "b": b}, "b, nosuch, b").count() == 1
    assert readers.read_one(spark, str(tmp_path / "none.json"), "id int") is None
    (tmp_path / "one.json").write_text('{"id": 7}')
    assert readers.read_one(spark, str(tmp_path / "one.json"), "id int").first().id == 7
    path = str(tmp_path / "p")
    sinks.put_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, "k")
    sinks.put_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), path, "k")
    assert {(r.v, r.k) for r in spark.read.parquet(path).collect()} == {(1, "a"), (9, "b")}
    store = str(tmp_path / "s")
    assert sinks.insert_absent(a, store, "id") == 1 and sinks.insert_absent(a.unionByName(spark.createDataFrame([(3, "y"), (3, "z"), (None, "q")], "id int, n string")), store, "id") == 1
    one = sinks.features(spark.createDataFrame([(1, 2.0, 3.0), (2, None, 3.0)], "id int, lat double, lon double"), "id").collect()
    assert [json.loads(r.feature) for r in one] == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [3.0, 2.0]}, "properties": {"id": 1}}]


def test_state_writes(spark):
    cache = spark.createDataFrame([("ath", datetime(2026, 5, 20)), ("bree", datetime(2026, 1, 1))], "query string, resolved_at timestamp")
    assert state.look_up(cache, " ATH ", NOW).count() == 1 and state.look_up(cache, "bree", NOW).isEmpty()
    e = spark.createDataFrame([(1, "s", datetime(2026, 5, 1), None), (2, "s", datetime(2026, 5, 1), NOW), (3, "t", datetime(2026, 5, 1), None)], "exhibition_id int, site string, last_seen_at timestamp, retired_at timestamp")
    assert {r.exhibition_id: r.last_seen_at for r in state.touch(e, spark.createDataFrame([("s",)], "site string"), F.lit(NOW)).collect()} == {1: NOW, 2: datetime(2026, 5, 1), 3: datetime(2026, 5, 1)}
    m = spark.createDataFrame([(1, None, False), (2, (1.0, 1.0), False)], "id bigint, location struct<lat: double, lon: double>, location_approximate boolean")
    got = state.set_locations(m, spark.createDataFrame([(1, (5.0, 6.0), True)], m.schema)).orderBy("id").collect()
    assert (got[0].location.lat, got[0].location_approximate, got[1].location.lat) == (5.0, True, 1.0)
    q = spark.createDataFrame([(1, "ok", 0, (1.0, 1.0)), (2, " ", 0, None), (3, "x", -1, None), (4, "y", None, (99.0, 0.0)), (5, None, 0, None)], "id int, name string, sitelinks int, location struct<lat: double, lon: double>")
    good, bad = resolve.quarantine(q)
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4, 5]


def test_boxes_windows_and_zoom(spark):
    m = spark.createDataFrame([(i, (1.0 + i, 1.0), i) for i in range(5)], "id bigint, location struct<lat: double, lon: double>, sitelinks int")
    points, more = search.box_points(m, 90.5, 0, -95, 2, 3)
    assert [r.point for r in points.collect()] == [[4.0, 5.0, 1.0], [3.0, 4.0, 1.0], [2.0, 3.0, 1.0]] and more and not search.box_points(m, 0, 0, 9, 2, 5)[1]
    assert search.time_window("weekend", date(2026, 6, 3)) == (date(2026, 6, 6), date(2026, 6, 7)) and search.time_window("weekend", date(2026, 6, 7)) == (date(2026, 6, 7),) * 2
    assert search.time_window("now", date(2026, 6, 3)) == (date(2026, 6, 3),) * 2 and search.time_window("month", date(2026, 6, 1))[1] == date(2026, 7, 1)
    with pytest.raises(ValueError):
        search.time_window("never", date(2026, 6, 1))
    z = spark.range(1).select(geo.zoom_for(F.lit(0.01)).alias("a"), geo.zoom_for(F.lit(2.0)).alias("b"), geo.zoom_for(F.lit(50.0)).alias("c")).first()
    assert z.a == 16 and z.a > z.b > z.c >= 3 and 19 < geo.cell_reach_km() < 20


def test_merges_settle(spark):
    schema = "id bigint, wikidata_id string, name string, normalized string, country string, locality string, description string, website string, aliases array<string>, sources array<string>, verified boolean, sitelinks int, location struct<lat: double, lon: double>"
    row = lambda i, w, n, al: (i, w, n, n.lower(), "Spain", None, None, None, al, ["osm"], False, i, None)
    df = spark.createDataFrame([row(1, "Q1", "A", ["B"]), row(2, None, "B", ["C"]), row(3, None, "C", [])], schema)
    got = resolve.settled(df, resolve.alias_merges).collect()
    assert [r.id for r in got] == [1] and set(got[0].aliases) == {"B", "C"} and got[0].sitelinks == 3


def test_entities_become_rows(spark):
    schema = "id bigint, wikidata_id string, name string, country string, locality string, description string, website string, aliases array<string>, sources array<string>, classes array<string>, verified boolean, sitelinks int, location struct<lat: double, lon: double>"
    rows = [(1, "Q1", "Alpha", "unknown", None, "", "", ["Shared"], ["lists"], [], False, 1, (0.0, 0.0)), (2, "Q1", "Beta", "France", "Ath", "d", "w", [], ["osm"], ["art"], True, 5, (1.0, 2.0)), (3, "Q1", "Gamma", "Belgium", None, None, None, [], ["wikidata"], [], None, 0, None)]
    got = resolve.merged_entities(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and (got[0].id, got[0].name, got[0].country, got[0].locality, got[0].aliases, got[0].verified, got[0].sitelinks, got[0].location.lat) == (1, "Alpha", "Belgium", "Ath", ["Beta", "Gamma", "Shared"], True, 5, 1.0)


def test_report_levels(spark):
    f = spark.createDataFrame([("a", "info", "1"), ("b", "warning", "2"), ("a", "error", "3")], "check string, severity string, subject string")
    assert quality.at_least(f, "warning").count() == 2 and quality.at_least(f, "info", "a").count() == 2
    assert quality.exit_status(f, "error") == 1 and quality.exit_status(f.filter("severity = 'info'"), "warning") == 0
    e = spark.createDataFrame([(1, "https://m.example/events/list/2", "https://m.example/", False), (2, "https://m.example/events/glass", "https://m.example/", False), (3, "https://m.example/", "https://m.example", True), (4, None, None, None)], "exhibition_id int, url string, source_page string, permanent boolean")
    assert [r.exhibition_id for r in quality.navigation_listings(e).collect()] == [1]


def test_robots_files(spark):
    files = spark.createDataFrame([("h", "User-agent: bad\nDisallow: /\n\nUser-Agent: *\nUser-agent: other\nDisallow: /private # x\nAllow: /private/open\nDisallow:\n\nUser-agent: z\nDisallow: /z"), ("i", None)], "host string, text string")
    got = rules.robots_rules(files)
    assert {tuple(r) for r in got.collect()} == {("h", "/private", False), ("h", "/private/open", True)}
    paths = spark.createDataFrame([("h", "/private/x"), ("h", "/private/open/x"), ("h", "/z"), ("i", "/")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in rules.allowed_paths(paths, got).collect()} == {("h", "/private/x"): False, ("h", "/private/open/x"): True, ("h", "/z"): True, ("i", "/"): True}


def test_labels_addresses_areas_and_cells(spark):
    df = spark.createDataFrame([(date(2026, 5, 1), date(2026, 6, 2), False), (None, date(2026, 6, 2), False), (date(2026, 5, 1), None, False), (None, None, True), (None, None, False)], "s date, e date, p boolean")
    assert [r[0] for r in df.select(text.run_label(F.col("s"), F.col("e"), F.col("p"))).collect()] == ["1 May 2026 – 2 Jun 2026", "until 2 Jun 2026", "from 1 May 2026", "permanent", ""]
    fields = "struct<house_number: string, road: string, postcode: string, city: string, town: string, village: string, borough: string, suburb: string, state: string, country: string>"
    a = spark.createDataFrame([(("12", "Main St", "7800", None, "Ath", None, None, None, None, "Belgium"),), ((None,) * 10,)], f"a {fields}")
    assert [r[0] for r in a.select(rules.address_line(F.col("a"))).collect()] == ["12 Main St, 7800 Ath, Belgium", None]
    read = spark.createDataFrame([("x", datetime(2026, 5, 31, 12)), ("y", datetime(2026, 5, 1))], "cell string, scraped_at timestamp")
    assert {(r.cell, r.scraped_at) for r in state.mark_areas(read, spark.createDataFrame([("z",)], "cell string"), NOW).collect()} == {("x", datetime(2026, 5, 31, 12)), ("z", NOW)}
    assert wikitext.cells_of(" [[A||b]] || {{x||y}} || c ") == [" [[A||b]] ", " {{x||y}} ", " c "] and wikitext.cell('style="x" | [[A|b]] c') == "[[A|b]] c"
    s = spark.createDataFrame([("a", None, NOW, datetime(2026, 5, 1)), ("b", None, NOW, datetime(2026, 5, 1)), ("c", None, None, None)], "site string, parked_reason string, last_attempt_at timestamp, next_due_at timestamp")
    assert [r.site for r in schedule.due_by_prominence(s, spark.createDataFrame([("b", 9), ("a", 2)], "site string, sitelinks int"), NOW).collect()] == ["c", "b", "a"]
    got = html.declared(['{"@type": "Event", "name": "Glass", "url": "/exhibitions/glass", "startDate": "2026-05-01T10:00"}', '{"@type": "Event", "name": "Talk", "url": "/events/talk"}', "{broken"], "https://m.example/")
    assert [(g["title"], g["start"]) for g in got] == [("Glass", "2026-05-01")]


def test_many_radius_queries_equal_one_by_one(spark):
    import random

    rnd = random.Random(4)
    at = lambda: (rnd.choice([rnd.uniform(-90, 90), rnd.uniform(50, 50.5), rnd.uniform(88, 90)]), rnd.choice([rnd.uniform(-180, 180), rnd.uniform(4, 4.5), rnd.uniform(179.9, 180), rnd.uniform(-180, -179.9)]))
    m = spark.createDataFrame([(i, at()) for i in range(800)] + [(900, None), (901, (0.0, 0.0))], "id bigint, location struct<lat: double, lon: double>")
    p = spark.createDataFrame([(i, *at()) for i in range(60)] + [(70, None, None)], "key bigint, lat double, lon double")
    d = geo.haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("m.lat"), F.col("m.lon"))
    for km in (2.0, 60.0):
        want = p.alias("p").join(search.placed(m).alias("m"), d <= km).select("key", "id")
        got = search.nearby_many(m, p, km)
        assert got.select("key", "id").exceptAll(want).isEmpty() and want.exceptAll(got.select("key", "id")).isEmpty() and got.count() == want.count()


def test_a_catalogue_is_loaded_and_merged(spark):
    schema = "id bigint, wikidata_id string, name string, normalized string, country string, locality string, description string, website string, aliases array<string>, sources array<string>, classes array<string>, verified boolean, location struct<lat: double, lon: double>, sitelinks int, street string, postcode string, wikipedia_url string, source_page string, page_id int, updated_at timestamp"
    row = lambda i, w, n, al=(), **k: {**dict.fromkeys(("locality", "description", "website", "street", "postcode", "wikipedia_url", "source_page", "page_id", "location")), "id": i, "wikidata_id": w, "name": n, "normalized": n.lower(), "country": "Spain", "aliases": list(al), "sources": ["x"], "classes": [], "verified": False, "sitelinks": 0, "updated_at": NOW, **k}
    old = spark.createDataFrame([row(1, "Q1", "Alpha", ["Beta"], page_id=7), row(2, None, "Gamma")], schema)
    new = spark.createDataFrame([row(3, None, "Alpha", website="w"), row(4, None, "Beta"), row(5, None, "Gamma", street="Main St"), row(6, None, " ")], schema)
    rows, bad = resolve.load_catalogue(old, new)
    got = {r.id: r for r in rows.collect()}
    assert set(got) == {1, 2} and got[1].website == "w" and got[1].page_id == 7 and "Beta" in got[1].aliases and got[2].street == "Main St" and [r.id for r in bad.collect()] == [6]


def test_articles_become_venues_once(spark):
    p = spark.createDataFrame([("A museum", 2, None, "museum in Ath", False, 1.0, 2.0), ("A museum", 1, "Q1", "museum in Ath", False, 1.0, 2.0), ("B", 3, None, "a painter", False, None, None), ("C museum", 4, None, "museum", True, None, None)], "title string, page_id bigint, wikidata_id string, description string, is_disambiguation boolean, lat double, lon double")
    assert [(r.title, r.page_id) for r in wiki.article_venues(p).collect()] == [("A museum", 1)]


def test_pages_are_cut_and_the_rest_has_no_country(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"i": k} for k in range(7)]}))
    (tmp_path / "b.json").write_text("{broken")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        df = spark.read.format("pages").schema("i int").option("limit", 3).load(root)
        assert sorted(r.i for r in df.collect()) == list(range(7)) and df.rdd.getNumPartitions() >= 3
    assert spark.read.format("pages").schema("i int").load(str(tmp_path)).count() == 7
    by, every = spark.createDataFrame([("Q1", "France")], "item string, country string"), spark.createDataFrame([("Q1",), ("Q2",), ("Q2",)], "item string")
    assert {tuple(r) for r in wiki.with_remainder(by, every).collect()} == {("Q1", "France"), ("Q2", None)}


def test_search_many_equals_brute_force_and_broadcasts_nothing(spark, monkeypatch):
    # what many rows share must not multiply, nor a table that looks small to the planner go to the driver
    rng = random.Random(3)
    words = ["museum", "glass", "salt", "toys", "mill", "old", "town", "harbour", "north", "art", "a"]
    spelt = lambda: " ".join(rng.choice(words) + rng.choice(["", "", "s", "x"]) for _ in range(rng.randint(1, 4)))
    names = [(i, spelt() if i % 3 else "Town Museum") for i in range(90)] + [(90, None), (91, " "), (92, "!")]
    asked = [(i % 55, spelt() if i % 4 else "town museum") for i in range(60)] + [(60, None), (61, "?"), (62, "zzz")]
    grams = lambda t: set(fuzzy._listed(t or ""))
    sims = [(k, len(g & h) / len(g | h), i) for k, q in asked for i, n in names if (g := grams(q)) & (h := grams(n))]
    want = {}
    for k, sim, i in sorted((x for x in sims if x[1] >= 0.4), key=lambda x: (x[0], -x[1], x[2])):
        want.setdefault(k, []).append((i, round(sim, 9)))
    want = sorted((k, n + 1, *x) for k, found in want.items() for n, x in enumerate(found[:3]))
    m, q = spark.createDataFrame(names, "id bigint, name string"), spark.createDataFrame(asked, "key bigint, text string")
    for share in (100_000, 7):
        monkeypatch.setattr(fuzzy, "SHARE", share, raising=False)
        got = search.search_many(m, q, 0.4, 3)
        assert sorted((r.key, r.rank, r.id, round(r.sim, 9)) for r in got.collect()) == want
        assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
