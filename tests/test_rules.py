from datetime import datetime, timezone

from pyspark.sql import functions as F

from vitrine.functions import rules
from vitrine.operators import state
from vitrine.sources.paged import Gate, PagedSource, retry_after

SPELL = {"france": "France", "netherlands": "Netherlands"}


def test_countries(spark):
    df = spark.createDataFrame([("The Netherlands", "Museums in France", "A mill near Ath, France."), (None, "List of mills", None), ("Narnia", "Hall of France", "in Rome in france")], "c string, t string, d string")
    got = df.select(rules.canonical_country(F.col("c"), SPELL), rules.country_in_title(F.col("t"), SPELL), rules.country_in_description(F.col("d"), SPELL)).collect()
    assert [tuple(r) for r in got] == [("Netherlands", "France", "France"), (None, None, None), (None, "France", "France")]


def test_classify_and_addresses(spark):
    df = spark.createDataFrame([("Town Museum", 0, False, "novel"), ("List of museums", 0, False, None), ("X", 14, False, None), ("Y", 0, True, None), ("Ann Lee", 0, False, "painter"), ("Z", 0, False, "(1801–1850)"), ("Q", 0, False, None)], "t string, n int, x boolean, d string")
    got = [r[0].reason for r in df.select(rules.classify(F.col("t"), F.col("n"), F.col("x"), F.col("d"))).collect()]
    assert got == ["venue", "list", "namespace", "disambiguation", "person", "life span", "no evidence"]
    q = spark.createDataFrame([("Ath", "ath ", "Belgium"), (None, "", None)], "a string, b string, c string").select(rules.geocode_query(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in q] == ["Ath, Belgium", ""]


def test_robots_and_links(spark):
    r = spark.createDataFrame([("h", "/", False), ("h", "/shows", True), ("h", "/shows/old", False), ("h", "", False)], "host string, prefix string, allow boolean")
    p = spark.createDataFrame([("h", "/x"), ("h", "/shows/1"), ("h", "/shows/old/2"), ("other", "/x")], "host string, path string")
    assert {(x.host, x.path): x.allowed for x in rules.allowed_paths(p, r).collect()} == {("h", "/x"): False, ("h", "/shows/1"): True, ("h", "/shows/old/2"): False, ("other", "/x"): True}
    links = spark.createDataFrame([("Current exhibitions", "/exhibitions"), ("Past exhibitions", "/a"), ("Shop", "/shop")], "t string, p string")
    assert [x[0] for x in links.select(rules.link_score(F.col("t"), F.col("p"))).collect()] == [6, -1, 0]
    c = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False)], "page string, n int, strong boolean")
    assert {x.n for x in rules.strong_only(c, "page", "strong").collect()} == {1, 3}


def test_listing_upsert_is_commutative_in_sights(spark):
    t = lambda d: datetime(2026, 1, d)
    s = "url string, title string, museum string, starts_on date, ends_on date, permanent boolean, site string, source_page string, scraped_at timestamp, first_seen_at timestamp, last_seen_at timestamp, retired_at timestamp"
    old = spark.createDataFrame([("u", "Old", None, None, None, None, None, "https://www.a.example/x", t(2), t(2), t(5), t(6)), ("v", "V", None, None, None, None, "s", None, t(1), t(1), t(1), t(2))], s)
    new = spark.createDataFrame([("u", "New", None, None, None, None, None, "", t(3), t(1), t(4), None), ("", "none", None, None, None, None, None, None, t(3), t(1), t(4), None)], s)
    got = {r.url: r for r in state.upsert_exhibitions(old, new).collect()}
    u = got["u"]
    assert (u.title, u.first_seen_at, u.last_seen_at, u.retired_at) == ("New", t(1), t(5), None) and got["v"].retired_at == t(2) and set(got) == {"u", "v"}


def test_pages_and_gate(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"items": [{"id": 1, "name": "a"}, {"id": 2}]}')
    (tmp_path / "2.json").write_text("{broken")
    spark.dataSource.register(PagedSource)
    assert {tuple(r) for r in spark.read.format("pages").schema("id int, name string").load(str(tmp_path)).collect()} == {(1, "a"), (2, None)}
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert retry_after("5") == 5 and retry_after(None) == retry_after("x") == 0 and retry_after("Thu, 01 Jan 2026 00:01:00 GMT", now) == 60
    g = Gate()
    assert g.refused() == 2 and g.refused(10) == 10 and g.passed() == 8.75
