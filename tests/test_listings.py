from datetime import date

from pyspark.sql import functions as F

from vitrine.functions import cards as c
from vitrine.operators import listings

FILLER = "The house by the river shows what its people made, kept and traded. " * 6
PAGE = f"""<html><head><title>What's on</title></head><body>
<nav><a href="/">Home</a><a href="/exhibitions/">Exhibitions</a><a href="/shop/">Shop</a><a href="https://other.example/exhibitions/x">Partner show far away</a></nav>
<h1>Exhibitions</h1>
<div class="grid"><p>{FILLER}</p>
 <article><a href="/exhibitions/salt-roads#top"><img alt=""><h3>Exhibition Salt Roads</h3></a><p><time datetime="2026-05-01T10:00">1 May</time> – <time datetime="2026-09-30">30 September</time></p></article>
 <article><a href="/exhibitions/glass"><h3>Glass of the North</h3><span>from 3 March 2026 to 12 July 2026</span></a></article>
 <article><h3>Not the name</h3><p>12 January 2026 – 1 February 2026</p><a href="/exhibitions/old-toys">Read more</a></article>
 <article><h3>Also not</h3><p>until 5 August 2026</p><a href="/exhibitions/bread-and-fire">Read more</a></article>
 <article><a href="/exhibitions/clocks" aria-label="Go to page Clocks and Time">Permanent exhibition</a></article>
 <article><a href="/exhibitions/lecture-on-ships">Lecture: ships of the coast, 4 July 2026</a></article>
 <article><a href="/exhibitions/2026">2026</a></article>
 <article><a href="/event/late-opening">Late opening, 10 June 2026</a></article>
</div><a href="/exhibitions/?page=2">Next</a><a href="/exhibitions/archive/">Archive of shows</a><a href="mailto:x@y.example">Mail us</a><a href="/exhibitions/glass">Glass of the North</a></body></html>"""
TODAY = date(2026, 6, 1)


def pages(spark, *items):
    return spark.createDataFrame(items, "page_id bigint, url string, html string")


def test_cards_hold_the_text_around_a_link():
    heading, cards = c.read_cards(PAGE, "https://m.example/exhibitions/")
    assert heading == "What's on Exhibitions"
    by = {k["href"]: k for k in cards}
    salt = by["https://m.example/exhibitions/salt-roads"]
    assert salt["label"] == "Exhibition Salt Roads" and salt["times"] == ["2026-05-01", "2026-09-30"] and "30 September" in salt["context"]
    assert by["https://m.example/exhibitions/clocks"]["label"] == "Go to page Clocks and Time"
    assert "mailto:x@y.example" not in by and c.read_cards(None, None) == ("", []) and c.read_cards("<a href='/x'>unclosed <b>text", "https://m.example/")[1][0]["text"] == "unclosed text"


def test_titles(spark):
    said = ["Grand Palais, Paris Exhibition Hilma af Klint", "Exposition permanente Méditerranées", "Go to page Kings", "Salt Roads 3 March 2026", "Toys Until Sunday", "<b>Ships</b> , ", "Ausstellungsarchiv", "Free", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*said, None])], "i int, s string")
    got = [r.t for r in df.select("i", c.clean_title(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == ["Hilma af Klint", "Méditerranées", "Kings", "Salt Roads", "Toys", "Ships", "Ausstellungsarchiv", "Free", "", None]
    slugs = spark.createDataFrame([("shows/salt-roads",), ("a/2026-05-01-glass_box.html",), ("a/2026",), ("",)], "p string")
    assert [r[0] for r in slugs.select(c.title_from_slug(F.col("p"))).collect()] == ["Salt roads", "Glass box", "", ""]


def test_permanence(spark):
    df = spark.createDataFrame([("Permanent exhibition",), ("Permanently closed",), ("Die Dauerausstellung",), ("Glass",), (None,)], "s string")
    assert [r[0] for r in df.select(c.names_permanent(F.col("s"))).collect()] == [True, False, True, False, False]


def test_a_page_of_cards_becomes_shows(spark):
    k = c.page_cards(pages(spark, (1, "https://m.example/exhibitions/", PAGE), (2, "https://m.example/exhibitions/", None), (3, None, "")))
    cand = listings.candidates(k)
    assert {r.title for r in cand.collect()} == {"Salt Roads", "Glass of the North", "Old toys", "Bread and fire", "Clocks and Time"}
    got = {r.title: r for r in listings.admitted(listings.with_runs(cand, F.lit(TODAY)), F.lit(TODAY)).collect()}
    assert set(got) == {"Salt Roads", "Glass of the North", "Bread and fire", "Clocks and Time"}  # old toys is over
    assert (got["Salt Roads"].starts_on, got["Salt Roads"].ends_on) == (date(2026, 5, 1), date(2026, 9, 30)) and got["Salt Roads"].running
    assert (got["Glass of the North"].starts_on, got["Glass of the North"].ends_on) == (date(2026, 3, 3), date(2026, 7, 12))
    assert got["Bread and fire"].ends_on == date(2026, 8, 5) and got["Clocks and Time"].permanent and not got["Salt Roads"].permanent
    assert listings.candidates(k.limit(0)).isEmpty()


def test_vague_paths_count_only_without_strong_ones_and_vouched_ones_need_a_run(spark):
    weak = '<a href="/event/glass-show">Glass show 1 May 2026 – 9 July 2026</a><a href="/about/us">About us all</a>'
    trusted = f'<title>Exhibitions</title><p>{FILLER}</p><a href="/work/1/">Women and Cameras, 1 May 2026 – 9 August 2026</a><a href="/visit/2/">Opening hours, 4 July 2026</a><a href="/work/9/">Library of books</a>'
    undated = '<title>Ausstellungen</title><a href="/ausstellung/a/">First room of glass</a><a href="/ausstellung/b/">Second room of salt</a>'
    p = pages(spark, (1, "https://m.example/now/", weak), (2, "https://m.example/en/", trusted), (3, "https://m.example/ausstellungen/", undated))
    shows = listings.admitted(listings.with_runs(listings.candidates(c.page_cards(p)), F.lit(TODAY)), F.lit(TODAY))
    got = {(r.page_id, r.title): r for r in shows.collect()}
    assert set(got) == {(1, "Glass show"), (2, "Women and Cameras"), (3, "First room of glass"), (3, "Second room of salt")}
    assert got[3, "First room of glass"].running and not got[3, "First room of glass"].permanent and got[3, "First room of glass"].ends_on is None


def test_titles_merge_and_order(spark):
    s = spark.createDataFrame(
        [(1, 0, "A", "u0", False, True, date(2026, 1, 1), date(2026, 7, 1)), (1, 1, " a ", "u1", False, True, date(2025, 12, 1), date(2026, 8, 1)), (1, 2, "B", "u2", True, True, None, None), (1, 3, "b", "u3", False, True, date(2026, 1, 1), date(2026, 2, 1)), (1, 4, "C", "u4", False, False, date(2026, 9, 1), date(2026, 9, 9)), (2, 0, "A", "v", False, True, None, None)],
        "page_id bigint, pos int, title string, href string, permanent boolean, running boolean, starts_on date, ends_on date",
    )
    got = [(r.page_id, r.title, r.href, r.starts_on, r.ends_on) for r in listings.in_order(listings.merged_titles(s, "page_id")).filter("page_id = 1").collect()]
    assert got == [(1, "A", "u0", date(2025, 12, 1), date(2026, 8, 1)), (1, "B", "u2", None, None), (1, "C", "u4", date(2026, 9, 1), date(2026, 9, 9))]


def test_the_plan_of_a_site(spark):
    home = '<a href="/exhibitions">Exhibitions</a><a href="/whats-on/current">Current exhibitions</a><a href="/past">Past exhibitions</a><a href="/dauerausstellung">Dauerausstellung</a><a href="/about">About us</a><a href="/shop">Shop</a><a href="https://x.example/about">About</a>'
    k = c.page_cards(pages(spark, (1, "https://m.example/", home), (2, "https://n.example/", "<p>nothing</p>")))
    got = {(r.page_id, r.kind, r["rank"]): r.href for r in listings.site_plan(k).collect()}
    assert got[1, "listing", 1] == "https://m.example/whats-on/current" and "https://m.example/exhibitions" in got.values() and "https://m.example/past" not in got.values()
    assert got[1, "permanent", 1] == "https://m.example/dauerausstellung" and got[1, "info", 1] == "https://m.example/about" and not any(p == 2 for p, *_ in got)
    usual = listings.conventional_urls(spark.createDataFrame([("n.example",)], "site string"), c.INFO_PATHS).orderBy("rank").first()
    assert usual.href == "https://n.example/visit"
    m = spark.createDataFrame([(1, "M", "https://m.example/"), (2, "N", "https://n.example/"), (3, "O", "")], "id bigint, name string, website string")
    alone = listings.institution_entries(m, spark.createDataFrame([(1,)], "id bigint"), spark.createDataFrame([(2, "https://n.example/about")], "id bigint, href string"))
    assert [tuple(r) for r in alone.collect()] == [(2, "N", "https://n.example/about", True)]


def test_declared_entries_come_first(spark):
    d, k = (spark.createDataFrame(rows, "page_id bigint, title string, href string") for rows in ([(1, "A", "u")], [(1, "A again", "u"), (1, "B", "v"), (2, "C", "u")]))
    assert {r.title for r in listings.declared_first(d, k, ["page_id", "href"]).collect()} == {"A", "B", "C"}
