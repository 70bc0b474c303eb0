from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import dates, fuzzy, html, wikitext
from vitrine.functions import text as tx
from vitrine.functions.geo import cell_label, haversine_km


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_fold(spark):
    cases = {"Musée d'Orsay": "musee d orsay", "Kunstmuseum Zürich": "kunstmuseum zurich", "Muzeum Łazienki": "muzeum lazienki", "Ørsted Æther Museum": "orsted aether museum",
             "Straßenmuseum": "strassenmuseum", "M+": "m", "70.8": "70 8", "  Museum   of   Art  ": "museum of art", "": "", "Эрмитаж": "эрмитаж", "Ħal Saflieni": "hal saflieni"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string").select("b", tx.fold(F.col("a")).alias("x"))
    assert all(r.b == r.x for r in df.collect())
    assert one(spark, tx.fold(F.col("a")), a=None) is None


def test_keys(spark):
    assert one(spark, tx.slug(F.col("a")), a="Musée d'Orsay!") == "musee-d-orsay"
    assert one(spark, tx.slug(F.col("a")), a="博物館").startswith("x-") and one(spark, tx.slug(F.col("a")), a="  ") == "unknown"
    assert one(spark, tx.site_host(F.col("a")), a="HTTPS://www.Site.example:80/x") == "site.example"
    assert one(spark, tx.site_host(F.col("a")), a="site.example") is None
    assert one(spark, tx.usable_url(F.col("a")), a="http://") is False and one(spark, tx.usable_url(F.col("a")), a="https://a.example/b") is True
    assert one(spark, tx.title_from_slug(F.col("a")), a="/shows/2024-05-01-the-blue-rider-2.html") == "The Blue Rider"
    assert one(spark, tx.clean_name(F.col("a")), a="A&amp;B​ \n C") == "A&B C"
    assert one(spark, tx.repair_utf8(F.unhex(F.col("a"))), a="41FFFE42") == "A�B"


def test_trigrams(spark):
    sim = fuzzy.similarity(fuzzy.trigrams(F.col("a")), fuzzy.trigrams(F.col("b")))
    part = fuzzy.word_similarity(fuzzy.trigrams(F.col("a")), fuzzy.ordered_trigrams(F.col("b")))
    for a, b, s in (("gotha", "gothenborg", 0.308), ("gothenburg", "gothenborg", 0.571), ("vikingar", "vikingr", 0.55), ("", "", 0.0)):
        assert abs(one(spark, sim, a=a, b=b) - s) < 0.006
    for a, b, s in (("gotha", "gothenborg", 0.667), ("gothenburg", "gothenborg", 0.636), ("kunstmuseum zurich", "national museum zurich", 0.632)):
        assert round(one(spark, part, a=a, b=b), 3) == s
        assert round(one(spark, fuzzy.both_similarities(a, F.col("b")).part, b=b), 3) == s


def test_similar_pairs_equal_brute_force(spark):
    names = ["museum of glass", "glass museum", "musem of glas", "old mill", "mill", "", "old mill"]
    d = spark.createDataFrame(list(enumerate(names)), "key bigint, text string")
    got = {(r.left_key, r.right_key) for r in fuzzy.similar_pairs(d, d, 0.4).collect()}
    g = {i: set(fuzzy._listed(n)) for i, n in enumerate(names)}
    want = {(i, j) for i in g for j in g if g[i] and g[j] and len(g[i] & g[j]) / len(g[i] | g[j]) >= 0.4}
    assert got == want


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_close_sets_equal_brute_force(threshold):
    rng = np.random.default_rng(1)
    some = lambda n, of: [set(rng.choice(of, rng.integers(1, min(of, 12) + 1), replace=False).tolist()) for _ in range(n)]
    flat = lambda s: (np.array([x * 7919 for r in s for x in r]), np.array([len(r) for r in s]))
    for n, of in ((1, 3), (40, 9), (300, 30)):
        a, b = some(n, of), some(2 * n, of)
        every = [[(j, len(p & q) / len(p | q)) for j, q in enumerate(b)] for p in a]
        for best in (None, 2):
            least = [max(threshold, sorted((s for _, s in r), reverse=True)[best - 1] if best else 0) for r in every]
            want = {(i, j): s for i, r in enumerate(every) for j, s in r if s >= least[i]}
            x, y, sim = fuzzy._close_sets(*flat(a), *flat(b), threshold, best)
            assert len(x) == len(want) and dict(zip(zip(x.tolist(), y.tolist()), sim.tolist())) == want


def test_geo(spark):
    assert abs(one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - 20015.086796) < 1e-3
    assert one(spark, haversine_km(F.col("a"), F.lit(0.0), F.lit(0.0), F.lit(1.0)), a=None) is None
    assert one(spark, cell_label(F.lit(51.5), F.lit(-0.126))) == "51.50,-0.25"


def test_dates():
    d = dates.parse_range
    assert d("1 May – 30 June 2026") == (date(2026, 5, 1), date(2026, 6, 30), False)
    assert d("until 12. Januar 2027") == (None, date(2027, 1, 12), False)
    assert d("bis 12. Januar 2027")[1] == date(2027, 1, 12) and d("seit 3. März 2020") == (date(2020, 3, 3), None, False)
    assert d("2026-02-31") == (None, None, False) and d("") == d(None) == (None, None, False)
    assert d("Permanent display since 2 May 2001") == (date(2001, 5, 2), None, True)
    assert d("03.04.2026") == (date(2026, 4, 3), date(2026, 4, 3), False)
    assert d("May 5, 2026 to June 7, 2026")[1] == date(2026, 6, 7)


def test_pages():
    page = html.read_page("<title>T</title><a href='/x/blue#a' aria-label='Blue Rider'><h3>B\xadlue</h3><time datetime='2026-01-02'></a><a href='mailto:a@b'>m</a><script>'<a href=/n>'</script><p>open <b>now", "https://m.example/")
    assert page["anchors"][0] == {"href": "https://m.example/x/blue", "text": "Blue", "title": "Blue Rider", "times": ["2026-01-02"], "pos": 0}
    assert page["anchors"][1]["href"] is None and page["title"] == "T" and page["text"].endswith("open now") and html.read_page(None, None)["anchors"] == []
    good = '{"@graph": [{"@type": ["ExhibitionEvent"], "name": {"@value": "Sea"}, "url": "/sea", "startDate": "2026-03-01T10:00", "endDate": "2026-04-01"}, {"@type": "Event", "name": "Talk"}]}'
    assert html.declared([good, "{broken"], "https://m.example") == [{"title": "Sea", "url": "https://m.example/sea", "start": "2026-03-01", "end": "2026-04-01"}]


def test_wikitext():
    text = "{{Infobox|a={{b}}}}\n== Kent ==\n* Dover\n** [[Dover Museum]] – old<ref>x</ref>\n* [[List of things]]\n* [[Fort|The Fort]], big\n* [[Fort]]\n{|\n! Name !! Town\n|-\n| [[Mill]] || Ash\n|}\n== See also ==\n* [[No]]"
    assert [(e["title"], e["locality"]) for e in wikitext.entries(text)] == [("Dover Museum", "Dover"), ("Fort", "Kent"), ("Mill", "Ash")]
    assert wikitext.entries(None) == []
