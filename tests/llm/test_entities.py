import math
import os
import random
import time
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.text import fold
from vitrine.llm import canonical, matching, survivorship, variants
from vitrine.llm.queries import QUERIES, SQL
from vitrine.session import shared_dir

DATA = "/root/testdata/sf0.001"
T = lambda d: datetime(2026, 1, d)
MUSEUM = "id bigint, name string, aliases array<string>, country string, locality string, description string, website string, location struct<lat: double, lon: double>, location_approximate boolean, sources array<string>, updated_at timestamp, street string, postcode string, wikidata_id string, kind string"


def museums(spark, *items):
    base = dict(name=None, aliases=[], country=None, locality=None, description=None, website=None, location=None, location_approximate=False, sources=[], updated_at=None, street=None, postcode=None, wikidata_id=None, kind="k")
    return spark.createDataFrame([{**base, **i} for i in items], MUSEUM)


def test_survivors(spark):
    m = museums(
        spark,
        dict(id=1, website="http://a.example", description="long text", location=(1.0, 1.0), location_approximate=True, sources=["a", " A", "b"], updated_at=T(5)),
        dict(id=2, website="https://nodot", description="n/a", location=(2.0, 2.0), sources=["a"], updated_at=T(1)),
        dict(id=3, website="https://b.example", description="longer text", location=(0.0, 0.0), sources=[], updated_at=T(3)),
        dict(id=4, description="same", website="x"), dict(id=5, description="size"), dict(id=6, description="???"),
    )
    g = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3), (2, 4), (2, 5), (3, 6), (3, 99), (None, 1)], "group_id bigint, museum_id bigint")
    got = {tuple(r) for r in survivorship.p7_found(g, m).filter("group_id IS NOT NULL").collect()}
    assert got == {(1, "website", 1), (1, "description", 3), (1, "location", 2), (1, "sources", 1), (3, "sources", 6)}
    assert survivorship.p7_found(g.limit(0), m).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("merge_groups", "museums", "places", "gazetteer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cur = c.execute(SQL[name])
    cols = sorted(x[0] for x in cur.description)
    at = [[x[0] for x in cur.description].index(k) for k in cols]
    assert sorted(df.columns) == cols
    assert sorted(tuple(str(r[k]) for k in cols) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in cur.fetchall())


GAZ = [(1, "country", "Germany", "Germany", ["Deutschland", "DE"]), (2, "country", "Spain", "Spain", ["ES"]), (3, "country", "Japan", "Japan", ["JP"]), (10, "town", "Upper Lolaiford", "Germany", []), (11, "town", "San Zerella", "Spain", ["Sanz"]), (12, "town", "Tijanda", "Spain", []), (13, "town", "Tijanda", "Japan", []), (14, "town", "Rijeburg", "Germany", [])]


def gazetteer(spark):
    return spark.createDataFrame([(*g, 10.0 * i, 10.0 * i) for i, g in enumerate(GAZ)], "entry_id bigint, kind string, name string, country string, other_names array<string>, lat double, lon double")


def test_canonical(spark):
    m = museums(
        spark, dict(id=1, country="Gemrany", locality="Up. Lolaiford"), dict(id=2, country="(Spain)", locality="44312 San Zerela"), dict(id=3, country="D.E.", locality="Tijanda (district)"),
        dict(id=4, country="Nordmark", locality="Zzzthorpe"), dict(id=5, country="Spain", locality="San Zerella"), dict(id=6, country=None, locality="  "), dict(id=7, country="Sapin", locality="City of Tijanda, Japan"), dict(id=7, country="Sapin", locality="City of Tijanda, Japan"),
    )
    q = ["rijeburg", "near rijebrg, deutschland", "museum of glass rijeburg", "asdf", "Rijeburg", "espana?", "upperlolaiford", None, "12345 tijanda - jp", "x" * 5000]
    p = spark.createDataFrame([(i, t, "", None, "c") for i, t in enumerate(q)], "place_id bigint, query string, display_name string, location struct<lat: double, lon: double>, field string")
    got = {(r.field, r.record_id): r.entry_id for r in canonical.p6_found(m, p, gazetteer(spark)).collect()}
    assert got == {
        ("country", 1): 1, ("country", 2): 2, ("country", 3): 1, ("country", 4): -1, ("country", 7): 2, ("locality", 1): 10, ("locality", 2): 11, ("locality", 3): 12, ("locality", 4): -1, ("locality", 7): 13,
        ("query", 0): 14, ("query", 1): 14, ("query", 2): -1, ("query", 3): -1, ("query", 5): -1, ("query", 6): 10, ("query", 8): 13, ("query", 9): -1,
    }
    assert canonical.p6_found(m.limit(0), p.limit(0), gazetteer(spark)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def mistype(rnd, w):
    for _ in range(rnd.choice([0, 1, 2])):
        i = rnd.randrange(len(w))
        w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])
    return w


def test_pigeonhole_and_prefix_joins_miss_nothing(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("bdgklmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 7))) for _ in range(60)]
    typed = sorted({t for w in base for t in (mistype(rnd, w), mistype(rnd, w)) if len(t) >= 6})
    refs = spark.createDataFrame([(w, "town") for w in base], "key string, kind string")
    got = {(r.key, r.rkey) for r in canonical.map_keys(spark.createDataFrame([(t,) for t in typed], "key string"), refs).collect()}
    for t in typed:
        if t in base:
            assert (t, t) in got
        else:
            for w in base:
                if len(w) >= 6 and levenshtein(t, w) <= 2:
                    assert (t, w) in got
    every = sorted({*base, *typed})
    close = {(r.t, r.u) for r in variants.close_words(spark.createDataFrame([(w,) for w in every], "token string")).collect()}
    want = {(a, b) for a in every for b in every if a < b and levenshtein(a, b) <= (2 if min(len(a), len(b)) >= 8 else 1 if min(len(a), len(b)) >= 5 else 0)}
    assert want <= close


def test_variants(spark):
    here = (50.0, 5.0)
    m = museums(
        spark, dict(id=1, name="Musée Vabolikemat du Verre", locality="Ath", location=here), dict(id=2, name="Musee Vabolikamet du Verre", locality="Ath"), dict(id=3, name="Мusée Vabolikemat du Verre", location=here),
        dict(id=4, name="Vabolikemat, Musée du Verre", location=(51.5, 5.0)), dict(id=5, name="Town Museum", locality="Ath"), dict(id=6, name="TOWN MUSEUM", locality="Ath"), dict(id=7, name="Town museum", locality="Bree"),
        *(dict(id=100 + i, name=f"{a}{b}o Town Museum", locality="Ghent") for i, (a, b) in enumerate((x, y) for x in ("Bakiru", "Dolenu", "Gosami", "Kutofi", "Metiva", "Pifulo") for y in ("bezan", "dorik", "gulem", "kifas", "mopit"))),
        dict(id=8, name=None), dict(id=9, name="  "), dict(id=2, name="Musee Vabolikamet du Verre", locality="Ath"), dict(id=10, name="w" * 20_000),
    )
    p = spark.createDataFrame([(1, "vabolikemat musee", None, None), (2, None, None, None), (3, "ath", None, None), (4, "town museum", None, None)], "place_id bigint, query string, display_name string, location struct<lat: double, lon: double>")
    got = {tuple(r) for r in variants.p4_found(m, p).collect()}
    assert {(1, 2), (2, 3), (5, 6)} <= {g[1:] for g in got if g[0] == "rows"} and not {(1, 3), (1, 4), (5, 7), (6, 7)} & {g[1:] for g in got if g[0] == "rows"}
    assert {g[1:] for g in got if g[0] == "query" and g[2] != 1} == set()
    assert {(1, 1), (3, 1)} <= {g[1:] for g in got if g[0] == "query"}
    assert variants.p4_found(m.limit(0), p.limit(0)).count() == 0


def test_meanings_are_learned_and_part_subjects(spark):
    stems = [a + b for a in ("bakiru", "dolenu", "gosami", "kutofi", "metiva", "pifulo", "rezane") for b in ("bezan", "dorik", "gulem", "kifas")]
    kinds = [("musee", "verre", "glass"), ("musee", "sel", "salt"), ("museo", "vidrio", "glass"), ("museo", "sal", "salt"), ("musee", "jouet", "toys"), ("museo", "barco", "ships"), ("musee", "musique", "music"), ("museo", "moneda", "coins"), ("musee", "pain", "bread"), ("museo", "mina", "mining")]
    rows = [(i, f"{k[0]} {k[1]} {s}", f"{s} {k[2]} museum") for i, (s, k) in enumerate((s, k) for s in stems for k in kinds)]
    usual = spark.createDataFrame([(w, w) for w in {"musee", "museo", "museum", "ath", *(x for k in kinds for x in k[1:])}], "token string, word string")
    pairs = spark.createDataFrame([*rows, *rows, (999, "a", "a")], "id bigint, own string, other string")
    got = {r.token: r.senses for r in variants.senses(pairs, usual, spark.createDataFrame([("ath",)], "token string")).collect()}
    assert got == {w: [k[2]] for k in kinds for w in k[1:]}
    assert variants.senses(pairs.limit(0), usual, usual.select("token")).count() == 0
    m = museums(spark, *(dict(id=i, name=n.title(), aliases=[o.title()], locality="Ghent") for i, n, o in rows), dict(id=9000, name="Pifulometi Glass Museum", locality="Ath"), dict(id=9001, name="Musee Verre Pifulometi", locality="Ath"), dict(id=9002, name="Museo Sal Pifulometi", locality="Ath"))
    p = spark.createDataFrame([(1, "pifulomeit salt museum", None, None)], "place_id bigint, query string, display_name string, location struct<lat: double, lon: double>")
    got = {tuple(r) for r in variants.p4_found(m, p).collect()}
    assert {g for g in got if g[1] >= 9000} == {("rows", 9000, 9001), ("query", 9002, 1)}


def test_vectors_keep_their_cosines():
    v = np.random.default_rng(0).normal(size=(200, matching.DIM)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.abs(matching._unpack(matching._pack(v)) @ v.T - v @ v.T).max() < 0.06


def _catalogue(spark, n=400):
    rnd = random.Random(9)
    stem = lambda: "".join(rnd.choice("bdgklmnrstvz") + rnd.choice(["a", "e", "i", "o", "u", "ai", "ou"]) for _ in range(5))
    kinds = ["Museum of Glass", "Museum of Salt", "Gallery of Toys", "Collection of Ships"]
    ms, rs, truth = [], [], set()
    for i in range(n):
        s, k, town = stem().capitalize() + "man", rnd.choice(kinds), rnd.choice(["Ath", "Bree", "Ciney", "Diest"])
        at = (50 + rnd.random(), 4 + rnd.random())
        ms.append(dict(id=i, name=f"{s} {k}", locality=town, country="Germany", location=at if rnd.random() < 0.8 else None, wikidata_id=f"Q{i}" if rnd.random() < 0.7 else None))
        if i % 2 == 0:
            name = f"{mistype(rnd, s)} {k}" if rnd.random() < 0.6 else f"{k} {s}"
            rs.append((i, "osm", name, [], "DE", mistype(rnd, town), (at[0] + 0.0005, at[1]) if rnd.random() < 0.6 else None, None, {}, f"Q{i}" if rnd.random() < 0.4 else None))
            truth.add((i, i))
        else:
            rs.append((i, "osm", f"{stem().capitalize()}man {k}", [], None, town, at, None, None, None))
    schema = "record_id bigint, source string, name string, other_names array<string>, country string, locality string, location struct<lat: double, lon: double>, website string, tags map<string,string>, wikidata_id string"
    return museums(spark, *ms), spark.createDataFrame(rs, schema), truth


def test_matching_held_out_accuracy_and_edges(spark):
    m, s, truth = _catalogue(spark)
    got = {(r.museum_id, r.record_id) for r in matching.p5_found(m, s, gazetteer(spark)).collect()}
    assert len(got & truth) / len(truth) >= 0.9 and len(got & truth) / len(got) >= 0.95
    assert len({r for _, r in got}) == len(got)
    odd = s.limit(0).union(spark.createDataFrame([(1, None, None, [], None, None, None, None, None, None), (2, None, "", [], "", "", None, "", {}, ""), (3, None, "w" * 30_000, ["x " * 9_000], "", "", None, "", {}, ""), (None, None, "x", [], None, None, None, None, None, None)], s.schema))
    assert matching.p5_found(m, odd, gazetteer(spark)).count() == 0
    assert matching.p5_found(m.limit(0), s.limit(0), gazetteer(spark)).count() == 0


def test_hyperplanes_find_nine_in_ten_of_brute_force(spark):
    m, s, _ = _catalogue(spark, 900)
    rec = matching.profiles(m, "m", "id", "aliases", m.street, m.postcode, gazetteer(spark)).unionByName(matching.profiles(s, "s", "record_id", "other_names", s.source, s.source, gazetteer(spark))).cache()
    names = matching.name_classes(rec, spark.sparkContext.broadcast(w := matching._learn(rec, rec.count()))).cache()
    rows = names.filter("keyed").collect()
    v = np.array([w.vector(r.nk) for r in rows])
    c = v @ v.T
    want = {(rows[i].h, rows[j].h) for i, j in zip(*np.nonzero(c >= matching.LEAST_COSINE)) if rows[i].in_s and rows[j].in_m}
    got = {(r.hs, r.hm) for r in matching.candidate_pairs(names.filter("keyed"), 400_000, matching.LEAST_COSINE - matching._ROUNDING).collect()}
    assert want and len(want & got) / len(want) >= 0.9 and not math.isnan(c.sum())
    assert len(names.collect()) == len({r.nk for r in names.collect()})


@pytest.mark.parametrize("coarse, fine", [(2, 6), (2, 9), (4, 10), (4, 14)])
def test_probes_keep_nine_in_ten_at_the_least_cosine_at_every_size(coarse, fine):
    c, n, rnd = matching.LEAST_COSINE, 3000, np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rnd.normal(size=(n, matching.DIM)))
    z = rnd.normal(size=x.shape)
    y = c * x + math.sqrt(1 - c * c) * unit(z - (z * x).sum(1, keepdims=True) * x)
    met = np.zeros(n, bool)
    for planes in matching._planes():
        here = np.ones(n, bool)
        for part, share in ((planes[:coarse], matching.COARSE_SHARE), (planes[matching.COARSE : matching.COARSE + fine], matching.FINE_SHARE)):
            bit = 1 << np.arange(len(part))
            looks = matching._probes((x @ part.T > 0) @ bit, np.abs(x @ part.T), share, c)
            here &= (looks == ((y @ part.T > 0) @ bit)[:, None]).any(1)
        met |= here
    assert met.mean() >= 0.9


def test_walks_bring_words_of_one_meaning_together():
    rnd = random.Random(3)
    stem = lambda: "".join(rnd.choice("bdgklmnrstvz") + rnd.choice("aeiou") for _ in range(4))
    kinds = [("verre", "glass"), ("sel", "salt"), ("jouet", "toys"), ("pain", "bread"), ("mine", "mining")]
    rows = [{"nks": [f"musee {k[0]} {s}", f"{s} {k[1]} museum"], "host": None, "tw": []} for s, k in ((stem(), rnd.choice(kinds)) for _ in range(600))]
    v = matching.fit_vectors(rows)
    same = [float(v[a] @ v[b]) for a, b in kinds]
    other = [float(v[a] @ v[d]) for a, _ in kinds for c, d in kinds if c != a]
    assert min(same) > max(other) and matching.fit_vectors([]) == {} and matching.fit_vectors([{"nks": [], "host": None, "tw": []}]) == {}


def test_wording_mends_typings_and_tells_key_words():
    counts = {"music": 400, "museum": 900, "of": 800, "musiksammlung": 300, "ath": 200}
    w = matching.Wording(counts, 4000, {}, {"music": ["music"], "musiksammlung": ["music"]})
    assert w.usual("msiksammlung") == "musiksammlung" and w.usual("musuem") == "museum" and w.usual("kiheiroudaisen") == "kiheiroudaisen"
    ws, subject = w.shape("msiksammlung kiheiroudaisen")
    assert subject == ["music"] and [(t, k) for t, _, k in ws] == [("music", False), ("kiheiroudaisen", True)]
    assert w.vector("kiheiroudaisen musuem of music") @ w.vector("museum of music kiheiroudaisen") > 0.999
    assert w.vector("kiheiroudaisen msiksammlung") @ w.vector("kiheiroudasien museum of music") > matching.LEAST_COSINE
    assert abs(w.vector("kiheiroudaisen museum") @ w.vector("bolutevarani museum")) < 0.4


def test_counts_are_those_of_all_records_not_of_the_sample(spark, monkeypatch):
    m, s, _ = _catalogue(spark, 200)
    monkeypatch.setattr(matching, "FIT_RECORDS", 10)
    rec = matching.profiles(m, "m", "id", "aliases", m.street, m.postcode, gazetteer(spark)).unionByName(matching.profiles(s, "s", "record_id", "other_names", s.source, s.source, gazetteer(spark)))
    counts = matching._learn(rec, rec.count()).counts
    rows = m.select("name").union(s.select("name")).collect()
    assert counts["of"] == sum(" of " in r.name for r in rows) and all(n >= variants.KEY_MENTIONS for n in counts.values())


def test_walks_and_confidence_are_fitted_on_all_records(spark, monkeypatch):
    monkeypatch.setattr(matching, "FIT_RECORDS", 10)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = [([" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(rnd.randint(0, 3))], rnd.choice([None, "w3.example"]), rnd.choices(words, k=rnd.randint(0, 2))) for _ in range(400)]
    index = {w: i for i, w in enumerate(words[:9])}
    want = np.zeros((9, 9))
    for nks, host, tw in rows:
        p, own = np.zeros(9), [x for x in (*(n.split() for n in nks), ["w3"] if host else [], tw) if x]
        for ws in own:
            for w in ws:
                if w in index:
                    p[index[w]] += 1 / len(own) / len(ws)
        want += np.outer(p, p)
    got = matching.walk_steps(spark.createDataFrame(rows, "nks array<string>, host string, tw array<string>").repartition(3), index)
    assert np.allclose(want[got.column("w").to_numpy(), got.column("v").to_numpy()], got.column("n").to_numpy()) and got.num_rows == (np.triu(want) > 0).sum()
    # 6,000 pairs of which the last thousand alone tell that a shared site means little
    r = np.random.default_rng(3)
    x, y = r.random((6000, 10)), np.arange(6000) % 2 == 0
    x[:, 0] += y
    x[5000:, 7] = ~y[5000:]
    w = matching.fit_confidence(spark.createDataFrame([(*map(float, a), bool(b)) for a, b in zip(x, y)], ", ".join(f"{f} double" for f in matching.FEATURES) + ", label boolean").repartition(3))
    a, prior = np.column_stack([x, np.ones(6000)]), np.array([2.0, 4.0, 2.5, -3.5, 1.5, -1.0, -1.5, 2.0, 2.0, -2.5, -3.0])
    slope = a.T @ ((1 / (1 + np.exp(-a @ w)) - y) * 0.5 / 3000) + 2e-3 * (w - prior)
    assert np.abs(slope).max() < 1e-6


def test_blocks_of_a_table_are_gone_when_it_is_done(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}
    before = files()
    v = matching._pack(np.random.default_rng(6).normal(size=(4000, matching.DIM)).astype(np.float32))
    names = spark.createDataFrame([(i, i % 2 == 0, i % 2 == 1, r.tobytes()) for i, r in enumerate(v)], "h bigint, in_m boolean, in_s boolean, vec binary")
    got = matching.candidate_pairs(names, 4000, 0.3)
    assert got.count() > 0
    # with the shuffle of the pairs themselves
    most = (matching.TABLES - 1) * 4000 * (9 + matching.DIM // 2)
    for _ in range(40):
        left = sum(os.path.getsize(f) for f in files() - before if os.path.exists(f))
        if left < most:
            break
        time.sleep(0.5)
    assert left < most


def test_matching_lets_its_tables_go_and_takes_names_apart_alike(spark):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    m, s, _ = _catalogue(spark, 120)
    found = matching.p5_found(m, s, gazetteer(spark))
    # the weighed pairs and those with labels
    assert len({x for x in os.listdir(folder) if x.startswith("kept-")} - before) <= 2 and found.count() > 0
    rnd = random.Random(2)
    # the sums of groups, and the typings that eight letters and more leave to be looked up
    table, size = np.random.default_rng(1).normal(size=(50, 6)).astype(np.float32), np.array([3, 1, 7, 7, 2])
    rows, first = np.random.default_rng(2).integers(0, 50, 20), np.cumsum(size) - size
    assert np.allclose(matching._sums(table, rows, first, size), np.add.reduceat(table[rows], first, axis=0), atol=1e-5)
    usual = ["museum", "gallery", "collection", "musiksammlung", "sammlung", "railways", "townhall"]
    w = matching.Wording({u: 900 - i for i, u in enumerate(usual)}, 1000, {}, {})
    for _ in range(2000):
        word = mistype(rnd, mistype(rnd, rnd.choice(usual)))
        assert w.usual("kiheiroudaisen") and {d for d in matching._deletions(word, 1) if d in w.typings} <= {*w._shorter(word)}
    # texts of plain letters take a shorter way to the same end
    texts = ["Saint-Étienne", "  St. Ives (UK) ", "42 Main\nSt.", "", None, "Łódź", "A_B", "\tx", "É", "İzmir", "x\n", "99 Ünder", "!?"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(matching._folded(F.col("t")).alias("a"), fold(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_variants_without_a_key_word_meet_in_their_place(spark):
    filler = [dict(id=100 + i, name=f"{a}{b}o Town Museum", locality="Ghent") for i, (a, b) in enumerate((x, y) for x in ("Bakiru", "Dolenu", "Gosami", "Kutofi", "Metiva", "Pifulo") for y in ("bezan", "dorik", "gulem", "kifas", "mopit"))]
    m = museums(
        spark, dict(id=1, name="Town Museum", locality="Ath", location=(50.0, 5.0)), dict(id=2, name="Museum, Town", locality="Ath"), dict(id=3, name="Town Musum", locality="Ath"), dict(id=4, name="Museum Town", locality="Bree"),
        dict(id=5, name="Be Haz Oub", locality="Ath"), dict(id=6, name="Behazoub", locality="Ath"), *filler,
    )
    p = spark.createDataFrame([(1, "museum town", None, (50.02, 5.0)), (2, "museum town", None, (51.0, 5.0))], "place_id bigint, query string, display_name string, location struct<lat: double, lon: double>")
    got = {tuple(r) for r in variants.p4_found(m, p).collect()}
    assert {g[1:] for g in got if g[0] == "rows"} == {(1, 2), (1, 3), (2, 3), (5, 6)}
    assert {g[1:] for g in got if g[0] == "query"} == {(1, 1)}


def test_names_without_a_key_word_miss_no_similar_name_in_reach(spark):
    filler = [dict(id=100 + i, name=f"{a}{b}o Town Museum", locality="Ghent") for i, (a, b) in enumerate((x, y) for x in ("Bakiru", "Dolenu", "Gosami", "Kutofi", "Metiva", "Pifulo") for y in ("bezan", "dorik", "gulem", "kifas", "mopit"))]
    m = museums(
        spark, dict(id=1, name="Town Museum", locality="Ath"), dict(id=2, name="Twn Musm", locality="Ath"), dict(id=3, name="Town Museum", location=(50.0049, 5.0)), dict(id=4, name="Museum, Town", location=(50.0051, 5.0)),
        dict(id=5, name="Town Museum", location=(20.0, 179.99)), dict(id=6, name="Museum Town", location=(20.0, -179.99)), dict(id=7, name="Museum Town", location=(20.0, -179.9)), dict(id=8, name="Town Museum", location=(85.0, 10.45)), *filler,
    )
    p = spark.createDataFrame([(1, "museum town", None, (85.0, 10.0)), (2, "museum town", None, (85.0, 9.9))], "place_id bigint, query string, display_name string, location struct<lat: double, lon: double>")
    got = {tuple(r) for r in variants.p4_found(m, p).collect()}
    assert got == {("rows", 1, 2), ("rows", 3, 4), ("rows", 5, 6), ("query", 8, 1)}
    rnd = random.Random(4)
    usual = ["town", "museum", "gallery", "music", "modern", "mosaic", "musical", "of", "glass", "graz"]
    short = ["m", "mus", "twn", "gly", "gl", "mod", "o", "msc"]
    lists = sorted({" ".join(mistype(rnd, w) if len(w) > 4 and rnd.random() < 0.2 else w for w in rnd.choices(usual + short, k=rnd.randint(1, 4))) for _ in range(250)} | {f"{''.join(rnd.choices('bdgklmaeiou', k=7))} {rnd.choice(usual)}" for _ in range(40)})
    n = variants.Names(None, spark.createDataFrame([*((k, 1) for k in lists), *((w, 400) for w in usual)], "nk string, n bigint"), spark.createDataFrame([], "token string, df bigint"), spark.createDataFrame([], "id bigint, own string, other string"))
    every, none = spark.createDataFrame([(k, "t") for k in lists], "nk string, at string"), spark.createDataFrame([], "nk string, at string")
    plain = n.shaped.filter("NOT keyed").select("nk")
    a, b = every.select(every.nk.alias("a")), every.select(every.nk.alias("b"))
    pairs = a.join(b, a.a < b.b).join(plain.withColumnRenamed("nk", "p"), F.expr("p = a OR p = b"), "left_semi")
    want = {(r.a, r.b) for r in n.scored(pairs).filter("level > 0").collect()}
    assert len(want) > 500 and want <= {tuple(r) for r in n.keyless_candidates((every, every), (none, none)).collect()}


def test_variants_take_few_plans(spark, monkeypatch):
    filler = [dict(id=100 + i, name=f"{a}{b}o Town Museum", locality="Ghent", location=(50.0, 5.0)) for i, (a, b) in enumerate((x, y) for x in ("Bakiru", "Dolenu", "Gosami") for y in ("bezan", "dorik", "gulem"))]
    m = museums(spark, dict(id=1, name="Town Museum", locality="Ath", location=(50.0, 5.0)), dict(id=2, name="Museum, Town", locality="Ath"), *filler)
    p = spark.createDataFrame([(1, "museum town", None, (50.02, 5.0))], "place_id bigint, query string, display_name string, location struct<lat: double, lon: double>")
    steps, own = [], variants.cut
    monkeypatch.setattr(variants, "cut", lambda d: steps.append(d) or own(d))
    found = variants.p4_found(m, p)
    # what the driver holds follows the steps: each kind of place had three of its own
    assert len(steps) <= 24
    assert {tuple(r) for r in found.collect()} >= {("rows", 1, 2), ("query", 1, 1)}


def test_two_errors_told_near_the_diagonal_alone():
    rnd = random.Random(8)
    for _ in range(3000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        b = mistype(rnd, mistype(rnd, a)) if len(a) > 4 and rnd.random() < 0.6 else "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        assert variants._within_two(a, b) == (levenshtein(a, b) <= 2), (a, b)
    began = time.time()
    assert variants._within_two("ab" * 20_000, "ab" * 10_000 + "x" + "ab" * 10_000) and matching.Wording({"museum": 90}, 100, {}, {}).usual("w" * 50_000) == "w" * 50_000
    assert time.time() - began < 5


def test_words_of_two_names_are_taken_apart_once(monkeypatch):
    calls, own = [], variants.bigrams
    monkeypatch.setattr(variants, "bigrams", lambda w: calls.append(w) or own(w))
    key = lambda *ws: [(w, 1.0, True) for w in ws]
    assert variants.soft_similarity(key("bakirube", "dolenuto", "gosamika"), key("metivalo", "pifuloze", "bakiruba"))[1] == 0
    assert len(calls) <= 6
    assert variants.soft_similarity(key("bakirubezan"), key("bakirubezon"))[1] == 3 and variants.soft_similarity(key("museum"), key("zzglass")) == (0.0, 0)
    assert variants.soft_similarity([("", 1.0, False)], [("town", 1.0, False)]) == (0.6, 3)


def test_swapped_neighbours_are_one_error(spark):
    got = {tuple(r) for r in variants.close_words(spark.createDataFrame([(w,) for w in ("museum", "musuem", "umsuem", "salon", "saoln", "town", "twon")], "token string")).collect()}
    assert {g for g in got if g[2] == 1} == {("museum", "musuem", 1), ("musuem", "umsuem", 1), ("salon", "saoln", 1)}


def test_shared_hosts_are_told_before_pairs_have_both_profiles(spark, monkeypatch):
    plans, own = [], matching.evidence
    monkeypatch.setattr(matching, "evidence", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or own(d))
    m, s, _ = _catalogue(spark, 40)
    matching.match_records(m, s, gazetteer(spark))
    assert "LeftOuter" not in next(x for x in plans[0].split("\n") if "Join" in x)


def test_vectors_go_before_words_are_compared_and_profiles_travel_without_subjects(spark, monkeypatch):
    folder, had, plans, compared, evidence = shared_dir(spark).removeprefix("file://"), [], [], matching.compared, matching.evidence
    before = set(os.listdir(folder))
    vectors = lambda: [x for x in set(os.listdir(folder)) - before if x.startswith("kept-") and "vec" in spark.read.parquet(f"{folder}/{x}").columns]
    monkeypatch.setattr(matching, "compared", lambda *a: had.extend(vectors()) or compared(*a))
    monkeypatch.setattr(matching, "evidence", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or evidence(d))
    m, s, _ = _catalogue(spark, 40)
    matching.match_records(m, s, gazetteer(spark))
    assert not had
    assert "subject" not in plans[0]
