import itertools
import random

import numpy as np

from vitrine.functions.geo import VPTree, np_haversine_m
from vitrine.operators import spatial
from vitrine.operators.spatial import near_pairs, p3_found, rows_in_regions

M = "id bigint, location struct<lat: double, lon: double>, location_approximate boolean, lat string"  # lat: a clashing column


def test_tree_equals_brute_force():
    rng = np.random.default_rng(1)
    lat, lon = np.radians(rng.uniform(-89, 89, 700)), np.radians(rng.uniform(-180, 180, 700))
    r = rng.uniform(1e4, 3e6, 700)
    q, p = VPTree(lat, lon, leaf=8).within(lat, lon, r)
    d = np_haversine_m(lat[:, None], lon[:, None], lat[None], lon[None])
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= r[:, None]))))


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, (50 + rnd.random() * 0.01, 179.995 + rnd.random() * 0.01), False, None) for i in range(400)]
    rows = [(i, (a, o - 360 if o > 180 else o), f, n) for i, (a, o), f, n in rows]
    rows += [(500 + i, (10.0, 10.0), None, "x") for i in range(5)] + [(500, (10.0, 10.0), None, "x")]  # one spot, a repeated row
    rows += [(600, None, False, None), (601, (0.0, 0.0), False, None), (602, (91.0, 0.0), False, None), (603, (10.0, 10.0), True, None), (None, (10.0, 10.0), False, None), (604, (None, 3.0), False, None)]
    got = {tuple(r) for r in near_pairs(spark.createDataFrame(rows, M), 100.0, cell_points=20).collect()}
    good = {i: l for i, l, f, _ in rows if i is not None and i < 600}
    want = set()
    for a, b in itertools.combinations(sorted(good), 2):
        (x, y), (u, v) = good[a], good[b]
        if np_haversine_m(*np.radians([x, y, u, v])) <= 100.0:
            want.add((a, b))
    assert got == want and len(want) > 50


def test_regions_across_the_date_line_and_empty_tables(spark):
    ring = [(-1.0, 179.0), (-1.0, 181.0), (1.0, 181.0), (1.0, 179.0)]
    regions = spark.createDataFrame([(7, ring), (8, None), (9, [(0.0, 0.0), (1.0, 1.0)])], "region_id bigint, ring array<struct<lat: double, lon: double>>")
    e = spark.createDataFrame([(1, (0.0, 179.5)), (1, (0.0, 179.5)), (2, (0.5, -179.5)), (3, (0.0, 178.9)), (4, None), (5, (2.0, 180.0))], "exhibition_id bigint, location struct<lat: double, lon: double>")
    assert {tuple(r) for r in rows_in_regions(e, "exhibition_id", regions).collect()} == {(1, 7), (2, 7)}
    none = p3_found(spark.createDataFrame([], M), e.limit(0), spark.createDataFrame([], "area_id bigint, ring array<struct<lat: double, lon: double>>"))
    assert none.count() == 0 and none.columns == ["kind", "key_a", "key_b"]


def test_leaders_find_the_cells_that_all_pivots_find():
    rnd = np.random.default_rng(5)
    lat, lon = np.degrees(np.arcsin(rnd.uniform(-1, 1, 9000))), rnd.uniform(-180, 180, 9000)
    lat[:3000], lon[:3000] = 51.5 + rnd.normal(0, 0.2, 3000), rnd.normal(0, 0.3, 3000)
    a = np.radians(np.array([lat[::2], lon[::2]]))
    pivots = spatial.np_unit(a[0], a[1])[rnd.permutation(4500)]
    for reach in (100.0, 50_000.0, -spatial._SLACK_M):
        got, want = (sorted(zip(*(x.tolist() for x in f))) for f in (spatial._cells(lat, lon, np.full(9000, reach), pivots), spatial._near_pivots(spatial.np_unit(np.radians(lat), np.radians(lon)), np.full(9000, (2 * reach + spatial._SLACK_M) / spatial.EARTH_M), pivots)))
        assert got == want and {g[0] for g in got if g[2]} == set(range(9000))
    assert len(spatial._cells(lat[:0], lon[:0], lat[:0], pivots)[0]) == 0
