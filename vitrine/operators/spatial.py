"""Radius joins and region containment over very many points.

Space is cut into the Voronoi cells of pivots drawn from the points themselves, so dense towns get more
cells. An item whose ball of radius r may reach another cell is copied there: by the triangle inequality
that holds only if its distance to that pivot is at most its distance to the nearest pivot plus 2 r. In each
cell a vantage-point tree answers all queries of the cell with the exact great-circle metric.

The join works on distinct positions and is expanded to rows by equi-joins afterwards, so a position held
by very many rows is one point in one cell and never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.geo import EARTH_M, VPTree, np_haversine_m, np_unit, usable

#: Points wanted in a cell, and the most pivots. The pivots are the only thing sent to every task: 24 bytes each, 1.5 MB at
#: most. Beyond CELL_POINTS * MAX_PIVOTS positions cells grow, and their trees with them by n log n: 30,000 points at 2e9.
CELL_POINTS, MAX_PIVOTS = 1500, 1 << 16
#: Pivots that lead to the others.
LEADERS = 256
_SLACK_M = 1.0


def choose_pivots(points: DataFrame, cell_points: int = CELL_POINTS, max_pivots: int = MAX_PIVOTS) -> np.ndarray:
    """Pivots as unit vectors: the points with the smallest hashes, at most ``max_pivots`` of them.

    ``points`` holds distinct ``lat``, ``lon``. The draw is deterministic and follows the density; a threshold on the
    hash chooses the points, so that no task sorts them.
    """
    n = points.count()
    if not n:
        return np.zeros((0, 3))
    k = int(min(max_pivots, max(1, n // cell_points)))
    whole = 1 << 40
    drawn = points.select("lat", "lon", F.pmod(F.xxhash64("lat", "lon"), F.lit(whole)).alias("h")).filter(F.col("h") < int(min(1.0, (1.2 * k + 30) / n) * whole))
    rows = sorted((r["h"], r["lat"], r["lon"]) for r in drawn.collect())[:k]
    a = np.radians(np.array([r[1:] for r in rows], dtype=float)).reshape(-1, 2)
    return np_unit(a[:, 0], a[:, 1])


def _near_pivots(vec: np.ndarray, margin: np.ndarray, pivots: np.ndarray):
    """(item, pivot, nearest) of each item: its nearest pivot, and all at most ``margin`` (an angle) farther away."""
    rows, cells, homes = [], [], []
    step = max(1, 2_000_000 // max(1, len(pivots)))
    for s in range(0, len(vec), step):
        dots = vec[s : s + step] @ pivots.T
        home = dots.argmax(1)
        nearest = np.arccos(np.clip(dots[np.arange(len(home)), home], -1, 1))
        limit = np.minimum(np.pi, nearest + margin[s : s + step])
        mask = dots >= np.cos(limit)[:, None]
        mask[np.arange(len(home)), home] = True
        r, c = np.nonzero(mask)
        rows.append(r + s)
        cells.append(c)
        homes.append(home[r] == c)
    if not rows:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def _cells(lat: np.ndarray, lon: np.ndarray, reach: np.ndarray, pivots: np.ndarray):
    """(item, cell, home) of each item: its nearest pivot's cell, and every cell its ball may reach.

    Of many pivots some lead: an item with leader l at distance d has every pivot it needs within d plus its margin,
    so within 2 d plus the margin of l; only those are looked at.
    """
    vec = np_unit(np.radians(lat), np.radians(lon))
    margin = (2 * reach + _SLACK_M) / EARTH_M
    if len(pivots) <= 4 * LEADERS:
        return _near_pivots(vec, margin, pivots)
    leaders = pivots[:LEADERS]
    own = np.concatenate([(vec[s : s + 8192] @ leaders.T).argmax(1) for s in range(0, len(vec), 8192)]) if len(vec) else np.empty(0, int)
    order = np.argsort(own, kind="stable")
    found = []
    for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        if not len(part):
            continue
        leader = leaders[own[part[0]]]
        far = np.arccos(np.clip(vec[part] @ leader, -1, 1))
        # the closer half needs far fewer pivots than the outermost item
        for some in np.split(part[np.argsort(far, kind="stable")], [len(part) // 2, len(part) * 7 // 8]):
            if len(some):
                d = np.arccos(np.clip(vec[some] @ leader, -1, 1))
                near = np.flatnonzero(pivots @ leader >= np.cos(min(np.pi, (2 * d + np.maximum(margin[some], 0)).max() + 1e-9)))
                i, c, h = _near_pivots(vec[some], margin[some], pivots[near])
                found.append((some[i], near[c], h))
    if not found:
        return _near_pivots(vec, margin, pivots)
    return tuple(np.concatenate(x) for x in zip(*found))


def _assign(pivots: np.ndarray, reach_m: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lat, lon = b.column("lat").to_numpy(), b.column("lon").to_numpy()
            r, c, home = _cells(lat, lon, np.full(len(lat), reach_m), pivots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int32)), pa.array(lat[r]), pa.array(lon[r]), pa.array(home)], ["cell", "lat", "lon", "home"]
            )

    return run


def close_positions(points: DataFrame, radius_m: float, pivots: np.ndarray) -> DataFrame:
    """Pairs of different positions at most ``radius_m`` apart, each once: lat_a, lon_a, lat_b, lon_b.

    A pair is reported in the home cell of its smaller position (by lat, then lon); the other one is at home
    there or was copied there.
    """
    schema = "lat_a double, lon_a double, lat_b double, lon_b double"
    if not len(pivots):
        return points.sparkSession.createDataFrame([], schema)

    def join(t: pa.Table) -> pa.Table:
        lat, lon, home = t.column("lat").to_numpy(), t.column("lon").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        own = np.nonzero(home)[0]
        la, lo = np.radians(lat), np.radians(lon)
        if len(own):
            q, p = VPTree(la, lo).within(la[own], lo[own], np.full(len(own), radius_m))
            q = own[q]
            keep = (lat[q] < lat[p]) | ((lat[q] == lat[p]) & (lon[q] < lon[p]))
            q, p = q[keep], p[keep]
        else:
            q = p = own
        return pa.table({"lat_a": lat[q], "lon_a": lon[q], "lat_b": lat[p], "lon_b": lon[p]})

    placed = points.mapInArrow(_assign(pivots, radius_m), "cell int, lat double, lon double, home boolean")
    return placed.groupBy("cell").applyInArrow(join, schema)


def _ring_ball(lat: np.ndarray, lon: np.ndarray) -> tuple[float, float, float]:
    """Centre in degrees and a radius in metres that holds a ring whose edges are straight in degrees."""
    t = np.linspace(0, 1, 17)[:-1, None]
    a = (lat + t * (np.roll(lat, -1) - lat)).T.ravel()
    o = (lon + t * (np.roll(lon, -1) - lon)).T.ravel()
    ra, ro = np.radians(a), np.radians(o)
    ca, co = (a.min() + a.max()) / 2, (o.min() + o.max()) / 2
    d = np_haversine_m(np.radians(ca), np.radians(co), ra, ro).max()
    gap = np_haversine_m(ra, ro, np.roll(ra, -1), np.roll(ro, -1)).max()
    return ca, co, float(d + gap)


def _inside(lat: np.ndarray, lon: np.ndarray, rlat: np.ndarray, rlon: np.ndarray) -> np.ndarray:
    """Even-odd test; a ring that runs on past 180 also holds the points a turn further west."""
    found = np.zeros(len(lat), bool)
    jlat, jlon = np.roll(rlat, 1), np.roll(rlon, 1)
    for turn in (0.0, 360.0, -360.0):
        x = lon + turn
        if x.size and (x.max() < rlon.min() or x.min() > rlon.max()):
            continue
        odd = np.zeros(len(lat), bool)
        for a, o, b, q in zip(rlat, rlon, jlat, jlon):
            if a != b:
                odd ^= ((a > lat) != (b > lat)) & (x < (q - o) * (lat - a) / (b - a) + o)
        found |= odd
    return found


def positions_in_regions(points: DataFrame, regions: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(region_id, lat, lon) of every distinct position that lies in a region.

    ``regions``: region_id bigint, ring array<struct<lat, lon>>. A region is a ball query (its enclosing
    ball) copied to every cell the ball may reach; the ring itself is tested on what the ball finds. Rings
    that are null or have fewer than three whole corners hold nothing.
    """
    schema = "region_id bigint, lat double, lon double"
    if not len(pivots):
        return points.sparkSession.createDataFrame([], schema)
    item = "cell int, region_id bigint, lat double, lon double, rlat array<double>, rlon array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "region_id", "lat", "lon", "rlat", "rlon"]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for rid, ring in zip(b.column("region_id").to_pylist(), b.column("ring").to_pylist()):
                pts = [(p["lat"], p["lon"]) for p in ring or [] if p and p["lat"] is not None and p["lon"] is not None]
                if rid is None or len(pts) < 3:
                    continue
                rl, ro = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
                ca, co, ball = _ring_ball(rl, ro)
                for c in _cells(np.array([ca]), np.array([co]), np.array([ball]), pivots)[1]:
                    for column, v in zip(out, (int(c), rid, ball, 0.0, rl.tolist(), ro.tolist())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    def join(t: pa.Table) -> pa.Table:
        rid = t.column("region_id")
        is_region = np.asarray(rid.is_valid())
        pts, regs = t.filter(pa.array(~is_region)), t.filter(pa.array(is_region))
        lat, lon = pts.column("lat").to_numpy(), pts.column("lon").to_numpy()
        ids, la, lo = [], [], []
        if len(lat) and regs.num_rows:
            tree = VPTree(np.radians(lat), np.radians(lon))
            rings = [(i, np.array(a), np.array(o)) for i, a, o in zip(*(regs.column(c).to_pylist() for c in ("region_id", "rlat", "rlon")))]
            balls = np.array([_ring_ball(a, o) for _, a, o in rings])
            q, p = tree.within(np.radians(balls[:, 0]), np.radians(balls[:, 1]), balls[:, 2])
            order = np.argsort(q, kind="stable")
            q, p = q[order], p[order]
            for k in np.unique(q):
                cand = p[np.searchsorted(q, k) : np.searchsorted(q, k, side="right")]
                i, a, o = rings[k]
                hit = cand[_inside(lat[cand], lon[cand], a, o)]
                ids.append(np.full(len(hit), i, np.int64))
                la.append(lat[hit])
                lo.append(lon[hit])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"region_id": cat(ids, np.int64), "lat": cat(la, float), "lon": cat(lo, float)})

    homes = points.mapInArrow(_assign(pivots, -_SLACK_M), "cell int, lat double, lon double, home boolean").filter("home")
    none = F.lit(None)
    homes = homes.select("cell", none.cast("bigint").alias("region_id"), "lat", "lon", none.cast("array<double>").alias("rlat"), none.cast("array<double>").alias("rlon"))
    return homes.unionByName(regions.select("region_id", "ring").mapInArrow(place, item)).groupBy("cell").applyInArrow(join, schema)


def near_pairs(museums: DataFrame, radius_m: float = 100.0, cell_points: int = CELL_POINTS) -> DataFrame:
    """Pairs (id_a < id_b) of rows with usable, not approximate positions at most ``radius_m`` apart.

    Null ids and rows without a usable position take no part; a null ``location_approximate`` counts as
    false; repeated ids count once; an empty table gives an empty result.
    """
    placed = (
        museums.select("id", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), "location_approximate")
        .filter(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon")) & ~F.coalesce("location_approximate", F.lit(False)))
        .select("id", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    )
    at = placed.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    points = at.select("lat", "lon")
    pivots = choose_pivots(points, cell_points)
    pairs = close_positions(points, radius_m, pivots)
    same = at.filter("n > 1").select(*(F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("lat", "lon")))
    pairs = pairs.unionByName(same)
    a = placed.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = placed.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    alike = (F.col("lat_a") == F.col("lat_b")) & (F.col("lon_a") == F.col("lon_b"))
    return (
        pairs.join(a, ["lat_a", "lon_a"])
        .join(b, ["lat_b", "lon_b"])
        .filter((F.col("a") != F.col("b")) & (~alike | (F.col("a") < F.col("b"))))
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        .distinct()
    )


def rows_in_regions(rows: DataFrame, key: str, regions: DataFrame, cell_points: int = CELL_POINTS * 4) -> DataFrame:
    """(key, region_id): the regions each row's usable ``location`` lies in, each once."""
    placed = (
        rows.select(F.col(key).alias("key"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"))
        .filter(F.col("key").isNotNull() & usable(F.col("lat"), F.col("lon")))
        .select("key", (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    )
    points = placed.select("lat", "lon").distinct()
    found = positions_in_regions(points, regions, choose_pivots(points, cell_points))
    return placed.join(found, ["lat", "lon"]).select("key", "region_id").distinct()


def p3_found(museums: DataFrame, exhibitions: DataFrame, areas: DataFrame) -> DataFrame:
    """Close museums ('near') and the areas that hold a listing ('area') as kind, key_a, key_b."""
    near = near_pairs(museums).select(F.lit("near").alias("kind"), F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))
    regions = areas.select(F.col("area_id").alias("region_id"), "ring")
    held = rows_in_regions(exhibitions, "exhibition_id", regions)
    return near.unionByName(held.select(F.lit("area").alias("kind"), F.col("key").alias("key_a"), F.col("region_id").alias("key_b")))
