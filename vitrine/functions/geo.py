"""Great-circle geometry as Column expressions (all JVM-side) and as numpy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6_371_008.8


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null when any coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    # not least(), which would turn a null into 1
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def usable(lat: Column, lon: Column) -> Column:
    """True for a position that isn't null, (0,0) or out of range; never null."""
    return F.coalesce(
        lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0.0) & (lon == 0.0)), F.lit(False)
    )


def within_km(df: DataFrame, lat: float, lon: float, km: float, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Rows within ``km`` of a point, with ``distance_km``.

    A latitude band is filtered first: it reaches the Parquet scan as a pushed range, the exact distance
    only runs on the survivors. The band alone is enough near the poles and across the date line.
    """
    pad = km / 111.0 * 1.01
    d = haversine_km(F.lit(lat), F.lit(lon), F.col(lat_col), F.col(lon_col))
    return (
        df.filter(F.col(lat_col).between(lat - pad, lat + pad)).withColumn("distance_km", d).filter(F.col("distance_km") <= km)
    )


def reach_in_degrees(lat: Column, km: float) -> Column:
    """Degrees of longitude that a circle of ``km`` around a latitude reaches at most on either side."""
    widest = F.cos(F.radians(F.least(F.abs(lat) + km / 111.0, F.lit(90.0))))
    return F.least(F.lit(180.0), F.lit(km / 111.0) / F.greatest(widest, F.lit(1e-6)))


def columns_around(lon: Column, wide: Column, size: float) -> Column:
    """Grid columns of ``size`` degrees that ``wide`` degrees around a longitude reach, over the 180th meridian too."""
    column = lambda c: F.floor((c + 180.0) / size)
    west, east, turn = lon - wide, lon + wide, F.lit(int(360 / size) + 1).cast("bigint")
    span = lambda w, e: F.struct(w.alias("w"), e.alias("e"))
    spans = F.array_compact(F.array(span(F.greatest(west, F.lit(-180.0)), F.least(east, F.lit(180.0))), F.when(west < -180, span(west + 360, F.lit(180.0))), F.when(east > 180, span(F.lit(-180.0), east - 360))))
    zero = F.lit(0).cast("bigint")
    return F.array_distinct(F.flatten(F.transform(spans, lambda p: F.sequence(F.greatest(column(p.w), zero), F.least(column(p.e), turn)))))


def grid(lat: Column, lon: Column, km: float, around: bool) -> Column:
    """Labels of grid cells: a position's own, or ``around``, all in which a position within ``km`` may lie; none for nulls.

    Bands of latitude, cut into columns as wide as high where the band is nearest to the pole.
    """
    size = km / 100.0
    band, steps = F.floor(lat / size), (-1, 0, 1) if around else (0,)

    def label(i: int, j: int) -> Column:
        # a column is wide enough for both circles of latitude that a pair may lie on
        edge = F.greatest(F.abs((band + i - 1) * size), F.abs((band + i + 2) * size))
        n = F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * (360.0 / size)))
        return F.concat_ws(",", band + i, F.pmod(F.floor((lon + 180.0) / 360.0 * n) + j, n))

    return F.when(lat.isNotNull() & lon.isNotNull(), F.array_distinct(F.array(*(label(i, j) for i in steps for j in steps)))).otherwise(F.array().cast("array<string>"))


def cell_label(lat: Column, lon: Column, size: float = 0.25) -> Column:
    """Grid-cell label, the centre rounded half away from zero, two decimals."""
    r = lambda c: F.round(c / size) * size + F.lit(0.0)
    return F.format_string("%.2f,%.2f", r(lat), r(lon))


def cell_reach_km(size: float = 0.25) -> float:
    """Radius in km that covers a grid cell from its centre, at the equator, where cells are largest: half its diagonal."""
    return float(size * 111.195 * np.sqrt(2) / 2)


def zoom_for(km: Column) -> Column:
    """Map zoom at which a radius fills about a screen: one less for each doubling, between 3 and 16."""
    return F.greatest(F.lit(3), F.least(F.lit(16), F.floor(F.lit(14.5) - F.log2(F.greatest(km, F.lit(0.1)))))).cast("int")


def radius_for_bbox(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Radius in km that covers a box: half its larger side, between 1 and 50."""
    high = (north - south) * 111.0
    wide = (east - west) * 111.0 * F.cos(F.radians((north + south) / 2))
    return F.greatest(F.lit(1.0), F.least(F.lit(50.0), F.greatest(high, wide) / 2))


def np_haversine_m(lat1, lon1, lat2, lon2):
    """Metres between points given in radians, on the mean sphere, in double precision."""
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def np_unit(lat, lon):
    """Unit vectors of points given in radians, one row each."""
    c = np.cos(lat)
    return np.column_stack([c * np.cos(lon), c * np.sin(lon), np.sin(lat)])


class VPTree:
    """Vantage-point tree over points in radians with the great-circle metric.

    Searches take many queries at once: a node receives the queries whose ball reaches it, so the work is
    in numpy calls on whole blocks.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, leaf: int = 64):
        self.lat, self.lon = lat, lon
        self.nodes: list[tuple] = []
        self.root = self._grow(leaf) if len(lat) else -1

    def _grow(self, leaf: int) -> int:
        todo = [(np.arange(len(self.lat)), None)]
        while todo:
            index, parent = todo.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = me
            if len(index) <= leaf:
                self.nodes.append([index])
                continue
            # the point farthest from the first one: an end of the cloud splits better than its middle
            d = np_haversine_m(self.lat[index[0]], self.lon[index[0]], self.lat[index], self.lon[index])
            v = index[int(np.argmax(d))]
            d = np_haversine_m(self.lat[v], self.lon[v], self.lat[index], self.lon[index])
            half = len(index) // 2
            order = np.argpartition(d, half)
            mu = float(d[order[half]])
            self.nodes.append([v, mu, -1, -1])
            todo.append((index[order[:half]], (me, 2)))
            todo.append((index[order[half:]], (me, 3)))
        return 0

    def within(self, lat: np.ndarray, lon: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query index, point index) of every point at most ``radius`` metres from a query."""
        out_q, out_p = [], []
        todo = [(self.root, np.arange(len(lat)))] if self.root == 0 and len(lat) else []
        while todo:
            at, q = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                index = node[0]
                step = max(1, 400_000 // max(1, len(index)))
                for s in range(0, len(q), step):
                    part = q[s : s + step]
                    d = np_haversine_m(lat[part, None], lon[part, None], self.lat[index][None], self.lon[index][None])
                    a, b = np.nonzero(d <= radius[part, None])
                    out_q.append(part[a])
                    out_p.append(index[b])
                continue
            v, mu, near, far = node
            d = np_haversine_m(self.lat[v], self.lon[v], lat[q], lon[q])
            slack = 1e-3 + radius[q]  # a millimetre over the metric's rounding
            if len(inner := q[d - slack <= mu]):
                todo.append((near, inner))
            if len(outer := q[d + slack >= mu]):
                todo.append((far, outer))
        if not out_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_q), np.concatenate(out_p)
