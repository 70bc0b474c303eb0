"""Point reads, place resolution, combined search and response shapes, in batch form where Spark gains by it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.fuzzy import similar_pairs
from vitrine.functions.geo import within_km
from vitrine.functions.text import filled, fold
from vitrine.operators.search import check_limits, placed, site_targets, town_places


def museum_by(museums: DataFrame, key: str) -> DataFrame:
    """The row of a numeric id or of an external id; the filter reaches the scan, no row is no error."""
    hit = (F.col("id") == int(key)) if key.isdecimal() else (F.col("wikidata_id") == key)
    return museums.filter(hit).orderBy("id").limit(1)


def targets_near(museums: DataFrame, site: Column, lat: float, lon: float, km: float, limit: int = 500) -> DataFrame:
    """Sites whose most prominent museum lies within ``km``, nearest first: site, id, name, distance_km."""
    check_limits(radius_km=km, limit=limit, lat=lat, lon=lon)
    t = site_targets(museums, site).join(placed(museums).select("id", "lat", "lon"), "id")
    return within_km(t, lat, lon, km).orderBy("distance_km", "site").limit(limit).select("site", "id", "name", "distance_km")


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows in an order, with ``total`` and ``has_more``. The total is a partial aggregate of its own."""
    check_limits(limit=limit, offset=offset)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def response(page: DataFrame, **echo: object) -> str:
    """A page as a JSON answer: count, total, has_more, the request echoed, and the items."""
    import json

    items = [json.loads(x) for x in page.drop("total", "has_more").toJSON().collect()]
    first = page.select("total", "has_more").first()
    return json.dumps({"count": len(items), "total": first["total"] if first else 0, "has_more": bool(first and first["has_more"]), **echo, "items": items}, ensure_ascii=False, default=str)


def show_matches(museums: DataFrame, exhibitions: DataFrame) -> DataFrame:
    """(id, exhibition_id): shows of a museum by external id, or by folded name where the show has none.

    A name that two museums share matches both, as on the map.
    """
    m = museums.select("id", filled(F.col("wikidata_id")).alias("wid"), fold(F.col("name")).alias("n"))
    e = exhibitions.select("exhibition_id", filled(F.col("museum_wikidata_id")).alias("wid"), fold(F.col("museum")).alias("n")).distinct()
    by_id = e.filter("wid IS NOT NULL").join(m.filter("wid IS NOT NULL"), "wid").select("id", "exhibition_id")
    by_name = e.filter("wid IS NULL AND n <> ''").join(m, "n").select("id", "exhibition_id")
    return by_id.unionByName(by_name).distinct()


def show_counts(matches: DataFrame) -> DataFrame:
    """(id, shows) of matched museums."""
    return matches.groupBy("id").agg(F.count_distinct("exhibition_id").alias("shows"))


def spots(rows: DataFrame) -> DataFrame:
    """Rows on one spot of four decimals: lat4, lon4 (in ten thousandths of a degree), rows, venues."""
    near = lambda c: F.floor(F.col(c) * 10_000 + 0.5)
    return placed(rows).groupBy(near("lat").alias("lat4"), near("lon").alias("lon4")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("museum").alias("venues"))


def days_left(end: Column, today: Column) -> Column:
    """Label of the days a show has left."""
    n = F.datediff(end, today)
    label = F.when(n < 0, "over").when(n == 0, "last day").when(n == 1, "1 day left").when(n <= 14, F.concat(n.cast("string"), F.lit(" days left")))
    return F.when(end.isNull(), "no end").otherwise(F.coalesce(label.when(n <= 60, F.concat(F.round(n / 7.0).cast("int").cast("string"), F.lit(" weeks left"))), F.lit("open")))


def closing_order(rows: DataFrame) -> DataFrame:
    """Soonest close first, shows without an end last, then nearest, then by venue."""
    return rows.orderBy(F.asc_nulls_last("ends_on"), "distance_km", "museum", "exhibition_id")


def resolve_places(asked: DataFrame, cache: DataFrame, geocoded: DataFrame, museums: DataFrame, least: float = 0.45) -> DataFrame:
    """(query, tier, lat, lon, radius_km) of every distinct query: cache, geocoder answers, towns of the catalogue, none.

    ``cache``: query, found, lat, lon, radius_km, negative answers included; ``geocoded``: query, lat, lon, radius_km of
    answers that came (a failed call has no row and is never cached). Each tier sees only what the ones before left, and
    towns are met on shared trigrams, so it costs one join a tier however many queries there are.
    """
    q = asked.select(F.lower(F.trim("query")).alias("query")).filter("query <> ''").distinct()
    c = cache.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.max(F.struct("found", "lat", "lon", "radius_km")).alias("a"))
    one = q.join(c, "query").select("query", F.when(F.col("a.found"), "cache").otherwise("none").alias("tier"), "a.lat", "a.lon", "a.radius_km")
    left = q.join(c, "query", "left_anti")
    g = geocoded.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.max(F.struct("lat", "lon", "radius_km")).alias("a"))
    two = left.join(g, "query").select("query", F.lit("geocoder").alias("tier"), "a.lat", "a.lon", "a.radius_km")
    rest = left.join(g, "query", "left_anti")
    towns = town_places(museums).select(F.xxhash64("country", "town").alias("key"), F.col("town").alias("text"), "country", "town", "members", "clat", "clon", "spread_km")
    met = similar_pairs(rest.select(F.col("query").alias("key"), fold(F.col("query")).alias("text")).filter("text <> ''"), towns.select("key", "text"), least)
    best = met.join(towns, met["right_key"] == towns["key"]).groupBy(F.col("left_key").alias("query")).agg(F.max(F.struct("sim", "members", "country", "town", "clat", "clon", "spread_km")).alias("b"))
    radius = F.greatest(F.lit(2.0), F.least(F.lit(25.0), F.col("b.spread_km")))
    three = best.select("query", F.lit("town").alias("tier"), F.col("b.clat").alias("lat"), F.col("b.clon").alias("lon"), radius.alias("radius_km"))
    null = F.lit(None).cast("double")
    four = rest.join(best.select("query"), "query", "left_anti").select("query", F.lit("none").alias("tier"), null.alias("lat"), null.alias("lon"), null.alias("radius_km"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def merged_hits(places: DataFrame, museums: DataFrame, shows: DataFrame, each: int = 5) -> DataFrame:
    """(kind, rank, key, label): the first places, then museums, then shows of a search, each in its own order.

    Inputs: rank, key, label.
    """
    kinds = [("place", places), ("museum", museums), ("show", shows)]
    out = None
    for i, (kind, rows) in enumerate(kinds):
        part = rows.filter(F.col("rank") <= each).select(F.lit(i).alias("kind_order"), F.lit(kind).alias("kind"), "rank", F.col("key").cast("string").alias("key"), "label")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("kind_order", "rank").drop("kind_order")


def to_scrape(museums: DataFrame, site: Column, near: tuple[float, float, float] | None = None, most: int = 5_000) -> DataFrame:
    """Museums with a site to read, all or those within (lat, lon, km), the most prominent ``most`` of an area."""
    m = museums.withColumn("site", site).filter("site IS NOT NULL")
    if near is None:
        return m.select("id", "name", "site")
    return within_km(placed(m), *near).orderBy(F.desc_nulls_last("sitelinks"), "id").limit(most).select("id", "name", "site")


def running_labels(exhibitions: DataFrame, today: date) -> DataFrame:
    """(exhibition_id, label): how long each listing is still on."""
    return exhibitions.select("exhibition_id", days_left(F.col("ends_on"), F.lit(today)).alias("label")).distinct()


def first_hits(rows: DataFrame, order: list[Column], key: str, label: str, most: int = 5) -> DataFrame:
    """(rank, key, label) of the first rows in an order, for ``merged_hits``; only they are numbered."""
    return rows.orderBy(*order).limit(most).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.col(key).alias("key"), F.col(label).alias("label"))
