"""Radius, box, name and place queries over the catalogue."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.fuzzy import both_similarities, similar_texts, similarity, trigrams
from vitrine.functions.geo import columns_around, haversine_km, reach_in_degrees, usable, within_km
from vitrine.functions.text import filled, fold


def placed(rows: DataFrame) -> DataFrame:
    """Rows with a usable position, as lat and lon."""
    return rows.withColumns({"lat": F.col("location.lat"), "lon": F.col("location.lon")}).filter(usable(F.col("lat"), F.col("lon")))


def check_limits(radius_km: float = 1, limit: int = 1, offset: int = 0, query: str = "", lat: float = 0, lon: float = 0) -> None:
    """Bounds of a request; raises ValueError."""
    if not (0 < radius_km <= 50 and 0 < limit <= 500 and 0 <= offset <= 10_000 and len(query) <= 200 and -90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError("request out of bounds")


def nearby(museums: DataFrame, lat: float, lon: float, km: float, verified: bool = False, limit: int = 500, offset: int = 0) -> DataFrame:
    """One page of the rows within ``km``, nearest first, with the total. ``total`` is counted apart from the page, in a
    partial aggregate, so the page itself is a distributed top-k."""
    hit = within_km(placed(museums), lat, lon, km)
    if verified:
        hit = hit.filter("verified")
    hit = hit.select("id", "name", F.coalesce("country", F.lit("")).alias("country"), F.round("distance_km", 4).alias("distance_km"))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy("distance_km", "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def nearby_many(museums: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """(key, id, distance_km) of the rows within ``km`` of each of many points (key, lat, lon), in one join.

    A point looks into the grid cells its circle may reach (as wide in degrees as its latitude asks for, around the
    180th meridian too); rows stand in one cell each. Work follows what is near, not points times rows.
    """
    size = max(0.01, km / 111.0)
    row = lambda c: F.floor(F.col(c) / size)
    q = points.filter(usable(F.col("lat"), F.col("lon"))).select("key", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    q = q.withColumn("y", F.explode(F.sequence(row("qlat") - 1, row("qlat") + 1)))
    q = q.withColumn("x", F.explode(columns_around(F.col("qlon"), reach_in_degrees(F.col("qlat"), km), size)))
    m = placed(museums).select("id", "lat", "lon", row("lat").alias("y"), F.floor((F.col("lon") + 180.0) / size).alias("x"))
    d = haversine_km(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    return q.join(m, ["y", "x"]).withColumn("distance_km", d).filter(F.col("distance_km") <= km).select("key", "id", "distance_km")


def search_many(museums: DataFrame, queries: DataFrame, least: float = 0.5, best: int = 5) -> DataFrame:
    """(key, rank, id, sim): the most similar names for each of many queries (key, text), by one join over shared trigrams.

    Rows of one name are alike to a text, so a text takes the first few ids of each name, and only its best go to the
    queries: neither names nor texts that many rows share multiply.
    """
    names = museums.select("id", fold(F.col("name")).alias("text")).filter("text <> ''")
    asked = queries.select("key", fold(F.col("text")).alias("text")).filter("text <> ''")

    def first(d: DataFrame, of: str, order: list) -> DataFrame:
        return d.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(*order))).filter(F.col("rank") <= best)

    ids = first(names, "text", ["id"]).select(F.col("text").alias("b_text"), "id")
    # the planner takes few columns of a compressed table for less than they are: neither table is broadcast
    met = similar_texts(asked, names, least, best).hint("merge").join(ids, "b_text")
    top = first(met, "a_text", [F.desc("sim"), "id"]).select(F.col("a_text").alias("text"), "id", "sim")
    return first(asked.hint("merge").join(top, "text"), "key", [F.desc("sim"), "id"]).select("key", "rank", "id", "sim")


def in_box(museums: DataFrame, south: float, west: float, north: float, east: float, limit: int = 40_000) -> DataFrame:
    """Points in a box, most prominent first."""
    lon = F.col("lon").between(west, east) if west <= east else ~F.col("lon").between(east, west)
    return placed(museums).filter(F.col("lat").between(south, north) & lon).orderBy(F.desc("sitelinks"), "id").limit(limit).select("id", "lat", "lon")


def box_points(museums: DataFrame, south: float, west: float, north: float, east: float, limit: int = 40_000) -> tuple[DataFrame, bool]:
    """(points, truncated): [id, lat, lon] triples of a box, and whether there were more than ``limit``. One row more is asked for."""
    south, north = max(-90.0, min(south, north)), min(90.0, max(south, north))
    some = in_box(museums, south, west, north, east, limit + 1).cache()
    return some.limit(limit).select(F.array(F.col("id").cast("double"), "lat", "lon").alias("point")), some.count() > limit


def museum_score(q: str, name: Column, aliases: Column, town: Column, sitelinks: Column, located: Column, sim: Column, part: Column) -> Column:
    """Match class, similarities, town, prominence and placement in one number. ``q`` is folded."""
    g = F.lit(q)
    kind = F.when(name == g, 3.0).when(F.array_contains(aliases, g), 2.5).when(name.startswith(q), 1.5).when(F.instr(name, q) > 0, 0.75).otherwise(0.0)
    in_query = F.coalesce((F.length(town) >= 4) & F.concat(F.lit(" "), g, F.lit(" ")).contains(F.concat(F.lit(" "), town, F.lit(" "))), F.lit(False))
    known = 0.2 * F.log1p(F.greatest(F.coalesce(sitelinks, F.lit(0)), F.lit(0)).cast("double"))
    return kind + 0.7 * sim + 0.3 * part + F.when(in_query, 0.4).otherwise(0.0) + known + F.when(located, 0.01).otherwise(0.0)


def search_text(name: Column, aliases: Column, town: Column) -> Column:
    """All a row answers to, folded: its name, its distinct aliases in order, its town."""
    return F.trim(F.concat_ws(" ", name, F.array_join(F.array_sort(F.array_distinct(F.coalesce(aliases, F.array().cast("array<string>")))), " "), town))


def search_museums(museums: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Best names for a query, misspelt or not.

    The tests (name similar, a similar stretch in it, prefix, equal alias, all the row's names and its town together
    similar) choose the candidates; only they are scored. Each similarity needs that share of the query's trigrams at
    least, so rows with fewer are dropped by built-in set operations, before the stretches are looked at in Arrow batches.
    """
    q = museums.sparkSession.range(1).select(fold(F.lit(query)).alias("q")).first()["q"]
    m = museums.select("id", "name", fold(F.col("name")).alias("n"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), fold).alias("al"), fold(F.col("locality")).alias("town"), "sitelinks", usable(F.col("location.lat"), F.col("location.lon")).alias("located"))
    m = m.withColumn("st", search_text(F.col("n"), F.col("al"), F.col("town")))
    asked = trigrams(F.lit(q))
    shared = F.size(F.array_intersect(trigrams(F.col("st")), asked)) >= F.ceil(0.3 * F.size(asked) - 1e-9)
    m = m.filter(shared | F.col("n").startswith(q) | F.array_contains("al", q))
    m = m.withColumn("s", both_similarities(q, F.col("n"))).withColumn("whole", similarity(trigrams(F.col("st")), asked))
    cand = m.filter((F.col("s.sim") >= 0.3) | (F.col("s.part") >= 0.55) | F.col("n").startswith(q) | F.array_contains("al", q) | (F.col("whole") >= 0.3))
    score = museum_score(q, F.col("n"), F.col("al"), F.col("town"), F.col("sitelinks"), F.col("located"), F.col("s.sim"), F.col("s.part"))
    return cand.withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), F.length("n"), "name", "id").limit(limit).select("id", "name", "score")


def search_exhibitions(exhibitions: DataFrame, query: str, today: date, upcoming: bool = True, live: bool = False, limit: int = 50) -> DataFrame:
    """Best titles for a query among shows that aren't over; the venue counts as a substring only."""
    q = query.strip().lower()
    e = exhibitions.select("exhibition_id", "title", "museum", "starts_on", "ends_on", "retired_at").filter(running(F.lit(today), upcoming))
    if live:
        e = e.filter("retired_at IS NULL")
    t = F.lower("title")
    score = F.when(t == q, 3.0).when(t.startswith(q), 1.5).when(F.instr(t, q) > 0, 0.75).when(F.instr(F.lower("museum"), q) > 0, 0.5).otherwise(0.0)
    sim = similarity(trigrams(t), trigrams(F.lit(q)))
    hit = e.withColumn("sim", sim).withColumn("kind", score).filter((F.col("sim") >= 0.3) | (F.col("kind") > 0))
    hit = hit.select("exhibition_id", "title", "ends_on", F.round(F.col("kind") + F.col("sim"), 4).alias("score")).distinct()
    return hit.orderBy(F.desc("score"), F.asc_nulls_last("ends_on"), "exhibition_id").limit(limit).select("exhibition_id", "title", "score")


def running(today: Column, upcoming: bool = False) -> Column:
    """Whether a show isn't over, and has begun unless upcoming ones count too."""
    on = F.col("ends_on").isNull() | (F.col("ends_on") >= today)
    return on if upcoming else on & (F.col("starts_on").isNull() | (F.col("starts_on") <= today))


def exhibitions_near(exhibitions: DataFrame, lat: float, lon: float, km: float, today: date, upcoming: bool = False) -> DataFrame:
    """Live shows within ``km``, soonest close first, then nearest; shows without an end last."""
    hit = within_km(placed(exhibitions.filter("retired_at IS NULL")), lat, lon, km).filter(running(F.lit(today), upcoming))
    hit = hit.select("exhibition_id", "title", F.col("ends_on").cast("string").alias("ends_on"), F.round("distance_km", 4).alias("distance_km")).distinct()
    return hit.orderBy(F.asc_nulls_last("ends_on"), "distance_km", "exhibition_id")


def time_window(name: str, today: date) -> tuple[date, date]:
    """First and last day of "now", "weekend" (the coming or running one) or "month" (30 days)."""
    if name == "now":
        return today, today
    if name == "weekend":
        first = today + timedelta(days=max(0, 5 - today.weekday()))
        return first, today + timedelta(days=6 - today.weekday())
    if name == "month":
        return today, today + timedelta(days=30)
    raise ValueError("no such window")


def country_codes(gazetteer: DataFrame) -> DataFrame:
    """(name, code): each country's code of two capital letters among its other names."""
    each = gazetteer.filter("kind = 'country'").select("name", F.explode("other_names").alias("code")).filter(F.col("code").rlike("^[A-Z]{2}$"))
    return each.groupBy("name").agg(F.min("code").alias("code"))


def between_days(exhibitions: DataFrame, first: date, last: date) -> DataFrame:
    """Shows that overlap a span of days; permanent ones always do."""
    over = (F.col("starts_on").isNull() | (F.col("starts_on") <= F.lit(last))) & (F.col("ends_on").isNull() | (F.col("ends_on") >= F.lit(first)))
    return exhibitions.filter(F.coalesce("permanent", F.lit(False)) | over).select("exhibition_id").distinct()


def soonest_close(exhibitions: DataFrame, today: date) -> DataFrame:
    """Per site, the earliest end of a live show that isn't permanent."""
    live = exhibitions.filter("retired_at IS NULL AND NOT coalesce(permanent, false) AND site IS NOT NULL").filter(F.col("ends_on") >= F.lit(today))
    return live.groupBy("site").agg(F.min("ends_on").cast("string").alias("closes"))


def counts(museums: DataFrame) -> DataFrame:
    """Six numbers of the catalogue in one pass."""
    at = usable(F.col("location.lat"), F.col("location.lon"))
    return museums.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(at).alias("placed"), F.count_if("verified").alias("verified"),
        F.count_if(F.coalesce(filled(F.col("website")), F.lit("")) != "").alias("with_website"),
        F.count_distinct("country").alias("countries"), F.unix_micros(F.max("updated_at")).alias("newest"),
    )


def unplaced(museums: DataFrame, country: str = "", name: str = "") -> DataFrame:
    """Rows without a usable position, most prominent first; empty arguments don't filter."""
    out = museums.filter(~usable(F.col("location.lat"), F.col("location.lon")))
    if country:
        out = out.filter(F.lower("country") == country.lower())
    if name:
        out = out.filter(F.lower("name").contains(name.lower()))
    return out.orderBy(F.desc("sitelinks"), "id").select("id", "name", "sitelinks")


def coverage(museums: DataFrame, site_scrapes: DataFrame, site: Column, lat: float, lon: float, km: float) -> DataFrame:
    """In an area: museums, museums with a site, sites read, last good read."""
    area = within_km(placed(museums), lat, lon, km).select("id", site.alias("site"))
    state = site_scrapes.groupBy("site").agg(F.max("last_success_at").alias("last"))
    joined = area.join(state, "site", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("museums"), F.count("site").alias("with_site"), F.count_distinct(F.when(F.col("last").isNotNull(), F.col("site"))).alias("sites_read"),
        F.unix_micros(F.max("last")).alias("last_read"),
    )


def town_places(museums: DataFrame) -> DataFrame:
    """Each (country, town) as a place: members, centre, and the distance to its farthest member."""
    m = placed(museums).select("country", fold(F.col("locality")).alias("town"), "lat", "lon").filter("town <> '' AND country IS NOT NULL")
    centre = m.groupBy("country", "town").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    far = m.join(centre, ["country", "town"]).withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")))
    return far.groupBy("country", "town").agg(F.first("n").alias("members"), F.first("clat").alias("clat"), F.first("clon").alias("clon"), F.max("d").alias("spread_km"))


def locality_place(museums: DataFrame, query: str, least: float = 0.45) -> DataFrame:
    """The town a query most likely means: a country named in it filters, the town's first word is compared."""
    q = museums.sparkSession.range(1).select(fold(F.lit(query)).alias("q")).first()["q"]
    towns = town_places(museums).withColumn("c", fold(F.col("country")))
    named = towns.select("c").distinct().filter(F.concat(F.lit(f" {q} "), F.lit("")).contains(F.concat(F.lit(" "), "c", F.lit(" ")))).orderBy(F.desc(F.length("c")), "c").limit(1).collect()
    if named:
        q = " ".join(f" {q} ".replace(f" {named[0]['c']} ", " ").split())
        towns = towns.filter(F.col("c") == named[0]["c"])
    sim = similarity(trigrams(F.split("town", " ")[0]), trigrams(F.lit(q.split(" ")[0] if q else "")))
    best = towns.withColumn("score", F.greatest(sim, similarity(trigrams(F.col("town")), trigrams(F.lit(q))))).filter(F.col("score") >= least)
    best = best.orderBy(F.desc("score"), F.desc("members"), "country", "town").limit(1)
    radius = F.greatest(F.lit(2.0), F.least(F.lit(25.0), F.col("spread_km")))
    return best.select("country", "town", "members", F.round("score", 4).alias("score"), F.round("clat", 5).alias("lat"), F.round("clon", 5).alias("lon"), F.round(radius, 3).alias("radius_km"))


def site_targets(museums: DataFrame, site: Column) -> DataFrame:
    """For each site the most prominent placed museum, ties by id."""
    m = placed(museums).withColumn("site", site).filter("site IS NOT NULL")
    top = F.max_by(F.struct("id", "name"), F.struct(F.coalesce("sitelinks", F.lit(0)), -F.col("id")))
    return m.groupBy("site").agg(top.alias("t")).select("site", F.col("t.id").alias("id"), F.col("t.name").alias("name"))
