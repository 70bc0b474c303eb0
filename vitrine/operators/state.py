"""Writes to listings, places, site states and areas, each as one keyed aggregation or join."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.geo import cell_label
from vitrine.functions.text import filled, site_host


def upsert_exhibitions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Listings by URL: texts and dates of the newest reading, the first sight only moves back, the last only forward.

    A listing that is read again is live again. The policy is commutative in the sights, so late rows don't matter.
    """
    columns = ["url", "title", "museum", "starts_on", "ends_on", "permanent", "site", "source_page", "scraped_at", "first_seen_at", "last_seen_at", "retired_at"]
    both = existing.select(*columns, F.lit(0).alias("side")).unionByName(incoming.select(*columns, F.lit(1).alias("side"))).filter("url <> ''")
    order = F.struct("side", "scraped_at", "title")
    return both.groupBy("url").agg(
        F.max_by("title", order).alias("title"), F.max_by("museum", order).alias("museum"), F.max_by("starts_on", order).alias("starts_on"), F.max_by("ends_on", order).alias("ends_on"),
        F.max_by(F.coalesce("site", site_host(F.coalesce(filled(F.col("source_page")), F.col("url")))), order).alias("site"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.max_by(F.when(F.col("side") == 1, F.lit(None)).otherwise(F.col("retired_at")), order).alias("retired_at"),
    )


def save_places(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The geocode cache by query: the newest answer, found or not."""
    both = cache.unionByName(answers).filter("query IS NOT NULL")
    best = F.max_by(F.struct("display_name", "location", "radius_km", "found", "resolved_at"), F.struct("resolved_at", "place_id"))
    return both.groupBy(F.lower(F.trim("query")).alias("query")).agg(best.alias("s")).select("query", "s.*")


def look_up(cache: DataFrame, query: str, now: datetime, days: int = 30) -> DataFrame:
    """A cached answer no older than ``days``."""
    return cache.filter((F.col("query") == query.strip().lower()) & (F.col("resolved_at") > F.lit(now) - F.make_dt_interval(F.lit(days))))


def scrape_states(attempts: DataFrame) -> DataFrame:
    """State of each site after all attempts: good reads and changes move forward, validators survive failures."""
    ok = F.col("consecutive_failures") == 0
    order = F.struct("last_attempt_at", "loaded_at")
    kept = lambda c: F.max_by(c, F.when(ok & F.col(c).isNotNull() & (F.col(c) != ""), order)).alias(c)
    return attempts.filter("site IS NOT NULL").groupBy("site").agg(
        F.max("last_attempt_at").alias("last_attempt_at"), F.max("last_success_at").alias("last_success_at"), F.max("last_change_at").alias("last_change_at"), kept("etag"), kept("listing_url"), kept("fingerprint"),
    )


def touch(exhibitions: DataFrame, sites: DataFrame, seen_at: Column) -> DataFrame:
    """Live listings of sites that answered "not modified" are seen again."""
    hit = sites.select("site").distinct().withColumn("_hit", F.lit(True))
    seen = F.when(F.col("_hit") & F.col("retired_at").isNull(), F.greatest("last_seen_at", seen_at)).otherwise(F.col("last_seen_at"))
    return exhibitions.join(hit, "site", "left").withColumn("last_seen_at", seen).drop("_hit")


def set_locations(museums: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the positions found for their ids (id, location, location_approximate); others as they are."""
    f = found.select("id", F.col("location").alias("_l"), F.col("location_approximate").alias("_a"))
    return museums.join(f, "id", "left").withColumns({"location": F.coalesce("_l", "location"), "location_approximate": F.coalesce("_a", "location_approximate")}).drop("_l", "_a")


def mark_areas(read: DataFrame, cells: DataFrame, now: datetime, keep_hours: int = 24) -> DataFrame:
    """(cell, scraped_at) after reading ``cells`` at ``now``: each at its newest reading, those that no longer cool off dropped."""
    both = read.select("cell", "scraped_at").unionByName(cells.select("cell", F.lit(now).alias("scraped_at")))
    newest = both.groupBy("cell").agg(F.max("scraped_at").alias("scraped_at"))
    return newest.filter(F.col("scraped_at") >= F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(keep_hours)))


def area_queue(requests: DataFrame, cooling: DataFrame, targets: DataFrame, now: datetime, hours: int = 24, per_area: int = 120) -> DataFrame:
    """Sites to read for requested points, areas in turn: (turn, cell, site).

    A request is its grid cell; a cell read within ``hours`` waits. Each cell brings at most ``per_area`` sites by
    prominence (the feature's own limit), and cells take turns site by site.
    """
    cells = requests.filter("lat IS NOT NULL AND lon IS NOT NULL").select(cell_label(F.col("lat"), F.col("lon")).alias("cell")).distinct()
    recent = cooling.filter(F.col("scraped_at") > F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(hours))).select("cell")
    open_cells = cells.join(recent, "cell", "left_anti")
    t = targets.select("site", "sitelinks", cell_label(F.col("lat"), F.col("lon")).alias("cell"))
    ranked = t.join(open_cells, "cell").withColumn("turn", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("sitelinks"), "site")))
    return ranked.filter(F.col("turn") <= per_area).select("turn", "cell", "site")
