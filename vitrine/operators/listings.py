"""Listings from pages: candidates among the cards, their runs, admission, and the plan of what to read of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import cards as c
from vitrine.functions.dates import date_range, day_of, open_end
from vitrine.functions.html import is_navigation
from vitrine.functions.rules import link_score, strong_only


def _host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://([^/?#]+)", 1)


def names_shows(url: Column, heading: Column) -> Column:
    """Whether a page says of itself, by its last path part or its heading, that it lists shows."""
    last = F.regexp_extract(c.path_of(url), r"([^/]*)$", 1)
    return c.has_any(last, c.STRONG_PATHS) | c.has_any(F.lower(heading), c.STRONG_PATHS)


def candidates(cards: DataFrame) -> DataFrame:
    """Cards (``page_cards``) that may be shows: page_id, url, heading, pos, href, title, context, times, strong, vouched.

    A link stays if it leads deeper into the same site, its path names entries (or the page vouches for them), its text
    is a title of 4 to 400 letters and tells no other kind of entry, archive, shop or staff page. A text that the page
    repeats is a button: the slug names the entry then. Each link once a page; where some paths name shows outright, the
    vaguer ones go. Repeats are counted in a window over a page's cards, the one group gathered.
    """
    path = c.path_of(F.col("href"))
    sections = c.path_sections(path)
    own = F.when(sections != "", sections).otherwise(F.when(c.has_any(path, c.STRONG_PATHS), path).otherwise(""))
    strong = c.has_any(own, c.STRONG_PATHS)
    named = strong | c.has_any(own, c.WEAK_PATHS)
    vouched = names_shows(F.col("url"), F.col("heading")) & (sections != "")
    said = F.lower(c.clean_title(F.col("text")))
    k = cards.withColumns({"path": path, "strong": strong, "named": named, "cleaned": c.clean_title(F.col("label")), "said": said})
    k = k.withColumn("repeated", (F.count(F.lit(1)).over(Window.partitionBy("page_id", "said")) > 1) & (F.col("said") != ""))
    k = k.withColumn("vouched", ~F.col("named") & vouched)
    keep = (_host(F.col("href")) == _host(F.col("url"))) & (F.col("named") | F.col("vouched"))
    keep = keep & F.length("label").between(4, 400) & ~c.is_other_kind(F.concat_ws(" ", "label", "text")) & ~c.has_any(F.lower("label"), c.SKIP_WORDS)
    keep = keep & ~is_navigation(F.col("href"), F.col("url"))
    button = (F.col("cleaned") == "") | F.lower("cleaned").isin(*c.BUTTONS) | (F.col("repeated") & (F.lower("cleaned") == F.col("said")))
    k = k.filter(keep).withColumn("title", F.when(button, c.title_from_slug(F.col("path"))).otherwise(F.col("cleaned")))
    k = k.filter((F.col("title") != "") & ~F.col("title").rlike(r"^\d+$"))
    first = k.groupBy("page_id", "href").agg(F.min_by(F.struct("url", "heading", "pos", "title", "context", "times", "strong", "vouched"), "pos").alias("k")).select("page_id", "href", "k.*")
    return strong_only(first, "page_id", "strong")


def with_runs(found: DataFrame, today: Column) -> DataFrame:
    """Candidates with ``starts_on``, ``ends_on`` and ``ongoing``: by the markup, else the title, else the text around.

    Two times or more in the markup are a run; an end more than ten years ahead is none.
    """
    t = F.transform("times", lambda x: day_of(x))
    days = F.array_compact(t)
    k = found.withColumns({"days": days, "rt": date_range("title"), "rc": date_range("context")})
    told = lambda r: F.col(f"{r}.start").isNotNull() | F.col(f"{r}.end").isNotNull() | F.col(f"{r}.permanent")
    marked = F.size("days") >= 2
    run = F.when(marked, F.struct(F.array_min("days").alias("start"), F.array_max("days").alias("end"), F.lit(False).alias("permanent"))).when(told("rt"), F.col("rt")).otherwise(F.col("rc"))
    k = k.withColumn("run", run)
    end = F.when(~open_end(F.col("run.end"), today), F.col("run.end"))
    return k.withColumns({"starts_on": F.col("run.start"), "ends_on": end, "ongoing": F.coalesce("run.permanent", F.lit(False)) | open_end(F.col("run.end"), today)}).drop("days", "rt", "rc", "run", "times")


def admitted(found: DataFrame, today: Column) -> DataFrame:
    """Shows among candidates with runs: dated, or permanent by name, or of a page of shows that dates none of them.

    An entry that only its page vouches for needs a run of more than a day, or an ongoing one with a start. What is over goes.
    Adds ``permanent``, ``running`` and ``upcoming``.
    """
    dated = F.col("starts_on").isNotNull() | F.col("ends_on").isNotNull()
    page = Window.partitionBy("page_id")
    k = found.withColumn("any_dated", F.max(dated | F.col("ongoing")).over(page))
    page_permanent = c.has_any(c.path_of(F.col("url")), c.PERMANENT_PATHS) | c.names_permanent(F.col("heading"))
    by_name = c.names_permanent(F.concat_ws(" ", "title", "context")) | c.has_any(c.path_of(F.col("href")), c.PERMANENT_PATHS) | page_permanent
    undated = ~F.col("any_dated") & names_shows(F.col("url"), F.col("heading"))
    k = k.withColumn("permanent", F.col("ongoing") | (~dated & by_name))
    k = k.filter(dated | F.col("permanent") | undated)
    is_run, dated_permanent = F.coalesce(F.col("starts_on") < F.col("ends_on"), F.lit(False)), F.col("ongoing") & F.col("starts_on").isNotNull()
    k = k.filter(~F.col("vouched") | is_run | dated_permanent)
    begun, over = F.coalesce(F.col("starts_on") <= today, F.lit(True)), F.coalesce(F.col("ends_on") < today, F.lit(False))
    always = F.col("permanent") | ~dated
    k = k.withColumns({"running": always | (begun & ~over), "upcoming": ~always & ~begun & ~over})
    return k.filter("running OR upcoming").drop("any_dated", "ongoing", "vouched", "strong")


def merged_titles(shows: DataFrame, owner: str) -> DataFrame:
    """Shows of an owner with one title merged: the earliest place, the widest run; permanent ones keep having none."""
    key = F.lower(F.trim("title"))
    g = shows.withColumn("_t", key).groupBy(owner, "_t").agg(
        F.min_by("title", "pos").alias("title"), F.min_by("href", "pos").alias("href"), F.min("pos").alias("pos"), F.max("permanent").alias("permanent"), F.max("running").alias("running"),
        F.min("starts_on").alias("starts_on"), F.max("ends_on").alias("ends_on"),
    )
    return g.drop("_t").withColumns({"starts_on": F.when(~F.col("permanent"), F.col("starts_on")), "ends_on": F.when(~F.col("permanent"), F.col("ends_on"))})


def in_order(shows: DataFrame) -> DataFrame:
    """Running ones first, then the soonest end, those without an end last, then their place on the page."""
    return shows.orderBy(F.desc("running"), F.asc_nulls_last("ends_on"), "pos")


def declared_first(declared: DataFrame, cards: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that a page declares in its data, then those of its cards that it doesn't."""
    return declared.unionByName(cards.join(declared.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def listing_links(cards: DataFrame, most: int = 3) -> DataFrame:
    """(page_id, rank, href): links of home pages that may lead to the programme, best first, in the page's order."""
    score = link_score(F.col("text"), F.concat(F.lit("/"), c.path_of(F.col("href"))))
    k = cards.filter((_host(F.col("href")) == _host(F.col("url"))) & ~c.names_permanent(F.col("text"))).withColumn("score", score).filter("score > 0")
    return _ranked(k, most)


def permanent_links(cards: DataFrame, most: int = 2) -> DataFrame:
    """(page_id, rank, href): links whose label, of 40 letters at most, or path names a permanent show."""
    hit = (c.names_permanent(F.col("text")) & (F.length("text") <= 40)) | c.has_any(c.path_of(F.col("href")), c.PERMANENT_PATHS)
    k = cards.filter((_host(F.col("href")) == _host(F.col("url"))) & hit & ~c.has_any(F.lower("text"), c.SKIP_WORDS)).withColumn("score", F.lit(0))
    return _ranked(k, most)


def info_links(cards: DataFrame, most: int = 2) -> DataFrame:
    """(page_id, rank, href): links to a museum's description of itself, one step deep at most."""
    path = c.path_of(F.col("href"))
    score = F.when(c.has_any(F.lower("text"), c.INFO_WORDS), 2).otherwise(0) + F.when(c.has_any(F.concat(F.lit("/"), path), c.INFO_PATHS), 1).otherwise(0)
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    k = cards.filter((_host(F.col("href")) == _host(F.col("url"))) & (depth <= 2) & (F.length("text") <= 40)).withColumn("score", score).filter("score > 0")
    return _ranked(k, most)


def _ranked(links: DataFrame, most: int) -> DataFrame:
    once = links.groupBy("page_id", "href").agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("s"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("s.score"), F.desc("s.p")))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select("page_id", "rank", "href")


def conventional_urls(sites: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """(site, rank, href): the usual addresses of a page, for sites whose home links to none."""
    p = F.posexplode(F.array(*(F.lit(x) for x in paths))).alias("rank", "path")
    return sites.select("site", p).select("site", (F.col("rank") + 1).alias("rank"), F.concat(F.lit("https://"), "site", "path").alias("href"))


def site_plan(home_cards: DataFrame) -> DataFrame:
    """(page_id, kind, rank, href): what to read of a site after its home page: programme, permanent shows, description."""
    part = lambda d, kind: d.select("page_id", F.lit(kind).alias("kind"), "rank", "href")
    lists = part(listing_links(home_cards), "listing")
    always = part(permanent_links(home_cards).join(lists.select("page_id", "href"), ["page_id", "href"], "left_anti"), "permanent")
    return lists.unionByName(always).unionByName(part(info_links(home_cards), "info"))


def institution_entries(museums: DataFrame, shows: DataFrame, pages: DataFrame) -> DataFrame:
    """Museums without any show as one permanent entry each, at the page that describes them or else their site.

    ``museums``: id, name, website; ``shows``: id; ``pages``: id, href.
    """
    page = pages.groupBy("id").agg(F.min("href").alias("href"))
    left = museums.filter("website <> ''").join(shows.select("id").distinct(), "id", "left_anti").join(page, "id", "left")
    return left.select("id", F.col("name").alias("title"), F.coalesce("href", "website").alias("href"), F.lit(True).alias("permanent"))
