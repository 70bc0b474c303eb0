"""Reference sources: editions, category prunes, page metadata, class labels, restatement in English, crawl counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.rules import classify
from vitrine.functions.text import filled
from vitrine.sources.readers import point_of, walk

# The root of the museum categories in each edition.
EDITIONS = {
    "en": "Category:Museums by country", "es": "Categoría:Museos por país", "de": "Kategorie:Museum nach Staat", "fr": "Catégorie:Musée par pays", "it": "Categoria:Musei per stato",
    "pt": "Categoria:Museus por país", "nl": "Categorie:Museum naar land", "pl": "Kategoria:Muzea według państw", "sv": "Kategori:Museer efter land", "ru": "Категория:Музеи по странам",
    "ja": "Category:各国の博物館", "zh": "Category:各國博物館", "uk": "Категорія:Музеї за країною", "cs": "Kategorie:Muzea podle zemí", "fi": "Luokka:Museot maittain",
    "da": "Kategori:Museer efter land", "ko": "분류:나라별 박물관", "tr": "Kategori:Ülkelerine göre müzeler",
}
# Words of categories that hold things about museums, and the beginnings of such categories.
ABOUT = (
    "curators", "directors", "founders", "employees", "staff", "people", "biographies", "architects", "collectors", "donors",
    "stubs", "templates", "logos", "images of", "photographs of", "lists of", "list of", "index of", "awards", "wikipedia",
    "navigational boxes", "redirects", "inductees", "inductee", "honorees", "honourees", "balloting",
    "award recipients", "award winners", "hall of fame members", "hall of fame players", "hall of fame horses",
)
ABOUT_STARTS = (
    "collections of", "collection of", "artworks", "paintings", "sculptures", "drawings", "engravings", "manuscripts", "works ", "exhibitions",
    "publications", "acquisitions",
)


def editions(spark: SparkSession) -> DataFrame:
    """(lang, root, source): the editions walked, English first, and what records of each are labelled with."""
    rows = [(lang, root, "wikipedia" if lang == "en" else f"wikipedia-{lang}") for lang, root in EDITIONS.items()]
    return spark.createDataFrame(rows, "lang string, root string, source string")


def skips_category(title: Column) -> Column:
    """Whether a category holds something other than museums and isn't walked."""
    name = F.regexp_replace(F.lower(title), r"^[^:]+:", "")
    return name.rlike("|".join(ABOUT)) | name.rlike("^(" + "|".join(ABOUT_STARTS) + ")")


def walk_categories(edges: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """``walk`` over categories, those that are skipped cut off with all below them."""
    return walk(edges.filter(~skips_category(F.col("child"))), roots, depth)


def nested_lists(entries: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(page, depth) of list pages reached from root lists through entries (page, title, is_list), each once."""
    e = entries.filter("is_list").select(F.col("page").alias("parent"), F.col("title").alias("child"), F.lit(None).cast("string").alias("hint"))
    return walk(e, roots.select(F.col("page").alias("node"), F.lit(None).cast("string").alias("hint")), depth).select(F.col("node").alias("page"), "depth")


def page_metadata(titles: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame, hops: int = 3) -> DataFrame:
    """(requested, title, page_id, description, wikidata_id, is_disambiguation, lat, lon) of requested titles.

    ``normalized`` and ``redirects``: from, to; ``pages``: title, page_id, props map, coordinates array. Chains of redirects
    are followed; a chain that doesn't end within ``hops``, and a title without a page, have no row.
    """
    t = titles.select(F.col("title").alias("requested")).distinct()
    t = t.join(normalized.groupBy(F.col("from").alias("requested")).agg(F.min("to").alias("to")), "requested", "left").select("requested", F.coalesce("to", "requested").alias("title"))
    r = redirects.groupBy(F.col("from").alias("title")).agg(F.min("to").alias("to"))
    for _ in range(hops):
        t = t.join(r, "title", "left").select("requested", F.coalesce("to", "title").alias("title"))
    prop = lambda k: F.element_at("props", k)
    p = pages.select(
        "title", "page_id", filled(prop("wikibase-shortdesc")).alias("description"), filled(prop("wikibase_item")).alias("wikidata_id"), F.coalesce(F.array_contains(F.map_keys("props"), "disambiguation"), F.lit(False)).alias("is_disambiguation"),
        F.get("coordinates", F.lit(0)).lat.alias("lat"), F.get("coordinates", F.lit(0)).lon.alias("lon"),
    )
    return t.join(p, "title")


def country_counts(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(country, label, museums): distinct items of each country, with its label, the id where it has none."""
    n = answers.groupBy("country").agg(F.count_distinct("item").alias("museums"))
    return n.join(labels.groupBy("country").agg(F.min("label").alias("label")), "country", "left").withColumn("label", F.coalesce("label", "country"))


def with_remainder(by_country: DataFrame, everything: DataFrame) -> DataFrame:
    """(item, country): items of the queries country by country, and those that no country's query gave, without one."""
    rest = everything.select("item").distinct().join(by_country.select("item"), "item", "left_anti")
    return by_country.select("item", "country").distinct().unionByName(rest.select("item", F.lit(None).cast("string").alias("country")))


def class_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(item, classes): labels of each item's classes, distinct, in the order first seen; ids without a label are left out.

    ``rows``: item, n, class_id; ``labels``: class_id, label. One pre-aggregated shuffle finds where each class is first.
    """
    first = rows.groupBy("item", "class_id").agg(F.min("n").alias("n")).join(labels.groupBy("class_id").agg(F.min("label").alias("label")), "class_id")
    seen = F.array_sort(F.collect_list(F.struct("n", "class_id", "label")))
    return first.groupBy("item").agg(seen.alias("s")).select("item", F.array_distinct(F.transform("s", lambda x: x.label)).alias("classes"))


def restate(museums: DataFrame, details: DataFrame) -> DataFrame:
    """Museums with what an English description of their external id states: its label becomes the name and the old name
    an alias; country and description are replaced; town and classes fill gaps; prominence is the greater.

    ``details``: wikidata_id, label, country, description, locality, classes, sitelinks; of several rows of an id the greatest counts.
    """
    d = details.filter("wikidata_id <> ''").groupBy("wikidata_id").agg(F.max(F.struct("label", "country", "description", "locality", "classes", "sitelinks")).alias("d"))
    m = museums.join(d, "wikidata_id", "left")
    label = filled(F.col("d.label"))
    renamed = label.isNotNull() & (label != F.col("name"))
    none = F.array().cast("array<string>")
    return m.select(
        "id", "wikidata_id", F.coalesce(label, "name").alias("name"), F.coalesce(filled(F.col("d.country")), "country").alias("country"), F.coalesce(filled(F.col("d.description")), "description").alias("description"),
        F.coalesce(filled(F.col("locality")), "d.locality").alias("locality"), F.when(F.size(F.coalesce("classes", none)) > 0, F.col("classes")).otherwise(F.coalesce("d.classes", none)).alias("classes"),
        F.array_sort(F.array_distinct(F.concat(F.filter(F.coalesce("aliases", none), lambda a: a != F.coalesce(label, F.lit(""))), F.when(renamed & F.col("name").isNotNull(), F.array("name")).otherwise(none)))).alias("aliases"),
        F.greatest("sitelinks", "d.sitelinks").alias("sitelinks"),
    )


def article_venues(pages: DataFrame) -> DataFrame:
    """(title, page_id, wikidata_id, description, lat, lon) of pages (``page_metadata``) told to be venues, once a canonical title.

    Only sure ones; of several pages of a title the smallest page id counts.
    """
    kind = classify(F.col("title"), F.lit(0), F.col("is_disambiguation"), F.col("description"))
    sure = pages.withColumn("kind", kind).filter("kind.decision = 'accept'")
    return sure.groupBy("title").agg(F.min(F.struct("page_id", "wikidata_id", "description", "lat", "lon")).alias("p")).select("title", "p.*")


def crawl_counts(visits: DataFrame) -> DataFrame:
    """(source, visited, emitted, rejected, by_reason) of visits (source, decision, reason)."""
    each = visits.groupBy("source", "decision", "reason").agg(F.count(F.lit(1)).alias("n"))
    sum_of = lambda d: F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("n"))), F.lit(0))
    why = F.array_sort(F.collect_list(F.when(F.col("decision") == "reject", F.concat_ws("=", "reason", F.col("n").cast("string")))))
    return each.groupBy("source").agg(F.sum("n").alias("visited"), sum_of("accept").alias("emitted"), sum_of("reject").alias("rejected"), F.array_join(why, "|").alias("by_reason"))


def geocoder_answer(a: Column) -> Column:
    """struct<lat, lon, website, kind> of a geocoder's answer: texts made numbers, the site among its extra tags, its object letter."""
    tags = F.coalesce(filled(F.element_at(a.extratags, "website")), filled(F.element_at(a.extratags, "contact:website")), filled(F.element_at(a.extratags, "url")))
    kind = F.when(a.osm_type == "node", "N").when(a.osm_type == "way", "W").when(a.osm_type == "relation", "R")
    return F.struct(a.lat.try_cast("double").alias("lat"), a.lon.try_cast("double").alias("lon"), tags.alias("website"), kind.alias("kind"))


def merged_item(parts: DataFrame, key: str = "item") -> DataFrame:
    """(key, values): string maps of one key merged in order ``n``; the last writer of a name wins."""
    each = parts.select(key, "n", F.explode("values").alias("name", "value")).groupBy(key, "name").agg(F.max_by("value", "n").alias("value"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))


def number_of(values: Column, name: str) -> Column:
    """A whole number in a string map, whatever kind of number its text is; null for anything else."""
    text = F.trim(F.element_at(values, name))
    return F.coalesce(text.try_cast("bigint"), F.when(text.try_cast("double") == F.floor(text.try_cast("double")), text.try_cast("double").try_cast("bigint")))


def point_in(values: Column) -> Column:
    """struct<lat, lon> of a string map: latitude and longitude, or a point text; null unless both are numbers."""
    lat, lon = F.element_at(values, "latitude").try_cast("double"), F.element_at(values, "longitude").try_cast("double")
    return F.coalesce(F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))), point_of(F.element_at(values, "coord")))
