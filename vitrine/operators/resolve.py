"""Identity, upsert, merges of duplicate rows, and placement at town centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.geo import columns_around, haversine_km, reach_in_degrees, usable
from vitrine.functions.text import compact_key, filled, fold, identity, known_country
from vitrine.session import cut


def newest_filled(c: Column, order: str = "ord") -> Column:
    """The last value in order that isn't null or empty."""
    return F.max_by(c, F.when(c.isNotNull() & (c != ""), F.col(order)))


def union_of(c: Column) -> Column:
    """Sorted union of string lists, empties dropped."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))))


def as_catalogue(source_records: DataFrame) -> DataFrame:
    """Raw records in the shape of catalogue rows; the normal form of a name is its folded form."""
    return source_records.select(
        F.col("record_id").alias("id"), "wikidata_id", "name", fold(F.col("name")).alias("normalized"), known_country(F.col("country")).alias("country"), "locality",
        F.lit(None).cast("string").alias("description"), "website", F.col("other_names").alias("aliases"), F.array("source").alias("sources"),
        F.array().cast("array<string>").alias("classes"), F.lit(False).alias("verified"), "location", F.lit(0).alias("sitelinks"),
        F.element_at("tags", "addr:street").alias("street"), F.element_at("tags", "addr:postcode").alias("postcode"), F.lit(None).cast("string").alias("wikipedia_url"),
        F.lit(None).cast("string").alias("source_page"), F.lit(None).cast("int").alias("page_id"), F.col("fetched_at").alias("updated_at"),
    )


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per identity; each column follows its own policy.

    Incoming rows come after existing ones, in order of id. Names are replaced, other texts only by filled ones, page ids
    only by real ones, lists united, flags or-ed, prominence and time are the greatest; ``search_text`` is what the row
    answers to then. One shuffle on the identity, pre-aggregated.
    """
    texts = ["wikidata_id", "country", "locality", "description", "website", "street", "postcode", "wikipedia_url", "source_page"]
    optional = [*texts[5:], "page_id", "updated_at"]
    columns = [*optional, "id", "wikidata_id", "name", "normalized", "country", "locality", "description", "website", "aliases", "sources", "classes", "verified", "location", "sitelinks"]
    kinds = {"page_id": "int", "updated_at": "timestamp"}
    # the columns from street on may be absent on either side
    part = lambda d, side: d.select(*(F.col(c) if c in d.columns or c not in optional else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns), F.lit(side).alias("side"))
    both = part(existing, 0).unionByName(part(incoming, 1))
    both = both.withColumn("country", known_country(F.col("country"))).withColumn("identity", identity(F.col("wikidata_id"), F.col("normalized"), F.col("country"))).withColumn("ord", F.struct("side", "id"))
    spot = usable(F.col("location.lat"), F.col("location.lon"))
    out = both.filter("identity IS NOT NULL").groupBy("identity").agg(
        F.max_by("name", "ord").alias("name"), F.max_by("normalized", "ord").alias("normalized"),
        *(newest_filled(F.col(c)).alias(c) for c in texts), F.max_by("page_id", F.when(F.col("page_id") > 0, F.col("ord"))).alias("page_id"), F.max("updated_at").alias("updated_at"),
        F.max_by(F.col("location"), F.when(spot, F.col("ord"))).alias("location"),
        *(union_of(F.col(c)).alias(c) for c in ("aliases", "sources", "classes")),
        F.bool_or(F.coalesce("verified", F.lit(False))).alias("verified"), F.max("sitelinks").alias("sitelinks"),
    )
    return out.withColumn("search_text", fold(F.concat_ws(" ", "name", F.array_join("aliases", " "), "locality")))


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows: a rejected one lacks a name, or has negative prominence or an impossible position."""
    bad = F.coalesce(F.trim("name") == "", F.lit(True)) | F.coalesce(F.col("sitelinks") < 0, F.lit(False)) | F.coalesce(F.abs("location.lat") > 90, F.lit(False)) | F.coalesce(F.abs("location.lon") > 180, F.lit(False))
    return rows.filter(~bad), rows.filter(bad)


def promote_ids(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, wikidata_id): rows known by name only that adopt the id of an incoming namesake of their country.

    An id that some row holds already is not adopted; of several rows or ids for a name the smallest one counts.
    """
    new = incoming.filter("wikidata_id <> '' AND normalized <> ''").groupBy("normalized", "country").agg(F.min("wikidata_id").alias("wikidata_id"))
    own = existing.filter("coalesce(wikidata_id, '') = '' AND normalized <> ''").groupBy("normalized", "country").agg(F.min("id").alias("id"))
    taken = existing.filter("wikidata_id <> ''").select("wikidata_id").distinct()
    return own.join(new, ["normalized", "country"]).join(taken, "wikidata_id", "left_anti").select("id", "wikidata_id")


def same_name_merges(museums: DataFrame) -> DataFrame:
    """(victim, keeper): rows without an id that share name and country with rows that have one; the smallest such id keeps."""
    named = museums.select("id", filled(F.col("wikidata_id")).alias("wid"), "normalized", "country").filter("normalized <> ''")
    keep = named.filter("wid IS NOT NULL").groupBy("normalized", "country").agg(F.min("id").alias("keeper"))
    return named.filter("wid IS NULL").join(keep, ["normalized", "country"]).select(F.col("id").alias("victim"), "keeper")


def _no_chains(pairs: DataFrame) -> DataFrame:
    """One keeper per victim, and no keeper that is a victim itself."""
    best = cut(pairs.groupBy("victim").agg(F.min("keeper").alias("keeper")))
    return best.join(best.select(F.col("victim").alias("keeper")).distinct(), "keeper", "left_anti").select("victim", "keeper")


def alias_merges(museums: DataFrame) -> DataFrame:
    """(victim, keeper): a row whose name is an alias of exactly one row of its country.

    Not if both have an id, and only within 1 km or where a position is missing. Aliases are exploded and met by
    equality; how many rows answer to a name is counted before the join.
    """
    m = museums.select("id", filled(F.col("wikidata_id")).alias("wid"), "normalized", "country", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), fold).alias("al"), "location.lat", "location.lon")
    m = m.filter("country IS NOT NULL")
    answers = m.select("id", "country", F.explode("al").alias("called")).filter("called <> ''").distinct()
    alone = answers.groupBy("country", "called").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper")).filter("n = 1")
    keepers = m.select(F.col("id").alias("keeper"), F.col("wid").alias("kwid"), F.col("lat").alias("klat"), F.col("lon").alias("klon"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("klat"), F.col("klon"))
    placed = usable(F.col("lat"), F.col("lon")) & usable(F.col("klat"), F.col("klon"))
    met = m.withColumnRenamed("normalized", "called").join(alone, ["country", "called"]).join(keepers, "keeper")
    met = met.filter((F.col("id") != F.col("keeper")) & (F.col("wid").isNull() | F.col("kwid").isNull()) & (~placed | (km <= 1.0)))
    return _no_chains(met.select(F.col("id").alias("victim"), "keeper"))


def name_variant_merges(museums: DataFrame) -> DataFrame:
    """(victim, keeper): rows with the same two or more long words at most 150 m apart; the better known one keeps.

    Positions are cut into cells of 0.002 degrees of latitude and 0.01 of longitude; a row looks into the cells that 150 m reach.
    """
    long_words = F.array_sort(F.filter(F.split("normalized", " "), lambda w: F.length(w) > 2))
    m = museums.select("id", "country", "sitelinks", "location.lat", "location.lon", long_words.alias("w")).filter(usable(F.col("lat"), F.col("lon")) & (F.size("w") >= 2))
    m = m.select("id", F.coalesce("sitelinks", F.lit(0)).alias("s"), "lat", "lon", F.array_join("w", " ").alias("w"), F.floor(F.col("lat") / 0.002).alias("band"))
    a = m.select(F.col("id").alias("ia"), F.col("s").alias("sa"), F.col("lat").alias("la"), F.col("lon").alias("oa"), "w", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    a = a.withColumn("x", F.explode(columns_around(F.col("oa"), reach_in_degrees(F.col("la"), 0.15), 0.01)))
    b = m.select(F.col("id").alias("ib"), F.col("s").alias("sb"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), "w", "band", F.floor((F.col("lon") + 180.0) / 0.01).alias("x"))
    first = F.struct(F.col("sa").alias("s"), (-F.col("ia")).alias("i")) > F.struct(F.col("sb").alias("s"), (-F.col("ib")).alias("i"))
    near = haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")) <= 0.15
    return _no_chains(a.join(b, ["w", "band", "x"]).filter(first & near).select(F.col("ib").alias("victim"), F.col("ia").alias("keeper")))


def exhibition_merges(exhibitions: DataFrame) -> DataFrame:
    """Repeated listings: the earliest URL of a (museum, title), with the whole span; permanent shows are left alone."""
    e = exhibitions.filter("NOT coalesce(permanent, false) AND museum IS NOT NULL AND trim(title) <> ''").select("url", F.lower(F.trim("title")).alias("title"), "museum", "starts_on", "ends_on").distinct()
    return e.groupBy("museum", "title").agg(
        F.count_distinct("url").alias("listings"), F.min_by("url", F.struct(F.coalesce("starts_on", F.lit("0001-01-01").cast("date")), "url")).alias("url"),
        F.min("starts_on").cast("string").alias("starts_on"), F.max("ends_on").cast("string").alias("ends_on"),
    ).filter("listings > 1")


def town_placements(museums: DataFrame, spread_km: float = 50.0) -> DataFrame:
    """(id, lat, lon, tier): unplaced rows set at the centre of their town's placed rows.

    Tier 1 takes the whole town name; tier 2, for what is left, its first word of four letters or more. A town whose
    members lie farther than ``spread_km`` from its centre places nobody. Approximate positions don't count as placed.
    """
    at = usable(F.col("location.lat"), F.col("location.lon")) & ~F.coalesce("location_approximate", F.lit(False))
    m = museums.select("id", "country", fold(F.col("locality")).alias("town"), F.when(at, F.col("location.lat")).alias("lat"), F.when(at, F.col("location.lon")).alias("lon")).filter("country IS NOT NULL AND town <> ''")
    m = m.withColumn("head", F.split("town", " ")[0])
    placed, left = m.filter("lat IS NOT NULL"), m.filter("lat IS NULL")

    def centres(key: str) -> DataFrame:
        c = placed.groupBy("country", key).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
        d = placed.join(c, ["country", key]).groupBy("country", key, "clat", "clon").agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).alias("far"))
        return d.filter(F.col("far") <= spread_km).select("country", key, "clat", "clon")

    one = left.join(centres("town"), ["country", "town"]).select("id", F.col("clat").alias("lat"), F.col("clon").alias("lon"), F.lit(1).alias("tier"))
    rest = left.filter(F.length("head") >= 4).join(one.select("id"), "id", "left_anti")
    two = rest.join(centres("head"), ["country", "head"]).select("id", F.col("clat").alias("lat"), F.col("clon").alias("lon"), F.lit(2).alias("tier"))
    return one.unionByName(two)


def repaired_positions(museums: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, lat, lon, tier) for rows without a usable position: the geocode cache's answer for their town, else the centre
    of the town's placed rows (``town_placements``); all approximate. Each town is looked up once, whatever its rows.

    ``cache``: query, found, lat, lon.
    """
    at = usable(F.col("location.lat"), F.col("location.lon"))
    left = museums.filter(~at).select("id", F.lower(F.trim("locality")).alias("query")).filter("query <> ''")
    known = cache.filter("found").filter(usable(F.col("lat"), F.col("lon"))).groupBy(F.lower(F.trim("query")).alias("query")).agg(F.min(F.struct("lat", "lon")).alias("a"))
    one = left.join(known, "query").select("id", "a.lat", "a.lon", F.lit(0).alias("tier"))
    rest = town_placements(museums).join(museums.filter(~at).select("id"), "id", "left_semi").join(one.select("id"), "id", "left_anti")
    return one.unionByName(rest.select("id", "lat", "lon", "tier"))


def load_catalogue(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, rejected): valid rows upserted, then merged by name, by alias and by words until nothing merges.

    Ids are the smallest of an identity; rejected rows are returned as they came.
    """
    good, bad = quarantine(incoming)
    ids = existing.select(identity(F.col("wikidata_id"), F.col("normalized"), known_country(F.col("country"))).alias("identity"), "id").unionByName(good.select(identity(F.col("wikidata_id"), F.col("normalized"), known_country(F.col("country"))).alias("identity"), "id"))
    rows = upsert(existing, good).join(ids.groupBy("identity").agg(F.min("id").alias("id")), "identity")
    rows = cut(rows)
    for merges in (same_name_merges, alias_merges, name_variant_merges):
        rows = settled(rows, merges)
    return rows, bad


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): connected components of edges (a, b); the label is the smallest node.

    Large-star and small-star rounds until nothing changes; each round cuts the lineage in the shared folder. Raises
    if ``rounds`` don't suffice (they grow with the logarithm of the longest path).
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(small)
        mark = tuple(e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("the components haven't settled")
    label = e.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.join(label, nodes["node"] == label["u"], "left").select("node", F.coalesce("label", "node").alias("label"))


def name_keys(rows: DataFrame) -> DataFrame:
    """(id, key): every name and alias of a row as a compact key in its country; none where the country is unknown."""
    names = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")
    named = rows.select("id", known_country(F.col("country")).alias("country"), names).filter("id IS NOT NULL AND country IS NOT NULL")
    keyed = named.select("id", compact_key(F.col("name")).alias("key"), compact_key(F.col("country")).alias("country")).filter("key <> ''")
    return keyed.select("id", F.concat_ws("|", "key", "country").alias("key")).distinct()


def entities(rows: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, label): rows of one entity have one label, the smallest id among them.

    Rows of one external id are one entity. A name key that one entity answers to recognises rows without an id; a
    key that two entities answer to recognises none. A row that joins brings its keys, so the rounds go on until
    nothing joins; a row whose keys speak for two entities stays alone. So no two ids ever meet, in whatever order the
    rows come. Rows that no entity claims join one another at the keys that none of them answers to.
    """
    keys = cut(name_keys(rows))
    ids = rows.filter("id IS NOT NULL").groupBy("id").agg(F.max(filled(F.col("wikidata_id"))).alias("wid"))
    known = cut(ids.filter("wid IS NOT NULL").select("id", F.col("wid").alias("entity")))

    def claims(labels: DataFrame) -> DataFrame:
        return keys.join(labels, "id").groupBy("key").agg(F.min("entity").alias("one"), F.max("entity").alias("other"))

    for _ in range(rounds):
        sole = claims(known).filter("one = other").select("key", F.col("one").alias("entity"))
        open_ = keys.join(known.select("id"), "id", "left_anti").join(sole, "key")
        new = cut(open_.groupBy("id").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).filter("entity = other").select("id", "entity"))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
    else:
        raise RuntimeError("the entities haven't settled")
    rest = keys.join(known.select("id"), "id", "left_anti").join(claims(known).select("key"), "key", "left_anti")
    hub = rest.groupBy("key").agg(F.min("id").alias("hub"))
    alone = components(rest.join(hub, "key").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    named = ids.select("id").join(known, "id", "left").join(alone.withColumnRenamed("node", "id"), "id", "left")
    own = named.select("id", F.coalesce(F.concat(F.lit("w"), "entity"), F.concat(F.lit("c"), F.coalesce("label", "id").cast("string"))).alias("entity"))
    first = own.groupBy("entity").agg(F.min("id").alias("label"))
    return own.join(first, "entity").select(F.col("id").alias("node"), "label")


def merged_entities(rows: DataFrame, authority: str = "wikidata") -> DataFrame:
    """One row for each entity, under its smallest id: the first filled text in order of id, the country of the authority
    before that of others, the first usable position, the greatest prominence, lists united, and every name that isn't
    the kept one an alias. Rows of a hot entity are folded before they move.
    """
    m = rows.join(entities(rows).withColumnRenamed("node", "id"), "id")
    filled_first = lambda c, order="id": F.min_by(c, F.when(c.isNotNull() & (c != ""), F.col(order) if isinstance(order, str) else order))
    ranked = F.struct((~F.coalesce(F.array_contains("sources", authority), F.lit(False))).alias("other"), "id")
    called = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    out = m.groupBy("label").agg(
        *(filled_first(F.col(c)).alias(c) for c in ("wikidata_id", "name", "locality", "description", "website")), filled_first(known_country(F.col("country")), ranked).alias("country"),
        F.min_by("location", F.when(usable(F.col("location.lat"), F.col("location.lon")), F.col("id"))).alias("location"), union_of(called).alias("called"), union_of(F.col("sources")).alias("sources"), union_of(F.col("classes")).alias("classes"),
        F.max("sitelinks").alias("sitelinks"), F.bool_or(F.coalesce("verified", F.lit(False))).alias("verified"),
    )
    return out.withColumn("aliases", F.filter("called", lambda x: F.col("name").isNull() | (x != F.col("name")))).withColumnRenamed("label", "id").drop("called")


def settled(rows: DataFrame, merges, rounds: int = 5) -> DataFrame:
    """Rows after merging again and again until ``merges`` (rows to victim and keeper pairs) finds none; raises if it doesn't end."""
    for _ in range(rounds):
        pairs = cut(merges(rows))
        if pairs.isEmpty():
            return rows
        folded = apply_merges(rows, pairs)
        rest = [c for c in rows.columns if c not in folded.columns]
        rows = cut(folded.join(rows.select("id", *rest), "id").select(*rows.columns))
    raise RuntimeError("the merges haven't settled")


def apply_merges(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows with victims folded into keepers by the upsert policy; every victim's facts are kept."""
    keyed = rows.join(pairs.select(F.col("victim").alias("id"), "keeper"), "id", "left").withColumn("to", F.coalesce("keeper", "id")).withColumn("ord", F.struct((F.col("to") == F.col("id")).alias("own"), (-F.col("id")).alias("i")))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("to") != F.col("id"), F.array("name")).otherwise(F.array().cast("array<string>")))))))
    return keyed.groupBy(F.col("to").alias("id")).agg(
        F.max_by("name", "ord").alias("name"), *(newest_filled(F.col(c)).alias(c) for c in ("wikidata_id", "country", "locality", "description", "website")),
        names.alias("aliases"), union_of(F.col("sources")).alias("sources"), F.bool_or(F.coalesce("verified", F.lit(False))).alias("verified"), F.max("sitelinks").alias("sitelinks"),
    )


def fold_enriched(raw: DataFrame, enriched: DataFrame, key: str, gaps: list[str]) -> DataFrame:
    """Raw rows replaced wholesale by enriched ones of the same key; only the named gaps of these are filled from raw."""
    r, e = raw.alias("r"), enriched.alias("e")
    both = r.join(e, F.col(f"r.{key}") == F.col(f"e.{key}"), "full_outer")
    there = F.col(f"e.{key}").isNotNull()
    out = []
    for c in raw.columns:
        new = F.coalesce(filled(F.col(f"e.{c}")), F.col(f"r.{c}")) if c in gaps else F.col(f"e.{c}")
        out.append(F.when(there, new).otherwise(F.col(f"r.{c}")).alias(c))
    return both.select(*out)
