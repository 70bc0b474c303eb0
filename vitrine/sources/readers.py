"""Sources: JSON objects under a prefix, tagged map elements, event notifications, graph walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.functions.text import filled
from vitrine.session import cut

NOTIFICATION = "Records array<struct<eventName: string, s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>"


def json_objects(spark: SparkSession, prefix: str, schema: str | StructType) -> DataFrame:
    """Every JSON object below a folder; what can't be read stays as a row with ``_corrupt_record``."""
    text = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(text + ", _corrupt_record string").option("recursiveFileLookup", "true").option("multiLine", "true").json(prefix)


def read_one(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """One JSON object; None if it isn't there, which is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def union_sources(sources: dict[str, DataFrame], wanted: str = "") -> DataFrame:
    """Union of the named sources (all by default) with a ``source`` column; unknown and repeated names are ignored."""
    names = list(dict.fromkeys(n.strip() for n in wanted.split(",") if n.strip() in sources)) or list(sources)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sources[n].withColumn("source", F.lit(n)) for n in names])


def tagged_venues(elements: DataFrame) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags) as venues: name by precedence, centre where a way has no point."""
    t = lambda k: filled(F.element_at("tags", k))
    named = elements.filter(t("tourism").isin("museum", "gallery") | (t("amenity") == "arts_centre") | (t("historic") == "museum"))
    wiki = t("wikipedia")
    return named.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("element"), F.coalesce(t("name:en"), t("int_name"), t("name")).alias("name"),
        F.array_sort(F.map_values(F.map_filter("tags", lambda k, v: k.rlike(r"^(name:|alt_name|old_name|official_name)") & (v != "")))).alias("other_names"),
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), F.coalesce(t("website"), t("contact:website"), t("url")).alias("website"),
        F.when(wiki.startswith("en:"), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(wiki.substr(F.lit(4), F.length(wiki)), F.lit(" "), F.lit("_")))).alias("wikipedia_url"),
        F.coalesce(wiki.startswith("en:"), F.lit(False)).alias("verified"),
    ).filter("name IS NOT NULL")


def point_of(wkt: Column) -> Column:
    """struct<lat, lon> of ``Point(lon lat)``; null for anything else."""
    p = r"(?i)^\s*point\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)\s*$"
    return F.when(wkt.rlike(p), F.struct(F.regexp_extract(wkt, p, 2).cast("double").alias("lat"), F.regexp_extract(wkt, p, 1).cast("double").alias("lon")))


def fold_bindings(rows: DataFrame) -> DataFrame:
    """Query answers (item, n, b map) folded to one record an item: first filled value in order, distinct aliases."""
    v = lambda k: filled(F.element_at("b", k))
    first = lambda k: F.min_by(v(k), F.when(v(k).isNotNull(), F.col("n")))
    return rows.groupBy("item").agg(*(first(k).alias(k) for k in ("itemLabel", "desc", "coord", "website", "article", "localityLabel", "countryLabel", "sitelinks")), F.array_sort(F.collect_set(v("alt"))).alias("aliases"))


def notified_keys(messages: DataFrame, column: str = "value") -> DataFrame:
    """(bucket, key) of every record in notification messages; messages that aren't JSON yield nothing."""
    r = messages.select(F.explode(F.from_json(F.col(column).cast("string"), NOTIFICATION).Records).alias("r"))
    return r.select(F.col("r.s3.bucket.name").alias("bucket"), F.try_url_decode(F.replace(F.col("r.s3.object.key"), F.lit("+"), F.lit("%20"))).alias("key"))


def walk(edges: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """(node, depth, hint) reached from roots (node, hint) along edges (parent, child, hint).

    Each node once, at its least depth; a hint is inherited from the nearest ancestor that has one. One join a level,
    the frontier alone moves; levels are cut in the shared folder.
    """
    seen = cut(roots.select("node", F.lit(0).alias("depth"), "hint"))
    front = seen
    for level in range(1, depth + 1):
        step = front.select(F.col("node").alias("parent"), F.col("hint").alias("above")).join(edges, "parent")
        step = step.groupBy(F.col("child").alias("node")).agg(F.min(F.coalesce("hint", "above")).alias("hint"))
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "hint"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
