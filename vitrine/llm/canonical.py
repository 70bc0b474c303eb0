"""Mapping free-entered values to a canonical list: a partition-based pigeonhole join in plain SQL operators.

Each distinct value is reduced to cores: what is left without known decorations (postcodes, wards, "city of",
a trailing country ...). A core that equals a reference string is mapped at once. Others may hold up to k
typing errors: a reference string is cut into k+1 segments, so one segment must stand unharmed in the value,
moved by at most k places. Segments and substrings meet in an equality join, ``levenshtein`` verifies, and an
anti-join reports what met nothing. There is no user code in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.geo import usable
from vitrine.functions.text import fold
from vitrine.session import cut

#: Typing errors allowed; reference strings shorter than MIN_FUZZY match exactly only.
ERRORS, MIN_FUZZY = 2, 4
#: Rows of the segment table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

# Decorations around a place name, as patterns on lower-case text.
LEADING = (
    r"^\d{2,7}\s+",
    r"^\d+\s*(?:st|nd|rd|th|e|er|º|ª|°|\.)?\s*(?:bezirk|arrondissement|ward|district|distrito|quartiere|stadtteil)\s*,\s*",
    r"^(?:the )?(?:municipality|city|town|centre|center|district|province|region|commune) of\s+",
    r"^(?:greater|near|around|in|museums? in|museum near|close to)\s+",
)
TRAILING = (r"\s+(?:municipality|stadt|city|town|district)$", r"\s*\((?:country|district|city|town|region|state)\)$")
# Abbreviated first words of place names.
SHORT_WORDS = (
    (r"^up\.?\s+", "upper "), (r"^lr\.?\s+", "lower "), (r"^st\.?\s+", "saint "), (r"^ste\.?\s+", "sainte "), (r"^b\.\s*(?=\p{L}{3})", "bad "),
    (r"^s\.\s*(?=\p{L}{3})", "san "), (r"^m\.?te\.?\s+", "monte "), (r"^mt\.?\s+", "mount "), (r"^n\.\s+(?=\p{L}{3})", "new "),
)


def _strip(c: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    out = F.regexp_replace(out, r"^\((.*)\)$", "$1")
    for _ in range(2):
        for p in LEADING:
            out = F.regexp_replace(out, p, "")
        for p in TRAILING:
            out = F.regexp_replace(out, p, "")
    return F.trim(out)


def _key(c: Column) -> Column:
    """Folded letters and digits without blanks, abbreviated first words written out."""
    out = F.lower(F.trim(c))
    for p, full in SHORT_WORDS:
        out = F.regexp_replace(out, p, full)
    return F.replace(fold(out), F.lit(" "), F.lit(""))


def references(gazetteer: DataFrame) -> DataFrame:
    """(entry_id, kind, country, lat, lon, key): every spelling of every entry, as a key."""
    names = F.explode(F.array_union(F.array("name"), F.coalesce("other_names", F.array().cast("array<string>")))).alias("n")
    rows = gazetteer.filter("entry_id IS NOT NULL").select("entry_id", "kind", "country", "lat", "lon", names)
    return rows.select("entry_id", "kind", "country", "lat", "lon", _key(F.col("n")).alias("key")).filter("key <> ''").distinct()


def _tables_of(refs: DataFrame):
    """Hint for a table derived from the reference list: broadcast while it is small, shuffled beyond."""
    small = refs.count() * (ERRORS + 1) <= BROADCAST_ROWS
    return F.broadcast if small else (lambda d: d)


def _segments(refs: DataFrame) -> DataFrame:
    """(rkey, len, seg, part): each reference key cut into ERRORS + 1 segments of nearly equal length."""
    k = ERRORS + 1
    keys = refs.select(F.col("key").alias("rkey"), "kind").distinct().withColumn("len", F.length("rkey")).filter(F.col("len") >= MIN_FUZZY)
    start = lambda i: F.floor(F.col("len") * i / k).cast("int")
    each = keys.select("rkey", "kind", "len", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("seg"))
    seg = F.col("seg")
    return each.select("rkey", "kind", "len", "seg", F.col("rkey").substr(start(seg) + 1, start(seg + 1) - start(seg)).alias("part"))


def _probes(keys: DataFrame, longest: int) -> DataFrame:
    """(key, len, seg, part): substrings of each key where a segment of a reference of nearly its length may stand.

    With i segments before it and ERRORS - i errors left after it, a segment can only have moved by at most i
    places, and by at most ERRORS - i places seen from the end: 19 substrings for a key.
    """
    k = ERRORS
    plan = [(delta, i, d) for delta in range(-k, k + 1) for i in range(k + 1) for d in range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1)]
    moves = F.explode(F.array(*(F.struct(F.lit(delta).alias("delta"), F.lit(i).alias("seg"), F.lit(d).alias("d")) for delta, i, d in plan))).alias("m")
    size = F.length("key")
    each = keys.filter((size >= MIN_FUZZY - 1) & (size <= longest + k) & F.col("key").rlike(r"\p{L}")).select("key", moves)
    n = (F.length("key") - F.col("m.delta")).alias("len")
    each = each.select("key", "m.seg", "m.d", n).filter(F.col("len") >= MIN_FUZZY)
    start = lambda i: F.floor(F.col("len") * i / (k + 1)).cast("int")
    seg = F.col("seg")
    cut = each.select("key", "len", "seg", (start(seg) + 1 + F.col("d")).alias("pos"), (start(seg + 1) - start(seg)).alias("n"))
    return cut.filter((F.col("pos") >= 1) & (F.col("pos") + F.col("n") - 1 <= F.length("key"))).select("key", "len", "seg", F.col("key").substr(F.col("pos"), F.col("n")).alias("part"))


def _cost(key: Column, rkey: Column, d: Column) -> Column:
    """Errors of a typing, or null if too many: swapped letters count as one; short names allow one."""
    swapped = (F.length(key) == F.length(rkey)) & (F.array_sort(F.split(key, "")) == F.array_sort(F.split(rkey, "")))
    return F.when((d == 1) | ((d == 2) & (swapped | (F.length(rkey) >= 6))), F.when((d == 2) & ~swapped, 2).otherwise(1))


def map_keys(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """(key, kind, rkey, cost): what each distinct key equals, or else all it is within ERRORS of."""
    hint = _tables_of(refs)
    names = refs.select(F.col("key").alias("rkey"), "kind").distinct()
    longest = names.agg(F.max(F.length("rkey"))).collect()[0][0] or 0
    exact = keys.join(hint(names), keys["key"] == names["rkey"]).select("key", "kind", "rkey", F.lit(0).alias("cost"))
    open_keys = keys.join(hint(names.select(F.col("rkey").alias("key")).distinct()), "key", "left_anti")
    spread = open_keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, "key")
    met = _probes(spread, longest).join(hint(_segments(refs)), ["len", "seg", "part"])
    near = met.select("key", "kind", "rkey", F.levenshtein("key", "rkey", ERRORS).alias("d")).filter("d > 0")
    near = near.select("key", "kind", "rkey", _cost(F.col("key"), F.col("rkey"), F.col("d")).alias("cost")).filter("cost IS NOT NULL").distinct()
    # a letter struck twice in a code too short for the segments
    squeezed = open_keys.filter(F.length("key").between(3, 4)).withColumn("rkey", F.regexp_replace("key", r"(.)\1", "$1")).filter("rkey <> key")
    twice = squeezed.join(hint(names), "rkey").select("key", "kind", "rkey", F.lit(1).alias("cost"))
    return exact.unionByName(near).unionByName(twice).distinct()


_MARK = r"^(.*\S)\s*(?:,|\s[-–—]\s?|\s?[-–—]\s)\s*([^,]+)$"


def map_values(values: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(vid, options array<struct<entry_id, country, lat, lon>>): the entries of least cost for each value.

    ``values``: vid, field, raw. A value is tried whole and without a country after it (behind a comma or dash,
    in any spelling, or as its last words, spelt rightly). Towns come before countries, a town of the
    country named before others.
    """
    refs = cut(references(gazetteer))
    hint = _tables_of(refs)
    base = values.withColumn("s", _strip(F.col("raw"))).filter("s <> ''")
    whole = base.select("vid", "field", _key(F.col("s")).alias("key"), F.lit("").alias("tail"))
    marked = base.filter(F.col("s").rlike(_MARK)).select("vid", "field", F.regexp_extract("s", _MARK, 1).alias("core"), F.regexp_extract("s", _MARK, 2).alias("tail"))
    # a tail that is a country's name has no more words than the longest one has letters
    most = refs.filter("kind = 'country'").agg(F.max(F.length("key"))).collect()[0][0] or 1
    w = base.filter("field <> 'country'").select("vid", "field", F.split("s", " ").alias("w")).filter("size(w) > 1").select("vid", "field", "w", F.explode(F.sequence(F.lit(1), F.least(F.size("w") - 1, F.lit(most)))).alias("i"))
    last = w.select("vid", "field", F.expr("array_join(slice(w, 1, size(w) - i), ' ')").alias("core"), F.expr("array_join(slice(w, size(w) - i + 1, i), ' ')").alias("tail"))
    known = refs.filter("kind = 'country'").select(F.col("key").alias("tail"), F.col("country").alias("tail_country")).distinct()
    tailed = lambda d: d.select("vid", "field", "core", _key(F.col("tail")).alias("tail")).filter("tail <> ''")
    marked = cut(tailed(marked))
    loose = map_keys(marked.select(F.col("tail").alias("key")).distinct(), refs.filter("kind = 'country'"))
    loose = loose.groupBy(F.col("key").alias("tail")).agg(F.min_by("rkey", F.struct("cost", "rkey")).alias("rkey")).join(hint(known.withColumnRenamed("tail", "rkey")), "rkey")
    ended = tailed(last).join(hint(known), "tail").unionByName(marked.join(loose.select("tail", "tail_country"), "tail"))
    ended = ended.select("vid", "field", _key(_strip(F.col("core"))).alias("key"), "tail", "tail_country")
    cores = cut(whole.withColumn("tail_country", F.lit(None).cast("string")).unionByName(ended).filter("key <> ''").distinct())
    mapped = map_keys(cores.select("key").distinct(), refs)
    fits = (F.col("field") == "query") | ((F.col("field") == "country") & (F.col("kind") == "country")) | ((F.col("field") == "locality") & (F.col("kind") == "town"))
    # a country with a country after it is no place of its own
    named = cores.join(mapped, "key").filter(fits & ~((F.col("kind") == "country") & (F.col("tail") != "")))
    full = named.join(hint(refs.withColumnRenamed("key", "rkey")), ["rkey", "kind"])
    off = (F.col("tail") != "") & (F.col("country") != F.col("tail_country"))
    score = F.struct((F.col("cost") + F.when(off, 1).otherwise(0)).alias("a"), F.when(F.col("kind") == "town", 0).otherwise(1).alias("b"), F.length("tail").alias("c"))
    ranked = full.select("vid", score.alias("score"), F.struct("entry_id", "country", "lat", "lon").alias("entry")).distinct()
    best = ranked.groupBy("vid").agg(F.min("score").alias("score"), F.collect_list(F.struct("score", "entry")).alias("all"))
    # a value meets only entries within ERRORS of it, so the list is short
    return best.select("vid", F.expr("transform(filter(all, x -> x.score = score), x -> x.entry)").alias("options"))


def p6_found(museums: DataFrame, places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(field, record_id, entry_id) of every typed value that isn't itself the name of an entry; -1 if none is meant.

    Null and blank values and values that are exactly a name are no cases. A name several entries share is told
    apart by the row's country, then by its position, then by the smaller id.
    """
    none = F.lit(None)
    spot = lambda f: F.when(usable(F.col("location.lat"), F.col("location.lon")), F.col(f"location.{f}")).alias(f)
    rows = (
        museums.select(F.lit("country").alias("field"), F.col("id").alias("record_id"), F.col("country").alias("raw"), none.cast("string").alias("ctx"), spot("lat"), spot("lon"))
        .unionByName(museums.select(F.lit("locality").alias("field"), F.col("id").alias("record_id"), F.col("locality").alias("raw"), F.col("country").alias("ctx"), spot("lat"), spot("lon")))
        .unionByName(places.select(F.lit("query").alias("field"), F.col("place_id").alias("record_id"), F.col("query").alias("raw"), F.element_at(F.split("display_name", ", *"), -1).alias("ctx"), spot("lat"), spot("lon")))
        .filter("record_id IS NOT NULL AND trim(raw) <> ''")
    )
    kinds = gazetteer.select("kind", F.col("name").alias("raw")).filter("raw IS NOT NULL")
    names = F.broadcast(kinds.filter("kind = 'country'").select(F.lit("country").alias("field"), "raw").unionByName(kinds.filter("kind = 'town'").select(F.lit("locality").alias("field"), "raw")).unionByName(kinds.select(F.lit("query").alias("field"), "raw")).distinct())
    rows = rows.join(names, ["field", "raw"], "left_anti")
    distinct = cut(rows.select("field", "raw").distinct().withColumn("vid", F.xxhash64("field", "raw")))
    options = cut(map_values(distinct, gazetteer))
    unmatched = distinct.join(options, "vid", "left_anti").select("field", "raw", F.array().cast("array<struct<entry_id:bigint,country:string,lat:double,lon:double>>").alias("options"))
    mapped = distinct.join(options, "vid").select("field", "raw", "options").unionByName(unmatched)
    got = rows.join(mapped, ["field", "raw"])
    far = lambda o: F.coalesce(F.pow(o.lat - F.col("lat"), 2) + F.pow((o.lon - F.col("lon")) * F.cos(F.radians("lat")), 2), F.lit(1e9))
    pick = F.array_min(F.transform("options", lambda o: F.struct(F.when(o.country == F.col("ctx"), 0).otherwise(1).alias("a"), far(o).alias("b"), o.entry_id.alias("entry_id"))))
    return got.select("field", "record_id", F.coalesce(pick.entry_id, F.lit(-1).cast("bigint")).alias("entry_id")).distinct()
