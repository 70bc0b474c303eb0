"""Best representative of each duplicate group, built field by field.

Every field has a rule: which values qualify and how they rank. One aggregation takes, for each field, the
maximum of a struct (rank ..., value, member); nothing is sorted, no group is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.geo import usable

# Texts that stand for no description.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "todo", "tbd", "tba", "unknown", "no description", "description", "placeholder", "not available", "coming soon", "test")


@dataclass(frozen=True)
class Rule:
    """``qualifies`` and ``rank`` (best is greatest) of a field's value; ``alone``: an equal best means no survivor."""

    field: str
    value: Column
    qualifies: Column
    rank: tuple[Column, ...]
    alone: bool = False


def catalogue_rules() -> list[Rule]:
    c = F.col
    rest = F.regexp_extract("website", r"(?s)^https?://(.*)$", 1)
    text = F.lower(F.trim("description"))
    spot = F.coalesce(usable(c("location.lat"), c("location.lon")), F.lit(False))
    kinds = F.size(F.array_distinct(F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))))
    return [
        Rule("website", c("website"), rest.contains("."), (c("updated_at"),)),
        Rule("description", c("description"), text.rlike(r"[\p{L}\p{Nd}]") & ~text.isin(*PLACEHOLDERS), (F.length("description"),), alone=True),
        Rule("location", c("location"), spot, (~F.coalesce("location_approximate", F.lit(False)), c("updated_at"))),
        Rule("sources", c("sources"), F.lit(True), (kinds,), alone=True),
    ]


def survivors(members: DataFrame, group: str, key: str, rules: list[Rule]) -> DataFrame:
    """(group, <field> struct<value, member>, ...): the surviving value of each field and the member it is from.

    Ties fall to the smallest key, or leave no survivor where the rule says so. A member listed twice counts
    once. A field without a qualifying value is null; null ranks lose against any other.
    """
    aggs = []
    for r in rules:
        best = F.when(r.qualifies, F.struct(*(x.alias(f"r{i}") for i, x in enumerate(r.rank)), (-F.col(key)).alias("low"), r.value.alias("value"), F.col(key).alias("member")))
        aggs.append(F.max(best).alias(r.field))
        if r.alone:
            other = F.when(r.qualifies, F.struct(*(x.alias(f"r{i}") for i, x in enumerate(r.rank)), F.col(key).alias("member")))
            aggs.append(F.max(other).alias(f"{r.field}_other"))
    got = members.groupBy(group).agg(*aggs)
    out = []
    for r in rules:
        v = F.struct(F.col(f"{r.field}.value").alias("value"), F.col(f"{r.field}.member").alias("member"))
        ok = F.col(r.field).isNotNull()
        if r.alone:
            ok = ok & (F.col(f"{r.field}.member") == F.col(f"{r.field}_other.member"))
        out.append(F.when(ok, v).alias(r.field))
    return got.select(group, *out)


def group_members(merge_groups: DataFrame, museums: DataFrame) -> DataFrame:
    """The rows of each group with the columns the rules read; members the catalogue lacks are left out."""
    need = museums.select("id", "website", "description", "location", "location_approximate", "sources", "updated_at")
    return merge_groups.select("group_id", "museum_id").join(need, F.col("museum_id") == F.col("id")).drop("id")


def p7_rows(merge_groups: DataFrame, museums: DataFrame) -> DataFrame:
    """One built row for each group."""
    s = survivors(group_members(merge_groups, museums), "group_id", "museum_id", catalogue_rules())
    return s.select(
        "group_id", F.col("website.value").alias("website"), F.col("description.value").alias("description"),
        F.col("location.value.lat").alias("lat"), F.col("location.value.lon").alias("lon"), F.array_join("sources.value", "|").alias("sources"),
    )


def p7_found(merge_groups: DataFrame, museums: DataFrame) -> DataFrame:
    """(group_id, field, museum_id): the member each field's surviving value is from."""
    rules = catalogue_rules()
    s = survivors(group_members(merge_groups, museums), "group_id", "museum_id", rules)
    each = F.explode(F.array(*(F.struct(F.lit(r.field).alias("field"), F.col(f"{r.field}.member").alias("museum_id")) for r in rules))).alias("x")
    return s.select("group_id", each).select("group_id", "x.field", "x.museum_id").filter("museum_id IS NOT NULL")
