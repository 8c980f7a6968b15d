"""Entity registry: alias lookup and upsert of new spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X


def alias_table(entities: DataFrame) -> DataFrame:
    """(alias_key, entity_id): an entity answers to its id, its name and its aliases; the smallest id wins."""
    keys = F.explode(F.array_distinct(F.concat(F.array(X.alias_key(F.col("entity_id")), X.alias_key(F.col("name"))), F.transform("aliases", lambda a: X.alias_key(a)))))
    return entities.select("entity_id", keys.alias("alias_key")).groupBy("alias_key").agg(F.min("entity_id").alias("entity_id"))


def resolve(mentions: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """Left join of mentions on their alias key. Spark broadcasts the alias table only if its measured size allows."""
    return mentions.withColumn("alias_key", X.alias_key(F.col(column))).join(aliases, "alias_key", "left")


def upsert(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Registry after a batch of (name, seen_at) mentions.

    A mention goes to the entity known by its alias, else by its slug, else a new entity named after the
    spelling seen first. Distinct spellings are folded before any grouping, so a name said a billion times
    is one row.
    """
    spelled = mentions.select(F.trim("name").alias("name"), "seen_at").groupBy("name").agg(F.min("seen_at").alias("seen_at")).filter("name <> ''")
    spelled = resolve(spelled, alias_table(entities)).withColumn("slug", X.slugify(F.col("name")))
    known = entities.select(F.col("entity_id").alias("slug"), F.col("entity_id").alias("by_slug"))
    placed = spelled.join(known, "slug", "left").withColumn("target", F.coalesce("entity_id", "by_slug", "slug"))
    fresh = placed.groupBy(F.col("target").alias("entity_id")).agg(
        F.min_by("name", F.struct("seen_at", "name")).alias("first_name"), F.collect_set(F.struct("alias_key", "name")).alias("seen")
    )
    merged = entities.join(fresh, "entity_id", "full_outer")
    name = F.coalesce("name", "first_name")
    own = F.array_compact(F.concat(F.array(X.alias_key(name)), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: X.alias_key(a))))
    added = F.filter(F.array_distinct(F.transform(F.coalesce("seen", F.array()), lambda s: s["alias_key"])), lambda k: ~F.array_contains(own, k))
    return merged.select(
        "entity_id", name.alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.sort_array(added).alias("added_aliases"),
        F.col("name").isNull().alias("is_new"),
    )
