"""Filters, validation and set operations over the note table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.operators.skew import global_position


def by_status(notes: DataFrame, status: str | None = "active") -> DataFrame:
    return notes if status is None else notes.filter(F.col("status") == status)


def citing(notes: DataFrame, url: Column, content_hash: Column | None = None) -> DataFrame:
    def hit(s):
        return (s["url"] == url) if content_hash is None else (s["url"] == url) & (s["content_hash"] == content_hash)

    return notes.filter(F.exists("sources", hit))


def validate(rows: DataFrame) -> DataFrame:
    """All errors and warnings of a write at once, as comma-joined codes. Empty ``errors`` means accepted."""
    def blank(c):
        return F.coalesce(F.trim(c), F.lit("")) == ""

    def bad_enum(c, *allowed):
        return ~F.coalesce(F.lower(F.trim(c)).isin(*allowed), F.lit(False))

    imp = F.col("importance")
    errors = F.array_compact(F.array(
        F.when(blank("body"), "empty_body"), F.when(blank("title"), "empty_title"), F.when(F.length(F.trim("title")) > 200, "long_title"),
        F.when(F.exists("entities", lambda e: F.trim(e) == ""), "blank_entity"), F.when(bad_enum("confidence", "high", "medium", "low"), "bad_confidence"),
        F.when(bad_enum("volatility", "stable", "drifting", "volatile"), "bad_volatility"), F.when(bad_enum("kind", "knowledge", "user", "experience"), "bad_kind"),
        F.when((imp < 0) | (imp > 1), "importance_range"),
    ))
    warnings = F.array_compact(F.array(F.when(F.col("urls").isNull(), "no_sources"), F.when(F.size("urls") == 0, "empty_sources")))
    return rows.withColumn("errors", F.array_join(errors, ",")).withColumn("warnings", F.array_join(warnings, ","))


def union_refs(left: Column, right: Column) -> Column:
    return F.array_distinct(F.concat(left, right))


def union_entities(left: Column, right: Column) -> Column:
    return X.dedupe_by(F.concat(left, right), lambda x: X.slugify(x))


def allocate_ids(rows: DataFrame, order: list[str], existing: DataFrame, prefix: str = "N-", digits: int = 4) -> DataFrame:
    """Ids that continue after the highest stored number, given out in ``order`` without a single-task window."""
    number = F.regexp_extract("note_id", r"^" + prefix + r"(\d+)$", 1)
    top = existing.filter(number != "").agg(F.coalesce(F.max(number.cast("bigint")), F.lit(0)).alias("top"))
    placed = global_position(rows, order).join(F.broadcast(top), F.lit(True)).withColumn("n", (F.col("top") + F.col("pos")).cast("string"))
    return placed.withColumn("new_id", F.concat(F.lit(prefix), F.lpad("n", F.greatest(F.length("n"), F.lit(digits)), "0"))).drop("n", "top", "pos")


def match_pool(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """(run, note_id, url) of candidates joined to the run's pool; ``content_hash`` NULL and ``in_pool`` false outside it."""
    p = pool.select("run", "url", "content_hash", F.lit(True).alias("_in"))
    return candidates.join(p, ["run", "url"], "left").withColumn("in_pool", F.coalesce("_in", F.lit(False))).drop("_in")


def fold_jobs(log: DataFrame, keys: list[str]) -> DataFrame:
    """Last row per job in append order; ``max_by`` folds on the map side."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r")).select(*keys, "r.*")


def page_groups(notes: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` entities by number of notes, with the entities that occur in their notes."""
    e = notes.filter(F.trim("body") != "").select("note_id", F.explode(F.array_distinct(F.transform("entities", lambda x: X.slugify(x)))).alias("entity_id"))
    best = e.groupBy("entity_id").agg(F.count("*").alias("n_notes")).orderBy(F.desc("n_notes"), "entity_id").limit(top)
    inside = e.join(F.broadcast(best), "entity_id")  # ``top`` rows
    related = inside.select("entity_id", "n_notes", "note_id").join(e.withColumnRenamed("entity_id", "related_id"), "note_id")
    return related.select("entity_id", "n_notes", "related_id").distinct()
