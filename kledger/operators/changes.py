"""Change feed with a cursor, and the timeline of a lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.functions import temporal as T
from kledger.operators.skew import global_position


def with_change(notes: DataFrame) -> DataFrame:
    """Adds updated (the later of created and reviewed_at) and change_kind."""
    c, r = T.parse_ts(F.col("created")), T.parse_ts(F.col("reviewed_at"))
    kind = F.when(F.col("status") != "active", "status").when(r > c, "reviewed").otherwise("created")
    return notes.withColumn("updated", F.greatest(c, r)).withColumn("change_kind", kind)


def page_bounds(changed: DataFrame, limit: int) -> DataFrame:
    """One row: total, has_more and the time up to which the oldest page reaches. A top-``limit`` sort, no window."""
    edge = changed.select("updated").orderBy("updated").limit(limit).agg(F.max("updated").alias("edge"))
    total = changed.agg(F.count("*").alias("total"))
    return edge.join(total, F.lit(True)).withColumn("has_more", F.col("total") > limit)


def list_changes(notes: DataFrame, since: str, limit: int) -> DataFrame:
    """The oldest page after ``since``: at least ``limit`` rows, cut between two timestamps and never inside one."""
    changed = with_change(notes).filter(F.col("updated") > T.now_lit(since))
    page = changed.join(F.broadcast(page_bounds(changed, limit)), F.lit(True)).filter(~F.col("has_more") | (F.col("updated") <= F.col("edge")))
    return page.withColumn("next_since", F.when(F.col("has_more"), F.col("edge"))).drop("edge")


def timeline(notes: DataFrame, chains: DataFrame) -> DataFrame:
    """(lineage, note_id, topo, change_kind, at, reason): created, reviewed and status events of every lineage."""
    c, r = T.parse_ts(F.col("created")), T.parse_ts(F.col("reviewed_at"))
    active = F.col("status") == "active"
    events = F.array_compact(F.array(
        F.when(c.isNotNull(), F.struct(F.lit(0).alias("o"), F.lit("created").alias("change_kind"), c.alias("at"))),
        F.when(active & (r > c), F.struct(F.lit(1).alias("o"), F.lit("reviewed").alias("change_kind"), r.alias("at"))),
        F.when(~active, F.struct(F.lit(2).alias("o"), F.lit("status").alias("change_kind"), F.greatest(c, r).alias("at"))),
    ))
    roots = chains.select("note_id", F.coalesce("canonical_id", "note_id").alias("lineage"), F.when(F.col("outcome") == "active", -F.col("hops")).otherwise(0).alias("topo"))
    return notes.join(roots, "note_id").select("lineage", "note_id", "topo", F.explode(events).alias("e")).select("lineage", "note_id", "topo", "e.change_kind", "e.at", "e.o").dropDuplicates()


def version_order(chains: DataFrame) -> DataFrame:
    """Position of each version in its lineage, oldest first: farther from the root first, then by id."""
    rows = chains.filter("outcome = 'active'").select("canonical_id", "note_id", (-F.col("hops")).alias("_d"))
    placed = global_position(rows, ["canonical_id", "_d", "note_id"])
    first = placed.groupBy("canonical_id").agg(F.min("pos").alias("_first"))
    return placed.join(first, "canonical_id").select("canonical_id", "note_id", (F.col("pos") - F.col("_first") + 1).alias("version"))
