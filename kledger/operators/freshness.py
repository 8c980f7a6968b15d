"""Temporal validity of notes: one ordered CASE chain per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.functions import temporal as T
from kledger.operators.skew import global_position

STATES = ("fresh", "review_due", "stale")


def with_freshness(notes: DataFrame, now: str, settings: T.FreshnessSettings | None = None) -> DataFrame:
    """Adds state, age_days, half_life_days, decay and reasons (codes in rule order)."""
    cfg = settings or T.FreshnessSettings()
    n = T.now_lit(now)
    half, review, stale = cfg.columns(F.col("kind"), F.col("volatility"))
    base = T.base_time(F.col("observed_at"), F.col("created"))
    until, since = T.parse_ts(F.col("valid_until")), T.parse_ts(F.col("valid_from"))
    changed, reviewed = T.parse_ts(F.col("source_changed_at")), T.parse_ts(F.col("reviewed_at"))
    df = notes.withColumns({
        "_base": base, "_half": half, "_review": review, "_stale": stale, "_until": until, "_since": since, "_changed": changed, "_reviewed": reviewed,
    })
    df = df.withColumn("age_days", F.when(F.col("_base").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), T.age_days(n, F.col("_base")))))
    df = df.withColumn("decay", T.decay(F.col("age_days"), F.col("_half")))
    expired, early = n > F.col("_until"), n < F.col("_since")
    no_base, no_half = F.col("_base").isNull(), F.col("_half").isNull()
    by_rule = (
        F.when(expired, "stale").when(early, "review_due").when(no_base, "review_due").when(no_half, "fresh")
        .when(F.col("decay") <= F.col("_stale"), "stale").when(F.col("decay") <= F.col("_review"), "review_due").otherwise("fresh")
    )
    pending = F.col("_changed").isNotNull() & (F.col("_reviewed").isNull() | (F.col("_changed") > F.col("_reviewed")))
    reasons = F.array_compact(F.array(
        F.coalesce(F.concat(F.lit("base:"), T.base_field(F.col("observed_at"), F.col("created"))), F.lit("base:none")),
        F.when(F.col("valid_from").isNotNull() & F.col("_since").isNull(), "bad_valid_from"),
        F.when(F.col("valid_until").isNotNull() & F.col("_until").isNull(), "bad_valid_until"),
        F.when(expired, "expired").when(early, "not_yet_valid").when(no_base, "no_base_time").when(no_half, "no_decay")
        .when(F.col("decay") <= F.col("_stale"), "decay_stale").when(F.col("decay") <= F.col("_review"), "decay_due").otherwise("decay_fresh"),
        F.when(F.col("source_changed_at").isNotNull() & F.col("_changed").isNull(), "bad_source_changed_at")
        .when(pending, "source_changed").when(F.col("_changed").isNotNull(), "source_change_reviewed"),
    ))
    df = df.withColumn("state", F.when(pending & (by_rule == "fresh"), "review_due").otherwise(by_rule)).withColumn("reasons", reasons)
    return df.withColumnRenamed("_half", "half_life_days").drop("_base", "_review", "_stale", "_until", "_since", "_changed", "_reviewed")


def state_counts(states: DataFrame) -> DataFrame:
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def review_queue(states: DataFrame) -> DataFrame:
    """Stale first, then review_due; older first; ids break ties. Numbered without a single-task window."""
    due = states.filter(F.col("state") != "fresh").select(
        "note_id", "state", "age_days", F.when(F.col("state") == "stale", 0).otherwise(1).alias("_s"), (-F.col("age_days")).alias("_a")
    )
    return global_position(due, ["_s", "_a", "note_id"], "queue_pos").drop("_s", "_a")


def source_change_pending(notes: DataFrame) -> DataFrame:
    changed, reviewed = T.parse_ts(F.col("source_changed_at")), T.parse_ts(F.col("reviewed_at"))
    return notes.agg(F.count_if(changed.isNotNull() & (reviewed.isNull() | (changed > reviewed))).alias("pending"))


def source_change_marks(notes: DataFrame, latest: DataFrame, marks: DataFrame, at: str) -> DataFrame:
    """New (note_id, url, content_hash, marked_at) rows: an active note records another hash than the newest
    snapshot of a URL it cites, and that (note, url, hash) is not marked yet."""
    cites = notes.filter("status = 'active'").select("note_id", F.explode("sources").alias("s")).select("note_id", F.col("s.url").alias("url"), F.col("s.content_hash").alias("recorded"))
    now_at = latest.select("url", "content_hash")
    changed = cites.join(now_at, "url").filter(~F.col("recorded").eqNullSafe(F.col("content_hash")))
    fresh = changed.select("note_id", "url", "content_hash").distinct().join(marks.select("note_id", "url", "content_hash"), ["note_id", "url", "content_hash"], "left_anti")
    return fresh.withColumn("marked_at", F.lit(at))
