"""Applying verdicts to the store: ordered skips, effects as new rows, explicit commands, conflict rulings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.operators.ingest import confidence_of
from kledger.session import written

BUCKETS = ("reviewed", "superseded", "merged", "conflicts", "skipped")


def primary_source(refs: Column) -> Column:
    """The first source with a hash, else the first with a URL."""
    usable = F.filter(refs, lambda r: r["url"] != "")
    return F.coalesce(F.try_element_at(F.filter(usable, lambda r: r["content_hash"] != ""), F.lit(1)), F.try_element_at(usable, F.lit(1)))


def evidence_from_candidates(candidates: DataFrame, now: str) -> DataFrame:
    p = primary_source(F.col("refs"))
    return candidates.select(
        "run", "evidence_index", F.trim("text").alias("text"), F.lit(now).alias("observed_at"), F.coalesce(p["url"], F.lit("")).alias("source_url"),
        F.coalesce(p["content_hash"], F.lit("")).alias("content_hash"), "entities",
    )


def decide(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What happens to each comparison, in batch order ``seq``.

    ``rows``: seq, prior_id, prior_status (NULL when missing), text (NULL when the index is out of range),
    suggested_action, guard, source_url, content_hash. ``known``: keys and body keys already handled. Duplicates
    and retirements look back in the batch; both are answered by a minimum of ``seq`` per key, which folds on
    the map side, instead of an ordered walk over a hot note. The rows are written once; their texts take no part in the
    joins and come back to their rows at the end, where they are read.
    """
    body_key = X.evidence_key(F.col("text"))
    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("body_key", body_key), "update-rows")
    has_text = F.col("body_key").isNotNull()
    df = numbered.drop("text").withColumn("key", F.when(has_text, F.concat_ws(":", "prior_id", "body_key")))
    usable = df.filter(F.col("prior_status").isNotNull() & has_text)
    first = usable.groupBy("key").agg(F.min("seq").alias("first_seq"))
    seen = known.select(F.col("key").alias("_k")).distinct()
    df = df.join(first, "key", "left")
    df = df.join(seen.select(F.col("_k").alias("key"), F.lit(True).alias("k1")), "key", "left").join(seen.select(F.col("_k").alias("body_key"), F.lit(True).alias("k2")), "body_key", "left")
    sourced = (F.trim("source_url") != "") & (F.trim("content_hash") != "")
    early = (
        F.when(F.col("prior_status").isNull(), "missing_prior").when(~has_text, "bad_index").when(F.col("first_seq") < F.col("seq"), "duplicate")
        .when(F.col("k1").isNotNull() | F.col("k2").isNotNull(), "already_processed")
    )
    blocked = F.col("guard").isNotNull() & ~F.col("suggested_action").isin("open_conflict", "none")
    df = df.withColumns({"_early": early, "_blocked": F.coalesce(blocked, F.lit(False)), "_sourced": F.coalesce(sourced, F.lit(False))})
    retires = df.filter("_early IS NULL AND prior_status = 'active' AND NOT _blocked AND suggested_action = 'supersede' AND _sourced").groupBy("prior_id").agg(F.min("seq").alias("retired_at"))
    df = df.join(retires, "prior_id", "left")
    skip = (
        F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("retired_at") < F.col("seq"), "retired").when(F.col("prior_status") != "active", "not_active")
        .when(F.col("_blocked"), "guard").when(F.col("suggested_action") == "none", "uncertain")
    )
    applied = (
        F.when(F.col("suggested_action") == "refresh_reviewed_at", "reviewed").when((F.col("suggested_action") == "supersede") & F.col("_sourced"), "superseded")
        .when(F.col("suggested_action") == "merge", "merged").otherwise("conflicts")
    )
    df = df.withColumn("skip", skip).withColumn("applied", F.when(skip.isNotNull(), "skipped").otherwise(applied))
    df = df.withColumn("downgraded", (F.col("applied") == "conflicts") & (F.col("suggested_action") == "supersede"))
    # left: a row has one text, so a reader of keys and outcomes alone pays for no join of texts
    df = df.join(numbered.select("_row", "text"), "_row", "left")
    return df.drop("_row", "first_seq", "k1", "k2", "_early", "_blocked", "_sourced", "retired_at")


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.agg(*[F.count_if(F.col("applied") == b).alias(b) for b in BUCKETS])


def supersede_effects(actions: DataFrame, notes: DataFrame) -> DataFrame:
    """The new note of each replacement and the retired state of its predecessor, one row each."""
    s = actions.filter("applied = 'superseded'").join(notes.select(F.col("note_id").alias("prior_id"), "entities", "volatility", "kind"), "prior_id")
    new_id = F.concat(F.lit("N-S"), F.substring("key", -16, 16))
    fresh = s.select(
        new_id.alias("note_id"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("superseded_by"), F.col("prior_id").alias("superseded_from"),
        confidence_of(F.lit(True), X.has_specifics(F.col("text"))).alias("confidence"), "volatility", "kind", X.derive_title(F.col("text"), 80).alias("title"),
    )
    none = F.lit(None).cast("string")
    old = s.select(F.col("prior_id").alias("note_id"), F.lit("superseded").alias("status"), new_id.alias("superseded_by"), none.alias("superseded_from"), none.alias("confidence"), "volatility", "kind", none.alias("title"))
    return fresh.unionByName(old)


def merge_effects(actions: DataFrame, notes: DataFrame, now: str) -> DataFrame:
    """Additions as rows (note_id, seq, addition, new_source): a note's body is its own text and its additions in
    order. Text the note already holds, from a source it already cites, changes nothing and is idempotent."""
    m = actions.filter("applied = 'merged'").join(notes.select(F.col("note_id").alias("prior_id"), "body", "sources"), "prior_id")
    has_text = F.contains("body", F.trim("text"))
    cited = F.exists("sources", lambda s: (s["url"] == F.col("source_url")) & (s["content_hash"] == F.col("content_hash")))
    new_source = (F.col("source_url") != "") & (F.col("content_hash") != "") & ~cited
    return m.select(
        F.col("prior_id").alias("note_id"), "seq", F.when(~has_text, F.concat(F.lit("- added ("), F.lit(now), F.lit("): "), F.trim("text"))).alias("addition"),
        new_source.alias("new_source"), F.when(has_text & ~new_source, "idempotent").otherwise("merged").alias("outcome"),
    )


def conflict_effects(actions: DataFrame, now: str) -> DataFrame:
    """New conflict-ledger rows: two claims and both keys."""
    return actions.filter("applied = 'conflicts'").select(
        "seq", F.col("prior_id").alias("claim_a"), F.substring("text", 1, 200).alias("claim_b"), "key", "body_key", F.lit("open").alias("status"), F.lit(now).alias("created"), "downgraded",
    )


def run_commands(commands: DataFrame, notes: DataFrame, now: str) -> DataFrame:
    """Explicit revise / supersede / invalidate commands (cmd_id, note_id, op, reason, text): outcome and effects."""
    df = commands.join(notes.select("note_id", "status"), "note_id", "left")
    error = (
        F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "active", "not_active").when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason_required")
        .when((F.col("op") != "invalidate") & (F.coalesce(F.trim("text"), F.lit("")) == ""), "text_required")
    )
    ok = error.isNull()
    makes = F.col("op").isin("supersede", "invalidate")
    new_id = F.concat(F.lit("N-X"), F.col("cmd_id").cast("string"))
    return df.select(
        "cmd_id", "note_id", "op", F.coalesce(error, F.lit("ok")).alias("outcome"), F.when(ok & makes, "superseded").when(ok, "active").alias("new_status"),
        F.when(ok & makes, new_id).alias("new_note_id"), (ok & (F.col("op") == "invalidate")).alias("tombstone"), F.when(ok & (F.col("op") == "revise"), F.lit(now)).alias("reviewed_at"),
    )


def rule_conflicts(decisions: DataFrame, conflicts: DataFrame, notes: DataFrame) -> DataFrame:
    """Decisions (conflict_id, verdict, adopted): an open conflict and a live adopted note, or the reason why not."""
    n = notes.select(F.col("note_id").alias("adopted"), F.col("status").alias("n_status"), "tombstone")
    df = decisions.join(conflicts.select("conflict_id", F.col("status").alias("c_status")), "conflict_id", "left").join(n, "adopted", "left")
    outcome = (
        F.when(F.col("c_status").isNull(), "unknown_conflict").when(F.col("c_status") != "open", "not_open").when(F.col("n_status").isNull(), "unknown_note")
        .when(~F.col("n_status").isin("active", "merged"), "note_retired").when(F.col("tombstone"), "tombstone").otherwise("resolved")
    )
    return df.select("conflict_id", "adopted", "verdict", outcome.alias("outcome"))


def unanswered_runs(runs: DataFrame, recorded: DataFrame) -> DataFrame:
    """(trace_id, reason) of runs that found nothing or too little; one entry per trace, once."""
    reason = F.when((F.col("notes_created") == 0) & (F.col("fresh_sources") == 0), "no_notes").when(F.col("fresh_sources") < F.col("min_fresh"), "below_min_fresh")
    return runs.withColumn("reason", reason).filter("reason IS NOT NULL").join(recorded.select("trace_id"), "trace_id", "left_anti").select("trace_id", "reason")
