"""Maintenance planning and the job ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.functions import temporal as T
from kledger.functions import vectors as V
from kledger.operators import evidence as EV
from kledger.operators import pairs as P
from kledger.operators.freshness import with_freshness
from kledger.operators.retrieval import top_rows, vectorize
from kledger.operators.store import fold_jobs
from kledger.session import written


@dataclass(frozen=True)
class ConsolidationSettings:
    """Plan limits. The plan is a bounded report: the first ``max_*`` actions of each class in id order."""

    merge_floor: float = 0.5
    merge_ceiling: float = 0.95
    max_conflict_pairs: int = 50
    max_merges: int = 10
    max_conflicts: int = 10
    max_refresh: int = 10
    max_rejudge: int = 10


def pool(notes: DataFrame) -> DataFrame:
    return notes.filter("status = 'active' AND NOT tombstone")


def pair_rows(pairs: DataFrame, notes: DataFrame, *more: str) -> DataFrame:
    """Pairs with the columns the evidence comparison reads; the right note is evidence without time or source."""
    a = notes.select(F.col("note_id").alias("a_id"), F.col("body").alias("prior_text"), F.col("entities").alias("prior_entities"), "source_changed_at", "observed_at", "created")
    b = notes.select(F.col("note_id").alias("b_id"), F.col("body").alias("evidence_text"), F.col("entities").alias("evidence_entities"))
    none = F.lit(None).cast("string")
    return pairs.join(a, "a_id").join(b, "b_id").select(
        F.concat_ws("|", "a_id", "b_id").alias("pair_id"), F.col("a_id").alias("prior_id"), F.col("b_id").alias("evidence_id"), "prior_text", "evidence_text",
        "prior_entities", "evidence_entities", F.array().cast("array<struct<url:string,content_hash:string>>").alias("sources"), F.lit("").alias("source_url"), F.lit("").alias("content_hash"),
        "source_changed_at", "observed_at", "created", none.alias("evidence_observed_at"), "pair_no", *more,
    )


def scanned_pairs(notes: DataFrame) -> DataFrame:
    """Pair numbering over the knowledge notes of the pool, written once."""
    return P.cumulated(P.partner_counts(P.keyed(pool(notes).filter("kind = 'knowledge'").select("note_id", "entities"))))


def conflict_candidates(notes: DataFrame, cum: DataFrame, cfg: ConsolidationSettings) -> DataFrame:
    """Conflicting pairs among the first ``max_conflict_pairs`` pairs: (a_id, b_id, pair_no, slot, similarity)."""
    compared = EV.compare(pair_rows(P.pair_window(cum, 0, cfg.max_conflict_pairs), notes)).filter("verdict = 'conflicting'")
    return compared.select(F.col("prior_id").alias("a_id"), F.col("evidence_id").alias("b_id"), "pair_no", F.col("first_conflict.slot").alias("slot"), "similarity")


def _pair_similarity(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """``pairs`` (a_id, b_id, ...) with their ``similarity``; a pair with a note that has no vector is left out."""
    left = vecs.select(F.col("note_id").alias("a_id"), F.col("v").alias("va"))
    right = vecs.select(F.col("note_id").alias("b_id"), F.col("v").alias("vb"))
    sim = V.similarity_from(V.dot(F.col("va"), F.col("vb")), V.norm2(F.col("va")), V.norm2(F.col("vb")))
    return pairs.join(left, "a_id").join(right, "b_id").withColumn("similarity", sim).drop("va", "vb")


def _in_band(pairs: DataFrame, cfg: ConsolidationSettings) -> DataFrame:
    return pairs.filter((F.col("similarity") >= cfg.merge_floor) & (F.col("similarity") < cfg.merge_ceiling))


def _conflicting(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """The conflicting ones of ``pairs`` (a_id, b_id, pair_no, similarity), with their ``slot``. Only pairs that reach the floor can conflict, so only those carry texts."""
    near = pairs.filter(F.col("similarity") >= EV.VerificationSettings().normalized().floor)
    compared = EV.compare(pair_rows(near, notes, "similarity")).filter("verdict = 'conflicting'")
    return compared.select(F.col("prior_id").alias("a_id"), F.col("evidence_id").alias("b_id"), "pair_no", F.col("first_conflict.slot").alias("slot"), "similarity")


def first_conflicts(notes: DataFrame, cum: DataFrame, vecs: DataFrame, cfg: ConsolidationSettings, window: int = 2_000) -> DataFrame | None:
    """The first ``max_conflicts`` conflicting pairs of all pairs in id order, or None."""
    return P.first_matching(cum, lambda pairs: _conflicting(_pair_similarity(pairs, vecs), notes), cfg.max_conflicts, window)


def first_merges(notes: DataFrame, cum: DataFrame, vecs: DataFrame, cfg: ConsolidationSettings, window: int = 2_000) -> DataFrame | None:
    """The first ``max_merges`` pairs of all pairs in id order whose similarity lies in the merge band and which do not conflict, or None."""

    def accept(pairs):
        near = written(_in_band(_pair_similarity(pairs, vecs), cfg), "merge-band")  # read by the comparison and by what it leaves
        return near.join(_conflicting(near, notes).select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select("a_id", "b_id", "pair_no", "similarity")

    return P.first_matching(cum, accept, cfg.max_merges, window)


def merge_candidates(notes: DataFrame, cum: DataFrame, conflicts: DataFrame, cfg: ConsolidationSettings, window: int = 100_000) -> DataFrame:
    """The first ``max_merges`` pairs in id order whose similarity lies in the merge band and which are not among ``conflicts``."""
    vecs = vectorize(notes, "note_id", F.col("body"))

    def accept(pairs):
        both = pairs.join(conflicts.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
        return _in_band(_pair_similarity(both, vecs), cfg).select("a_id", "b_id", "pair_no", "similarity")

    found = P.first_matching(cum, accept, cfg.max_merges, window)
    if found is None:
        found = conflicts.select("a_id", "b_id", "pair_no", "similarity").limit(0)
    return with_canonical(found, notes)


def with_canonical(found: DataFrame, notes: DataFrame) -> DataFrame:
    """``found`` (a_id, b_id, ...) with the older note as ``canonical_id`` and the other as ``absorbed_id``."""
    when = notes.select("note_id", F.coalesce(T.parse_ts(F.col("created")), F.lit("9999-12-31").cast("timestamp")).alias("c"))
    a, b = (when.select(F.col("note_id").alias(f"{x}_id"), F.col("c").alias(f"{x}_c")) for x in "ab")
    df = found.join(a, "a_id").join(b, "b_id")
    first = F.least(F.struct("a_c", "a_id"), F.struct(F.col("b_c").alias("a_c"), F.col("b_id").alias("a_id")))["a_id"]
    return df.withColumn("canonical_id", first).withColumn("absorbed_id", F.when(first == F.col("a_id"), F.col("b_id")).otherwise(F.col("a_id"))).drop("a_c", "b_c")


def refresh_candidates(notes: DataFrame, now: str) -> DataFrame:
    """Due or stale notes with a source URL: (note_id, url, state)."""
    s = with_freshness(pool(notes), now).filter("state <> 'fresh'")
    url = F.try_element_at(F.filter("sources", lambda x: x["url"] != ""), F.lit(1))["url"]
    return s.withColumn("url", url).filter("url IS NOT NULL").select("note_id", "url", "state", "body")


def rejudge_candidates(notes: DataFrame, now: str) -> DataFrame:
    """Low confidence, or due without any URL; notes a model has confirmed are left out. Needs ``confirmed``."""
    s = with_freshness(pool(notes), now)
    no_url = F.size(F.filter("sources", lambda x: x["url"] != "")) == 0
    due = (F.col("state") != "fresh") & no_url
    low = F.col("confidence") == "low"
    reasons = F.concat_ws(",", F.when(due, "due_without_source"), F.when(low, "low_confidence"))
    return s.filter(due | low).filter(~F.col("confirmed")).select("note_id", reasons.alias("reasons"), "body")


def plan(notes: DataFrame, now: str, cfg: ConsolidationSettings | None = None) -> DataFrame:
    """(action, note_ids, idempotency_key): capped per class, keyed by action, ids, bodies and parameters.

    Conflicts and merges are searched among all pairs, and no merge of the plan is a conflict.
    """
    cfg = cfg or ConsolidationSettings()
    cum = scanned_pairs(notes)
    knowledge = pool(notes).filter("kind = 'knowledge'")
    vecs = written(vectorize(knowledge, "note_id", F.col("body")), "plan-vectors")
    none = notes.sparkSession.createDataFrame([], "a_id string, b_id string, pair_no bigint, slot string, similarity double")
    conflicts, merges = first_conflicts(notes, cum, vecs, cfg), first_merges(notes, cum, vecs, cfg)
    conflicts = none if conflicts is None else conflicts
    merges = with_canonical(none.drop("slot") if merges is None else merges, notes)
    hashes = notes.select("note_id", F.sha2("body", 256).alias("h"))

    def two(df, action, cap, params):
        rows = df.orderBy("a_id", "b_id").limit(cap).join(hashes.select(F.col("note_id").alias("a_id"), F.col("h").alias("ha")), "a_id").join(hashes.select(F.col("note_id").alias("b_id"), F.col("h").alias("hb")), "b_id")
        key = X.idempotency_key(F.lit(action), F.array("a_id", "b_id"), F.array("ha", "hb"), params)
        return rows.select(F.lit(action).alias("action"), F.concat_ws(",", "a_id", "b_id").alias("note_ids"), key.alias("idempotency_key"))

    def one(df, action, cap, params):
        rows = df.orderBy("note_id").limit(cap)
        key = X.idempotency_key(F.lit(action), F.array("note_id"), F.array(F.sha2("body", 256)), params)
        return rows.select(F.lit(action).alias("action"), F.col("note_id").alias("note_ids"), key.alias("idempotency_key"))

    return (
        two(conflicts, "conflict", cfg.max_conflicts, F.col("slot"))
        .unionByName(two(merges, "merge", cfg.max_merges, F.concat(F.lit("canonical="), "canonical_id")))
        .unionByName(one(refresh_candidates(notes, now), "refresh", cfg.max_refresh, F.concat(F.lit("url="), "url")))
        .unionByName(one(rejudge_candidates(notes, now), "rejudge", cfg.max_rejudge, F.lit("tier=cheap")))
    )


def cap_per_class(actions: DataFrame, n: int) -> DataFrame:
    """First ``n`` actions per class by ids, then key. A group limit runs before the shuffle."""
    return top_rows(actions, ["action"], ["note_ids", "idempotency_key"], n, "_r").drop("_r")


def gate_jobs(actions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Actions whose key is already done become ``skipped`` with the matched job; the others ``pending``."""
    done = jobs.filter("status = 'done'").groupBy("idempotency_key").agg(F.max_by("job_id", "seq").alias("matched_job_id"))
    return actions.join(done, "idempotency_key", "left").withColumn("status", F.when(F.col("matched_job_id").isNotNull(), "skipped").otherwise("pending"))


def transition(commands: DataFrame, log: DataFrame) -> DataFrame:
    """Retry and skip commands against the folded ledger: (cmd_id, job_id, outcome, status, attempt)."""
    state = fold_jobs(log, ["ledger", "job_id"]).select("ledger", "job_id", F.col("status").alias("cur"), "attempt")
    df = commands.join(state, ["ledger", "job_id"], "left")
    outcome = (
        F.when(F.col("cur").isNull(), "unknown_job")
        .when((F.col("op") == "retry") & (F.col("cur") != "failed"), "only_failed_can_retry")
        .when((F.col("op") == "skip") & ~F.col("cur").isin("pending", "failed"), "only_pending_or_failed_can_skip").otherwise("ok")
    )
    ok = outcome == "ok"
    return df.select(
        "cmd_id", "ledger", "job_id", "op", outcome.alias("outcome"),
        F.when(ok & (F.col("op") == "retry"), "pending").when(ok, "skipped").alias("status"),
        F.when(ok & (F.col("op") == "retry"), F.col("attempt") + 1).when(ok, F.col("attempt")).alias("attempt"),
    )


def merge_effects(merges: DataFrame, notes: DataFrame) -> DataFrame:
    """Execution of merge jobs (seq, canonical_id, absorbed_id): one outcome row per job.

    A job fails when either side is not active, or when an earlier job of the batch already absorbed one of
    its notes. First uses are found by an aggregate per note, so chains need no sequential pass.
    """
    live = notes.filter("status = 'active'").select("note_id")
    gone = merges.groupBy(F.col("absorbed_id").alias("n")).agg(F.min("seq").alias("gone_at"))
    a = gone.select(F.col("n").alias("canonical_id"), F.col("gone_at").alias("c_gone"))
    b = gone.select(F.col("n").alias("absorbed_id"), F.col("gone_at").alias("a_gone"))
    df = merges.join(a, "canonical_id", "left").join(b, "absorbed_id", "left")
    df = df.join(live.select(F.col("note_id").alias("canonical_id"), F.lit(True).alias("c_ok")), "canonical_id", "left").join(live.select(F.col("note_id").alias("absorbed_id"), F.lit(True).alias("a_ok")), "absorbed_id", "left")
    fail = F.col("c_ok").isNull() | F.col("a_ok").isNull() | (F.col("c_gone") < F.col("seq")) | (F.col("a_gone") < F.col("seq"))
    return df.select("seq", "canonical_id", "absorbed_id", F.when(F.coalesce(fail, F.lit(False)), "failed").otherwise("done").alias("status"))


def refresh_effects(jobs: DataFrame, notes: DataFrame, latest: DataFrame) -> DataFrame:
    """Refresh jobs (note_id, url) against the newest snapshots: unchanged, changed, or failed on drift."""
    live = notes.filter("status = 'active'").select("note_id", "sources", F.lit(True).alias("_ok"))
    df = jobs.join(live, "note_id", "left").join(latest.select("url", F.col("content_hash").alias("new_hash")), "url", "left")
    ref = F.try_element_at(F.filter("sources", lambda s: s["url"] == F.col("url")), F.lit(1))
    status = F.when(F.col("_ok").isNull(), "failed:not_active").when(ref.isNull(), "failed:not_cited").when(F.col("new_hash").isNull(), "failed:no_snapshot").when(F.col("new_hash") == ref["content_hash"], "unchanged").otherwise("changed")
    return df.select("note_id", "url", status.alias("outcome"), ref["content_hash"].alias("old_hash"), "new_hash")


def rejudge_effects(outputs: DataFrame, notes: DataFrame) -> DataFrame:
    """Rejudge outputs (note_id, raw): JSON with exactly verdict and reason, anything else fails."""
    v = F.try_parse_json(F.trim("raw"))
    keys = F.array_sort(F.json_object_keys(F.trim("raw")))
    verdict, reason = F.try_variant_get(v, "$.verdict", "string"), F.try_variant_get(v, "$.reason", "string")
    typed = F.schema_of_variant(v) == "OBJECT<reason: STRING, verdict: STRING>"
    ok = v.isNotNull() & (keys == F.array(F.lit("reason"), F.lit("verdict"))) & typed & verdict.isin("confirm", "supersede") & (F.trim(reason) != "")
    live = notes.filter("status = 'active'").select("note_id", F.lit(True).alias("_ok"))
    df = outputs.join(live, "note_id", "left")
    status = F.when(F.col("_ok").isNull(), "failed:not_active").when(~F.coalesce(ok, F.lit(False)), "failed:malformed").otherwise("done")
    return df.select("note_id", status.alias("status"), F.when(status == "done", verdict).alias("verdict"), F.when((status == "done") & (verdict == "supersede"), "superseded").alias("new_status"))
