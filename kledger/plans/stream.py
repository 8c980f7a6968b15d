"""Streaming jobs (STR), each run to the end of its input; the twin is the batch form of the same question."""

from __future__ import annotations

from pyspark.sql import functions as F

from kledger.plans import fixtures as fx
from kledger.plans.core import MARKS
from kledger.plans.evals import STREAKS
from kledger.plans.fn import FINGERPRINT_SQL, with_fingerprint
from kledger.plans.oracle_base import ts, twin
from kledger.plans.registry import query
from kledger.streaming import jobs as S


def events(spark, sf):
    return S.read_stream(spark, sf, only="events.parquet")


def delivered(spark, parts, name):
    """(stream, deliver): each of ``parts`` (frames of one schema) is written as one delivery, in as many files as it has tasks."""
    path = S.work_dir(spark, name)
    parts[0].limit(0).write.parquet(path)
    stream = S.read_stream(spark, path, None, schema=parts[0].schema)
    return stream, [lambda df=df: df.write.mode("append").parquet(path) for df in parts]


def staged(spark, df, name, order, files=4):
    """``df`` delivered in ``files`` consecutive slices of its integer column ``order``, oldest slice first."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return delivered(spark, [df], name)
    return delivered(spark, [df.filter(F.floor((F.col(order) - lo) * files / (hi - lo + 1)) == i) for i in range(files)], name)


@query("STR-01", twin("SELECT strftime(ts, '%Y-%m-%d') AS day, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*)::BIGINT AS calls FROM token_ledger GROUP BY ALL", "token_ledger"))
def str_01(spark, sf):
    ledger = events(spark, sf).selectExpr(
        "cast(ts as timestamp) AS ts", "concat('m', cast(user_id % 3 as string)) AS model", "cast(floor(value * 100) as bigint) AS input_tokens", "cast(floor(value * 10) as bigint) AS output_tokens"
    )
    return S.token_totals(spark, ledger).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("STR-02", twin(f"SELECT note_id, strftime(greatest({ts('created')}, {ts('reviewed_at')}), '%Y-%m-%d') AS updated, CASE WHEN status <> 'active' THEN 'status' WHEN {ts('reviewed_at')} > {ts('created')} THEN 'reviewed' ELSE 'created' END AS change_kind FROM notes0", "notes0"))
def str_02(spark, sf):
    hist, deliver = staged(spark, fx.notes(spark, sf, False).select("d", "note_id", "status", "created", "reviewed_at"), "history", "d")
    return S.change_feed(spark, hist, deliver).select("note_id", F.date_format("updated", "yyyy-MM-dd").alias("updated"), "change_kind")


@query("STR-03", "SELECT DISTINCT user_id::VARCHAR || '-' || (props ->> '$.k') AS idempotency_key FROM events")
def str_03(spark, sf):
    jobs = events(spark, sf).selectExpr("cast(ts as timestamp) AS ts", "concat(cast(user_id as string), '-', get_json_object(props, '$.k')) AS idempotency_key")
    return S.job_intake(spark, jobs)


@query("STR-04", STREAKS)
def str_04(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr("user_id AS worker", "event_id AS seq", "CASE WHEN event_type IN ('error', 'click') THEN 'failed' ELSE 'done' END AS status")
    return S.streaks(spark, *staged(spark, rows, "outcomes", "seq"))


@query("STR-05", "SELECT doc_id AS seq, source || CASE WHEN v2 THEN '@v2' ELSE '' END AS doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN 'added' WHEN v2 THEN 'replaced' ELSE 'error' END AS action FROM (SELECT doc_id, source, doc_id % 3 = 0 AS v2 FROM documents)")
def str_05(spark, sf):
    rows = fx.table(spark, sf, "documents").selectExpr("doc_id AS seq", "concat(source, CASE WHEN doc_id % 3 = 0 THEN '@v2' ELSE '' END) AS doc_id")
    return S.corpus_versions(spark, *staged(spark, rows, "arrivals", "seq"))


@query("STR-06", twin("SELECT DISTINCT n.note_id, s.url, s.content_hash FROM notes n JOIN snapshot_log s ON s.url = n.src_url WHERE n.status = 'active' AND n.src_hash <> s.content_hash", "notes", "snapshot_log"))
def str_06(spark, sf):
    log = fx.snapshot_log(spark, sf).select("url", "content_hash", "fetched_at")
    days = [log.filter(F.to_date("fetched_at") == day) for day in ("2024-03-01", "2024-03-31")]  # one delivery per fetch date
    snapshots, deliver = delivered(spark, days, "snapshots")
    return S.source_marks(spark, snapshots, fx.notes(spark, sf), fx.NOW, deliver).select("note_id", "url", "content_hash")


@query("STR-07", twin(f"SELECT note_id, CASE WHEN d % 5 = 0 THEN sha256({FINGERPRINT_SQL} || 'x') ELSE {FINGERPRINT_SQL} END AS fingerprint, CASE WHEN d % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS writes FROM notes0", "notes0"))
def str_07(spark, sf):
    n = with_fingerprint(fx.notes(spark, sf, False)).select("d", "note_id", "fingerprint")
    first = n.select("note_id", "fingerprint", F.lit(1).alias("version"))
    again = n.filter("d % 2 = 1 OR d % 5 = 0").select("note_id", F.when(F.expr("d % 5 = 0"), F.sha2(F.concat("fingerprint", F.lit("x")), 256)).otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(2).alias("version"))
    return S.search_view(spark, *delivered(spark, [first, again], "images"))
