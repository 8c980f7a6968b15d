"""Operator inputs derived from the given tables. ``oracle_base`` builds the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kledger.sources.pages import main_text

NOW = "2025-01-01 00:00:00"


# Tables whose rows carry long texts: worth spreading when they arrive in fewer pieces than there are cores.
TEXT_TABLES = ("documents", "pages", "conversations")
MAX_BROADCAST_LABELS = 3_000_000
"""Up to this many labels (an id and a number) travel to the documents; more are joined by a shuffle."""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables. A text table stored as one small file would keep all per-row work in one task, so
    it is spread over the cores; a table that is already in many pieces is left as it is."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def nid(expr: str) -> str:
    return f"concat('N-', lpad(cast({expr} as string), greatest(6, length(cast({expr} as string))), '0'))"


STATUS = """CASE WHEN d % 97 IN (10, 11) THEN 'merged' WHEN d % 101 = 50 THEN 'merged'
  WHEN d % 13 = 5 THEN 'merged' WHEN d % 17 = 3 THEN 'superseded' ELSE 'active' END"""
NEXT = f"""CASE WHEN d % 97 = 10 THEN {nid('d + 1')} WHEN d % 97 = 11 THEN {nid('d - 1')}
  WHEN d % 101 = 50 THEN 'N-missing' ELSE {nid('d + 1')} END"""


def page_versions(spark: SparkSession, sf: str) -> DataFrame:
    """page_id, url, text, content_hash of every page."""
    return (
        table(spark, sf, "pages")
        .select("page_id", "url", main_text(F.col("html")).alias("text"))
        .withColumn("content_hash", F.sha2("text", 256))
    )


def notes(spark: SparkSession, sf: str, with_sources: bool = True) -> DataFrame:
    """The note table (T1). The key ``d`` is the document id it came from."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("d"), "text", "source")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("d"), "quality")
    if labels.count() <= MAX_BROADCAST_LABELS:  # checked before it is sent; otherwise the join shuffles the texts
        labels = F.broadcast(labels)
    base = docs.join(labels, "d", "left").selectExpr(
        "d",
        f"{nid('d')} AS note_id",
        r"substr(split(text, '\n')[0], 1, 60) AS title",
        "text AS body",
        "array(source, concat('topic-', cast(d % 37 as string))) AS entities",
        "CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS confidence",
        f"{STATUS} AS status",
        f"CASE WHEN {STATUS} = 'merged' THEN {NEXT} END AS redirect_to",
        f"CASE WHEN {STATUS} = 'superseded' THEN {NEXT} END AS superseded_by",
        "element_at(array('stable', 'drifting', 'volatile'), cast(d % 3 + 1 as int)) AS volatility",
        "CASE d % 11 WHEN 0 THEN 'user' WHEN 1 THEN 'experience' ELSE 'knowledge' END AS kind",
        "CASE WHEN d % 7 <> 0 THEN (d % 10) / 10.0D END AS importance",
        f"({STATUS} = 'active' AND d % 29 = 0) AS tombstone",
        "concat(cast(date_add(DATE'2024-01-01', cast(d % 365 as int)) as string), 'T00:00:00') AS created",
        "CASE WHEN d % 4 = 0 THEN NULL WHEN d % 23 = 0 THEN 'n/a' ELSE concat(cast(date_add(DATE'2024-01-01', cast(d % 365 + 1 as int)) as string), 'T00:00:00') END AS observed_at",
        "CASE WHEN d % 19 = 0 THEN '2024-06-30' END AS valid_until",
        "CASE WHEN d % 31 = 0 THEN '2025-06-30' END AS valid_from",
        "CASE WHEN d % 9 = 0 THEN concat(cast(date_add(DATE'2024-01-01', cast(d % 365 + 20 as int)) as string), 'T00:00:00') END AS source_changed_at",
        "CASE WHEN d % 10 = 0 THEN concat(cast(date_add(DATE'2024-01-01', cast(d % 365 + 30 as int)) as string), 'T00:00:00') WHEN d % 5 = 0 THEN concat(cast(date_add(DATE'2024-01-01', cast(d % 365 + 10 as int)) as string), 'T00:00:00') END AS reviewed_at",
    )
    if not with_sources:
        return base
    n_pages = max(1, table(spark, sf, "pages").count())
    pages = page_versions(spark, sf).select(F.col("page_id").alias("_p"), "url", "content_hash")
    joined = base.withColumn("_p", F.col("d") % n_pages).join(pages, "_p", "left")
    ref = "CASE WHEN d % 6 = 0 THEN '' WHEN d % 8 = 0 THEN 'old' ELSE content_hash END"
    return joined.withColumn("sources", F.expr(f"array(struct(url, {ref} AS content_hash))")).drop("_p", "url", "content_hash")


def lint_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes whose bodies carry note references and entity links."""
    extra = (
        f"concat(body, CASE WHEN d % 2 = 0 AND d > 0 THEN concat(' ', {nid('d - 1')}) ELSE '' END,"
        " CASE WHEN d % 3 = 0 THEN ' [[entity:src3|x]]' ELSE '' END,"
        " CASE WHEN d % 15 = 0 THEN ' [[entity:nowhere|y]]' ELSE '' END)"
    )
    return notes(spark, sf, with_sources=False).withColumn("body", F.expr(extra))


def snapshot_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions for pages with an odd id, one for the others."""
    v1 = page_versions(spark, sf).selectExpr("url", "text", "content_hash", "TIMESTAMP'2024-03-01 00:00:00' AS fetched_at", "page_id")
    v2 = v1.filter("page_id % 2 = 1").selectExpr(
        "url", "concat(text, ' v2') AS text", "sha2(concat(text, ' v2'), 256) AS content_hash",
        "fetched_at + INTERVAL 30 DAYS AS fetched_at", "page_id",
    )
    return v1.unionByName(v2).drop("page_id")


def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per document: a heading, a fenced block, and all its lines; of three lines one may cite its note and one the next note."""
    lines = rf"array_join(transform(split(text, '\n'), (x, i) -> CASE WHEN (i + 1) % 3 = 1 AND doc_id % 5 <> 0 THEN concat(x, ' ', {nid('doc_id')}) WHEN (i + 1) % 3 = 2 AND doc_id % 7 = 0 THEN concat(x, ' ', {nid('doc_id + 1')}) ELSE x END), '\n')"
    return table(spark, sf, "documents").selectExpr("concat('P-', cast(doc_id as string)) AS page_id", rf"concat('# ', source, '\n```\ncode line\n```\n', {lines}) AS body")


def phrase_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is asked for by a quotation of 24 characters, and every benchmark text by itself."""
    docs = table(spark, sf, "documents").selectExpr("concat('D-', cast(doc_id as string)) AS qid", "trim(substr(text, 11, 24)) AS q")
    bench = table(spark, sf, "benchmark").selectExpr("concat('B-', cast(item_id as string)) AS qid", "trim(text) AS q")
    return docs.unionByName(bench)


def bench_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").selectExpr("concat('B-', cast(item_id as string)) AS qid", "text AS q")


def short_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A query of one or two characters from every document."""
    return table(spark, sf, "documents").selectExpr(
        "concat('S-', cast(doc_id as string)) AS qid", "trim(substr(text, 1, 2)) AS q"
    )


def token_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "cast(ts as timestamp) AS ts",
        "concat(cast(user_id as string), '-', cast(cast(ts as date) as string)) AS trace_id",
        "event_type AS step", "concat('m', cast(user_id % 3 as string)) AS model",
        "cast(floor(value * 100) as bigint) AS input_tokens", "cast(floor(value * 10) as bigint) AS output_tokens",
        "cast(floor(value) as bigint) AS cache_read_tokens", "value * 7 AS latency_ms",
        "CASE WHEN event_type = 'error' THEN 'error' END AS error_type",
    )


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS seq", "user_id AS ledger",
        "concat('J-', lpad(get_json_object(props, '$.k'), greatest(4, length(get_json_object(props, '$.k'))), '0')) AS job_id",
        "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status",
        "cast(floor(value) as bigint) % 4 AS attempt",
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn",
        "CASE WHEN role = 'user' AND turn >= 4 AND turn % 4 = 2 THEN 'tool' ELSE role END AS role",
        "text AS content",
        "CASE WHEN role = 'user' AND turn >= 4 AND turn % 4 = 2 THEN 'web_search' ELSE '' END AS name",
    )


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, whole, is an answer to one benchmark item under one condition; ``k`` is the answer's id."""
    items = table(spark, sf, "benchmark").selectExpr("item_id", "text AS item_text")
    n_items = max(1, items.count())
    docs = table(spark, sf, "documents").selectExpr("doc_id AS k", "text AS doc_text", f"doc_id % {n_items} AS item_id", f"(doc_id div {n_items}) % 4 AS c")
    ev = table(spark, sf, "events").selectExpr("event_id AS k", "value")
    return (
        docs.join(items, "item_id")
        .join(ev, "k", "left")
        .selectExpr(
            "k", "item_id", "concat('q', cast(item_id as string)) AS qid", "concat('c', cast(c + 1 as string)) AS condition",
            "element_at(array('single_hop', 'multi_hop', 'temporal', 'unanswerable'), cast(item_id % 4 + 1 as int)) AS qtype",
            "CASE WHEN k % 9 = 0 THEN '资料未提及。' WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN concat(doc_text, ' [1] [3] ', item_text) ELSE concat(doc_text, ' [2] ') END AS answer",
            "CASE WHEN item_id % 4 = 3 THEN array() ELSE array(substr(item_text, 1, 12), substr(item_text, 21, 12), substr(item_text, 41, 12)) END AS gold_points",
            "cast(floor(value * 100) as bigint) AS input_tokens", "cast(floor(value * 10) as bigint) AS output_tokens",
            "value * 7 AS latency_ms",
            "CASE WHEN c IN (0, 3) THEN cast(floor(value) as bigint) % 6 END AS fresh_search_count",
            "concat('t', cast(k as string)) AS trace_id",
            "cast(k % 4 as int) AS n_sources",
        )
    )


# The event timeline used by the sequence analytics. Query ids repeat at five pairs of events.
REPEATS = {4: 1, 8: 6, 12: 10, 16: 13, 23: 5}
N_EVENTS = 24
INGEST_EVENT = 0
UPDATE_EVENT = 17


def seq_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(run, event, condition) rows; the runs come from blocks of 96 ledger rows, so they grow with the data."""
    ev = table(spark, sf, "events").selectExpr(
        "cast(floor(event_id / 96) as bigint) AS run", "cast(floor((event_id % 96) / 4) as int) AS event_id", "event_id % 4 AS c", "value", "event_type"
    )
    qid = "event_id"
    for later, first in REPEATS.items():
        qid = f"CASE WHEN event_id = {later} THEN {first} ELSE {qid} END"
    return ev.filter("NOT (event_id = 0 AND c = 0)").selectExpr(
        "run", "event_id", "concat('c', cast(c + 1 as string)) AS condition",
        f"CASE WHEN event_id = {INGEST_EVENT} THEN 'ingest' WHEN event_id = {UPDATE_EVENT} THEN 'update' ELSE 'query' END AS event_kind",
        f"CASE WHEN event_id NOT IN ({INGEST_EVENT}, {UPDATE_EVENT}) THEN concat('q', cast({qid} as string)) END AS qid",
        f"CASE WHEN event_id NOT IN ({INGEST_EVENT}, {UPDATE_EVENT}) THEN element_at(array('single_hop', 'temporal', 'multi_hop', 'unanswerable'), cast(({qid}) % 4 + 1 as int)) END AS qtype",
        "cast(floor(value * 100) as bigint) AS in_tok", "cast(floor(value * 10) as bigint) AS out_tok",
        "cast(floor(value * 3) as bigint) AS judge_in_tok", "value * 7 AS latency_ms",
        "CASE WHEN event_type <> 'error' THEN (cast(floor(value * 100) as bigint) % 4) / 3.0D END AS em",
        "(event_type = 'signup') AS refusal",
        "CASE WHEN event_type <> 'view' THEN (cast(floor(value * 100) as bigint) % 5) / 4.0D END AS citation_coverage",
        "CASE WHEN c = 3 THEN element_at(array('simple', 'update', 'deep'), cast(cast(floor(value) as bigint) % 3 + 1 as int)) END AS policy_mode",
        "CASE WHEN c IN (1, 2) THEN cast(floor(value) as bigint) % 4 END AS embedding_calls",
        f"CASE WHEN event_id > {UPDATE_EVENT} AND event_id % 3 = 0 THEN 'override' ELSE 'base' END AS gold_source",
    )


def unanswered(spark: SparkSession, sf: str) -> DataFrame:
    """Open ledger questions: every user turn, whole."""
    d = "conv_id * 1000 + turn"
    return table(spark, sf, "conversations").filter("role = 'user'").selectExpr(
        f"{nid(d)} AS note_id", "text AS question", "concat('2024-05-0', cast(conv_id % 9 + 1 as string)) AS asked_date",
        "CASE WHEN conv_id % 2 = 0 THEN 'no_notes' ELSE 'below_min_fresh' END AS reason",
    )


def guard_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").selectExpr(
        "concat('B-', cast(item_id as string)) AS qid", "concat(text, CASE WHEN item_id % 4 = 0 THEN concat(' topic-', cast(item_id % 37 as string)) ELSE '' END) AS q"
    )


def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Conflict ledger: notes d and d + 37 for every d; every second one is open."""
    n = notes(spark, sf, with_sources=False).selectExpr("d", "note_id", "title", "body", "entities", "concat(title, ' ', body) AS t")
    b = n.selectExpr("d - 37 AS d", "note_id AS note_b", "entities AS entities_b", "t AS text_b", "title AS title_b")
    return n.join(b, "d", "left").selectExpr(
        "concat('C-', lpad(cast(d as string), greatest(6, length(cast(d as string))), '0')) AS conflict_id", "d", "note_id AS note_a", "note_b",
        "CASE WHEN d % 2 = 0 THEN 'open' ELSE 'resolved' END AS status", "concat('topic-', cast(d % 37 as string)) AS entity",
        "t AS text_a", "coalesce(text_b, '') AS text_b", "entities AS entities_a", "entities_b", "title AS value_a", "title_b AS value_b",
    )


def corpus_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "lpad(cast(doc_id as string), greatest(6, length(cast(doc_id as string))), '0') AS doc_id",
        r"substr(split(text, '\n')[0], 1, 60) AS title", "concat('doc://', source, '/', cast(doc_id as string)) AS url", "text AS body",
    )
