"""Sources, filters, set operations, entity registry, freshness, lint and change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kledger.functions import temporal as T
from kledger.functions import text as X
from kledger.operators import changes as CH
from kledger.operators import entities as E
from kledger.operators import freshness as FR
from kledger.operators import lint as L
from kledger.operators import store as S
from kledger.operators.retrieval import top_rows
from kledger.plans import fixtures as fx
from kledger.plans import oracle_base as ob
from kledger.plans.fn import AGE_SQL, ASSERTION_SQL, BASE_SQL, HALF_SQL, slug_sql, with_fingerprint
from kledger.plans.oracle_base import NOW, nid, ranked_twin, ts, twin
from kledger.plans.registry import query
from kledger.plans.ret import chains
from kledger.session import shared_folder
from kledger.sources import jsonl as J
from kledger.sources import markdown as M
from kledger.sources import pages as PG

PLAIN = ["note_id", "title", "confidence", "status", "redirect_to", "superseded_by", "volatility", "kind", "importance", "tombstone", "observed_at", "created"]


def notes(spark, sf):
    return fx.notes(spark, sf, False)


# ---- sources and sinks -----------------------------------------------------------------------------
RECORDS = twin(f"SELECT {', '.join(PLAIN)}, array_to_string(entities, '|') AS entities, md5(body) AS body_md5, NULL::VARCHAR AS extra FROM notes0", "notes0")


def parsed(files):
    return M.parse_records(files).select(*PLAIN, F.array_join("entities", "|").alias("entities"), F.md5("body").alias("body_md5"), "extra")


@query("SRC-01", RECORDS)
def src_01(spark, sf):
    return parsed(M.render_records(fx.notes(spark, sf)).select(F.col("note_id").alias("path"), "text"))


@query("SRC-02", RECORDS)
def src_02(spark, sf):
    """The sink: records written to files in the shared folder and read back from them."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    M.write_records(fx.notes(spark, sf), path)
    return parsed(M.read_records(spark, path))


@query("SRC-03", twin("SELECT page_id, url, sha1(url) AS url_sha1, content_hash, length(text)::INTEGER AS n_chars, length(text) > 8000 AS truncated, md5(substr(text, 1, 8000)) AS display_md5 FROM page_versions", "page_versions"))
def src_03(spark, sf):
    return PG.snapshots(fx.table(spark, sf, "pages")).select("page_id", "url", "url_sha1", "content_hash", F.length("text").alias("n_chars"), "truncated", F.md5("display").alias("display_md5"))


@query("SRC-04", twin("SELECT DISTINCT url, content_hash FROM snapshot_log s WHERE NOT EXISTS (SELECT 1 FROM page_versions p WHERE p.url = s.url AND p.content_hash = s.content_hash AND p.page_id % 3 = 0)", "snapshot_log", "page_versions"))
def src_04(spark, sf):
    stored = fx.page_versions(spark, sf).filter("page_id % 3 = 0")
    return PG.new_snapshots(fx.snapshot_log(spark, sf), stored).select("url", "content_hash")


@query("SRC-05", twin("SELECT page_id, 'sources/' || sha1(url) || '/' || content_hash || '/content.md' AS path FROM page_versions", "page_versions"))
def src_05(spark, sf):
    return fx.page_versions(spark, sf).select("page_id", PG.snapshot_path("sources", F.col("url"), F.col("content_hash")).alias("path"))


def ledger_lines(spark, sf):
    """The token ledger as JSON lines, some of them broken."""
    js = F.to_json(F.struct("event_id", "trace_id", "step", "model", "input_tokens", "output_tokens"))
    line = F.when(F.expr("event_id % 50 = 7"), F.substring(js, 1, 40)).when(F.expr("event_id % 50 = 8"), F.lit("  ")).when(F.expr("event_id % 50 = 9"), F.lit("[1]"))
    line = line.when(F.expr("event_id % 50 = 10"), F.to_json(F.struct("event_id", "step"))).otherwise(js)
    return fx.token_ledger(spark, sf).select("event_id", line.alias("value"))


@query("SRC-06", twin("SELECT event_id, trace_id, step, input_tokens, output_tokens FROM token_ledger WHERE event_id % 50 NOT IN (7, 8, 9, 10)", "token_ledger"))
def src_06(spark, sf):
    return J.tolerant_rows(ledger_lines(spark, sf), J.LEDGER, ["trace_id", "input_tokens", "output_tokens"]).select("event_id", "trace_id", "step", "input_tokens", "output_tokens")


@query("SRC-07", twin("SELECT event_id, CASE event_id % 50 WHEN 7 THEN 'not json' WHEN 8 THEN 'blank' WHEN 9 THEN 'not an object' ELSE 'missing trace_id' END AS reason FROM token_ledger WHERE event_id % 50 IN (7, 8, 9, 10)", "token_ledger"))
def src_07(spark, sf):
    return J.violations(ledger_lines(spark, sf), ["event_id", "trace_id"]).select("event_id", "reason")


@query("SRC-08", twin("SELECT event_id, trace_id, step, model, input_tokens, output_tokens, cache_read_tokens, round(latency_ms, 6) AS latency_ms, error_type FROM token_ledger", "token_ledger"))
def src_08(spark, sf):
    return fx.token_ledger(spark, sf).select("event_id", "trace_id", "step", "model", "input_tokens", "output_tokens", "cache_read_tokens", F.round("latency_ms", 6).alias("latency_ms"), "error_type")


@query("SRC-09", twin(r"""SELECT lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0') AS doc_id, md5(regexp_replace(array_to_string(list_filter(string_split('# head' || chr(10) || text, chr(10)), lambda x: NOT starts_with(x, '#')), chr(10)), '^\s+|\s+$', '', 'g')) AS body_md5
 FROM documents WHERE source <> 'src1'"""))
def src_09(spark, sf):
    docs = fx.corpus_docs(spark, sf)
    subset = docs.filter("NOT url LIKE 'doc://src1/%'").select("doc_id")
    out, _ = J.corpus(docs.select("doc_id", "title", "url"), docs.select("doc_id", F.concat(F.lit("# head\n"), "body").alias("text")), subset)
    return out.select("doc_id", F.md5("body").alias("body_md5"))


@query("SRC-10", twin("SELECT note_id, CASE WHEN d % 3 = 0 THEN 'created' ELSE 'overwrite' END AS action, CASE WHEN d % 3 <> 0 THEN md5(body) END AS previous_md5 FROM notes0", "notes0"))
def src_10(spark, sf):
    n = notes(spark, sf)
    return J.version_history(n.filter("d % 3 <> 0"), n).select("note_id", "action", F.md5("previous_body").alias("previous_md5"))


# ---- filters ---------------------------------------------------------------------------------------
@query("FLT-01", twin("SELECT note_id, title FROM notes0 WHERE status = 'active'", "notes0"))
def flt_01(spark, sf):
    return S.by_status(notes(spark, sf)).select("note_id", "title")


@query("FLT-04", twin("SELECT n.note_id, p.url, n.src_hash = p.content_hash AS exact FROM notes n JOIN page_versions p ON p.url = n.src_url", "notes", "page_versions"))
def flt_04(spark, sf):
    cited = fx.notes(spark, sf).select("note_id", F.explode("sources").alias("s")).select("note_id", "s.url", F.col("s.content_hash").alias("recorded"))
    urls = fx.page_versions(spark, sf).select("url", "content_hash")
    return cited.join(urls, "url").select("note_id", "url", (F.col("recorded") == F.col("content_hash")).alias("exact"))


@query("FLT-05", twin("SELECT conflict_id, note_a, note_b FROM conflicts WHERE status = 'open'", "conflicts"))
def flt_05(spark, sf):
    return fx.conflicts(spark, sf).filter("status = 'open'").select("conflict_id", "note_a", "note_b")


@query("FLT-06", twin("SELECT note_id, title, substr(body, 1, 120) || CASE WHEN length(body) > 120 THEN '…' ELSE '' END AS snippet FROM notes0 WHERE status = 'active' AND kind = 'user'", "notes0"))
def flt_06(spark, sf):
    return notes(spark, sf).filter("status = 'active' AND kind = 'user'").select("note_id", "title", X.snippet(F.col("body"), 120).alias("snippet"))


_EXTRA = "concat('{{\"ledger\":\"', CASE WHEN d % 20 = 0 THEN 'unanswered' ELSE 'x' END, '\",\"run_step_key\":\"run', cast(d % 50 as {s}), '::', volatility, '\"}}')"


@query("FLT-07", twin("SELECT note_id FROM notes0 WHERE status = 'active' AND NOT tombstone AND d % 20 = 0", "notes0"))
def flt_07(spark, sf):
    n = notes(spark, sf).withColumn("extra", F.try_parse_json(F.expr(_EXTRA.format(s="string"))))
    return n.filter("status = 'active' AND NOT tombstone").filter(F.try_variant_get("extra", "$.ledger", "string") == "unanswered").select("note_id")


@query("FLT-08", twin("SELECT note_id FROM notes0 WHERE d % 50 = 7 AND volatility = 'drifting'", "notes0"))
def flt_08(spark, sf):
    n = notes(spark, sf).withColumn("extra", F.try_parse_json(F.expr(_EXTRA.format(s="string"))))
    return n.filter(F.try_variant_get("extra", "$.run_step_key", "string") == "run7::drifting").select("note_id")


@query("FLT-09", twin("""SELECT note_id, array_to_string(list_filter([CASE WHEN d % 12 = 0 THEN 'empty_body' END, CASE WHEN d % 10 = 0 OR trim(title) = '' THEN 'empty_title' END, CASE WHEN d % 10 <> 0 AND d % 14 = 0 AND length(trim(title)) > 49 THEN 'long_title' END,
   CASE WHEN d % 15 = 0 THEN 'blank_entity' END, CASE WHEN d % 16 = 0 THEN 'bad_confidence' END, CASE WHEN d % 18 = 0 THEN 'bad_kind' END, CASE WHEN importance IS NOT NULL AND d % 21 = 1 THEN 'importance_range' END], lambda x: x IS NOT NULL), ',') AS errors,
   CASE WHEN d % 6 = 0 THEN 'no_sources' WHEN d % 6 = 1 THEN 'empty_sources' ELSE '' END AS warnings FROM notes0""", "notes0"))
def flt_09(spark, sf):
    rows = notes(spark, sf).selectExpr(
        "note_id", "CASE WHEN d % 12 = 0 THEN ' ' ELSE 'x' END AS body", "CASE WHEN d % 10 = 0 THEN NULL WHEN d % 14 = 0 THEN repeat(trim(title), 4) ELSE title END AS title",
        "CASE WHEN d % 15 = 0 THEN array('a', ' ') ELSE entities END AS entities", "CASE WHEN d % 16 = 0 THEN 'sure' ELSE upper(confidence) END AS confidence", "volatility",
        "CASE WHEN d % 18 = 0 THEN 'rumour' ELSE kind END AS kind", "CASE WHEN d % 21 = 1 THEN importance + 2 ELSE importance END AS importance",
        "CASE WHEN d % 6 = 0 THEN NULL WHEN d % 6 = 1 THEN array() ELSE array('u') END AS urls",
    )
    return S.validate(rows).select("note_id", "errors", "warnings")


FOLD = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ledger, job_id ORDER BY seq DESC) AS rn FROM job_log) WHERE rn = 1"


@query("FLT-10", twin(f"SELECT ledger, job_id, status FROM ({FOLD}) WHERE status = 'failed'", "job_log"))
def flt_10(spark, sf):
    return S.fold_jobs(fx.job_log(spark, sf), ["ledger", "job_id"]).filter("status = 'failed'").select("ledger", "job_id", "status")


@query("AG-16", twin(f"SELECT ledger, job_id, seq, status, attempt FROM ({FOLD})", "job_log"))
def ag_16(spark, sf):
    return S.fold_jobs(fx.job_log(spark, sf), ["ledger", "job_id"]).select("ledger", "job_id", "seq", "status", "attempt")


# ---- set operations --------------------------------------------------------------------------------
@query("ST-01", twin("""SELECT a.note_id, a.src_url || '#' || a.src_hash || CASE WHEN b.src_url = a.src_url AND b.src_hash = a.src_hash THEN '' ELSE '|' || b.src_url || '#' || b.src_hash END AS refs,
  CASE WHEN b.src_url = a.src_url AND b.src_hash = a.src_hash THEN 0 ELSE 1 END::INTEGER AS added FROM notes a JOIN notes b ON b.d = a.d + 37""", "notes"))
def st_01(spark, sf):
    n = fx.notes(spark, sf).select("d", "note_id", "sources")
    o = n.select((F.col("d") - 37).alias("d"), F.col("sources").alias("other"))
    u = S.union_refs(F.col("sources"), F.col("other"))
    return n.join(o, "d").select("note_id", F.array_join(F.transform(u, lambda s: F.concat(s["url"], F.lit("#"), s["content_hash"])), "|").alias("refs"), (F.size(u) - F.size("sources")).alias("added"))


@query("ST-02", twin(f"""SELECT a.note_id, array_to_string(list_filter(u, lambda x, i: list_position(s, s[i]) = i), '|') AS entities FROM (
 SELECT a.note_id, list_concat(a.entities, [upper(b.source), b.entities[2]]) AS u, list_transform(list_concat(a.entities, [upper(b.source), b.entities[2]]), lambda y: {slug_sql('y')}) AS s FROM notes0 a JOIN notes0 b ON b.d = a.d + 1) a""", "notes0"))
def st_02(spark, sf):
    n = notes(spark, sf).select("d", "note_id", "entities")
    o = n.select((F.col("d") - 1).alias("d"), F.array(F.upper(F.col("entities")[0]), F.col("entities")[1]).alias("other"))
    return n.join(o, "d").select("note_id", F.array_join(S.union_entities(F.col("entities"), F.col("other")), "|").alias("entities"))


@query("ST-03", twin("SELECT DISTINCT trace_id, step, model FROM token_ledger", "token_ledger"))
def st_03(spark, sf):
    return fx.token_ledger(spark, sf).select("trace_id", "step", "model").dropDuplicates()


def index_rows(spark, sf):
    n = with_fingerprint(notes(spark, sf))
    kept = n.filter("d % 41 <> 0").selectExpr(
        "note_id", "CASE WHEN d % 47 = 0 THEN 'superseded' ELSE status END AS status", "CASE WHEN d % 59 = 0 THEN '' WHEN d % 43 = 0 THEN 'other' ELSE fingerprint END AS fingerprint"
    )
    return kept.unionByName(n.filter("d % 53 = 0").selectExpr("concat('X-', note_id) AS note_id", "status", "fingerprint"))


@query("ST-04", twin("SELECT 'missing' AS side, note_id FROM notes0 WHERE d % 41 = 0 UNION ALL SELECT 'extra', 'X-' || note_id FROM notes0 WHERE d % 53 = 0", "notes0"))
def st_04(spark, sf):
    s, i = notes(spark, sf).select("note_id"), index_rows(spark, sf).select("note_id")
    return s.exceptAll(i).select(F.lit("missing").alias("side"), "note_id").unionByName(i.exceptAll(s).select(F.lit("extra").alias("side"), "note_id"))


@query("JN-12", twin("""SELECT note_id, reason FROM (SELECT note_id, concat_ws(',', CASE WHEN d % 41 = 0 THEN 'missing' END, CASE WHEN d % 41 <> 0 AND d % 47 = 0 AND status <> 'superseded' THEN 'status' END,
   CASE WHEN d % 41 <> 0 AND d % 59 = 0 THEN 'legacy' END, CASE WHEN d % 41 <> 0 AND d % 59 <> 0 AND d % 43 = 0 THEN 'changed' END) AS reason FROM notes0
 UNION ALL SELECT 'X-' || note_id, 'extra' FROM notes0 WHERE d % 53 = 0) WHERE reason <> ''""", "notes0"))
def jn_12(spark, sf):
    return L.index_drift(with_fingerprint(notes(spark, sf)), index_rows(spark, sf))


# ---- entities --------------------------------------------------------------------------------------
def registry(spark, sf):
    src = fx.table(spark, sf, "documents").select("source").distinct()
    return src.select(X.slugify(F.col("source")).alias("entity_id"), F.col("source").alias("name"), F.array(F.concat(F.lit("Source "), "source")).alias("aliases"))


ob.cte("registry", f"SELECT DISTINCT {slug_sql('source')} AS entity_id, source AS name, 'Source ' || source AS alias FROM documents")
ob.cte("aliases", "SELECT lower(trim(unnest([entity_id, name, alias]))) AS alias_key, min(entity_id) AS entity_id FROM registry GROUP BY 1", "registry", materialized=True)
_SPELL = "CASE doc_id % 4 WHEN 0 THEN concat(' ', upper(source), ' ') WHEN 1 THEN concat('source ', source) WHEN 2 THEN concat('topic ', cast(doc_id % 37 as {s})) ELSE concat(source, '!') END"


@query("JN-05", twin(f"SELECT doc_id, name, a.entity_id FROM (SELECT doc_id, {_SPELL.format(s='varchar')} AS name FROM documents) LEFT JOIN aliases a ON a.alias_key = lower(trim(name))", "aliases"))
def jn_05(spark, sf):
    m = fx.table(spark, sf, "documents").select("doc_id", F.expr(_SPELL.format(s="string")).alias("name"))
    return E.resolve(m, E.alias_table(registry(spark, sf))).select("doc_id", "name", "entity_id")


@query("JN-06", twin(f"""WITH m AS (SELECT trim({_SPELL.format(s='varchar')}) AS name, min(doc_id) AS seen_at FROM documents GROUP BY 1),
 p AS (SELECT m.*, lower(trim(name)) AS alias_key, coalesce(a.entity_id, {slug_sql('name')}) AS entity_id FROM m LEFT JOIN aliases a ON a.alias_key = lower(trim(m.name))),
 g AS (SELECT entity_id, arg_min(name, seen_at) AS first_name, list_distinct(list(alias_key)) AS seen FROM p GROUP BY 1)
 SELECT coalesce(r.entity_id, g.entity_id) AS entity_id, coalesce(r.name, g.first_name) AS name,
   array_to_string(list_sort(list_filter(coalesce(seen, []), lambda k: k <> lower(trim(coalesce(r.name, g.first_name))) AND (r.alias IS NULL OR k <> lower(trim(r.alias))))), '|') AS added, r.name IS NULL AS is_new
 FROM registry r FULL JOIN g USING (entity_id)""", "registry", "aliases"))
def jn_06(spark, sf):
    m = fx.table(spark, sf, "documents").select(F.expr(_SPELL.format(s="string")).alias("name"), F.col("doc_id").alias("seen_at"))
    return E.upsert(registry(spark, sf), m).select("entity_id", "name", F.array_join("added_aliases", "|").alias("added"), "is_new")


@query("JN-07", twin("""SELECT note_id, count(*) FILTER (p.url IS NOT NULL)::BIGINT AS kept, count(*) FILTER (p.url IS NULL)::BIGINT AS dropped FROM (
 SELECT note_id, d % 10 AS run, unnest(CASE WHEN d % 3 = 0 THEN [src_url, 'http://outside/' || d::VARCHAR] ELSE [src_url] END) AS url FROM notes) c
 LEFT JOIN (SELECT DISTINCT page_id % 10 AS run, url FROM page_versions WHERE page_id % 3 <> 0) p ON p.run = c.run AND p.url = c.url GROUP BY note_id""", "notes", "page_versions"))
def jn_07(spark, sf):
    n = fx.notes(spark, sf).withColumn("urls", F.expr("CASE WHEN d % 3 = 0 THEN array(sources[0].url, concat('http://outside/', cast(d as string))) ELSE array(sources[0].url) END"))
    cand = n.select("note_id", F.expr("d % 10").alias("run"), F.explode("urls").alias("url"))
    pool = fx.page_versions(spark, sf).filter("page_id % 3 <> 0").selectExpr("page_id % 10 AS run", "url", "content_hash").dropDuplicates(["run", "url"])
    return S.match_pool(cand, pool).groupBy("note_id").agg(F.count_if("in_pool").alias("kept"), F.count_if(~F.col("in_pool")).alias("dropped"))


@query("AG-17", twin(f"""WITH e AS (SELECT DISTINCT note_id, {slug_sql('x')} AS entity_id FROM (SELECT note_id, unnest(entities) AS x FROM notes0 WHERE trim(body) <> '')),
 b AS (SELECT entity_id, count(*)::BIGINT AS n_notes FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
 SELECT DISTINCT b.entity_id, n_notes, r.entity_id AS related_id FROM b JOIN e USING (entity_id) JOIN e r USING (note_id)""", "notes0"))
def ag_17(spark, sf):
    return S.page_groups(notes(spark, sf))


# ---- ids, history, snapshots -----------------------------------------------------------------------
@query("WN-10", twin(f"SELECT doc_id, {nid('(SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY source, doc_id)')} AS new_id FROM documents"))
def wn_10(spark, sf):
    rows = fx.table(spark, sf, "documents").select("source", "doc_id")
    return S.allocate_ids(rows, ["source", "doc_id"], notes(spark, sf), digits=6).select("doc_id", "new_id")


@query("WN-15", "SELECT user_id, event_id, rn::INTEGER AS from_end FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 50")
def wn_15(spark, sf):
    return top_rows(fx.table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 50, "from_end")


@query("WN-05", twin("""SELECT l.url, l.content_hash, strftime(l.fetched_at, '%Y-%m-%d') AS fetched_day, coalesce(c.n, 0)::BIGINT AS n_changes FROM latest_snapshot l LEFT JOIN (SELECT url, count(*) AS n FROM (
 SELECT url, content_hash, lag(content_hash) OVER (PARTITION BY url ORDER BY fetched_at, content_hash) AS p FROM snapshot_log) WHERE p <> content_hash GROUP BY url) c USING (url)""", "latest_snapshot", "snapshot_log"))
def wn_05(spark, sf):
    log = fx.snapshot_log(spark, sf)
    n = PG.change_points(log).groupBy("url").agg(F.count("*").alias("n_changes"))
    return PG.latest_by_url(log).join(n, "url", "left").select("url", "content_hash", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_day"), F.coalesce("n_changes", F.lit(0)).cast("bigint").alias("n_changes"))


# ---- freshness -------------------------------------------------------------------------------------
_c, _r, _u, _f = ts("source_changed_at"), ts("reviewed_at"), ts("valid_until"), ts("valid_from")


def state_sql(half: str, review: str, stale: str) -> str:
    dec = f"(CASE WHEN {half} IS NULL OR age_days <= 0 THEN 1.0::DOUBLE ELSE pow(0.5::DOUBLE, age_days / {half}) END)"
    return f"""SELECT *, CASE WHEN rule = 'fresh' AND pending THEN 'review_due' ELSE rule END AS state,
   concat_ws(',', 'base:' || base_field, how, CASE WHEN pending THEN 'source_changed' WHEN c IS NOT NULL THEN 'source_change_reviewed' END) AS reasons FROM (
  SELECT *, {dec} AS decay, {half} AS half_life_days, (c IS NOT NULL AND (r IS NULL OR c > r)) AS pending,
   CASE WHEN {NOW} > u THEN 'expired' WHEN {NOW} < f THEN 'not_yet_valid' WHEN base IS NULL THEN 'no_base_time' WHEN {half} IS NULL THEN 'no_decay' WHEN {dec} <= {stale} THEN 'decay_stale' WHEN {dec} <= {review} THEN 'decay_due' ELSE 'decay_fresh' END AS how,
   CASE WHEN {NOW} > u THEN 'stale' WHEN {NOW} < f THEN 'review_due' WHEN base IS NULL THEN 'review_due' WHEN {half} IS NULL THEN 'fresh' WHEN {dec} <= {stale} THEN 'stale' WHEN {dec} <= {review} THEN 'review_due' ELSE 'fresh' END AS rule
  FROM (SELECT *, {_c} AS c, {_r} AS r, {_u} AS u, {_f} AS f, {BASE_SQL} AS base, CASE WHEN {ts('observed_at')} IS NOT NULL THEN 'observed_at' WHEN {ts('created')} IS NOT NULL THEN 'created' ELSE 'none' END AS base_field,
   CASE WHEN {BASE_SQL} IS NULL THEN 0.0 ELSE greatest(0.0, {AGE_SQL}) END::DOUBLE AS age_days FROM notes0))"""


ob.cte("fresh_states", state_sql(HALF_SQL, "0.5", "0.25"), "notes0", materialized=True)
ob.cte(
    "kind_states",
    state_sql("(CASE WHEN kind = 'user' THEN (CASE volatility WHEN 'volatile' THEN 10.0::DOUBLE WHEN 'drifting' THEN 120.0::DOUBLE END) ELSE (CASE volatility WHEN 'volatile' THEN 30.0::DOUBLE WHEN 'drifting' THEN 120.0::DOUBLE END) END)",
              "(CASE WHEN kind = 'user' THEN 0.7 ELSE 0.5 END)", "(CASE WHEN kind = 'user' THEN 0.7 ELSE 0.25 END)"),
    "notes0", materialized=True,
)


@query("TMP-01", twin("SELECT note_id, state, round(age_days, 6) AS age_days, half_life_days, round(decay, 6) AS decay, reasons FROM fresh_states", "fresh_states"))
def tmp_01(spark, sf):
    s = FR.with_freshness(notes(spark, sf), fx.NOW)
    return s.select("note_id", "state", F.round("age_days", 6).alias("age_days"), "half_life_days", F.round("decay", 6).alias("decay"), F.array_join("reasons", ",").alias("reasons"))


@query("TMP-02", twin("SELECT note_id, kind, state, half_life_days FROM kind_states", "kind_states"))
def tmp_02(spark, sf):
    cfg = T.FreshnessSettings.layered({"drifting": 120}, per_kind={"user": {"review_ratio": 0.7, "stale_ratio": 0.9, "half_life_days": {"volatile": 10.0}}})
    return FR.with_freshness(notes(spark, sf), fx.NOW, cfg).select("note_id", "kind", "state", "half_life_days")


def active_states(spark, sf):
    return FR.with_freshness(notes(spark, sf).filter("status = 'active'"), fx.NOW)


@query("TMP-03", twin("SELECT state, count(*)::BIGINT AS n, round(max(age_days), 6) AS oldest, min(note_id) AS first_id FROM fresh_states WHERE status = 'active' GROUP BY state", "fresh_states"))
def tmp_03(spark, sf):
    return active_states(spark, sf).groupBy("state").agg(F.count("*").alias("n"), F.round(F.max("age_days"), 6).alias("oldest"), F.min("note_id").alias("first_id"))


@query("TK-03", twin("SELECT note_id, state, row_number() OVER (ORDER BY CASE state WHEN 'stale' THEN 0 ELSE 1 END, age_days DESC, note_id)::BIGINT AS queue_pos FROM fresh_states WHERE status = 'active' AND state <> 'fresh'", "fresh_states"))
def tk_03(spark, sf):
    return FR.review_queue(active_states(spark, sf)).select("note_id", "state", "queue_pos")


@query("AG-10", twin("SELECT count(*) FILTER (state = 'fresh')::BIGINT AS fresh, count(*) FILTER (state = 'review_due')::BIGINT AS review_due, count(*) FILTER (state = 'stale')::BIGINT AS stale FROM fresh_states WHERE status = 'active'", "fresh_states"))
def ag_10(spark, sf):
    return FR.state_counts(active_states(spark, sf))


@query("AG-21", twin(f"SELECT count(*) FILTER ({_c} IS NOT NULL AND ({_r} IS NULL OR {_c} > {_r}))::BIGINT AS pending FROM notes0 WHERE status = 'active'", "notes0"))
def ag_21(spark, sf):
    return FR.source_change_pending(notes(spark, sf).filter("status = 'active'"))


MARKS = """SELECT n.note_id, l.url, l.content_hash FROM notes n JOIN latest_snapshot l ON l.url = n.src_url WHERE n.status = 'active' AND n.src_hash <> l.content_hash AND d % 18 <> 0"""


def marks_of(spark, sf):
    n, latest = fx.notes(spark, sf), PG.latest_by_url(fx.snapshot_log(spark, sf))
    done = n.filter("d % 18 = 0").select("note_id", F.explode("sources").alias("s")).select("note_id", "s.url").join(latest, "url").select("note_id", "url", "content_hash")
    return FR.source_change_marks(n, latest, done, fx.NOW)


@query("JN-13", twin(MARKS, "notes", "latest_snapshot"))
def jn_13(spark, sf):
    return marks_of(spark, sf).select("note_id", "url", "content_hash")


@query("TMP-04", twin(f"SELECT note_id, max(content_hash) AS content_hash, count(*)::BIGINT AS n_slots FROM ({MARKS}) GROUP BY note_id", "notes", "latest_snapshot"))
def tmp_04(spark, sf):
    slots = marks_of(spark, sf).groupBy("note_id", "url").agg(F.max_by("content_hash", "marked_at").alias("content_hash"))
    return slots.groupBy("note_id").agg(F.max("content_hash").alias("content_hash"), F.count("*").alias("n_slots"))


@query("JN-08", twin("SELECT DISTINCT note_id, src_url AS url, src_hash AS content_hash FROM notes n WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM snapshot_log s WHERE s.url = n.src_url AND s.content_hash = n.src_hash)", "notes", "snapshot_log"))
def jn_08(spark, sf):
    return L.dangling_evidence(fx.notes(spark, sf), fx.snapshot_log(spark, sf))


# ---- lint ------------------------------------------------------------------------------------------
ob.cte(
    "page_lines",
    f"""SELECT page_id, line_no::INTEGER AS line_no, line, fence, (sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no)) % 2 = 1 AS inside FROM (
   SELECT page_id, line, line_no, regexp_matches(trim(line), '^(```|~~~)') AS fence FROM (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT page_id, string_split(body, chr(10)) AS ls FROM wiki_pages)))""",
    "wiki_pages", materialized=True,
)
ob.cte("assertions", f"SELECT page_id, line_no, trim(line) AS line, regexp_matches(line, '\\bN-\\d+\\b') AS cited FROM page_lines WHERE NOT fence AND NOT inside AND {ASSERTION_SQL.format('line')}", "page_lines", materialized=True)
_refs = r"list_distinct(regexp_extract_all(body, '\bN-\d+\b'))"
ob.cte("refs", f"SELECT 'page:' || page_id AS source, unnest({_refs}) AS ref FROM wiki_pages UNION ALL SELECT 'note:' || note_id, ref FROM (SELECT note_id, unnest({_refs}) AS ref FROM lint_notes) WHERE ref <> note_id", "wiki_pages", "lint_notes", materialized=True)
ob.cte("resolved_refs", "SELECT source, ref, c.canonical_id, coalesce(c.outcome, 'missing') AS outcome FROM refs LEFT JOIN chains c ON c.note_id = ref", "refs", "chains", materialized=True)
_ents = r"list_distinct(regexp_extract_all(body, '\[\[entity:([^\]|]+?)(?:\|[^\]]*)?\]\]', 1))"
ob.cte(
    "broken",
    f"""SELECT 'note' AS kind, source, ref AS target, outcome AS reason FROM resolved_refs WHERE outcome <> 'active'
 UNION ALL SELECT 'entity', source, slug, 'unregistered' FROM (SELECT 'page:' || page_id AS source, unnest({_ents}) AS slug FROM wiki_pages UNION ALL SELECT 'note:' || note_id, unnest({_ents}) FROM lint_notes) WHERE lower(trim(slug)) NOT IN (SELECT alias_key FROM aliases)""",
    "resolved_refs", "wiki_pages", "lint_notes", "aliases", materialized=True,
)
ob.cte("orphan_notes", "SELECT note_id FROM notes0 WHERE status = 'active' AND note_id NOT IN (SELECT canonical_id FROM resolved_refs WHERE outcome = 'active' AND source LIKE 'page:%')", "notes0", "resolved_refs")


@query("WN-06", twin("SELECT page_id, line_no, line, cited FROM assertions", "assertions"))
def wn_06(spark, sf):
    return L.assertion_lines(fx.wiki_pages(spark, sf))


@query("AG-12", twin("SELECT count(*)::BIGINT AS assertion_lines, count(*) FILTER (cited)::BIGINT AS cited_lines, round(coalesce(count(*) FILTER (cited)::DOUBLE / nullif(count(*), 0), 1.0), 6) AS coverage FROM assertions", "assertions"))
def ag_12(spark, sf):
    return L.citation_coverage(fx.wiki_pages(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query("LNT-02", twin("SELECT page_id, line_no, line FROM assertions WHERE NOT cited", "assertions"))
def lnt_02(spark, sf):
    return L.uncited_lines(fx.wiki_pages(spark, sf))


def lint_inputs(spark, sf):
    return fx.wiki_pages(spark, sf), fx.lint_notes(spark, sf), chains(spark, sf)


@query("JN-09", ranked_twin("SELECT kind, source, target, reason FROM broken", "broken"))
def jn_09(spark, sf):
    p, n, c = lint_inputs(spark, sf)
    return L.broken_links(p, n, c, E.alias_table(registry(spark, sf)))


@query("JN-10", ranked_twin("SELECT note_id FROM orphan_notes", "orphan_notes"))
def jn_10(spark, sf):
    return L.orphans(*lint_inputs(spark, sf))


@query("JN-11", ranked_twin("SELECT source, ref AS referenced, canonical_id FROM resolved_refs WHERE outcome = 'active' AND ref <> canonical_id", "resolved_refs"))
def jn_11(spark, sf):
    return L.merged_references(*lint_inputs(spark, sf))


@query("LNT-01", ranked_twin(f"""SELECT (SELECT count(*) FROM orphan_notes)::BIGINT AS orphans, (SELECT count(*) FROM broken)::BIGINT AS broken, (SELECT count(*) FROM resolved_refs WHERE outcome = 'active' AND ref <> canonical_id)::BIGINT AS merged_refs,
  round(coalesce((SELECT count(*) FILTER (cited)::DOUBLE / nullif(count(*), 0) FROM assertions), 1.0), 6) AS coverage, (SELECT count(*) FROM fresh_states WHERE status = 'active' AND state = 'stale')::BIGINT AS stale,
  (SELECT count(*) FROM conflicts WHERE status = 'open')::BIGINT AS conflicts_open, (SELECT count(*) FROM notes0 WHERE tombstone)::BIGINT AS tombstones,
  (SELECT count(*) FROM (SELECT DISTINCT note_id, src_url, src_hash FROM notes n WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM snapshot_log s WHERE s.url = n.src_url AND s.content_hash = n.src_hash)))::BIGINT AS dangling,
  (SELECT count(*) FILTER ({_c} IS NOT NULL AND ({_r} IS NULL OR {_c} > {_r})) FROM notes0 WHERE status = 'active')::BIGINT AS source_changed_pending, false AS healthy""",
    "orphan_notes", "broken", "resolved_refs", "assertions", "fresh_states", "conflicts", "notes", "snapshot_log"))
def lnt_01(spark, sf):
    p, n, c = lint_inputs(spark, sf)
    base = fx.notes(spark, sf)
    def count(df, name):
        return df.agg(F.count("*").alias(name))
    parts = [
        count(L.orphans(p, n, c), "orphans"), count(L.broken_links(p, n, c, E.alias_table(registry(spark, sf))), "broken"), count(L.merged_references(p, n, c), "merged_refs"),
        L.citation_coverage(p).select(F.round("coverage", 6).alias("coverage")), FR.state_counts(active_states(spark, sf)).select("stale"),
        count(fx.conflicts(spark, sf).filter("status = 'open'"), "conflicts_open"), count(base.filter("tombstone"), "tombstones"),
        count(L.dangling_evidence(base, fx.snapshot_log(spark, sf)), "dangling"), FR.source_change_pending(base.filter("status = 'active'")).withColumnRenamed("pending", "source_changed_pending"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x), F.lit(True))  # one row each
    return out.withColumn("healthy", (F.col("broken") == 0) & (F.col("coverage") > 0))


def page_texts(spark, sf):
    """The notes a page is written from: its document's, and the one 37 further on."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(F.col("doc_id"), F.col("doc_id") - 37)).alias("page"))
    return docs.filter("page >= 0").select(F.concat(F.lit("P-"), F.col("page").cast("string")).alias("page_id"), F.expr(fx.nid("doc_id")).alias("note_id"), "text")


_grams = r"CASE WHEN length(w) >= 2 THEN list_distinct(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) WHEN w <> '' THEN [w] ELSE [] END"
ob.cte("page_texts", f"SELECT page_id, note_id, {_grams} AS g FROM (SELECT 'P-' || page::VARCHAR AS page_id, {nid('doc_id')} AS note_id, regexp_replace(text, '\\s+', '', 'g') AS w FROM (SELECT doc_id, text, unnest([doc_id, doc_id - 37]) AS page FROM documents) WHERE page >= 0)")
ob.cte(
    "best_notes",
    f"""SELECT page_id, line_no, note_id, score FROM (SELECT page_id, line_no, note_id, n_both::DOUBLE / least(nl, nt) AS score, row_number() OVER (PARTITION BY page_id, line_no ORDER BY n_both::DOUBLE / least(nl, nt) DESC, note_id) AS rn
  FROM (SELECT l.page_id, l.line_no, t.note_id, l.n AS nl, t.n AS nt, count(*) AS n_both FROM (SELECT page_id, line_no, len(g) AS n, unnest(g) AS gram FROM (SELECT page_id, line_no, {_grams} AS g FROM (SELECT page_id, line_no, regexp_replace(line, '\\s+', '', 'g') AS w FROM assertions WHERE NOT cited))) l
   JOIN (SELECT page_id, note_id, len(g) AS n, unnest(g) AS gram FROM page_texts) t USING (page_id, gram) GROUP BY ALL)) WHERE rn = 1""",
    "assertions", "page_texts", materialized=True,
)


@query("TK-05", twin("SELECT page_id, line_no, note_id, round(score, 6) AS score FROM best_notes", "best_notes"))
def tk_05(spark, sf):
    return L.best_notes(L.uncited_lines(fx.wiki_pages(spark, sf)), page_texts(spark, sf)).withColumn("score", F.round("score", 6))


@query("LNT-03", twin("""SELECT p.page_id, p.line_no, CASE WHEN a.page_id IS NOT NULL THEN rtrim(p.line) || '（' || coalesce(b.note_id, (SELECT min(note_id) FROM page_texts t WHERE t.page_id = p.page_id)) || '）' ELSE p.line END AS line
 FROM page_lines p LEFT JOIN (SELECT page_id, line_no FROM assertions WHERE NOT cited) a USING (page_id, line_no) LEFT JOIN best_notes b USING (page_id, line_no) WHERE NOT fence""", "page_lines", "assertions", "best_notes", "page_texts"))
def lnt_03(spark, sf):
    out = L.annotate_citations(fx.wiki_pages(spark, sf), page_texts(spark, sf))
    fences = fx.wiki_pages(spark, sf).select("page_id", F.posexplode(F.split("body", "\n")).alias("p", "line")).filter(F.trim("line").rlike("^(```|~~~)")).selectExpr("page_id", "p + 1 AS line_no")
    return out.join(fences, ["page_id", "line_no"], "left_anti")


@query("LNT-04", twin(r"""SELECT note_id AS id, md5(b || CASE WHEN regexp_matches(b, '\[\[entity:src3\|') OR source <> 'src3' THEN '' ELSE chr(10) || '## Related entities' || chr(10) || chr(10) || '- [[entity:src3|src3]]' || chr(10) END) AS body_md5
 FROM (SELECT note_id, source, regexp_replace(body, '\[\[entity:nowhere\|([^\]]*)\]\]', '\1', 'g') AS b FROM lint_notes)""", "lint_notes"))
def lnt_04(spark, sf):
    n = fx.lint_notes(spark, sf)
    fixed = L.repair_links(n.select(F.col("note_id").alias("id"), "body"), E.alias_table(registry(spark, sf)))
    wanted = n.filter("entities[0] = 'src3'").select(F.col("note_id").alias("id"), F.lit("src3").alias("entity_id"), F.lit("src3").alias("name"))
    return L.ensure_links(fixed, wanted).select("id", F.md5("body").alias("body_md5"))


@query("LNT-05", twin(f"SELECT 'P-' || page::VARCHAR AS page_id, md5('# ' || page::VARCHAR || chr(10) || string_agg('- ' || text || '（' || {nid('doc_id')} || '）', chr(10) ORDER BY doc_id)) AS page_md5 FROM (SELECT doc_id, text, unnest([doc_id, doc_id - 37]) AS page FROM documents) WHERE page >= 0 GROUP BY page"))
def lnt_05(spark, sf):
    t = page_texts(spark, sf).withColumn("item", F.concat(F.lit("- "), F.col("text"), F.lit("（"), "note_id", F.lit("）")))
    g = t.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("note_id", "item"))).alias("xs"))  # two items per page at most
    return g.select("page_id", F.md5(F.concat(F.lit("# "), F.substring("page_id", 3, 100), F.lit("\n"), F.array_join("xs.item", "\n"))).alias("page_md5"))


@query("AG-11", twin("""SELECT count(*)::BIGINT AS notes, count(*) FILTER (status = 'active')::BIGINT AS active, count(*) FILTER (status = 'merged')::BIGINT AS merged, count(*) FILTER (status = 'superseded')::BIGINT AS superseded,
  (SELECT count(*) FROM wiki_pages)::BIGINT AS pages, (SELECT count(*) FROM registry)::BIGINT AS entities, (SELECT count(*) FROM conflicts WHERE status = 'open')::BIGINT AS conflicts_open, (SELECT count(*) FROM conflicts WHERE status = 'resolved')::BIGINT AS conflicts_resolved FROM notes0""",
    "notes0", "wiki_pages", "registry", "conflicts"))
def ag_11(spark, sf):
    n = notes(spark, sf).agg(F.count("*").alias("notes"), *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "merged", "superseded")])
    c = fx.conflicts(spark, sf).agg(*[F.count_if(F.col("status") == s).alias(f"conflicts_{s}") for s in ("open", "resolved")])
    p, e = fx.wiki_pages(spark, sf).agg(F.count("*").alias("pages")), registry(spark, sf).agg(F.count("*").alias("entities"))
    return n.join(F.broadcast(p), F.lit(True)).join(F.broadcast(e), F.lit(True)).join(F.broadcast(c), F.lit(True))


# ---- change feed -----------------------------------------------------------------------------------
ob.cte("changed", f"SELECT *, greatest({ts('created')}, {_r}) AS updated, CASE WHEN status <> 'active' THEN 'status' WHEN {_r} > {ts('created')} THEN 'reviewed' ELSE 'created' END AS change_kind FROM notes0", "notes0", materialized=True)
SINCE, LIMIT = "2024-06-01 00:00:00", 25
_page = f"""WITH m AS (SELECT * FROM changed WHERE updated > TIMESTAMP '{SINCE}'), e AS (SELECT max(updated) AS edge FROM (SELECT updated FROM m ORDER BY updated LIMIT {LIMIT})), t AS (SELECT count(*) AS total FROM m)"""


@query("CF-01", twin(_page + f"""SELECT note_id, strftime(updated, '%Y-%m-%d') AS updated, change_kind, total::BIGINT AS total, total > {LIMIT} AS has_more, CASE WHEN total > {LIMIT} THEN strftime(edge, '%Y-%m-%d') END AS next_since
 FROM m, e, t WHERE total <= {LIMIT} OR updated <= edge""", "changed"))
def cf_01(spark, sf):
    p = CH.list_changes(notes(spark, sf), SINCE, LIMIT)
    return p.select("note_id", F.date_format("updated", "yyyy-MM-dd").alias("updated"), "change_kind", "total", "has_more", F.date_format("next_since", "yyyy-MM-dd").alias("next_since"))


@query("TK-07", twin(_page + f"SELECT note_id FROM m, e, t WHERE total <= {LIMIT} OR updated <= edge", "changed"))
def tk_07(spark, sf):
    return CH.list_changes(notes(spark, sf), SINCE, LIMIT).select("note_id")


@query("CF-02", ranked_twin(f"""SELECT coalesce(c.canonical_id, n.note_id) AS lineage, n.note_id, (CASE WHEN c.outcome = 'active' THEN -c.hops ELSE 0 END)::INTEGER AS topo, k AS change_kind, strftime(at_ts, '%Y-%m-%d') AS at FROM (
  SELECT note_id, 'created' AS k, {ts('created')} AS at_ts FROM notes0 UNION ALL SELECT note_id, 'reviewed', {_r} FROM notes0 WHERE status = 'active' AND {_r} > {ts('created')} UNION ALL SELECT note_id, 'status', greatest({ts('created')}, {_r}) FROM notes0 WHERE status <> 'active') n JOIN chains c USING (note_id)""", "chains", "notes0"))
def cf_02(spark, sf):
    return CH.timeline(notes(spark, sf), chains(spark, sf)).select("lineage", "note_id", "topo", "change_kind", F.date_format("at", "yyyy-MM-dd").alias("at"))


@query("CF-03", ranked_twin("SELECT canonical_id, note_id, row_number() OVER (PARTITION BY canonical_id ORDER BY hops DESC, note_id)::BIGINT AS version FROM chains WHERE outcome = 'active'", "chains"))
def cf_03(spark, sf):
    return CH.version_order(chains(spark, sf))
