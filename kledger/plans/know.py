"""Evidence comparison (VER), ingest (ING), memory update (UPD) and consolidation (CON)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.functions import vectors as V
from kledger.operators import consolidate as CO
from kledger.operators import evidence as EV
from kledger.operators import ingest as I
from kledger.operators import pairs as PR
from kledger.operators import update as U
from kledger.operators.blocks import score_cosine, top_matches, top_matches_grouped
from kledger.plans import fixtures as fx
from kledger.plans import oracle_base as ob
from kledger.plans.fn import BASE_SQL, SPECIFICS_SQL, slug_sql
from kledger.plans.oracle_base import cosine, nid, ts
from kledger.plans.oracle_base import ranked_twin as twin
from kledger.plans.registry import query
from kledger.session import written
from kledger.sources import pages as PG

# ---- evidence fixture ------------------------------------------------------------------------------


def facts(d: str, s: str) -> str:
    c = lambda e: f"cast({e} as {s})"
    return (
        f"concat(' Released 2024-0', {c(f'({d}) % 9 + 1')}, '-15 version 1.', {c(f'({d}) % 4')}, ' window ', {c(f'128 + ({d}) % 3')}, 'k share ', {c(f'90 + ({d}) % 5')}, '% limit ', {c(f'({d}) % 6')},"
        f" ' items 共 3 个', CASE WHEN ({d}) % 5 = 0 THEN ' version 9.9' ELSE '' END)"
    )


def evidence_pairs(spark, sf):
    n = fx.notes(spark, sf)
    other = n.select((F.col("d") - 37).alias("d"), F.col("body").alias("other"))
    df = n.join(other, "d", "left").withColumn("other", F.coalesce("other", F.lit("")))
    f0, f1 = facts("d", "string"), facts("d + 1", "string")
    ev = f"CASE d % 4 WHEN 0 THEN concat(body, {f0}) WHEN 1 THEN concat(body, {f1}) WHEN 2 THEN concat(other, {f0}) ELSE concat(body, {f0}, ' 第3章 extra 77 points') END"
    return df.selectExpr(
        "d", "note_id AS pair_id", "note_id AS prior_id", "concat('E-', cast(d as string)) AS evidence_id", f"concat(body, {f0}) AS prior_text", f"{ev} AS evidence_text", "entities AS prior_entities",
        "CASE WHEN d % 7 = 0 THEN array('other') WHEN d % 11 = 0 THEN array() ELSE entities END AS evidence_entities", "sources",
        "CASE WHEN d % 2 = 0 THEN sources[0].url ELSE '' END AS source_url", "CASE WHEN d % 16 = 0 THEN '' WHEN d % 12 = 0 THEN 'newhash' ELSE sources[0].content_hash END AS content_hash",
        "source_changed_at", "observed_at", "created", "CASE d % 3 WHEN 1 THEN '2025-06-01T00:00:00' WHEN 2 THEN '2023-01-01T00:00:00' END AS evidence_observed_at", "status",
    )


ob.cte(
    "ev_pairs",
    f"""SELECT d, note_id AS pair_id, note_id AS prior_id, 'E-' || d::VARCHAR AS evidence_id, body || {facts('d', 'varchar')} AS prior_text,
  CASE d % 4 WHEN 0 THEN body || {facts('d', 'varchar')} WHEN 1 THEN body || {facts('d + 1', 'varchar')} WHEN 2 THEN other || {facts('d', 'varchar')} ELSE body || {facts('d', 'varchar')} || ' 第3章 extra 77 points' END AS evidence_text,
  entities AS prior_entities, CASE WHEN d % 7 = 0 THEN ['other'] WHEN d % 11 = 0 THEN []::VARCHAR[] ELSE entities END AS evidence_entities, src_url, src_hash,
  CASE WHEN d % 2 = 0 THEN src_url ELSE '' END AS source_url, CASE WHEN d % 16 = 0 THEN '' WHEN d % 12 = 0 THEN 'newhash' ELSE src_hash END AS content_hash, source_changed_at, observed_at, created,
  CASE d % 3 WHEN 1 THEN '2025-06-01T00:00:00' WHEN 2 THEN '2023-01-01T00:00:00' END AS evidence_observed_at, status
 FROM (SELECT a.*, coalesce(b.body, '') AS other FROM notes a LEFT JOIN notes0 b ON b.d = a.d + 37)""",
    "notes", "notes0", materialized=True,
)
# The rule of the fact scan in SQL: five searches, each over the whole text, and one sweep over what they found.
SEARCHES = [
    ("date", r"[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9]{4}\s*年\s*[0-9]{1,2}\s*月(?:\s*[0-9]{1,2}\s*日)?"), ("chapter", r"第\s*[0-9]+\s*[章节条款]|(?:[Cc]hapter|CH)\s*[0-9]+"),
    ("version", r"[vV]?[0-9]+(?:\.[0-9]+)+(?:[-.][A-Za-z][\w.]*)?"), ("percent", r"[0-9]+(?:\.[0-9]+)?\s*%"), ("number", r"[0-9]+(?:\.[0-9]+)?\s*(?:[A-Za-z%]{1,4}|[年月日天周次个条块倍位万亿人])?"),
]
WORD = r"""[^\s0-9，。；、：:,.!?！？()（）「」【】\[\]"''`*#>_+/=~|&]*$"""


def tokens_cte(name: str, source: str, owner: str, text: str) -> None:
    value = r"""CASE kind WHEN 'date' THEN CASE WHEN contains(raw, '年') THEN lpad(regexp_extract(raw, '[0-9]+')::INT::VARCHAR, 4, '0') || '-' || lpad(regexp_extract(raw, '年\s*([0-9]+)', 1)::INT::VARCHAR, 2, '0')
     || CASE WHEN contains(raw, '日') THEN '-' || lpad(regexp_extract(raw, '月\s*([0-9]+)', 1)::INT::VARCHAR, 2, '0') ELSE '' END ELSE raw END
   WHEN 'chapter' THEN regexp_extract(raw, '[0-9]+')::HUGEINT::VARCHAR || CASE WHEN contains(raw, '章') OR contains(lower(raw), 'ch') THEN '章' WHEN contains(raw, '节') THEN '节' WHEN contains(raw, '条') THEN '条' ELSE '款' END
   WHEN 'version' THEN lower(regexp_replace(regexp_replace(raw, '^[vV]+', ''), '[.\-]+$', '')) WHEN 'percent' THEN replace(raw, ' ', '') ELSE printf('%g', raw::DOUBLE) END"""
    ob.cte(f"{name}_src", f"SELECT {owner} AS owner_id, coalesce({text}, '') AS text FROM {source}", source, materialized=True)
    # every part ends in a find, so parts lie end to end: their lengths give the places
    searches = " UNION ALL ".join(rf"SELECT owner_id, {i} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(text, '(?s).*?(?:{pattern})')) AS part, generate_subscripts(regexp_extract_all(text, '(?s).*?(?:{pattern})'), 1) AS i FROM {name}_src" for i, (kind, pattern) in enumerate(SEARCHES))
    found = " ".join(rf"WHEN '{kind}' THEN regexp_extract(part, '(?s)^.*?({pattern})$', 1)" for kind, pattern in SEARCHES)
    ob.cte(
        f"{name}_found",
        f"""SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY start, rank) AS n FROM (
   SELECT owner_id, rank, kind, found, stop - length(found) AS start, stop FROM (
    SELECT owner_id, rank, kind, CASE kind {found} END AS found, sum(length(part)) OVER (PARTITION BY owner_id, rank ORDER BY i)::BIGINT AS stop FROM ({searches})))""",
        f"{name}_src", materialized=True,
    )
    ob.cte(
        f"{name}_next",
        f"""SELECT c.owner_id, c.n, f.n AS after FROM {name}_found c ASOF JOIN (SELECT owner_id, start, min(n) AS n FROM {name}_found GROUP BY owner_id, start) f ON f.owner_id = c.owner_id AND c.stop <= f.start""",
        f"{name}_found", materialized=True,
    )
    ob.cte(f"{name}_kept", f"SELECT owner_id, 1::BIGINT AS n, 0 AS pos FROM {name}_found WHERE n = 1 UNION ALL SELECT k.owner_id, x.after, k.pos + 1 FROM {name}_kept k JOIN {name}_next x ON x.owner_id = k.owner_id AND x.n = k.n", f"{name}_found", f"{name}_next")
    ob.cte(
        f"{name}_raw",
        rf"""SELECT owner_id, pos, kind, CASE WHEN kind = 'number' THEN regexp_extract(found, '^[0-9]+(?:\.[0-9]+)?') ELSE found END AS raw, CASE WHEN kind = 'number' THEN lower(regexp_extract(found, '^[0-9]+(?:\.[0-9]+)?\s*(.*)$', 1)) ELSE '' END AS unit,
   right(regexp_replace(regexp_extract(regexp_replace(substr(text, 1, start::INTEGER), '\s+$', ''), '{WORD}'), '^-+|-+$', '', 'g'), 6) AS context FROM {name}_kept JOIN {name}_found USING (owner_id, n) JOIN {name}_src USING (owner_id)""",
        f"{name}_kept", f"{name}_found", f"{name}_src", materialized=True,
    )
    ob.cte(
        name,
        f"""SELECT owner_id, kind, value, slot, min(pos)::INTEGER AS pos, arg_min(raw, pos) AS raw, arg_min(unit, pos) AS unit, arg_min(context, pos) AS context FROM (
   SELECT *, CASE WHEN kind = 'number' THEN kind || ':' || unit || ':' || context ELSE kind || ':' || context END AS slot FROM (SELECT *, {value} AS value FROM {name}_raw)) GROUP BY owner_id, kind, value, slot""",
        f"{name}_raw", materialized=True,
    )


tokens_cte("p_tok", "ev_pairs", "prior_id", "prior_text")
tokens_cte("e_tok", "ev_pairs", "evidence_id", "evidence_text")
tokens_cte("doc_tok", "notes0", "note_id", "body")
COMPARABLE = "(kind <> 'number' OR unit <> '' OR context <> '')"
ob.cte(
    "scan",
    f"""SELECT pair_id, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(n_skipped, 0) AS n_skipped, coalesce(n_unequal, 0) = 0 AS slots_agree, first_slot, coalesce(np, 0) AS n_prior_tokens, coalesce(ne, 0) AS n_evidence_tokens, coalesce(nn, 0) AS n_new_tokens
 FROM (SELECT DISTINCT pair_id FROM ev_pairs) LEFT JOIN (
  SELECT pair_id, count(*) FILTER (np = 1 AND ne = 1 AND vp <> ve) AS n_conflicts, count(*) FILTER (np > 0 AND ne > 0 AND NOT (np = 1 AND ne = 1)) AS n_skipped, count(*) FILTER (NOT (np = 1 AND ne = 1 AND vp = ve)) AS n_unequal,
   min(CASE WHEN np = 1 AND ne = 1 AND vp <> ve THEN slot END) AS first_slot FROM (
   SELECT pair_id, slot, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS ne, coalesce(min(CASE WHEN side = 0 THEN value END), '') AS vp, coalesce(min(CASE WHEN side = 1 THEN value END), '') AS ve FROM (
    SELECT pair_id, 0 AS side, t.* FROM ev_pairs p JOIN p_tok t ON t.owner_id = p.prior_id WHERE {COMPARABLE} UNION ALL SELECT pair_id, 1, t.* FROM ev_pairs p JOIN e_tok t ON t.owner_id = p.evidence_id WHERE {COMPARABLE}) GROUP BY pair_id, slot) GROUP BY pair_id) USING (pair_id)
 LEFT JOIN (SELECT pair_id, count(*) AS np FROM ev_pairs p JOIN p_tok t ON t.owner_id = p.prior_id GROUP BY 1) USING (pair_id) LEFT JOIN (SELECT pair_id, count(*) AS ne FROM ev_pairs p JOIN e_tok t ON t.owner_id = p.evidence_id GROUP BY 1) USING (pair_id)
 LEFT JOIN (SELECT pair_id, count(*) AS nn FROM ev_pairs p JOIN e_tok t ON t.owner_id = p.evidence_id WHERE NOT EXISTS (SELECT 1 FROM p_tok q WHERE q.owner_id = p.prior_id AND q.kind = t.kind AND q.value = t.value) GROUP BY 1) USING (pair_id)""",
    "ev_pairs", "p_tok", "e_tok", materialized=True,
)
ob.vectors("prior_vec", "ev_pairs", "pair_id", "prior_text", "ev_pairs")
ob.vectors("evid_vec", "ev_pairs", "pair_id", "evidence_text", "ev_pairs")
ob.cte(
    "verdicts",
    f"""SELECT p.*, s.* EXCLUDE (pair_id), least(1.0, greatest(0.0, {cosine()})) AS similarity, p.source_url <> '' AND p.source_url = p.src_url AS hit,
   len(prior_entities) > 0 AND len(evidence_entities) > 0 AND NOT list_has_any(list_transform(prior_entities, lambda x: {slug_sql('x')}), list_transform(evidence_entities, lambda x: {slug_sql('x')})) AS disjoint
 FROM ev_pairs p JOIN prior_vec a ON a.id = p.pair_id JOIN evid_vec b ON b.id = p.pair_id JOIN scan s ON s.pair_id = p.pair_id""",
    "ev_pairs", "prior_vec", "evid_vec", "scan", materialized=True,
)
VERDICT = f"""CASE WHEN similarity < 0.3 THEN 'uncertain' WHEN disjoint THEN 'uncertain' WHEN n_conflicts > 0 THEN 'conflicting'
  WHEN hit AND content_hash <> '' AND content_hash <> src_hash AND {ts('source_changed_at')} IS NOT NULL AND similarity >= 0.6 THEN 'newer'
  WHEN similarity >= 0.8 AND n_new_tokens = 0 AND n_skipped = 0 AND slots_agree THEN 'consistent'
  WHEN {ts('evidence_observed_at')} > {BASE_SQL} AND similarity >= 0.6 THEN 'newer' WHEN n_evidence_tokens > n_prior_tokens THEN 'more_specific' ELSE 'uncertain' END"""
ob.cte("ladder", f"SELECT *, {VERDICT} AS verdict, CASE WHEN similarity >= 0.3 AND disjoint THEN 'entities_disjoint' END AS guard FROM verdicts", "verdicts", materialized=True)
ACTION = "CASE {0} WHEN 'consistent' THEN 'refresh_reviewed_at' WHEN 'newer' THEN 'supersede' WHEN 'more_specific' THEN 'merge' WHEN 'conflicting' THEN 'open_conflict' ELSE 'none' END"


def doc_tokens(spark, sf):
    return EV.fact_tokens(fx.table(spark, sf, "documents").select(F.expr(fx.nid("doc_id")).alias("owner_id"), "text"))


@query("VER-01", twin("SELECT owner_id, pos, kind, value, raw, unit FROM doc_tok", "doc_tok"))
def ver_01(spark, sf):
    return doc_tokens(spark, sf).select("owner_id", "pos", "kind", "value", "raw", "unit")


@query("VER-02", twin("SELECT owner_id, pos, context FROM doc_tok", "doc_tok"))
def ver_02(spark, sf):
    return doc_tokens(spark, sf).select("owner_id", "pos", "context")


@query("VER-03", twin("SELECT kind, value, count(*)::BIGINT AS n FROM (SELECT * FROM p_tok UNION ALL SELECT * FROM e_tok) GROUP BY ALL", "p_tok", "e_tok"))
def ver_03(spark, sf):
    p = evidence_pairs(spark, sf)
    a = EV.fact_tokens(p.select(F.col("prior_id").alias("owner_id"), F.col("prior_text").alias("text")))
    b = EV.fact_tokens(p.select(F.col("evidence_id").alias("owner_id"), F.col("evidence_text").alias("text")))
    return a.unionByName(b).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("VER-04", twin(f"SELECT owner_id, slot, value, {COMPARABLE} AS comparable FROM doc_tok", "doc_tok"))
def ver_04(spark, sf):
    return doc_tokens(spark, sf).select("owner_id", "slot", "value", EV.comparable().alias("comparable"))


@query("AG-22", twin(f"SELECT owner_id, slot, count(*)::INTEGER AS n_values, string_agg(value, '|' ORDER BY pos) AS values FROM doc_tok WHERE {COMPARABLE} GROUP BY ALL", "doc_tok"))
def ag_22(spark, sf):
    return EV.slot_values(doc_tokens(spark, sf))


def scan_of(spark, sf):
    p = evidence_pairs(spark, sf)
    a = EV.fact_tokens(p.select(F.col("prior_id").alias("owner_id"), F.col("prior_text").alias("text")))
    b = EV.fact_tokens(p.select(F.col("evidence_id").alias("owner_id"), F.col("evidence_text").alias("text")))
    return EV.slot_scan(p.select("pair_id", "prior_id", "evidence_id"), a, b)


@query("VER-05", twin("SELECT pair_id, n_conflicts::BIGINT AS n_conflicts, n_skipped::BIGINT AS n_skipped, slots_agree, first_slot, n_prior_tokens::BIGINT AS n_prior_tokens, n_evidence_tokens::BIGINT AS n_evidence_tokens FROM scan", "scan"))
def ver_05(spark, sf):
    return scan_of(spark, sf).select("pair_id", "n_conflicts", "n_skipped", "slots_agree", F.col("first_conflict.slot").alias("first_slot"), "n_prior_tokens", "n_evidence_tokens")


@query("ST-06", twin("SELECT pair_id, n_new_tokens::BIGINT AS n_new_tokens FROM scan", "scan"))
def st_06(spark, sf):
    return scan_of(spark, sf).select("pair_id", "n_new_tokens")


def compared(spark, sf):
    return EV.compare(evidence_pairs(spark, sf))


@query("VER-06", twin(f"SELECT pair_id, round(similarity, 6) AS similarity, verdict, {ACTION.format('verdict')} AS suggested_action, guard FROM ladder", "ladder"))
def ver_06(spark, sf):
    return compared(spark, sf).select("pair_id", F.round("similarity", 6).alias("similarity"), "verdict", "suggested_action", "guard")


@query("VER-07", twin(f"""SELECT run, count(*)::BIGINT AS n_survivors, round(max(least(1.0, sim)), 6) AS best, any_value(n_priors)::BIGINT AS n_priors FROM (
 SELECT p.d // 4 AS run, {cosine()} AS sim, n.n_priors FROM ev_pairs p JOIN ev_pairs e ON e.d // 4 = p.d // 4 JOIN prior_vec a ON a.id = p.pair_id JOIN evid_vec b ON b.id = e.pair_id JOIN (SELECT d // 4 AS run, count(*) AS n_priors FROM ev_pairs GROUP BY 1) n ON n.run = p.d // 4)
 WHERE sim >= 0.3 GROUP BY run""", "ev_pairs", "prior_vec", "evid_vec"))
def ver_07(spark, sf):
    p = evidence_pairs(spark, sf).withColumn("run", F.expr("d div 4"))
    enc = V.encoder()
    priors = p.select(F.col("prior_id").alias("item_id"), enc("prior_text").alias("v"), F.col("run").alias("group"))
    ev = p.select(F.col("evidence_id").alias("qid"), enc("evidence_text").alias("v"), F.col("run").alias("group"))
    hits = top_matches_grouped(priors, ev, score_cosine, 1 << 30, floor=0.3)
    runs = ev.select("qid", F.col("group").alias("run"))
    n = p.groupBy("run").agg(F.count("*").alias("n_priors"))
    return hits.join(runs, "qid").groupBy("run").agg(F.count("*").alias("n_survivors"), F.round(F.max(F.least(F.col("score"), F.lit(1.0))), 6).alias("best")).join(n, "run")


_JUDGED = "CASE d % 5 WHEN 0 THEN ' Newer' WHEN 1 THEN 'conflicting' WHEN 2 THEN 'nonsense' WHEN 3 THEN 'consistent' END"


def judged(spark, sf):
    return evidence_pairs(spark, sf).select("pair_id", F.expr(_JUDGED).alias("judged"))


_JUDGE_SQL = f"""SELECT pair_id, CASE WHEN op AND known THEN j END AS judge_verdict, CASE WHEN op AND known AND (guard IS NULL OR j IN ('conflicting', 'uncertain')) THEN j ELSE verdict END AS final_verdict, guard
 FROM (SELECT *, verdict = 'uncertain' AND similarity >= 0.3 AS op, coalesce(j IN ('consistent', 'newer', 'more_specific', 'conflicting', 'uncertain'), false) AS known FROM (SELECT *, lower(trim({_JUDGED})) AS j FROM ladder))"""


@query("VER-08", twin(_JUDGE_SQL, "ladder"))
def ver_08(spark, sf):
    return EV.apply_judgements(compared(spark, sf), judged(spark, sf)).select("pair_id", "judge_verdict", "final_verdict", "guard")


@query("UDF-02", twin(f"SELECT final_verdict, count(*)::BIGINT AS n FROM ({_JUDGE_SQL}) GROUP BY 1", "ladder"))
def udf_02(spark, sf):
    return EV.apply_judgements(compared(spark, sf), judged(spark, sf)).groupBy("final_verdict").agg(F.count("*").alias("n"))


@query("VER-09", """SELECT event_id, floor, consistent, least(consistent, greatest(floor, s)) AS supersede FROM (SELECT event_id, s, f AS floor, greatest(f, least(1.0::DOUBLE, greatest(0.0::DOUBLE, c))) AS consistent FROM (
 SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 512 - 0.25::DOUBLE)) AS f, value / 64 - 0.5::DOUBLE AS c, value / 16 - 1::DOUBLE AS s FROM events))""")
def ver_09(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", (F.col("value") / 512 - 0.25).alias("f"), (F.col("value") / 64 - 0.5).alias("c"), (F.col("value") / 16 - 1).alias("s"))
    return e.select("event_id", *EV.normalized_columns(F.col("f"), F.col("c"), F.col("s")))


@query("JN-14", twin("SELECT pair_id, CASE WHEN source_url <> '' AND source_url = src_url THEN src_url END AS url, CASE WHEN source_url <> '' AND source_url = src_url THEN src_hash END AS prior_hash FROM ev_pairs", "ev_pairs"))
def jn_14(spark, sf):
    ref = EV.matched_source(F.col("sources"), F.col("source_url"))
    return evidence_pairs(spark, sf).select("pair_id", ref["url"].alias("url"), ref["content_hash"].alias("prior_hash"))


@query("JN-15", twin("SELECT pair_id, disjoint FROM verdicts", "verdicts"))
def jn_15(spark, sf):
    return evidence_pairs(spark, sf).select("pair_id", EV.entities_disjoint(F.col("prior_entities"), F.col("evidence_entities")).alias("disjoint"))


# ---- pairs and similarity joins --------------------------------------------------------------------
ob.cte("know", "SELECT * FROM notes0 WHERE status = 'active' AND NOT tombstone AND kind = 'knowledge'", "notes0", materialized=True)
ob.cte(
    "all_pairs",
    f"""SELECT *, row_number() OVER (ORDER BY a_id, b_id) - 1 AS pair_no FROM (SELECT a.note_id AS a_id, b.note_id AS b_id, a.d AS da, b.d AS db FROM know a JOIN know b ON a.note_id < b.note_id
   WHERE {slug_sql('a.source')} = {slug_sql('b.source')} OR a.d % 37 = b.d % 37)""",
    "know", materialized=True,
)


@query("JN-04", twin("SELECT k.note_id, count(p.b_id)::BIGINT AS partners FROM know k LEFT JOIN all_pairs p ON p.a_id = k.note_id GROUP BY 1", "know", "all_pairs"))
def jn_04(spark, sf):
    n = CO.pool(fx.notes(spark, sf, False)).filter("kind = 'knowledge'").select("note_id", "entities")
    return PR.partner_counts(PR.keyed(n)).select("note_id", "partners")


@query("JN-04-window", twin("SELECT a_id, b_id, pair_no::BIGINT AS pair_no FROM all_pairs WHERE pair_no BETWEEN 40 AND 299", "all_pairs"))
def jn_04_window(spark, sf):
    return PR.pair_window(CO.scanned_pairs(fx.notes(spark, sf, False)), 40, 300)


def candidates(spark, sf):
    """Every page is a candidate, with its whole text; every fifth brings a stored note back, and some say next to nothing."""
    pages = fx.page_versions(spark, sf).select(F.col("page_id").alias("d"), "url", F.col("text").alias("page"))
    known = fx.notes(spark, sf, False).select("d", F.expr("CASE WHEN d % 5 = 0 THEN body END AS body"), F.col("entities").alias("own"))  # no other body is read
    return pages.join(known, "d", "left").selectExpr(
        "d", "concat('K-', lpad(cast(d as string), greatest(9, length(cast(d as string))), '0')) AS cand_id",
        "CASE WHEN d % 50 = 13 THEN concat('page ', cast(d as string)) WHEN d % 5 = 0 AND body IS NOT NULL THEN body ELSE page END AS text",
        "CASE WHEN d % 30 = 3 OR own IS NULL THEN array('elsewhere') ELSE own END AS entities", "CASE WHEN d % 40 = 23 THEN array('') ELSE array(url) END AS urls",
        "CASE d % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence", "CASE d % 4 WHEN 0 THEN 'volatile' WHEN 1 THEN 'drifting' ELSE 'stable' END AS volatility",
    )


ob.cte(
    "cands",
    """SELECT page_id AS d, 'K-' || lpad(page_id::VARCHAR, greatest(9, length(page_id::VARCHAR))::INTEGER, '0') AS cand_id,
  CASE WHEN page_id % 50 = 13 THEN 'page ' || page_id::VARCHAR WHEN page_id % 5 = 0 AND n.body IS NOT NULL THEN n.body ELSE p.text END AS text,
  CASE WHEN page_id % 30 = 3 OR n.entities IS NULL THEN ['elsewhere'] ELSE n.entities END AS entities, CASE WHEN page_id % 40 = 23 THEN [''] ELSE [p.url] END AS urls, CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS confidence,
  CASE page_id % 4 WHEN 0 THEN 'volatile' WHEN 1 THEN 'drifting' ELSE 'stable' END AS volatility FROM page_versions p LEFT JOIN notes0 n ON n.d = p.page_id""",
    "page_versions", "notes0", materialized=True,
)
ob.cte("cand_texts", "SELECT cand_id, trim(text) AS text FROM cands", "cands")
ob.cte("trimmed", "SELECT d, trim(body) AS body FROM notes0", "notes0")
ob.vectors("cand_vec", "cands", "cand_id", "text", "cands")
ob.vectors("cand_trim_vec", "cand_texts", "cand_id", "text", "cand_texts")
ob.vectors("trim_vec", "trimmed", "d", "body", "trimmed")
ob.cte("sim_max", f"SELECT c.id AS cand_id, max({cosine('c', 'v')}) AS similarity_max FROM cand_vec c CROSS JOIN trim_vec v JOIN notes0 n ON n.d = v.id WHERE n.status = 'active' GROUP BY 1", "cand_vec", "trim_vec", "notes0", materialized=True)


@query("JN-21", twin(f"SELECT qid, note_id, round(score, 6) AS score FROM (SELECT q.id AS qid, {nid('v.id')} AS note_id, {cosine('q', 'v')} AS score, row_number() OVER (PARTITION BY q.id ORDER BY {cosine('q', 'v')} DESC, v.id) AS rn FROM bench_vec q CROSS JOIN body_vec v WHERE {cosine('q', 'v')} >= 0.3) WHERE rn = 1", "bench_vec", "body_vec"))
def jn_21(spark, sf):
    enc = V.encoder()
    items = fx.notes(spark, sf, False).filter("length(body) > 0").select(F.col("note_id").alias("item_id"), enc("body").alias("v"))
    qs = fx.bench_queries(spark, sf).select("qid", enc("q").alias("v"))
    return top_matches(items, qs, score_cosine, 1, floor=0.3).select("qid", F.col("item_id").alias("note_id"), F.round("score", 6).alias("score"))


def with_signals(spark, sf):
    c = I.read_candidates(candidates(spark, sf))
    return I.formation(c.drop("qid", "v").join(I.max_similarity(c, fx.notes(spark, sf, False)), "cand_id"))


ob.cte(
    "formed",
    f"""SELECT *, least(100, 15 + CASE WHEN has_source THEN 25 ELSE 0 END + CASE WHEN has_specifics THEN 25 ELSE 0 END + 10 * least(entity_count, 3) + CASE WHEN body_chars >= 80 THEN 10 WHEN body_chars >= 20 THEN 5 ELSE 0 END) / 100.0::DOUBLE AS importance,
   CASE WHEN has_source AND has_specifics THEN 'high' WHEN has_source THEN 'medium' ELSE 'low' END AS conf FROM (
  SELECT c.*, s.similarity_max, length(trim(text))::INTEGER AS body_chars, len(entities)::INTEGER AS entity_count, trim(urls[1]) <> '' AS has_source, {SPECIFICS_SQL.format('text')} AS has_specifics FROM cands c LEFT JOIN sim_max s USING (cand_id))""",
    "cands", "sim_max", materialized=True,
)
DECISION = "CASE WHEN body_chars < 20 THEN 'short' WHEN NOT has_source THEN 'no_source' WHEN importance < 0.3 THEN 'unimportant' WHEN similarity_max >= 0.95 THEN 'near_duplicate' ELSE 'accept' END"


@query("ING-01", twin("SELECT cand_id, body_chars, entity_count, has_source, has_specifics, round(similarity_max, 6) AS similarity_max FROM formed", "formed"))
def ing_01(spark, sf):
    return with_signals(spark, sf).select("cand_id", "body_chars", "entity_count", "has_source", "has_specifics", F.round("similarity_max", 6).alias("similarity_max"))


@query("ING-02", twin("SELECT cand_id, importance FROM formed", "formed"))
def ing_02(spark, sf):
    return with_signals(spark, sf).select("cand_id", "importance")


@query("ING-03", twin("SELECT cand_id, conf AS confidence FROM formed", "formed"))
def ing_03(spark, sf):
    return with_signals(spark, sf).select("cand_id", "confidence")


@query("ING-04", twin(f"SELECT cand_id, {DECISION} AS decision, {DECISION} = 'accept' AS persist FROM formed", "formed"))
def ing_04(spark, sf):
    return with_signals(spark, sf).select("cand_id", "decision", "persist")


ob.cte("cand_keys", f"SELECT cand_id, list_distinct(list_transform(entities, lambda x: {slug_sql('x')})) AS ks FROM cands", "cands", materialized=True)
ob.cte(
    "best_old",
    f"""SELECT cand_id, note_id, score FROM (SELECT c.id AS cand_id, n.note_id, {cosine('c', 'v')} AS score, row_number() OVER (PARTITION BY c.id ORDER BY {cosine('c', 'v')} DESC, n.note_id) AS rn
   FROM cand_trim_vec c JOIN cand_keys k ON k.cand_id = c.id CROSS JOIN trim_vec v JOIN notes0 n ON n.d = v.id WHERE n.status = 'active' AND NOT n.tombstone AND {cosine('c', 'v')} >= 0.9
   AND list_has_any(k.ks, list_transform(n.entities, lambda x: {slug_sql('x')}))) WHERE rn = 1""",
    "cand_trim_vec", "cand_keys", "trim_vec", "notes0", materialized=True,
)
ob.cte(
    "parents",
    f"""SELECT id, p FROM (SELECT a.id, b.id AS p, row_number() OVER (PARTITION BY a.id ORDER BY {cosine()} DESC, b.id) AS rn FROM cand_trim_vec a JOIN cand_keys ka ON ka.cand_id = a.id JOIN cand_trim_vec b ON b.id < a.id JOIN cand_keys kb ON kb.cand_id = b.id
   WHERE a.id NOT IN (SELECT cand_id FROM best_old) AND b.id NOT IN (SELECT cand_id FROM best_old) AND {cosine()} >= 0.9 AND list_has_any(ka.ks, kb.ks)) WHERE rn = 1""",
    "cand_trim_vec", "cand_keys", "best_old", materialized=True,
)
ob.cte("climb", "SELECT id AS start, id AS cur, 0 AS h FROM cand_trim_vec UNION ALL SELECT c.start, p.p, c.h + 1 FROM climb c JOIN parents p ON p.id = c.cur", "cand_trim_vec", "parents")
ob.cte(
    "ingested",
    """SELECT cand_id, 'merged' AS action, note_id AS target FROM best_old UNION ALL
 SELECT start, CASE WHEN max(h) = 0 THEN 'created' ELSE 'merged_in_batch' END, arg_max(cur, h) FROM climb WHERE start NOT IN (SELECT cand_id FROM best_old) GROUP BY start""",
    "best_old", "climb", materialized=True,
)


@query("ING-05", twin("SELECT c.cand_id, CASE WHEN b.note_id IS NULL THEN 'created' ELSE 'merged' END AS action, b.note_id AS merged_into FROM cands c LEFT JOIN best_old b USING (cand_id)", "cands", "best_old"))
def ing_05(spark, sf):
    c = candidates(spark, sf)
    best = I.best_existing(c, fx.notes(spark, sf, False)).select("cand_id", F.col("note_id").alias("merged_into"))
    return c.join(best, "cand_id", "left").select("cand_id", F.when(F.col("merged_into").isNull(), "created").otherwise("merged").alias("action"), "merged_into")


@query("TK-06", twin("SELECT cand_id, note_id, round(score, 6) AS score FROM best_old", "best_old"))
def tk_06(spark, sf):
    return I.best_existing(candidates(spark, sf), fx.notes(spark, sf, False)).withColumn("score", F.round("score", 6))


@query("ING-07", ob.ranked_twin("SELECT cand_id, action, target FROM ingested", "ingested"))
def ing_07(spark, sf):
    return I.batch_ingest(candidates(spark, sf), fx.notes(spark, sf, False))


@query("ING-06", ob.ranked_twin(f"""WITH r AS (SELECT i.target, false AS canon, c.confidence, c.volatility, c.entities, c.urls FROM ingested i JOIN cands c USING (cand_id) WHERE action = 'merged'
  UNION ALL SELECT note_id, true, confidence, volatility, entities, [src_url] FROM notes WHERE note_id IN (SELECT target FROM ingested WHERE action = 'merged'))
 SELECT target, ['low', 'medium', 'high'][max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)] AS confidence, ['stable', 'drifting', 'volatile'][max(CASE volatility WHEN 'volatile' THEN 3 WHEN 'drifting' THEN 2 ELSE 1 END)] AS volatility,
   (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT {slug_sql('x')} AS e FROM (SELECT unnest(q.entities) AS x FROM r q WHERE q.target = r.target))) AS entities,
   (SELECT count(DISTINCT u) FROM (SELECT unnest(q.urls) AS u FROM r q WHERE q.target = r.target))::BIGINT AS n_sources, count(*) FILTER (NOT canon)::BIGINT AS n_merged FROM r GROUP BY target""", "ingested", "cands", "notes"))
def ing_06(spark, sf):
    c = candidates(spark, sf)
    n = fx.notes(spark, sf)
    merged = I.batch_ingest(c, n.drop("sources")).filter("action = 'merged'").select("cand_id", "target")
    new = c.join(merged, "cand_id").select("target", F.lit(False).alias("is_canonical"), "confidence", "volatility", "entities", "urls")
    old = n.join(merged.select(F.col("target").alias("note_id")).distinct(), "note_id", "left_semi").select(F.col("note_id").alias("target"), F.lit(True).alias("is_canonical"), "confidence", "volatility", "entities", F.col("sources.url").alias("urls"))
    return I.merge_projection(new.unionByName(old))


ob.cte("trim_keys", f"SELECT d AS id, list_filter(list_transform(entities, lambda x: {slug_sql('x')}), lambda x: x <> '') AS ks FROM notes0", "notes0", materialized=True)
ob.cte(
    "alike",
    f"""SELECT a.id AS x, b.id AS y FROM trim_vec a JOIN trim_vec b ON a.id <> b.id JOIN trim_keys ka ON ka.id = a.id JOIN trim_keys kb ON kb.id = b.id
   WHERE list_has_any(ka.ks, kb.ks) AND {cosine()} >= 0.9 UNION ALL SELECT d, d FROM notes0""",
    "trim_vec", "trim_keys", "notes0", materialized=True,
)
ob.cte("lowest", "SELECT d AS id, d AS low, 0 AS step FROM notes0 UNION ALL SELECT a.x, min(l.low), step + 1 FROM lowest l JOIN alike a ON a.y = l.id WHERE step < 40 GROUP BY a.x, step", "alike", "notes0")


@query("ING-08", ob.ranked_twin("SELECT id, low AS component FROM lowest WHERE step = 40", "lowest"))
def ing_08(spark, sf):
    return I.duplicate_groups(fx.notes(spark, sf, False).select(F.col("d").alias("id"), F.col("body").alias("text"), "entities"))


# ---- memory update ---------------------------------------------------------------------------------
_REFS = "array(struct(src AS url, CASE WHEN d % 4 = 0 THEN '' ELSE 'h1' END AS content_hash), struct(CASE WHEN d % 5 = 0 THEN '' ELSE concat('http://two/', cast(d as string)) END AS url, CASE WHEN d % 3 = 0 THEN '' ELSE 'h2' END AS content_hash))"


@query("UPD-01", twin("""SELECT cand_id, CASE WHEN u1 <> '' AND h1 <> '' THEN u1 WHEN u2 <> '' AND h2 <> '' THEN u2 WHEN u1 <> '' THEN u1 ELSE u2 END AS source_url,
  CASE WHEN u1 <> '' AND h1 <> '' THEN h1 WHEN u2 <> '' AND h2 <> '' THEN h2 ELSE '' END AS content_hash, md5(trim(text)) AS text_md5 FROM (
 SELECT cand_id, text, urls[1] AS u1, CASE WHEN d % 4 = 0 THEN '' ELSE 'h1' END AS h1, CASE WHEN d % 5 = 0 THEN '' ELSE 'http://two/' || d::VARCHAR END AS u2, CASE WHEN d % 3 = 0 THEN '' ELSE 'h2' END AS h2 FROM cands)""", "cands"))
def upd_01(spark, sf):
    c = candidates(spark, sf).withColumn("src", F.col("urls")[0]).withColumn("refs", F.expr(_REFS)).withColumn("run", F.lit(0)).withColumn("evidence_index", F.col("cand_id"))
    e = U.evidence_from_candidates(c, fx.NOW)
    return e.select(F.col("evidence_index").alias("cand_id"), "source_url", F.when(F.col("source_url") == "", "").otherwise(F.col("content_hash")).alias("content_hash"), F.md5("text").alias("text_md5"))


def update_batch(spark, sf):
    """Comparisons as a batch: every tenth one comes twice, every twelfth note gets a second piece of evidence."""
    c = written(compared(spark, sf).select("d", "prior_id", "status", F.col("evidence_text").alias("text"), "suggested_action", "guard", "source_url", "content_hash"), "update-batch")
    first = c.withColumn("seq", F.col("d"))
    again = c.filter("d % 10 = 0").withColumn("seq", F.col("d") + 100_000_000)
    second = c.filter("d % 12 = 0").withColumn("seq", F.col("d") + 200_000_000).withColumn("text", F.concat("text", F.lit(" more")))
    rows = first.unionByName(again).unionByName(second)
    return rows.withColumns({
        "prior_status": F.expr("CASE WHEN d % 41 <> 0 THEN status END"), "text": F.expr("CASE WHEN d % 43 <> 0 THEN text END"),
        "suggested_action": F.expr("CASE WHEN d % 12 = 0 THEN 'supersede' ELSE suggested_action END"), "source_url": F.expr("CASE WHEN d % 6 = 0 AND source_url <> '' THEN source_url ELSE '' END"),
        "content_hash": F.expr("CASE WHEN d % 24 = 0 THEN 'h' ELSE content_hash END"),
    })


def known_keys(spark, sf):
    p = evidence_pairs(spark, sf).filter("d % 9 = 0 OR d % 17 = 0").select("d", "prior_id", X.evidence_key(F.col("evidence_text")).alias("k"))
    keys = F.array(F.struct((F.col("d") % 9 == 0).alias("of"), F.concat_ws(":", "prior_id", "k").alias("key")), F.struct((F.col("d") % 17 == 0).alias("of"), F.col("k").alias("key")))
    return p.select(F.inline(keys)).filter("of").select("key")


def decided(spark, sf):
    return U.decide(update_batch(spark, sf), known_keys(spark, sf))


ob.cte(
    "batch",
    f"""SELECT seq, d, prior_id, CASE WHEN d % 41 <> 0 THEN status END AS prior_status, CASE WHEN d % 43 <> 0 THEN text END AS text, CASE WHEN d % 12 = 0 THEN 'supersede' ELSE act END AS act, guard,
   CASE WHEN d % 6 = 0 AND source_url <> '' THEN source_url ELSE '' END AS source_url, CASE WHEN d % 24 = 0 THEN 'h' ELSE content_hash END AS content_hash FROM (
   SELECT d AS seq, d, prior_id, status, evidence_text AS text, {ACTION.format('verdict')} AS act, guard, source_url, content_hash FROM ladder
   UNION ALL SELECT d + 100000000, d, prior_id, status, evidence_text, {ACTION.format('verdict')}, guard, source_url, content_hash FROM ladder WHERE d % 10 = 0
   UNION ALL SELECT d + 200000000, d, prior_id, status, evidence_text || ' more', {ACTION.format('verdict')}, guard, source_url, content_hash FROM ladder WHERE d % 12 = 0)""",
    "ladder", materialized=True,
)
ob.cte("known", "SELECT prior_id || ':' || substr(sha1(trim(evidence_text)), 1, 16) AS key FROM ev_pairs WHERE d % 9 = 0 UNION SELECT substr(sha1(trim(evidence_text)), 1, 16) FROM ev_pairs WHERE d % 17 = 0", "ev_pairs", materialized=True)
ob.cte(
    "early",
    """SELECT *, CASE WHEN prior_status IS NULL THEN 'missing_prior' WHEN text IS NULL THEN 'bad_index' WHEN (min(CASE WHEN prior_status IS NOT NULL AND text IS NOT NULL THEN seq END) OVER (PARTITION BY key)) < seq THEN 'duplicate'
    WHEN key IN (SELECT key FROM known) OR body_key IN (SELECT key FROM known) THEN 'already_processed' END AS early, guard IS NOT NULL AND act NOT IN ('open_conflict', 'none') AS blocked, trim(source_url) <> '' AND trim(content_hash) <> '' AS sourced
  FROM (SELECT *, substr(sha1(trim(text)), 1, 16) AS body_key, CASE WHEN text IS NOT NULL THEN prior_id || ':' || substr(sha1(trim(text)), 1, 16) END AS key FROM batch)""",
    "batch", "known", materialized=True,
)
ob.cte(
    "decided",
    """SELECT *, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN act = 'refresh_reviewed_at' THEN 'reviewed' WHEN act = 'supersede' AND sourced THEN 'superseded' WHEN act = 'merge' THEN 'merged' ELSE 'conflicts' END AS applied FROM (
  SELECT e.*, CASE WHEN early IS NOT NULL THEN early WHEN r.at0 < seq THEN 'retired' WHEN prior_status <> 'active' THEN 'not_active' WHEN blocked THEN 'guard' WHEN act = 'none' THEN 'uncertain' END AS skip FROM early e
  LEFT JOIN (SELECT prior_id, min(seq) AS at0 FROM early WHERE early IS NULL AND prior_status = 'active' AND NOT blocked AND act = 'supersede' AND sourced GROUP BY 1) r USING (prior_id))""",
    "early", materialized=True,
)


@query("UPD-02", twin("SELECT seq, prior_id, act AS suggested_action, applied, skip FROM decided", "decided"))
def upd_02(spark, sf):
    return decided(spark, sf).select("seq", "prior_id", "suggested_action", "applied", "skip")


@query("JN-19", twin("SELECT seq, key FROM early WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM known) AND body_key NOT IN (SELECT key FROM known)", "early", "known"))
def jn_19(spark, sf):
    k = X.evidence_key(F.col("text"))
    rows = update_batch(spark, sf).filter("text IS NOT NULL").select("seq", F.concat_ws(":", "prior_id", k).alias("key"), k.alias("body_key"))
    known = known_keys(spark, sf).distinct()
    return rows.join(known, "key", "left_anti").join(known.withColumnRenamed("key", "body_key"), "body_key", "left_anti").select("seq", "key")


@query("UPD-03", twin("SELECT seq, prior_id, source_url, content_hash FROM decided WHERE applied = 'conflicts' AND act = 'supersede'", "decided"))
def upd_03(spark, sf):
    return decided(spark, sf).filter("downgraded").select("seq", "prior_id", "source_url", "content_hash")


@query("UPD-04", twin(f"""SELECT 'N-S' || right(key, 16) AS note_id, 'active' AS status, NULL AS superseded_by, prior_id AS superseded_from, CASE WHEN {SPECIFICS_SQL.format('s.text')} THEN 'high' ELSE 'medium' END AS confidence FROM decided s WHERE applied = 'superseded'
 UNION ALL SELECT prior_id, 'superseded', 'N-S' || right(key, 16), NULL, NULL FROM decided WHERE applied = 'superseded'""", "decided"))
def upd_04(spark, sf):
    return U.supersede_effects(decided(spark, sf), fx.notes(spark, sf, False)).select("note_id", "status", "superseded_by", "superseded_from", "confidence")


@query("UPD-05", twin("""SELECT m.prior_id AS note_id, seq, CASE WHEN NOT contains(n.body, trim(text)) THEN md5('- added (2025-01-01 00:00:00): ' || trim(text)) END AS addition_md5,
  (source_url <> '' AND content_hash <> '' AND NOT (n.src_url = source_url AND n.src_hash = content_hash)) AS new_source FROM decided m JOIN notes n ON n.note_id = m.prior_id WHERE applied = 'merged'""", "decided", "notes"))
def upd_05(spark, sf):
    return U.merge_effects(decided(spark, sf), fx.notes(spark, sf), fx.NOW).select("note_id", "seq", F.md5("addition").alias("addition_md5"), "new_source")


@query("UPD-06", twin("SELECT DISTINCT prior_id AS note_id, '2025-01-01 00:00:00' AS reviewed_at FROM decided WHERE applied = 'reviewed'", "decided"))
def upd_06(spark, sf):
    return decided(spark, sf).filter("applied = 'reviewed'").select(F.col("prior_id").alias("note_id"), F.lit(fx.NOW).alias("reviewed_at")).distinct()


@query("UPD-07", twin("SELECT seq, prior_id AS claim_a, substr(text, 1, 200) AS claim_b, key, body_key, 'open' AS status FROM decided WHERE applied = 'conflicts'", "decided"))
def upd_07(spark, sf):
    return U.conflict_effects(decided(spark, sf), fx.NOW).select("seq", "claim_a", "claim_b", "key", "body_key", "status")


@query("AG-18", twin("SELECT " + ", ".join(f"count(*) FILTER (applied = '{b}')::BIGINT AS {b}" for b in U.BUCKETS) + " FROM decided", "decided"))
def ag_18(spark, sf):
    return U.action_counts(decided(spark, sf))


_CMD = "CASE WHEN d % 44 = 0 THEN 'N-none' ELSE note_id END AS note_id, CASE d % 3 WHEN 0 THEN 'revise' WHEN 1 THEN 'supersede' ELSE 'invalidate' END AS op, CASE WHEN d % 10 = 0 THEN ' ' ELSE 'because' END AS reason, CASE WHEN d % 14 = 0 THEN '' ELSE body END AS text"


@query("UPD-08", twin(f"""SELECT cmd_id, note_id, op, outcome, CASE WHEN outcome = 'ok' THEN CASE WHEN op = 'revise' THEN 'active' ELSE 'superseded' END END AS new_status, CASE WHEN outcome = 'ok' AND op <> 'revise' THEN 'N-X' || cmd_id::VARCHAR END AS new_note_id,
  outcome = 'ok' AND op = 'invalidate' AS tombstone FROM (SELECT c.*, CASE WHEN n.status IS NULL THEN 'not_found' WHEN n.status <> 'active' THEN 'not_active' WHEN trim(reason) = '' THEN 'reason_required' WHEN op <> 'invalidate' AND trim(text) = '' THEN 'text_required' ELSE 'ok' END AS outcome
 FROM (SELECT d AS cmd_id, {_CMD} FROM notes0) c LEFT JOIN notes0 n ON n.note_id = c.note_id)""", "notes0"))
def upd_08(spark, sf):
    n = fx.notes(spark, sf, False)
    cmds = n.selectExpr("d AS cmd_id", *[x.strip() for x in _split_select(_CMD)])
    return U.run_commands(cmds, n, fx.NOW).select("cmd_id", "note_id", "op", "outcome", "new_status", "new_note_id", "tombstone")


def _split_select(sql: str) -> list[str]:
    import re

    return re.split(r",\s*(?=CASE )", sql)


@query("UPD-09", twin("""SELECT conflict_id, adopted, verdict, CASE WHEN c_status IS NULL THEN 'unknown_conflict' WHEN c_status <> 'open' THEN 'not_open' WHEN n.status IS NULL THEN 'unknown_note' WHEN n.status NOT IN ('active', 'merged') THEN 'note_retired' WHEN n.tombstone THEN 'tombstone' ELSE 'resolved' END AS outcome
 FROM (SELECT conflict_id, status AS c_status, CASE WHEN d % 300 = 0 THEN 'N-none' WHEN d % 200 = 0 THEN note_b ELSE note_a END AS adopted, 'a' AS verdict FROM conflicts UNION ALL SELECT 'C-none', NULL, 'N-000001', 'b') x LEFT JOIN notes0 n ON n.note_id = x.adopted""", "conflicts", "notes0"))
def upd_09(spark, sf):
    c = fx.conflicts(spark, sf)
    dec = c.selectExpr("conflict_id", "'a' AS verdict", "CASE WHEN d % 300 = 0 THEN 'N-none' WHEN d % 200 = 0 THEN note_b ELSE note_a END AS adopted")
    dec = dec.unionByName(spark.sql("SELECT 'C-none' AS conflict_id, 'b' AS verdict, 'N-000001' AS adopted"))
    return U.rule_conflicts(dec, c, fx.notes(spark, sf, False))


@query("JN-20", twin("""SELECT conflict_id, array_to_string(list_sort(CASE WHEN len(list_intersect(entities_a, coalesce(entities_b, []))) > 0 THEN list_intersect(entities_a, entities_b) ELSE list_distinct(list_concat(entities_a, coalesce(entities_b, []))) END), '|') AS entities FROM conflicts""", "conflicts"))
def jn_20(spark, sf):
    c = fx.conflicts(spark, sf)
    b = F.coalesce("entities_b", F.array().cast("array<string>"))
    shared = F.array_intersect("entities_a", b)
    return c.select("conflict_id", F.array_join(F.sort_array(F.when(F.size(shared) > 0, shared).otherwise(F.array_union("entities_a", b))), "|").alias("entities"))


@query("UPD-10", """SELECT event_id::VARCHAR AS trace_id, CASE WHEN nc = 0 AND fs = 0 THEN 'no_notes' ELSE 'below_min_fresh' END AS reason FROM (SELECT event_id, floor(value)::BIGINT % 3 AS nc, floor(value * 10)::BIGINT % 4 AS fs, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 3 END AS mf FROM events)
 WHERE ((nc = 0 AND fs = 0) OR fs < mf) AND event_id % 11 <> 0""")
def upd_10(spark, sf):
    r = fx.table(spark, sf, "events").selectExpr("cast(event_id as string) AS trace_id", "event_id", "cast(floor(value) as bigint) % 3 AS notes_created", "cast(floor(value * 10) as bigint) % 4 AS fresh_sources", "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 3 END AS min_fresh")
    return U.unanswered_runs(r, r.filter("event_id % 11 = 0").select("trace_id"))


# ---- consolidation ---------------------------------------------------------------------------------


def fact_notes(spark, sf):
    """Notes whose bodies end in facts, so that same-entity pairs can conflict."""
    return fx.notes(spark, sf).withColumn("body", F.expr(f"concat(body, {facts('d', 'string')})")).withColumn("confirmed", F.expr("d % 46 = 0"))


ob.cte("fact_notes", f"SELECT * REPLACE (body || {facts('d', 'varchar')} AS body) FROM notes", "notes", materialized=True)
ob.vectors("fact_vec", "fact_notes", "note_id", "body", "fact_notes")
tokens_cte("f_tok", "fact_notes", "note_id", "body")
ob.cte(
    "con_conflicts",
    f"""SELECT p.a_id, p.b_id, p.pair_no, min(s.slot) AS slot FROM (SELECT * FROM all_pairs WHERE pair_no < 50) p JOIN fact_vec a ON a.id = p.a_id JOIN fact_vec b ON b.id = p.b_id JOIN (
   SELECT a_id, b_id, slot FROM (SELECT p.a_id, p.b_id, t.slot, count(*) FILTER (t.owner_id = p.a_id) AS np, count(*) FILTER (t.owner_id = p.b_id) AS ne, min(CASE WHEN t.owner_id = p.a_id THEN value END) AS vp, min(CASE WHEN t.owner_id = p.b_id THEN value END) AS ve
     FROM (SELECT * FROM all_pairs WHERE pair_no < 50) p JOIN f_tok t ON t.owner_id = p.a_id OR t.owner_id = p.b_id WHERE {COMPARABLE} GROUP BY ALL) WHERE np = 1 AND ne = 1 AND vp <> ve) s ON s.a_id = p.a_id AND s.b_id = p.b_id
  WHERE {cosine()} >= 0.3 GROUP BY ALL""",
    "all_pairs", "fact_vec", "f_tok", materialized=True,
)
ob.cte(
    "con_merges",
    f"""SELECT *, CASE WHEN (ca, a_id) < (cb, b_id) THEN a_id ELSE b_id END AS canonical_id FROM (SELECT p.a_id, p.b_id, p.pair_no, least(1.0, greatest(0.0, {cosine()})) AS similarity, na.created AS ca, nb.created AS cb FROM all_pairs p JOIN fact_vec a ON a.id = p.a_id JOIN fact_vec b ON b.id = p.b_id JOIN notes0 na ON na.note_id = p.a_id JOIN notes0 nb ON nb.note_id = p.b_id
   WHERE {cosine()} >= 0.5 AND {cosine()} < 0.95 AND NOT EXISTS (SELECT 1 FROM con_conflicts c WHERE c.a_id = p.a_id AND c.b_id = p.b_id) ORDER BY pair_no LIMIT 10)""",
    "all_pairs", "fact_vec", "con_conflicts", "notes0", materialized=True,
)


# the plan looks for conflicts and merges among all pairs
ob.cte(
    "plan_near",
    f"""SELECT p.a_id, p.b_id, p.pair_no, {cosine()} AS similarity FROM all_pairs p JOIN fact_vec a ON a.id = p.a_id JOIN fact_vec b ON b.id = p.b_id WHERE {cosine()} >= 0.3""",
    "all_pairs", "fact_vec", materialized=True,
)
ob.cte(
    "plan_slots",
    f"""SELECT owner_id, slot, count(*) AS n, min(value) AS value FROM f_tok WHERE {COMPARABLE} GROUP BY ALL HAVING count(*) = 1""",
    "f_tok", materialized=True,
)
ob.cte(
    "plan_conflicts",
    """SELECT p.a_id, p.b_id, p.pair_no, min(x.slot) AS slot FROM plan_near p JOIN plan_slots x ON x.owner_id = p.a_id JOIN plan_slots y ON y.owner_id = p.b_id AND y.slot = x.slot WHERE x.value <> y.value GROUP BY ALL""",
    "plan_near", "plan_slots", materialized=True,
)
ob.cte(
    "plan_merges",
    """SELECT *, CASE WHEN (ca, a_id) < (cb, b_id) THEN a_id ELSE b_id END AS canonical_id FROM (SELECT p.a_id, p.b_id, p.pair_no, na.created AS ca, nb.created AS cb FROM plan_near p JOIN notes0 na ON na.note_id = p.a_id JOIN notes0 nb ON nb.note_id = p.b_id
   WHERE similarity >= 0.5 AND similarity < 0.95 AND NOT EXISTS (SELECT 1 FROM plan_conflicts c WHERE c.a_id = p.a_id AND c.b_id = p.b_id) ORDER BY pair_no LIMIT 10)""",
    "plan_near", "plan_conflicts", "notes0", materialized=True,
)


@query("CON-01", twin("SELECT a_id, b_id, slot FROM con_conflicts", "con_conflicts"))
def con_01(spark, sf):
    n = fact_notes(spark, sf)
    return CO.conflict_candidates(n, CO.scanned_pairs(n), CO.ConsolidationSettings()).select("a_id", "b_id", "slot")


@query("CON-02", twin("SELECT a_id, b_id, canonical_id, round(similarity, 6) AS similarity FROM con_merges", "con_merges"))
def con_02(spark, sf):
    n, cfg = fact_notes(spark, sf), CO.ConsolidationSettings()
    cum = CO.scanned_pairs(n)
    return CO.merge_candidates(n, cum, CO.conflict_candidates(n, cum, cfg), cfg).select("a_id", "b_id", "canonical_id", F.round("similarity", 6).alias("similarity"))


@query("CON-03", twin("SELECT s.note_id, n.src_url AS url, s.state FROM fresh_states s JOIN notes n USING (note_id) WHERE s.status = 'active' AND NOT s.tombstone AND s.state <> 'fresh'", "fresh_states", "notes"))
def con_03(spark, sf):
    return CO.refresh_candidates(fx.notes(spark, sf), fx.NOW).select("note_id", "url", "state")


def sparse_sources(spark, sf):
    return fact_notes(spark, sf).withColumn("sources", F.expr("CASE WHEN d % 5 = 0 THEN array(struct('' AS url, '' AS content_hash)) ELSE sources END"))


REJUDGE = "SELECT note_id, concat_ws(',', CASE WHEN state <> 'fresh' AND {0} THEN 'due_without_source' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END) AS reasons FROM fresh_states WHERE status = 'active' AND NOT tombstone AND d % 46 <> 0 AND (confidence = 'low' OR (state <> 'fresh' AND {0}))"


@query("CON-04", twin(REJUDGE.format("d % 5 = 0"), "fresh_states"))
def con_04(spark, sf):
    return CO.rejudge_candidates(sparse_sources(spark, sf), fx.NOW).select("note_id", "reasons")


PLAN = f"""WITH one AS (SELECT * FROM (SELECT 'refresh' AS action, note_id, 'url=' || src_url AS params FROM fresh_states JOIN notes USING (note_id) WHERE fresh_states.status = 'active' AND NOT fresh_states.tombstone AND state <> 'fresh' ORDER BY note_id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'rejudge', note_id, 'tier=cheap' FROM ({REJUDGE.format('false')}) ORDER BY note_id LIMIT 10)),
 two AS (SELECT * FROM (SELECT 'conflict' AS action, a_id, b_id, slot AS params FROM plan_conflicts ORDER BY a_id, b_id LIMIT 10) UNION ALL SELECT 'merge', a_id, b_id, 'canonical=' || canonical_id FROM plan_merges)
 SELECT action, note_id AS note_ids, sha256(concat_ws(chr(10), action, note_id, sha256(body), params)) AS idempotency_key FROM one JOIN (SELECT note_id, body FROM fact_notes) USING (note_id)
 UNION ALL SELECT action, a_id || ',' || b_id, sha256(concat_ws(chr(10), action, a_id || ',' || b_id, sha256(a.body) || ',' || sha256(b.body), params)) FROM two JOIN fact_notes a ON a.note_id = a_id JOIN fact_notes b ON b.note_id = b_id"""


@query("CON-05", twin(PLAN, "fresh_states", "notes", "plan_conflicts", "plan_merges", "fact_notes"))
def con_05(spark, sf):
    return CO.plan(fact_notes(spark, sf), fx.NOW)


def planned(spark, sf):
    n = fx.notes(spark, sf, False)
    key = X.idempotency_key(F.lit("refresh"), F.array("note_id"), F.array(F.sha2("body", 256)), F.lit(""))
    return n.select("d", F.element_at(F.array(F.lit("merge"), F.lit("refresh"), F.lit("rejudge")), (F.col("d") % 3 + 1).cast("int")).alias("action"), F.col("note_id").alias("note_ids"), key.alias("idempotency_key"))


ob.cte("planned", "SELECT d, ['merge', 'refresh', 'rejudge'][d % 3 + 1] AS action, note_id AS note_ids, sha256(concat_ws(chr(10), 'refresh', note_id, sha256(body), '')) AS idempotency_key FROM notes0", "notes0", materialized=True)


@query("WN-14", twin("SELECT action, note_ids FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY note_ids, idempotency_key) AS rn FROM planned) WHERE rn <= 10", "planned"))
def wn_14(spark, sf):
    return CO.cap_per_class(planned(spark, sf).drop("d"), 10).select("action", "note_ids")


@query("CON-06", twin("SELECT action, note_ids, CASE WHEN d % 4 = 0 THEN 'J-' || (d + CASE WHEN d % 8 = 0 THEN 1000000 ELSE 0 END)::VARCHAR END AS matched_job_id, CASE WHEN d % 4 = 0 THEN 'skipped' ELSE 'pending' END AS status FROM planned", "planned"))
def con_06(spark, sf):
    p = planned(spark, sf)
    jobs = p.selectExpr("idempotency_key", "d AS seq", "concat('J-', cast(d as string)) AS job_id", "CASE WHEN d % 4 = 0 THEN 'done' ELSE 'failed' END AS status")
    more = p.filter("d % 8 = 0").selectExpr("idempotency_key", "d + 1000000 AS seq", "concat('J-', cast(d + 1000000 as string)) AS job_id", "'done' AS status")
    return CO.gate_jobs(p, jobs.unionByName(more)).select("action", "note_ids", "matched_job_id", "status")


@query("CON-07", twin(f"""WITH m AS (SELECT d AS seq, note_id AS canonical_id, {nid('d + CASE WHEN d % 4 = 0 THEN 37 ELSE 1 END')} AS absorbed_id FROM notes0 WHERE d % 3 <> 1), g AS (SELECT absorbed_id AS n, min(seq) AS gone FROM m GROUP BY 1)
 SELECT seq, canonical_id, absorbed_id, CASE WHEN ca.note_id IS NULL OR aa.note_id IS NULL OR coalesce(gc.gone < seq, false) OR coalesce(ga.gone < seq, false) THEN 'failed' ELSE 'done' END AS status FROM m
 LEFT JOIN g gc ON gc.n = canonical_id LEFT JOIN g ga ON ga.n = absorbed_id LEFT JOIN notes0 ca ON ca.note_id = canonical_id AND ca.status = 'active' LEFT JOIN notes0 aa ON aa.note_id = absorbed_id AND aa.status = 'active'""", "notes0"))
def con_07(spark, sf):
    n = fx.notes(spark, sf, False)
    m = n.filter("d % 3 <> 1").selectExpr("d AS seq", "note_id AS canonical_id", f"{fx.nid('d + CASE WHEN d % 4 = 0 THEN 37 ELSE 1 END')} AS absorbed_id")
    return CO.merge_effects(m, n)


@query("CON-08", twin("""SELECT j.note_id, j.url, CASE WHEN n.status <> 'active' THEN 'failed:not_active' WHEN j.url <> n.src_url THEN 'failed:not_cited' WHEN l.content_hash IS NULL THEN 'failed:no_snapshot' WHEN l.content_hash = n.src_hash THEN 'unchanged' ELSE 'changed' END AS outcome
 FROM (SELECT note_id, CASE WHEN d % 13 = 0 THEN 'http://gone/' ELSE src_url END AS url FROM notes) j JOIN notes n USING (note_id) LEFT JOIN latest_snapshot l ON l.url = j.url""", "notes", "latest_snapshot"))
def con_08(spark, sf):
    n = fx.notes(spark, sf)
    jobs = n.selectExpr("note_id", "CASE WHEN d % 13 = 0 THEN 'http://gone/' ELSE sources[0].url END AS url")
    return CO.refresh_effects(jobs, n, PG.latest_by_url(fx.snapshot_log(spark, sf))).select("note_id", "url", "outcome")


_RAW = """CASE d % 6 WHEN 0 THEN '{"verdict": "confirm", "reason": "ok"}' WHEN 1 THEN '{"verdict": "supersede", "reason": "old"}' WHEN 2 THEN '{"verdict": "confirm"}' WHEN 3 THEN '{"verdict": "maybe", "reason": "x"}' WHEN 4 THEN 'not json' ELSE '{"verdict": "confirm", "reason": "a", "more": 1}' END"""


@query("CON-09", twin("""SELECT note_id, CASE WHEN status <> 'active' THEN 'failed:not_active' WHEN d % 6 >= 2 THEN 'failed:malformed' ELSE 'done' END AS status, CASE WHEN status = 'active' AND d % 6 < 2 THEN CASE WHEN d % 6 = 0 THEN 'confirm' ELSE 'supersede' END END AS verdict,
  CASE WHEN status = 'active' AND d % 6 = 1 THEN 'superseded' END AS new_status FROM notes0""", "notes0"))
def con_09(spark, sf):
    n = fx.notes(spark, sf, False)
    return CO.rejudge_effects(n.select("note_id", F.expr(_RAW).alias("raw")), n)


@query("CON-10", twin("SELECT a_id, b_id, slot FROM con_conflicts WHERE pair_no % 3 <> 0", "con_conflicts"))
def con_10(spark, sf):
    n = fact_notes(spark, sf)
    rows = CO.conflict_candidates(n, CO.scanned_pairs(n), CO.ConsolidationSettings())
    return rows.join(rows.filter("pair_no % 3 = 0").select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select("a_id", "b_id", "slot")


@query("CON-11", twin("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ledger, job_id ORDER BY seq DESC) AS rn FROM job_log) WHERE rn = 1), c AS (SELECT event_id AS cmd_id, user_id AS ledger, 'J-' || lpad((event_id % 100)::VARCHAR, 4, '0') AS job_id, CASE WHEN event_id % 2 = 0 THEN 'retry' ELSE 'skip' END AS op FROM events)
 SELECT cmd_id, ledger, job_id, op, outcome, CASE WHEN outcome = 'ok' THEN CASE WHEN op = 'retry' THEN 'pending' ELSE 'skipped' END END AS status, CASE WHEN outcome = 'ok' THEN attempt + CASE WHEN op = 'retry' THEN 1 ELSE 0 END END::BIGINT AS attempt FROM (
 SELECT c.*, f.attempt, CASE WHEN f.status IS NULL THEN 'unknown_job' WHEN op = 'retry' AND f.status <> 'failed' THEN 'only_failed_can_retry' WHEN op = 'skip' AND f.status NOT IN ('pending', 'failed') THEN 'only_pending_or_failed_can_skip' ELSE 'ok' END AS outcome FROM c LEFT JOIN f USING (ledger, job_id))""", "job_log"))
def con_11(spark, sf):
    cmds = fx.table(spark, sf, "events").selectExpr("event_id AS cmd_id", "user_id AS ledger", "concat('J-', lpad(cast(event_id % 100 as string), 4, '0')) AS job_id", "CASE WHEN event_id % 2 = 0 THEN 'retry' ELSE 'skip' END AS op")
    return CO.transition(cmds, fx.job_log(spark, sf))
