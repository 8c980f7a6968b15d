"""Aggregates (AG), windows (WN), model output (LLM), policy (POL) and evaluation (EVL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.operators import analytics as A
from kledger.operators import modelout as M
from kledger.operators import policy as P
from kledger.operators import retrieval as R
from kledger.operators.freshness import with_freshness
from kledger.plans import fixtures as fx
from kledger.plans import oracle_base as ob
from kledger.plans.fn import REQUEST_HASH_SQL, norm_sql, requests, tokens_sql
from kledger.plans.oracle_base import cosine, ranked_twin, twin
from kledger.plans.registry import query
from kledger.plans.ret import chains

# ---- scoring and matrices --------------------------------------------------------------------------
_ph = " OR ".join(f"contains(na, '{p}')" for p in A.REFUSAL_PHRASES)
ob.cte(
    "scored",
    f"""SELECT *, CASE WHEN answer IS NOT NULL THEN CASE WHEN len(ng) = 0 THEN 0.0 ELSE len(list_filter(ng, lambda g: g <> '' AND contains(na, g)))::DOUBLE / len(ng) END END AS em,
   CASE WHEN answer IS NOT NULL THEN len(list_filter(ng, lambda g: g <> '' AND contains(na, g))) END AS n_hits, length(na) < 80 AND ({_ph}) AS refusal,
   CASE WHEN n_sources > 0 AND answer IS NOT NULL THEN len(list_filter(list_distinct(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)), lambda n: n::INTEGER BETWEEN 1 AND n_sources))::DOUBLE / n_sources END AS citation_coverage
 FROM (SELECT *, {norm_sql('answer')} AS na, list_transform(gold_points, lambda g: {norm_sql('g')}) AS ng FROM eval_rows)""",
    "eval_rows", materialized=True,
)


def scored(spark, sf):
    return A.score_answers(fx.eval_rows(spark, sf))


SCORED = "qid, condition, round(em, 6) AS em, refusal, round(citation_coverage, 6) AS citation_coverage"


@query("EVL-01", twin(f"SELECT {SCORED}, n_hits::INTEGER AS n_hits FROM scored", "scored"))
def evl_01(spark, sf):
    hits = F.when(F.col("point_hits").isNotNull(), F.size(F.filter("point_hits", lambda h: h)))
    return scored(spark, sf).select("qid", "condition", F.round("em", 6).alias("em"), "refusal", F.round("citation_coverage", 6).alias("citation_coverage"), hits.alias("n_hits"))


@query("AG-06", twin("SELECT qid, condition, round(em, 6) AS em FROM scored WHERE em IS NOT NULL", "scored"))
def ag_06(spark, sf):
    return scored(spark, sf).filter("em IS NOT NULL").select("qid", "condition", F.round("em", 6).alias("em"))


@query("AG-07", twin("SELECT qid, condition, refusal FROM scored", "scored"))
def ag_07(spark, sf):
    return scored(spark, sf).select("qid", "condition", "refusal")


@query("AG-08", twin("SELECT qid, condition, round(citation_coverage, 6) AS citation_coverage FROM scored", "scored"))
def ag_08(spark, sf):
    return scored(spark, sf).select("qid", "condition", F.round("citation_coverage", 6).alias("citation_coverage"))


PCT = "round(quantile_cont({0}, 0.5), 6) AS latency_p50, round(quantile_cont({0}, 0.95), 6) AS latency_p95"
MATRIX = f"""SELECT condition, count(*)::BIGINT AS n, round(coalesce(avg(em), 0.0), 6) AS em_mean, count(em)::BIGINT AS em_n, round(count(*) FILTER (coalesce(refusal, false))::DOUBLE / count(*), 6) AS refusal_rate, round(avg(input_tokens), 6) AS in_mean, round(avg(output_tokens), 6) AS out_mean,
  round(CASE WHEN count(fresh_search_count) > 0 THEN avg(coalesce(fresh_search_count, 0)) END, 6) AS fresh_mean, {PCT.format('latency_ms')} FROM scored GROUP BY condition"""


@query("AG-02", twin(MATRIX, "scored"))
def ag_02(spark, sf):
    return A.condition_matrix(scored(spark, sf))


@query("AG-03", twin(f"SELECT step, {PCT.format('latency_ms')} FROM token_ledger GROUP BY step", "token_ledger"))
def ag_03(spark, sf):
    return A.exact_percentiles(fx.token_ledger(spark, sf), ["step"], "latency_ms", A.P50_95)


def judge_outputs(spark, sf):
    body = "concat('\"coverage\": ', cast(k % 7 as string), ', \"citation\": ', cast(k % 5 as string), '.5, \"temporal\": ', cast(k % 4 + 1 as string), ', \"reasons\": \"r {x}\"')"
    raw = (
        f"CASE item_id % 5 WHEN 0 THEN concat('{{', {body}, '}}') WHEN 1 THEN concat('```json\\n{{', {body}, '}}\\n```') WHEN 2 THEN concat('Sure {{no}}: {{', {body}, '}} done') WHEN 3 THEN '{{\"coverage\": 3}}'"
        " ELSE '{\"coverage\": true, \"citation\": 2, \"temporal\": 3, \"reasons\": \"x\"}' END"
    ).replace("{{", "{").replace("}}", "}")
    return fx.eval_rows(spark, sf).select("item_id", "qid", "condition", "k", F.expr(raw).alias("raw"))


ob.cte(
    "judged",
    """SELECT k, item_id, qid, condition, CASE WHEN item_id % 5 <= 2 THEN greatest(1, least(5, k % 7))::INTEGER END AS coverage, CASE WHEN item_id % 5 <= 2 THEN greatest(1, least(5, round_even(k % 5 + 0.5, 0)))::INTEGER END AS citation, CASE WHEN item_id % 5 <= 2 THEN (k % 4 + 1)::INTEGER END AS temporal FROM eval_rows""",
    "eval_rows",
)


@query("LLM-04", twin("SELECT qid, condition, coverage, citation, temporal FROM judged", "judged"))
def llm_04(spark, sf):
    return M.judge_scores(judge_outputs(spark, sf)).select("qid", "condition", "coverage", "citation", "temporal")


JUDGE_MEANS = "round(avg(coverage), 6) AS coverage, round(avg(citation), 6) AS citation, round(avg(temporal), 6) AS temporal, count(coverage)::BIGINT AS judged_n"


def judge_means(df):
    return df.groupBy("condition").agg(*[F.round(F.avg(s), 6).alias(s) for s in M.SCORES], F.count("coverage").alias("judged_n"))


@query("AG-04", twin(f"SELECT condition, {JUDGE_MEANS} FROM judged GROUP BY condition", "judged"))
def ag_04(spark, sf):
    return judge_means(M.judge_scores(judge_outputs(spark, sf)))


@query("AG-05", twin("SELECT condition, round(avg(citation_coverage), 6) AS coverage_mean, count(citation_coverage)::BIGINT AS coverage_n, count(em)::BIGINT AS em_n FROM scored GROUP BY condition", "scored"))
def ag_05(spark, sf):
    return A.coverage_means(scored(spark, sf))


@query("EVL-02", twin(f"SELECT m.*, j.* EXCLUDE (condition), v.coverage_mean, v.coverage_n FROM ({MATRIX}) m JOIN (SELECT condition, {JUDGE_MEANS} FROM judged GROUP BY condition) j USING (condition) JOIN (SELECT condition, round(avg(citation_coverage), 6) AS coverage_mean, count(citation_coverage)::BIGINT AS coverage_n FROM scored GROUP BY condition) v USING (condition)", "scored", "judged"))
def evl_02(spark, sf):
    s = scored(spark, sf)
    return A.condition_matrix(s).join(judge_means(M.judge_scores(judge_outputs(spark, sf))), "condition").join(A.coverage_means(s).drop("em_n"), "condition")


@query("EVL-03", twin(f"SELECT {SCORED}, qtype, input_tokens, j.coverage AS judge_coverage FROM scored s JOIN (SELECT k, coverage FROM judged) j USING (k)", "scored", "judged"))
def evl_03(spark, sf):
    j = M.judge_scores(judge_outputs(spark, sf)).select("k", F.col("coverage").alias("judge_coverage"))
    return scored(spark, sf).join(j, "k").select("qid", "condition", F.round("em", 6).alias("em"), "refusal", F.round("citation_coverage", 6).alias("citation_coverage"), "qtype", "input_tokens", "judge_coverage")


@query("SRC-11", twin("SELECT condition, '| ' || condition || ' | ' || n::VARCHAR || ' | ' || em_n::VARCHAR || ' | a／b |' AS line FROM (SELECT condition, count(*) AS n, count(em) AS em_n FROM scored GROUP BY condition)", "scored"))
def src_11(spark, sf):
    m = scored(spark, sf).groupBy("condition").agg(F.count("*").alias("n"), F.count("em").alias("em_n")).withColumn("note", F.lit(" a|b "))
    return A.markdown_rows(m, ["condition", "n", "em_n", "note"])


@query("AG-13", twin("SELECT t.qtype, count(e.item_id)::BIGINT AS n FROM (SELECT unnest(['single_hop', 'multi_hop', 'temporal', 'unanswerable', 'other']) AS qtype) t LEFT JOIN (SELECT DISTINCT item_id, qtype FROM eval_rows) e USING (qtype) GROUP BY 1", "eval_rows"))
def ag_13(spark, sf):
    types = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("single_hop", "multi_hop", "temporal", "unanswerable", "other")])).alias("qtype"))
    n = fx.eval_rows(spark, sf).select("item_id", "qtype").distinct().groupBy("qtype").agg(F.count("*").alias("n"))
    return types.join(n, "qtype", "left").select("qtype", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# ---- token ledger ----------------------------------------------------------------------------------
@query("AG-01", twin("SELECT trace_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) FILTER (error_type IS NOT NULL)::BIGINT AS errors FROM token_ledger GROUP BY 1", "token_ledger"))
def ag_01(spark, sf):
    return trace_sums(fx.token_ledger(spark, sf))


def trace_sums(ledger):
    return ledger.groupBy("trace_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("error_type").isNotNull()).alias("errors"))


@query("AG-24", twin("""SELECT trace_id, count(*) FILTER (step = 'view')::BIGINT AS prior_hit_count, count(*) FILTER (step = 'click')::BIGINT AS fresh_search_count, count(*) FILTER (step = 'signup')::BIGINT AS fresh_fetch_count, count(*) FILTER (step = 'purchase')::BIGINT AS notes_created,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(latency_ms), 4) AS latency_ms, round(count(*) FILTER (step = 'purchase')::DOUBLE / nullif(count(*) FILTER (step IN ('view', 'purchase')), 0), 4) AS citation_coverage FROM token_ledger GROUP BY 1""", "token_ledger"))
def ag_24(spark, sf):
    t = fx.token_ledger(spark, sf)
    logs = {"view": "prior_hit_count", "click": "fresh_search_count", "signup": "fresh_fetch_count", "purchase": "notes_created"}
    counts = [F.count_if(F.col("step") == step).alias(name) for step, name in logs.items()]
    df = t.groupBy("trace_id").agg(*counts, F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("latency_ms"), 4).alias("latency_ms"))
    cov = F.try_divide(F.col("notes_created").cast("double"), (F.col("prior_hit_count") + F.col("notes_created")).cast("double"))
    return df.withColumn("citation_coverage", F.round(cov, 4))


@query("JN-18", twin("SELECT m.trace_id, m.tok AS main_tokens, coalesce(j.tok, 0)::BIGINT AS judge_tokens FROM (SELECT trace_id, sum(input_tokens)::BIGINT AS tok FROM token_ledger WHERE step <> 'view' GROUP BY 1) m LEFT JOIN (SELECT trace_id, sum(input_tokens)::BIGINT AS tok FROM token_ledger WHERE step = 'view' GROUP BY 1) j USING (trace_id)", "token_ledger"))
def jn_18(spark, sf):
    t = fx.token_ledger(spark, sf).withColumn("trace_id", F.when(F.col("step") == "view", F.concat("trace_id", F.lit("-judge"))).otherwise(F.col("trace_id")))
    s = t.groupBy("trace_id").agg(F.sum("input_tokens").alias("tok"))
    judge = s.filter("trace_id LIKE '%-judge'").select(F.expr("substr(trace_id, 1, length(trace_id) - 6)").alias("trace_id"), F.col("tok").alias("judge_tokens"))
    return s.filter("trace_id NOT LIKE '%-judge'").join(judge, "trace_id", "left").select("trace_id", F.col("tok").alias("main_tokens"), F.coalesce("judge_tokens", F.lit(0)).cast("bigint").alias("judge_tokens"))


@query("EVL-12", twin("""SELECT trace_id, m_in, l_in FROM (SELECT trace_id, sum(input_tokens)::BIGINT AS l_in FROM token_ledger WHERE event_id % 97 <> 0 GROUP BY 1) l FULL JOIN (SELECT trace_id, sum(input_tokens)::BIGINT AS m_in FROM token_ledger GROUP BY 1) m USING (trace_id) WHERE m_in IS DISTINCT FROM l_in""", "token_ledger"))
def evl_12(spark, sf):
    t = fx.token_ledger(spark, sf)
    return A.reconcile(trace_sums(t), t.filter("event_id % 97 <> 0")).filter(~F.col("m_in").eqNullSafe(F.col("l_in"))).select("trace_id", "m_in", "l_in")


@query("EVL-04", """SELECT user_id, (sum(CASE WHEN event_id % 2 = 1 THEN floor(value * 100) END) - sum(CASE WHEN event_id % 2 = 0 THEN floor(value * 100) END))::BIGINT AS input_diff, round(sum(CASE WHEN event_id % 2 = 1 THEN value * 7 END) - sum(CASE WHEN event_id % 2 = 0 THEN value * 7 END), 4) AS latency_diff FROM events GROUP BY user_id""")
def evl_04(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "cold").otherwise("warm").alias("run"), F.floor(F.col("value") * 100).cast("bigint").alias("tok"), (F.col("value") * 7).alias("lat"))
    p = e.groupBy("user_id").pivot("run", ["cold", "warm"]).agg(F.sum("tok").alias("tok"), F.sum("lat").alias("lat"))
    return p.select("user_id", (F.col("warm_tok") - F.col("cold_tok")).alias("input_diff"), F.round(F.col("warm_lat") - F.col("cold_lat"), 4).alias("latency_diff"))


def lag_modes(spark, sf):
    return fx.seq_rows(spark, sf).filter("policy_mode IS NOT NULL")


@query("EVL-05", twin("""SELECT run, CASE WHEN (s IS NOT NULL)::INT + (u IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 2 THEN coalesce(s <= u, true) AND coalesce(u <= d, true) AND (u IS NOT NULL OR coalesce(s <= d, true)) END AS ladder_ok, si < di AS cost_gap_ok FROM (
 SELECT run, max(judge_in_tok) FILTER (policy_mode = 'simple') AS s, max(judge_in_tok) FILTER (policy_mode = 'update') AS u, max(judge_in_tok) FILTER (policy_mode = 'deep') AS d, sum(in_tok) FILTER (policy_mode = 'simple') AS si, sum(in_tok) FILTER (policy_mode = 'deep') AS di FROM seq_rows WHERE policy_mode IS NOT NULL GROUP BY run)""", "seq_rows"))
def evl_05(spark, sf):
    g = lag_modes(spark, sf).groupBy("run").pivot("policy_mode", ["simple", "update", "deep"]).agg(F.max("judge_in_tok").alias("n"), F.sum("in_tok").alias("tok"))
    s, u, d = (F.col(f"{m}_n") for m in ("simple", "update", "deep"))
    present = sum((c.isNotNull().cast("int") for c in (s, u, d)), F.lit(0))
    ok = F.coalesce(s <= u, F.lit(True)) & F.coalesce(u <= d, F.lit(True)) & (u.isNotNull() | F.coalesce(s <= d, F.lit(True)))
    return g.select("run", F.when(present >= 2, ok).alias("ladder_ok"), (F.col("simple_tok") < F.col("deep_tok")).alias("cost_gap_ok"))


# ---- sequence experiments --------------------------------------------------------------------------
ob.cte(
    "curve",
    """SELECT g.run, g.event_id, g.kind AS event_kind, c.condition, sum(coalesce(m, 0)) OVER w AS main, sum(coalesce(j, 0)) OVER w AS judge, sum(coalesce(e, 0)) OVER w AS emb FROM (SELECT run, event_id, max(event_kind) AS kind FROM seq_rows GROUP BY ALL) g
  CROSS JOIN (SELECT unnest(['c1', 'c2', 'c3', 'c4']) AS condition) c LEFT JOIN (SELECT run, event_id, condition, sum(in_tok) AS m, sum(judge_in_tok) AS j, sum(coalesce(embedding_calls, 0)) AS e FROM seq_rows GROUP BY ALL) p ON p.run = g.run AND p.event_id = g.event_id AND p.condition = c.condition
  WINDOW w AS (PARTITION BY g.run, c.condition ORDER BY g.event_id)""",
    "seq_rows", materialized=True,
)
ob.cte("amort", "SELECT run, condition, event_id, main + judge AS all_in, row_number() OVER (PARTITION BY run, condition ORDER BY event_id) AS n FROM curve WHERE event_kind = 'query'", "curve", materialized=True)


def curve(spark, sf):
    return A.cost_curve(fx.seq_rows(spark, sf))


@query("WN-01", twin("SELECT run, event_id, condition, main::BIGINT AS main, judge::BIGINT AS judge, emb::BIGINT AS emb FROM curve", "curve"))
def wn_01(spark, sf):
    return curve(spark, sf).select("run", "event_id", "condition", "main", "judge", "emb")


@query("WN-02", twin("SELECT run, condition, n::BIGINT AS n, event_id, round(all_in / n, 6) AS per_query FROM amort", "amort"))
def wn_02(spark, sf):
    return A.amortized(curve(spark, sf)).select("run", "condition", "n", "event_id", "per_query")


@query("WN-03", twin("SELECT t.run, t.condition AS target, min(CASE WHEN s.all_in <= t.all_in THEN t.n END)::BIGINT AS crossing FROM amort t JOIN amort s ON s.run = t.run AND s.n = t.n AND s.condition = 'c4' WHERE t.condition <> 'c4' GROUP BY ALL", "amort"))
def wn_03(spark, sf):
    return A.break_even(A.amortized(curve(spark, sf)))


ob.cte(
    "repeats",
    """SELECT q.run, qid, first, second, CASE WHEN u.upd IS NULL OR second < u.upd THEN 'intra' WHEN first < u.upd AND u.upd < second THEN 'straddle' END AS kind FROM (
   SELECT run, qid, min(event_id) FILTER (rn = 1) AS first, min(event_id) FILTER (rn = 2) AS second FROM (SELECT run, qid, event_id, row_number() OVER (PARTITION BY run, qid ORDER BY event_id) AS rn FROM (SELECT DISTINCT run, qid, event_id FROM seq_rows WHERE event_kind = 'query')) GROUP BY ALL) q
  LEFT JOIN (SELECT run, min(event_id) AS upd FROM seq_rows WHERE event_kind = 'update' GROUP BY run) u ON u.run = q.run WHERE second IS NOT NULL""",
    "seq_rows", materialized=True,
)


@query("WN-09", twin("SELECT run, qid, first, second, kind FROM repeats WHERE kind IS NOT NULL", "repeats"))
def wn_09(spark, sf):
    return A.repeat_pairs(fx.seq_rows(spark, sf))


@query("AG-14", twin(f"SELECT condition, count(*)::BIGINT AS n_rows, sum(in_tok)::BIGINT AS main_in, sum(judge_in_tok)::BIGINT AS judge_in, sum(out_tok)::BIGINT AS main_out, sum(coalesce(embedding_calls, 0))::BIGINT AS embedding, {PCT.format('latency_ms')} FROM seq_rows GROUP BY condition", "seq_rows"))
def ag_14(spark, sf):
    return A.condition_totals(fx.seq_rows(spark, sf))


@query("AG-15", twin("SELECT run, count(*) FILTER (policy_mode = 'simple')::BIGINT AS simple_n, count(*) FILTER (policy_mode = 'update')::BIGINT AS update_n, count(*) FILTER (policy_mode = 'deep')::BIGINT AS deep_n, round(count(*) FILTER (policy_mode = 'simple')::DOUBLE / count(*), 6) AS simple_rate FROM seq_rows WHERE condition = 'c4' AND event_kind = 'query' GROUP BY run", "seq_rows"))
def ag_15(spark, sf):
    q = fx.seq_rows(spark, sf).filter("condition = 'c4' AND event_kind = 'query'")
    return q.groupBy("run").agg(*[F.count_if(F.col("policy_mode") == m).alias(f"{m}_n") for m in ("simple", "update", "deep")], F.round(F.count_if(F.col("policy_mode") == "simple") / F.count("*"), 6).alias("simple_rate"))


_q, _t = "event_kind = 'query'", "event_kind = 'query' AND event_id > 17 AND gold_source = 'base' AND qtype = 'temporal'"
ob.cte(
    "sstats",
    f"""SELECT run, condition, avg(citation_coverage) FILTER ({_q} AND qtype <> 'unanswerable') AS acov, avg(em) FILTER ({_t}) AS tem, avg(citation_coverage) FILTER ({_t}) AS tcov, count(*) FILTER ({_t}) AS tn, count(*) FILTER ({_q} AND qtype = 'unanswerable') AS un,
  min(citation_coverage) FILTER ({_q} AND qtype = 'unanswerable') AS umin, count(*) FILTER ({_q} AND gold_source = 'override') AS orn, coalesce(sum(in_tok) FILTER (NOT ({_q})), 0)::BIGINT AS build, sum(in_tok + judge_in_tok)::BIGINT AS all_in, count(*) FILTER ({_q}) AS qn, count(*) FILTER ({_q} AND policy_mode = 'simple') AS sn FROM seq_rows GROUP BY ALL""",
    "seq_rows", materialized=True,
)


@query("EVL-06", twin("SELECT run, condition, round(acov, 6) AS answerable_cov, round(tem, 6) AS temporal_em, round(tcov, 6) AS temporal_cov, tn::BIGINT AS temporal_n, un::BIGINT AS unanswerable_n, orn::BIGINT AS override_n, build AS build_cost, all_in FROM sstats", "sstats"))
def evl_06(spark, sf):
    return A.sequence_stats(fx.seq_rows(spark, sf)).select("run", "condition", "answerable_cov", "temporal_em", "temporal_cov", "temporal_n", "unanswerable_n", "override_n", "build_cost", "all_in")


@query("EVL-07", twin("""WITH r AS (SELECT p.run, count(*) AS n_pairs, count(*) FILTER (b.citation_coverage < a.citation_coverage) AS n_down, count(*) FILTER (a.citation_coverage IS NOT NULL AND b.citation_coverage IS NOT NULL) AS n_both FROM repeats p
   LEFT JOIN seq_rows a ON a.run = p.run AND a.event_id = p.first AND a.condition = 'c4' LEFT JOIN seq_rows b ON b.run = p.run AND b.event_id = p.second AND b.condition = 'c4' WHERE kind = 'intra' GROUP BY p.run),
 s AS (SELECT run, round(acov, 6) AS acov, round(tem, 6) AS tem, round(tcov, 6) AS tcov, tn, umin, all_in, qn, sn, condition FROM sstats),
 x AS (SELECT b.run, c4.all_in AS a4, c2.all_in AS a2, c4.acov - c2.acov AS dcov, c4.umin,
   CASE WHEN n_pairs IS NULL THEN 'undetermined' WHEN n_down > 0 THEN 'falsified' WHEN c4.qn > 0 AND c4.sn = 0 THEN 'falsified' WHEN n_both = n_pairs AND c4.sn > 0 THEN 'hold' ELSE 'undetermined' END AS reuse,
   CASE WHEN coalesce(c4.tn, 0) = 0 THEN 'undetermined' WHEN c2.tcov IS NULL AND c2.tem IS NULL THEN 'undetermined' WHEN coalesce(c4.tcov > c2.tcov AND c4.tcov > c3.tcov, false) OR coalesce(c4.tem > c2.tem AND c4.tem > c3.tem, false) THEN 'hold'
    WHEN coalesce(c4.tcov <= c2.tcov AND c4.tcov <= c3.tcov, false) AND coalesce(c4.tem <= c2.tem AND c4.tem <= c3.tem, false) THEN 'falsified' ELSE 'undetermined' END AS evolution
  FROM (SELECT DISTINCT run FROM seq_rows) b LEFT JOIN s c4 ON c4.run = b.run AND c4.condition = 'c4' LEFT JOIN s c2 ON c2.run = b.run AND c2.condition = 'c2' LEFT JOIN s c3 ON c3.run = b.run AND c3.condition = 'c3' LEFT JOIN r ON r.run = b.run)
 SELECT run, CASE WHEN a4 IS NULL OR a2 IS NULL THEN 'undetermined' WHEN a4 <= a2 THEN 'hold' WHEN dcov >= 0.5 THEN 'hold' WHEN reuse = 'falsified' AND evolution = 'falsified' THEN 'falsified' ELSE 'undetermined' END AS economy, reuse, evolution,
  CASE WHEN umin IS NULL THEN 'undetermined' WHEN umin <= 0.25 THEN 'falsified' ELSE 'not_falsified' END AS anti_fabrication FROM x""", "repeats", "sstats", "seq_rows"))
def evl_07(spark, sf):
    return A.verdict_table(fx.seq_rows(spark, sf))


@query("JN-17", twin("SELECT s.run, s.event_id, s.condition, CASE WHEN gold_source = 'override' THEN 'override' ELSE coalesce(b.text, '') END AS gold, gold_source, qtype FROM seq_rows s LEFT JOIN benchmark b ON 'q' || b.item_id::VARCHAR = s.qid WHERE event_kind = 'query'", "seq_rows"))
def jn_17(spark, sf):
    gold = fx.table(spark, sf, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("base_gold"))
    over = F.when(F.col("gold_source") == "override", F.lit("override"))
    rows = fx.seq_rows(spark, sf).filter("event_kind = 'query'").join(gold, "qid", "left")
    return rows.select("run", "event_id", "condition", F.coalesce(over, "base_gold", F.lit("")).alias("gold"), "gold_source", "qtype")


@query("JN-16", "WITH a AS (SELECT doc_id % 97 AS arrive, CASE WHEN doc_id % 7 = 0 THEN doc_id % 97 + 5 END AS replaced FROM documents), e AS (SELECT arrive AS event_id FROM a UNION SELECT replaced FROM a WHERE replaced IS NOT NULL) SELECT event_id, (SELECT count(*) FROM a WHERE arrive <= event_id AND (replaced IS NULL OR event_id < replaced))::BIGINT AS visible FROM e")
def jn_16(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id % 97 AS arrive", "CASE WHEN doc_id % 7 = 0 THEN doc_id % 97 + 5 END AS replaced")
    return A.visible_counts(d)


# ---- conversations and ledgers in order ------------------------------------------------------------
ob.cte(
    "segments",
    """SELECT *, (sum(CASE WHEN rn = 1 OR (role = 'assistant' AND NOT (rn = 2 AND coalesce(prev = 'user', false))) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS segment FROM (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
    "messages", materialized=True,
)


@query("WN-07", twin("SELECT conv_id, turn, role, segment FROM segments", "segments"))
def wn_07(spark, sf):
    return A.segment_turns(fx.messages(spark, sf)).select("conv_id", "turn", "role", "segment")


@query("WN-08", twin(f"""WITH t AS (SELECT *, {tokens_sql('content')} + {tokens_sql('role')} + {tokens_sql('name')} AS tokens, max(segment) OVER (PARTITION BY conv_id) AS ns FROM segments)
 SELECT conv_id, max(ns)::BIGINT AS n_segments, sum(tokens)::BIGINT AS pre_tokens, sum(tokens) FILTER (segment > ns - 2)::BIGINT AS kept_tokens, min(turn) FILTER (segment > ns - 2) AS kept_from, sum(tokens) >= 280 AND max(ns) > 2 AS compact,
  substr(arg_min(content, turn) FILTER (role = 'assistant' AND trim(content) <> ''), 1, 200) AS plan FROM t GROUP BY conv_id""", "segments"))
def wn_08(spark, sf):
    return A.compaction_plan(fx.messages(spark, sf), window=400, ratio=0.7, keep=2)


@query("AG-26", twin("SELECT conv_id, turn, '[' || name || '] ' || substr(content, 1, 800) || CASE WHEN length(content) > 800 THEN '…' ELSE '' END AS line FROM messages WHERE role = 'tool'", "messages"))
def ag_26(spark, sf):
    return A.tool_digest(fx.messages(spark, sf))


@query("AG-20", twin("SELECT conv_id % 10 AS run_group, count(DISTINCT conv_id)::BIGINT AS runs, count(*)::BIGINT AS events, sum(length(content))::BIGINT AS pre_total, sum(least(length(content), 100))::BIGINT AS post_total FROM messages WHERE role = 'assistant' GROUP BY 1", "messages"))
def ag_20(spark, sf):
    m = fx.messages(spark, sf).filter("role = 'assistant'")
    return m.groupBy((F.col("conv_id") % 10).alias("run_group")).agg(F.countDistinct("conv_id").alias("runs"), F.count("*").alias("events"), F.sum(F.length("content")).alias("pre_total"), F.sum(F.least(F.length("content"), F.lit(100))).alias("post_total"))


def outcomes(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("user_id AS worker", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'failed' ELSE 'done' END AS status")


STREAKS = """SELECT worker, seq, streak::BIGINT AS streak, streak = 3 AS pause FROM (SELECT *, CASE WHEN status = 'failed' THEN row_number() OVER (PARTITION BY worker, grp ORDER BY seq) - CASE WHEN grp = 0 THEN 0 ELSE 1 END ELSE 0 END AS streak FROM (
  SELECT user_id AS worker, event_id AS seq, CASE WHEN event_type IN ('error', 'click') THEN 'failed' ELSE 'done' END AS status, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events))"""


@query("WN-11", STREAKS)
def wn_11(spark, sf):
    return A.failure_streaks(outcomes(spark, sf)).select("worker", "seq", "streak", "pause")


@query("WN-12", """SELECT worker, day, n, before FROM (SELECT *, lag(n) OVER (PARTITION BY worker ORDER BY day) AS before FROM (SELECT user_id AS worker, (epoch_us(ts) // 86400000000)::BIGINT AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL)) WHERE n > before""")
def wn_12(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("worker"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("bigint").alias("day"))
    return A.growth_violations(e.groupBy("worker", "day").agg(F.count("*").alias("n")))


_STEP = "CASE event_type WHEN 'view' THEN 'plan' WHEN 'purchase' THEN concat('act:', cast(event_id % 7 as {s})) WHEN 'signup' THEN 'distill' END"


@query("WN-16", f"SELECT worker, seq, last_value(step IGNORE NULLS) OVER (PARTITION BY worker ORDER BY seq) AS current FROM (SELECT user_id AS worker, event_id AS seq, {_STEP.format(s='varchar')} AS step FROM events)")
def wn_16(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.expr(_STEP.format(s="string")).alias("step"))
    return A.current_step(e).select("worker", "seq", "current")


@query("AG-25", "SELECT user_id AS worker, count(*) FILTER (event_type NOT IN ('error', 'click'))::BIGINT AS done, count(*) FILTER (event_type = 'click')::BIGINT AS timeout, count(*) FILTER (event_type = 'error')::BIGINT AS error FROM events GROUP BY 1")
def ag_25(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("worker")).agg(F.count_if(~F.col("event_type").isin("error", "click")).alias("done"), F.count_if(F.col("event_type") == "click").alias("timeout"), F.count_if(F.col("event_type") == "error").alias("error"))


_URL = "concat('http://s/', cast(cast(floor(value) as bigint) % 10 as {s}))"
_HASH = "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('h', cast(event_id % 5 as {s})) END"
POOL_SQL = """SELECT run, row_number() OVER (PARTITION BY run ORDER BY pos)::BIGINT AS number, url, content_hash FROM (SELECT run, url, min(pos) AS pos, coalesce(arg_min(h, pos) FILTER (h <> ''), '') AS content_hash FROM ({}) GROUP BY run, url)"""


@query("AG-23", POOL_SQL.format(f"SELECT user_id AS run, event_id AS pos, {_URL.format(s='varchar')} AS url, {_HASH.format(s='varchar')} AS h FROM events"))
def ag_23(spark, sf):
    rows = fx.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), F.expr(_URL.format(s="string")).alias("url"), F.expr(_HASH.format(s="string")).alias("content_hash"))
    return A.source_pool(rows)


@query("AG-27", POOL_SQL.format(f"""SELECT user_id AS run, event_id * 10 + i AS pos, u AS url, CASE WHEN i = 0 THEN h ELSE '' END AS h FROM (SELECT user_id, event_id, h, unnest(CASE event_id % 4 WHEN 0 THEN [u, u || '/b'] WHEN 1 THEN [u] WHEN 2 THEN [u, u || '/c'] ELSE [] END) AS u, unnest(CASE event_id % 4 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] WHEN 2 THEN [0, 1] ELSE [] END) AS i
 FROM (SELECT user_id, event_id, {_URL.format(s='varchar')} AS u, {_HASH.format(s='varchar')} AS h FROM events))"""))
def ag_27(spark, sf):
    u, h = _URL.format(s="string"), _HASH.format(s="string")
    content = (
        f"CASE event_id % 4 WHEN 0 THEN to_json(struct(array(struct({u} AS url, {h} AS content_hash), struct(concat({u}, '/b') AS url, '' AS content_hash)) AS results))"
        f" WHEN 1 THEN to_json(struct({u} AS url, {h} AS content_hash)) WHEN 2 THEN to_json(struct(array(struct({u} AS url, {h} AS content_hash), struct(concat({u}, '/c') AS url, '' AS content_hash)) AS sources)) ELSE 'plain text' END"
    )
    m = fx.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.expr(content).alias("content"))
    return A.source_pool(A.logged_sources(m))


@query("TK-08", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, min(event_id) OVER (PARTITION BY event_type) AS seen FROM events) ORDER BY r, seen LIMIT 123")
def tk_08(spark, sf):
    return A.round_robin(fx.table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", 123).select("event_id")


# ---- validation ------------------------------------------------------------------------------------
_QA = "CASE WHEN item_id % 11 = 0 THEN 'dup' ELSE concat('q', cast(item_id as {s})) END"


@query("EVL-08", twin("""SELECT item_id, concat_ws(',', CASE WHEN n > 1 THEN 'duplicate_qid' END, CASE WHEN item_id % 6 = 0 THEN 'bad_type' END, CASE WHEN item_id % 6 <> 0 AND qtype = 'unanswerable' AND item_id % 8 = 7 THEN 'points_for_unanswerable' END, CASE WHEN item_id % 6 <> 0 AND qtype <> 'unanswerable' AND item_id % 5 = 0 THEN 'points_range' END) AS errors
 FROM (SELECT item_id, qtype, count(*) OVER (PARTITION BY CASE WHEN item_id % 11 = 0 THEN 'dup' ELSE 'q' || item_id::VARCHAR END) AS n FROM (SELECT item_id, ['single_hop', 'multi_hop', 'temporal', 'unanswerable'][item_id % 4 + 1] AS qtype FROM benchmark))"""))
def evl_08(spark, sf):
    from kledger.operators.validate import qa_errors

    b = fx.table(spark, sf, "benchmark").selectExpr(
        "item_id", f"{_QA.format(s='string')} AS qid", "text AS question",
        "CASE WHEN item_id % 6 = 0 THEN 'riddle' ELSE element_at(array('single_hop', 'multi_hop', 'temporal', 'unanswerable'), cast(item_id % 4 + 1 as int)) END AS qtype",
        "CASE WHEN item_id % 4 = 3 THEN CASE WHEN item_id % 8 = 7 THEN array('p') ELSE array() END WHEN item_id % 5 = 0 THEN array('p') ELSE array('p', 'q', 'r') END AS gold_points",
    )
    return qa_errors(b).select("item_id", "errors")


ob.cte("tl", "SELECT * FROM (SELECT DISTINCT run, CASE WHEN run % 5 = 1 AND event_id > 9 THEN event_id + 1 ELSE event_id END AS event_id, CASE WHEN run % 7 = 2 AND event_id = 20 THEN 'update' ELSE event_kind END AS kind, CASE WHEN run % 6 = 3 AND event_id = 22 THEN 'q1' ELSE qid END AS qid, qtype FROM seq_rows WHERE condition = 'c2')", "seq_rows", materialized=True)


@query("EVL-09", twin("""SELECT run, 'gap' AS violation, event_id FROM (SELECT run, event_id, lag(event_id) OVER (PARTITION BY run ORDER BY event_id) AS p FROM tl) WHERE event_id <> p + 1
 UNION ALL SELECT run, 'updates', count(*) FILTER (kind = 'update')::INTEGER FROM tl GROUP BY run HAVING count(*) FILTER (kind = 'update') <> 1
 UNION ALL SELECT run, 'asked_often', max(event_id) FROM tl WHERE kind = 'query' GROUP BY run, qid HAVING count(*) > 2
 UNION ALL SELECT t.run, 'temporal_early', t.event_id FROM tl t JOIN (SELECT run, min(event_id) AS u FROM tl WHERE kind = 'update' GROUP BY run) x USING (run) WHERE t.kind = 'query' AND t.qtype = 'temporal' AND t.event_id < x.u""", "tl"))
def evl_09(spark, sf):
    from kledger.operators.validate import timeline_violations

    t = fx.seq_rows(spark, sf).filter("condition = 'c2'").selectExpr(
        "run", "CASE WHEN run % 5 = 1 AND event_id > 9 THEN event_id + 1 ELSE event_id END AS event_id", "CASE WHEN run % 7 = 2 AND event_id = 20 THEN 'update' ELSE event_kind END AS kind",
        "CASE WHEN run % 6 = 3 AND event_id = 22 THEN 'q1' ELSE qid END AS qid", "qtype",
    ).distinct()
    return timeline_violations(t)


@query("EVL-10", "SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 2 ELSE 0 END::BIGINT AS n_clusters FROM documents WHERE doc_id % 31 = 0 OR doc_id % 43 = 1")
def evl_10(spark, sf):
    from kledger.operators.validate import cluster_cover

    d = fx.table(spark, sf, "documents").select("doc_id", F.col("source").alias("cluster"))
    members = d.filter("doc_id % 43 <> 1 OR doc_id % 31 = 0").unionByName(d.filter("doc_id % 31 = 0").withColumn("cluster", F.lit("second")))
    return cluster_cover(members, d.select("doc_id"))


@query("EVL-11", twin("SELECT qid, condition, coalesce(n_hits, 0) >= 1 AS passed FROM scored WHERE len(gold_points) > 0", "scored"))
def evl_11(spark, sf):
    hit = F.coalesce(F.exists("point_hits", lambda h: h), F.lit(False))
    return scored(spark, sf).filter(F.size("gold_points") > 0).select("qid", "condition", hit.alias("passed"))


# ---- model output ----------------------------------------------------------------------------------
_TXT = "CASE turn % 4 WHEN 0 THEN concat('{{\"k\": ', cast(turn as string), ', \"t\": \"a}}b\"}}') WHEN 1 THEN concat('```json\\n{{\"k\": ', cast(turn as string), '}}\\n```') WHEN 2 THEN concat(replace(text, '{{', ' '), ' {{bad}} then {{\"k\": ', cast(turn as string), '}} tail') ELSE replace(text, '{{', ' ') END".replace("{{", "{").replace("}}", "}")


@query("LLM-01", "SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN turn END AS k FROM conversations")
def llm_01(spark, sf):
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_TXT).alias("raw"))
    return c.select("conv_id", "turn", F.get_json_object(M.first_json(F.col("raw")), "$.k").cast("bigint").alias("k"))


@query("UDF-03", "SELECT doc_id, 'AB1' || nfc_normalize(text) AS folded FROM documents")
def udf_03(spark, sf):
    c = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("ＡＢ①"), "text").alias("t"))
    return c.select("doc_id", X.nfkc(F.col("t")).alias("folded"))


def extraction(spark, sf):
    n = fx.notes(spark, sf)
    good = "to_json(struct(body AS text, concat(entities[0], '，', entities[1], ',', entities[0]) AS entities, upper(confidence) AS confidence, 'odd' AS volatility, array(sources[0].url, 'http://outside/') AS source_urls))"
    small = "to_json(struct(concat('n', cast(d as string)) AS text, 'x' AS entities))"
    items = f"concat_ws(',', {good}, '{{\"text\": \" \"}}', '\"str\"', {small}" + f", CASE WHEN d % 20 = 0 THEN concat_ws(',', {', '.join([small] * 8)}) END)".replace("{{", "{")
    raw = f"concat('Here: {{\"notes\": [', {items}, '], \"conflicts\": [{{\"summary\": \" s', cast(d as string), ' \", \"action\": \"a\"}}, {{\"summary\": \"\"}}, 3]}}')".replace("{{", "{").replace("}}", "}")
    return n.select(F.col("note_id").alias("run"), "d", F.expr(raw).alias("raw"))


def extraction_pool(spark, sf):
    return fx.notes(spark, sf).filter("d % 3 <> 0").select(F.col("note_id").alias("run"), F.col("sources")[0]["url"].alias("url"))


@query("LLM-02", twin("""SELECT note_id AS run, pos::INTEGER AS pos, CASE WHEN pos = 0 THEN length(substr(trim(body), 1, 240)) ELSE length('n' || d::VARCHAR) END::INTEGER AS n_chars, CASE WHEN pos = 0 THEN entities[1] || '|' || entities[2] ELSE 'x' END AS entities,
  CASE WHEN pos = 0 THEN confidence ELSE 'medium' END AS confidence, 'stable' AS volatility, CASE WHEN pos = 0 AND d % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_urls FROM (SELECT *, unnest(CASE WHEN d % 20 = 0 THEN range(8) ELSE range(2) END) AS pos FROM notes)""", "notes"))
def llm_02(spark, sf):
    out = M.extracted_notes(extraction(spark, sf), extraction_pool(spark, sf))
    return out.select("run", "pos", F.length("text").alias("n_chars"), F.array_join("entities", "|").alias("entities"), "confidence", "volatility", "n_urls")


@query("LLM-02-counters", twin("SELECT note_id AS run, 2::INTEGER AS dropped, CASE WHEN length(trim(body)) > 240 THEN 1 ELSE 0 END::INTEGER AS cut, CASE WHEN d % 20 = 0 THEN 2 ELSE 0 END::INTEGER AS over_cap FROM notes0", "notes0"))
def llm_02_counters(spark, sf):
    return M.extraction_counters(extraction(spark, sf))


@query("LLM-03", twin("SELECT note_id AS run, 0::INTEGER AS pos, 's' || d::VARCHAR AS summary, 'a' AS action FROM notes0", "notes0"))
def llm_03(spark, sf):
    return M.extracted_conflicts(extraction(spark, sf))


_NAME = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 2 THEN 'fetch_url' WHEN 3 THEN 'ghost' ELSE 'web_search' END"
_ARGS = "CASE event_id % 7 WHEN 0 THEN '{\"query\": \"x\"}' WHEN 1 THEN '{\"query\": \"\"}' WHEN 2 THEN '{bad' WHEN 3 THEN '[1]' WHEN 4 THEN '{\"query\": 5}' ELSE '{\"query\": \"y\"}' END"
_ERR = "CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'HTTP 401 expired' WHEN 1 THEN 'Transport error: reset' ELSE 'bad frame' END END"


def tool_turns(spark, sf):
    e = fx.table(spark, sf, "events")
    one = e.selectExpr("event_id AS round_id", "1 AS turn", "CASE WHEN event_id % 4 = 0 THEN '' ELSE 'web_search' END AS expected", "event_id % 3 = 0 AS follow_up", f"{_NAME} AS name", f"{_ARGS} AS raw_arguments", f"{_ERR} AS error", "value * 7 AS latency_ms", "cast(floor(value * 100) as bigint) AS input_tokens", "cast(floor(value * 10) as bigint) AS output_tokens")
    two = one.filter("follow_up AND name IS NOT NULL AND round_id % 2 = 0").withColumn("turn", F.lit(2)).withColumn("raw_arguments", F.expr("CASE WHEN round_id % 12 = 0 THEN concat(raw_arguments, ' ') ELSE raw_arguments END")).withColumns({"latency_ms": F.lit(0.0), "input_tokens": F.lit(0).cast("bigint"), "output_tokens": F.lit(0).cast("bigint")})
    return one.unionByName(two)


ob.cte(
    "rounds",
    """SELECT event_id AS round_id, value, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'web_search' END AS expected, CASE WHEN event_type = 'error' THEN 'provider_error' WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 6 = 0 THEN 'ok' ELSE 'unwanted_call' END WHEN event_id % 6 = 0 THEN 'no_call' WHEN event_id % 6 = 3 THEN 'name_hallucinated' WHEN event_id % 6 = 2 THEN 'wrong_tool'
   WHEN event_id % 7 IN (1, 2, 3, 4) THEN 'bad_arguments' WHEN event_id % 3 = 0 AND event_id % 2 = 0 AND event_id % 12 <> 0 THEN 'repeated_call' ELSE 'ok' END AS verdict FROM events""",
)


@query("LLM-05", twin("SELECT round_id, expected, verdict, verdict IN ('ok', 'repeated_call') AS args_ok FROM rounds", "rounds"))
def llm_05(spark, sf):
    return M.classify_rounds(tool_turns(spark, sf))


@query("LLM-06", f"SELECT event_id, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'network' ELSE 'protocol' END END AS error_class FROM events")
def llm_06(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", M.error_class(F.expr(_ERR)).alias("error_class"))


@query("AG-19", twin(f"""SELECT count(*)::BIGINT AS rounds, round(count(*) FILTER (verdict IN ('ok', 'bad_arguments', 'repeated_call') AND expected <> '')::DOUBLE / count(*) FILTER (expected <> ''), 6) AS name_rate, round(count(*) FILTER (verdict IN ('ok', 'repeated_call') AND expected <> '')::DOUBLE / count(*) FILTER (expected <> ''), 6) AS args_rate,
  round(count(*) FILTER (verdict = 'ok')::DOUBLE / count(*), 6) AS ok_rate, {PCT.format('value * 7')}, round(sum(floor(value * 100)) / 1e6 * 2.0 + sum(floor(value * 10)) / 1e6 * 8.0, 6) AS cost FROM rounds""", "rounds"))
def ag_19(spark, sf):
    t = tool_turns(spark, sf)
    v = M.classify_rounds(t)
    use = t.groupBy("round_id").agg(F.sum("latency_ms").alias("latency_ms"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    j = v.join(use, "round_id").withColumn("all", F.lit(1))
    want = F.col("expected") != ""
    s = j.groupBy("all").agg(
        F.count("*").alias("rounds"), F.round(F.count_if(want & F.col("verdict").isin("ok", "bad_arguments", "repeated_call")) / F.count_if(want), 6).alias("name_rate"), F.round(F.count_if(want & F.col("args_ok")) / F.count_if(want), 6).alias("args_rate"),
        F.round(F.count_if(F.col("verdict") == "ok") / F.count("*"), 6).alias("ok_rate"), F.round(F.sum("i") / 1e6 * 2.0 + F.sum("o") / 1e6 * 8.0, 6).alias("cost"),
    )
    return s.join(A.exact_percentiles(j, ["all"], "latency_ms", A.P50_95), "all").drop("all")


@query("LLM-07", twin(f"SELECT request_hash, min(conv_id)::BIGINT AS seq, count(*)::BIGINT AS n FROM (SELECT h.request_hash, c.conv_id FROM ({REQUEST_HASH_SQL}) h JOIN (SELECT DISTINCT conv_id FROM messages) c USING (conv_id)) GROUP BY 1", "messages"))
def llm_07(spark, sf):
    last = fx.messages(spark, sf).groupBy("conv_id").agg(F.max_by("content", "turn").alias("response"))
    asked = requests(spark, sf).join(last, "conv_id").select("request_hash", F.col("conv_id").alias("seq"), "response")
    return M.replay_index(asked).select("request_hash", "seq", "n")


# ---- policy ----------------------------------------------------------------------------------------
ob.keyword("kw_probe", "bench_queries", R.pool_size(8))
ob.nearest("nn_probe", "bench_vec", R.pool_size(8))
ob.hybrid("hy_probe", "kw_probe", "nn_probe", 8)
ob.cte("short_texts", "SELECT d, title || ' ' || substr(body, 1, 400) AS t FROM notes0", "notes0")
ob.vectors("short_vec", "short_texts", "d", "t", "short_texts")
ob.cte(
    "feat",
    f"""WITH near AS (SELECT q.id AS qid, n.note_id, n.state, n.confidence FROM bench_vec q CROSS JOIN short_vec v JOIN fresh_states n ON n.d = v.id WHERE n.status = 'active' AND (n.state <> 'fresh' OR n.confidence = 'low') AND least(1.0, {cosine('q', 'v')}) >= 0.3),
  win AS (SELECT h.qid, h.note_id, h.score, n.state, n.confidence, n.volatility FROM hy_probe h JOIN fresh_states n USING (note_id)),
  extra AS (SELECT qid, count(*) FILTER (state = 'stale') AS s, count(*) FILTER (state = 'review_due') AS d, count(*) FILTER (confidence = 'low') AS l FROM near WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.qid = near.qid AND win.note_id = near.note_id) GROUP BY qid),
  w AS (SELECT qid, count(*) AS n, max(score) AS top, count(*) FILTER (state = 'fresh') AS f, count(*) FILTER (state = 'stale') AS s, count(*) FILTER (state = 'review_due') AS d, count(*) FILTER (confidence = 'low') AS l, count(*) FILTER (volatility = 'volatile') AS v, max(CASE volatility WHEN 'volatile' THEN 2 WHEN 'drifting' THEN 1 ELSE 0 END) AS mv FROM win GROUP BY qid),
  c AS (SELECT q.id AS qid, count(*) AS n FROM bench_vec q CROSS JOIN conflict_a_vec v JOIN conflicts k ON k.conflict_id = v.id WHERE k.status = 'open' AND least(1.0, {cosine('q', 'v')}) >= 0.3 GROUP BY 1)
 SELECT b.qid, coalesce(w.n, 0)::BIGINT AS hit_count, coalesce(w.top, 0.0)::DOUBLE AS top_score, coalesce(w.f, 0)::BIGINT AS fresh_hits, (coalesce(w.d, 0) + coalesce(e.d, 0))::BIGINT AS review_due_hits, (coalesce(w.s, 0) + coalesce(e.s, 0))::BIGINT AS stale_hits, coalesce(w.v, 0)::BIGINT AS volatile_hits,
   ['stable', 'drifting', 'volatile'][coalesce(w.mv, 0) + 1] AS max_volatility, (coalesce(w.l, 0) + coalesce(e.l, 0))::BIGINT AS low_confidence_hits, coalesce(c.n, 0)::BIGINT AS conflict_hits
 FROM bench_queries b LEFT JOIN w ON w.qid = b.qid LEFT JOIN extra e ON e.qid = b.qid LEFT JOIN c ON c.qid = b.qid""",
    "bench_vec", "short_vec", "fresh_states", "hy_probe", "conflict_a_vec", "conflicts", "bench_queries", materialized=True,
)


def policy_features(spark, sf):
    n = fx.notes(spark, sf, False)
    qs = fx.bench_queries(spark, sf)
    hits = R.hybrid_search(qs, n, chains(spark, sf), fx.NOW, 8).select("qid", "note_id", "score")
    states = with_freshness(n.filter("status = 'active'"), fx.NOW)
    open_c = fx.conflicts(spark, sf).filter("status = 'open'").select("conflict_id", F.col("text_a").alias("question"))
    return P.features(qs, hits, states, open_c)


@query("POL-01", ranked_twin("SELECT * FROM feat", "feat"))
def pol_01(spark, sf):
    return policy_features(spark, sf)


# the ladder runs over every event as a question, so that each rule is met
_FEAT = """SELECT event_id AS qid, event_id % 9 AS hit_count, event_id % 50 / 1000.0{d} AS top_score, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS conflict_hits, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS stale_hits,
  CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS low_confidence_hits, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS review_due_hits, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS volatile_hits, value / 100 AS budget_ratio, value AS elapsed, CASE WHEN event_id % 29 = 0 THEN 'simple' END AS forced FROM {t}"""
ob.cte(
    "modes",
    f"""SELECT qid, rule, coalesce(forced, CASE WHEN elapsed > 150 AND m2 = 'deep' THEN 'update' ELSE m2 END) AS mode FROM (SELECT *, CASE WHEN budget_ratio < {P.BUDGET_FLOOR} AND m1 = 'deep' THEN 'update' ELSE m1 END AS m2 FROM (SELECT *,
  CASE WHEN conflict_hits > 0 OR hit_count = 0 THEN 'deep' WHEN stale_hits > 0 OR low_confidence_hits > 0 OR review_due_hits > 0 OR volatile_hits > 0 THEN 'update' WHEN hit_count >= 2 AND top_score >= 0.010 THEN 'simple' ELSE 'update' END AS m1,
  CASE WHEN conflict_hits > 0 THEN 'open_conflict' WHEN hit_count = 0 THEN 'no_hits' WHEN stale_hits > 0 OR low_confidence_hits > 0 THEN 'stale_or_low' WHEN review_due_hits > 0 OR volatile_hits > 0 THEN 'due_or_volatile' WHEN hit_count >= 2 AND top_score >= 0.010 THEN 'covered' ELSE 'thin' END AS rule
  FROM ({_FEAT.format(d='::DOUBLE', t='events')})))""",
    materialized=True,
)


def modes(spark, sf):
    fx.table(spark, sf, "events").createOrReplaceTempView("kledger_events")
    return P.with_mode(spark.sql(_FEAT.format(d="D", t="kledger_events")), time_budget=150.0)


@query("POL-02", twin("SELECT qid, mode, rule FROM modes", "modes"))
def pol_02(spark, sf):
    return modes(spark, sf).select("qid", "mode", "rule")


@query("POL-03", twin("""SELECT qid, mode, CASE WHEN qid % 2 = 0 THEN greatest(1, least(20, qid % 31)) ELSE CASE mode WHEN 'simple' THEN 3 ELSE 5 END END::INTEGER AS prior_k, CASE mode WHEN 'simple' THEN 1200 ELSE 4000 END::INTEGER AS prior_max_chars, CASE mode WHEN 'simple' THEN 0 WHEN 'update' THEN 2 ELSE 4 END::INTEGER AS max_fresh_searches,
  CASE mode WHEN 'simple' THEN 3 WHEN 'update' THEN 6 ELSE 12 END::INTEGER AS max_steps, CASE mode WHEN 'update' THEN 1 ELSE 0 END::INTEGER AS min_fresh_sources, mode = 'deep' AS subagents,
  CASE WHEN qid % 3 = 0 THEN 'full' ELSE CASE mode WHEN 'simple' THEN 'brief' WHEN 'update' THEN 'standard' ELSE 'full' END END AS report_style FROM modes""", "modes"))
def pol_03(spark, sf):
    lim = P.limits(F.col("mode"), {"prior_k": F.when(F.col("qid") % 2 == 0, F.col("qid") % 31), "report_style": F.when(F.col("qid") % 3 == 0, "full").when(F.col("qid") % 3 == 1, "loud")})
    return modes(spark, sf).select("qid", "mode", *[c.alias(n) for n, c in lim.items()])


@query("POL-04", ranked_twin("SELECT qid, rank, note_id FROM hy_bench WHERE rank <= CASE WHEN qid LIKE '%1' THEN 3 ELSE 5 END", "hy_bench"))
def pol_04(spark, sf):
    hits = R.hybrid_search(fx.bench_queries(spark, sf), fx.notes(spark, sf, False), chains(spark, sf), fx.NOW, 5)
    k = P.limits(F.when(F.col("qid").endswith("1"), "simple").otherwise("deep"))["prior_k"]
    return hits.filter(F.col("rank") <= k).select("qid", "rank", "note_id")


@query("POL-05", twin("SELECT event_id, CASE WHEN mf <= 0 THEN 'not_required' WHEN fs >= mf THEN 'met' ELSE 'short' END AS outcome FROM (SELECT event_id, floor(value)::BIGINT % 4 AS fs, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS mf FROM events)"))
def pol_05(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr("event_id", "cast(floor(value) as bigint) % 4 AS fs", "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS mf")
    return e.select("event_id", P.outcome(F.col("fs"), F.col("mf")).alias("outcome"))
