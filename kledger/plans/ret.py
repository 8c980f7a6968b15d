"""Redirect chains (JN-01..03), retrieval (RET), chunking (WN-13), ranking (TK, WN-04, ST-05) and the quality gate (AG-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.functions import vectors as V
from kledger.operators import chunks as C
from kledger.operators import graph as G
from kledger.operators import priors as P
from kledger.operators import retrieval as R
from kledger.operators.metrics import channel_metrics
from kledger.plans import fixtures as fx
from kledger.plans import oracle_base as ob
from kledger.plans.fn import FINGERPRINT_SQL, slug_sql, with_fingerprint
from kledger.plans.oracle_base import nid, ranked_twin
from kledger.plans.oracle_base import ranked_twin as twin
from kledger.plans.registry import query

K = 5
POOL = R.pool_size(K)
ob.keyword("kw_phrase", "phrase_queries", POOL)
ob.keyword("kw_bench", "bench_queries", POOL)
ob.nearest("nn_bench", "bench_vec", POOL)
ob.nearest("nn_phrase", "phrase_vec", POOL)
ob.hybrid("hy_bench", "kw_bench", "nn_bench", K)
ob.hybrid("hy_phrase", "kw_phrase", "nn_phrase", K)
POOL3 = R.pool_size(3)
ob.keyword("kw_phrase3", "phrase_queries", POOL3)
ob.nearest("nn_phrase3", "phrase_vec", POOL3)
ob.hybrid("hy_phrase3", "kw_phrase3", "nn_phrase3", 3)
ob.hybrid("hy_all", "kw_bench", "nn_bench", 1 << 30)
ob.keyword("kw_short", "short_queries", POOL)


def chains(spark, sf, with_path=False):
    return G.redirects(fx.notes(spark, sf, False).select("note_id", "status", "redirect_to", "superseded_by"), with_path)


@query("JN-01", ranked_twin("SELECT note_id, canonical_id, outcome, first_alias, hops::INTEGER AS hops FROM chains", "chains"))
def jn_01(spark, sf):
    return chains(spark, sf)


@query("JN-02", ranked_twin("SELECT note_id, array_to_string(path, '>') AS path FROM chains WHERE path IS NOT NULL", "chains"))
def jn_02(spark, sf):
    return chains(spark, sf, True).filter("path IS NOT NULL").select("note_id", F.array_join("path", ">").alias("path"))


@query("JN-03", ranked_twin("SELECT canonical_id, note_id AS ancestor_id, hops::INTEGER AS distance FROM chains WHERE outcome = 'active' AND hops > 0", "chains"))
def jn_03(spark, sf):
    return chains(spark, sf).filter("outcome = 'active' AND hops > 0").select("canonical_id", F.col("note_id").alias("ancestor_id"), F.col("hops").alias("distance"))


def notes(spark, sf):
    return fx.notes(spark, sf, False)


@query("RET-01", twin(f"""SELECT note_id, {FINGERPRINT_SQL} AS fingerprint, greatest(length(title) - 2, 0)::INTEGER + greatest(length(body) - 2, 0)::INTEGER AS n_postings, coalesce(n2, 0)::BIGINT AS norm2
 FROM notes0 n LEFT JOIN note_vec v ON v.id = n.d""", "notes0", "note_vec"))
def ret_01(spark, sf):
    view = with_fingerprint(notes(spark, sf))
    grams = F.size(X.ngrams(F.col("title"), 3)) + F.size(X.ngrams(F.col("body"), 3))
    vec = R.note_vectors(view).select("note_id", V.norm2(F.col("v")).alias("norm2"))
    return view.select("note_id", "fingerprint", grams.alias("n_postings")).join(vec, "note_id", "left").withColumn("norm2", F.coalesce("norm2", F.lit(0)).cast("bigint"))


@query("RET-02", twin("SELECT qid, note_id, rank, score FROM kw_phrase", "kw_phrase"))
def ret_02(spark, sf):
    return R.keyword_channel(notes(spark, sf), fx.phrase_queries(spark, sf), POOL).select("qid", "note_id", "rank", "score")


@query("RET-03", twin("SELECT qid, note_id, rank FROM kw_short", "kw_short"))
def ret_03(spark, sf):
    return R.short_channel(notes(spark, sf), fx.short_queries(spark, sf), POOL).select("qid", "note_id", "rank")


def bench_nearest(spark, sf, pool=POOL):
    return R.vector_channel(R.note_vectors(notes(spark, sf)), R.vectorize(fx.bench_queries(spark, sf), "qid", F.trim("q")), pool)


@query("RET-04", twin("SELECT qid, note_id, rank, round(score, 6) AS score FROM nn_bench", "nn_bench"))
def ret_04(spark, sf):
    return bench_nearest(spark, sf).select("qid", "note_id", "rank", F.round("score", 6).alias("score"))


@query("RET-05", twin("SELECT qid, note_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM (SELECT qid, note_id, rank FROM kw_bench UNION ALL SELECT qid, note_id, rank FROM nn_bench) GROUP BY ALL", "kw_bench", "nn_bench"))
def ret_05(spark, sf):
    kw = R.keyword_channel(notes(spark, sf), fx.bench_queries(spark, sf), POOL)
    prep = lambda c: c.select("qid", F.col("note_id").alias("canonical_id"), "rank", F.lit(True).alias("direct"), F.lit(None).cast("string").alias("alias"))
    return R.rrf({"fts": prep(kw), "vector": prep(bench_nearest(spark, sf))}).select("qid", F.col("canonical_id").alias("note_id"), F.round("fused", 9).alias("fused"))


def bench_search(spark, sf, **kw):
    return R.hybrid_search(fx.bench_queries(spark, sf), notes(spark, sf), chains(spark, sf), fx.NOW, K, **kw)


def phrase_search(spark, sf, k=K):
    return R.hybrid_search(fx.phrase_queries(spark, sf), notes(spark, sf), chains(spark, sf), fx.NOW, k)


@query("RET-06", ranked_twin("SELECT qid, rank, note_id, title, score, match_type, redirected_from FROM hy_bench", "hy_bench"))
def ret_06(spark, sf):
    return bench_search(spark, sf)


@query("RET-06-phrase", ranked_twin("SELECT qid, rank, note_id, title, score, match_type, redirected_from FROM hy_phrase", "hy_phrase"))
def ret_06_phrase(spark, sf):
    return phrase_search(spark, sf)


@query("WN-13", ranked_twin("SELECT chunk_id, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM chunks", "chunks"))
def wn_13(spark, sf):
    return C.chunks(fx.corpus_docs(spark, sf)).select("chunk_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


CHUNK_SEARCH = r"""WITH qg AS (SELECT qid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) AS g FROM (SELECT qid, string_split(regexp_replace(q, '\s+', '', 'g'), '') AS w FROM bench_queries)),
 cg AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) AS g FROM (SELECT chunk_id, string_split(regexp_replace(text, '\s+', '', 'g'), '') AS w FROM chunks)),
 it AS (SELECT qid, chunk_id, count(*) AS n FROM (SELECT qid, unnest(g) AS gram FROM qg) JOIN (SELECT chunk_id, unnest(g) AS gram FROM cg) USING (gram) GROUP BY ALL),
 sc AS (SELECT q.id AS qid, c.id AS chunk_id, round(0.5::DOUBLE * CASE WHEN q.n2 = 0 OR c.n2 = 0 THEN 0.0 ELSE list_dot_product(q.v, c.v) / sqrt(q.n2 * c.n2) END
   + 0.5::DOUBLE * coalesce(it.n, 0) / (len(qg.g) + len(cg.g) - coalesce(it.n, 0)), 9) AS score
   FROM bench_vec q CROSS JOIN chunk_vec c JOIN qg ON qg.qid = q.id JOIN cg ON cg.chunk_id = c.id LEFT JOIN it ON it.qid = q.id AND it.chunk_id = c.id)
 SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 5"""


@query("RET-07", ranked_twin(CHUNK_SEARCH, "chunks", "chunk_vec", "bench_vec", "bench_queries"))
def ret_07(spark, sf):
    return C.chunk_search(C.chunks(fx.corpus_docs(spark, sf)), fx.bench_queries(spark, sf), K).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("RET-08", twin("SELECT NOT c AS fresh, count(*)::BIGINT AS n_vectors, count(*)::BIGINT AS n_texts FROM (SELECT sha256(body) AS h, bool_or(d % 2 = 0) AS c FROM notes0 WHERE length(body) > 0 GROUP BY 1) GROUP BY 1", "notes0"))
def ret_08(spark, sf):
    from kledger.sources.cache import embed_with_cache

    texts = notes(spark, sf).select("d", "note_id", "body")
    cached = embed_with_cache(texts.filter("d % 2 = 0"), "body", "hash-128", None).drop("fresh")
    cached = cached.select("model", "text_sha256", "v")
    out = embed_with_cache(texts, "body", "hash-128", cached)
    return out.groupBy("fresh").agg(F.count("*").alias("n_vectors"), F.countDistinct("text_sha256").alias("n_texts"))


def phrase_priors(spark, sf):
    n = fx.notes(spark, sf)
    ch = chains(spark, sf, True)
    return P.prior_hits(R.hybrid_search(fx.phrase_queries(spark, sf), n, ch, fx.NOW, K), n, ch)


ob.cte(
    "prior_hits",
    r"""SELECT h.qid, h.rank, h.note_id, h.title, h.score, CASE WHEN length(b) > 600 THEN substr(b, 1, 600) || '…' ELSE b END AS body, confidence, volatility, coalesce(observed_at, created) AS observed_at, src_url,
   coalesce(c.path[1:len(c.path) - 1], []) AS aliases
 FROM hy_phrase h JOIN (SELECT *, regexp_replace(body, '^\s+|\s+$', '', 'g') AS b FROM notes) n USING (note_id) LEFT JOIN chains c ON c.note_id = h.redirected_from""",
    "hy_phrase", "notes", "chains", materialized=True,
)


def block_sql(pos: str, body: str) -> str:
    return f"""('### [P-' || ({pos})::VARCHAR || '] ' || h.note_id || ' ' || h.title || chr(10) || '- confidence: ' || h.confidence || chr(10) || '- volatility: ' || h.volatility || chr(10) || '- observed_at: ' || coalesce(h.observed_at, '-')
   || chr(10) || '- sources: ' || h.src_url || CASE WHEN len(h.aliases) > 0 THEN chr(10) || '- redirected_from: ' || array_to_string(h.aliases, ', ') ELSE '' END || chr(10) || {body} || chr(10) || chr(10))"""


ob.cte(
    "fit_try",
    f"""SELECT h.*, length({block_sql('h.rank', "''")}) AS bare FROM prior_hits h""",
    "prior_hits", materialized=True,
)
_left = "(f.room - h.bare)"
_cap = f"""(CASE WHEN h.bare + length(h.body) <= f.room THEN -1
   WHEN {_left} - 8 >= 80 AND {_left} - 8 < length(h.body) AND h.bare + {_left} - 8 + 1 <= f.room THEN {_left} - 8
   WHEN {_left} // 2 >= 80 AND {_left} // 2 < length(h.body) AND h.bare + {_left} // 2 + 1 <= f.room THEN {_left} // 2 END)"""
ob.cte(
    "fit",
    f"""SELECT qid, 0::BIGINT AS rank, {P.BUDGET - len(P.HEADER)}::BIGINT AS room, ''::VARCHAR AS ids, ''::VARCHAR AS txt, 0::BIGINT AS n FROM (SELECT DISTINCT qid FROM prior_hits)
 UNION ALL SELECT h.qid, h.rank, (f.room - h.bare - CASE WHEN {_cap} = -1 THEN length(h.body) ELSE {_cap} + 1 END)::BIGINT, f.ids || CASE WHEN f.n > 0 THEN ',' ELSE '' END || h.note_id,
   f.txt || {block_sql('h.rank', f"CASE WHEN {_cap} = -1 THEN h.body ELSE substr(h.body, 1, {_cap}::BIGINT) || '…' END")}, f.n + 1
 FROM fit f JOIN fit_try h ON h.qid = f.qid AND h.rank = f.rank + 1 WHERE {_cap} IS NOT NULL""",
    "fit_try", "prior_hits",
)
FIT = f"SELECT qid, n::INTEGER AS n_hits, ids AS note_ids, CASE WHEN n > 0 THEN '{P.HEADER}' || txt ELSE '' END AS context FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank DESC) AS rn FROM fit) WHERE rn = 1"


@query("RET-09", ranked_twin("SELECT qid, rank, note_id, length(body)::INTEGER AS body_chars, observed_at, src_url AS urls, array_to_string(aliases, ',') AS aliases, score FROM prior_hits", "prior_hits"))
def ret_09(spark, sf):
    return phrase_priors(spark, sf).select(
        "qid", "rank", "note_id", F.length("body").alias("body_chars"), "observed_at", F.array_join("urls", ",").alias("urls"), F.array_join("aliases", ",").alias("aliases"), "score"
    )


@query("TK-04", ranked_twin(f"SELECT qid, n_hits, note_ids, length(context)::INTEGER AS context_chars FROM ({FIT})", "fit"))
def tk_04(spark, sf):
    return P.prior_context(phrase_priors(spark, sf)).select("qid", "n_hits", "note_ids", F.length("context").alias("context_chars"))


@query("RET-10", ranked_twin(f"SELECT qid, md5(context) AS context_md5, substr(context, 1, 200) AS head FROM ({FIT})", "fit"))
def ret_10(spark, sf):
    return P.prior_context(phrase_priors(spark, sf)).select("qid", F.md5("context").alias("context_md5"), F.substring("context", 1, 200).alias("head"))


@query("RET-11", twin("""SELECT qid, rank, note_id, question, asked_date, reason, round(score, 6) AS score FROM (
 SELECT q.id AS qid, u.note_id, u.question, u.asked_date, u.reason, """ + ob.cosine("q", "v") + """ AS score, row_number() OVER (PARTITION BY q.id ORDER BY """ + ob.cosine("q", "v") + """ DESC, u.note_id) AS rank
 FROM guard_vec q CROSS JOIN unanswered_vec v JOIN unanswered u ON u.d = v.id WHERE """ + ob.cosine("q", "v") + """ >= 0.4) WHERE rank <= 2""", "guard_vec", "unanswered_vec", "unanswered"))
def ret_11(spark, sf):
    return P.unanswered_guards(fx.guard_queries(spark, sf), fx.unanswered(spark, sf)).withColumn("score", F.round("score", 6))


_hit = lambda t: f"SELECT q.id AS qid, v.id AS conflict_id FROM guard_vec q CROSS JOIN {t} v JOIN open_c o ON o.conflict_id = v.id WHERE {ob.cosine('q', 'v')} >= 0.3"


@query("RET-12", twin(f"""WITH open_c AS (SELECT * FROM conflicts WHERE status = 'open'),
 hit AS (SELECT q.qid, c.conflict_id FROM guard_queries q JOIN open_c c ON contains({slug_sql('q.q')}, {slug_sql('c.entity')}) UNION {_hit('conflict_a_vec')} UNION {_hit('conflict_b_vec')})
 SELECT qid, rank, conflict_id, entity, value_a, value_b FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY conflict_id) AS rank FROM hit) JOIN open_c USING (conflict_id) WHERE rank <= 3""",
    "guard_queries", "guard_vec", "conflicts", "conflict_a_vec", "conflict_b_vec"))
def ret_12(spark, sf):
    return P.conflict_guards(fx.guard_queries(spark, sf), fx.conflicts(spark, sf).filter("status = 'open'")).select("qid", "rank", "conflict_id", "entity", "value_a", "value_b")


# ---- quality gate ----------------------------------------------------------------------------------
ob.keyword("kw_truth", "bench_queries", 1 << 30)
ob.cte(
    "truth",
    f"""SELECT 'D-' || doc_id::VARCHAR AS qid, {nid('doc_id')} AS note_id FROM documents
 UNION ALL SELECT qid, note_id FROM kw_truth_hits""",
    "kw_truth_hits",
)
ob.cte("forbid", f"SELECT 'D-' || doc_id::VARCHAR AS qid, {nid('doc_id + 1')} AS note_id FROM documents")
GATE = """WITH r AS (SELECT 'fts' AS channel, qid, note_id, rank FROM kw_phrase UNION ALL SELECT 'vector', qid, note_id, rank FROM nn_phrase UNION ALL SELECT 'hybrid', qid, note_id, rank FROM hy_phrase),
 nt AS (SELECT qid, count(*) AS n FROM truth GROUP BY qid),
 h AS (SELECT r.channel, r.qid, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, min(CASE WHEN rank <= 5 THEN rank END) AS first FROM r JOIN truth t USING (qid, note_id) GROUP BY ALL),
 f AS (SELECT DISTINCT r.channel, r.qid FROM r JOIN forbid USING (qid, note_id) WHERE rank <= 5),
 c AS (SELECT unnest(['fts', 'vector', 'hybrid']) AS channel)
 SELECT c.channel, (SELECT count(*) FROM nt)::BIGINT AS scored_queries, round(a.r3 / (SELECT count(*) FROM nt), 6) AS recall3, round(a.r5 / (SELECT count(*) FROM nt), 6) AS recall5, round(a.rr / (SELECT count(*) FROM nt), 6) AS mrr,
   (SELECT count(*) FROM f WHERE f.channel = c.channel)::BIGINT AS forbidden_hits, (SELECT count(DISTINCT qid) FROM forbid)::BIGINT AS forbidden_checks
 FROM c JOIN (SELECT h.channel, sum(h3::DOUBLE / n) AS r3, sum(h5::DOUBLE / n) AS r5, sum(coalesce(1.0::DOUBLE / first, 0)) AS rr FROM h JOIN nt USING (qid) GROUP BY 1) a USING (channel)"""


def truth(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("concat('D-', cast(doc_id as string)) AS qid", f"{fx.nid('doc_id')} AS note_id")
    return d.unionByName(R.phrase_hits(notes(spark, sf), fx.bench_queries(spark, sf)).select("qid", "note_id"))


def forbid(spark, sf):
    return fx.table(spark, sf, "documents").selectExpr("concat('D-', cast(doc_id as string)) AS qid", f"{fx.nid('doc_id + 1')} AS note_id")


def gate_rankings(spark, sf):
    n, qs = notes(spark, sf), fx.phrase_queries(spark, sf)
    vecs = R.note_vectors(n)
    fts = R.keyword_channel(n, qs, POOL).select(F.lit("fts").alias("channel"), "qid", "note_id", "rank")
    vec = R.vector_channel(vecs, R.vectorize(qs, "qid", F.trim("q")), POOL).select(F.lit("vector").alias("channel"), "qid", "note_id", "rank")
    hyb = R.hybrid_search(qs, n, chains(spark, sf), fx.NOW, K).select(F.lit("hybrid").alias("channel"), "qid", "note_id", "rank")
    return fts.unionByName(vec).unionByName(hyb)


@query("RET-13", ranked_twin(GATE, "kw_phrase", "nn_phrase", "hy_phrase", "truth", "forbid"))
def ret_13(spark, sf):
    return channel_metrics(gate_rankings(spark, sf), truth(spark, sf), forbid(spark, sf))


@query("AG-09", twin("""WITH r AS (SELECT qid, note_id, rank FROM kw_phrase), nt AS (SELECT qid, count(*) AS n FROM truth GROUP BY qid)
 SELECT q.qid, coalesce(n, 0)::BIGINT AS n_truth, round(CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(h5, 0)::DOUBLE / n END, 6) AS recall5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr
 FROM phrase_queries q LEFT JOIN nt USING (qid) LEFT JOIN (SELECT qid, count(*) FILTER (rank <= 5) AS h5, min(CASE WHEN rank <= 5 THEN rank END) AS first FROM r JOIN truth USING (qid, note_id) GROUP BY qid) USING (qid)""", "kw_phrase", "truth", "phrase_queries"))
def ag_09(spark, sf):
    from kledger.operators.metrics import query_metrics

    qs = fx.phrase_queries(spark, sf)
    ranked = R.keyword_channel(notes(spark, sf), qs, POOL).select("qid", "note_id", "rank")
    return query_metrics(qs.select("qid"), ranked, truth(spark, sf))


# ---- ranking pieces --------------------------------------------------------------------------------
@query("WN-04", ranked_twin("SELECT qid, canonical_id, rank, direct, alias FROM hy_bench_nn_bench", "hy_bench_nn_bench"))
def wn_04(spark, sf):
    return R.resolve_ranks(bench_nearest(spark, sf).select("qid", "note_id", "rank"), chains(spark, sf))


@query("TK-01", ranked_twin("SELECT qid, rank, note_id FROM hy_phrase WHERE rank <= 3", "hy_phrase"))
def tk_01(spark, sf):
    return phrase_search(spark, sf, K).filter("rank <= 3").select("qid", "rank", "note_id")


@query("TK-02", twin("SELECT qid, note_id, rank FROM nn_bench", "nn_bench"))
def tk_02(spark, sf):
    return bench_nearest(spark, sf).select("qid", "note_id", "rank")


@query("ST-05", twin("SELECT qid, note_id, count(*)::BIGINT AS n_channels FROM (SELECT qid, note_id FROM kw_phrase UNION ALL SELECT qid, note_id FROM nn_phrase) GROUP BY ALL", "kw_phrase", "nn_phrase"))
def st_05(spark, sf):
    n, qs = notes(spark, sf), fx.phrase_queries(spark, sf)
    a = R.keyword_channel(n, qs, POOL).select("qid", "note_id")
    b = R.vector_channel(R.note_vectors(n), R.vectorize(qs, "qid", F.trim("q")), POOL).select("qid", "note_id")
    return a.unionByName(b).groupBy("qid", "note_id").agg(F.count("*").alias("n_channels"))


@query("FLT-02", ranked_twin("SELECT c.note_id, canonical_id FROM chains c JOIN notes0 n ON n.note_id = c.canonical_id WHERE outcome = 'active' AND NOT n.tombstone", "chains", "notes0"))
def flt_02(spark, sf):
    live = notes(spark, sf).filter("NOT tombstone").select(F.col("note_id").alias("canonical_id"))
    return chains(spark, sf).filter("outcome = 'active'").join(live, "canonical_id", "left_semi").select("note_id", "canonical_id")


@query("FLT-03", ranked_twin("""SELECT qid, note_id, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS rank FROM hy_all WHERE kind = 'user' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 5""", "hy_all"))
def flt_03(spark, sf):
    return bench_search(spark, sf, kind="user").select("qid", "note_id", "rank")


ob.vectors("body64_vec", "notes0", "note_id", "body", "notes0", dim=64)


@query("UDF-01", twin("SELECT id AS note_id, len(v)::INTEGER AS dim, n2::BIGINT AS norm2, array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ',') AS vector FROM body64_vec", "body64_vec"))
def udf_01(spark, sf):
    v = R.vectorize(notes(spark, sf), "note_id", F.col("body"), V.encoder(dim=64))
    return v.select("note_id", F.size("v").alias("dim"), V.norm2(F.col("v")).alias("norm2"), F.array_join(F.col("v").cast("array<string>"), ",").alias("vector"))


@query("UDF-04", ranked_twin("SELECT qid, rank, note_id, title, score, match_type, redirected_from FROM hy_phrase3", "hy_phrase3"))
def udf_04(spark, sf):
    return notes(spark, sf).transform(lambda n: R.hybrid_search(fx.phrase_queries(spark, sf), n, chains(spark, sf), fx.NOW, 3))
