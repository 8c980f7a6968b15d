"""DuckDB twins of the fixtures, as named common table expressions that ``twin`` strings together."""

from __future__ import annotations

from kledger.plans.fixtures import N_EVENTS, REPEATS  # noqa: F401

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str, materialized: bool = False) -> None:
    CTES[name] = (needs, ("MATERIALIZED " if materialized else "") + "(" + sql + ")")


def twin(main: str, *needs: str) -> str:
    """``WITH`` every needed expression and what it needs in turn, then ``main``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in CTES[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS {CTES[n][1]}" for n in order)
    main = main.strip()
    if not head:
        return main
    if main.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{main[len('WITH RECURSIVE '):]}"
    if main.upper().startswith("WITH "):
        return f"WITH {head},\n{main[5:]}"
    return f"WITH {head}\n{main}"


def nid(e: str) -> str:
    return f"('N-' || lpad(({e})::VARCHAR, greatest(6, length(({e})::VARCHAR))::INTEGER, '0'))"


def iso(days: str) -> str:
    return f"(strftime(DATE '2024-01-01' + ({days})::INTEGER, '%Y-%m-%d') || 'T00:00:00')"


ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def ts(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '{ISO_SHAPE}') THEN try_cast({c} AS TIMESTAMP) END)"


NOW = "TIMESTAMP '2025-01-01 00:00:00'"


def days(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 86400e6)"


DROPPED = (
    r"(?is)<!--.*?-->|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>"
    r"|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>|<noscript\b.*?</noscript>"
)
_t = f"regexp_replace(html, '{DROPPED}', '', 'g')"
_t = rf"regexp_replace({_t}, '(?i)</(?:p|div|li|h[1-6]|article|section|tr|ul|ol)>|<br\s*/?>', chr(10), 'g')"
_t = f"regexp_replace({_t}, '<[^>]*>', '', 'g')"
for _r, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _t = f"replace({_t}, '{_r}', '{_c}')"
_t = rf"regexp_replace({_t}, '[ \t\r\f]+', ' ', 'g')"
_t = rf"regexp_replace({_t}, ' ?\n ?', chr(10), 'g')"
_t = rf"regexp_replace({_t}, '\n{{2,}}', chr(10), 'g')"
MAIN_TEXT = rf"regexp_replace({_t}, '^[ \n]+|[ \n]+$', '', 'g')"

cte("page_text", f"SELECT page_id, url, {MAIN_TEXT} AS text FROM pages", materialized=True)
cte("page_versions", "SELECT page_id, url, text, sha256(text) AS content_hash FROM page_text", "page_text", materialized=True)

STATUS = """CASE WHEN d % 97 IN (10, 11) THEN 'merged' WHEN d % 101 = 50 THEN 'merged'
  WHEN d % 13 = 5 THEN 'merged' WHEN d % 17 = 3 THEN 'superseded' ELSE 'active' END"""
NEXT = f"""CASE WHEN d % 97 = 10 THEN {nid('d + 1')} WHEN d % 97 = 11 THEN {nid('d - 1')}
  WHEN d % 101 = 50 THEN 'N-missing' ELSE {nid('d + 1')} END"""

cte(
    "notes0",
    f"""SELECT d, {nid('d')} AS note_id, substr(split_part(text, chr(10), 1), 1, 60) AS title, text AS body,
  source, [source, 'topic-' || (d % 37)::VARCHAR] AS entities,
  CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS confidence,
  {STATUS} AS status,
  CASE WHEN {STATUS} = 'merged' THEN {NEXT} END AS redirect_to,
  CASE WHEN {STATUS} = 'superseded' THEN {NEXT} END AS superseded_by,
  ['stable', 'drifting', 'volatile'][d % 3 + 1] AS volatility,
  CASE d % 11 WHEN 0 THEN 'user' WHEN 1 THEN 'experience' ELSE 'knowledge' END AS kind,
  CASE WHEN d % 7 <> 0 THEN (d % 10) / 10.0::DOUBLE END AS importance,
  ({STATUS} = 'active' AND d % 29 = 0) AS tombstone,
  {iso('d % 365')} AS created,
  CASE WHEN d % 4 = 0 THEN NULL WHEN d % 23 = 0 THEN 'n/a' ELSE {iso('d % 365 + 1')} END AS observed_at,
  CASE WHEN d % 19 = 0 THEN '2024-06-30' END AS valid_until,
  CASE WHEN d % 31 = 0 THEN '2025-06-30' END AS valid_from,
  CASE WHEN d % 9 = 0 THEN {iso('d % 365 + 20')} END AS source_changed_at,
  CASE WHEN d % 10 = 0 THEN {iso('d % 365 + 30')} WHEN d % 5 = 0 THEN {iso('d % 365 + 10')} END AS reviewed_at
 FROM (SELECT doc_id AS d, text, source FROM documents) LEFT JOIN (SELECT doc_id AS d, quality FROM labels) USING (d)""",
    materialized=True,
)
cte(
    "notes",
    """SELECT n.*, p.url AS src_url,
  CASE WHEN d % 6 = 0 THEN '' WHEN d % 8 = 0 THEN 'old' ELSE p.content_hash END AS src_hash
 FROM notes0 n LEFT JOIN page_versions p ON p.page_id = n.d % (SELECT greatest(1, count(*)) FROM pages)""",
    "notes0", "page_versions", materialized=True,
)
cte(
    "lint_notes",
    f"""SELECT * REPLACE (body || CASE WHEN d % 2 = 0 AND d > 0 THEN ' ' || {nid('d - 1')} ELSE '' END
  || CASE WHEN d % 3 = 0 THEN ' [[entity:src3|x]]' ELSE '' END || CASE WHEN d % 15 = 0 THEN ' [[entity:nowhere|y]]' ELSE '' END AS body) FROM notes0""",
    "notes0", materialized=True,
)
cte(
    "snapshot_log",
    """SELECT url, text, content_hash, TIMESTAMP '2024-03-01 00:00:00' AS fetched_at FROM page_versions
 UNION ALL SELECT url, text || ' v2', sha256(text || ' v2'), TIMESTAMP '2024-03-31 00:00:00' FROM page_versions WHERE page_id % 2 = 1""",
    "page_versions", materialized=True,
)
cte(
    "latest_snapshot",
    "SELECT url, content_hash, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, content_hash DESC) AS rn FROM snapshot_log) WHERE rn = 1",
    "snapshot_log", materialized=True,
)
cte(
    "wiki_pages",
    f"""SELECT 'P-' || doc_id::VARCHAR AS page_id, '# ' || source || chr(10) || '```' || chr(10) || 'code line' || chr(10) || '```' || chr(10)
   || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 1 AND doc_id % 5 <> 0 THEN x || ' ' || {nid('doc_id')} WHEN i % 3 = 2 AND doc_id % 7 = 0 THEN x || ' ' || {nid('doc_id + 1')} ELSE x END), chr(10)) AS body FROM documents""",
    materialized=True,
)
cte(
    "phrase_queries",
    """SELECT 'D-' || doc_id::VARCHAR AS qid, trim(substr(text, 11, 24)) AS q FROM documents
 UNION ALL SELECT 'B-' || item_id::VARCHAR, trim(text) FROM benchmark""",
    materialized=True,
)
cte("bench_queries", "SELECT 'B-' || item_id::VARCHAR AS qid, text AS q FROM benchmark")
cte("short_queries", "SELECT 'S-' || doc_id::VARCHAR AS qid, trim(substr(text, 1, 2)) AS q FROM documents")
cte(
    "token_ledger",
    """SELECT event_id, ts, user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_type AS step, 'm' || (user_id % 3)::VARCHAR AS model,
  floor(value * 100)::BIGINT AS input_tokens, floor(value * 10)::BIGINT AS output_tokens, floor(value)::BIGINT AS cache_read_tokens,
  value * 7 AS latency_ms, CASE WHEN event_type = 'error' THEN 'error' END AS error_type FROM events""",
)
cte(
    "job_log",
    """SELECT event_id AS seq, user_id AS ledger, 'J-' || lpad(props ->> '$.k', greatest(4, length(props ->> '$.k'))::INTEGER, '0') AS job_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status,
  floor(value)::BIGINT % 4 AS attempt FROM events""",
)
cte(
    "messages",
    """SELECT conv_id, turn, CASE WHEN role = 'user' AND turn >= 4 AND turn % 4 = 2 THEN 'tool' ELSE role END AS role, text AS content,
  CASE WHEN role = 'user' AND turn >= 4 AND turn % 4 = 2 THEN 'web_search' ELSE '' END AS name FROM conversations""",
)
cte(
    "eval_rows",
    """SELECT k, item_id, 'q' || item_id::VARCHAR AS qid, 'c' || (c + 1)::VARCHAR AS condition,
  ['single_hop', 'multi_hop', 'temporal', 'unanswerable'][item_id % 4 + 1] AS qtype,
  CASE WHEN k % 9 = 0 THEN '资料未提及。' WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN doc_text || ' [1] [3] ' || item_text ELSE doc_text || ' [2] ' END AS answer,
  CASE WHEN item_id % 4 = 3 THEN []::VARCHAR[] ELSE [substr(item_text, 1, 12), substr(item_text, 21, 12), substr(item_text, 41, 12)] END AS gold_points,
  floor(value * 100)::BIGINT AS input_tokens, floor(value * 10)::BIGINT AS output_tokens, value * 7 AS latency_ms,
  CASE WHEN c IN (0, 3) THEN floor(value)::BIGINT % 6 END AS fresh_search_count,
  't' || k::VARCHAR AS trace_id, k % 4 AS n_sources
 FROM (SELECT item_id, b.text AS item_text, (doc_id // n) % 4 AS c, doc_id AS k, d.text AS doc_text FROM documents d, (SELECT count(*) AS n FROM benchmark) JOIN benchmark b ON b.item_id = d.doc_id % n) g
 LEFT JOIN events e ON e.event_id = g.k""",
    materialized=True,
)
_qid = "event_id"
for _later, _first in REPEATS.items():
    _qid = f"CASE WHEN event_id = {_later} THEN {_first} ELSE {_qid} END"
cte(
    "seq_rows",
    f"""SELECT run, event_id, 'c' || (c + 1)::VARCHAR AS condition,
  CASE WHEN event_id = 0 THEN 'ingest' WHEN event_id = 17 THEN 'update' ELSE 'query' END AS event_kind,
  CASE WHEN event_id NOT IN (0, 17) THEN 'q' || ({_qid})::VARCHAR END AS qid,
  CASE WHEN event_id NOT IN (0, 17) THEN ['single_hop', 'temporal', 'multi_hop', 'unanswerable'][({_qid}) % 4 + 1] END AS qtype,
  floor(value * 100)::BIGINT AS in_tok, floor(value * 10)::BIGINT AS out_tok, floor(value * 3)::BIGINT AS judge_in_tok, value * 7 AS latency_ms,
  CASE WHEN event_type <> 'error' THEN (floor(value * 100)::BIGINT % 4) / 3.0::DOUBLE END AS em, (event_type = 'signup') AS refusal,
  CASE WHEN event_type <> 'view' THEN (floor(value * 100)::BIGINT % 5) / 4.0::DOUBLE END AS citation_coverage,
  CASE WHEN c = 3 THEN ['simple', 'update', 'deep'][floor(value)::BIGINT % 3 + 1] END AS policy_mode,
  CASE WHEN c IN (1, 2) THEN floor(value)::BIGINT % 4 END AS embedding_calls,
  CASE WHEN event_id > 17 AND event_id % 3 = 0 THEN 'override' ELSE 'base' END AS gold_source
 FROM (SELECT event_id // 96 AS run, ((event_id % 96) // 4)::INTEGER AS event_id, event_id % 4 AS c, value, event_type FROM events)
 WHERE NOT (event_id = 0 AND c = 0)""",
    materialized=True,
)


def vectors(name: str, source: str, key: str, text: str, *needs: str, dim: int = 128) -> None:
    """``name``: (id, v INTEGER[dim], n2), the signed hash vector of ``text``, and its exact squared norm."""
    cte(
        f"{name}_g",
        f"""SELECT id, gram, count(*) AS c FROM (
   SELECT id, unnest(list_concat(cs, list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1]))) AS gram
   FROM (SELECT {key} AS id, string_split({text}, '') AS cs FROM {source} WHERE length({text}) > 0)) GROUP BY ALL""",
        *needs, materialized=True,
    )
    cte(
        f"{name}_w",
        f"""SELECT id, h.b, sum(CASE WHEN h.s = 0 THEN c ELSE -c END)::BIGINT AS w FROM {name}_g g
  JOIN (SELECT gram, (v % {dim})::INTEGER AS b, (v // {dim}) % 2 AS s FROM (SELECT gram, ('0x' || substr(md5(gram), 1, 15))::BIGINT AS v FROM (SELECT DISTINCT gram FROM {name}_g))) h USING (gram)
  GROUP BY id, h.b""",
        f"{name}_g", materialized=True,
    )
    cte(
        name,
        f"""SELECT id, list(coalesce(w, 0)::DOUBLE ORDER BY b) AS v, sum(coalesce(w, 0) * coalesce(w, 0))::DOUBLE AS n2
  FROM (SELECT DISTINCT id FROM {name}_w) CROSS JOIN (SELECT unnest(range({dim}))::INTEGER AS b) LEFT JOIN {name}_w USING (id, b) GROUP BY id""",
        f"{name}_w", materialized=True,
    )


def cosine(a: str = "a", b: str = "b") -> str:
    return f"(CASE WHEN {a}.n2 = 0 OR {b}.n2 = 0 THEN 0.0 ELSE list_dot_product({a}.v, {b}.v) / sqrt({a}.n2 * {b}.n2) END)"


vectors("body_vec", "notes0", "d", "body", "notes0")
vectors("note_vec", "notes0", "d", "(title || chr(10) || body)", "notes0")
vectors("bench_vec", "bench_queries", "qid", "q", "bench_queries")
vectors("phrase_vec", "phrase_queries", "qid", "q", "phrase_queries")

# ---- redirect chains, retrieval channels, chunks ----------------------------------------------------
cte(
    "walk",
    """SELECT note_id AS start, note_id AS cur, 0 AS hops, [note_id] AS path, status, coalesce(redirect_to, superseded_by) AS nxt, false AS missing FROM notes0
 UNION ALL SELECT w.start, w.nxt, w.hops + 1, list_append(w.path, w.nxt), coalesce(n.status, 'none'), coalesce(n.redirect_to, n.superseded_by), n.note_id IS NULL
 FROM walk w LEFT JOIN notes0 n ON n.note_id = w.nxt WHERE w.status IN ('merged', 'superseded') AND w.nxt IS NOT NULL AND NOT list_contains(w.path[1:len(w.path) - 1], w.cur)""",
    "notes0",
)
cte(
    "chains",
    """SELECT start AS note_id, CASE WHEN outcome = 'active' THEN cur END AS canonical_id, outcome, CASE WHEN start <> cur OR outcome <> 'active' THEN start END AS first_alias,
   CASE WHEN outcome <> 'cycle' THEN hops END AS hops, CASE WHEN outcome <> 'cycle' THEN path END AS path
 FROM (SELECT *, CASE WHEN status = 'active' THEN 'active' WHEN missing THEN 'broken' ELSE 'cycle' END AS outcome, row_number() OVER (PARTITION BY start ORDER BY hops DESC) AS rn FROM walk) WHERE rn = 1""",
    "walk", materialized=True,
)


def ranked_twin(main: str, *needs: str) -> str:
    """A twin whose expressions include the recursive redirect walk."""
    return twin(main, *needs).replace("WITH ", "WITH RECURSIVE ", 1)


def keyword(name: str, queries: str, pool: int) -> None:
    """``name``: BM25-ranked phrase hits of ``queries`` (qid, q)."""
    cte(
        f"{name}_parts",
        f"""SELECT qid, q, note_id, doc_len, unnest([t, b]) AS part FROM (SELECT qid, lower(trim(q)) AS q FROM {queries} WHERE length(trim(q)) >= 3) x
  JOIN (SELECT note_id, lower(title) AS t, lower(body) AS b, (greatest(length(title) - 2, 0) + greatest(length(body) - 2, 0))::BIGINT AS doc_len FROM notes0) n ON contains(n.t, x.q) OR contains(n.b, x.q)""",
        queries, "notes0", materialized=True,
    )
    # one row per occurrence; the next one may overlap it
    cte(
        f"{name}_at",
        f"""SELECT qid, q, note_id, doc_len, substr(part, strpos(part, q) + 1) AS rest FROM {name}_parts WHERE contains(part, q)
 UNION ALL SELECT qid, q, note_id, doc_len, substr(rest, strpos(rest, q) + 1) FROM {name}_at WHERE contains(rest, q)""",
        f"{name}_parts",
    )
    cte(f"{name}_hits", f"SELECT qid, note_id, count(*)::BIGINT AS tf, doc_len FROM {name}_at GROUP BY ALL", f"{name}_at", materialized=True)
    cte(
        f"{name}_scored",
        f"""SELECT qid, note_id, tf, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE
     / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len)), 9) AS score
   FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS df FROM {name}_hits)
   CROSS JOIN (SELECT count(*)::DOUBLE AS n, sum(greatest(length(title) - 2, 0) + greatest(length(body) - 2, 0))::DOUBLE / count(*) AS avg_len FROM notes0)""",
        f"{name}_hits", "notes0", materialized=True,
    )
    cte(
        f"{name}_short",
        f"""SELECT qid, note_id, 0.0::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY note_id) AS rank
   FROM (SELECT qid, lower(trim(q)) AS q FROM {queries} WHERE length(trim(q)) IN (1, 2)) x JOIN notes0 n ON contains(lower(n.title), x.q) OR contains(lower(n.body), x.q)""",
        queries, "notes0", materialized=True,
    )
    cte(
        name,
        f"""SELECT qid, note_id, score, rank FROM (SELECT qid, note_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, note_id) AS rank FROM {name}_scored
   UNION ALL SELECT * FROM {name}_short) WHERE rank <= {pool}""",
        f"{name}_scored", f"{name}_short", materialized=True,
    )


def nearest(name: str, queries_vec: str, pool: int) -> None:
    cte(
        name,
        f"""SELECT * FROM (SELECT q.id AS qid, {_nid_of('n.id')} AS note_id, {cosine('q', 'n')} AS score,
   row_number() OVER (PARTITION BY q.id ORDER BY {cosine('q', 'n')} DESC, n.id) AS rank FROM {queries_vec} q CROSS JOIN note_vec n WHERE {cosine('q', 'n')} > 1e-6) WHERE rank <= {pool}""",
        queries_vec, "note_vec", materialized=True,
    )


def _nid_of(e: str) -> str:
    return nid(e)


def hybrid(name: str, key: str, vec: str, k: int) -> None:
    """``name``: the full hybrid ranking from channels ``key`` (keyword) and ``vec`` (nearest)."""
    for ch in (key, vec):
        cte(
            f"{name}_{ch}",
            f"""SELECT qid, canonical_id, direct, alias, row_number() OVER (PARTITION BY qid ORDER BY best) AS rank FROM (
     SELECT qid, canonical_id, min(c.rank) AS best, bool_or(first_alias IS NULL) AS direct, arg_min(first_alias, CASE WHEN first_alias IS NOT NULL THEN c.rank END) AS alias
     FROM {ch} c JOIN chains h ON h.note_id = c.note_id AND h.outcome = 'active' GROUP BY qid, canonical_id)""",
            ch, "chains", materialized=True,
        )
    from kledger.plans.fn import CONF_SQL, DECAY_SQL, IMP_SQL

    cte(
        name,
        f"""SELECT qid, rank, note_id, title, score, match_type, CASE WHEN NOT direct THEN alias END AS redirected_from, kind FROM (
   SELECT f.*, n.note_id, n.title, n.kind, round(fused * {CONF_SQL} * {DECAY_SQL} * {IMP_SQL}, 9) AS score,
     row_number() OVER (PARTITION BY qid ORDER BY round(fused * {CONF_SQL} * {DECAY_SQL} * {IMP_SQL}, 9) DESC, n.note_id) AS rank
   FROM (SELECT qid, canonical_id, sum(1.0::DOUBLE / (60 + rank)) AS fused, CASE WHEN count(*) = 2 THEN 'both' ELSE min(ch) END AS match_type, bool_or(direct) AS direct, arg_min(alias, o) AS alias FROM (
     SELECT *, 'fts' AS ch, CASE WHEN alias IS NOT NULL THEN 0 END AS o FROM {name}_{key} UNION ALL SELECT *, 'vector', CASE WHEN alias IS NOT NULL THEN 1 END FROM {name}_{vec}) GROUP BY qid, canonical_id) f
   JOIN notes0 n ON n.note_id = f.canonical_id WHERE NOT n.tombstone) WHERE rank <= {k}""",
        f"{name}_{key}", f"{name}_{vec}", "notes0", materialized=True,
    )


cte(
    "unanswered",
    f"""SELECT conv_id * 1000 + turn AS d, {nid('conv_id * 1000 + turn')} AS note_id, text AS question, '2024-05-0' || (conv_id % 9 + 1)::VARCHAR AS asked_date,
  CASE WHEN conv_id % 2 = 0 THEN 'no_notes' ELSE 'below_min_fresh' END AS reason FROM conversations WHERE role = 'user'""",
)
cte("guard_queries", "SELECT 'B-' || item_id::VARCHAR AS qid, text || CASE WHEN item_id % 4 = 0 THEN ' topic-' || (item_id % 37)::VARCHAR ELSE '' END AS q FROM benchmark")
cte(
    "conflicts",
    """SELECT 'C-' || lpad(a.d::VARCHAR, greatest(6, length(a.d::VARCHAR))::INTEGER, '0') AS conflict_id, a.d, a.note_id AS note_a, b.note_id AS note_b,
  CASE WHEN a.d % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, 'topic-' || (a.d % 37)::VARCHAR AS entity,
  a.title || ' ' || a.body AS text_a, coalesce(b.title || ' ' || b.body, '') AS text_b, a.entities AS entities_a, b.entities AS entities_b,
  a.title AS value_a, b.title AS value_b
 FROM notes0 a LEFT JOIN notes0 b ON b.d = a.d + 37""",
    "notes0", materialized=True,
)
vectors("guard_vec", "guard_queries", "qid", "q", "guard_queries")
vectors("unanswered_vec", "unanswered", "d", "question", "unanswered")
vectors("conflict_a_vec", "conflicts", "conflict_id", "text_a", "conflicts")
vectors("conflict_b_vec", "conflicts", "conflict_id", "text_b", "conflicts")
cte(
    "units",
    r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si, k) AS u, substr(s, (k * 500 + 1)::BIGINT, 500) AS t, CASE WHEN si = 1 AND k = 0 THEN chr(10) || chr(10) ELSE '' END AS j
 FROM (SELECT doc_id, pi, si, s, unnest(range(0, ceil(length(s) / 500.0)::BIGINT)) AS k FROM (
   SELECT doc_id, pi, unnest(ss) AS s, generate_subscripts(ss, 1) AS si FROM (
     SELECT doc_id, pi, CASE WHEN length(p) <= 500 THEN [p] ELSE list_filter(list_transform(string_split(regexp_replace(p, '([。！？；!?;]|\. )', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') END AS ss
     FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (
       SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents)))))""",
    materialized=True,
)
cte(
    "packing",
    """SELECT doc_id, 1::BIGINT AS u, t AS buf, NULL::VARCHAR AS done FROM units WHERE u = 1
 UNION ALL SELECT n.doc_id, n.u, CASE WHEN length(p.buf) + length(n.j) + length(n.t) <= 500 THEN p.buf || n.j || n.t ELSE n.t END,
   CASE WHEN length(p.buf) + length(n.j) + length(n.t) <= 500 THEN NULL ELSE p.buf END
 FROM packing p JOIN units n ON n.doc_id = p.doc_id AND n.u = p.u + 1""",
    "units",
)
cte(
    "chunks",
    """SELECT c.doc_id AS d, lpad(c.doc_id::VARCHAR, greatest(6, length(c.doc_id::VARCHAR))::INTEGER, '0') || '#c' || (row_number() OVER (PARTITION BY c.doc_id ORDER BY u) - 1)::VARCHAR AS chunk_id, c.text,
   substr(split_part(o.text, chr(10), 1), 1, 60) AS title
 FROM (SELECT doc_id, u, done AS text FROM packing WHERE done IS NOT NULL
   UNION ALL SELECT doc_id, 1000000000, arg_max(buf, u) FROM packing GROUP BY doc_id) c JOIN documents o USING (doc_id)""",
    "packing", materialized=True,
)
vectors("chunk_vec", "chunks", "chunk_id", "(title || chr(10) || text)", "chunks")
