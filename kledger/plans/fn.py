"""Scalar functions (FN) over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kledger.functions import temporal as T
from kledger.functions import text as X
from kledger.functions import vectors as V
from kledger.operators import modelout as MO
from kledger.plans import fixtures as fx
from kledger.plans.oracle_base import NOW, cosine, days, nid, ts, twin
from kledger.plans.registry import query


def docs(spark, sf):
    return fx.table(spark, sf, "documents")


SLUG_SQL = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g')"


def slug_sql(x: str) -> str:
    s = SLUG_SQL.format(x)
    return f"CASE WHEN {s} <> '' THEN {s} ELSE 'e-' || substr(sha1({x}), 1, 8) END"


@query("FN-01", twin(f"SELECT doc_id, {slug_sql('text')} AS slug, {slug_sql('source')} AS source_slug, {slug_sql(chr(39) + '?!' + chr(39) + ' || chr(233)')} AS empty_slug FROM documents"))
def fn_01(spark, sf):
    return docs(spark, sf).select(
        "doc_id", X.slugify(F.col("text")).alias("slug"), X.slugify(F.col("source")).alias("source_slug"),
        X.slugify(F.lit("?!é")).alias("empty_slug"),
    )


@query("FN-02", "SELECT doc_id, lower(trim(text)) AS alias_key FROM documents")
def fn_02(spark, sf):
    return docs(spark, sf).select("doc_id", X.alias_key(F.col("text")).alias("alias_key"))


_ENUM_IN = "CASE doc_id % 5 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'Low' WHEN 2 THEN 'medium' WHEN 3 THEN lang ELSE NULL END"


@query("FN-03", f"SELECT doc_id, CASE WHEN v IN ('high', 'medium', 'low') THEN v ELSE 'medium' END AS confidence FROM (SELECT doc_id, lower(trim({_ENUM_IN})) AS v FROM documents)")
def fn_03(spark, sf):
    return docs(spark, sf).withColumn("v", F.expr(_ENUM_IN)).select("doc_id", X.coerce_enum(F.col("v"), ("high", "medium", "low"), "medium").alias("confidence"))


@query("FN-04", twin("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text || ',' || source || ';' || upper(source), '[，,、;；/|]+'), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
 SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)[1:6], '|') AS entities FROM p"""))
def fn_04(spark, sf):
    raw = F.concat(F.col("text"), F.lit(","), F.col("source"), F.lit(";"), F.upper("source"))
    return docs(spark, sf).select("doc_id", F.array_join(X.split_entities(raw), "|").alias("entities"))


FULL = X.FULLWIDTH.replace("'", "''")
ASCII = X.ASCII_FOLD.replace("'", "''")


def norm_sql(x: str) -> str:
    kept = rf"regexp_replace(lower(nfc_normalize(translate({x}, '{FULL}', '{ASCII}'))), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}%.]+', '', 'g')"
    marked = kept
    for _ in range(2):
        marked = rf"regexp_replace({marked}, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g')"
    return f"replace(replace({marked}, '.', ''), chr(1), '.')"


@query("FN-05", f"SELECT doc_id, md5({norm_sql('text')}) AS normal_md5, {norm_sql('substr(text, 1, 60) || ' + chr(39) + ' v1.2.3 … 93.7% end. ５．１' + chr(39))} AS sample FROM documents")
def fn_05(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.md5(X.normalize_answer(F.col("text"))).alias("normal_md5"),
        X.normalize_answer(F.concat(F.substring("text", 1, 60), F.lit(" v1.2.3 … 93.7% end. ５．１"))).alias("sample"),
    )


@query("FN-06", r"""WITH c AS (SELECT doc_id, string_split(text, '') AS u, string_split(regexp_replace(text, '\s+', '', 'g'), '') AS w FROM documents),
 g AS (SELECT doc_id, u, w, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) AS b, list_transform(range(1, len(u) - 1), lambda i: u[i] || u[i + 1] || u[i + 2]) AS t FROM c)
 SELECT doc_id, len(u)::INTEGER AS n_unigrams, len(b)::INTEGER AS n_bigram_set, len(t)::INTEGER AS n_trigrams, md5(array_to_string(list_sort(b), ' ')) AS bigram_md5 FROM g""")
def fn_06(spark, sf):
    t = F.col("text")
    b = X.bigram_set(t)
    return docs(spark, sf).select(
        "doc_id", F.size(X.chars(t)).alias("n_unigrams"), F.size(b).alias("n_bigram_set"), F.size(X.ngrams(t, 3)).alias("n_trigrams"),
        F.md5(F.array_join(F.sort_array(b), " ")).alias("bigram_md5"),
    )


@query("FN-07", twin("SELECT id AS doc_id, b AS bucket, w AS weight FROM body_vec_w WHERE w <> 0", "body_vec_w"))
def fn_07(spark, sf):
    return (
        docs(spark, sf).select("doc_id", F.posexplode(V.encoder()(F.col("text"))).alias("bucket", "weight"))
        .filter("weight <> 0").withColumn("weight", F.col("weight").cast("bigint"))
    )


@query("FN-08", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
 SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def fn_08(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.dense_cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def body_pairs(spark, sf, step: int = 37):
    """Note d with note d + step, as (d, a, b) bodies."""
    d = docs(spark, sf).selectExpr("doc_id AS d", "text AS a")
    return d.join(d.select((F.col("d") - step).alias("d"), F.col("a").alias("b")), "d")


@query("FN-09", twin(f"SELECT a.id AS d, round(greatest(0.0, least(1.0, {cosine()})), 6) AS similarity FROM body_vec a JOIN body_vec b ON b.id = a.id + 37", "body_vec"))
def fn_09(spark, sf):
    v = docs(spark, sf).filter("length(text) > 0").select(F.col("doc_id").alias("d"), V.encoder()(F.col("text")).alias("va")).withColumn("na", V.norm2(F.col("va")))
    o = v.select((F.col("d") - 37).alias("d"), F.col("va").alias("vb"), F.col("na").alias("nb"))
    sim = V.similarity_from(V.dot(F.col("va"), F.col("vb")), F.col("na"), F.col("nb"))
    return v.join(o, "d").select("d", F.round(sim, 6).alias("similarity"))


_SETS = r"WITH s AS (SELECT doc_id AS d, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) AS g FROM (SELECT doc_id, string_split(regexp_replace(text, '\s+', '', 'g'), '') AS w FROM documents)) "


@query("FN-10", _SETS + "SELECT a.d, round(CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END, 6) AS jaccard FROM s a JOIN s b ON b.d = a.d + 37")
def fn_10(spark, sf):
    return body_pairs(spark, sf).select("d", F.round(X.jaccard(X.bigram_sizes(F.col("a"), F.col("b"))), 6).alias("jaccard"))


@query("FN-11", _SETS + "SELECT a.d, round(CASE WHEN least(len(a.g), len(b.g)) = 0 THEN 0.0 ELSE len(list_intersect(a.g, b.g))::DOUBLE / least(len(a.g), len(b.g)) END, 6) AS overlap FROM s a JOIN s b ON b.d = a.d + 37")
def fn_11(spark, sf):
    return body_pairs(spark, sf).select("d", F.round(X.overlap_coefficient(X.bigram_sizes(F.col("a"), F.col("b"))), 6).alias("overlap"))


FINGERPRINT_SQL = """sha256(concat_ws(chr(10), title, body, confidence, volatility, kind, coalesce(redirect_to, ''), coalesce(superseded_by, ''), coalesce(observed_at, ''), created,
  CASE WHEN tombstone THEN '1' ELSE '0' END, coalesce(importance::VARCHAR, '')))"""


def with_fingerprint(df):
    cols = [F.col(c) for c in ("title", "body", "confidence", "volatility", "kind", "redirect_to", "superseded_by", "observed_at", "created", "tombstone", "importance")]
    return df.withColumn("fingerprint", X.record_fingerprint(*cols))


@query("FN-12", twin(f"SELECT note_id, {FINGERPRINT_SQL} AS fingerprint FROM notes0", "notes0"))
def fn_12(spark, sf):
    return with_fingerprint(fx.notes(spark, sf, False)).select("note_id", "fingerprint")


@query("FN-13", twin("SELECT note_id, sha256(body) AS body_hash, substr(sha1(trim(body)), 1, 16) AS evidence_key, note_id || ':' || substr(sha1(trim(body)), 1, 16) AS update_key FROM notes0", "notes0"))
def fn_13(spark, sf):
    k = X.evidence_key(F.col("body"))
    return fx.notes(spark, sf, False).select("note_id", F.sha2("body", 256).alias("body_hash"), k.alias("evidence_key"), F.concat_ws(":", "note_id", k).alias("update_key"))


@query("FN-14", twin(f"""SELECT note_id, sha256(concat_ws(chr(10), 'merge', least(note_id, nxt) || ',' || greatest(note_id, nxt), sha256(body), 'min=0.5')) AS idempotency_key
 FROM (SELECT note_id, body, {nid('d + 37')} AS nxt FROM notes0)""", "notes0"))
def fn_14(spark, sf):
    n = fx.notes(spark, sf, False).withColumn("nxt", F.expr(fx.nid("d + 37")))
    key = X.idempotency_key(F.lit("merge"), F.array("note_id", "nxt"), F.array(F.sha2("body", 256)), F.lit("min=0.5"))
    return n.select("note_id", key.alias("idempotency_key"))


TOOLS = '[{"name": "web_search"}, {"name": "fetch_url"}]'
REQUEST_HASH_SQL = f"""SELECT conv_id, sha256(concat_ws('|', 'm1', '{TOOLS}', count(*)::VARCHAR, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT)::HUGEINT::VARCHAR, sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)::HUGEINT::VARCHAR)) AS request_hash
 FROM (SELECT conv_id, md5(concat_ws(chr(31), turn::VARCHAR, role, content, CASE WHEN name <> '' THEN 'name=' || name ELSE '' END, CASE WHEN role = 'tool' THEN 'tool_call_id=call-' || turn::VARCHAR ELSE '' END)) AS h FROM messages) GROUP BY conv_id"""


def requests(spark, sf):
    """Every conversation as one request; tool messages answer the call of their turn."""
    m = fx.messages(spark, sf).withColumn("tool_call_id", F.when(F.col("role") == "tool", F.concat(F.lit("call-"), F.col("turn").cast("string"))))
    return MO.request_hash(m, "m1", tools=TOOLS)


@query("FN-15", twin(REQUEST_HASH_SQL, "messages"))
def fn_15(spark, sf):
    return requests(spark, sf)


@query("FN-16", twin("SELECT event_id, trace_id || '::' || step AS step_key FROM token_ledger", "token_ledger"))
def fn_16(spark, sf):
    return fx.token_ledger(spark, sf).select("event_id", F.concat_ws("::", "trace_id", "step").alias("step_key"))


@query("FN-17", r"""SELECT doc_id, substr(list_filter(list_transform(string_split('## * ' || text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[#>*\- ]+', ''))), lambda x: x <> '')[1], 1, 60) AS title FROM documents""")
def fn_17(spark, sf):
    return docs(spark, sf).select("doc_id", X.derive_title(F.concat(F.lit("## * "), F.col("text"))).alias("title"))


_ID_IN = "CASE doc_id % 6 WHEN 0 THEN concat(' notes/N-000', cast(doc_id as {s}), '.md') WHEN 1 THEN concat('wiki-data/notes/C-', cast(doc_id as {s})) WHEN 2 THEN concat('../', source) WHEN 3 THEN source WHEN 4 THEN concat('9', source) ELSE concat('./', source, '/x') END"


@query("FN-18", rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9_-]{{0,63}}$') THEN t END AS note_id FROM (
 SELECT doc_id, regexp_replace(regexp_replace(replace(trim({_ID_IN.format(s='varchar')}), '\', '/'), '\.md$', ''), '^(wiki-data/)?(\./)?(notes/)?', '') AS t FROM documents)""")
def fn_18(spark, sf):
    return docs(spark, sf).withColumn("raw", F.expr(_ID_IN.format(s="string"))).select("doc_id", X.normalize_note_id(F.col("raw")).alias("note_id"))


def tokens_sql(x: str) -> str:
    wide = rf"length(regexp_replace({x}, '[^\x{{2E80}}-\x{{10FFFF}}]', '', 'g'))"
    return f"({wide} + ceil((length({x}) - {wide}) / 4.0))::BIGINT"


@query("FN-19", twin(f"SELECT conv_id, turn, {tokens_sql('content')} + {tokens_sql('role')} + {tokens_sql('name')} AS tokens FROM (SELECT * REPLACE (content || '中文测试' AS content) FROM messages)", "messages"))
def fn_19(spark, sf):
    m = fx.messages(spark, sf).withColumn("content", F.concat("content", F.lit("中文测试")))
    return m.select("conv_id", "turn", (X.estimated_tokens(F.col("content")) + X.estimated_tokens(F.col("role")) + X.estimated_tokens(F.col("name"))).alias("tokens"))


@query("FN-20", """SELECT doc_id, substr(text, 1, 120) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS snippet,
  CASE WHEN p > 0 THEN substr(text, greatest(p - 30, 1), p - greatest(p - 30, 1)) || '[' || substr(text, p, 3) || ']' || substr(text, p + 3, 30) END AS highlighted
 FROM (SELECT doc_id, text, position('the' IN lower(text)) AS p FROM documents)""")
def fn_20(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", X.snippet(t, 120).alias("snippet"), X.highlight(t, F.lit("THE")).alias("highlighted"))


@query("FN-21", twin(r"""SELECT note_id, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '\bN-\d+\b'))), ',') AS refs,
  array_to_string(list_sort(list_distinct(regexp_extract_all(body, '\[\[entity:([^\]|]+?)(?:\|[^\]]*)?\]\]', 1))), ',') AS entities,
  len(list_distinct(regexp_extract_all(body || ' [1] [2] [1]', '\[(\d+)\]', 1)))::INTEGER AS n_citations FROM lint_notes""", "lint_notes"))
def fn_21(spark, sf):
    b = F.col("body")
    return fx.lint_notes(spark, sf).select(
        "note_id", F.array_join(F.sort_array(X.note_refs(b)), ",").alias("refs"), F.array_join(F.sort_array(X.entity_links(b)), ",").alias("entities"),
        F.size(X.citation_numbers(F.concat(b, F.lit(" [1] [2] [1]")))).alias("n_citations"),
    )


DECOR_SQL = X.DECORATION.replace("'", "''")
ASSERTION_SQL = rf"""(trim({{0}}) <> '' AND NOT regexp_matches(trim({{0}}), '^\s*(```|~~~)') AND NOT regexp_matches(trim({{0}}), '^#{{{{1,6}}}}\s')
  AND regexp_replace(regexp_replace(trim({{0}}), '\[\[[^\]]*\]\]', '', 'g'), '{DECOR_SQL.replace('{', '{{').replace('}', '}}')}', '', 'g') <> '')"""


@query("FN-22", twin(f"SELECT page_id, count(*)::BIGINT AS n_lines, count(*) FILTER ({ASSERTION_SQL.format('line')})::BIGINT AS n_assertions FROM (SELECT page_id, unnest(string_split(body, chr(10))) AS line FROM wiki_pages) GROUP BY page_id", "wiki_pages"))
def fn_22(spark, sf):
    lines = fx.wiki_pages(spark, sf).select("page_id", F.explode(F.split("body", "\n")).alias("line"))
    return lines.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count_if(X.is_assertion(F.col("line"))).alias("n_assertions"))


_TS_IN = "CASE d % 7 WHEN 0 THEN '2026' WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN concat(created, 'Z') WHEN 4 THEN substr(created, 1, 10) WHEN 5 THEN '2024-13-45' ELSE created END"


@query("FN-23", twin(f"""SELECT note_id, strftime({ts('raw')}, '%Y-%m-%d %H:%M:%S') AS parsed FROM (SELECT note_id, {_TS_IN} AS raw FROM notes0)""", "notes0"))
def fn_23(spark, sf):
    n = fx.notes(spark, sf, False).withColumn("raw", F.expr(_TS_IN))
    return n.select("note_id", F.date_format(T.parse_ts(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("FN-24", twin(f"""SELECT note_id, strftime(coalesce({ts('observed_at')}, {ts('created')}), '%Y-%m-%d') AS base_day,
  CASE WHEN {ts('observed_at')} IS NOT NULL THEN 'observed_at' WHEN {ts('created')} IS NOT NULL THEN 'created' END AS base_field FROM notes0""", "notes0"))
def fn_24(spark, sf):
    o, c = F.col("observed_at"), F.col("created")
    return fx.notes(spark, sf, False).select("note_id", F.date_format(T.base_time(o, c), "yyyy-MM-dd").alias("base_day"), T.base_field(o, c).alias("base_field"))


HALF_SQL = "(CASE volatility WHEN 'volatile' THEN 30.0::DOUBLE WHEN 'drifting' THEN 90.0::DOUBLE END)"
BASE_SQL = f"coalesce({ts('observed_at')}, {ts('created')})"
AGE_SQL = days(NOW, BASE_SQL)
DECAY_SQL = f"(CASE WHEN {HALF_SQL} IS NULL OR {AGE_SQL} IS NULL OR {AGE_SQL} <= 0 THEN 1.0::DOUBLE ELSE pow(0.5::DOUBLE, {AGE_SQL} / {HALF_SQL}) END)"
CONF_SQL = "(CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'low' THEN 0.75::DOUBLE ELSE 0.9::DOUBLE END)"
IMP_SQL = "(0.5::DOUBLE + 0.5::DOUBLE * (CASE WHEN importance IS NULL THEN 0.6 ELSE greatest(0.0, least(1.0, importance)) END)::DOUBLE)"


@query("FN-25", twin(f"SELECT note_id, round({DECAY_SQL}, 6) AS decay FROM notes0", "notes0"))
def fn_25(spark, sf):
    age = T.age_days(T.now_lit(fx.NOW), T.base_time(F.col("observed_at"), F.col("created")))
    return fx.notes(spark, sf, False).select("note_id", F.round(T.decay(age, T.half_life(F.col("volatility"))), 6).alias("decay"))


@query("FN-26", twin(f"SELECT note_id, {CONF_SQL} AS confidence_factor, round({IMP_SQL}, 6) AS importance_factor FROM notes0", "notes0"))
def fn_26(spark, sf):
    return fx.notes(spark, sf, False).select("note_id", T.confidence_factor(F.col("confidence")).alias("confidence_factor"), F.round(T.importance_factor(F.col("importance")), 6).alias("importance_factor"))


SPECIFICS_SQL = "(regexp_matches({0}, '[0-9]') OR regexp_matches({0}, '[A-Za-z]') OR regexp_matches({0}, '[「『“\"''][^」』”\"'']+[」』”\"'']'))"


@query("FN-27", f"SELECT doc_id, {SPECIFICS_SQL.format('substr(text, 3, 2)')} AS specific FROM documents")
def fn_27(spark, sf):
    return docs(spark, sf).select("doc_id", X.has_specifics(F.substring("text", 3, 2)).alias("specific"))


_PLAN_IN = r"concat('Plan{n}- [ ] ', substr(text, 1, 20), '{n}- step ', source, '{n}  - [x] done{n}', CASE WHEN doc_id % 2 = 0 THEN '- [ ] second' ELSE '-x' END)"
_PLAN_ODD = r"concat('Plan{n}- a ', source, '{n}-b{n}- c')"


@query("FN-28", r"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(CASE WHEN doc_id % 3 = 0 THEN """ + _PLAN_ODD.format(n="@@") + " ELSE " + _PLAN_IN.format(n="@@") + r""" END, '@@', chr(10)), chr(10)), lambda x: trim(x)) AS a FROM documents),
 f AS (SELECT doc_id, list_filter(a, lambda x: regexp_matches(x, '^- \[ \]\s+\S')) AS boxes, list_filter(a, lambda x: regexp_matches(x, '^-\s+\S')) AS items FROM l)
 SELECT doc_id, array_to_string(CASE WHEN len(boxes) > 0 THEN boxes ELSE items END, '|') AS tasks FROM f""")
def fn_28(spark, sf):
    plan = F.replace(F.expr(f"CASE WHEN doc_id % 3 = 0 THEN {_PLAN_ODD.format(n='@@')} ELSE {_PLAN_IN.format(n='@@')} END"), F.lit("@@"), F.lit("\n"))
    return docs(spark, sf).withColumn("plan", plan).select("doc_id", F.array_join(X.open_tasks(F.col("plan")), "|").alias("tasks"))


@query("FN-29", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_extract('说明。来源：doc-' || doc_id || '、 ' || source || ' 。其余', '来源：([^。]*)。', 1), '、'), lambda x: trim(x)), lambda x: x <> ''), '|') AS docs FROM documents""")
def fn_29(spark, sf):
    t = F.expr("concat('说明。来源：doc-', cast(doc_id as string), '、 ', source, ' 。其余')")
    return docs(spark, sf).select("doc_id", F.array_join(X.source_docs(t), "|").alias("docs"))


def ledger_line(question, day, reason):
    return F.concat(F.lit("问题「"), question, F.lit("」于 "), day, F.lit(" 未得到回答（原因 "), reason, F.lit("）"))


@query("FN-30", r"""SELECT doc_id, regexp_extract(l, '(?s)问题「(.*)」于 ', 1) AS question, regexp_extract(l, '」于 (\d{4}-\d{2}-\d{2})', 1) AS asked_date, regexp_extract(l, '（原因 (\w+)）', 1) AS reason
 FROM (SELECT doc_id, '问题「' || substr(text, 1, 50) || '」于 2024-05-0' || (doc_id % 9 + 1) || ' 未得到回答（原因 ' || CASE WHEN doc_id % 2 = 0 THEN 'no_notes' ELSE 'below_min_fresh' END || '）' AS l FROM documents)""")
def fn_30(spark, sf):
    line = ledger_line(F.substring("text", 1, 50), F.expr("concat('2024-05-0', cast(doc_id % 9 + 1 as string))"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'no_notes' ELSE 'below_min_fresh' END"))
    return docs(spark, sf).withColumn("l", line).select(
        "doc_id", F.regexp_extract("l", "(?s)问题「(.*)」于 ", 1).alias("question"), F.regexp_extract("l", r"」于 (\d{4}-\d{2}-\d{2})", 1).alias("asked_date"),
        F.regexp_extract("l", r"（原因 (\w+)）", 1).alias("reason"),
    )


@query("FN-31", "SELECT doc_id, regexp_replace(v, '@v2$', '') AS base, v LIKE '%@v2' AS is_v2 FROM (SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '@v2' ELSE '' END AS v FROM documents)")
def fn_31(spark, sf):
    v = F.concat("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN '@v2' ELSE '' END"))
    return docs(spark, sf).withColumn("v", v).select("doc_id", X.version_base(F.col("v")).alias("base"), F.col("v").endswith("@v2").alias("is_v2"))


_RAW_IN = "CASE doc_id % 8 WHEN 0 THEN '0.4' WHEN 1 THEN '7' WHEN 2 THEN '-3' WHEN 3 THEN 'nan' WHEN 4 THEN source WHEN 5 THEN NULL WHEN 6 THEN 'Yes' ELSE 'off' END"


@query("FN-32", f"""SELECT doc_id, CASE WHEN d IS NULL OR isnan(d) THEN 0.5 ELSE greatest(0.0, least(1.0, d)) END::DOUBLE AS ratio,
  greatest(0, coalesce(CASE WHEN regexp_matches(trim(r), '^[+-]?[0-9]+$') THEN try_cast(trim(r) AS BIGINT) END, 5))::BIGINT AS n,
  CASE WHEN lower(trim(r)) IN ('1', 'true', 'yes', 'on', 'y', 't') THEN true WHEN lower(trim(r)) IN ('0', 'false', 'no', 'off', 'n', 'f') THEN false ELSE true END AS flag
 FROM (SELECT doc_id, r, try_cast(r AS DOUBLE) AS d FROM (SELECT doc_id, {_RAW_IN} AS r FROM documents))""")
def fn_32(spark, sf):
    r = F.col("r")
    return docs(spark, sf).withColumn("r", F.expr(_RAW_IN)).select("doc_id", X.ratio(r, 0.5).alias("ratio"), X.count_floor(r, 5).alias("n"), X.flag(r, True).alias("flag"))
