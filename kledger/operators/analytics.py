"""Experiment analytics: scoring, matrices, exact percentiles, cost curves, turns, streaks, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.operators.skew import global_position, position_within, previous, running

# Phrases that mark a refusal, and the length under which they count.
REFUSAL_PHRASES = ("无法确定", "无法回答", "我不知道", "资料未提及", "没有找到", "不确定")
REFUSAL_MAX = 80
UPDATE_EVENT = 17


# ---- scoring ---------------------------------------------------------------------------------------
def score_answers(rows: DataFrame) -> DataFrame:
    """Adds em, point_hits, refusal and citation_coverage; an unanswered row has none of them."""
    na = X.normalize_answer(F.col("answer"))
    df = rows.withColumn("_na", na).withColumn("_gold", F.transform(X.nfkc_each(F.col("gold_points")), lambda g: X.normalize_folded(g)))
    hits = F.transform("_gold", lambda g: (g != "") & F.contains(F.col("_na"), g))
    df = df.withColumn("point_hits", F.when(F.col("answer").isNotNull(), hits))
    em = F.when(F.size("_gold") == 0, F.lit(0.0)).otherwise(F.size(F.filter("point_hits", lambda h: h)) / F.size("_gold").cast("double"))
    refusal = (F.length("_na") < REFUSAL_MAX) & F.exists(F.array(*[F.lit(p) for p in REFUSAL_PHRASES]), lambda p: F.contains(F.col("_na"), p))
    cited = F.size(F.filter(X.citation_numbers(F.col("answer")), lambda n: (n >= 1) & (n <= F.col("n_sources"))))
    coverage = F.when((F.col("n_sources") > 0) & F.col("answer").isNotNull(), cited / F.col("n_sources").cast("double"))
    return df.withColumn("em", F.when(F.col("answer").isNotNull(), em)).withColumn("refusal", refusal).withColumn("citation_coverage", coverage).drop("_na", "_gold")


# ---- exact percentiles -----------------------------------------------------------------------------
def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per key, exact for keys of any size.

    One range-partitioned sort numbers all rows; a percentile reads two of them. Nothing gathers the values
    of a key, as an aggregate over its distinct values would.
    """
    # equal values are told apart by their place, so a frequent value fills several range partitions
    rows = df.select(*keys, value).filter(F.col(value).isNotNull()).withColumn("_tie", F.monotonically_increasing_id())
    placed = global_position(rows, [*keys, value, "_tie"]).drop("_tie")
    size = placed.groupBy(*keys).agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in points.items()]))
    want = size.select(*keys, "_first", "_n", spec.alias("s")).withColumn("_at", F.col("s.p") * (F.col("_n") - 1))
    want = want.withColumn("_lo", F.floor("_at")).withColumn("_frac", F.col("_at") - F.col("_lo"))
    picks = want.select(*keys, "s.name", "_frac", F.explode(F.array(
        F.struct((F.col("_first") + F.col("_lo")).alias("pos"), (1 - F.col("_frac")).alias("w")),
        F.struct((F.col("_first") + F.least(F.col("_lo") + 1, F.col("_n") - 1)).alias("pos"), F.col("_frac").alias("w")),
    )).alias("q")).select(*keys, "name", F.col("q.pos").alias("pos"), F.col("q.w").alias("w"))
    got = picks.join(placed.select("pos", F.col(value).alias("_x")), "pos").groupBy(*keys).agg(
        *[F.round(F.sum(F.when(F.col("name") == n, F.col("w") * F.col("_x"))), 6).alias(n) for n in points]
    )
    return got


P50_95 = {"latency_p50": 0.5, "latency_p95": 0.95}


def condition_matrix(rows: DataFrame) -> DataFrame:
    """One row per condition; rows without a condition are dropped. Missing scores leave the denominator,
    missing search counts are zero unless a condition has none at all."""
    df = rows.filter("condition IS NOT NULL")
    agg = df.groupBy("condition").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.avg("em"), F.lit(0.0)), 6).alias("em_mean"), F.count("em").alias("em_n"),
        F.round(F.count_if(F.coalesce("refusal", F.lit(False))) / F.count("*"), 6).alias("refusal_rate"),
        F.round(F.avg("input_tokens"), 6).alias("in_mean"), F.round(F.avg("output_tokens"), 6).alias("out_mean"),
        F.round(F.when(F.count("fresh_search_count") > 0, F.avg(F.coalesce("fresh_search_count", F.lit(0)))), 6).alias("fresh_mean"),
    )
    return agg.join(exact_percentiles(df, ["condition"], "latency_ms", P50_95), "condition", "left")


def coverage_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("condition").agg(F.round(F.avg("citation_coverage"), 6).alias("coverage_mean"), F.count("citation_coverage").alias("coverage_n"), F.count("em").alias("em_n"))


def markdown_cell(c: Column) -> Column:
    """A table cell: bars are widened, white space is folded, nothing is left empty."""
    t = F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("／")), r"\s+", " "))
    return F.when(t == "", "—").otherwise(t)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown table line per row, keyed by the first column."""
    cells = F.concat_ws(" | ", *[markdown_cell(F.col(c).cast("string")) for c in columns])
    return df.select(F.col(columns[0]), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


# ---- sequence experiments --------------------------------------------------------------------------
def cost_curve(rows: DataFrame, conditions: tuple[str, ...] = ("c1", "c2", "c3", "c4")) -> DataFrame:
    """Running main, judge and embedding cost per (run, condition) over all events of the run. A condition
    without a row at an event keeps its value."""
    per = rows.groupBy("run", "event_id", "condition").agg(F.sum("in_tok").alias("m"), F.sum("judge_in_tok").alias("j"), F.sum(F.coalesce("embedding_calls", F.lit(0))).alias("e"))
    kinds = rows.groupBy("run", "event_id").agg(F.max("event_kind").alias("event_kind"), F.max("qid").alias("qid"))
    grid = kinds.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    df = grid.join(per, ["run", "event_id", "condition"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return running(df, ["run", "condition"], ["event_id"], sums={"main": zero("m"), "judge": zero("j"), "emb": zero("e")}).drop("m", "j", "e")


def amortized(curve: DataFrame) -> DataFrame:
    """(run, condition, n, event_id, all_in, per_query) at every query event; n counts the queries so far."""
    q = F.when(F.col("event_kind") == "query", 1).otherwise(0)
    df = running(curve, ["run", "condition"], ["event_id"], sums={"n": q}).filter("event_kind = 'query'")
    all_in = F.col("main") + F.col("judge")
    return df.select("run", "condition", "n", "event_id", "qid", all_in.alias("all_in"), F.round(all_in / F.col("n"), 6).alias("per_query"))


def break_even(amort: DataFrame, subject: str = "c4") -> DataFrame:
    """First query at which ``subject`` costs no more than each other condition; NULL when never."""
    s = amort.filter(F.col("condition") == subject).select("run", "n", F.col("all_in").alias("own"))
    df = amort.filter(F.col("condition") != subject).join(s, ["run", "n"])
    return df.groupBy("run", F.col("condition").alias("target")).agg(F.min(F.when(F.col("own") <= F.col("all_in"), F.col("n"))).alias("crossing"))


def condition_totals(rows: DataFrame) -> DataFrame:
    agg = rows.groupBy("condition").agg(
        F.count("*").alias("n_rows"), F.sum("in_tok").alias("main_in"), F.sum("judge_in_tok").alias("judge_in"), F.sum("out_tok").alias("main_out"),
        F.sum(F.coalesce("embedding_calls", F.lit(0))).alias("embedding"),
    )
    return agg.join(exact_percentiles(rows, ["condition"], "latency_ms", P50_95), "condition", "left")


def repeat_pairs(rows: DataFrame) -> DataFrame:
    """(run, qid, first, second, kind): the first two query events of each question; intra when both lie before
    the update, straddle when the update lies between."""
    upd = rows.filter("event_kind = 'update'").groupBy("run").agg(F.min("event_id").alias("update_id"))
    asked = rows.filter("event_kind = 'query' AND qid IS NOT NULL").select("run", "qid", "event_id").distinct()
    first = asked.groupBy("run", "qid").agg(F.min("event_id").alias("first"))
    later = asked.join(first, ["run", "qid"]).filter("event_id > first").groupBy("run", "qid").agg(F.min("first").alias("first"), F.min("event_id").alias("second"))
    df = later.join(upd, "run", "left")
    kind = F.when(F.col("update_id").isNull() | (F.col("second") < F.col("update_id")), "intra").when((F.col("first") < F.col("update_id")) & (F.col("update_id") < F.col("second")), "straddle")
    return df.withColumn("kind", kind).filter("kind IS NOT NULL").select("run", "qid", "first", "second", "kind")


def sequence_stats(rows: DataFrame) -> DataFrame:
    """Per (run, condition): coverage of answerable queries, temporal subset after the update, unanswerable and
    override rows, build cost."""
    q = F.col("event_kind") == "query"
    temporal = q & (F.col("event_id") > UPDATE_EVENT) & (F.col("gold_source") == "base") & (F.col("qtype") == "temporal")
    return rows.groupBy("run", "condition").agg(
        F.round(F.avg(F.when(q & (F.col("qtype") != "unanswerable"), F.col("citation_coverage"))), 6).alias("answerable_cov"),
        F.round(F.avg(F.when(temporal, F.col("em"))), 6).alias("temporal_em"), F.round(F.avg(F.when(temporal, F.col("citation_coverage"))), 6).alias("temporal_cov"), F.count_if(temporal).alias("temporal_n"),
        F.count_if(q & (F.col("qtype") == "unanswerable")).alias("unanswerable_n"), F.min(F.when(q & (F.col("qtype") == "unanswerable"), F.col("citation_coverage"))).alias("unanswerable_min"),
        F.count_if(q & (F.col("gold_source") == "override")).alias("override_n"), F.sum(F.when(~q, F.col("in_tok")).otherwise(0)).alias("build_cost"),
        F.sum(F.col("in_tok") + F.col("judge_in_tok")).alias("all_in"), F.count_if(q).alias("query_n"), F.count_if(q & (F.col("policy_mode") == "simple")).alias("simple_n"),
    )


def verdict_table(rows: DataFrame) -> DataFrame:
    """Four claims per run: hold, falsified, undetermined, or not_falsified; missing data is never a verdict."""
    st = sequence_stats(rows)
    def side(c):
        return st.filter(F.col("condition") == c).select("run", *[F.col(x).alias(f"{c}_{x}") for x in ("all_in", "answerable_cov", "temporal_em", "temporal_cov", "temporal_n", "unanswerable_n", "unanswerable_min", "query_n", "simple_n")])
    base = rows.select("run").distinct()
    for c in ("c4", "c2", "c3"):
        base = base.join(side(c), "run", "left")
    c4 = rows.filter("condition = 'c4'").select("run", "event_id", F.col("citation_coverage").alias("cov"))
    intra = repeat_pairs(rows).filter("kind = 'intra'").select("run", "qid", "first", "second")
    a = intra.join(c4.select("run", F.col("event_id").alias("first"), F.col("cov").alias("cov1")), ["run", "first"], "left").join(c4.select("run", F.col("event_id").alias("second"), F.col("cov").alias("cov2")), ["run", "second"], "left")
    reuse = a.groupBy("run").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("cov2") < F.col("cov1")).alias("n_down"), F.count_if(F.col("cov1").isNotNull() & F.col("cov2").isNotNull()).alias("n_both"))
    df = base.join(reuse, "run", "left")
    reuse_state = (
        F.when(F.col("n_pairs").isNull(), "undetermined").when(F.col("n_down") > 0, "falsified").when((F.col("c4_query_n") > 0) & (F.col("c4_simple_n") == 0), "falsified")
        .when((F.col("n_both") == F.col("n_pairs")) & (F.col("c4_simple_n") > 0), "hold").otherwise("undetermined")
    )
    def above(x):
        return F.coalesce((F.col(f"c4_{x}") > F.col(f"c2_{x}")) & (F.col(f"c4_{x}") > F.col(f"c3_{x}")), F.lit(False))
    def under(x):
        return F.coalesce((F.col(f"c4_{x}") <= F.col(f"c2_{x}")) & (F.col(f"c4_{x}") <= F.col(f"c3_{x}")), F.lit(False))
    evo = (
        F.when(F.coalesce("c4_temporal_n", F.lit(0)) == 0, "undetermined").when(F.col("c2_temporal_cov").isNull() & F.col("c2_temporal_em").isNull(), "undetermined")
        .when(above("temporal_cov") | above("temporal_em"), "hold").when(under("temporal_cov") & under("temporal_em"), "falsified").otherwise("undetermined")
    )
    df = df.withColumn("reuse", reuse_state).withColumn("evolution", evo)
    eco = (
        F.when(F.col("c4_all_in").isNull() | F.col("c2_all_in").isNull(), "undetermined").when(F.col("c4_all_in") <= F.col("c2_all_in"), "hold")
        .when(F.col("c4_answerable_cov") - F.col("c2_answerable_cov") >= 0.5, "hold").when((F.col("reuse") == "falsified") & (F.col("evolution") == "falsified"), "falsified").otherwise("undetermined")
    )
    anti = F.when(F.col("c4_unanswerable_min").isNull(), "undetermined").when(F.col("c4_unanswerable_min") <= 0.25, "falsified").otherwise("not_falsified")
    return df.select("run", eco.alias("economy"), "reuse", "evolution", anti.alias("anti_fabrication"))


# ---- conversations ---------------------------------------------------------------------------------
def segment_turns(messages: DataFrame) -> DataFrame:
    """Adds ``segment``: a new one at the first row and at every assistant row, except the assistant row right
    after a lone opening user row."""
    rn = running(messages, ["conv_id"], ["turn"], sums={"rn": F.lit(1)})
    p = previous(rn, ["conv_id"], ["turn"], {"prev_role": F.col("role")})
    start = (F.col("rn") == 1) | ((F.col("role") == "assistant") & ~((F.col("rn") == 2) & F.coalesce(F.col("prev_role") == "user", F.lit(False))))
    p = p.withColumn("_start", F.when(start, 1).otherwise(0)).drop("rn", "prev_role")
    return running(p, ["conv_id"], ["turn"], sums={"segment": F.col("_start")}).drop("_start")


def compaction_plan(messages: DataFrame, window: int = 131072, ratio: float = 0.7, keep: int = 4) -> DataFrame:
    """One row per conversation: whether to compact, what is kept, and the first assistant text as the plan."""
    tok = X.estimated_tokens(F.col("content")) + X.estimated_tokens(F.col("role")) + X.estimated_tokens(F.col("name"))
    seg = segment_turns(messages).withColumn("tokens", tok)
    n = seg.groupBy("conv_id").agg(F.max("segment").alias("n_segments"), F.sum("tokens").alias("pre_tokens"), F.min_by(F.when(F.trim("content") != "", F.substring("content", 1, 200)), F.when((F.col("role") == "assistant") & (F.trim("content") != ""), F.col("turn"))).alias("plan"))
    kept = seg.join(n.select("conv_id", "n_segments"), "conv_id").filter(F.col("segment") > F.col("n_segments") - keep).groupBy("conv_id").agg(F.sum("tokens").alias("kept_tokens"), F.min("turn").alias("kept_from"))
    due = (F.col("pre_tokens") >= F.lit(ratio * window)) & (F.col("n_segments") > keep)
    return n.join(kept, "conv_id").withColumn("compact", due).select("conv_id", "n_segments", "pre_tokens", "kept_tokens", "kept_from", "compact", "plan")


def tool_digest(messages: DataFrame, limit: int = 800) -> DataFrame:
    """Digest lines of tool messages in turn order: (conv_id, turn, line)."""
    cut = F.when(F.length("content") > limit, F.concat(F.substring("content", 1, limit), F.lit("…"))).otherwise(F.col("content"))
    return messages.filter("role = 'tool'").select("conv_id", "turn", F.concat(F.lit("["), "name", F.lit("] "), cut).alias("line"))


# ---- ledgers ---------------------------------------------------------------------------------------
def failure_streaks(outcomes: DataFrame, pause_at: int = 3) -> DataFrame:
    """Adds ``streak`` (failures in a row, this row included) and ``pause`` where the limit is reached."""
    bad = F.when(F.col("status") == "failed", 1).otherwise(0)
    df = running(outcomes, ["worker"], ["seq"], sums={"fails": bad})
    df = running(df, ["worker"], ["seq"], maxes={"settled": F.when(F.col("status") != "failed", F.col("fails"))})
    streak = F.col("fails") - F.coalesce("settled", F.lit(0))
    return df.withColumn("streak", streak).withColumn("pause", streak == pause_at).drop("fails", "settled")


def current_step(events: DataFrame) -> DataFrame:
    """Adds ``current``: the last known step of the worker; events without a step keep the previous one."""
    df = running(events, ["worker"], ["seq"], maxes={"_s": F.when(F.col("step").isNotNull(), F.struct("seq", "step"))})
    return df.withColumn("current", F.col("_s.step")).drop("_s")


def growth_violations(counts: DataFrame) -> DataFrame:
    """(worker, day, n, before) where a count grew from one snapshot to the next."""
    p = previous(counts, ["worker"], ["day"], {"before": F.col("n")})
    return p.filter(F.col("n") > F.col("before")).select("worker", "day", "n", "before")


def source_pool(rows: DataFrame) -> DataFrame:
    """(run, number, url, content_hash): URLs of a run in first-seen order, first non-empty hash kept."""
    pool = rows.groupBy("run", "url").agg(F.min("pos").alias("pos"), F.min_by("content_hash", F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("pos"))).alias("content_hash"))
    return position_within(pool, ["run"], "pos", "number").select("run", "number", "url", F.coalesce("content_hash", F.lit("")).alias("content_hash"))


def logged_sources(messages: DataFrame) -> DataFrame:
    """(run, pos, url, content_hash) from logged tool results: search hits, fetched pages, nested sources."""
    item = "array<struct<url:string,content_hash:string>>"
    j = F.from_json("content", f"results {item}, sources {item}, url string, content_hash string")
    m = messages.select("run", "seq", j.alias("j")).filter("j IS NOT NULL")
    page = F.when(F.col("j.url").isNotNull(), F.array(F.struct(F.col("j.url").alias("url"), F.col("j.content_hash").alias("content_hash")))).otherwise(F.array().cast(item))
    none = F.array().cast(item)
    every = F.concat(F.coalesce("j.results", none), page, F.coalesce("j.sources", none))
    out = m.select("run", "seq", F.posexplode(every).alias("i", "s")).filter("s.url IS NOT NULL AND s.url <> ''")
    return out.select("run", (F.col("seq") * (1 << 20) + F.col("i")).alias("pos"), "s.url", F.coalesce("s.content_hash", F.lit("")).alias("content_hash"))


def round_robin(rows: DataFrame, category: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows taken category by category in turn, categories in order of first appearance."""
    from kledger.operators.retrieval import top_rows

    first = rows.groupBy(category).agg(F.min(order).alias("_seen"))
    ranked = top_rows(rows, [category], [order], limit, "_round")
    return ranked.join(first, category).orderBy("_round", "_seen").limit(limit).drop("_round", "_seen")


def visible_counts(docs: DataFrame) -> DataFrame:
    """(event_id, visible) at every event where the corpus changes: arrivals up to it minus replacements.

    Arrivals and replacements are folded to one signed count per event, so no (event, document) pair is built.
    """
    plus = docs.groupBy(F.col("arrive").alias("event_id")).agg(F.count("*").alias("n"))
    minus = docs.filter("replaced IS NOT NULL").groupBy(F.col("replaced").alias("event_id")).agg((-F.count("*")).alias("n"))
    delta = plus.unionByName(minus).groupBy("event_id").agg(F.sum("n").alias("n"))
    return running(delta, [], ["event_id"], sums={"visible": F.col("n")}).select("event_id", "visible")


def reconcile(metrics: DataFrame, ledger: DataFrame) -> DataFrame:
    """Traces whose run metrics and ledger sums differ, missing sides included."""
    l = ledger.groupBy("trace_id").agg(F.sum("input_tokens").alias("l_in"), F.sum("output_tokens").alias("l_out"))
    df = metrics.select("trace_id", F.col("input_tokens").alias("m_in"), F.col("output_tokens").alias("m_out")).join(l, "trace_id", "full_outer")
    return df.filter(~(F.col("m_in").eqNullSafe(F.col("l_in")) & F.col("m_out").eqNullSafe(F.col("l_out"))))
