"""Choosing how much research a question needs from what the store already holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import vectors as V
from kledger.operators.blocks import ITEM_BLOCK, MAX_BROADCAST_QUERIES, QUERY_BLOCK, SLICE, bounded_rows, score_cosine

# Limits of each mode (prior_k, prior_max_chars, max_fresh_searches, max_steps, min_fresh_sources).
LIMITS = {"simple": (3, 1200, 0, 3, 0), "update": (5, 4000, 2, 6, 1), "deep": (5, 4000, 4, 12, 0)}
LIMIT_NAMES = ("prior_k", "prior_max_chars", "max_fresh_searches", "max_steps", "min_fresh_sources")
BOUNDS = {"prior_k": (1, 20), "prior_max_chars": (200, 20000), "max_fresh_searches": (0, 20), "max_steps": (1, 50), "min_fresh_sources": (0, 20)}
STYLES = {"simple": "brief", "update": "standard", "deep": "full"}
SUBAGENTS = ("deep",)
MIN_HITS, MIN_SCORE, BUDGET_FLOOR = 2, 0.010, 0.15


def count_similar(items: DataFrame, queries: DataFrame, flags: list[str], floor: float) -> DataFrame:
    """(qid, one sum per flag) over the items at least ``floor`` similar to each query. Tasks return sums, not pairs."""
    out = "qid string, " + ", ".join(f"{f} bigint" for f in flags)

    def block(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(it):
            return pd.DataFrame(columns=["qid", *flags])
        sums = np.zeros((len(q), len(flags)), dtype=np.int64)
        for lo in range(0, len(it), SLICE):
            part = it.iloc[lo : lo + SLICE]
            near = (np.minimum(score_cosine(q, part), 1.0) >= floor).astype(np.float64)
            sums += (near @ part[flags].to_numpy(dtype=np.float64)).astype(np.int64)
        return pd.DataFrame({"qid": q["qid"].to_numpy(), **{f: sums[:, i] for i, f in enumerate(flags)}})

    rows = bounded_rows(queries, MAX_BROADCAST_QUERIES)
    if rows is not None:
        shared = items.sparkSession.sparkContext.broadcast(pd.DataFrame([r.asDict() for r in rows], columns=queries.columns))

        def scan(batches):
            total = None
            for pdf in batches:
                got = block(shared.value, pdf).set_index("qid")
                total = got if total is None else total.add(got, fill_value=0)
            if total is not None and len(total):
                yield total.astype("int64").reset_index()

        part = items.mapInPandas(scan, out)
    else:
        nb, qb = (max(1, -(-t.count() // size)) for t, size in ((items, ITEM_BLOCK), (queries, QUERY_BLOCK)))
        zero = F.lit(0).cast("bigint")
        left = items.withColumn("_n", F.pmod(F.xxhash64("item_id"), F.lit(nb))).withColumn("_q", F.explode(F.sequence(zero, F.lit(qb - 1).cast("bigint"))))
        right = queries.withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(qb))).withColumn("_n", F.explode(F.sequence(zero, F.lit(nb - 1).cast("bigint"))))
        part = left.groupBy("_n", "_q").cogroup(right.groupBy("_n", "_q")).applyInPandas(lambda a, b: block(b, a), out)
    return part.groupBy("qid").agg(*[F.sum(f).alias(f) for f in flags])


GUARDS = ["stale", "due", "low"]


def features(queries: DataFrame, hits: DataFrame, states: DataFrame, conflicts: DataFrame, floor: float = 0.3) -> DataFrame:
    """One row per question. ``hits``: (qid, note_id, score), the probe window; ``states``: active notes with state,
    volatility, confidence, title and body; ``conflicts``: (conflict_id, question), open ones.

    Stale, due and low-confidence notes outside the window count too when similar enough: all similar notes are
    counted in one scan and the window's own share is taken off.
    """
    enc = V.encoder()
    flag = {"stale": F.col("state") == "stale", "due": F.col("state") == "review_due", "low": F.col("confidence") == "low"}
    st = states.select("note_id", "state", "volatility", "confidence", *[c.cast("bigint").alias(n) for n, c in flag.items()], F.concat(F.col("title"), F.lit(" "), F.substring("body", 1, 400)).alias("t"))
    qv = queries.select("qid", enc(F.col("q")).alias("v"))
    risky = st.filter("stale + due + low > 0").select(F.col("note_id").alias("item_id"), enc("t").alias("v"), *GUARDS)
    everywhere = count_similar(risky, qv, GUARDS, floor)
    win = hits.join(st, "note_id")
    vol = F.when(F.col("volatility") == "volatile", 2).when(F.col("volatility") == "drifting", 1).otherwise(0)
    inside = win.join(qv.withColumnRenamed("v", "qv"), "qid").withColumn("nv", enc("t"))
    sim = V.similarity_from(V.dot(F.col("qv"), F.col("nv")), V.norm2(F.col("qv")), V.norm2(F.col("nv")))
    near = F.when(sim >= floor, 1).otherwise(0)
    window = inside.groupBy("qid").agg(
        F.count("*").alias("hit_count"), F.max("score").alias("top_score"), F.count_if(F.col("state") == "fresh").alias("fresh_hits"), F.count_if(F.col("volatility") == "volatile").alias("volatile_hits"), F.max(vol).alias("_vol"),
        *[F.sum(f).alias(f"w_{f}") for f in GUARDS], *[F.sum(F.col(f) * near).alias(f"n_{f}") for f in GUARDS],
    )
    related = count_similar(conflicts.select(F.col("conflict_id").alias("item_id"), enc(F.col("question")).alias("v"), F.lit(1).cast("bigint").alias("conflict_hits")), qv, ["conflict_hits"], floor)
    df = queries.join(window, "qid", "left").join(everywhere, "qid", "left").join(related, "qid", "left")
    def zero(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    total = {f: zero(f"w_{f}") + zero(f) - zero(f"n_{f}") for f in GUARDS}
    return df.select(
        "qid", zero("hit_count").alias("hit_count"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), zero("fresh_hits").alias("fresh_hits"), total["due"].alias("review_due_hits"), total["stale"].alias("stale_hits"),
        zero("volatile_hits").alias("volatile_hits"), F.element_at(F.array(F.lit("stable"), F.lit("drifting"), F.lit("volatile")), (F.coalesce("_vol", F.lit(0)) + 1).cast("int")).alias("max_volatility"),
        total["low"].alias("low_confidence_hits"), zero("conflict_hits").alias("conflict_hits"),
    )


def with_mode(rows: DataFrame, time_budget: float | None = None) -> DataFrame:
    """Adds mode and rule. Needs the features, budget_ratio, elapsed and forced (NULL unless forced)."""
    guard = [
        (F.col("conflict_hits") > 0, "deep", "open_conflict"), (F.col("hit_count") == 0, "deep", "no_hits"), ((F.col("stale_hits") > 0) | (F.col("low_confidence_hits") > 0), "update", "stale_or_low"),
        ((F.col("review_due_hits") > 0) | (F.col("volatile_hits") > 0), "update", "due_or_volatile"), ((F.col("hit_count") >= MIN_HITS) & (F.col("top_score") >= MIN_SCORE), "simple", "covered"),
    ]
    mode, rule = F.lit("update"), F.lit("thin")
    for cond, m, r in reversed(guard):
        mode, rule = F.when(cond, m).otherwise(mode), F.when(cond, r).otherwise(rule)

    def one_down(m: Column) -> Column:
        # a guarded question is never routed below "update"
        return F.when(m == "deep", "update").otherwise(m)

    df = rows.withColumn("mode", mode).withColumn("rule", rule)
    df = df.withColumn("mode", F.when(F.col("budget_ratio") < BUDGET_FLOOR, one_down(F.col("mode"))).otherwise(F.col("mode")))
    if time_budget is not None:
        df = df.withColumn("mode", F.when(F.col("elapsed") > time_budget, one_down(F.col("mode"))).otherwise(F.col("mode")))
    return df.withColumn("mode", F.coalesce("forced", "mode"))


def limits(mode: Column, overrides: dict[str, Column] | None = None) -> dict[str, Column]:
    """Limit columns of a mode; an override is pulled into its bounds, and one that names no report style is not followed."""
    out = {}
    for i, name in enumerate(LIMIT_NAMES):
        base = F.lit(None).cast("int")
        for m, vals in LIMITS.items():
            base = F.when(mode == m, vals[i]).otherwise(base)
        o = (overrides or {}).get(name)
        lo, hi = BOUNDS[name]
        out[name] = base if o is None else F.when(o.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), o)).cast("int")).otherwise(base)
    style = F.lit(None).cast("string")
    for m, name in STYLES.items():
        style = F.when(mode == m, name).otherwise(style)
    wanted, helped = (overrides or {}).get("report_style"), (overrides or {}).get("subagents")
    out["subagents"] = mode.isin(*SUBAGENTS) if helped is None else F.coalesce(helped, mode.isin(*SUBAGENTS))
    out["report_style"] = style if wanted is None else F.when(wanted.isin(*STYLES.values()), wanted).otherwise(style)
    return out


def outcome(fresh: Column, required: Column) -> Column:
    return F.when(required <= 0, "not_required").when(fresh >= required, "met").otherwise("short")
