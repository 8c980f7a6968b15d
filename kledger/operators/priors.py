"""From ranked matches to prompt context: note facts, character budget, numbered blocks, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.operators.retrieval import phrase_hits, top_rows, vector_channel, vectorize

BODY_CHARS = 600
MIN_BODY_CHARS = 80
BUDGET = 4000
PROMPT_HEAD = "Answer only from the numbered material below and cite it as [n]. Say so when it does not cover the question."
HEADER = "## Earlier notes, for checking only\n\n"


def prior_hits(matches: DataFrame, notes: DataFrame, chains: DataFrame) -> DataFrame:
    """Matches with what is shown of a note: body of at most 600 characters, base date, URLs, alias chain."""
    facts = notes.select("note_id", "body", "confidence", "volatility", F.coalesce("observed_at", "created").alias("observed_at"), F.col("sources.url").alias("urls"))
    paths = chains.filter("path IS NOT NULL").select(F.col("note_id").alias("redirected_from"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("aliases"))
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    return (
        matches.join(facts, "note_id")
        .join(paths, "redirected_from", "left")
        .withColumn("body", F.when(F.length(body) > BODY_CHARS, F.concat(F.substring(body, 1, BODY_CHARS), F.lit("…"))).otherwise(body))
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    )


def block(pos: Column, h) -> Column:
    """One numbered block. ``h`` is a struct of the facts of a hit."""
    return F.concat(
        F.lit("### [P-"), pos.cast("string"), F.lit("] "), h["note_id"], F.lit(" "), h["title"],
        F.lit("\n- confidence: "), h["confidence"], F.lit("\n- volatility: "), h["volatility"], F.lit("\n- observed_at: "), F.coalesce(h["observed_at"], F.lit("-")),
        F.lit("\n- sources: "), F.when(F.size(h["urls"]) > 0, F.array_join(h["urls"], ", ")).otherwise("-"),
        F.when(F.size(h["aliases"]) > 0, F.concat(F.lit("\n- redirected_from: "), F.array_join(h["aliases"], ", "))).otherwise(""),
        F.lit("\n"), h["body"], F.lit("\n\n"),
    )


def fit_budget(hits: Column, budget: int = BUDGET, header: int = len(HEADER)) -> Column:
    """Rank-ordered hits -> kept (note_id, text) blocks within ``budget`` characters.

    A block that does not fit is shortened (first to the room left, then to half of it, never under 80
    characters of body); if that fails, packing stops. The fold runs over the at most k hits of one query.
    """
    start = F.struct(
        F.array().cast("array<struct<note_id:string,text:string>>").alias("kept"), F.lit(budget - header).alias("room"), F.lit(False).alias("stop")
    )

    def step(acc, h):
        pos = F.size(acc["kept"]) + 1
        full = block(pos, h)
        bare = F.length(full) - F.length(h["body"])

        def shortened(cap):
            usable = (cap >= MIN_BODY_CHARS) & (cap < F.length(h["body"])) & (bare + cap + 1 <= acc["room"])
            cut = h.withField("body", F.concat(F.substr(h["body"], F.lit(1), F.greatest(cap, F.lit(0))), F.lit("…")))
            return F.when(usable, block(pos, cut))

        left = acc["room"] - bare
        text = F.when(F.length(full) <= acc["room"], full).otherwise(F.coalesce(shortened(left - 8), shortened(F.floor(left / 2).cast("int"))))
        take = ~acc["stop"] & text.isNotNull()
        return F.struct(
            F.when(take, F.concat(acc["kept"], F.array(F.struct(h["note_id"].alias("note_id"), text.alias("text"))))).otherwise(acc["kept"]).alias("kept"),
            F.when(take, acc["room"] - F.length(text)).otherwise(acc["room"]).cast("int").alias("room"),
            (acc["stop"] | text.isNull()).alias("stop"),
        )

    return F.aggregate(hits, start, step, lambda a: a["kept"])


def prior_context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per query: number of kept hits, their ids, and the text. Gathers at most k hits per query."""
    h = F.struct("rank", "note_id", "title", "body", "confidence", "volatility", "observed_at", "urls", "aliases")
    kept = hits.groupBy("qid").agg(F.sort_array(F.collect_list(h)).alias("hs")).select("qid", fit_budget(F.col("hs"), budget).alias("kept"))
    return kept.select(
        "qid", F.size("kept").alias("n_hits"), F.array_join("kept.note_id", ",").alias("note_ids"),
        F.when(F.size("kept") > 0, F.concat(F.lit(HEADER), F.array_join("kept.text", ""))).otherwise("").alias("context"),
    )


def rag_prompt(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Numbered material followed by the question. ``hits`` has (qid, rank, url, title, snippet)."""
    g = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "url", "title", "snippet"))).alias("hs"))
    blocks = F.transform("hs", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["url"], F.lit("\n"), h["title"], F.lit("\n"), h["snippet"], F.lit("\n\n")))
    material = F.coalesce(F.array_join(blocks, ""), F.lit("(no material)\n\n"))
    return queries.join(g, "qid", "left").select("qid", F.concat(F.lit(PROMPT_HEAD + "\n\n"), material, F.lit("Question: "), F.col("q")).alias("prompt"))


def unanswered_guards(queries: DataFrame, ledger: DataFrame, floor: float = 0.4, top: int = 2) -> DataFrame:
    """The ``top`` open ledger questions at least ``floor`` similar to each query."""
    lv = vectorize(ledger, "note_id", F.col("question"))
    qv = vectorize(queries, "qid", F.col("q"))
    hits = vector_channel(lv, qv, top, floor=floor)
    return hits.join(ledger, "note_id").select("qid", "rank", "note_id", "question", "asked_date", "reason", "score")


def conflict_guards(queries: DataFrame, conflicts: DataFrame, floor: float = 0.3, top: int = 3) -> DataFrame:
    """The first ``top`` open conflicts whose entity is named in the query or whose notes resemble it.

    ``conflicts``: (conflict_id, entity, text_a, text_b, ...), open ones only.
    """
    slugs = queries.select(F.col("qid").alias("note_id"), F.lit("").alias("title"), X.slugify(F.col("q")).alias("body"))
    slugged = conflicts.select("conflict_id", X.slugify(F.col("entity")).alias("slug"))
    first = top_rows(slugged, ["slug"], ["conflict_id"], top, "_r").drop("_r")  # later ones of a slug can never be among the first
    patterns = first.select(F.col("slug").alias("qid"), F.col("slug").alias("q")).distinct()
    named = phrase_hits(slugs, patterns, min_chars=1).select(F.col("note_id").alias("qid"), F.col("qid").alias("slug"))
    named = named.join(first, "slug").select("qid", "conflict_id").distinct()
    qv = vectorize(queries, "qid", F.col("q"))
    sides = [vectorize(conflicts, "conflict_id", F.col(c)) for c in ("text_a", "text_b")]
    tables = [s.select(F.col("conflict_id").alias("note_id"), "v") for s in sides]
    alike = [vector_channel(t, qv, top, floor=floor, by_id=True).select("qid", F.col("note_id").alias("conflict_id")) for t in tables]
    both = named.unionByName(alike[0]).unionByName(alike[1]).distinct()
    return top_rows(both, ["qid"], ["conflict_id"], top).join(conflicts.drop("text_a", "text_b"), "conflict_id")
