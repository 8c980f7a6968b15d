"""Hybrid retrieval for a table of queries against a table of notes: phrase/BM25, cosine, rank fusion.

Channel candidates are cut inside the scan: each task keeps at most ``pool`` rows per query, so what is
shuffled is (tasks x queries x pool) rows, never one row per (query, note).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kledger.functions import temporal as T
from kledger.functions import text as X
from kledger.functions import vectors as V
from kledger.operators.blocks import score_cosine, top_matches
from kledger.operators.phrases import passages
from kledger.session import written

RRF_K = 60
K1, B = 1.2, 0.75
MIN_COSINE = 1e-6
# Bounds of the phrases sent to every task: their number and their size together. Beyond them they are joined.
MAX_BROADCAST_PHRASES, MAX_BROADCAST_CHARS = 65_536, 4_000_000


def pool_size(k: int) -> int:
    return max(4 * k, 16)


def top_rows(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """Ranked rows, at most ``n`` per key. Catalyst turns this into a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


# ---- keyword channel -------------------------------------------------------------------------------

_HITS = "qid string, note_id string, tf bigint, doc_len bigint"


def _phrase_scan(notes: DataFrame, rows: list) -> DataFrame:
    """One pass over the texts with an Aho-Corasick automaton of all phrases: cost text + hits, not text x phrases."""
    import ahocorasick

    by_phrase: dict[str, list[str]] = {}
    for r in rows:
        by_phrase.setdefault(r["q"], []).append(r["qid"])
    machine = ahocorasick.Automaton()
    for p, ids in by_phrase.items():
        machine.add_word(p, ids)
    machine.make_automaton()
    shared = notes.sparkSession.sparkContext.broadcast(machine)

    def scan(batches):
        m = shared.value
        for pdf in batches:
            out: dict[tuple, int] = {}
            for nid, title, body in zip(pdf["note_id"], pdf["title"], pdf["body"], strict=True):
                size = max(len(title) - 2, 0) + max(len(body) - 2, 0)
                for part in (title, body):
                    for _, ids in m.iter(part):
                        for qid in ids:
                            key = (qid, nid, size)
                            out[key] = out.get(key, 0) + 1
            yield pd.DataFrame([(q, n, c, s) for (q, n, s), c in out.items()], columns=["qid", "note_id", "tf", "doc_len"])

    view = notes.select("note_id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("body", F.lit(""))).alias("body"))
    return view.mapInPandas(scan, _HITS)


def _phrase_join(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """Any number of phrases: the passages of the notes that are a phrase (see ``phrases``), joined to the queries."""
    title, body = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "body"))
    found = passages(notes, written(queries.select("q").distinct(), "phrases"), title, body)
    return found.join(queries, "q").select("qid", "note_id", "tf", "doc_len")


def phrase_hits(notes: DataFrame, queries: DataFrame, force_join: bool = False, min_chars: int = 3) -> DataFrame:
    """(qid, note_id, tf, doc_len) of every note that contains the whole query, ignoring case."""
    qs = queries.select("qid", F.lower(F.trim("q")).alias("q")).filter(F.length("q") >= min_chars)
    n, size = qs.agg(F.count("*"), F.coalesce(F.sum(F.length("q")), F.lit(0))).first()  # checked before anything is sent
    if force_join or n > MAX_BROADCAST_PHRASES or size > MAX_BROADCAST_CHARS:
        return _phrase_join(notes, qs)
    return _phrase_scan(notes, qs.collect())


def corpus_stats(notes: DataFrame) -> DataFrame:
    size = F.greatest(F.length("title") - 2, F.lit(0)) + F.greatest(F.length("body") - 2, F.lit(0))
    return notes.agg(F.count("*").alias("n_docs"), (F.sum(size).cast("double") / F.count("*")).alias("avg_len"))


def bm25(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds the BM25 score; a phrase found in more than half of the notes keeps a tiny positive weight."""
    df = hits.groupBy("qid").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    norm = F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_len"))
    score = F.round(idf * F.col("tf") * F.lit(K1 + 1) / norm, 9)
    stats = corpus_stats(notes)  # exactly one row
    return hits.join(df, "qid").join(F.broadcast(stats), F.lit(True)).withColumn("score", score).drop("df", "n_docs", "avg_len")


def keyword_channel(notes: DataFrame, queries: DataFrame, pool: int, force_join: bool = False) -> DataFrame:
    """Phrase hits ranked by BM25; queries under three characters fall back to a substring match in id order."""
    qs = queries.select("qid", F.lower(F.trim("q")).alias("q")).filter("length(q) > 0")
    # equal phrases have equal hits: they are looked for and ranked once
    hits = written(phrase_hits(notes, qs.select(F.col("q").alias("qid"), "q").distinct(), force_join), "phrase-hits")
    ranked = top_rows(bm25(hits, notes), ["qid"], [F.desc("score"), "note_id"], pool).select(F.col("qid").alias("q"), "note_id", "score", "rank")
    return ranked.join(qs, "q").select("qid", "note_id", "score", "rank").unionByName(short_channel(notes, queries, pool))


def short_channel(notes: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """One- and two-character queries: an equi join on the distinct short grams of each note."""
    qs = queries.select("qid", F.lower(F.trim("q")).alias("gram")).filter("length(gram) IN (1, 2)")
    wanted = written(qs.select("gram").distinct(), "short-grams")  # its size is known: the grams of the notes are filtered where they lie
    t, b = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("body", F.lit("")))
    grams = notes.select("note_id", F.explode(F.array_distinct(F.concat(X.chars(t), X.chars(b), X.ngrams(t, 2), X.ngrams(b, 2)))).alias("gram"))
    best = top_rows(grams.join(wanted, "gram", "left_semi"), ["gram"], ["note_id"], pool)
    return best.join(qs, "gram").select("qid", "note_id", F.lit(0.0).alias("score"), "rank")


# ---- vector channel --------------------------------------------------------------------------------


def vector_channel(note_vectors: DataFrame, query_vectors: DataFrame, pool: int, floor: float | None = None, by_id: bool = False, force_grid: bool = False) -> DataFrame:
    """Exact cosine top ``pool`` per query: (qid, note_id, score, rank). Inputs are (note_id, v) and (qid, v).

    Without a ``floor`` the cosine must exceed the orthogonality bound. With ``by_id`` the first ``pool`` ids
    at or above the floor are kept instead of the best scores.
    """
    low = float(np.nextafter(MIN_COSINE, 1)) if floor is None else floor
    items = note_vectors.select(F.col("note_id").alias("item_id"), "v")
    return top_matches(items, query_vectors.select("qid", "v"), score_cosine, pool, low, by_id, force_grid).withColumnRenamed("item_id", "note_id")


def vectorize(df: DataFrame, key: str, text, encoder=None) -> DataFrame:
    """(key, v) with the hash vector of ``text``; blank texts have no vector."""
    enc = encoder or V.encoder()
    return df.select(key, text.alias("_t")).filter("length(_t) > 0").select(key, enc(F.col("_t")).alias("v"))


def note_vectors(notes: DataFrame, encoder=None) -> DataFrame:
    return vectorize(notes, "note_id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), encoder)


# ---- fusion and ranking ----------------------------------------------------------------------------


def _targets(hit: DataFrame, keys: list[str], *same: Column) -> DataFrame:
    """Resolved candidates -> targets ranked per ``keys``. ``same`` aggregates what is equal for all rows of a target."""
    best = hit.groupBy(*keys, "canonical_id").agg(
        F.min("rank").alias("best"),
        F.max(F.col("first_alias").isNull()).alias("direct"),
        F.min_by("first_alias", F.when(F.col("first_alias").isNotNull(), F.col("rank"))).alias("alias"),
        *same,
    )
    w = Window.partitionBy(*keys).orderBy("best")  # at most ``pool`` rows per query
    return best.withColumn("rank", F.row_number().over(w)).drop("best")


def _live(chains: DataFrame) -> DataFrame:
    return chains.filter("outcome = 'active'").select("note_id", "canonical_id", "first_alias")


def resolve_ranks(channel: DataFrame, chains: DataFrame) -> DataFrame:
    """Candidates -> active targets. A target keeps its best rank, and targets are ranked again without gaps."""
    return _targets(channel.join(_live(chains), "note_id"), ["qid"])


def _fused(union: DataFrame, k: int, *same: Column) -> DataFrame:
    fts, vec = (F.max(F.col("channel") == n) for n in ("fts", "vector"))
    return union.groupBy("qid", "canonical_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"),
        F.when(fts & vec, "both").when(fts, "fts").otherwise("vector").alias("match_type"),
        F.max("direct").alias("direct"),
        # the keyword channel is looked at first, as its aliases were seen first
        F.min_by("alias", F.when(F.col("alias").isNotNull(), F.struct(F.when(F.col("channel") == "fts", 0).otherwise(1), "rank"))).alias("alias"),
        *same,
    )


def rrf(channels: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion over (qid, canonical_id, rank, direct, alias) channels."""
    parts = [c.withColumn("channel", F.lit(n)) for n, c in channels.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return _fused(union, k)


def _numbered(queries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The distinct query texts under a number, and (qid, number) of every query; queries that share a qid stay as they are, without the second."""
    asked = queries.select("qid", F.trim("q").alias("q")).filter("length(q) > 0")
    if not asked.groupBy("qid").count().filter("count > 1").isEmpty():
        return asked, None
    once = written(asked.select("q").distinct().select(F.monotonically_increasing_id().cast("string").alias("qid"), "q"), "search-texts")
    return once, asked.join(once.withColumnRenamed("qid", "_once"), "q").select("qid", "_once")


def hybrid_search(
    queries: DataFrame, notes: DataFrame, chains: DataFrame, now: str, k: int = 5, kind: str | None = None,
    include_tombstones: bool = False, vectors: DataFrame | None = None,
) -> DataFrame:
    """Ranked matches of every query: (qid, rank, note_id, title, score, match_type, redirected_from)."""
    pool = pool_size(k)
    once, asked = _numbered(queries)
    fts = keyword_channel(notes, once, pool).select("qid", "note_id", "rank", F.lit("fts").alias("channel"))
    vec = vector_channel(vectors if vectors is not None else note_vectors(notes), vectorize(once, "qid", F.col("q")), pool).select("qid", "note_id", "rank", F.lit("vector").alias("channel"))
    cards = written(_cards(notes, now, kind, include_tombstones), "search-cards")
    # what the score needs of a target travels with its candidates, so they are shuffled twice: to the notes and to the queries
    factors = F.transform("cards", lambda c, i: F.struct(c["confidence"].alias("confidence"), c["decay"].alias("decay"), c["importance"].alias("importance"), i.alias("place")))
    to = _live(chains).join(cards.select(F.col("note_id").alias("canonical_id"), factors.alias("factors")), "canonical_id", "left")
    hit = fts.unionByName(vec).join(to, "note_id").drop("note_id").repartition("qid")
    same = F.first("factors").alias("factors")
    fused = _fused(_targets(hit, ["qid", "channel"], same), RRF_K, same).withColumn("card", F.explode("factors")).drop("factors")
    score = F.col("fused") * F.col("card.confidence") * F.col("card.decay") * F.col("card.importance")
    ranked = top_rows(fused.withColumn("score", F.round(score, 9)), ["qid"], [F.desc("score"), "canonical_id"], k)
    if asked is not None:
        ranked = ranked.withColumnRenamed("qid", "_once").join(asked, "_once")
    out = ranked.withColumnRenamed("canonical_id", "note_id").join(cards, "note_id")
    return out.select(
        "qid", "rank", "note_id", F.col("cards")[F.col("card.place")]["title"].alias("title"), "score", "match_type",
        F.when(~F.col("direct"), F.col("alias")).alias("redirected_from"),
    )


def _cards(notes: DataFrame, now: str, kind: str | None, include_tombstones: bool) -> DataFrame:
    """(note_id, cards): title and score factors of the notes that may be shown; one card per row of a note id."""
    if not include_tombstones:
        notes = notes.filter(~F.coalesce("tombstone", F.lit(False)))
    if kind is not None:
        notes = notes.filter(F.coalesce("kind", F.lit("knowledge")) == kind)
    age = T.age_days(T.now_lit(now), T.base_time(F.col("observed_at"), F.col("created")))
    card = F.struct(
        T.confidence_factor(F.col("confidence")).alias("confidence"), T.decay(age, T.half_life(F.col("volatility"))).alias("decay"),
        T.importance_factor(F.col("importance")).alias("importance"), "title",
    )
    return notes.filter("note_id IS NOT NULL").select("note_id", card.alias("card")).groupBy("note_id").agg(F.collect_list("card").alias("cards"))
