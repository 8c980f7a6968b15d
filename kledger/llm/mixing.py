"""Soft-membership mixing in DataFrame expressions: how often each document should be used so that domains meet targets.

Domains are the classes of the labelled table. A classifier fitted on at most ``LABELLED`` labelled documents (in
the order of a hash of the id) gives every document a posterior over domains: naive Bayes over a short lexicon of
the most telling words (present or absent) and over binned surface shares. Nonnegative rates, one per document, then minimise
the squared distance of the expected token totals of all domains to their targets, by projected gradient steps;
each step is one aggregate over all documents that returns one number per domain.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import discard, written

LABELLED, LEXICON, SUPPORT, TELLING, DOMAINS = 20_000, 200, 10, 0.3, 16
STEPS, CLOSE = 40, 1e-6
TARGETS = {"plain": 0.97, "junk": 0.02, "toxic": 0.01}
ANCHOR = "plain"
SYMBOLS = "#*$%&|<>!"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)``: junk where quality is 0, else toxic where toxic is 1, else plain; the first by name of repeats."""
    kind = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "plain")
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), kind.alias("domain")).filter("doc_id is not null and domain is not null")
    return rows.groupBy("doc_id").agg(F.min("domain").alias("domain"))


def _share(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))) / F.greatest(F.length(text), F.lit(1))


def _bin(name: str, share: Column) -> Column:
    """A token for the share's place on a square-root scale of 0 to 9."""
    return F.concat(F.lit(f"{name}:"), F.least(F.lit(9), F.floor(10 * F.sqrt(share))).cast("string"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _bins(text: Column, words: Column) -> Column:
    fresh = F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(F.lit(0.0))
    return F.array(_bin(":symbols", _share(text, SYMBOLS)), _bin(":capitals", _share(text, CAPITALS)), _bin(":fresh", fresh))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, lexicon: int = LEXICON) -> tuple[list[str], list[str], dict[str, list[float]], list[float]]:
    """(domains, lexicon, log likelihoods by token, log priors) from at most ``bound`` labelled documents."""
    known = domains(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    known = written(known, "mix-labelled")  # bounded, so it may be broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id")
    seen = written(rows.select("domain", F.array_distinct(_words(F.col("text"))).alias("words"), _bins(F.col("text"), _words(F.col("text"))).alias("bins")), "mix-words")
    size = {r.domain: r.n for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(size)[:DOMAINS]
    total = sum(size.values())
    counts = [F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(names)]
    per_word = seen.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *counts).filter(F.col("n") >= SUPPORT)
    # how far a domain's share of the word's documents is from its share of all; long-standing words first
    apart = [F.abs(F.col(f"c{i}") / F.col("n") - size[d] / total) for i, d in enumerate(names)]
    per_word = per_word.withColumn("apart", F.greatest(*apart, F.lit(0.0)) if names else F.lit(0.0)).filter(F.col("apart") >= TELLING)
    best = per_word.orderBy(F.desc(F.col("apart") * F.sqrt("n")), "word").limit(lexicon).select("word").collect() if names else []
    words = [r.word for r in best]
    tokens = seen.select("domain", F.explode(F.concat("bins", F.array_intersect("words", _literal(words)))).alias("token"))
    found = tokens.groupBy("token").agg(*counts).collect() if names else []  # at most lexicon + 30 rows
    rate = {r.token: [(r[f"c{i}"] + 0.5) / (size[d] + 1.0) for i, d in enumerate(names)] for r in found}
    prior = [math.log(size[d] / total) + sum(math.log(1 - rate[w][i]) for w in words if w in rate) for i, d in enumerate(names)]
    # a word counts by its presence against its absence, a bin by its own rate
    like = {t: [math.log(x) - (0 if t[0] == ":" else math.log(1 - x)) for x in r] for t, r in rate.items()}
    discard(known, seen)
    return names, words, like, prior


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def posteriors(docs: DataFrame, model: tuple) -> DataFrame:
    """``docs`` as ``(record, n_tokens, post)``: all columns, the word count, and the posterior by domain."""
    names, lexicon, like, prior = model
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), text.alias("text"), _words(text).alias("words"))
    zero = F.array(*[F.lit(0.0)] * len(names))
    table = F.create_map(*[x for t in sorted(like) for x in (F.lit(t), F.array(*[F.lit(v) for v in like[t]]))])
    tokens = F.concat(_bins(F.col("text"), F.col("words")), F.array_intersect("words", _literal(lexicon)))
    logit = F.aggregate(tokens, F.array(*[F.lit(p) for p in prior]), lambda acc, t: F.zip_with(acc, F.coalesce(F.try_element_at(table, t), zero), lambda a, b: a + b))
    rows = rows.select("record", F.size("words").cast("bigint").alias("n_tokens"), logit.alias("logit"))
    weight = F.transform("logit", lambda x: F.exp(x - F.array_max("logit")))
    return rows.withColumn("weight", weight).select("record", "n_tokens", F.transform("weight", lambda x: x / F.aggregate("weight", F.lit(0.0), lambda a, b: a + b)).alias("post"))


def _rate(steps: list[list[float]]) -> Column:
    """The rate after projected steps from 1: each subtracts its weights times the posterior and stops at 0."""
    if not steps:
        return F.lit(1.0)
    past = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    return F.aggregate(past, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(s, F.col("post"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))


def fit_rates(rows: DataFrame, names: list[str], targets: dict[str, float], anchor: str | None) -> tuple[list[list[float]], dict[str, float]]:
    """Steps of the projected gradient over ``rows`` (n_tokens, post), and the targeted token totals.

    Domains are weighed by the inverse of their curvature, so small ones converge as fast as large ones. With an ``anchor`` the overall size is such that this domain keeps its tokens, else it is that of the input.
    """
    k = len(names)
    tokens, p = F.col("n_tokens"), [F.get("post", F.lit(i)) for i in range(k)]
    sums = rows.agg(*[F.coalesce(F.sum(tokens * p[i]), F.lit(0.0)) for i in range(k)], *[F.coalesce(F.sum(tokens * p[i] * p[j]), F.lit(0.0)) for i in range(k) for j in range(k)]).first()
    mass, curve = np.array(sums[:k], float), np.array(sums[k:], float).reshape(k, k)
    share = np.array([targets.get(d, 0.0) for d in names])
    if not mass.sum() or not share.sum():
        return [], {d: float(m) for d, m in zip(names, mass, strict=True)}
    share = share / share.sum()
    whole = mass.sum()
    if anchor in names and share[names.index(anchor)] > 0:
        whole = mass[names.index(anchor)] / share[names.index(anchor)]
    want = whole * share
    full = np.maximum(np.diag(curve), 1e-9)
    steps: list[list[float]] = []
    now = mass
    for _ in range(STEPS):
        if np.abs(now - want).max() <= CLOSE * whole:
            break
        # the distance counts each domain by the inverse of its curvature over documents that can still move
        scale = 1 / np.maximum(np.diag(curve), 0.05 * full)
        step = 1 / max(np.abs(np.linalg.eigvals(curve * scale[None, :])).max(), 1e-9)
        steps.append([float(x) for x in step * scale * (now - want)])
        rated = rows.select("n_tokens", "post", _rate(steps).alias("rate"))
        moving = tokens * F.when(F.col("rate") > 0, 1.0).otherwise(0.0)
        sums = rated.agg(*[F.sum(F.col("rate") * tokens * p[i]) for i in range(k)], *[F.sum(moving * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
        now, curve = np.array(sums[:k], float), np.array(sums[k:], float).reshape(k, k)
    return steps, {d: float(w) for d, w in zip(names, want, strict=True)}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str | None = ANCHOR, bound: int = LABELLED) -> DataFrame:
    """``(record, n_tokens, domain, posterior, rate, copies)`` for every row of ``docs``.

    ``rate`` is the expected number of uses; ``copies`` is its rounding up or down by a hash of the id, which
    is right on average. Null and empty texts have no tokens and a posterior from their bins. Repeated rows get equal
    rates. Without labels, or without any token, every rate is 1. An empty table gives no row.
    """
    model = fit(docs, labels, bound)
    names = model[0]
    if not names:
        out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.size(_words(F.coalesce(F.col("text").cast("string"), F.lit("")))).cast("bigint").alias("n_tokens"))
        return out.select("record", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    rows = written(posteriors(docs, model), "mix-posteriors")
    steps, _ = fit_rates(rows.select("n_tokens", "post"), names, targets or TARGETS, anchor)
    top = F.array_position("post", F.array_max("post")).cast("int")
    rated = rows.select("record", "n_tokens", F.element_at(_literal(names), top).alias("domain"), F.array_max("post").alias("posterior"), _rate(steps).alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("record.doc_id")), F.lit(1 << 32)) / float(1 << 32)
    return rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))
