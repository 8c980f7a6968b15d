"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. The counts of all vote patterns (at most
3 ** labellers) feed an expectation-maximisation that estimates each labeller's accuracy and the share of good
documents; its posterior labels a bounded sample (``SAMPLE`` documents of up to ``SAMPLE_BYTES`` bytes, in the order
of a hash of the id), on which a linear scorer over hashed byte trigrams is trained. All documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import Words, slices, text_bytes, written
from kledger.llm.likelihood import BUCKETS, CHUNK, _inside, base_statistics, trigram_buckets

SAMPLE, SAMPLE_BYTES, ROUNDS, SCALE, FALSE_ALARM = 1500, 8192, 200, 20.0, 0.005
VOTES = ["length", "symbols", "capitals", "repeats", "lone", "width", "lines"]


def votes(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """-1 (bad), 0 (no vote) or 1 (good) by text and labeller."""
    docs = len(offs) - 1
    stats, words = base_statistics(raw, offs), Words(raw, offs)
    n = np.maximum(1, stats["n_words"])

    def total(mask: np.ndarray) -> np.ndarray:
        s = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=s[1:])
        return s[offs[1:]] - s[offs[:-1]]

    capital, small = total((raw >= 65) & (raw <= 90)), total((raw >= 97) & (raw <= 122))
    lone = words.end - words.start == 1
    lone &= ~np.isin(raw[words.start], np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)) if len(words.start) else lone
    lone = np.bincount(words.doc[lone], minlength=docs)
    lines = np.maximum(1, total(raw == 10) + 1)

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    some = stats["n_words"] > 0
    share = capital / np.maximum(1, capital + small)
    out = [
        vote(stats["n_words"] < 20, stats["n_words"] >= 60),
        vote(stats["n_symbols"] > 0.1 * n, (stats["n_symbols"] == 0) & some),
        vote(share > 0.4, (share < 0.2) & some),
        vote(stats["n_repeat_words"] > 0.4 * n, (stats["n_repeat_words"] < 0.1 * n) & some),
        vote(lone > 0.08 * n, (lone < 0.01 * n) & some),
        vote((stats["word_chars"] > 9 * n) | ~some, (stats["word_chars"] < 7 * n) & some),
        vote(stats["n_dup_lines"] > 0.3 * lines, (stats["n_dup_lines"] == 0) & some),
    ]
    return np.stack(out, 1).astype(np.int8)


def estimate(patterns: np.ndarray, counts: np.ndarray, false_alarm: float = FALSE_ALARM, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, vote rates, share of good) by expectation-maximisation.

    ``rates[c, j, v]`` is how often labeller j votes v - 1 on documents of class c (0 bad, 1 good): its accuracy
    on bad documents is ``rates[0, :, 0]``, on good ones ``rates[1, :, 2]``. The labellers look for unlike faults, so a
    bad vote is held to be wrong on at most ``false_alarm`` of the good documents; else the estimate
    may take one fault for the bad class and the others for good ones.
    """
    m = patterns.shape[1]
    cast = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    rates = np.tile(np.array([[[0.35, 0.3, 0.35]], [[0.03, 0.27, 0.7]]]), (1, m, 1))
    share = 0.8
    post = np.full(len(patterns), share)
    for _ in range(rounds):
        bad, good = (np.einsum("pjv,jv->p", cast, np.log(rates[c])) for c in (0, 1))
        post = 1 / (1 + np.exp(np.clip(bad + np.log(1 - share) - good - np.log(share), -500, 500)))
        for c, w in ((0, counts * (1 - post)), (1, counts * post)):
            rates[c] = (np.einsum("p,pjv->jv", w, cast) + 1) / (w.sum() + 3)
        wrong = np.minimum(rates[1, :, :1], false_alarm)
        rates[1, :, 1:] *= (1 - wrong) / rates[1, :, 1:].sum(1, keepdims=True)
        rates[1, :, :1] = wrong
        share = float(np.clip((counts * post).sum() / max(1, counts.sum()), 0.02, 0.98))
    return post, rates, share


def train(texts: list[bytes], target: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer over shares of hashed trigrams, for soft targets."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not texts:
        return w, bias
    rows, codes, values = [], [], []
    for i, t in enumerate(texts):
        code, n = np.unique(trigram_buckets(np.frombuffer(t, np.uint8)), return_counts=True)
        rows.append(np.full(len(code), i, np.int32))
        codes.append(code.astype(np.int32))
        values.append((SCALE * n / max(1, n.sum())).astype(np.float32))
    r, c, v = np.concatenate(rows), np.concatenate(codes), np.concatenate(values)
    s, s0 = np.full(BUCKETS, 1e-10), 1e-10
    for _ in range(rounds):
        z = np.bincount(r, weights=v * w[c], minlength=len(texts)) + bias
        d = (target - 1 / (1 + np.exp(-z))) / len(texts)
        g = np.bincount(c, weights=v * d[r], minlength=BUCKETS) - 1e-7 * w
        s, s0 = s + g * g, s0 + d.sum() ** 2
        w, bias = w + 0.5 * g / np.sqrt(s), bias + 0.1 * d.sum() / np.sqrt(s0)
    return w, float(bias)


def _votes_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 3 ** np.arange(len(VOTES))
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            for lo, hi in slices(offs, CHUNK):
                code = (votes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) + 1) @ power
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(code.astype(np.int32))], ["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, pattern int")


def classify(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, pattern, weak_label, score, kept)`` for every row; ``kept`` where the score is at least 0.5.

    ``pattern`` numbers the votes in base 3. Null and empty texts have no trigram and score by the bias and by their
    votes alone: they are not kept. Equal texts get equal scores; an empty table gives no row; further columns are not read.
    """
    cast = written(_votes_of(docs), "weak-votes")
    counts = {r.pattern: r.n for r in cast.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3 ** 7 rows
    codes = np.array(sorted(counts), np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(VOTES)) % 3 - 1
    post, _, _ = estimate(patterns, np.array([counts[c] for c in codes.tolist()], float))
    weak = dict(zip(codes.tolist(), post.tolist(), strict=True))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text").between(3, sample_bytes))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample).select("text").collect()  # bounded
    texts = [r.text.encode() for r in picked]
    power = 3 ** np.arange(len(VOTES))
    offs = np.cumsum([0, *map(len, texts)])
    own = (votes(np.frombuffer(b"".join(texts), np.uint8), offs) + 1) @ power if texts else np.zeros(0, np.int64)
    w, bias = train(texts, np.array([weak[c] for c in own.tolist()]))
    sent = docs.sparkSession.sparkContext.broadcast((w * SCALE, bias, weak))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, b0, label = sent.value
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            for lo, hi in slices(offs, CHUNK):
                part, o = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                code = trigram_buckets(part)
                ok = _inside(o, len(code))
                s, m = np.zeros(len(part) + 1), np.zeros(len(part) + 1, np.int64)
                s[1 : len(code) + 1], m[1 : len(code) + 1] = np.where(ok, weight[code], 0), ok
                s, m = np.cumsum(s), np.cumsum(m)
                n = m[o[1:]] - m[o[:-1]]
                score = 1 / (1 + np.exp(-np.clip((s[o[1:]] - s[o[:-1]]) / np.maximum(1, n) + b0, -500, 500)))
                pattern = (votes(part, o) + 1) @ power
                soft = np.array([label.get(p, 0.5) for p in pattern.tolist()])
                score = np.round(np.where(n > 0, score, np.minimum(soft, 0.49)), 9)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(pattern.astype(np.int32)), pa.array(soft), pa.array(score), pa.array(score >= 0.5)], ["doc_id", "pattern", "weak_label", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, pattern int, weak_label double, score double, kept boolean")
