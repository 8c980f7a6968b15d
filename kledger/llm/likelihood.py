"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text, with a fixed threshold.

Two multinomials over hashed byte trigrams are counted: one on all trusted documents, one on all documents. A
document's score is the mean log ratio of its trigrams. The threshold is the ``LOST`` quantile of the trusted documents' scores, read from counts on a fixed
grid, so every document's verdict is a function of the table alone. Plain rules come first: too few words, or too
many words in repeated three-word windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kledger.llm.common import Hashes, Words, slices, text_bytes, windows, written

BUCKETS = 1 << 16
TRUSTED = 100_000
"""Up to this many trusted ids travel to the tasks; more of them are joined to the documents by a shuffle."""
LOST = 0.001
GRID = 1000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CHUNK = 1 << 20


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte (two fewer than bytes)."""
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    r = raw.astype(np.uint32)
    code = (r[:-2] << np.uint32(16)) | (r[1:-1] << np.uint32(8)) | r[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _inside(offs: np.ndarray, n: int) -> np.ndarray:
    """True for trigrams that do not cross from one text to the next."""
    ok = np.ones(max(0, n), bool)
    for back in (1, 2):
        at = offs[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def base_statistics(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    docs = len(offs) - 1
    words = Words(raw, offs)

    def total(mask: np.ndarray) -> np.ndarray:
        s = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=s[1:])
        return s[offs[1:]] - s[offs[:-1]]

    out = {"n_words": words.count, "word_chars": total(words.inside & ((raw & 0xC0) != 0x80)), "n_symbols": total(SYMBOLS[raw])}
    # lines: cut after each \n and at the texts' bounds
    cuts = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, offs[offs < len(raw)]]))
    ends = np.append(cuts[1:], len(raw))
    stop = np.where((ends > cuts) & (raw[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(raw) else ends
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, cuts)
    a, b = cuts[has], stop[has]
    doc = np.searchsorted(offs, a, side="right") - 1
    seen = np.unique(np.stack([doc.astype(np.uint64), Hashes(raw).spans(a, b) if len(raw) else np.zeros(0, np.uint64)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
    out["n_dup_lines"] = np.bincount(doc, minlength=docs) - np.bincount(seen[0].astype(np.int64), minlength=docs)
    at, key = windows(words, 3)
    order = np.lexsort((key, words.doc[at]))
    k, d = key[order], words.doc[at][order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.hash), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    out["n_repeat_words"] = np.bincount(words.doc[covered], minlength=docs)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of every trusted row (quality 1, toxic not 1), once."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()


def mark_trusted(rows: DataFrame, marks: DataFrame, bound: int | None = None) -> DataFrame:
    """``rows`` with ``trusted``: whether ``marks`` (written ids, each once) holds the row's ``doc_id``."""
    few = marks.count() <= (TRUSTED if bound is None else bound)  # checked before anything is sent
    marks = marks.withColumn("trusted", F.lit(True))
    return rows.join(F.broadcast(marks) if few else marks.hint("merge"), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def score_documents(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, trusted, score)`` for every row.

    A text of fewer than three bytes, or null, scores 0. Without trusted documents every score is 0.
    """
    marks = written(trusted_ids(labels), "llr-trusted")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            raw, offs = text_bytes(b.column(0))
            mark = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in slices(offs, CHUNK):
                part, o = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                code = trigram_buckets(part)
                ok = _inside(o, len(code))
                every += np.bincount(code[ok], minlength=BUCKETS)
                ok &= np.repeat(mark[lo:hi], np.diff(o))[: len(code)]
                good += np.bincount(code[ok], minlength=BUCKETS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(every[at]), pa.array(good[at])], ["bucket", "n", "good"])

    # texts meet their marks only here; the scores below are marked when they are plain numbers
    counts = mark_trusted(rows, marks).select("text", "trusted").mapInArrow(count, "bucket int, n bigint, good bigint").groupBy("bucket").agg(F.sum("n"), F.sum("good")).collect()  # at most BUCKETS rows
    n, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in counts:
        n[bucket], good[bucket] = a, b
    ratio = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((n + 1) / (n.sum() + BUCKETS)) if good.sum() else np.zeros(BUCKETS)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            for lo, hi in slices(offs, CHUNK):
                part, o = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                code = trigram_buckets(part)
                ok = _inside(o, len(code))
                s, m = np.zeros(len(part) + 1), np.zeros(len(part) + 1, np.int64)
                s[1 : len(code) + 1] = np.where(ok, sent.value[code], 0)
                m[1 : len(code) + 1] = ok
                s, m = np.cumsum(s), np.cumsum(m)
                mean = (s[o[1:]] - s[o[:-1]]) / np.maximum(1, m[o[1:]] - m[o[:-1]])
                base = base_statistics(part, o)
                own = [b.column(0).slice(lo, hi - lo), *[pa.array(base[k].astype(np.int64)) for k in names], pa.array(np.round(mean, 9))]
                yield pa.RecordBatch.from_arrays(own, ["doc_id", *names, "score"])

    scored = rows.mapInArrow(score, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, score double")
    return mark_trusted(scored, marks)


def threshold(scored: DataFrame, lost: float = LOST) -> float:
    """The grid point below which at most ``lost`` of the trusted documents that pass the plain rules score."""
    cell = F.floor(F.col("score") * GRID).cast("bigint")
    seen = scored.filter(F.col("trusted") & ~F.col("base_failed")).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    # log ratios of smoothed shares lie within +-64, so there are at most 128 * GRID cells
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = seen.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    first = below.filter(F.col("upto") > F.col("all") * lost).agg(F.min("cell")).first()[0]
    return float("-inf") if first is None else first / GRID


def quality_rules(docs: DataFrame, labels: DataFrame, lost: float = LOST) -> DataFrame:
    """Every document with its statistics, ``base_failed``, ``score`` and ``kept``.

    Null and empty texts have no words and fail the plain rules; equal rows get equal verdicts; an empty table
    gives no row; further columns are not read. Labels may be empty: then only the plain rules decide.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = written(score_documents(docs, labels).withColumn("base_failed", failed), "llr-scores")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold(scored, lost))))
