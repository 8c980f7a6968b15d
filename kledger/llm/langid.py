"""Language of texts by a linear-chain conditional random field over words.

A word's features are its first and last bytes (up to three), its byte 2- and 3-grams, and its place in a lexicon
of the most frequent words of each language. Forward-backward over each line gives every word a distribution over
languages, with learned transitions, so switches inside a line are found. A text's language is the largest mean
posterior of its words. The field is fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled texts of up to
``SAMPLE_BYTES`` bytes for each of the ``LANGUAGES`` most frequent languages, in the order of a hash of the id,
plus lines mixed from two languages each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kledger.llm.common import LOWER, Hashes, mix, slices, text_bytes, written

PER_LANGUAGE, SAMPLE_BYTES, LANGUAGES = 150, 16384, 64
BUCKETS, LEXICON, ROUNDS, CHAIN = 1 << 16, 800, 30, 1024
CHUNK = 1 << 19
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


class Chains:
    """Words (runs of letters and non-ASCII bytes), their features, and their chains (lines, cut at ``CHAIN`` words)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lexicon: np.ndarray):
        raw = LOWER[raw]
        inside = LETTER[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        n, size = len(self.start), self.end - self.start
        line = np.cumsum((raw == 10) | edge[:-1])[self.start] if len(raw) else np.zeros(0, np.int64)
        fresh = np.append(True, line[1:] != line[:-1]) if n else np.zeros(0, bool)
        at = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        self.head = np.flatnonzero(at % CHAIN == 0)
        self.length = np.diff(np.append(self.head, n))
        hashes = Hashes(raw)
        word = hashes.spans(self.start, self.end)
        self.word = word
        slot = np.minimum(np.searchsorted(lexicon, word), max(0, len(lexicon) - 1))
        self.lex = np.where(lexicon[slot] == word, slot, -1) if len(lexicon) else np.full(n, -1)
        self.affix = np.full((6, n), -1, np.int64)
        for k in (1, 2, 3):
            ok = size >= k
            for row, a in ((k - 1, self.start), (k + 2, self.end - k)):
                self.affix[row, ok] = self._bucket(hashes.spans(a[ok], a[ok] + k), row + 10)
        r = raw.astype(np.uint64)
        self.gram = []
        for k in (2, 3):
            m = max(0, len(raw) - k + 1)
            code = np.zeros(m, np.uint64)
            ok = np.ones(m, bool)
            for j in range(k):
                code = code << np.uint64(8) | r[j : m + j]
                ok &= inside[j : m + j]
                if j:
                    ok &= ~first[j : m + j]
            place = np.flatnonzero(ok)
            self.gram.append((np.searchsorted(self.start, place, side="right") - 1, self._bucket(code[place], k)))

    @staticmethod
    def _bucket(key: np.ndarray, kind: int) -> np.ndarray:
        return (mix(key + np.uint64(kind << 32)) >> np.uint64(48)).astype(np.int64)

    def emissions(self, w: np.ndarray, lex: np.ndarray, bias: np.ndarray) -> np.ndarray:
        n, k = len(self.start), w.shape[1]
        out = np.tile(bias, (n, 1))
        for row in self.affix:
            ok = row >= 0
            out[ok] += w[row[ok]]
        for owner, bucket in self.gram:
            for c in range(k):
                out[:, c] += np.bincount(owner, weights=w[bucket, c], minlength=n)
        ok = self.lex >= 0
        out[ok] += lex[self.lex[ok]]
        return out

    def gradient(self, diff: np.ndarray, n_lex: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = diff.shape[1]
        w, lex = np.zeros((BUCKETS, k)), np.zeros((n_lex, k))
        for c in range(k):
            for row in self.affix:
                ok = row >= 0
                w[:, c] += np.bincount(row[ok], weights=diff[ok, c], minlength=BUCKETS)
            for owner, bucket in self.gram:
                w[:, c] += np.bincount(bucket, weights=diff[owner, c], minlength=BUCKETS)
            if n_lex:
                ok = self.lex >= 0
                lex[:, c] = np.bincount(self.lex[ok], weights=diff[ok, c], minlength=n_lex)
        return w, lex, diff.sum(0)


def forward_backward(emission: np.ndarray, trans: np.ndarray, head: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each word, expected transitions) over chains that start at ``head``; all chains step together."""
    n, k = emission.shape
    if n == 0:
        return np.zeros((0, k)), np.zeros((k, k))
    local, t_mat = np.exp(emission - emission.max(1, keepdims=True)), np.exp(trans)
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    alpha, beta = np.empty((n, k)), np.ones((n, k))
    for t, m in enumerate(active):
        at = head[:m] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ t_mat) * local[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(len(active) - 1, 0, -1):
        at = head[: active[t]] + t
        b = (local[at] * beta[at]) @ t_mat.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    later = np.ones(n, bool)
    later[head] = False
    at = np.flatnonzero(later)
    a, b = alpha[at - 1], local[at] * beta[at]
    z = ((a @ t_mat) * b).sum(1, keepdims=True)
    return post, t_mat * ((a / z).T @ b)


@dataclass
class Field:
    """A fitted field: feature weights, lexicon, and transitions over ``languages``."""

    languages: list[str]
    lexicon: np.ndarray
    w: np.ndarray
    lex: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    def posteriors(self, chains: Chains) -> np.ndarray:
        return forward_backward(chains.emissions(self.w, self.lex, self.bias), self.trans, chains.head, chains.length)[0]


def _mixed_lines(texts: list[str], labels: list[int], rng: np.random.Generator, n: int) -> list[list[tuple[str, int]]]:
    words = [t.split() for t in texts]
    full = [i for i, w in enumerate(words) if len(w) > 30]
    out = []
    for _ in range(n if len(full) > 1 else 0):
        pair, line = rng.choice(full, 2, replace=False), []
        for part in range(int(rng.integers(2, 5))):
            w = words[pair[part % 2]]
            a, size = int(rng.integers(0, len(w) - 15)), int(rng.integers(4, 15))
            line.append((" ".join(w[a : a + size]), labels[pair[part % 2]]))
        out.append(line)
    return out


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 3) -> Field:
    """The field of greatest regularised likelihood found by ``rounds`` adaptive gradient steps over the sample."""
    languages = sorted(set(langs))
    index = {x: i for i, x in enumerate(languages)}
    labels, k = [index[x] for x in langs], len(languages)
    rng = np.random.default_rng(seed)
    parts = [[(line, y)] for t, y in zip(texts, labels, strict=True) for line in t.split("\n")] + _mixed_lines(texts, labels, rng, len(texts))
    pieces = [(p + " ").encode() for line in parts for p, _ in line]
    last = np.cumsum([len(line) for line in parts]) - 1
    for i in last.tolist():
        pieces[i] += b"\n"
    starts = np.cumsum([0, *map(len, pieces)])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    offs = np.array([0, len(raw)])
    of_piece = np.array([y for line in parts for _, y in line], np.int64)
    probe = Chains(raw, offs, np.zeros(0, np.uint64))
    gold = of_piece[np.searchsorted(starts, probe.start, side="right") - 1]
    frequent = []
    for y in range(k):
        seen, count = np.unique(probe.word[gold == y], return_counts=True)
        frequent.append(seen[np.lexsort((seen, -count))[:LEXICON]])
    lexicon = np.unique(np.concatenate(frequent)) if frequent else np.zeros(0, np.uint64)
    c = Chains(raw, offs, lexicon)
    field = Field(languages, lexicon, np.zeros((BUCKETS, k)), np.zeros((len(lexicon), k)), np.zeros(k), np.zeros((k, k)))
    n = max(1, len(gold))
    if k < 2 or not len(gold):
        return field
    want = np.zeros((len(gold), k))
    want[np.arange(len(gold)), gold] = 1
    later = np.ones(len(gold), bool)
    later[c.head] = False
    at = np.flatnonzero(later)
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[at - 1], gold[at]), 1)
    state = [np.full_like(x, 1e-8) for x in (field.w, field.lex, field.bias, field.trans)]
    for _ in range(rounds):
        post, expected = forward_backward(c.emissions(field.w, field.lex, field.bias), field.trans, c.head, c.length)
        grads = [*c.gradient((want - post) / n, len(lexicon)), (moves - expected) / n]
        for x, g, s in zip((field.w, field.lex, field.bias, field.trans), grads, state, strict=True):
            g = g - 1e-6 * x
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    return field


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may teach: a language, a text, and an id outside the held-out fold."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False)))


def held_out():
    """crc32 of the id as text, modulo 4, is 2; a row without an id is in no fold."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_bytes: int = SAMPLE_BYTES, languages: int = LANGUAGES) -> DataFrame:
    """At most ``languages * per_language`` rows (lang, text) of ``learnable`` rows, none over ``max_bytes``."""
    rows = learnable(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    top = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    order = [F.xxhash64(F.col("doc_id").cast("bigint")), F.col("doc_id"), F.xxhash64("text")]
    ids = rows.filter(F.octet_length("text") <= max_bytes).join(F.broadcast(top), "lang").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ids.filter(F.col("nth") <= per_language).select("lang", "text")


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row from its text alone; ``und`` without a letter or a model."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for b in batches:
            raw, offs = text_bytes(b.column(2))
            letters = np.array([t.is_valid and any(map(str.isalpha, t.as_py())) for t in b.column(2)], bool)
            for lo, hi in slices(offs, CHUNK):
                m = hi - lo
                sums = np.zeros((m, max(1, len(f.languages))))
                if f.languages:
                    c = Chains(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], f.lexicon)
                    post = f.posteriors(c)
                    for k in range(post.shape[1]):
                        sums[:, k] = np.bincount(c.doc, weights=post[:, k], minlength=m)
                total = sums.sum(1)
                ok = letters[lo:hi] & (total > 0)
                best = sums.argmax(1)
                score = np.where(ok, np.minimum(1, sums[np.arange(m), best] / np.where(total > 0, total, 1)), 0.0)
                pred = [f.languages[i] if o else "und" for i, o in zip(best.tolist(), ok.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, m), b.column(1).slice(lo, m), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Fit on the sample of ``docs`` and predict every row. Without a learnable row every prediction is ``und``."""
    rows = written(sample(docs, **bounds), "lang-sample").orderBy("lang", "text").collect()  # bounded, see sample
    return predict(docs, fit([r.text for r in rows], [r.lang for r in rows]))
