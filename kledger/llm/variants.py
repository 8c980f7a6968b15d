"""Spelling variants: words at one inserted, deleted or replaced letter, found by bit-sliced position indexes.

A near pair ``u``, ``v`` (``v`` as long as ``u`` or one letter longer) differs at one place of ``u``. A node
``[lo, hi)`` of words of one length is all words that agree left of ``lo`` and right of ``hi``; a pair whose place
lies inside meets there. Every word lies in two halves of its own length's range, and, as the longer one, in those
of the length below. Nodes with too many words are halved again, down to a single place, where letters alone bound
them. So every pair meets in exactly one node of bounded size, whatever the words.

Consecutive nodes form a chunk with one index: for every position and letter the bitset of words that have it
there. For all shorter words at once, position by position, three bitsets are carried over the chunk: equal so far,
one replaced so far, and one letter ahead so far, which reads the slice of the next position. What they hold at
the end are the near words; whole words are compared before a pair counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import discard, written

MIN_LENGTH, MIN_COUNT, DROP_EVERY, RATIO = 7, 2, 31, 10
NODE_WORDS = 4096
NODE_LETTERS = 4 << 20
CHUNK_WORDS, CHUNK_LETTERS = 1024, 4 << 20
HELD_WORDS, HELD_BYTES = 200_000, 32 << 20
NODE = ["cls", "lo", "hi", "context"]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """``(word, n)`` over all whole texts; a run whose checksum with its document's id says so loses one letter.

    A null text has no run; a null id is the empty string in the checksum; repeated rows count each.
    """
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = "" if doc is None else doc
                for w, k in Counter(run.findall(text.as_py() or "")).items():
                    w = w.lower() if w.isascii() else w.encode("latin-1").lower().decode("latin-1")  # only A-Z
                    h = zlib.crc32(f"{own}:{w}".encode())
                    if h % drop_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < min_length:
                            continue
                    if w not in held:
                        size += len(w)
                    held[w] += k
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _nodes(rows: DataFrame, ranges) -> DataFrame:
    """Rows ``(word, n, longer, cls)`` in the nodes whose ranges ``ranges`` gives, with a hash of what the node's words share."""
    each = rows.withColumn("range", F.explode(ranges)).select("word", "n", "longer", "cls", "range.lo", "range.hi")
    rest = F.expr("substring(word, hi + 1 + longer, length(word))")
    return each.withColumn("context", F.xxhash64(F.expr("substring(word, 1, lo)"), rest))


def _halves(lo: str, hi: str):
    mid = f"cast(({lo} + {hi}) div 2 as int)"
    return F.expr(f"array(named_struct('lo', {lo}, 'hi', {mid}), named_struct('lo', {mid}, 'hi', {hi}))")


def placed(words: DataFrame, min_length: int = MIN_LENGTH, node_words: int = NODE_WORDS, node_letters: int = NODE_LETTERS) -> list[DataFrame]:
    """Tables of ``(word, n, longer, cls, lo, hi, context)`` that hold every node once; all are small enough for a task."""
    roles = F.expr(f"filter(array(named_struct('longer', 0, 'cls', length(word)), named_struct('longer', 1, 'cls', length(word) - 1)), r -> r.cls >= {min_length})")
    rows = words.withColumn("role", F.explode(roles)).select("word", "n", "role.longer", "role.cls")
    level = written(_nodes(rows, _halves("0", "cls")), "variant-nodes")
    done = []
    while True:
        sizes = level.groupBy(*NODE).agg(F.count("*").alias("rows"))
        large = f"hi - lo > 1 and rows > 1 and (rows > {node_words} or rows * cast(hi - lo as bigint) > {node_letters})"
        hot = written(sizes.filter(large).select(*NODE), "variant-hot")
        if hot.isEmpty():
            return [*done, level]
        done.append(level.join(hot, NODE, "left_anti"))
        level = written(_nodes(level.join(hot, NODE, "left_semi"), _halves("lo", "hi")), "variant-nodes")


def near_in_chunk(words: list[str], longer: np.ndarray, lo: np.ndarray, hi: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (shorter or equal word, other word) of near words within nodes; rows of a node are consecutive."""
    n, span = len(words), hi - lo
    wide = int((span + longer).max())
    codes = np.zeros((n, wide + 1), np.uint8)
    for i, w in enumerate(words):
        part = w[lo[i] : hi[i] + longer[i]].encode("latin-1")
        codes[i, : len(part)] = np.frombuffer(part, np.uint8)
    blocks = -(-n // 64)
    letters = np.unique(codes)
    letters = letters[letters > 0]
    number = np.full(256, len(letters), np.int64)  # the last slice, for no letter, stays empty
    number[letters] = np.arange(len(letters))
    codes = number[codes]

    def slices(k: int) -> np.ndarray:
        has = np.zeros((len(letters) + 1, blocks * 64), bool)
        has[codes[:, k], np.arange(n)] = True
        has[-1] = False
        return np.packbits(has, axis=1, bitorder="little").view(np.uint64)

    def bits(flags: np.ndarray) -> np.ndarray:
        out = np.zeros((*flags.shape[:-1], blocks * 64), bool)
        out[..., :n] = flags
        return np.packbits(out, axis=-1, bitorder="little").view(np.uint64)

    ask = np.flatnonzero(longer == 0)
    ask = ask[np.argsort(-span[ask], kind="stable")]
    if not len(ask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    equal = bits(node[ask][:, None] == node[None, :])
    replaced, ahead = np.zeros_like(equal), np.zeros_like(equal)
    here = slices(0)
    for k in range(int(span[ask[0]])):
        after = slices(k + 1)
        a = int(np.searchsorted(-span[ask], -k, side="left"))  # words whose range goes beyond k
        own = codes[ask[:a], k]
        same = here[own]
        ahead[:a] = (ahead[:a] | equal[:a]) & after[own]
        replaced[:a] = (replaced[:a] & same) | (equal[:a] & ~same)
        equal[:a] &= same
        here = after
    is_longer = bits(longer == 1)
    found = (replaced & ~is_longer) | ((ahead | equal) & is_longer)
    row, col = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :n])
    return ask[row], col


def _first_difference(u: str, v: str, at: int) -> int:
    while at < len(u) and u[at] == v[at]:
        at += 1
    return at


def near_words(table: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` per word and node of ``table``: how many near words, and the most frequent, first in order."""
    names = ["word", "n_near", "best_n", "best"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def solve(words: list[str], n: np.ndarray, longer: np.ndarray, cls: np.ndarray, lo: np.ndarray, hi: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        count, best = [0] * len(words), [None] * len(words)
        left, right = near_in_chunk(words, longer, lo, hi, node)
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            u, v = words[i], words[j]
            at = _first_difference(u, v, int(lo[i]))
            here = lo[i] <= at < hi[i] or at == hi[i] == cls[i]  # each pair counts where it first differs
            if not here or u[:at] != v[:at] or (u[at:] if longer[j] else u[at + 1 :]) != v[at + 1 :] or u == v:
                continue
            for a, b in ((i, j), (j, i)) if longer[j] else ((i, j),):  # equal lengths are found from both sides
                count[a] += 1
                key = (-int(n[b]), words[b])
                if best[a] is None or key < best[a]:
                    best[a] = key
        some = [i for i, c in enumerate(count) if c]
        rows = [(words[i], count[i], -best[i][0], best[i][1]) for i in some]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[list[tuple]] = []  # nodes of two words or more; a word alone has no near word
        group: list[tuple] = []
        open_key, rows, widest = None, 0, 0

        def close() -> pa.RecordBatch:
            words, *numbers = zip(*(r for g in chunk for r in g), strict=True)
            marks = np.repeat(np.arange(len(chunk)), [len(g) for g in chunk])
            return solve(list(words), *(np.array(x, np.int64) for x in numbers), marks)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("word", "n", "longer", "cls", "lo", "hi", "context")]
            for *row, cls, lo, hi, context in zip(*cols, strict=True):
                if (cls, lo, hi, context) != open_key:
                    if len(group) > 1:
                        chunk.append(group)
                        rows, widest = rows + len(group), max(widest, group[0][5] - group[0][4])
                        if rows >= CHUNK_WORDS or rows * (widest + 2) > CHUNK_LETTERS:
                            yield close()
                            chunk, rows, widest = [], 0, 0
                    open_key, group = (cls, lo, hi, context), []
                group.append((*row, cls, lo, hi))
        if len(group) > 1:
            chunk.append(group)
        if chunk:
            yield close()

    dealt = table.repartition(*NODE).sortWithinPartitions(*NODE)
    return dealt.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """``(word, root)`` for ``forms`` (word, form): the end of each chain of at most ``steps`` forms, by doubling."""
    chains = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    reach = 1
    while reach < steps:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(chains.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
        discard(chains)
        chains, reach = longer, 2 * reach
    return chains


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY, ratio: int = RATIO, node_words: int = NODE_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``min_length`` letters and ``min_count`` occurrences.

    ``form`` is the most frequent near word (ties: first in code-point order) if it is ``ratio`` times as frequent,
    ``root`` the end of the chain of forms. Null and empty texts have no words, texts and words of any length are read
    whole, repeated rows count each, further columns are not read, an empty table gives no row.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    words = written(word_counts(docs, min_length, min_count, drop_every), "variant-words")
    found = None
    for t in placed(words, min_length, node_words):
        found = near_words(t) if found is None else found.unionByName(near_words(t))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best"))
    wide = words.join(best, "word", "left")
    much = -F.col("best.less") >= ratio * F.col("n")
    formed = written(wide.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("best.form")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")), "variant-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(max(most / min_count, 1), ratio) + 1e-9)
    roots = _roots(formed.filter("form is not null"), steps)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
