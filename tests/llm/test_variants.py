import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kledger.llm import variants
from kledger.llm.queries import ORACLES, QUERIES


def counted(rows, min_length=7, min_count=2, every=31):
    held = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= min_length:
                held[w] += 1
    return {w: n for w, n in held.items() if n >= min_count}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(words, ratio=10):
    out = {}
    for w, n in words.items():
        others = [v for v in words if v != w and near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(r) for w, r in out.items()}


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_and_twin(spark, sf):
    import duckdb

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = result(QUERIES["op13_spelling_variants"](spark, sf))
    assert got == brute(counted(docs)) and any(f for f, *_ in got.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLES["op13_spelling_variants"]).fetchall()
    assert {w: (f, r, n, k, fn) for w, f, r, n, k, fn in want} == got


def family(rng, size):
    """Texts whose words crowd around a few stems, so that nodes are large and chains of forms are long."""
    stems = ["abababa", "aaaaaaaa", "abcdefghij", "éabcdefghij", "x" * 40]
    words = []
    for _ in range(size):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxÿ") + w[i:], w[:i] + rng.choice("abx×") + w[i + 1 :]])
        words += [w] * rng.choice([1, 2, 3, 40, 700])
    rng.shuffle(words)
    return [(i, " ".join(words[i::20])) for i in range(20)]


@pytest.mark.parametrize("node_words", [2, 8, 4096])
def test_crowded_words(spark, node_words):
    """Small nodes force halving down to single places; results do not depend on it."""
    rows = family(random.Random(node_words), 250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(counted(rows))
    got = result(variants.spelling_variants(df, node_words=node_words))
    assert got == want
    assert any(r[1] != w and r[1] != r[0] for w, r in got.items())  # a chain of more than one form


def test_edges(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(variants.spelling_variants(docs)) == brute(counted(rows))
    assert variants.spelling_variants(no_docs).count() == 0
    assert variants.spelling_variants(docs.filter("text is null or length(text) < 7")).count() == 0


def test_long_words(spark):
    long = "ab" * 30_000
    rows = [(0, f"{long} {long} {long[:-1]} {long[:-1]} z{long} z{long} {long[:100]}q{long[101:]}"), (1, f"{long[:100]}q{long[101:]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(variants.spelling_variants(df, drop_every=1 << 33))
    assert {len(w): r[3] for w, r in got.items() if w[100:101] != "q"} == {60_000: 3, 59_999: 1, 60_001: 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=3, max_size=4), min_size=1, max_size=12, unique=True))
def test_index_equals_pairs(words):
    """One node of words of three and four letters over their whole range."""
    longer = np.array([len(w) - 3 for w in words])
    zero = np.zeros(len(words), np.int64)
    left, right = variants.near_in_chunk(words, longer, zero, zero + 3, zero)
    got = {(words[i], words[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)}
    assert got == {(u, v) for u in words for v in words if len(u) == 3 and u != v and near(u, v)}
