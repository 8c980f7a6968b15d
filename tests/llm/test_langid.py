import itertools
import zlib

import numpy as np

from kledger.llm import langid
from kledger.llm.queries import QUERIES


def test_query_held_out_accuracy(spark, sf):
    rows = QUERIES["op6_language_crf"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    own = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert len(own) > 20 and sum(own) / len(own) > 0.95


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    head, length = np.array([0, 4, 5]), np.array([4, 1, 2])
    post, moves = langid.forward_backward(e, t, head, length)
    want, want_moves = np.zeros_like(e), np.zeros((3, 3))
    for h, n in zip(head, length, strict=True):
        paths = list(itertools.product(range(3), repeat=int(n)))
        w = np.array([np.exp(sum(e[h + i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        for p, x in zip(paths, w / w.sum(), strict=True):
            for i, y in enumerate(p):
                want[h + i, y] += x
            for a, b in zip(p, p[1:], strict=False):
                want_moves[a, b] += x
    assert np.allclose(post, want) and np.allclose(moves, want_moves)


def test_labels_words_in_mixed_lines():
    en = ["the cat sat with the other one and that thing", "this is what they were thinking then"] * 20
    de = ["der hund und die katze sind nicht schlecht", "ich habe keine zeitung gelesen und auch nicht"] * 20
    field = langid.fit(en + de, ["en"] * 40 + ["de"] * 40)
    text = b"the cat sat with the other und die katze sind nicht schlecht"
    chains = langid.Chains(np.frombuffer(text, np.uint8), np.array([0, len(text)]), field.lexicon)
    got = [field.languages[i] for i in field.posteriors(chains).argmax(1)]
    assert got == ["en"] * 6 + ["de"] * 6


def test_edges(spark, docs, no_docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred == ("en" if letters else "und") and (letters or r.score == 0)
    assert langid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    numbers = spark.createDataFrame([(0, "12 34", "xx"), (1, "— …", "xx"), (4, "word", "xx")], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in langid.identify(numbers).orderBy("doc_id").collect()] == ["und", "und", "xx"]
