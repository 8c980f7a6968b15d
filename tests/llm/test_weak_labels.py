import numpy as np

from kledger.llm import weak_labels
from kledger.llm.queries import QUERIES


def test_query_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op2_weak_label_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.5


def test_estimate_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.7
    hit = np.array([0.95, 0.9, 0.85, 0.8])
    votes = np.where((rng.random((20000, 4)) < hit) == good[:, None], 1, -1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, share = weak_labels.estimate(patterns, counts.astype(float), false_alarm=1.0)
    assert abs(share - 0.7) < 0.03
    assert np.allclose(rates[1, :, 2], hit, atol=0.03) and np.allclose(rates[0, :, 0], hit, atol=0.04)
    assert ((post[at.ravel()] > 0.5) == good).mean() > 0.93


def test_edges(docs, no_docs):
    rows = weak_labels.classify(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(0 <= r.score <= 1 and (r.kept == (r.score >= 0.5)) for r in rows)
    assert not any(r.kept for r in rows if len(texts[r.doc_id] or "") < 3)
    assert len({r.score for r in rows if r.doc_id in (0, 4)}) == 1
    assert weak_labels.classify(no_docs).count() == 0
