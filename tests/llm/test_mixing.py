import numpy as np

from kledger.llm import mixing
from kledger.llm.queries import QUERIES


def test_rates_equal_a_brute_force_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.3, 0.3], 300)
    tokens = rng.integers(0, 400, 300)
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "n_tokens bigint, post array<double>")
    steps, want = mixing.fit_rates(rows, ["a", "b", "c"], {"a": 0.7, "b": 0.25, "c": 0.05}, "a")
    got = [r.rate for r in rows.select(mixing._rate(steps).alias("rate")).collect()]
    rate = np.ones(300)
    for s in steps:
        rate = np.maximum(0, rate - p @ np.array(s))
    assert np.allclose(got, rate) and (rate >= 0).all() and (rate == 0).any()
    totals = (rate * tokens) @ p
    assert np.allclose(totals, [want[d] for d in "abc"], rtol=2e-3, atol=1e-3 * totals.sum())


def test_query_meets_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_soft_mixing"](spark, sf).collect()
    kind = {r.doc_id: r.domain for r in mixing.domains(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labelled = [r for r in rows if r.doc_id in kind]
    assert sum(r.domain == kind[r.doc_id] for r in labelled) / len(labelled) > 0.85
    plain = sum(r.rate * r.n_tokens for r in rows if r.domain == "plain") / sum(r.rate * r.n_tokens for r in rows)
    assert 0.94 < plain <= 1
    assert abs(sum(r.copies for r in rows) / sum(r.rate for r in rows) - 1) < 0.05


def test_edges(docs, no_docs, labels):
    rows = mixing.mix(docs, labels).collect()
    assert sorted(str(r.record.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert len({(r.rate, r.copies) for r in rows if r.record.doc_id in (0, 4) and r.record.text == rows[0].record.text}) <= 2
    assert {r.rate for r in mixing.mix(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix(no_docs, labels).count() == 0
