import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kledger.llm import negatives
from kledger.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, ask int, block string, rank int"


def brute(rows, every=100, k=5, percent=80):
    """Rows (vec_id, embedding, label) by the rule, one pair after another, in whole numbers."""
    own = set()
    for i, e, label in rows:
        if i is None or label is None or not e or any(x is None or not math.isfinite(x * 256) for x in e):
            continue
        own.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e)))
    clip = lambda s: min(max(s, negatives.LOW), negatives.HIGH)
    out = []
    for a, label, v in own:
        if a % every:
            continue
        scored = [(-clip(sum(x * y for x, y in zip(v, w, strict=True))), b, m == label) for b, m, w in own if b != a and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2])[:k]:
            fits = sorted(s for s in scored if not s[2] and percent * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out += [(a, positive, r, b, -p, -s) for r, (s, b, _) in enumerate(fits, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, "b", 2) for i, e, label in rows], SCHEMA).repartition(3)


def test_query_and_twin(spark, sf):
    import duckdb

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = result(QUERIES["op12_hilbert_hard_negatives"](spark, sf))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(ORACLES["op12_hilbert_hard_negatives"]).fetchall())


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 4, "asks": 2, "zones": 3, "seeds": 1}])
def test_crowded_vectors(spark, sizes):
    """Clusters, a third of all rows with one vector, and many equal scores; small blocks, slices and cells change nothing."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(600):
        c = int(rng.integers(6))
        v = centres[0] if i % 3 == 0 else np.round(centres[c] + rng.normal(size=8) * 0.2, 1)
        rows.append((i, v.tolist(), c if i % 5 else int(rng.integers(10))))
    want = brute(rows, every=20)
    assert len(want) > 400
    assert result(negatives.mine(frame(spark, rows), every=20, **sizes)) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [math.sin(i), math.cos(i), 0.1], i % 3) for i in range(40)]
    bad = [(100, None, 1), (100, [1.0, None, 1.0], 1), (100, [1.0, nan, 0.0], 1), (5, [inf, 0.0, 0.0], 1), (6, [1.0, 0.0, 0.1], None), (None, [1.0, 0.0, 0.1], 1), (100, [], 1)]
    odd = [(200, [1.0, 0.0], 1), (201, [1.0, 0.5], 1), (202, [1.0, 0.25], 2), (300, [0.0, 0.0, 0.0], 2), (301, [1e20, 3.0, 2.0], 2), (302, [1e306, 0.0, 0.0], 1), (400, [-0.4, 0.1, 0.1], 0)]
    twice = [(0, [0.0, 1.0, 0.1], 0), (0, [0.0, 1.0, 0.1], 0), (500, [0.9, 0.1, 0.0], 1), (500, [0.9, 0.1, 0.0], 2), (501, [0.9, 0.2, 0.0], 1), (501, [0.9, 0.2, 0.0], 1), (-100, [0.5, 0.5, 0.5], 7)]
    rows = good + bad + odd + twice
    want = brute(rows)
    assert want and result(negatives.mine(frame(spark, rows))) == want
    assert result(negatives.mine(frame(spark, rows), block_rows=2, asks=1, zones=2)) == want
    assert negatives.mine(frame(spark, rows).limit(0)).count() == 0
    assert negatives.mine(frame(spark, good[1:])).count() == 0  # no anchor
    assert negatives.mine(frame(spark, [(100, [1.0], 1)])).count() == 0  # an anchor alone


def test_zone_maps_leave_blocks_out(spark):
    """Far clusters: the second pass reads few of the blocks."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 8] + rng.normal(size=8) * 0.01).tolist(), i % 2) for i in range(800)]
    usable = negatives.usable_rows(frame(spark, rows))
    blocks = negatives.build_blocks(usable, 6, block_rows=16)
    assert blocks.count() >= 50
    assert 4 <= result(negatives.mine(frame(spark, rows), block_rows=16)).__len__()
    zones = [(np.frombuffer(r.zone_min), np.frombuffer(r.zone_max), np.frombuffer(r.vectors).reshape(r.n, r.dim)) for r in blocks.collect()]
    a = np.floor(256 * np.array([rows[0][1]]))
    least, most = negatives.bounds(a, np.stack([z[0] for z in zones]), np.stack([z[1] for z in zones]))
    for (_, _, v), lo, hi in zip(zones, least[0], most[0], strict=True):
        assert lo <= (v @ a[0]).min() and (v @ a[0]).max() <= hi
    best = max((v @ a[0]).max() for _, _, v in zones)
    assert (most[0] >= 0.9 * best).sum() < len(zones) / 3


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3), st.integers(1, 3))
def test_hilbert_curve_visits_neighbours(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = negatives.hilbert_places(cells.astype(np.uint32), bits)
    assert len(set(keys)) == len(keys)
    path = cells[np.argsort(np.array(keys, object), kind="stable")]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
