"""Groups of similar rows equal the brute-force rule, whatever the cells."""

import random

import numpy as np
import pytest

from kledger.operators import ingest as I
from kledger.operators import similar as S

SCHEMA = "id bigint, v array<int>, keys array<string>"


def brute(rows, threshold):
    """(id, component) by comparing every pair."""
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = [(i, np.array(v, float), {k for k in ks if k is not None}) for i, v, ks in rows if v is not None and any(v) and ks]
    for n, (i, a, ka) in enumerate(held):
        for j, b, kb in held[:n]:
            if ka & kb and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, find(i)) for i in parent)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def crowd(seed, n, spread):
    """Clusters, chains between them, outliers, copies, one key with most rows, rows without keys and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 6))
    rows = []
    for i in range(n):
        a, b = rng.integers(7, size=2)
        t = rng.random() if i % 11 == 0 else 0.0
        v = np.round(20 * ((1 - t) * centres[a] + t * centres[b] + rng.normal(size=6) * spread)).astype(int).tolist()
        keys = [["hot"], ["hot", f"k{i % 5}"], [f"k{i % 5}"], ["hot", None]][int(rng.integers(4))]
        rows.append((i + 100, v, keys))
        if i % 17 == 0:
            rows.append((i + 5000, v, keys))
    return [*rows, (1, [0] * 6, ["hot"]), (2, [0] * 6, ["hot"]), (3, None, ["hot"]), (4, [1, 0, 0, 0, 0, 0], []), (5, [1, 0, 0, 0, 0, 0], None and []), (6, [1, 0, 0, 0, 0, 0], [None])]


@pytest.mark.parametrize(("seed", "spread", "threshold", "sizes"), [(1, 0.1, 0.9, {}), (2, 0.25, 0.97, {"cell": 8, "visitor_cells": 3, "zone_cells": 4}), (3, 0.6, 0.9, {"cell": 4, "visitor_cells": 2, "zone_cells": 5})])
def test_groups_equal_all_pairs(spark, seed, spread, threshold, sizes):
    rows = crowd(seed, 300, spread)
    want = brute([(i, v, k or []) for i, v, k in rows], threshold)
    assert 5 < len({c for _, c in want}) < len(want)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(S.linked_groups(df, threshold, **sizes)) == want


def test_no_rows_and_no_usable_rows(spark):
    assert S.linked_groups(spark.createDataFrame([], SCHEMA), 0.9).count() == 0
    assert result(S.linked_groups(spark.createDataFrame([(1, [0, 0], ["a"]), (2, None, None)], SCHEMA), 0.9)) == [(1, 1), (2, 2)]


def test_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij") for _ in range(3000))
    rows = [
        (1, long, ["A b"]), (2, long[:-1] + "z", ["a-B"]), (3, "q" * 50, ["a b"]), (4, long, ["other"]), (5, long, []), (6, None, ["a b"]), (7, "  ", ["a b"]), (8, f" {long} ", ["a b"]),
        (9, "q" * 50, ["other", "third"]), (10, "q" * 49, ["third"]),
    ]
    texts = spark.createDataFrame(rows, "id bigint, text string, entities array<string>")
    assert result(I.duplicate_groups(texts)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 1), (9, 9), (10, 9)]
