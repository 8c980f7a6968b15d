import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kledger.llm import repeats
from kledger.llm.induced import common_prefixes, suffix_array


def brute(rows, length):
    """rows in order: (id, text) -> (id, bytes, removed, spans, kept)."""
    seen, out = set(), []
    for d, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def stored(spark, rows, path, schema="doc_id bigint, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_query_on_whole_tables(spark, sf):
    from kledger.llm.queries import QUERIES

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert result(QUERIES["op8_suffix_array_dedup"](spark, sf)) == brute(rows, 100)


def mixed_rows(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(30), text(9)
    rows = [(i, text(5) + " " + passage + " " + text(6)) for i in range(40)]
    rows += [(40 + i, text(20) + line + text(10) + "é" * i + line) for i in range(30)]
    return [*rows, (90, "ab" * 400), (91, "a" * 700), (92, "ab" * 100), (93, None), (94, ""), (95, rows[3][1]), (95, rows[3][1]), (95, text(60)), (None, rows[3][1])]


def test_both_ways_equal_brute_force(spark, tmp_path):
    rows = mixed_rows()
    df = stored(spark, rows, tmp_path / "t")
    want = brute(sorted(rows, key=lambda x: -1 if x[0] is None else x[0]), 40)
    assert result(repeats.remove_repeats(df, 40, 12)) == want
    assert result(repeats.remove_repeats(df, 40, 12, gather=3, shard=2000)) == want


def test_edges(spark, docs, no_docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: -1 if x[0] is None else x[0])
    assert result(repeats.remove_repeats(df)) == brute(rows, 100)
    assert repeats.remove_repeats(no_docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 4))
def test_suffix_array_equals_a_plain_sort(values, times):
    s = np.array([*values * times, 0])
    sa = suffix_array(s)
    plain = s.tolist()
    want = sorted(range(len(plain)), key=lambda i: plain[i:])
    assert sa.tolist() == want
    lcp = common_prefixes(s, sa, 25)
    for a, b in zip(want, want[1:], strict=False):
        n = 0
        while n < 25 and a + n < len(plain) and b + n < len(plain) and plain[a + n] == plain[b + n]:
            n += 1
        assert lcp[b] == n


def test_every_string_holds_an_anchor_that_depends_on_it_alone():
    r = random.Random(1)
    text = "".join(r.choice("ab") for _ in range(600)).encode()
    data = np.frombuffer(text + text[100:400] + b"a" * 80, np.uint8)
    place, _, _ = repeats.anchors(data, np.array([0, len(data)]), 50, 10)
    own = set(place.tolist())
    seen = {}
    for i in range(len(data) - 49):
        inside = frozenset(p - i for p in range(i, i + 41) if p in own)
        least = repeats.anchors(data[i : i + 50], np.array([0, 50]), 50, 10)[0].tolist()
        assert least and set(least) <= inside
        seen.setdefault(bytes(data[i : i + 50]), set()).update(least)


def test_anchors_are_found_once(spark, tmp_path, monkeypatch):
    """One plan reads the texts for anchors; both sides of their join read the written lists."""
    df = stored(spark, mixed_rows(), tmp_path / "t")
    lists, write = [], repeats.written
    monkeypatch.setattr(repeats, "written", lambda x, name: lists.append((name, x)) or write(x, name))
    repeats.repeated_spans(df, 40, 12)
    plans = {name: x._jdf.queryExecution().executedPlan().toString() for name, x in lists}
    assert plans["repeat-places"].count("MapInArrow") == 1 and "MapInArrow" not in plans["repeat-texts"]


def test_small_chunks_change_nothing(spark, tmp_path, monkeypatch):
    df = stored(spark, mixed_rows(7), tmp_path / "t")
    want = result(repeats.remove_repeats(df, 40, 12))
    monkeypatch.setattr(repeats, "CHUNK", 300)
    raw, offs = repeats.text_bytes(df.select("text").toArrow().column(0))
    at, text, h = repeats.anchors(raw, offs, 40, 12)
    found = []
    for lo, hi in repeats.slices(offs, repeats.CHUNK):
        p, t, k = repeats.anchors(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], 40, 12)
        found += zip((p + offs[lo]).tolist(), (t + lo).tolist(), k.tolist(), strict=True)
    assert found == list(zip(at.tolist(), text.tolist(), h.tolist(), strict=True))
    assert want == brute(sorted(mixed_rows(7), key=lambda x: -1 if x[0] is None else x[0]), 40)
