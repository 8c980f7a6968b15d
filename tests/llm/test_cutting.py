import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kledger.llm import cutting
from kledger.llm.queries import QUERIES, byte_tokenizer


@lru_cache
def whole(text):
    tok = cutting.encoder(*byte_tokenizer()).tok
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, capacity):
    """Every id in exactly one piece, sequences gapless, each full or a power of two of its own."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole(texts[r.doc_id])
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    short = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        if at != capacity:
            assert at < capacity and at & (at - 1) == 0
            short.append(at)
    assert len(short) == len(set(short))
    return pieces


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = check(QUERIES["op11_concatenate_and_cut"](spark, sf).collect(), texts, 1024)
    assert set(pieces) == set(texts)
    for doc, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(whole(texts[doc]))


@pytest.mark.parametrize("capacity", [4, 64, 1024])
def test_edges(docs, capacity):
    own = docs.filter("doc_id is null or doc_id <> 9")
    texts = {r.doc_id: r.text for r in own.collect()}
    rows = cutting.pieces_of(cutting.pack_windows(own, *byte_tokenizer(), capacity=capacity)).collect()
    check(rows, texts, capacity)
    assert sum(r.length for r in rows) == sum(len(whole(t)) for t in texts.values())
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]  # null and empty: the end id alone


def test_repeated_rows_are_packed_each(docs):
    rows = cutting.pieces_of(cutting.pack_windows(docs.filter("doc_id = 9"), *byte_tokenizer(), capacity=8)).collect()
    n = len(whole("one two three four five six seven eight"))
    assert sum(r.length for r in rows) == 2 * n
    assert sorted(i for r in rows for i in range(r.start, r.start + r.length)) == sorted([*range(n), *range(n)])


def test_many_partitions_meet_in_one_window(docs):
    """More partitions than tokens a window: one sequence is made of boundary records of many partitions."""
    spark = docs.sparkSession
    rows = spark.range(100).selectExpr("id as doc_id", "cast(null as string) as text").repartition(25)
    out = cutting.pack_windows(rows, *byte_tokenizer(), capacity=64).collect()
    assert sorted(len(r.ids) // 4 for r in out) == [4, 32, 64]
    assert sorted(d.doc_id for r in out for d in r.docs) == list(range(100))
    assert all([d.offset for d in r.docs] == list(range(len(r.docs))) for r in out)


def test_empty_table(no_docs):
    assert cutting.pieces_of(cutting.pack_windows(no_docs, *byte_tokenizer())).count() == 0


@given(st.integers(0, 5000), st.sampled_from([4, 64, 1000, 1024]))
def test_tail(total, capacity):
    cuts = cutting.tail_cuts(total, capacity)
    sizes = np.diff(cuts).tolist()
    assert cuts[0] % capacity == 0 and cuts[-1] == total and all(s & (s - 1) == 0 for s in sizes) and len(sizes) == len(set(sizes))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ .,'s\n\té1漢\xa0\x1c\u0085<|endoftext|>ÀΣ😀"), max_size=60))
def test_both_readers_agree(text):
    assert np.frombuffer(cutting.encoder(*byte_tokenizer()).ids(text), "<u4").tolist() == whole(text)[:-1]


def test_hard_texts():
    enc = cutting.encoder(*byte_tokenizer())
    for text in ("x<|endoftext|>y", "\n" * 1_500_000 + "a", "a" * 100_000):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == whole(text)[:-1]
