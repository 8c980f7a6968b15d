import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kledger.llm import packing
from kledger.llm.queries import QUERIES, tokenizer_path


def whole(text):
    tok = packing.encoder(tokenizer_path()).tok
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, capacity):
    bins = defaultdict(list)
    seen = Counter()
    for r in rows:
        ids = whole(texts[r.doc_id])
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and r.start == r.piece * capacity
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.length == capacity or r.start + r.length == len(ids)
        seen[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return bins, seen


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_pack_best_fit"](spark, sf).collect()
    bins, seen = check(rows, texts, 4096)
    assert all(seen[d] == len(whole(t)) for d, t in texts.items())
    assert len(bins) <= sum(seen.values()) / 4096 * 1.01 + 1


def test_edges(docs, no_docs):
    rows = packing.pack(docs.filter("doc_id is not null"), tokenizer_path(), capacity=64, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(rows, texts, 64)
    assert sum(r.length for r in rows if r.doc_id == 9) == 2 * len(whole(texts[9]))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(docs.filter("doc_id is null"), tokenizer_path()).count() == 1
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzABZ .,!?'s\n\téÉ̱Σσ12<|>H漢\xa0"), max_size=60))
def test_memo_equals_the_tokenizer(text):
    enc = packing.encoder(tokenizer_path())
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == whole(text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_equals_best_fit_one_by_one(counts):
    steps = packing.plan(counts, 40)
    fill = Counter()
    for length, rank, n, per, first, offset in steps:
        for k in range(n):
            assert 0 <= offset + (k % per) * length <= 40 - length
            fill[first + k // per] += length
    assert all(v <= 40 for v in fill.values())
    assert sum(fill.values()) == sum(a * b for a, b in counts.items())
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(40 - length)
    assert len(fill) == len(rooms)
    for length, n in counts.items():
        own = sorted((r, c) for le, r, c, *_ in steps.tolist() if le == length)
        assert [r for r, _ in own] == np.cumsum([0, *[c for _, c in own]])[:-1].tolist() and sum(c for _, c in own) == n


def test_special_strings_stay_whole():
    enc = packing.encoder(tokenizer_path())
    for t in ("a<|endoftext|>b, c", "<|endoftext|>.", "x <|startoftext|>, y"):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == whole(t)[:-1]


@pytest.mark.parametrize("form", ["{}.", "a{},", "a{}b"])
def test_every_character_up_to_the_ideographs(form):
    """Separators that are no white space to the tokenizer, letters that change when normalised, marks before a point."""
    enc = packing.encoder(tokenizer_path())
    texts = [form.replace("{}", chr(c)) for c in range(0x3000)] + [form.replace("{}", x) for x in ("İ", "क़", "ẖ", "ﬁ", "\U00010400")]
    want = enc.tok.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want, strict=True) if np.frombuffer(enc.ids(t), "<u4").tolist() != w.ids] == []


def test_query_fills_sequences_with_tokens(spark, sf, monkeypatch):
    paths = []
    write = packing.write_sequences
    monkeypatch.setattr(packing, "write_sequences", lambda packed, path: (paths.append(path), write(packed, path)))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_pack_best_fit"](spark, sf).collect()
    assert len(paths) == 1
    back = spark.read.parquet(paths[0]).collect()
    assert sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows) == sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in back)
    for r in back:
        assert bytes(r.ids) == np.array(whole(texts[r.doc_id])[r.start : r.start + r.length], "<u4").tobytes()


def test_joined_parts_and_a_full_memo_give_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_PARTS", 40)
    enc = packing.Encoder(tokenizer_path())
    calls = []
    enc.tok, own = type("Counted", (), {"encode_batch_fast": lambda self, parts, **k: calls.append(len(parts)) or own.encode_batch_fast(parts, **k)})(), enc.tok
    for n in range(5):
        words = [f"w{chr(97 + i % 26)}{chr(98 + n)}" + "é" * (i // 26) for i in range(60)] + ["a|b", "|", "it's", "x."]
        assert np.frombuffer(enc.ids(" ".join(words)), "<u4").tolist() == own.encode(" ".join(words), add_special_tokens=False).ids
        assert len(enc.memo) <= 40 + len(words) + 5
    assert max(calls) <= 4  # words go together, only those with a bar alone


def test_tokens_move_in_16_bits_and_lie_in_32(spark, docs, tmp_path, monkeypatch):
    moved = []
    write = packing.write_sequences
    monkeypatch.setattr(packing, "fresh_folder", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(packing, "write_sequences", lambda packed, path: (moved.extend(packed.collect()), write(packed, path)))
    named = docs.filter("doc_id is not null and doc_id != 9")
    rows = packing.packed_sequences(named, tokenizer_path()).collect()
    check(rows, {r.doc_id: r.text for r in named.collect()}, 4096)
    assert moved and all(len(r.ids) == 2 * r.length for r in moved)
    stored = spark.read.parquet(str(tmp_path / "sequences")).collect()
    assert len(stored) == len(moved) and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in stored)


@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=9))
def test_narrow_ids_come_back(ids):
    data = np.array(ids, "<u4").tobytes()
    assert packing.widen(packing.narrow(data), len(ids)) == data
    assert len(packing.narrow(data)) == (2 if ids and max(ids) < 1 << 16 else 4) * len(ids)
