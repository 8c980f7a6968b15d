"""Removal of long repeated byte strings by suffix arrays over shards of candidate segments.

Every 100-byte string holds an anchor: the smallest hash of its 20-byte pieces, a choice that depends on
the string alone. So two equal strings meet at an equal anchor, and only surroundings of anchors that occur
twice can repeat. A string also holds 40 bytes more on one side of its anchor; segments of strings that share the anchor
with those bytes are sharded by them. Segments equal in full are one from the start. What differs goes into a suffix array per shard, made by induced sorting;
runs of common prefixes of 100 bytes give the first place of each string, and all later starts are removed.
An anchor with very many different segments (a passage in a third of all documents) is not gathered: its strings
are compared by 128-bit hashes in an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import Hashes, discard, mix, slices, text_bytes, written
from kledger.llm.induced import common_prefixes, suffix_array

LENGTH, PIECE = 100, 20
SHARD = 1 << 21
"""Bytes of segments in one suffix array."""
GATHER = 1 << 15
"""Different segments that a shard may hold because they must stand together."""
STRETCH = 2048
CHUNK = 1 << 17
"""Bytes of texts taken at once: the arrays of eight bytes a place that come of them stay in a core's cache."""
NO_ID = -(1 << 63)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over a[i : i+width] for each i, by doubling; the tail uses what is left."""
    out, have = a.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = op(out[:-step], out[step:])
        have += step
    return out


def anchors(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, hash) of every anchor: pieces smallest in some ``length``-byte string of their text."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - piece + 1)
    h = Hashes(raw).spans(at, at + piece) | np.uint64(1)
    wide = length - piece + 1
    low = _slide(h, wide, np.minimum)
    good = np.zeros(len(h) + 1, np.int64)
    size = np.diff(offs)
    whole = size >= length
    np.add.at(good, offs[:-1][whole], 1)
    np.add.at(good, np.minimum(offs[1:][whole] - length + 1, len(h)), -1)
    low[np.cumsum(good[:-1]) == 0] = 0
    # the largest minimum over the windows that hold a piece equals its hash if it is the smallest of one
    most = _slide(low[::-1], wide, np.maximum)[::-1]
    place = np.flatnonzero(most == h)
    return place, np.searchsorted(offs, place, side="right") - 1, h[place]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _anchor_lists(docs: DataFrame, length: int, piece: int) -> DataFrame:
    """``(row, hs, ats)``: hashes and places of the anchors of every text that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            row = b.column(0).to_numpy()
            for lo, hi in slices(offs, CHUNK):
                o = offs[lo : hi + 1] - offs[lo]
                place, text, h = anchors(raw[offs[lo] : offs[hi]], o, length, piece)
                has, first = np.unique(text, return_index=True)
                ends = pa.array(np.append(first, len(text)).astype(np.int32))
                yield _batch(["row", "hs", "ats"], row[lo:hi][has], *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), (place - o[text]).astype(np.int32))))

    return _rows(docs).select("row", "text").mapInArrow(run, "row bigint, hs array<bigint>, ats array<int>")


def _occurrences(texts: DataFrame, length: int, piece: int) -> DataFrame:
    """Per repeated anchor of ``texts`` (row, doc, text, ats) and side: ``(h, seg, doc, row, lo, hi)``.

    A string that holds an anchor also holds ``half`` bytes more on its left or on its right, and ``h`` hashes
    the anchor with those bytes. ``lo`` to ``hi`` are the starts of the strings of that side, ``seg`` is the hash of all
    their bytes.
    """
    half = (length - piece) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "seg", "doc", "row", "lo", "hi"]
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            row, doc = b.column("row").to_numpy(), b.column("doc").to_numpy()
            ats = b.column("ats")
            for lo, hi in slices(offs, CHUNK):
                o = offs[lo : hi + 1] - offs[lo]
                part = ats.slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                p = part.flatten().to_numpy().astype(np.int64) + o[text]
                hashes = Hashes(raw[offs[lo] : offs[hi]])
                for side, (first, last, a, z) in enumerate(((p - (length - piece), p - half, p - half, p + piece), (p - half + 1, p, p, p + piece + half))):
                    s, e = np.maximum(o[text], first), np.minimum(o[text + 1] - length, last)
                    ok = s <= e
                    s, e, a, z, t = s[ok], e[ok], a[ok], z[ok], text[ok]
                    h = mix(hashes.spans(a, z) + np.uint64(side))
                    seg = mix(hashes.spans(s, e + length) ^ (a - s).astype(np.uint64))
                    yield _batch(names, h.view(np.int64), seg.view(np.int64), doc[lo:hi][t], row[lo:hi][t], (s - o[t]).astype(np.int32), (e - o[t]).astype(np.int32))

    return texts.select("row", "doc", "text", "ats").mapInArrow(run, "h bigint, seg bigint, doc bigint, row bigint, lo int, hi int")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """``(h, many, doc, row, at, data)``: the bytes of the segments that ``texts`` (row, doc, text, segs) lists.

    Segments of one text and key that overlap are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, doc, row, segs in zip(b.column("text"), b.column("doc").to_pylist(), b.column("row").to_pylist(), b.column("segs"), strict=True):
                data = text.as_py().encode()
                h, many, lo, hi = (segs.values.field(k).to_numpy(zero_copy_only=False) for k in ("h", "many", "lo", "hi"))
                order = np.lexsort((lo, h))
                h, many, lo, end = h[order], many[order], lo[order].astype(np.int64), hi[order].astype(np.int64) + length
                reach = np.maximum.accumulate(end + np.cumsum(np.append(0, h[1:] != h[:-1])) * len(data)) if len(h) else end
                reach -= np.cumsum(np.append(0, h[1:] != h[:-1])) * len(data)
                fresh = np.append(True, (h[1:] != h[:-1]) | (lo[1:] > reach[:-1])) if len(h) else np.zeros(0, bool)
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(h)) - 1 if len(h) else first
                n = len(first)
                out = [data[x:z] for x, z in zip(lo[first].tolist(), reach[last].tolist(), strict=True)]
                yield _batch(["h", "many", "doc", "row", "at", "data"], h[first], many[first], np.full(n, doc), np.full(n, row), lo[first].astype(np.int32), pa.array(out, pa.binary()))

    return texts.select("row", "doc", "text", "segs").mapInArrow(run, "h bigint, many boolean, doc bigint, row bigint, at int, data binary")


def _first_start(doc: np.ndarray, row: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where an earlier member of the same group (rows in group order) exists by (doc, row, start)."""
    order = np.lexsort((start, row, doc, group))
    fresh = np.append(True, group[order][1:] != group[order][:-1])
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    later = np.zeros(len(group), bool)
    later[order] = (doc[order] != doc[lead]) | (row[order] != row[lead]) | (start[order] != start[lead])
    return later


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of maximal runs of consecutive starts."""
    order = np.lexsort((start, row))
    r, s = row[order], start[order]
    cut = np.append(True, (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1)) if len(r) else np.zeros(0, bool)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(r)) - 1 if len(r) else first
    return r[first], s[first], s[last]


def repeated_starts(data: list[bytes], doc: np.ndarray, row: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): starts in these segments whose string also starts earlier in one of them."""
    size = np.array([len(d) for d in data])
    s = np.zeros(int(size.sum()) + len(size) + 1, np.uint16)
    ends = np.cumsum(size + 1)
    body = np.ones(len(s), bool)
    body[ends - 1] = False
    body[-1] = False
    s[body] = np.frombuffer(b"".join(data), np.uint8).astype(np.uint16) + 2
    s[ends - 1] = 1
    sa = suffix_array(s)
    plcp = common_prefixes(s, sa, length)
    same = plcp[sa] >= length
    group = np.cumsum(~same)
    both = same.copy()
    both[:-1] |= same[1:]
    places = sa[both]
    seg = np.searchsorted(ends, places, side="right")
    ok = (seg < len(size)) & (places + length < ends[np.minimum(seg, len(size) - 1)])
    places, seg, group = places[ok], seg[ok], group[both][ok]
    start = at[seg] + places - (ends[seg] - size[seg] - 1)
    later = _first_start(doc[seg], row[seg], start, group)
    return _runs(row[seg][later], start[later])


def _shard_marks(segments: DataFrame, length: int, shard: int) -> DataFrame:
    """``(row, lo, hi)`` from suffix arrays over whole anchors, about ``shard`` bytes at a time."""

    def marks(t: pa.Table) -> pa.RecordBatch:
        r, lo, hi = repeated_starts(t.column("data").to_pylist(), t.column("doc").to_numpy(), t.column("row").to_numpy(), t.column("at").to_numpy().astype(np.int64), length)
        return _batch(["row", "lo", "hi"], r.astype(np.int64), lo.astype(np.int32), hi.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            while True:
                h, upto = t.column("h").to_numpy(), np.cumsum(pc.binary_length(t.column("data")).to_numpy())
                cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
                cuts = cuts[upto[cuts - 1] >= shard][:1]
                if not len(cuts):
                    break
                yield marks(t.slice(0, int(cuts[0])))
                t = t.slice(int(cuts[0]))
            rest = t
        if rest is not None and rest.num_rows:
            yield marks(rest)

    dealt = segments.select("h", "doc", "row", "at", "data").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "row bigint, lo int, hi int")


def _hashed_marks(segments: DataFrame, length: int) -> DataFrame:
    """``(row, lo, hi)`` for anchors with very many segments: one row per string, the first found by an aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column("data").cast(pa.large_binary()).view(pa.large_string()))
            for lo, hi in slices(offs, CHUNK):
                o = offs[lo : hi + 1] - offs[lo]
                n = np.maximum(0, np.diff(o) - length + 1)
                seg = np.repeat(np.arange(hi - lo), n)
                k = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
                h = Hashes(raw[offs[lo] : offs[hi]])
                a = o[seg] + k
                x = h.spans(a, a + length)
                half = a + length // 2
                y = mix(h.spans(a, half) * np.uint64(0x9E3779B97F4A7C15) + h.spans(half, a + length))
                own = [b.column(c).to_numpy()[lo:hi][seg] for c in ("doc", "row", "at")]
                yield _batch(["x", "y", "doc", "row", "start"], x.view(np.int64), y.view(np.int64), own[0], own[1], (own[2] + k).astype(np.int32))

    strings = segments.select("doc", "row", "at", "data").mapInArrow(run, "x bigint, y bigint, doc bigint, row bigint, start int")
    place = F.struct("doc", "row", "start")
    first = strings.groupBy("x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(first, ["x", "y"]).filter(place > F.col("first"))
    return later.select("row", F.col("start").alias("lo"), F.col("start").alias("hi")).distinct()


def _spans(marks: pa.Array, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of the maximal removed runs of one text."""
    lo, hi = (marks.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    inside = np.cumsum(edge) > 0
    step = np.diff(np.concatenate([[0], inside[:-1].astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def repeated_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, gather: int = GATHER, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(marked, marks)``: texts with repeated anchors (row, doc, text) and ``(row, lo, hi)`` of later starts in them.

    ``row`` is the place of a row in the scan of ``docs``, which must be a stored table. The order of texts is
    by id (none first), then by place, so of repeated rows the first in the table stays.
    """
    lists = written(_anchor_lists(docs, length, piece), "repeat-places")  # read twice: found once
    twice = lists.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    every = lists.select("row", F.explode(F.arrays_zip("hs", "ats")).alias("x")).select("row", F.col("x.hs").alias("h"), F.col("x.ats").alias("at"))
    held = every.join(twice, "h").groupBy("row").agg(F.collect_list("at").alias("ats"))
    texts = written(_rows(docs).join(held, "row"), "repeat-texts")
    discard(lists)
    seen = written(_occurrences(texts, length, piece), "repeat-anchors")
    place = F.struct("doc", "row", "lo", "hi")
    variants = written(seen.groupBy("h", "seg").agg(F.min(place).alias("first"), F.count("*").alias("n")), "repeat-segments")
    copies = seen.join(variants.filter("n > 1"), ["h", "seg"]).filter(place > F.col("first")).select("row", "lo", "hi")
    kinds = variants.groupBy("h").agg(F.count("*").alias("kinds"), F.min("first").alias("origin")).filter("kinds > 1")
    # anchors whose strings begin in one stretch of one text go to one shard, where neighbours are one segment
    kinds = written(kinds.select("h", "kinds", F.xxhash64("origin.row", F.floor(F.col("origin.lo") / STRETCH)).alias("near")), "repeat-kinds")
    room = kinds.groupBy("near").agg(F.sum("kinds").alias("total"))
    key = F.when(F.col("total") <= gather, F.col("near")).otherwise(F.col("h"))
    kinds = kinds.join(room, "near").select("h", (F.col("kinds") > gather).alias("many"), key.alias("key"))
    differ = variants.join(kinds, "h").select(F.col("key").alias("h"), "many", *[F.col(f"first.{c}").alias(c) for c in ("row", "lo", "hi")])
    listed = differ.groupBy("row").agg(F.collect_list(F.struct("h", "many", "lo", "hi")).alias("segs"))
    segments = written(_cut(texts.drop("ats").join(listed, "row"), length), "repeat-bytes")
    found = _shard_marks(segments.filter("not many"), length, shard)
    found = found.union(_hashed_marks(segments.filter("many"), length))
    marks = written(copies.union(found), "repeat-marks")
    discard(seen, variants, segments)
    return texts, marks


def remove_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, gather: int = GATHER, shard: int = SHARD) -> DataFrame:
    """``(row, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` for every row of ``docs``.

    A byte goes if it lies in a ``length``-byte string that also starts earlier: in a text of a smaller id, or
    in the same text further left. Null and short texts lose nothing; a null text is empty. An empty table
    gives no row; columns other than doc_id and text are not read. ``spans`` lists the removed [lo, hi) bytes.
    """
    texts, marks = repeated_spans(docs, length, piece, gather, shard)
    lists = marks.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, text, m in zip(b.column("row").to_pylist(), b.column("text"), b.column("marks"), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                lo, hi = _spans(m, length, len(data))
                keep = np.ones(len(data), bool)
                for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
                    keep[a:z] = False
                out.append((row, int((hi - lo).sum()), len(lo), hashlib.sha256(data[keep].tobytes()).hexdigest(), [{"lo": a, "hi": z} for a, z in zip(lo.tolist(), hi.tolist(), strict=True)]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
                yield _batch(["row", "n_removed", "n_spans", "sha", "spans"], *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)])

    cut = written(texts.join(lists, "row").select("row", "text", "marks").mapInArrow(run, "row bigint, n_removed bigint, n_spans bigint, sha string, spans array<struct<lo: int, hi: int>>"), "repeat-cuts")
    discard(texts, marks)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("whole"))
    zero = F.lit(0).cast("bigint")
    out = base.join(cut, "row", "left")
    return out.select("row", "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), "spans")
