"""Best-fit packing of token sequences, planned on the histogram of lengths.

Texts are tokenised in Python tasks (a text's white-space parts are looked up in a bounded memo, so each
distinct part meets the tokenizer once while it is there). The planner sees only how many pieces have each length
(``capacity`` numbers at most) and works on groups of equally filled bins, longest pieces first, each piece
into the fullest bin that still takes it. Its steps say which ranks of a length fill which bins at which
offset; pieces get their rank within their length from per-task counts and look their slot up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kledger.llm.common import fresh_folder, written

CAPACITY = 4096
MEMO_PARTS = 700_000
"""Parts a worker remembers (about 110 MB); workers outlive their stage, so the memo stays beside later ones."""
MEMO_PART_BYTES = 64
TOGETHER = 64


class Encoder:
    """``ids(text)``: the tokenizer's ids as little-endian 32-bit bytes, equal to encoding the text whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        bar = self.tok.encode("a | b", add_special_tokens=False).ids
        alone = [self.tok.encode(c, add_special_tokens=False).ids for c in ("a", "|", "b")]
        self.bar = alone[1][0] if [len(x) for x in alone] == [1, 1, 1] and bar == sum(alone, []) else None
        # the tokenizer's white space lacks four separators that str.split() cuts at
        self.separators, self.space = "\x1c\x1d\x1e\x1f", re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.combining = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part. Parts without a bar meet the tokenizer together, between bars: none of their ids is a bar's, and nothing joins over white space."""
        plain = [w for w in parts if "|" not in w] if self.bar is not None else []
        runs = [plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
        got: dict[str, bytes] = {}
        for words, e in zip(runs, self.tok.encode_batch_fast([" | ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            data, cuts = ids.tobytes(), [-1, *np.flatnonzero(ids == self.bar).tolist(), len(ids)]
            got.update(zip(words, [data[4 * a + 4 : 4 * z] for a, z in pairwise(cuts)], strict=True))
        if len(got) < len(parts):
            rest = [w for w in parts if w not in got]
            got.update(zip(rest, [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)], strict=True))
        return [got[w] for w in parts]

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts not in the memo. A final ``.`` or ``,`` after an ASCII letter is a token of its own; other letters may change when normalised."""
        stem = {w: w[:-1] for w in parts if w[-1] in ".," and "a" <= w[-2:-1] <= "z" and "<|" not in w}
        need = [w for w in dict.fromkeys([*(stem.get(w, w) for w in parts), *{w[-1] for w in stem}]) if w not in self.memo]
        got = dict(zip(need, self._encode(need), strict=True))
        for w, s in stem.items():
            got[w] = (got.get(s) or self.memo[s]) + (got.get(w[-1]) or self.memo[w[-1]])
        if len(self.memo) > MEMO_PARTS:  # the parts met first are the commonest
            while len(self.memo) > MEMO_PARTS // 2:
                self.memo.popitem()
        self.memo.update((w, b) for w, b in got.items() if len(w) <= MEMO_PART_BYTES)
        return got

    def ids(self, text: str) -> bytes:
        if not self.combining.search(text):  # composition may differ by case, so such texts keep theirs
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        odd = any(c in text for c in self.separators)
        parts = [p for p in self.space.split(text) if p] if odd else text.split()
        try:
            return b"".join(map(self.memo.__getitem__, parts))
        except KeyError:
            distinct = dict.fromkeys(parts)
            known = {w: self.memo[w] for w in distinct if w in self.memo}
            known |= self._learn([w for w in distinct if w not in known])
            return b"".join(map(known.__getitem__, parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def narrow(ids: bytes) -> bytes:
    """32-bit ids in 16 bits each if all of them fit, else as they are."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if len(wide) and wide.max() < 1 << 16 else ids


def widen(ids: bytes, length: int) -> bytes:
    """``length`` ids as 32-bit numbers, whichever way ``narrow`` left them."""
    return ids if len(ids) == 4 * length else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False, short_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, nth[, ids])``: every document's ids and ``end_id``, cut every ``capacity``.

    ``nth`` counts pieces of one length within ``task``. A null text is empty, so it is one piece of length 1.
    With ``short_ids`` a piece's ids lie in 16 bits each where they fit (``narrow``); the crc is that of 32 bits.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + (", ids binary" if with_ids else "")
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + ([pa.binary()] if with_ids else [])
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = enc.ids(text.as_py() or "") + tail
                for p, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc, p, p * capacity, n, zlib.crc32(part), task, int(seen[n]), *([narrow(part) if short_ids else part] if with_ids else [])))
                    seen[n] += 1
                    held += len(part) if with_ids else 64
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts. Rows ``(length, first rank, n, per bin, first bin, offset)``.

    Ranks ``first rank + k`` for k < n go to bin ``first bin + k // per bin`` at ``offset + (k % per bin) * length``.
    A group of bins is touched at most log2(capacity) times, as each touch leaves less than half its room, so
    the rows are bounded by the capacity alone.
    """
    rooms: list[int] = []  # sorted free sizes that some group has
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
    rows: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(room: int, first: int, bins: int) -> None:
        if room > 0 and bins > 0:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, bins))

    def fill(length: int, rank: int, left: int, room: int, first: int, bins: int) -> int:
        """Pieces of ``length`` into ``bins`` bins of ``room``; returns how many went in."""
        per = room // length
        full = min(bins, left // per)
        if full:
            rows.append((length, rank, full * per, per, first, capacity - room))
            put(room - per * length, first, full)
        some = left - full * per if full < bins else 0
        if some:
            rows.append((length, rank + full * per, some, some, first + full, capacity - room))
            put(room - some * length, first + full, 1)
        put(room, first + full + bool(some), bins - full - bool(some))
        return full * per + some

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                bins = -(-left // (capacity // length))
                took = fill(length, rank, left, capacity, made, bins)
                made += bins
            else:
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                took = fill(length, rank, left, room, first, bins)
            rank, left = rank + took, left - took
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False, short_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``: every piece and its place.

    Null texts are empty; texts of any length are cut whole; repeated rows are packed each; an empty table
    gives no row. Further columns of ``docs`` are not read. A length that most pieces share costs no more than
    others: ranks come from per-task counts, and slots from a lookup in the plan.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids, short_ids), "pack-pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = written(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    steps = plan(histogram, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    sent = docs.sparkSession.sparkContext.broadcast(steps)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        keys = (s[:, 0] << 48) + s[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            k = rank - s[at, 1]
            own = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            new = [pa.array(s[at, 4] + k // s[at, 3]), pa.array(s[at, 5] + k % s[at, 3] * length)]
            yield pa.RecordBatch.from_arrays([*own, *new, *([b.column("ids")] if with_ids else [])], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    ranked = cut.join(per_task.select("length", "task", "base"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(place, schema)


def write_sequences(packed: DataFrame, path: str) -> None:
    """The pieces of ``pack(..., with_ids=True)`` laid out by sequence and offset: each sequence lies whole, in order, in one file, its ids in 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [widen(x.as_py(), n) for x, n in zip(b.column("ids"), b.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()) if c == "ids" else b.column(c) for c in b.schema.names], b.schema.names)

    dealt = packed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    dealt.mapInArrow(run, packed.schema).write.mode("overwrite").option("compression", "zstd").parquet(path)


def packed_sequences(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all documents, their tokens written into sequences in the shared folder; ``ids_crc32`` is that of the tokens read back.

    Until they lie in their sequences, tokens are stored and shuffled in 16 bits each where a piece's ids fit.
    """
    packed = pack(docs, tokenizer, with_ids=True, short_ids=True)
    path = fresh_folder(docs.sparkSession, "sequences")
    write_sequences(packed, path)
    back = docs.sparkSession.read.schema(packed.schema).parquet(path)
    return back.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
