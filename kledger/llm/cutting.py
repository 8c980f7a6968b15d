"""Packing by concatenating all documents and cutting the stream of tokens into fixed windows.

Pass one tokenises every document, writes its ids and its offset inside its own partition, and sums the tokens
of each partition; prefix sums over those totals give every document its place in one global stream. Pass two
reads the ids back, cuts each document where windows end, and writes every window that lies inside one
partition as it is. A window that crosses from one partition into the next leaves one boundary record on either
side; only those are shuffled and joined. What is left after the last full window is cut into powers of two,
which need no padding, so no sequence is padded at all.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import fresh_folder, running_offset, written

CAPACITY = 1024
FLUSH_BYTES = 8 << 20
DOCS = "array<struct<doc_id: bigint, start: bigint, offset: bigint, length: bigint, doc_tokens: bigint>>"
PART = f"sequence_id bigint, begin bigint, ids binary, docs {DOCS}, whole boolean"
_DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])


class ByteEncoder:
    """``ids(text)`` of a byte-level tokenizer file, as little-endian 32-bit bytes.

    ``ranks`` names the same vocabulary as ranks; most texts then go through the faster reader of that format. Texts
    that hold one of the tokenizer's added strings, or that the fast reader refuses, go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.fast = Tokenizer.from_file(path), None
        with open(path) as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # its pattern gives up on very long white space
                pass
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple, ByteEncoder] = {}


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> ByteEncoder:
    key = (path, ranks, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteEncoder(*key)
    return _ENCODERS[key]


def tokenised(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 0) -> DataFrame:
    """Pass one, written: ``(doc_id, n, ids, task, at)``; ``at`` counts the tokens before the document in its partition."""
    names = ["doc_id", "n", "ids", "task", "at"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, at = encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = enc.ids(text.as_py() or "") + tail
                out.append((doc, len(data) // 4, data, task, at))
                at += len(data) // 4
                held += len(data)
                if held > FLUSH_BYTES:
                    yield _batch(out, types, names)
                    out, held = [], 0
            if out:
                yield _batch(out, types, names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return written(rows.mapInArrow(run, "doc_id bigint, n bigint, ids binary, task int, at bigint"), "cut-tokens")


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def tail_cuts(total: int, capacity: int) -> list[int]:
    """Where sequences end from the last full window on: the rest of the stream in powers of two, largest first."""
    at = total - total % capacity
    cuts = [at]
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        cuts.append(at)
    return cuts


def cut_windows(placed: DataFrame, total: int, capacity: int) -> DataFrame:
    """Pass two: parts of sequences from ``(doc_id, n, ids, start)``. A part that is not its whole sequence is a boundary record."""
    cuts = tail_cuts(total, capacity)
    names = ["sequence_id", "begin", "ids", "docs", "whole"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(_DOC), pa.bool_()]

    def window(g: int) -> tuple[int, int, int]:
        if g < cuts[0]:
            s = g // capacity
            return s, s * capacity, (s + 1) * capacity
        i = bisect_right(cuts, g) - 1
        return cuts[0] // capacity + i, cuts[i], cuts[i + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        seq, low, high, begin, at = -1, 0, 0, 0, -1  # the open window and the part of it that is here
        data: list[bytes] = []
        docs: list[dict] = []

        def close() -> None:
            nonlocal data, docs, held
            if docs:
                out.append((seq, begin - low, b"".join(data), docs, begin == low and at == high))
                held += 4 * (at - begin) + 64 * len(docs)
            data, docs = [], []

        for batch in batches:
            cols = [batch.column(c) for c in ("doc_id", "n", "start")]
            for doc, n, start, ids in zip(*(c.to_pylist() for c in cols), batch.column("ids"), strict=True):
                buf = memoryview(ids.as_buffer())
                g = start
                while g < start + n:
                    if g != at or g >= high:
                        close()
                        seq, low, high = window(g)
                        begin = at = g
                    stop = min(high, start + n)
                    docs.append({"doc_id": doc, "start": g - start, "offset": g - low, "length": stop - g, "doc_tokens": n})
                    data.append(bytes(buf[4 * (g - start) : 4 * (stop - start)]))
                    g = at = stop
                    if held > FLUSH_BYTES:
                        yield _batch(out, types, names)
                        out, held = [], 0
        close()
        if out:
            yield _batch(out, types, names)

    return placed.select("doc_id", "n", "start", "ids").mapInArrow(run, PART)


def _joined(edges: DataFrame) -> DataFrame:
    """Whole sequences out of boundary records: at most ``capacity`` of them, each of a token or more, make one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("begin", "ids", "docs")))
    held = edges.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return held.select("sequence_id", ids.alias("ids"), F.flatten("parts.docs").alias("docs"))


def pack_windows(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Written sequences ``(sequence_id, ids, docs)``: ``ids`` are the tokens, ``docs`` the pieces in it, in order.

    Null and empty texts are their ``end_id`` alone; null ids and repeated rows are documents like others; texts of any
    length are cut whole; further columns of ``docs`` are not read; an empty table gives no sequence. All sequences
    hold ``capacity`` tokens but the last few, which hold powers of two, each another one. A lost task finds
    the same ids at the same offsets, since pass one is written before offsets are given.
    """
    spark = docs.sparkSession
    cut = tokenised(docs, tokenizer, ranks, pattern, end_id)
    totals = written(cut.groupBy("task").agg(F.sum("n").alias("tokens")), "cut-totals")  # one row per partition
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    starts = written(running_offset(totals, "task", "tokens", "base").select("task", "base"), "cut-starts")
    placed = cut.join(starts, "task").withColumn("start", F.col("base") + F.col("at"))  # broadcast only while small
    root = fresh_folder(spark, "windows")
    cut_windows(placed, total, capacity).write.partitionBy("whole").option("compression", "zstd").parquet(f"{root}/cut")
    parts = spark.read.schema(PART).parquet(f"{root}/cut")
    _joined(parts.filter("not whole")).write.option("compression", "zstd").parquet(f"{root}/joined")
    columns = ["sequence_id", "ids", "docs"]
    return parts.filter("whole").select(*columns).unionByName(spark.read.schema(f"sequence_id bigint, ids binary, docs {DOCS}").parquet(f"{root}/joined"))


def pieces_of(sequences: DataFrame) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: every piece, its checksum taken from the sequence's tokens."""
    each = sequences.select("sequence_id", "ids", F.explode("docs").alias("d"))
    own = F.expr("substring(ids, cast(4 * d.offset + 1 as int), cast(4 * d.length as int))")
    return each.select("d.doc_id", "d.start", "d.length", F.crc32(own).alias("ids_crc32"), "d.doc_tokens", "sequence_id", "d.offset")
