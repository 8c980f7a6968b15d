"""Helpers shared by the training-data operators: the shared folder, written tables, byte views of text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a maximal run of characters other than ASCII white space."""


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kledger-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """``df`` as a table in the shared folder. It is computed once, and lost executors do not take it with them."""
    path = fresh_folder(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (weakref.ref(out), path)
    return out


_PLACES: dict[int, tuple[weakref.ref, str]] = {}

ROWS_A_TASK = 4096


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which holds about ``rows`` rows, in no more tasks than they fill (``ROWS_A_TASK`` each); a large table is left as it is.

    A step over small tables costs its tasks, not its rows, whatever the number of shuffle partitions is.
    """
    most, tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-rows // ROWS_A_TASK))
    return df.coalesce(tasks) if tasks < most else df


def place(df: DataFrame) -> str:
    """The folder of a written table."""
    ref, path = _PLACES[id(df)]
    if ref() is not df:
        raise KeyError("not a written table")
    return path


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        ref, path = _PLACES.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def running_offset(sizes: DataFrame, key: str, size: str, name: str, block: int = 4096) -> DataFrame:
    """Per row of ``sizes`` (one per integer ``key``) the sum of ``size`` over smaller keys.

    Blocks of keys are summed on their own and only one row per block crosses blocks, level by level, so no
    task sorts more than ``block`` rows however many keys there are.
    """
    from pyspark.sql import Window

    top = sizes.agg(F.max(key)).first()[0]
    inside = Window.partitionBy("_blk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    b = sizes.withColumn("_blk", F.floor(F.col(key) / block).cast("bigint"))
    own = b.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("bigint"))
    if top is None or top < block:
        return own.withColumnRenamed("_in", name).drop("_blk")
    per = b.groupBy("_blk").agg(F.sum(size).cast("bigint").alias("_sz"))
    above = running_offset(per.withColumnRenamed("_blk", "_k"), "_k", "_sz", "_off", block).select(F.col("_k").alias("_blk"), "_off")
    return own.join(above, "_blk").withColumn(name, F.col("_in") + F.col("_off")).drop("_blk", "_in", "_off")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose bytes stay near ``limit``; a longer row stands alone. Every row is in one range."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def arrow_uri(path: str) -> str:
    """Hadoop writes ``file:/x``; Arrow's file systems want ``file:///x``."""
    return re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}"


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """64-bit hashes of any spans of a byte array, from one prefix sum (a polynomial modulo 2**64, then mixed)."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.prefix[1:])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.down[a] + (b - a).astype(np.uint64))


class Words:
    """Words of consecutive texts in one byte array: ``start``, ``end``, ``doc`` and a 64-bit ``hash`` of each."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        space = SPACE[raw]
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= space[1:]
        tails = offs[1:][offs[:-1] < offs[1:]] - 1
        last[tails] = inside[tails]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.hashes = Hashes(raw)
        self.hash = self.hashes.spans(self.start, self.end)
        self.count = np.bincount(self.doc, minlength=len(offs) - 1)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``n`` words inside one text."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = words.hash[:m].copy()
    for k in range(1, n):
        key = key * np.uint64(0x100000001B3) + words.hash[k : m + k]
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    return at, mix(key[at])
