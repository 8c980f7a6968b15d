"""Best rows per query, scored block by block.

A block is a slice of the item table times a slice of the query table, scored as one matrix product inside a
task. Two layouts give the same rows:

* scan: up to a checked number of queries travel to every task, the items are read once and never shuffled;
* grid: beyond that bound the items are written once to the shared folder, in id order, and each task holds a bounded
  block of queries with their best so far and reads the item blocks from there. Neither table is copied, nothing
  passes through the driver and no block outgrows memory. Equal queries are scored once.

Either way a task returns at most ``n`` rows per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kledger.session import arrow_uri, discard, place, written

MAX_BROADCAST_QUERIES = 4096
ITEM_BLOCK, QUERY_BLOCK, SLICE = 8192, 1024, 2048
OUT = "qid string, item_id string, score double"


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None. Reads no more than limit + 1 rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def cosine_matrix(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines from integer vectors. Dots and norms are whole numbers, so every engine gets the same quotient."""
    q, v = q.astype(np.float64), v.astype(np.float64)
    den = np.sqrt((q**2).sum(1)[:, None] * (v**2).sum(1)[None, :])
    return np.divide(q @ v.T, den, out=np.zeros((len(q), len(v))), where=den > 0)


def stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def incidence(lists, vocab: dict) -> np.ndarray:
    out = np.zeros((len(lists), max(1, len(vocab))), dtype=np.float32)
    for i, xs in enumerate(lists):
        out[i, [vocab[x] for x in xs if x in vocab]] = 1
    return out


def vocabulary(lists) -> dict:
    return {x: i for i, x in enumerate(sorted({x for xs in lists for x in xs}))}


def score_cosine(q: pd.DataFrame, items: pd.DataFrame) -> np.ndarray:
    return cosine_matrix(stack(q["v"]), stack(items["v"]))


def score_shared_key(q: pd.DataFrame, items: pd.DataFrame) -> np.ndarray:
    """Cosine where the two rows share a key, minus one elsewhere."""
    vocab = vocabulary(q["keys"])
    shared = incidence(q["keys"], vocab) @ incidence(items["keys"], vocab).T
    return np.where(shared > 0, score_cosine(q, items), -1.0)


def score_hybrid(q: pd.DataFrame, items: pd.DataFrame) -> np.ndarray:
    """Even mix of cosine and Jaccard of the gram sets."""
    vocab = vocabulary(q["grams"])
    inter = (incidence(q["grams"], vocab) @ incidence(items["grams"], vocab).T).astype(np.float64)
    nq = np.array([len(g) for g in q["grams"]], dtype=np.float64)[:, None]
    ni = np.array([len(g) for g in items["grams"]], dtype=np.float64)[None, :]
    jac = np.divide(inter, nq + ni - inter, out=np.zeros_like(inter), where=(nq > 0) & (ni > 0))
    return np.round(0.5 * score_cosine(q, items) + 0.5 * jac, 9)


def _pick(scores: np.ndarray, ids: np.ndarray, n: int, floor: float, by_id: bool):
    ok = np.flatnonzero(scores >= floor)
    if by_id:
        return ok[np.argsort(ids[ok], kind="stable")][:n]
    if len(ok) > n:
        cut = np.partition(scores[ok], len(ok) - n)[len(ok) - n]
        ok = ok[scores[ok] >= cut]
    return ok[np.lexsort((ids[ok], -scores[ok]))][:n]


def _block(q: pd.DataFrame, items: pd.DataFrame, score: Callable, n: int, floor: float, by_id: bool) -> pd.DataFrame:
    cols = ["qid", "item_id", "score"]
    if not len(q) or not len(items):
        return pd.DataFrame(columns=cols)
    out = []
    for lo in range(0, len(items), SLICE):  # keeps the score matrix of a task small, whatever the batch size
        part = items.iloc[lo : lo + SLICE]
        ids = part["item_id"].to_numpy(dtype=str)
        m = score(q, part)
        out += [(qid, ids[j], float(m[i, j])) for i, qid in enumerate(q["qid"]) for j in _pick(m[i], ids, n, floor, by_id)]
    return pd.DataFrame(out, columns=cols)


def _sorted(df: pd.DataFrame, by_id: bool) -> pd.DataFrame:
    return df.sort_values("item_id") if by_id else df.sort_values(["score", "item_id"], ascending=[False, True])


def _merged(best: np.ndarray, names: np.ndarray, r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Put candidates (row, score, id), in id order within a row, among the best of their rows; ties keep the earlier id."""
    n = best.shape[1]
    rows = np.unique(r)
    rr = np.concatenate([np.repeat(rows, n), r])
    ss = np.concatenate([best[rows].ravel(), score])
    ii = np.concatenate([names[rows].ravel(), ids])
    order = np.lexsort((np.concatenate([np.tile(np.arange(n), len(rows)), n + np.arange(len(r))]), -ss, rr))
    rr, ss, ii = rr[order], ss[order], ii[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(rr)) + 1])
    rank = np.arange(len(rr)) - np.repeat(first, np.diff(np.append(first, len(rr))))
    keep = rank < n
    best[rr[keep], rank[keep]] = ss[keep]
    names[rr[keep], rank[keep]] = ii[keep]


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v**2).sum(1))[:, None]
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)


class _BestCosines:
    """The best ``n`` items per query of a block, for items that come in id order.

    Single-precision products only tell which pairs cannot be among the best; the others get the exact cosine.
    """

    PAIRS = 1 << 16

    def __init__(self, q: pd.DataFrame, n: int, floor: float):
        self.q, self.n, self.floor = stack(q["v"]).astype(np.float64), n, floor
        self.unit, self.norm2 = _unit(self.q), (self.q**2).sum(1)
        self.slack = np.float32(1.3e-7 * (self.q.shape[1] + 8))
        self.best, self.names = np.full((len(q), n), -np.inf), np.empty((len(q), n), object)

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        v = v.astype(np.float64)
        about, norm2 = self.unit @ _unit(v).T, (v**2).sum(1)
        low = np.maximum(self.best[:, -1], self.floor).astype(np.float32) - self.slack
        some = about >= low[:, None]
        if len(v) > self.n and np.count_nonzero(some) > 4 * self.n * len(self.q):
            kth = np.partition(about, len(v) - self.n, axis=1)[:, len(v) - self.n]
            some = about >= np.maximum(low, kth - 2 * self.slack)[:, None]
        r, c = np.nonzero(some)
        parts = []
        for lo in range(0, len(r), self.PAIRS):
            a, b = r[lo : lo + self.PAIRS], c[lo : lo + self.PAIRS]
            den = np.sqrt(self.norm2[a] * norm2[b])
            parts.append(np.divide(np.einsum("ij,ij->i", self.q[a], v[b]), den, out=np.zeros(len(a)), where=den > 0))
        if parts:
            exact = np.concatenate(parts)
            ok = (exact > self.best[r, -1]) & (exact >= self.floor)  # a later id with an equal score stays behind
            if ok.any():
                _merged(self.best, self.names, r[ok], exact[ok], ids[c[ok]])

    def rows(self, qid: np.ndarray) -> pd.DataFrame:
        r, k = np.nonzero(self.best > -np.inf)
        return pd.DataFrame({"qid": qid[r], "item_id": self.names[r, k], "score": self.best[r, k]})


def _grid(items: DataFrame, queries: DataFrame, score: Callable, n: int, floor: float, by_id: bool) -> DataFrame:
    """The rows of ``top_matches`` for any number of queries."""
    spark = items.sparkSession
    cores = spark.sparkContext.defaultParallelism
    asked = written(queries.select("qid", *[c for c in queries.columns if c != "qid"]), "match-queries")
    keys = [c for c in asked.columns if c != "qid"]
    once = written(asked.select(keys).distinct().select(F.monotonically_increasing_id().cast("string").alias("qid"), *keys), "match-once")
    read = written(items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("None"))), "match-read")
    fast = score is score_cosine and not by_id and n <= SLICE
    if fast:  # of items with one vector only the first n can be among the best
        copy, every = F.row_number().over(Window.partitionBy("v").orderBy("item_id")), read
        read = written(every.withColumn("_copy", copy).filter(F.col("_copy") <= n).drop("_copy"), "match-few")
        discard(every)
    n_items, blocks = read.count(), max(1, -(-once.count() // (4 * QUERY_BLOCK)))
    # few query blocks: the items are divided among several tasks per block
    shares = max(1, min(-(-n_items // ITEM_BLOCK), -(-2 * cores // blocks)))
    table = written(read.repartitionByRange(max(shares, -(-n_items // (16 * ITEM_BLOCK))), "item_id").sortWithinPartitions("item_id"), "match-items")
    discard(read)
    uri, columns = arrow_uri(place(table)), table.columns

    def item_blocks(share: int):
        from pyarrow import fs, parquet

        store, base = fs.FileSystem.from_uri(uri)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))
        for path in files[share::shares]:
            with store.open_input_file(path) as f:
                yield from parquet.ParquetFile(f).iter_batches(SLICE, columns=columns)

    def cosines(q: pd.DataFrame, share: int) -> pd.DataFrame:
        held = _BestCosines(q, n, floor)
        for b in item_blocks(share):
            v = b.column(columns.index("v"))
            held.add(np.array(b.column(0).to_pylist(), object), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1))
        return held.rows(q["qid"].to_numpy())

    def any_score(q: pd.DataFrame, share: int) -> pd.DataFrame:
        best = None
        for b in item_blocks(share):
            new = _block(q, b.to_pandas(), score, n, floor, by_id)
            best = _sorted(new if best is None else pd.concat([best, new]), by_id).groupby("qid", sort=False).head(n)
        return pd.DataFrame(columns=["qid", "item_id", "score"]) if best is None else best

    def cells(share: int):
        def run(batches):
            held, size = [], 0
            for pdf in batches:
                while len(pdf):
                    held.append(pdf.iloc[: 4 * QUERY_BLOCK - size])
                    pdf = pdf.iloc[len(held[-1]) :]
                    size += len(held[-1])
                    if size == 4 * QUERY_BLOCK:
                        yield (cosines if fast else any_score)(pd.concat(held), share)
                        held, size = [], 0
            if held:
                yield (cosines if fast else any_score)(pd.concat(held), share)

        return run

    out = None
    for share in range(shares):
        part = once.repartition(blocks).mapInPandas(cells(share), OUT)
        out = part if out is None else out.unionByName(part)
    same = asked.join(once.withColumnRenamed("qid", "_rep"), keys).select("qid", "_rep")
    out = out.withColumnRenamed("qid", "_rep")
    if not asked.groupBy("qid").count().filter("count > 1").isEmpty():
        return _ranked(out.join(same, "_rep").select("qid", "item_id", "score"), "qid", n, by_id)
    # ranked before equal queries take their rows: the rows per query are shuffled once, by what stands for the query
    return _ranked(out, "_rep", n, by_id).join(same, "_rep").select("qid", "item_id", "score", "rank")


def _ranked(part: DataFrame, key: str, n: int, by_id: bool) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(["item_id"] if by_id else [F.desc("score"), "item_id"]))
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_matches(items: DataFrame, queries: DataFrame, score: Callable, n: int, floor: float = -0.5, by_id: bool = False, force_grid: bool = False, max_queries: int | None = None) -> DataFrame:
    """(qid, item_id, score, rank): the best ``n`` items per query with a score of at least ``floor``.

    ``items`` starts with item_id, ``queries`` with qid; the other columns are what ``score`` reads. ``by_id``
    keeps the first ``n`` item ids above the floor instead of the best scores.
    """
    rows = None if force_grid else bounded_rows(queries, max_queries or MAX_BROADCAST_QUERIES)
    if rows is not None:
        shared = items.sparkSession.sparkContext.broadcast(pd.DataFrame([r.asDict() for r in rows], columns=queries.columns))

        def scan(batches):
            q, best = shared.value, None
            for pdf in batches:
                new = _block(q, pdf, score, n, floor, by_id)
                both = new if best is None else pd.concat([best, new])
                best = _sorted(both, by_id).groupby("qid", sort=False).head(n)
            if best is not None:
                yield best

        return _ranked(items.mapInPandas(scan, OUT), "qid", n, by_id)
    return _grid(items, queries, score, n, floor, by_id)


def top_matches_grouped(items: DataFrame, queries: DataFrame, score: Callable, n: int, floor: float = -0.5, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Like ``top_matches``, comparing only rows of the same ``group`` (a row may stand in several groups).

    A large group is cut into slices of fixed size, so a group with a third of all rows becomes many small
    cells instead of one task, and a cell returns at most ``n`` rows per query instead of its pairs.
    """
    def slices(df, size, name):
        return df.groupBy("group").agg(F.ceil(F.count("*") / size).cast("bigint").alias(name))

    sizes = slices(items, item_block, "_ni").join(slices(queries, query_block, "_nq"), "group")
    zero = F.lit(0).cast("bigint")
    left = items.join(sizes, "group").withColumn("_n", F.pmod(F.xxhash64("item_id"), F.col("_ni"))).withColumn("_q", F.explode(F.sequence(zero, F.col("_nq") - 1))).drop("_ni", "_nq")
    right = queries.join(sizes, "group").withColumn("_q", F.pmod(F.xxhash64("qid"), F.col("_nq"))).withColumn("_n", F.explode(F.sequence(zero, F.col("_ni") - 1))).drop("_ni", "_nq")
    keys = ["group", "_n", "_q"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _block(b, a, score, n, floor, False), OUT)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "item_id")
    once = part.groupBy("qid", "item_id").agg(F.max("score").alias("score"))  # a pair may meet in several groups
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
