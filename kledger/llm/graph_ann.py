"""Nearest neighbours by largest cosine over robust-pruned directed graphs, one per shard.

Vectors of one direction (to twelve digits of their largest component) are one node with its smallest ids and their
vectors, so copies, also scaled ones, are one node however many there are. Nodes are dealt to shards by a hash of
the direction. A shard's graph grows in batches: a greedy beam search from the
entry proposes neighbours for each new node, relaxed pruning keeps those that no kept neighbour covers, and the
edges go both ways, pruned again where a list overflows. Graphs are written to the shared folder, a file each. Queries
then search every shard by beam search, block by block; a task holds some blocks with their best so far and reads the
graphs from there, so neither graphs nor queries are copied per pair. All of the beam is scored in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kledger.llm.common import arrow_uri, place, written

SHARD_ROWS, DEGREE, BEAM, RELAX = 4096, 32, 96, 1.2
BLOCK, HELD = 256, 8
"""Queries searched at once, and how many such blocks a task holds while it reads the graphs."""
GRAPH = "dim int, shard int, n int, vectors binary, edges binary, entries binary, members binary, ids array<array<bigint>>"
DIGITS = 12


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def beam_search(unit: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the ``beam`` best nodes found per query, best first; -1 where fewer were found."""
    n, q = len(unit), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    cos = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)

    def take(row: np.ndarray, node: np.ndarray) -> None:
        nonlocal ids, cos, done
        key = np.unique(row * n + node)
        row, node = key // n, key % n
        new = ~seen[row, node]
        row, node = row[new], node[new]
        seen[row, node] = True
        if not len(row):
            return
        got = np.einsum("ij,ij->i", queries[row], unit[node])
        count = np.bincount(row, minlength=q)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        wide = int(count.max())
        i2, c2 = np.full((q, wide), -1, np.int64), np.full((q, wide), -np.inf, np.float32)
        i2[row, at], c2[row, at] = node, got
        i2, c2 = np.concatenate([ids, i2], 1), np.concatenate([cos, c2], 1)
        d2 = np.concatenate([done, i2[:, beam:] < 0], 1)
        best = np.argsort(-c2, axis=1, kind="stable")[:, :beam]
        ids, cos, done = (np.take_along_axis(x, best, 1) for x in (i2, c2, d2))

    take(np.repeat(np.arange(q), len(entries)), np.tile(entries, q))
    while True:
        order = np.cumsum(~done, axis=1)
        pick = ~done & (order <= expand)
        row, col = np.nonzero(pick)
        if not len(row):
            return ids, cos
        done[row, col] = True
        near = edges[ids[row, col]]
        ok = near >= 0
        take(np.repeat(row, ok.sum(1)), near[ok].astype(np.int64))


def robust_prune(unit: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Per node at most ``degree`` of its ``pool`` (-1: none): nearest first, dropping what a kept one covers."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    pool = np.sort(pool, axis=1)[:, ::-1]
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    vec = unit[np.maximum(pool, 0)]
    far = np.where(pool >= 0, 2 - 2 * np.einsum("bcd,bd->bc", vec, unit[nodes]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    pool, far = np.take_along_axis(pool, order, 1), np.take_along_axis(far, order, 1)
    vec = np.take_along_axis(vec, order[:, :, None], 1)
    alive = pool >= 0
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = pool[rows, first][some]
        apart = 2 - 2 * np.einsum("bcd,bd->bc", vec, vec[rows, first])
        alive &= ~(some[:, None] & (relax * relax * apart <= far))
        alive[rows, first] = False
    return out


def build_graph(unit: np.ndarray, degree: int, beam: int, relax: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of the graph over unit vectors."""
    n = len(unit)
    slack = 2 * degree
    edges = np.full((n, slack), -1, np.int64)
    fill = np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    mean = unit.mean(0)
    entry = int(np.argmax(unit @ mean))
    order = np.append(entry, order[order != entry])
    done, entries = 1, np.array([entry])
    while done < n:
        batch = order[done : done + min(max(1, done), 512)]
        found, _ = beam_search(unit, edges, entries, unit[batch], beam)
        own = robust_prune(unit, batch, found, degree, relax)
        edges[batch, :degree] = own
        fill[batch] = (own >= 0).sum(1)
        src, dst = np.repeat(batch, (own >= 0).sum(1)), own[own >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        count = np.bincount(dst, minlength=n)
        nth = np.arange(len(dst)) - np.repeat((np.cumsum(count) - count), count)
        at = fill[dst] + nth
        fits = at < slack
        edges[dst[fits], at[fits]] = src[fits]
        over = np.unique(dst[~fits])
        if len(over):
            most = int(count[over].max())
            extra = np.full((n if n < 1 else len(over), most), -1, np.int64)
            slot = np.searchsorted(over, dst)
            mine = (slot < len(over)) & (over[np.minimum(slot, len(over) - 1)] == dst)
            extra[slot[mine], nth[mine]] = src[mine]
            pruned = robust_prune(unit, over, np.concatenate([edges[over], extra], 1), degree, relax)
            edges[over] = -1
            edges[over, :degree] = pruned
        touched = np.unique(dst)
        fill[touched] = (edges[touched] >= 0).sum(1)
        done += len(batch)
        if done > 64 and len(entries) == 1:  # a few spread entries beside the central one
            entries = np.append(entries, order[1:8])
    over = np.flatnonzero(fill > degree)
    for a in range(0, len(over), 512):
        part = over[a : a + 512]
        pruned = robust_prune(unit, part, edges[part], degree, relax)
        edges[part] = -1
        edges[part, :degree] = pruned
    return edges[:, :degree].astype(np.int32), entries.astype(np.int32)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _level(v: np.ndarray) -> np.ndarray:
    """Vectors brought near length one by powers of two: cosines stay the same to the last digit, and no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def build_index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """The written graphs over every usable row of ``vectors`` (vec_id, embedding): one row per shard.

    ``keep`` rows of each direction are listed, smallest ids first; a search for k neighbours that leaves the
    query's own row out needs k + 1. Rows of one direction tie, so the ones left out cannot be among the nearest.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    rows = rows.withColumn("most", most).withColumn("direction", F.transform("embedding", lambda x: F.rint(x / F.col("most") * 10.0**DIGITS) + 0.0)).drop("most")
    nth = F.row_number().over(Window.partitionBy("direction").orderBy("vec_id"))
    some = rows.withColumn("nth", nth).filter(F.col("nth") <= keep)
    nodes = written(some.groupBy("direction").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows")), "ann-nodes")
    total = nodes.count()
    shards = max(1, -(-total // shard_rows))
    dealt = nodes.select("direction", F.col("rows.vec_id").alias("ids"), F.col("rows.embedding").alias("members"), F.size("direction").alias("dim"), F.pmod(F.xxhash64("direction"), F.lit(shards)).cast("int").alias("shard"))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("first").reset_index(drop=True)
        v = np.stack(f["direction"].to_numpy())
        members = np.stack([m for node in f["members"] for m in node])
        edges, entries = build_graph(_unit(v), degree, beam, relax)
        return pd.DataFrame([(int(f["dim"][0]), int(f["shard"][0]), len(f), v.tobytes(), edges.tobytes(), entries.tobytes(), members.tobytes(), [list(map(int, x)) for x in f["ids"]])], columns=[c.split()[0] for c in GRAPH.split(", ")])

    graphs = dealt.withColumn("first", F.get("ids", F.lit(0))).groupBy("dim", "shard").applyInPandas(build, GRAPH)
    return written(graphs, "ann-graphs", maxRecordsPerFile=1)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query (vec_id, embedding), its own row left out.

    Blocks of queries meet every shard of their dimension. Ties go to the smaller id. Unusable queries give no
    row, as do queries without candidates; a repeated query id gives the rows of one. ``index`` is what ``build_index`` wrote.
    """
    q = queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    q = written(q.withColumn("dim", F.size("embedding")), "ann-queries")
    asked, graphs, tasks = q.count(), max(1, index.count()), 2 * q.sparkSession.sparkContext.defaultParallelism
    # few groups of queries: the graphs are divided among several tasks per group
    groups = max(1, -(-asked // (HELD * block)), min(-(-asked // block), -(-tasks // graphs)))
    shares = max(1, min(graphs, -(-tasks // groups)))
    uri = arrow_uri(place(index))

    def stored(share: int, dim: int) -> Iterator[dict]:
        from pyarrow import fs, parquet

        store, base = fs.FileSystem.from_uri(uri)
        for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))[share::shares]:
            with store.open_input_file(path) as f:
                file = parquet.ParquetFile(f)
                if file.metadata.num_rows and file.read(columns=["dim"]).column(0)[0].as_py() == dim:
                    yield file.read().to_pylist()[0]

    def best_of(ids: np.ndarray, vectors: np.ndarray, share: int) -> pd.DataFrame:
        own, dim = _level(vectors), vectors.shape[1]
        unit, best = _unit(own), [[] for _ in ids]
        for r in stored(share, dim):
            v = np.frombuffer(r["vectors"], np.float64).reshape(r["n"], dim)
            members = _level(np.frombuffer(r["members"], np.float64).reshape(-1, dim))
            names, count = np.concatenate(r["ids"]), np.array([len(i) for i in r["ids"]])
            ends, graph = np.cumsum(count), _unit(v)
            edges, entries = np.frombuffer(r["edges"], np.int32).reshape(r["n"], -1), np.frombuffer(r["entries"], np.int32).astype(np.int64)
            for lo in range(0, len(ids), block):
                found, _ = beam_search(graph, edges, entries, unit[lo : lo + block], max(beam, 2 * k))
                for i, nodes in enumerate(found, lo):
                    nodes = nodes[nodes >= 0]
                    per = count[nodes]
                    at = np.repeat(ends[nodes] - np.cumsum(per), per) + np.arange(per.sum())
                    near, vec = members[at], own[i]
                    scores = near @ vec / (np.sqrt((near * near).sum(1)) * np.sqrt(vec @ vec))
                    new = sorted((-s, x) for s, x in zip(scores.tolist(), names[at].tolist(), strict=True) if x != ids[i])[:k]
                    best[i] = sorted({*best[i], *new})[:k]
        return pd.DataFrame([(int(i), x, -s) for i, rows in zip(ids, best, strict=True) for s, x in rows], columns=["query_id", "vec_id", "score"])

    def run(share: int):
        def search_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for f in frames:
                while len(f):
                    held.append(f.iloc[: HELD * block - size])
                    f = f.iloc[len(held[-1]) :]
                    size += len(held[-1])
                    if size == HELD * block:
                        yield from of_dims(pd.concat(held))
                        held, size = [], 0
            if held:
                yield from of_dims(pd.concat(held))

        def of_dims(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, g in f.groupby("dim"):
                yield best_of(g["vec_id"].to_numpy(), np.stack(g["embedding"].to_numpy()), share)

        return search_all

    found = None
    for share in range(shares):
        part = q.repartition(groups).mapInPandas(run(share), "query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, **sizes) -> DataFrame:
    """Index all of ``vectors`` and search it for ``queries``; an empty table on either side gives no row."""
    return search(build_index(vectors, k + 1, **sizes), queries, k)
