"""Groups of similar vectors by an exact rule: two rows link if they share a key and their cosine reaches a threshold.

No hash decides which pairs are compared, so no link is lost. What keeps the work bounded:

* the rows of a key are sorted by their nearest pivot and their angle to it, and cut into cells of bounded size;
* links inside cells, then among one head per linked part of a cell, join most of what is dense;
* every row outside its key's largest connected part then visits the cells of that key, except those whose cap
  (angles around the cell's centre) lies further away than the threshold allows, and those that are in its own part
  already. A pair inside the largest part can add nothing, so every pair that could is compared.

Cells and visitors meet in slices of bounded size; only a visitor's own vectors travel to a cell, and a task returns
pairs of parts, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.operators.graph import components
from kledger.session import discard, written

CELL, PURE, PIVOTS = 256, 64, 64
VISITOR_CELLS, ZONE_CELLS = 64, 2048
HELD_PAIRS, HELD_BYTES = 200_000, 4 << 20
ROW = "key string, id bigint, v array<int>, pivot int, angle double"
CELLS = "key string, cell bigint, ids array<bigint>, parts array<bigint>, pivots array<int>, angles array<double>, vectors binary"


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def reached(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of whole numbers reach the threshold; dots and norms are exact."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :]) >= threshold


def parts_of(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest id reachable from each row over a symmetric matrix of links."""
    order = np.argsort(ids, kind="stable")
    linked = linked[np.ix_(order, order)] | np.eye(len(ids), dtype=bool)
    root = np.arange(len(ids))
    while True:
        low = np.where(linked, root[None, :], len(ids)).min(1)
        low = low[low]
        if (low == root).all():
            break
        root = low
    out = np.empty(len(ids), np.int64)
    out[order] = ids[order][root]
    return out


def _placed(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``ROW`` for nodes (key, id, v): the nearest pivot and the angle to it."""
    sent = nodes.sparkSession.sparkContext.broadcast(pivots)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cos = unit(np.stack(f["v"].to_numpy())) @ sent.value.T
                yield f.assign(pivot=cos.argmax(1).astype(np.int32), angle=np.arccos(np.clip(cos.max(1), -1, 1)))

    return nodes.select("key", "id", "v").mapInPandas(place, ROW)


def _cells(rows: DataFrame, threshold: float, size: int) -> DataFrame:
    """Rows cut into cells in the order of key, pivot, angle; ``parts`` are what links inside the cell connect."""
    names = [c.split()[0] for c in CELLS.split(", ")]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close() -> pd.DataFrame:
            nonlocal held, made
            key, ids, v, pivots, angles = zip(*held, strict=True)
            ids, v = np.array(ids, np.int64), np.stack(v).astype(np.int32)
            row = (key[0], (task << 40) + made, ids.tolist(), parts_of(ids, reached(v, v, threshold)).tolist(), list(pivots), list(angles), v.tobytes())
            held, made = [], made + 1
            return pd.DataFrame([row], columns=names)

        for f in frames:
            for row in f[["key", "id", "v", "pivot", "angle"]].itertuples(index=False, name=None):
                if held and (row[0] != held[0][0] or len(held) >= size or (row[3] != held[-1][3] and len(held) >= min(PURE, size))):
                    yield close()
                held.append(row)
        if held:
            yield close()

    order = ["key", "pivot", "angle", "id"]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, CELLS), "alike-cells")


def _heads(cells: DataFrame) -> DataFrame:
    """One row of every part of every cell: the one whose id names the part."""

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, v = np.asarray(r.ids), np.frombuffer(r.vectors, np.int32).reshape(len(r.ids), -1)
                at = np.flatnonzero(ids == np.asarray(r.parts))
                yield pd.DataFrame({"key": r.key, "id": ids[at], "v": list(v[at]), "pivot": np.asarray(r.pivots)[at], "angle": np.asarray(r.angles)[at]})

    return cells.mapInPandas(heads, ROW)


def _links(cells: DataFrame) -> DataFrame:
    each = cells.select(F.explode(F.arrays_zip("ids", "parts")).alias("p"))
    return each.select(F.col("p.ids").alias("a"), F.col("p.parts").alias("b")).filter("a <> b")


def _visits(cells: DataFrame, threshold: float, visitor_cells: int, zone_cells: int) -> DataFrame:
    """``(cell, parts, vectors)``: rows that must be compared with ``cell``, from one other cell of the same key.

    ``cells`` has (key, cell, parts, main, vectors), ``main`` being the key's largest part.
    """
    wide = float(np.arccos(np.clip(threshold, -1, 1)))

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                u = unit(np.frombuffer(r.vectors, np.int32).reshape(len(r.parts), -1))
                centre = u.mean(0)
                norm = np.sqrt((centre * centre).sum())
                centre = centre / norm if norm > 0 else u[0]
                cap = float(np.arccos(np.clip((u @ centre).min(), -1, 1)))
                pure = int(r.parts[0]) if len(set(r.parts)) == 1 else None
                out.append((r.key, r.cell, centre.tobytes(), cap, pure))
            yield pd.DataFrame(out, columns=["key", "cell", "centre", "cap", "pure"])

    def sliced(rows: DataFrame, size: int, columns: list[str], name: str) -> DataFrame:
        count = rows.groupBy("key").agg(F.ceil(F.count("*") / size).cast("bigint").alias("_n"))
        held = rows.join(count, "key").withColumn(f"{name}_slice", F.pmod(F.xxhash64("cell"), F.col("_n")))
        return held.groupBy("key", f"{name}_slice").agg(F.collect_list(F.struct(*columns)).alias(name))

    zones = cells.mapInPandas(summarise, "key string, cell bigint, centre binary, cap double, pure bigint")
    zones = sliced(zones, zone_cells, ["cell", "centre", "cap", "pure"], "zones")
    outside = cells.filter(F.exists("parts", lambda p: p != F.col("main")))
    visitors = sliced(outside, visitor_cells, ["cell", "parts", "main", "vectors"], "visitors")

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                centres = np.stack([np.frombuffer(z["centre"], np.float64) for z in r.zones])
                caps, names = np.array([z["cap"] for z in r.zones]), [z["cell"] for z in r.zones]
                pure = np.array([-1 if z["pure"] is None else z["pure"] for z in r.zones], np.int64)
                some = np.array([z["pure"] is not None for z in r.zones])
                out, held = [], 0
                for x in r.visitors:
                    parts = np.asarray(x["parts"], np.int64)
                    at = np.flatnonzero(parts != x["main"])
                    own = np.frombuffer(x["vectors"], np.int32).reshape(len(parts), -1)[at]
                    u, parts = unit(own), parts[at]
                    apart = np.arccos(np.clip(u @ centres.T, -1, 1))
                    must = (apart <= caps + wide + 1e-6) & ~(some & (pure == parts[:, None]))
                    for j in np.flatnonzero(must.any(0)):
                        out.append((names[j], parts[must[:, j]].tolist(), own[must[:, j]].tobytes()))
                        held += len(out[-1][2])
                        if held > HELD_BYTES:  # a slice of visitors may have to see every cell of a slice of zones
                            yield pd.DataFrame(out, columns=["cell", "parts", "vectors"])
                            out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=["cell", "parts", "vectors"])

    met = visitors.join(zones, "key").repartition("key", "visitors_slice", "zones_slice")
    return met.mapInPandas(choose, "cell bigint, parts array<bigint>, vectors binary")


def _compare(visits: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of parts with a link between them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for f in frames:
            for r in f.itertuples(index=False):
                mine, theirs = np.asarray(r.own_parts), np.asarray(r.parts)
                x, y = (np.frombuffer(v, np.int32).reshape(n, -1) for v, n in ((r.own_vectors, len(mine)), (r.vectors, len(theirs))))
                i, j = np.nonzero(reached(x, y, threshold) & (mine[:, None] != theirs[None, :]))
                if len(i):
                    both = np.stack([mine[i], theirs[j]], 1)
                    seen.update(map(tuple, np.unique(np.sort(both, axis=1), axis=0).tolist()))
            if len(seen) > HELD_PAIRS:
                yield pd.DataFrame(sorted(seen), columns=["a", "b"])
                seen.clear()
        if seen:
            yield pd.DataFrame(sorted(seen), columns=["a", "b"])

    sent = visits.select("cell", F.col("parts").alias("own_parts"), F.col("vectors").alias("own_vectors"))
    return sent.join(cells.select("cell", "parts", "vectors"), "cell").mapInPandas(run, "a bigint, b bigint").distinct()


def linked_groups(rows: DataFrame, threshold: float, cell: int = CELL, visitor_cells: int = VISITOR_CELLS, zone_cells: int = ZONE_CELLS) -> DataFrame:
    """(id, component) for ``rows`` (id bigint, v array<int>, keys array<string>): the smallest id reachable over links.

    Rows link if they share a key and the cosine of their whole-number vectors is at least ``threshold`` (above 0).
    A zero vector, a null vector and a row without keys link with nothing; null keys are not shared. Ids are unique.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    keys = F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
    usable = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    own = rows.select("id", "v", F.when(usable, F.coalesce(keys, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("keys"))
    nodes = own.filter(F.size("keys") > 0)
    pivots = [r[0] for r in nodes.orderBy(F.xxhash64("id"), "id").select("v").limit(PIVOTS).collect()]  # for the order alone
    if not pivots:
        return own.select("id", F.col("id").alias("component"))
    placed = written(_placed(nodes.select("id", "v", F.explode("keys").alias("key")), unit(np.array(pivots))), "alike-placed")  # range bounds are read from it first
    cells = level = _cells(placed, threshold, cell)
    discard(placed)
    links, before = _links(cells), None
    while True:
        if before is None:
            before = cells.agg(F.sum(F.size("ids"))).first()[0]
        several = level.groupBy("key").agg(F.count("*").alias("cells")).filter("cells > 1").select("key")
        rest = written(_heads(level.join(several, "key", "left_semi")), "alike-heads")
        left = rest.count()
        if left == 0 or left > 0.7 * before:
            break
        level, before = _cells(rest, threshold, cell), left
        links = links.unionByName(_links(level))
        discard(rest)
    parts = written(components(links, nodes.select("id")), "alike-parts")
    flat = cells.select("key", "cell", F.posexplode("ids").alias("at", "id")).join(parts, "id")
    sizes = flat.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    told = flat.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "component"))), lambda x: x["component"]).alias("parts"))
    known = written(cells.drop("parts").join(told, "cell").join(main, "key").select("key", "cell", "parts", "main", "vectors"), "alike-known")
    between = written(_compare(_visits(known, threshold, visitor_cells, zone_cells), known, threshold), "alike-between")
    discard(known, cells)
    joined = components(between, parts.select(F.col("component").alias("id")).distinct())
    final = parts.join(joined.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component").select("id", F.col("whole").alias("component"))
    return own.select("id").join(final, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
