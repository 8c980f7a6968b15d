"""Hard negatives by windows of inner products over Hilbert-ordered blocks with zone maps.

Rows with one vector and one label are one node with its smallest ids. Nodes are range-sorted by length, label and
place on a Hilbert curve and written as blocks, each with the least and greatest value of every dimension. For an
anchor, interval arithmetic over such a zone map bounds every inner product in the block. A search for the best rows
of a window of scores first reads the blocks with the highest bounds; what it finds there narrows the window, and
a second pass reads exactly the blocks whose bounds still meet it. The positives are one such search (own label,
all scores); each of them opens a window for the search among the other labels.

Anchors and zone maps meet in cells of bounded slices; a block travels once to the anchors that must read it, and
tasks keep only the best rows per anchor and window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kledger.llm.common import written

BLOCK_ROWS, PURE_ROWS, BLOCK_BYTES = 1024, 256, 4 << 20
ASKS, ZONES, SEEDS = 512, 2048, 2
HILBERT_DIMS, HILBERT_BITS = 64, 2
HELD_ROWS = 200_000
LOW, HIGH = -(2**63), 2**63 - 1
EXACT = 2.0**53
BLOCK = "block bigint, dim int, n int, label_min bigint, label_max bigint, zone_min binary, zone_max binary, vectors binary, labels binary, ids binary, ends binary"
ASK = "ask bigint, dim int, label bigint, vec_id bigint, vector array<double>, windows array<struct<lo: bigint, hi: bigint>>"


def usable_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part, each once; ``vector`` holds whole numbers as doubles."""
    e = F.col(vector_col).cast("array<double>")
    scaled = F.transform(e, lambda x: x * 256)
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), e.alias("e"), scaled.alias("s"), bad.alias("bad"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~F.col("bad"))
    # floor() of a double is a long in Spark; beyond 2**53 every double is whole already
    whole = F.transform("s", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), whole.alias("vector"))


def hilbert_keys(v: np.ndarray, bits: int = HILBERT_BITS, dims: int = HILBERT_DIMS) -> list[bytes]:
    """Places on a Hilbert curve over the first ``dims`` dimensions, each cut into 2**bits steps of the vector's own length.

    Zero lies in the middle of a step, so that small values of either sign fall together.
    """
    v = v[:, :dims]
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    scaled = v / np.where(norm > 0, norm, 1) * np.sqrt(v.shape[1])
    return hilbert_places(np.clip((scaled + 2) / 4 * (1 << bits) + 0.5, 0, (1 << bits) - 1).astype(np.uint32), bits)


def hilbert_places(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place on the curve of each cell of a grid with 2**bits steps a side, as bytes in the curve's order."""
    x = cells.copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:  # axes to the transposed Hilbert index, one bit plane after another
        p = q - 1
        for i in range(d):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap.astype(np.uint32)
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, d - 1] & q) > 0, t ^ (q - 1), t).astype(np.uint32)
        q >>= 1
    x ^= t[:, None]
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)], 1).astype(np.uint8)
    return [r.tobytes() for r in np.packbits(planes.reshape(n, -1), axis=1)]


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """``(label, vector, ids)``: rows of one vector and label as one node with their ``keep`` smallest different ids."""
    place = F.dense_rank().over(Window.partitionBy("vector", "label").orderBy("vec_id"))
    some = rows.withColumn("place", place).filter(F.col("place") <= keep)
    return some.groupBy("vector", "label").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def build_blocks(rows: DataFrame, keep: int, block_rows: int = BLOCK_ROWS, pure_rows: int = PURE_ROWS) -> DataFrame:
    """The written blocks of all rows: nodes in the order of length, label and Hilbert place, cut every ``block_rows`` nodes.

    A block of ``pure_rows`` or more also ends where the label changes.
    """
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = np.empty(len(f), object)
            for dim, at in f.groupby("dim").indices.items():
                keys[at] = hilbert_keys(np.stack(f["vector"].to_numpy()[at]).reshape(len(at), dim))
            yield f.assign(place=keys)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close() -> pd.DataFrame:
            nonlocal held, made
            v = np.stack([r[1] for r in held])
            labels, counts = np.array([r[0] for r in held], np.int64), [len(r[2]) for r in held]
            ids = np.concatenate([np.asarray(r[2], np.int64) for r in held])
            row = ((task << 40) + made, v.shape[1], len(held), int(labels.min()), int(labels.max()), v.min(0).tobytes(), v.max(0).tobytes(), v.tobytes(), labels.tobytes(), ids.tobytes(), np.cumsum(counts, dtype=np.int64).tobytes())
            held, made = [], made + 1
            return pd.DataFrame([row], columns=names)

        for f in frames:
            for label, vector, ids in zip(f["label"], f["vector"], f["ids"], strict=True):
                if held:
                    other = len(vector) != len(held[0][1])
                    full = len(held) >= block_rows or len(held) * 8 * len(vector) >= BLOCK_BYTES
                    if other or full or (label != held[-1][0] and len(held) >= pure_rows):
                        yield close()
                held.append((label, np.asarray(vector, np.float64), ids))
        if held:
            yield close()

    sized = nodes_of(rows, keep).withColumn("dim", F.size("vector"))
    keyed = written(sized.mapInPandas(place, "vector array<double>, label bigint, ids array<bigint>, dim int, place binary"), "negative-nodes")
    order = ["dim", "label", "place", F.get("ids", F.lit(0))]
    blocks = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "vector", "ids").mapInPandas(cut, BLOCK)
    return written(blocks, "negative-blocks")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as 64-bit integers; what lies beyond is the nearest 64-bit integer."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in r] for r in m] for m in (a, b))
    exact = [[min(max(sum(x * y for x, y in zip(u, v, strict=True)), LOW), HIGH) for v in right] for u in left]
    return np.array(exact, np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each vector of ``a`` with any vector between ``low`` and ``high``."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(all="ignore"):
        most, least = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
        slack = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-9  # far over the rounding of the sums
        least, most = least - slack, most + slack
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def _best(ask: np.ndarray, hi: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each (ask, hi), by score, largest first, then id."""
    order = np.lexsort((vec, ~score, hi, ask))  # ~score reverses the order without overflow
    a, h = ask[order], hi[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def _slices(asks: DataFrame) -> DataFrame:
    """Asks packed into slices of one dimension: rows (slice, dim, asks), about ``ASKS`` in each."""
    return asks.groupBy("dim", "slice").agg(F.collect_list(F.struct("ask", "label", "vec_id", "vector", "windows")).alias("asks"))


def chosen(slices: DataFrame, zones: DataFrame, same: bool, seeds: int | None) -> DataFrame:
    """``(slice, dim, block, at)``: the blocks whose bounds meet a window of an ask, and the places of those asks in the slice.

    With ``seeds`` only the so many blocks of the highest bounds are named for each ask and slice of zone maps.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                a = np.stack([x["vector"] for x in r.asks])
                label = np.array([x["label"] for x in r.asks], np.int64)
                low, high = (np.stack([np.frombuffer(z[c], np.float64) for z in r.zones]) for c in ("zone_min", "zone_max"))
                first, last = (np.array([z[c] for z in r.zones], np.int64) for c in ("label_min", "label_max"))
                least, most = bounds(a, low, high)
                meets = np.zeros(most.shape, bool)
                for i, x in enumerate(r.asks):
                    for w in x["windows"]:
                        meets[i] |= (most[i] >= w["lo"]) & (least[i] <= w["hi"])
                if same:
                    meets &= (first <= label[:, None]) & (label[:, None] <= last)
                else:
                    meets &= (first != label[:, None]) | (last != label[:, None])
                if seeds is not None and meets.shape[1] > seeds:
                    ranked = np.argsort(np.where(meets, -most, np.inf), axis=1, kind="stable")[:, :seeds]
                    top = np.zeros_like(meets)
                    np.put_along_axis(top, ranked, True, axis=1)
                    meets &= top
                out = [(r.slice, r.dim, z["block"], np.flatnonzero(meets[:, j]).tolist()) for j, z in enumerate(r.zones) if meets[:, j].any()]
                yield pd.DataFrame(out, columns=["slice", "dim", "block", "at"])

    cells = slices.join(zones, "dim")  # both sides are few: a slice is hundreds of asks, a cell of zones thousands of blocks
    return cells.repartition("slice", "cell").mapInPandas(run, "slice bigint, dim int, block bigint, at array<int>")


def read_windows(picked: DataFrame, slices: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """``(ask, lo, hi, score, vec_id)``: the first ``k`` rows of every window within the blocks that its ask must read."""
    names = ["ask", "hi", "score", "vec_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> list[np.ndarray]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            best = _best(*cols, k)
            return [c[best] for c in cols]

        for f in frames:
            for r in f.itertuples(index=False):
                v = np.frombuffer(r.vectors, np.float64).reshape(r.n, r.dim)
                labels, ids, ends = (np.frombuffer(x, np.int64) for x in (r.labels, r.ids, r.ends))
                count = np.diff(ends, prepend=0)
                asks = [r.asks[i] for i in r.at]
                score = products(np.stack([x["vector"] for x in asks]), v)
                for i, x in enumerate(asks):
                    fits = (labels == x["label"]) if same else (labels != x["label"])
                    for w in x["windows"]:
                        at = np.flatnonzero(fits & (score[i] >= w["lo"]) & (score[i] <= w["hi"]))
                        if len(at) > k + 1:  # k nodes beside the anchor's own, and all that tie with the last of them
                            kth = np.partition(score[i][at], len(at) - k - 1)[len(at) - k - 1]
                            at = at[score[i][at] >= kth]
                        if not len(at):
                            continue
                        per = count[at]
                        flat = np.repeat(ends[at] - np.cumsum(per), per) + np.arange(per.sum())
                        vec, s = ids[flat], np.repeat(score[i][at], per)
                        other = vec != x["vec_id"]
                        vec, s = vec[other], s[other]
                        a, h = np.full(len(vec), x["ask"], np.int64), np.full(len(vec), w["hi"], np.int64)
                        best = _best(a, h, s, vec, k)
                        held.append((a[best], h[best], s[best], vec[best]))
                        size += len(best)
                if size > HELD_ROWS:
                    held = [tuple(merged())]
                    size = len(held[0][0])
                    if size > HELD_ROWS // 2:
                        yield pd.DataFrame(dict(zip(names, held[0], strict=True)))
                        held, size = [], 0
        if held:
            yield pd.DataFrame(dict(zip(names, merged(), strict=True)))

    read = picked.join(slices, ["dim", "slice"]).join(blocks.drop("dim", "label_min", "label_max", "zone_min", "zone_max"), "block")
    found = read.select("dim", "n", "at", "asks", "vectors", "labels", "ids", "ends").mapInPandas(run, "ask bigint, hi bigint, score bigint, vec_id bigint")
    rank = F.row_number().over(Window.partitionBy("ask", "hi").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(asks: DataFrame, blocks: DataFrame, zones: DataFrame, same: bool, k: int, seeds: int = SEEDS) -> DataFrame:
    """``(ask, hi, score, vec_id, rank)``: the first ``k`` rows of every window of every ask, exactly, in two passes."""
    slices = written(_slices(asks), "negative-asks")
    first = written(read_windows(chosen(slices, zones, same, seeds), slices, blocks, same, k), "negative-first")
    reached = first.filter(F.col("rank") == k).select("ask", "hi", F.col("score").alias("least"))  # k rows lie at or above it
    each = asks.withColumn("w", F.explode("windows")).select("*", F.col("w.hi").alias("hi")).join(reached, ["ask", "hi"], "left")
    window = F.struct(F.greatest("w.lo", "least").alias("lo"), "hi")
    narrow = each.groupBy("ask", "dim", "slice", "label", "vec_id", "vector").agg(F.collect_list(window).alias("windows"))
    again = written(_slices(narrow), "negative-asks")
    return read_windows(chosen(again, zones, same, None), again, blocks, same, k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, seeds: int = SEEDS, block_rows: int = BLOCK_ROWS, asks: int = ASKS, zones: int = ZONES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are rows whose id ``every`` divides. Rows without an id, a label or a vector, with an empty vector, or with
    a component that is null or not finite (also after scaling) take no part. Equal rows count once; rows of one id that
    differ are rows of their own, but never partners of each other. Only vectors of one length meet. A score beyond
    64 bits counts as the nearest 64-bit number. Ties go to the smaller id. An empty table gives no row, as does an
    anchor without positives; further columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable_rows(vectors), "negative-rows")
    blocks = build_blocks(rows, max(positives + 1, negatives), block_rows)
    cells = written(blocks.select("block", "dim", "label_min", "label_max", "zone_min", "zone_max", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // zones)))).alias("cell")), "negative-zones")
    maps = written(cells.groupBy("dim", "cell").agg(F.collect_list(F.struct("block", "label_min", "label_max", "zone_min", "zone_max")).alias("zones")), "negative-maps")
    own = rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("dim", F.size("vector"))
    anchors = written(own.select(F.monotonically_increasing_id().alias("ask"), "dim", "label", "vec_id", "vector"), "negative-anchors")
    dealt = anchors.withColumn("slice", F.pmod(F.xxhash64("ask"), F.lit(max(1, -(-anchors.count() // asks)))))
    everything = F.array(F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")))
    near = written(search(dealt.withColumn("windows", everything), blocks, maps, True, positives, seeds).select("ask", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")
    least = F.ceil(F.col("positive_score").cast("decimal(20,0)") * percent / 100).cast("bigint")
    windows = near.filter("positive_score >= 0").groupBy("ask").agg(F.collect_set(F.struct(least.alias("lo"), F.col("positive_score").alias("hi"))).alias("windows"))  # at most ``positives``
    hard = search(dealt.join(windows, "ask"), blocks, maps, False, negatives, seeds)
    pairs = near.join(hard.select("ask", F.col("hi").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["ask", "positive_score"])
    return pairs.join(anchors.select("ask", F.col("vec_id").alias("anchor_id")), "ask").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
