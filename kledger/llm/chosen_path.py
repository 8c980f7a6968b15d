"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets are one class from the start, so exact copies
cost one row. Each class keeps a sketch: for ``COORDS`` hash functions, the smallest value over the set. Every
tree starts from one coordinate and branches the classes by the value there; a node with few members is compared
exhaustively, a larger one selects further coordinates (a function of the node, so all its members agree) and
branches again. Two sets of similarity s share a branch with probability s, so ``TREES`` independent trees miss
a pair of similarity 0.8 with probability 0.2**TREES where nodes are small.

Nodes compare sketches with a wide margin and give loose links (a forest per node, never all pairs). Each
loose component then compares its members' full sets, and those confirmed links make the result. The first trees
label what is connected anyway, so later ones leave nodes of one label alone. A large group is cut into cells; what
stands outside its largest connected part then meets every member, so no link between parts is lost. Members lie in the
shared folder, in group order; a task holds some of the visitors and reads the members a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import LOWER, ROWS_A_TASK, Words, arrow_uri, discard, few_tasks, mix, place, slices, text_bytes, windows, written
from kledger.llm.components import components

COORDS, TREES, FIRST, DEPTH, LEAF, WIDER = 64, 12, 3, 4, 96, 4
# a node of sketches may be WIDER times as large as a cell of full sets
LOOSE = 0.5
"""Sketches that agree in this share are compared in full: six standard errors below 0.8 at 64 coordinates."""
CHUNK = 1 << 17
HELD_BYTES = 4 << 20
"""A task holds no more of a group's visitors at once (or one)."""


def shingle_sets(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): per text the sorted distinct 64-bit hashes of its ``n``-word shingles, ASCII letters lowered.

    A text of 1 to n-1 words is one shingle; one without words has none.
    """
    w = Words(LOWER[raw], offs)
    at, key = windows(w, n)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        first = np.searchsorted(w.doc, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = w.count[short] > k
            whole[has] = whole[has] * np.uint64(0x100000001B3) + w.hash[first[has] + k]
        whole = mix(whole + w.count[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        key, doc = np.concatenate([key, whole])[order], np.concatenate([doc, short])[order]
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        key[a:b].sort()
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    return key, np.searchsorted(doc, np.arange(len(offs)))


def _functions(coords: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * coords + 1, dtype=np.uint64))
    return (r[:coords] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[coords:] >> np.uint64(32)).astype(np.uint32)


def _sums(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    s = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys, out=s[1:])
    return s[bounds[1:]] - s[bounds[:-1]]


def sketches(docs: DataFrame, n: int, coords: int = COORDS) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, sketch, tiny)`` per row; ``set_a`` and ``set_b`` fingerprint the whole set.

    ``tiny`` is the last byte of each coordinate: enough to tell how many agree.
    """
    mul, xor = _functions(coords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for lo, hi in slices(offs, CHUNK):
                key, bounds = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                low = np.zeros((hi - lo, coords), np.uint32)
                if len(full):
                    k32 = (key >> np.uint64(32)).astype(np.uint32)
                    for c in range(coords):
                        h = (k32 ^ xor[c]) * mul[c]
                        h ^= h >> np.uint32(15)
                        h *= np.uint32(0x2C1B3C6D)
                        low[full, c] = np.minimum.reduceat(h, bounds[full])
                a, b = _sums(key, bounds), _sums(mix(key), bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array((np.arange(hi - lo + 1) * coords).astype(np.int32)), pa.array(low.view(np.int32).ravel())), pa.array([r.tobytes() for r in low.astype(np.uint8)], pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "tiny"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch array<int>, tiny binary")


def _full_sets(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (grp, id, text, set_a, set_b) with the set as bytes in ``data`` instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            want = batch.column("set_a").to_numpy(), batch.column("set_b").to_numpy()
            for lo, hi in slices(offs, CHUNK):
                key, bounds = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], n)
                own = (_sums(key, bounds).view(np.int64) == want[0][lo:hi]) & (_sums(mix(key), bounds).view(np.int64) == want[1][lo:hi])
                at = np.flatnonzero(own)  # a repeated id may come with another text
                data = [key[bounds[i] : bounds[i + 1]].tobytes() for i in at]
                cut = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([cut.column("grp").take(pa.array(at)), cut.column("id").take(pa.array(at)), pa.array(data, pa.binary())], ["grp", "id", "data"])

    return rows.mapInArrow(run, "grp bigint, id bigint, data binary").dropDuplicates(["grp", "id"])


def _agree(data: list[bytes], share: float) -> np.ndarray:
    """Which pairs of sketches agree in at least ``share`` of their coordinates."""
    s = np.stack([np.frombuffer(d, np.uint8) for d in data])
    return np.stack([(s == row).sum(1) for row in s]) >= share * s.shape[1]


def _similar(data: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of full sets reach the similarity, in whole numbers."""
    sets = [np.frombuffer(d, np.uint64) for d in data]
    size = np.array([len(s) for s in sets])
    key, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    key, owner = key[shared], owner[shared]
    run = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    inter = np.zeros((len(sets), len(sets)))
    step = 32768
    for a in range(0, int(run[-1]) + 1 if len(run) else 0, step):
        lo, hi = np.searchsorted(run, [a, a + step])
        m = np.zeros((step, len(sets)), np.float32)
        m[run[lo:hi] - a, owner[lo:hi]] = 1
        inter += m.T @ m
    return 100 * inter >= percent * (size[:, None] + size[None, :] - inter)


def _forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each id to the smallest id it is connected with."""
    root = np.arange(len(ids))
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = i, j
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    out = []
    for i in range(len(ids)):
        r = i
        while root[r] != r:
            r = root[r]
        if r != i:
            out.append((int(ids[i]), int(ids[r])))
    return out


def _bridges(ids: np.ndarray, label: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs that join ids of different labels, at most one fewer than there are labels."""
    _, part = np.unique(label, return_inverse=True)
    out = []
    for i in range(len(ids)):
        row = linked[i].copy()
        while True:
            row &= part != part[i]
            j = int(np.argmax(row))
            if not row[j]:
                break
            out.append((int(ids[i]), int(ids[j])))
            part[part == part[j]] = part[i]
    return out


class _Sketches:
    """Visitors that meet further sketches."""

    def __init__(self, data: list[bytes], share: float):
        self.own, self.share = np.stack([np.frombuffer(d, np.uint8) for d in data]), share

    def linked(self, data: list[bytes]) -> np.ndarray:
        s = np.stack([np.frombuffer(d, np.uint8) for d in data])
        return np.stack([(s == row).sum(1) for row in self.own]) >= self.share * s.shape[1]


class _Sets:
    """Visitors that meet further full sets. Only keys that both sides hold enter the product."""

    def __init__(self, data: list[bytes], percent: float):
        sets = [np.frombuffer(d, np.uint64) for d in data]
        self.size, self.percent = np.array([len(x) for x in sets]), int(percent)
        self.key, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(self.at, kind="stable")
        self.at, self.owner = self.at[order], self.owner[order]

    def linked(self, data: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(d, np.uint64) for d in data]
        size = np.array([len(x) for x in sets])
        key, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        at = np.searchsorted(self.key, key)
        hit = np.flatnonzero((at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] == key))
        column, theirs = np.unique(at[hit], return_inverse=True)
        order = np.argsort(theirs, kind="stable")
        theirs, owner = theirs[order], owner[hit][order]
        rank = np.full(len(self.key), -1)
        rank[column] = np.arange(len(column))
        ours, mine = rank[self.at], self.owner
        ours, mine = ours[ours >= 0], mine[ours >= 0]
        inter, step = np.zeros((len(self.size), len(sets))), 4096
        for a in range(0, len(column), step):
            x, y = (np.zeros((min(step, len(column) - a), n), np.float32) for n in (len(self.size), len(sets)))
            for m, col, who in ((x, ours, mine), (y, theirs, owner)):
                lo, hi = np.searchsorted(col, [a, a + step])
                m[col[lo:hi] - a, who[lo:hi]] = 1
            inter += x.T @ y
        return 100 * inter >= self.percent * (self.size[:, None] + size[None, :] - inter)


def _gathered(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of ``by``, which come next to each other."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        keys = [t.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
            yield t.slice(a, b - a)
        rest = t.slice(int(cuts[-1]) if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(rows: DataFrame, kind: str, level: float, count: int) -> DataFrame:
    """Edges of each (grp, cell) of ``rows``, about ``count`` rows. Without labels: from each id to the smallest id it is connected with.

    With labels (ids of one label are connected already): links between labels.
    """
    labelled = "label" in rows.columns

    def edges(t: pa.Table) -> list[tuple[int, int]]:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
        data = t.column("data").take(pa.array(order)).to_pylist()
        if len(order) < 2:
            return []
        linked = _agree(data, level) if kind == "sketch" else _similar(data, int(level))
        if not labelled:
            return _forest(ids[order], linked)
        return _bridges(ids[order], t.column("label").to_numpy()[order], linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, ["grp", "cell"]):
            if found := edges(t):
                yield _pairs(found)

    cells = few_tasks(rows.select("grp", "cell", "id", "data", *(["label"] if labelled else [])), count)
    cells = cells.repartition("grp", "cell").sortWithinPartitions("grp", "cell")
    return few_tasks(cells.mapInArrow(run, "a bigint, b bigint"), count)


def _visits(rows: DataFrame, kind: str, level: float, leaf: int, count: int) -> DataFrame:
    """Links between labels in the groups of ``rows`` (grp, id, data, label), a written table of about ``count`` rows: a written table of edges.

    Members of one label are connected already, so pairs inside a group's largest one can add nothing: what stands outside
    it meets all members. They lie in the shared folder in group order. A task holds at most ``leaf`` visitors, reads the
    members of their group ``leaf`` at a time, and nothing is copied per visitor.
    """
    table = written(rows.select("grp", "id", "data", "label").repartitionByRange(max(1, -(-count // ROWS_A_TASK)), "grp", "id").sortWithinPartitions("grp", "id"), "visited-groups")
    parts = table.groupBy("grp", "label").agg(F.count("*").alias("m"))
    main = parts.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("main"), (F.sum("m") - F.max("m")).alias("outside"))
    main = written(few_tasks(main.select("grp", "main", F.ceil(F.col("outside") / leaf).cast("int").alias("blocks")), count), "visited-labels")
    blocks = main.agg(F.sum("blocks")).first()[0] or 0
    uri = arrow_uri(place(table))

    def members(files: list, grp: int) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for store, path, low, high in files:
            if low <= grp <= high:
                with store.open_input_file(path) as f:
                    for b in parquet.ParquetFile(f, buffer_size=1 << 20).iter_batches(leaf, columns=["grp", "id", "data", "label"]):
                        g = b.column(0).to_numpy()
                        lo, hi = np.searchsorted(g, grp), np.searchsorted(g, grp, side="right")
                        if hi > lo:
                            yield b.slice(lo, hi - lo)
                        if g[-1] > grp:
                            break

    def listed() -> list:
        from pyarrow import fs, parquet

        store, base = fs.FileSystem.from_uri(uri)
        out = []
        for path in sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")):
            with store.open_input_file(path) as f:
                meta = parquet.ParquetFile(f).metadata
                stats = [meta.row_group(k).column(0).statistics for k in range(meta.num_row_groups)]
                if stats:
                    out.append((store, path, min(x.min for x in stats), max(x.max for x in stats)))
        return out

    def meet(t: pa.Table, files: list) -> list[tuple[int, int]]:
        ids, data, label = t.column("id").to_numpy(), t.column("data").to_pylist(), t.column("label").to_numpy()
        held = (_Sketches if kind == "sketch" else _Sets)(data, level)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        out = []
        for b in members(files, t.column("grp")[0].as_py()):
            own = np.array([top(x) for x in label.tolist()])
            theirs = np.array([top(x) for x in b.column(3).to_pylist()])
            apart = own[:, None] != theirs[None, :]
            some = np.flatnonzero(apart.any(0))
            if not len(some):
                continue
            other = b.column(1).to_numpy()[some]
            linked = held.linked(b.column(2).take(pa.array(some)).to_pylist()) & apart[:, some]
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = top(int(own[i])), top(int(theirs[some[j]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(ids[i]), int(other[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            g, k = t.column("grp").to_numpy(), t.column("block").to_numpy()
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
                sizes = np.array([len(d) for d in t.column("data").slice(a, z - a).to_pylist()]) if z > a else np.zeros(0, np.int64)
                for lo, hi in slices(np.append(0, np.cumsum(sizes)), HELD_BYTES):
                    for c in range(lo, hi, leaf):
                        files = listed() if files is None else files
                        if found := meet(t.slice(a + c, min(hi, c + leaf) - c), files):
                            yield _pairs(found)

    visitors = table.join(main, "grp").filter("label != main").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    most = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * table.sparkSession.sparkContext.defaultParallelism)
    dealt = visitors.select("grp", "block", "id", "data", "label").repartition(max(1, min(blocks, most)), "grp", "block").sortWithinPartitions("grp", "block")
    out = written(dealt.mapInArrow(run, "a bigint, b bigint"), "visit-edges")
    discard(table, main)
    return out


def link_sets(rows: DataFrame, percent: int, leaf: int = LEAF) -> DataFrame:
    """``(id, component)`` by all linked pairs inside each ``grp`` of ``rows`` (grp, id, data); ids without a link are left out.

    Groups over ``leaf`` are cut into cells that share one pivot. What that leaves outside a group's largest
    part then meets all members of the group.
    """
    count = rows.count()
    sizes = written(few_tasks(rows.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1"), count), "group-sizes")
    whole = F.lit(0).alias("cell")
    held = rows.join(sizes, "grp")
    stars = written(_compare(held.filter(F.col("n") <= leaf).select("grp", "id", "data", whole), "set", percent, count), "set-edges")
    roots = stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
    if sizes.filter(F.col("n") > leaf).limit(1).count() == 0:
        return roots
    large = written(few_tasks(held.filter(F.col("n") > leaf).withColumn("cells", F.ceil(F.col("n") / leaf).cast("int")), count), "large-groups")
    dealt = large.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    pivots = large.filter("id = pivot").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    first = written(_compare(dealt.unionByName(pivots), "set", percent, count), "cell-edges")
    parts = components(first)
    labelled = few_tasks(large.join(parts, "id", "left"), count).withColumn("label", F.coalesce("component", "id")).select("grp", "id", "data", "n", "label")
    mixed = written(few_tasks(labelled.groupBy("grp").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("grp"), count), "mixed-groups")
    if mixed.limit(1).count() == 0:  # every large group is connected, so no further pair can matter
        discard(large)
        return roots.union(parts)
    inner = written(labelled.join(mixed, "grp", "left_semi"), "mixed-members")
    second = _visits(inner, "set", percent, leaf, count)
    discard(inner)
    discard(large)
    return roots.union(components(first.union(second)))


def _pivot_links(rows: DataFrame) -> DataFrame:
    """(id, pivot) where the sketches ``data`` and ``other`` agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.stack([np.frombuffer(d, np.uint8) for d in b.column(c).to_pylist()]) for c in ("data", "other"))
                at = pa.array(np.flatnonzero((x == y).sum(1) >= LOOSE * x.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("pivot").take(at)], ["a", "b"])

    return rows.select("id", "pivot", "data", "other").mapInArrow(run, "a bigint, b bigint")


def _roots(classes: DataFrame, trees: range) -> DataFrame:
    """``(id, grp)``: the first node of each class in each tree."""
    node = F.explode(F.expr(f"transform(sequence({trees.start}, {trees.stop - 1}), t -> xxhash64(t, sketch[t]))"))
    return classes.select("id", node.alias("grp"))


def loose_edges(classes: DataFrame, trees: int, depth: int, leaf: int, coords: int) -> DataFrame:
    """Edges (a, b) between classes (id, sketch, tiny) whose sketches agree enough and that share a node of a tree.

    The first trees label what is connected anyway: small nodes are compared, and members of larger ones are compared
    with the node's pivot. In the other trees a node of one label is done. Small mixed nodes are compared. In a large one
    either few members stand outside the largest label and visit the others, or it branches by two selected
    coordinates; at the last depth the outsiders always visit.
    """
    data = classes.select("id", F.col("tiny").alias("data"))
    start, all_classes = min(FIRST, trees), classes.count()
    level, rows = _roots(classes, range(start)), all_classes * start
    sizes = written(few_tasks(level.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1"), rows), "node-sizes")
    held = written(few_tasks(few_tasks(level.join(sizes, "grp"), rows).join(data, "id"), rows), "first-nodes")
    ends = _compare(held.filter(F.col("n") <= leaf).select("grp", "id", "data", F.lit(0).alias("cell")), "sketch", LOOSE, rows)
    other = data.select(F.col("id").alias("pivot"), F.col("data").alias("other"))
    star = _pivot_links(few_tasks(held.filter((F.col("n") > leaf) & (F.col("id") != F.col("pivot"))).join(other, "pivot"), rows))
    labels = written(components(ends.union(star)).select("id", F.col("component").alias("label")), "loose-labels")
    discard(held)
    edges = [labels.select(F.col("id").alias("a"), F.col("label").alias("b"))]
    members = few_tasks(classes.select("id", "sketch", "tiny").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), all_classes)
    node = F.explode(F.expr(f"transform(sequence({start}, {trees - 1}), t -> xxhash64(t, sketch[t]))"))
    level = members.select("id", "sketch", "tiny", "label", node.alias("grp")) if trees > start else None
    rows = all_classes * (trees - start)
    for d in range(depth if level is not None else 0):
        facts = level.groupBy("grp").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("grp", "n")
        held = written(few_tasks(level.join(few_tasks(facts, rows), "grp"), rows), "nodes")
        rows = held.count()
        small = held.filter(F.col("n") <= leaf).select("grp", "id", F.col("tiny").alias("data"), "label", F.lit(0).alias("cell"))
        edges.append(written(_compare(small, "sketch", LOOSE, rows), "loose-edges"))
        large = held.filter(F.col("n") > leaf)
        most = few_tasks(large.groupBy("grp", "n", "label").agg(F.count("*").alias("m")), rows).groupBy("grp", "n").agg(F.max("m").alias("m"))
        cost = (F.col("n") - F.col("m")) * F.ceil(F.col("n") / leaf)
        most = written(few_tasks(most.withColumn("cheap", F.lit(d == depth - 1) | (cost <= F.col("n"))), rows), "node-sizes")
        visits, deeper = most.agg(F.sum(F.when(F.col("cheap"), F.col("n"))), F.sum(F.when(~F.col("cheap"), F.col("n")))).first()
        large = few_tasks(large.join(most.select("grp", "cheap"), "grp"), rows)
        if visits:
            visited = written(large.filter("cheap").select("grp", "id", F.col("tiny").alias("data"), "label"), "visited-nodes")
            edges.append(_visits(visited, "sketch", LOOSE, leaf, visits))
            discard(visited)
        if not deeper:
            discard(held, most)
            break
        chosen = F.array_distinct(F.expr(f"transform(sequence(1, 2), j -> cast(pmod(xxhash64(grp, j), {coords}) as int))"))
        deep = large.filter("not cheap").select("id", "sketch", "tiny", "label", "grp", F.explode(chosen).alias("c"))
        level, rows = written(deep.select("id", "sketch", "tiny", "label", F.xxhash64("grp", "c", F.get("sketch", F.col("c"))).alias("grp")), "node-level"), 2 * deeper
        discard(held, most)
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, coords: int = COORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Rows are linked if their shingle sets reach ``percent`` of similarity; ``component_id`` is the smallest id
    reachable. Null, empty and blank texts have no shingles and are linked with nothing. A row without an
    id is linked with nothing and kept. Rows that share an id are one document, linked by all their texts.
    An empty table gives no row; further columns are not read.
    """
    named = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("n_shingles", "set_a", "set_b"))
    rows = written(sketches(docs, shingle, coords).withColumn("id", named), "sketches")
    equal = rows.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in ("set_a", "set_b", "sketch", "tiny")])
    classes = written(equal, "set-classes")
    loose = components(loose_edges(classes, trees, depth, WIDER * leaf, coords))
    members = few_tasks(loose.select("id", F.col("component").alias("grp")).join(classes.select("id", "first", "set_a", "set_b"), "id"), loose.count())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("first"), F.col("text").cast("string").alias("text"))
    full = written(_full_sets(texts.join(members.hint("merge"), "first"), shingle), "full-sets")
    near = link_sets(full, percent, leaf)
    discard(full)
    ids = written(rows.filter("id is not null").groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high"), "shared-ids")
    if ids.limit(1).count():  # one document by several texts joins their classes
        same_id = rows.select("doc_id", "id").join(ids, "doc_id").filter("id is not null").select(F.col("id").alias("a"), F.col("low").alias("b"))
        near = components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).union(same_id))
    parts = classes.select("id", "first").join(near, "id", "left").withColumn("part", F.coalesce("component", "id"))
    parts = parts.join(parts.groupBy("part").agg(F.min("first").alias("smallest")), "part").select("id", "smallest")
    out = rows.drop("sketch", "tiny").join(parts, "id", "left").withColumn("component_id", F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
