"""Redirect chains: follow merged and superseded records to the active one, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.session import cut_lineage, discard, written


def redirects(notes: DataFrame, with_path: bool = False) -> DataFrame:
    """note_id -> (canonical_id, outcome, first_alias, hops[, path]).

    ``outcome`` is ``active``, ``cycle``, ``broken`` (no next, or a next that is not stored). Active records
    map to themselves in no join at all; only the records that point elsewhere take part in the doubling.
    Each round halves the remaining chain length. A round that settles nothing proves that what is left
    runs into a cycle: were a longer chain still open, its nearer members would have settled in that round.
    """
    next_id = F.when(F.col("status") == "merged", F.col("redirect_to")).when(F.col("status") == "superseded", F.col("superseded_by"))
    edges = notes.filter("status <> 'active'").select("note_id", next_id.alias("ptr"))
    known = notes.select(F.col("note_id").alias("ptr"), F.lit(True).alias("_known"), (F.col("status") == "active").alias("_active"))
    state = edges.join(known, "ptr", "left").select(
        "note_id", "ptr",
        F.when(F.coalesce(F.col("_active"), F.lit(False)), "active").when(F.col("_known").isNull(), "broken").alias("outcome"),
        F.lit(1).alias("hops"),
        *([F.array("note_id", "ptr").alias("path")] if with_path else []),
    )
    state = cut_lineage(state)
    open_before = None
    while True:
        open_rows = state.filter("outcome IS NULL").count()
        if open_rows == 0 or open_rows == open_before:
            break
        open_before = open_rows
        hop = state.select(
            F.col("note_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("outcome").alias("_outcome"), F.col("hops").alias("_hops"),
            *([F.col("path").alias("_path")] if with_path else []),
        )
        moved = (
            state.filter("outcome IS NULL").join(hop, "ptr")
            .select(
                "note_id", F.col("_ptr").alias("ptr"), F.col("_outcome").alias("outcome"), (F.col("hops") + F.col("_hops")).alias("hops"),
                *([F.concat("path", F.slice("_path", 2, 1 << 30)).alias("path")] if with_path else []),
            )
        )
        state = cut_lineage(state.filter("outcome IS NOT NULL").unionByName(moved))
    done = state.withColumn("outcome", F.coalesce("outcome", F.lit("cycle")))
    ok = F.col("outcome") == "active"
    aliases = done.select(
        "note_id", F.when(ok, F.col("ptr")).alias("canonical_id"), "outcome", F.col("note_id").alias("first_alias"),
        F.when(F.col("outcome") != "cycle", F.col("hops")).alias("hops"),
        *([F.when(F.col("outcome") != "cycle", F.col("path")).alias("path")] if with_path else []),
    )
    actives = notes.filter("status = 'active'").select(
        "note_id", F.col("note_id").alias("canonical_id"), F.lit("active").alias("outcome"), F.lit(None).cast("string").alias("first_alias"), F.lit(0).alias("hops"),
        *([F.array("note_id").alias("path")] if with_path else []),
    )
    return actives.unionByName(aliases)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id -> component (the smallest id reachable). ``edges`` has (a, b), each undirected edge once.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round replaces each node's
    links by links to the smallest neighbour, with plain aggregates and joins, and the number of edges
    never grows. A hub costs partial minima on the map side, not a gathered group.
    """
    e = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    previous = None
    while True:
        # minima are written before they are joined: one row per node, so the join can split a hub's links over tasks
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "edge-minima")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges-down")
        low2 = written(down.groupBy("a").agg(F.min("b").alias("m")), "edge-minima")
        small = down.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("p"))
        small = small.select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).filter("a <> b").distinct()
        after = written(small, "edges")
        discard(e, low, down, low2)
        e = after
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == previous:
            break
        previous = mark
    roots = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
