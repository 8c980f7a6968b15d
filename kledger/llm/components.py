"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import discard, few_tasks, written


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return few_tasks(both.filter("b > a").join(few_tasks(low, rows), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b"), rows)


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = few_tasks(down.groupBy("a").agg(F.min("b").alias("low")), rows)
    near = few_tasks(down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")), rows)
    return near.union(low.select("a", F.col("low").alias("b"))).filter("a != b")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of an edge; ``component`` is the smallest id it reaches.

    ``edges`` has long columns ``a`` and ``b``; loops, repeats and both directions are fine. Each round is
    written to the shared folder; only counts reach the driver, and what is small runs in few tasks. Minima are combined before each shuffle,
    and the joins are plain equi-joins that adaptive execution splits at a hot id.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        # done when every id has one edge and no centre has one: then each star's centre is its smallest id
        ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        crowded = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
        rows = e.count()
        if few_tasks(crowded, rows).limit(1).count() == 0:
            break
        wide = written(_large_star(e, rows), "edges")
        discard(e)
        e = written(few_tasks(_small_star(wide, rows).distinct(), rows), "edges")
        discard(wide)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
