"""Windows that survive a hot key.

A plain ``partitionBy(key)`` window sorts a whole key in one task. Here each key is cut into buckets of its
order column: inside a bucket an ordinary window runs, and a second, far smaller window over one summary row
per bucket carries the running state across buckets. The results equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kledger.session import cut_lineage

BUCKET = 65536


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict | None = None, maxes: dict | None = None, width: int = BUCKET) -> DataFrame:
    """Add running sums and running maxima (current row included) per ``keys`` in the order of ``order``.

    ``order[0]`` must be an integer column; it also picks the bucket. ``maxes`` over a struct whose first
    field is the order column gives "last value so far".
    """
    sums, maxes = sums or {}, maxes or {}
    b = df.withColumn("_b", _bucket(order[0], width))
    for n, c in {**sums, **maxes}.items():
        b = b.withColumn(f"_v_{n}", c)
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums] + [F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy(*keys, "_b").agg(*aggs)
    carry = carry.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_cb"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxes],
    )
    cond = F.col("_b") == F.col("_cb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(carry, cond)
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)))
    for n in maxes:
        m = F.max(f"_v_{n}").over(inside)
        out = out.withColumn(n, F.when(m.isNull() | (F.col(f"_o_{n}") > m), F.col(f"_o_{n}")).otherwise(m))
    drop = ["_b", "_cb"] + [f"_k{i}" for i in range(len(keys))] + [f"_{p}_{n}" for p in ("v", "o") for n in [*sums, *maxes]]
    return out.drop(*drop)


def previous(df: DataFrame, keys: list[str], order: list[str], cols: dict, width: int = BUCKET) -> DataFrame:
    """Add, for each ``name: column``, the column's value on the previous row of the same key."""
    b = df.withColumn("_b", _bucket(order[0], width)).withColumn("_row", F.struct(*[c.alias(n) for n, c in cols.items()]))
    last = b.groupBy(*keys, "_b").agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_b")
    last = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_cb"), F.lag("_last").over(w).alias("_carry"))
    cond = F.col("_b") == F.col("_cb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = b.join(last, cond).withColumn("_prev", F.coalesce(F.lag("_row").over(inside), F.col("_carry")))
    for n in cols:
        out = out.withColumn(n, F.col("_prev")[n])
    return out.drop("_b", "_cb", "_row", "_prev", "_carry", *[f"_k{i}" for i in range(len(keys))])


def global_position(df: DataFrame, order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Dense 1-based position of every row in the total order of ``order``, with no single-task window.

    Range partitions are sorted on their own; one count per partition gives the offsets. The partitioned
    rows are written to the checkpoint folder first, so both passes see the same partition bounds.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumn("_m", F.monotonically_increasing_id()))
    part, idx = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn("_p", part).withColumn("_i", idx)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition, so a small table
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_off") + F.col("_i") + 1).drop("_m", "_p", "_i", "_off")


def position_within(df: DataFrame, keys: list[str], pos: str, name: str, descending: bool = False, width: int = BUCKET) -> DataFrame:
    """1-based rank of each row among the rows of its ``keys`` by the integer column ``pos`` (unique within a key)."""
    order = df if not descending else df.withColumn("_neg", -F.col(pos))
    col = "_neg" if descending else pos
    return running(order, keys, [col], sums={name: F.lit(1)}, width=width).drop("_neg")
