"""Two-pass external shuffle into shards of equal row counts, in DataFrame expressions only.

Pass one scatters the rows over buckets by a seeded hash of their id and their place in the input, so equal
rows and equal ids spread like any others; the buckets are written to the shared folder. Pass two takes each
bucket (bounded in rows and bytes) into one array, shuffles it by Fisher-Yates with seeded draws, and writes
the order out. The buckets, one after another, are one random permutation of the rows; shard ``s`` of ``n``
takes the positions from floor(s*N/n) on, so counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.llm.common import running_offset, utf8_size, written


def fisher_yates(n: Column, bucket: Column, seed: int) -> Column:
    """A permutation of 0..n-1 as an array: for i from n-1 down to 1, swap i with a seeded draw from 0..i."""

    def swap(acc: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        low, high = F.slice(acc, F.lit(1), j), F.slice(acc, j + 2, F.greatest(i - j - 1, F.lit(0)))
        moved = F.concat(low, F.slice(acc, i + 1, F.lit(1)), high, F.slice(acc, j + 1, F.lit(1)), F.slice(acc, i + 2, n))
        return F.when(j < i, moved).otherwise(acc)

    n = n.cast("int")
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), n - 1), swap)


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 32 << 20, bucket_rows: int = 512, id_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``(record struct, position, shard, slot)`` for every row of ``docs``; ``record`` holds its columns as they are.

    ``slot`` counts from 0 without gaps in each shard. Null ids, repeated rows and columns of any name are
    rows like others; an empty table gives an empty result. ``size`` (bytes of a row) bounds the buckets; by
    default it is the text's. ``docs`` must be a scan or a written table, whose rows keep their places when
    a lost task runs again.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    size = size if size is not None else utf8_size(F.col("text")) + 1
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_col).alias("id"), size.alias("bytes"))
    total, weight = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_buckets = max(1, -(-total // bucket_rows), -(-weight // bucket_bytes))
    place = F.monotonically_increasing_id()
    scattered = written(rows.select("record", F.pmod(F.xxhash64(F.lit(seed), "id", place), F.lit(n_buckets)).alias("bucket"), place.alias("place")), "shard-buckets")
    starts = running_offset(scattered.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n", "start").select("bucket", "start")
    starts = written(starts, "shard-starts")  # its size is known, so the records stay where their bucket is
    held = scattered.repartitionByRange("bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("place", "record")), lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1)).alias("rows"))
    order = held.withColumn("order", fisher_yates(F.size("rows"), F.col("bucket"), seed))
    moved = F.transform("order", lambda at: F.get("rows", at)["record"])
    dealt = order.join(starts, "bucket").select("start", F.posexplode(moved).alias("i", "record"))
    placed = dealt.select("record", (F.col("start") + F.col("i")).alias("position"))
    shard = F.expr(f"(({n_shards}L * (position + 1) - 1) div {max(1, total)}L)")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - F.expr(f"(shard * {total}L) div {n_shards}L"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard (``shard=0`` and so on), rows in slot order within each file.

    ``shuffle_into_shards`` leaves neighbouring buckets in one task, so rows are written where they are.
    """
    flat = sharded.select("shard", "slot", "record")
    flat.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").option("compression", "zstd").parquet(path)


def read_shards(sharded: DataFrame, path: str) -> DataFrame:
    """``(slot, record, shard)`` of what ``write_shards`` wrote for ``sharded``; no row for an empty table."""
    return sharded.sparkSession.read.schema(sharded.select("slot", "record", "shard").schema).parquet(path)
