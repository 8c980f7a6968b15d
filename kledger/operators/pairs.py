"""Pairs of notes that share an entity, without ever listing all of them.

The number of pairs is quadratic in the size of an entity, but what is asked of them is not: how many there
are, and which come first in id order. Both are answered from ranks. For a note with keys K, the later notes
sharing any key are counted by inclusion and exclusion over the subsets of K: sum over non-empty S of
(-1)^(|S|+1) times the number of later notes holding all of S. A note with more than ``MAX_KEYS`` keys has too many
subsets; the pairs it is in are met one by one instead. The counts, summed in id order, say which notes own the
pairs numbered lo..hi, and only those notes are expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.operators.retrieval import top_rows
from kledger.operators.skew import global_position, position_within, running
from kledger.session import cut_lineage

MAX_KEYS = 6  # as many entities as a note usually carries at most: 63 subsets


def keyed(notes: DataFrame) -> DataFrame:
    """(note_id, keys, pos): distinct entity slugs of each note and its place in id order."""
    keys = F.array_sort(F.array_distinct(F.transform("entities", lambda e: X.slugify(e))))
    return global_position(notes.select("note_id", keys.alias("keys")).filter(F.size("keys") > 0), ["note_id"])


def partner_counts(placed: DataFrame) -> DataFrame:
    """(note_id, keys, pos, partners): how many later notes share at least one key."""
    few = placed.filter(F.size("keys") <= MAX_KEYS)
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("keys")) - 1)
    subset = F.transform(masks, lambda m: F.filter("keys", lambda k, i: F.pmod(F.call_function("shiftright", m, i), F.lit(2)) == 1))
    sub = few.select("note_id", "pos", F.explode(subset).alias("s")).select(
        "note_id", "pos", F.array_join("s", "\x1f").alias("s"), F.when(F.size("s") % 2 == 1, 1).otherwise(-1).alias("sign")
    )
    ranked = position_within(sub, ["s"], "pos", "from_end", descending=True)
    counts = ranked.groupBy("note_id").agg(F.sum(F.col("sign") * (F.col("from_end") - 1)).alias("_few"))
    one = placed.filter(F.size("keys") > MAX_KEYS).select(F.col("pos").alias("_p"), F.explode("keys").alias("key"))
    two = placed.select(F.col("pos").alias("_q"), F.explode("keys").alias("key"))
    met = one.join(two, "key").filter("_p <> _q").select(F.least("_p", "_q").alias("pos"), F.greatest("_p", "_q").alias("later")).distinct()
    many = met.groupBy("pos").agg(F.count("*").alias("_many"))
    both = placed.join(counts, "note_id", "left").join(many, "pos", "left")
    zero = F.lit(0).cast("bigint")
    return both.select("note_id", "keys", "pos", (F.coalesce("_few", zero) + F.coalesce("_many", zero)).alias("partners"))


def cumulated(counts: DataFrame) -> DataFrame:
    """Adds ``before``: the number of pairs owned by earlier notes. Written out once, as it is read in windows."""
    cum = running(counts, [], ["pos"], sums={"upto": F.col("partners")})
    return cut_lineage(cum.withColumn("before", F.col("upto") - F.col("partners")).select("note_id", "keys", "pos", "partners", "before"))


def pair_window(cum: DataFrame, lo: int, hi: int) -> DataFrame:
    """(a_id, b_id, pair_no): the pairs numbered lo..hi-1 (from 0) in the order (smaller id, larger id)."""
    owners = cum.filter((F.col("partners") > 0) & (F.col("before") < hi) & (F.col("before") + F.col("partners") > lo))
    left = owners.select(F.col("note_id").alias("a_id"), F.col("pos").alias("a_pos"), "before", F.explode("keys").alias("key"))
    right = cum.select(F.col("note_id").alias("b_id"), F.col("pos").alias("b_pos"), F.explode("keys").alias("key"))
    met = left.join(right, "key").filter("b_pos > a_pos").select("a_id", "b_id", "b_pos", "before").distinct()
    # no owner contributes more than hi pairs, so longer lists are cut before they are shuffled
    ranked = top_rows(met, ["a_id"], ["b_pos"], hi, "_r")
    return ranked.withColumn("pair_no", F.col("before") + F.col("_r") - 1).filter((F.col("pair_no") >= lo) & (F.col("pair_no") < hi)).select("a_id", "b_id", "pair_no")


def total_pairs(cum: DataFrame) -> int:
    return int(cum.agg(F.coalesce(F.sum("partners"), F.lit(0))).first()[0])


def first_matching(cum: DataFrame, accept, wanted: int, window: int = 100_000) -> DataFrame | None:
    """The first ``wanted`` pairs, in order, that ``accept`` (a DataFrame -> DataFrame filter) lets through.

    Windows of pairs are tried in order, each twice as long as the last, and the search stops as soon as
    enough are found: exact, and as long as needed but no longer.
    """
    total, lo, kept, have = total_pairs(cum), 0, None, 0
    while lo < total and have < wanted:
        got = cut_lineage(accept(pair_window(cum, lo, lo + window)).orderBy("pair_no").limit(wanted - have))
        have += got.count()
        kept = got if kept is None else kept.unionByName(got)
        lo, window = lo + window, window * 2
    return kept
