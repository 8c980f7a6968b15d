"""Checks of evaluation inputs: question sets, timelines, clusters. Every violation is a row or a code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.operators.skew import previous

QA_TYPES = ("single_hop", "multi_hop", "temporal", "unanswerable")


def qa_errors(qa: DataFrame) -> DataFrame:
    """Adds ``errors``: missing question, repeated qid, unknown type, wrong number of gold points."""
    again = qa.groupBy("qid").agg(F.count("*").alias("_n")).filter("_n > 1")
    n = F.size("gold_points")
    known = F.col("qtype").isin(*QA_TYPES)
    errors = F.concat_ws(
        ",", F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "missing_question"), F.when(F.col("_n").isNotNull(), "duplicate_qid"), F.when(~known, "bad_type"),
        F.when(known & (F.col("qtype") == "unanswerable") & (n > 0), "points_for_unanswerable"), F.when(known & (F.col("qtype") != "unanswerable") & ((n < 2) | (n > 4)), "points_range"),
    )
    return qa.join(again, "qid", "left").withColumn("errors", errors).drop("_n")


def timeline_violations(events: DataFrame) -> DataFrame:
    """(run, violation, event_id): gaps in the ids, not exactly one update, a question asked more than twice, a
    temporal question before the update. ``events``: run, event_id, kind, qid, qtype."""
    p = previous(events, ["run"], ["event_id"], {"_p": F.col("event_id")})
    gap = p.filter(F.col("event_id") != F.col("_p") + 1).select("run", F.lit("gap").alias("violation"), "event_id")
    ups = events.groupBy("run").agg(F.count_if(F.col("kind") == "update").alias("n"), F.min(F.when(F.col("kind") == "update", F.col("event_id"))).alias("u"))
    bad_ups = ups.filter("n <> 1").select("run", F.lit("updates").alias("violation"), F.col("n").cast("int").alias("event_id"))
    often = events.filter("kind = 'query'").groupBy("run", "qid").agg(F.count("*").alias("n"), F.max("event_id").alias("event_id")).filter("n > 2").select("run", F.lit("asked_often").alias("violation"), "event_id")
    early = events.filter("kind = 'query' AND qtype = 'temporal'").join(ups.select("run", "u"), "run").filter("event_id < u").select("run", F.lit("temporal_early").alias("violation"), "event_id")
    return gap.unionByName(bad_ups).unionByName(often).unionByName(early)


def cluster_cover(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that are not in exactly one cluster: (doc_id, n_clusters)."""
    n = members.groupBy("doc_id").agg(F.countDistinct("cluster").alias("n_clusters"))
    return docs.join(n, "doc_id", "left").select("doc_id", F.coalesce("n_clusters", F.lit(0)).cast("bigint").alias("n_clusters")).filter("n_clusters <> 1")
