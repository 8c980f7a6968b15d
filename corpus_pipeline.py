"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
``docs``. All but the last return the columns of documents as they came, whatever further columns there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kledger.llm import chosen_path, likelihood, mixing, packing, repeats
from kledger.llm.common import fresh_name, written
from kledger.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows with one id stay or go together by the id's worst verdict; rows without an id go by none and stay."""
    verdict = likelihood.quality_rules(docs, table(spark, sf_dir, "labels"))
    gone = verdict.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (five-word shingles, similarity 0.8)."""
    classes = chosen_path.near_duplicates(docs)
    gone = classes.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their later repeats of 100 bytes or more, cut at whole characters; ``n_chars`` follows the text."""
    row, spans = fresh_name(docs, "row", "spans")
    cut = repeats.remove_repeats(docs).filter(F.col("n_spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans))
    placed = docs.withColumn(row, F.monotonically_increasing_id()).join(cut, row, "left")

    @F.pandas_udf("string")
    def without(text, lists):
        out = []
        for t, s in zip(text, lists, strict=True):
            if t is None or s is None:
                out.append(t)
                continue
            data = np.frombuffer(t.encode(), np.uint8)
            keep = np.ones(len(data), bool)
            for x in s:
                a, z = x["lo"], x["hi"]
                while a < z and data[a] & 0xC0 == 0x80:  # keep a character of which a byte stays
                    a += 1
                while z > a and z < len(data) and data[z] & 0xC0 == 0x80:
                    z -= 1
                keep[a:z] = False
            out.append(data[keep].tobytes().decode())
        return type(text)(out)

    text = F.when(F.col(spans).isNotNull(), without(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = placed.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights: the anchor domain, whose tokens set the total, stays once; others stay as often as their rates say."""
    rated = mixing.mix(docs, table(spark, sf_dir, "labels"))
    uses = F.when(F.coalesce(F.col("domain") == mixing.ANCHOR, F.lit(True)), F.lit(1)).otherwise(F.col("copies"))
    stay = rated.withColumn("uses", uses).filter("uses > 0")
    return stay.select("record", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use")).select("record.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 4096 tokens; the tokens lie there in the shared folder."""
    return packing.packed_sequences(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mixed), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
