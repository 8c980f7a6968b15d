"""Paragraph-first chunking of documents, and search over the chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.functions import vectors as V
from kledger.operators.blocks import score_cosine, score_hybrid, top_matches

MAX_CHARS = 500
SNIPPET = 200
# Where a sentence may end.
SENTENCE_END = r"(?<=[。！？；!?;])|(?<=\. )"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def chunk_texts(body: Column, limit: int = MAX_CHARS) -> Column:
    """Array of chunks. Short paragraphs are joined by a blank line until full; long ones are cut at sentence
    ends, over-long sentences every ``limit`` characters. A piece of full size can never take a neighbour,
    so cutting before packing gives the same chunks as cutting while packing."""

    def unit(t, joiner):
        return F.struct(t.alias("t"), joiner.alias("j"))

    def cut(s, joiner):
        n = F.ceil(F.length(s) / F.lit(float(limit))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: unit(F.substr(s, k * limit + 1, F.lit(limit)), F.when(k == 0, joiner).otherwise("")))

    def paragraph(p):
        sentences = F.filter(F.transform(F.split(p, SENTENCE_END), lambda s: _strip(s)), lambda s: s != "")
        long = F.flatten(F.transform(sentences, lambda s, i: cut(s, F.when(i == 0, "\n\n").otherwise(""))))
        return F.when(F.length(p) <= limit, F.array(unit(p, F.lit("\n\n")))).otherwise(long)

    paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda p: _strip(p)), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, paragraph))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc, u):
        fits = (acc["buf"] == "") | (F.length(acc["buf"]) + F.length(u["j"]) + F.length(u["t"]) <= limit)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["buf"]))).alias("done"),
            F.when(acc["buf"] == "", u["t"]).when(fits, F.concat(acc["buf"], u["j"], u["t"])).otherwise(u["t"]).alias("buf"),
        )

    return F.aggregate(units, start, step, lambda a: F.when(a["buf"] != "", F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]))


def chunks(docs: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(doc_id, title, url, body) -> one row per chunk, numbered from 0 within its document."""
    cs = docs.select("doc_id", "title", "url", F.posexplode(chunk_texts(F.col("body"), limit)).alias("n", "text"))
    return cs.withColumn("chunk_id", F.concat(F.col("doc_id"), F.lit("#c"), F.col("n").cast("string")))


def chunk_search(chunk_table: DataFrame, queries: DataFrame, k: int = 5, mode: str = "hybrid", force_grid: bool = False) -> DataFrame:
    """Top ``k`` chunks per query: cosine, or the even mix of cosine and bigram Jaccard. Ties by chunk_id."""
    enc = V.encoder()
    qs = queries.select("qid", enc(F.col("q")).alias("v"), X.bigram_set(F.col("q")).alias("grams"))
    items = chunk_table.select(F.col("chunk_id").alias("item_id"), enc(F.concat_ws("\n", "title", "text")).alias("v"), X.bigram_set(F.col("text")).alias("grams"))
    out = top_matches(items, qs, score_hybrid if mode == "hybrid" else score_cosine, k, -2.0, force_grid=force_grid, max_queries=512)
    return out.withColumnRenamed("item_id", "chunk_id")
