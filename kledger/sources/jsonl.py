"""JSON-lines ledgers: tolerant and strict scans, append sinks, corpora with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = (
    "event_id bigint, ts string, trace_id string, step string, model string, input_tokens bigint, output_tokens bigint, "
    "cache_read_tokens bigint, latency_ms double, error_type string"
)


def tolerant_rows(lines: DataFrame, schema: str, required: list[str], column: str = "value") -> DataFrame:
    """Typed rows of the readable lines. Blank, cut-off, non-object lines and lines without a required field are left out."""
    parsed = F.from_json(column, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.filter(F.trim(column).startswith("{")).select(parsed.alias("r")).filter("r._corrupt IS NULL")
    for name in required:
        rows = rows.filter(F.col(f"r.{name}").isNotNull())
    return rows.select("r.*").drop("_corrupt")


def scan_tolerant(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    return tolerant_rows(spark.read.text(path), schema, required)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) with physical line numbers, also when a file is read in several splits: a split
    starts at the number of lines in the splits before it, ordered by byte offset."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"), "value"
    )
    blocks = raw.groupBy("file", "start").agg(F.min("m").alias("m0"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = blocks.select("file", "start", "m0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return raw.join(offsets, ["file", "start"]).select("file", (F.col("off") + F.col("m") - F.col("m0") + 1).alias("line_no"), "value")


def bad_line(value: Column, required: list[str]) -> Column:
    """Why a line is not acceptable, or NULL."""
    v = F.try_parse_json(value)
    missing = [F.when(F.try_variant_get(v, f"$.{n}", "string").isNull(), F.lit(f"missing {n}")) for n in required]
    return F.when(F.trim(value) == "", F.lit("blank")).when(v.isNull(), F.lit("not json")).when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not an object")).otherwise(F.coalesce(*missing, F.lit(None)))


def violations(lines: DataFrame, required: list[str]) -> DataFrame:
    return lines.withColumn("reason", bad_line(F.col("value"), required)).filter("reason IS NOT NULL")


def strict_rows(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Typed rows; the job fails on the first bad line and names its file and number."""
    reason = bad_line(F.col("value"), required)
    where = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), reason)
    checked = lines.withColumn("value", F.when(reason.isNotNull(), F.raise_error(where).cast("string")).otherwise(F.col("value")))
    return checked.select("file", "line_no", F.from_json("value", schema).alias("r")).select("file", "line_no", "r.*")


def append_ledger(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Append-only sink: one row per call, never rewritten."""
    rows.write.mode("append").format(fmt).save(path)


def corpus(manifest: DataFrame, texts: DataFrame, subset: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, unknown ids). ``manifest``: (doc_id, title, url); ``texts``: (doc_id, text); headings are dropped."""
    body = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~line.startswith("#")), "\n")
    docs = manifest.join(texts, "doc_id").select("doc_id", "title", "url", F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    if subset is None:
        return docs, manifest.select("doc_id").limit(0)
    return docs.join(subset.select("doc_id").distinct(), "doc_id", "left_semi"), subset.select("doc_id").distinct().join(manifest, "doc_id", "left_anti").select("doc_id")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.explode("docs").alias("d")).select("d.*")


def version_history(before: DataFrame, after: DataFrame, key: str = "note_id") -> DataFrame:
    """The previous image of every row about to be written: (key, action, previous_body)."""
    prev = before.select(key, F.col("body").alias("previous_body"), F.lit(True).alias("_seen"))
    return after.select(key).join(prev, key, "left").select(key, F.when(F.col("_seen").isNull(), "created").otherwise("overwrite").alias("action"), "previous_body")
