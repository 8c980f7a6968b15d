"""Web-page snapshots: main text, content address, append-only versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.operators.skew import previous

DISPLAY_CHARS = 8000

# What is dropped, what breaks a line, and the character references that are decoded.
DROPPED = (
    r"(?is)<!--.*?-->|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>"
    r"|<header\b.*?</header>|<footer\b.*?</footer>|<aside\b.*?</aside>|<noscript\b.*?</noscript>"
)
LINE_BREAKERS = r"(?i)</(?:p|div|li|h[1-6]|article|section|tr|ul|ol)>|<br\s*/?>"
ANY_TAG = r"<[^>]*>"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def main_text(html: Column) -> Column:
    t = F.regexp_replace(html, DROPPED, "")
    t = F.regexp_replace(t, LINE_BREAKERS, "\n")
    t = F.regexp_replace(t, ANY_TAG, "")
    for ref, ch in REFERENCES:
        t = F.replace(t, F.lit(ref), F.lit(ch))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{2,}", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def snapshot_path(root: str, url: Column, content_hash: Column) -> Column:
    return F.concat_ws("/", F.lit(root), F.sha1(url), content_hash, F.lit("content.md"))


def snapshots(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> one snapshot row each. The hash covers the whole text, only the display is cut."""
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).select(
        "page_id",
        "url",
        F.sha1("url").alias("url_sha1"),
        F.sha2("text", 256).alias("content_hash"),
        "text",
        F.substring("text", 1, DISPLAY_CHARS).alias("display"),
        (F.length("text") > DISPLAY_CHARS).alias("truncated"),
    )


def new_snapshots(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose (url, hash) is not stored yet, one per (url, hash). Append the result."""
    once = incoming.dropDuplicates(["url", "content_hash"])
    return once.join(stored.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def append_snapshots(incoming: DataFrame, path: str) -> None:
    """Append unseen versions under ``path``, laid out by the first two characters of the url hash."""
    spark = incoming.sparkSession
    parts = incoming.withColumn("prefix", F.substring("url_sha1", 1, 2))
    try:
        stored = spark.read.parquet(path)
        parts = new_snapshots(parts, stored)
    except Exception as exc:  # the first write has nothing to read
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        parts = parts.dropDuplicates(["url", "content_hash"])
    parts.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def latest_by_url(snaps: DataFrame) -> DataFrame:
    """The newest snapshot of each URL. ``max_by`` combines on the map side, so a hot URL costs one row per task."""
    return snaps.groupBy("url").agg(
        F.max_by(F.struct("content_hash", "fetched_at"), F.struct("fetched_at", "content_hash")).alias("s")
    ).select("url", "s.content_hash", "s.fetched_at")


def change_points(snaps: DataFrame) -> DataFrame:
    """Rows whose hash differs from the previous snapshot of the same URL. A much-fetched URL is cut by month."""
    timed = snaps.withColumn("_t", F.unix_micros("fetched_at"))
    seen = previous(timed, ["url"], ["_t", "content_hash"], {"previous_hash": F.col("content_hash")}, width=30 * 86_400_000_000)
    return seen.filter("previous_hash IS NOT NULL AND previous_hash <> content_hash").select("url", "fetched_at", "previous_hash", "content_hash")
