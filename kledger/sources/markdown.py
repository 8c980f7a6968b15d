"""Note records as text files: a front-matter block between ``---`` lines, then the body."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = (
    "note_id string, title string, entities array<string>, confidence string, status string, redirect_to string, superseded_by string, volatility string, kind string, "
    "importance double, tombstone boolean, observed_at string, reviewed_at string, valid_from string, valid_until string, source_changed_at string, created string, trace_id string, "
    "sources array<struct<url:string,content_hash:string>>"
)
FIELDS = [p.split()[0] for p in META.replace("struct<url:string,content_hash:string>", "x").split(", ")]
NUMBER = re.compile(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
OPTIONAL = ["redirect_to", "superseded_by", "importance", "observed_at", "reviewed_at", "valid_from", "valid_until", "source_changed_at"]


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _scalar(s: str):
    s = s.strip()
    if s in ("", "null", "~"):
        return None
    if s[0] in "[{\"" or s in ("true", "false"):
        try:
            return json.loads(s)
        except ValueError:
            return s
    if NUMBER.match(s):
        return json.loads(s)
    return s.strip("'")


def front_matter_json(block: str) -> str | None:
    """The block as a JSON object: scalars, inline JSON, and ``-`` lists of scalars or of small maps. None if it is no mapping."""
    out: dict = {}
    key = None
    for raw in block.splitlines():
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = line.strip()
        if line[0] in " -" and key is not None:
            if not isinstance(out.get(key), list):
                out[key] = []
            fresh = item.startswith("- ")
            item = item[2:] if fresh else item
            name, sep, value = item.partition(": ")
            if sep and name.isidentifier():
                if fresh or not out[key]:
                    out[key].append({})
                out[key][-1][name] = _scalar(value)
            else:
                out[key].append(_scalar(item))
            continue
        name, sep, value = line.partition(":")
        if not sep:
            return None
        key = name.strip()
        out[key] = _scalar(value)
    return json.dumps(out, ensure_ascii=False)


def _to_json(batches):
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "meta_json": [front_matter_json(b) if b is not None else "{}" for b in pdf["block"]], "body": pdf["body"]})


def parse_records(files: DataFrame) -> DataFrame:
    """(path, text) -> typed note fields, body, ``extra`` (unknown keys, JSON) and ``corrupt`` (the text of an unreadable row).

    A file without a block is all body. Enum values off the list fall back to their default, an importance out of
    range becomes NULL.
    """
    shape = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n|$)(.*)$"
    has = F.col("text").rlike(shape)
    cut = files.select(
        "path", F.when(has, F.regexp_extract("text", shape, 1)).alias("block"), F.when(has, F.regexp_extract("text", shape, 2)).otherwise(F.col("text")).alias("body"),
    )
    raw = cut.mapInPandas(_to_json, "path string, meta_json string, body string")
    m = F.from_json("meta_json", META)
    known = F.array(*[F.lit(f) for f in FIELDS])
    extra = F.map_filter(F.from_json("meta_json", "map<string,string>"), lambda k, v: ~F.array_contains(known, k))
    df = raw.select("path", "body", m.alias("m"), extra.alias("x"), F.when(F.col("meta_json").isNull(), F.col("body")).alias("corrupt"))

    def enum(name, allowed, default):
        v = F.lower(F.trim(F.col(f"m.{name}")))
        return F.when(v.isin(*allowed), v).otherwise(default).alias(name)

    enums = {
        "confidence": (("high", "medium", "low"), "medium"), "status": (("active", "merged", "superseded"), "active"),
        "volatility": (("stable", "drifting", "volatile"), "stable"), "kind": (("knowledge", "user", "experience"), "knowledge"),
    }
    cols = []
    for f in FIELDS:
        c = F.col(f"m.{f}")
        if f in enums:
            cols.append(enum(f, *enums[f]))
        elif f == "importance":
            cols.append(F.when((c >= 0) & (c <= 1), c).alias(f))
        elif f == "tombstone":
            cols.append(F.coalesce(c, F.lit(False)).alias(f))
        else:
            cols.append(c.alias(f))
    return df.select("path", *cols, "body", F.when(F.size("x") > 0, F.to_json("x")).alias("extra"), "corrupt")


def render_records(notes: DataFrame) -> DataFrame:
    """(note_id, text): the inverse of ``parse_records``. NULL optionals and a false tombstone are left out."""
    have = [f for f in FIELDS if f in notes.columns]
    lines = []
    for f in have:
        if f == "tombstone":
            lines.append(F.when(F.col(f), "tombstone: true"))
        elif dict(notes.dtypes)[f].startswith("array"):
            lines.append(F.concat(F.lit(f"{f}: "), F.to_json(f)))
        else:
            quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(f).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
            value = F.col(f).cast("string") if f == "importance" else quoted
            lines.append(F.concat(F.lit(f"{f}: "), value))
    block = F.array_join(F.array_compact(F.array(*lines)), "\n")
    return notes.select("note_id", F.concat(F.lit("---\n"), block, F.lit("\n---\n"), F.col("body")).alias("text"))


def write_records(notes: DataFrame, path: str) -> None:
    """Records laid out by the last two characters of the id, many per file; Parquet is the primary sink."""
    rendered = render_records(notes).select(F.to_json(F.struct("note_id", "text")).alias("value"), F.right("note_id", F.lit(2)).alias("prefix"))
    rendered.write.mode("overwrite").partitionBy("prefix").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of what ``write_records`` wrote, the note's id as its path; input of ``parse_records``."""
    row = F.from_json("value", "note_id string, text string")
    return spark.read.text(path).select(row.alias("r")).select(F.col("r.note_id").alias("path"), F.col("r.text").alias("text"))
