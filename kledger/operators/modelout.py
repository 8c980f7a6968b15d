"""Reading what a model wrote: JSON in free text, extracted notes, scores, tool calls, errors, replays."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X

# Caps of one extraction, known tools with their required text argument, error marks.
NOTE_CHARS, MAX_NOTES, MAX_CONFLICTS = 240, 8, 5
TOOLS = {"web_search": "query", "fetch_url": "url"}
AUTH_MARK = r'HTTP 401|HTTP 403|身份验证失败|"code": ?"100[0-3]"'
NETWORK_MARK = r"(?i)transport error|connect|timeout|重试"
SCORES = ("coverage", "citation", "temporal")


def _first_block(text: str) -> str | None:
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            value, end = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        return text[m.start() : end] if isinstance(value, dict) else None
    return None


def first_json(c: Column) -> Column:
    """The first JSON object in a text. A text that is one object, fenced or not, never leaves the JVM."""

    @F.pandas_udf("string")
    def scan(xs: pd.Series) -> pd.Series:
        return pd.Series([_first_block(x) if x is not None else None for x in xs], dtype="object")

    clean = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\n?", ""), r"\n?```\s*$", "")
    whole = F.try_parse_json(clean).isNotNull() & F.trim(clean).startswith("{")
    return F.when(whole, clean).otherwise(scan(F.when(~F.coalesce(whole, F.lit(False)) & clean.contains("{"), clean)))


def extracted_notes(outputs: DataFrame, pool: DataFrame) -> DataFrame:
    """(run, pos, text, entities, confidence, volatility, urls): well-formed notes, at most eight, pool URLs only.

    ``outputs``: (run, raw). A run's notes stay in its row until they are capped, so nothing is ranked.
    """
    js = first_json(F.col("raw"))
    items = F.from_json(js, "notes array<string>")["notes"]
    shape = "text string, entities string, confidence string, volatility string, source_urls array<string>"
    notes = F.transform(items, lambda s: F.from_json(F.when(s.startswith("{"), s), shape))
    good = F.filter(notes, lambda n: F.coalesce(F.trim(n["text"]), F.lit("")) != "")
    df = outputs.select("run", F.size(F.coalesce(items, F.array().cast("array<string>"))).alias("n_items"), good.alias("good"))
    rows = df.select("run", F.posexplode(F.slice("good", 1, MAX_NOTES)).alias("pos", "n"))
    levels, vols = ("high", "medium", "low"), ("stable", "drifting", "volatile")
    flat = rows.select(
        "run", "pos", F.substring(F.trim("n.text"), 1, NOTE_CHARS).alias("text"), X.split_entities(F.coalesce("n.entities", F.lit(""))).alias("entities"),
        X.coerce_enum(F.coalesce("n.confidence", F.lit("")), levels, "medium").alias("confidence"), X.coerce_enum(F.coalesce("n.volatility", F.lit("")), vols, "stable").alias("volatility"),
        F.coalesce("n.source_urls", F.array().cast("array<string>")).alias("urls"),
    )
    kept = flat.select("run", "pos", F.explode("urls").alias("url")).join(pool.select("run", "url").distinct(), ["run", "url"], "left_semi").groupBy("run", "pos").agg(F.count("*").alias("n_urls"))
    return flat.drop("urls").join(kept, ["run", "pos"], "left").withColumn("n_urls", F.coalesce("n_urls", F.lit(0)).cast("bigint"))


def extraction_counters(outputs: DataFrame) -> DataFrame:
    items = F.from_json(first_json(F.col("raw")), "notes array<string>")["notes"]
    texts = F.transform(items, lambda s: F.from_json(F.when(s.startswith("{"), s), "text string")["text"])
    good = F.filter(texts, lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    return outputs.select(
        "run", F.coalesce(F.size(items) - F.size(good), F.lit(0)).alias("dropped"), F.coalesce(F.size(F.filter(good, lambda t: F.length(F.trim(t)) > NOTE_CHARS)), F.lit(0)).alias("cut"),
        F.greatest(F.coalesce(F.size(good), F.lit(0)) - MAX_NOTES, F.lit(0)).alias("over_cap"),
    )


def extracted_conflicts(outputs: DataFrame) -> DataFrame:
    items = F.from_json(first_json(F.col("raw")), "conflicts array<string>")["conflicts"]
    rows = F.transform(items, lambda s: F.from_json(F.when(s.startswith("{"), s), "summary string, action string"))
    good = F.filter(rows, lambda r: F.coalesce(F.trim(r["summary"]), F.lit("")) != "")
    return outputs.select("run", F.posexplode(F.slice(good, 1, MAX_CONFLICTS)).alias("pos", "c")).select("run", "pos", F.trim("c.summary").alias("summary"), F.coalesce(F.trim("c.action"), F.lit("")).alias("action"))


def judge_scores(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds coverage, citation and temporal (1..5, rounded half to even), all NULL unless all three are finite
    numbers and the reasons are text."""
    v = F.try_parse_json(first_json(F.col(raw)))
    df = outputs.withColumn("_v", v)

    def kind(name):
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))

    def number(name):
        return kind(name).rlike("^(BIGINT|DOUBLE|DECIMAL)") & ~F.isnan(F.try_variant_get("_v", f"$.{name}", "double"))

    ok = F.coalesce(kind("reasons") == "STRING", F.lit(False))
    for s in SCORES:
        ok = ok & F.coalesce(number(s), F.lit(False))
    def score(name):
        return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.try_variant_get("_v", f"$.{name}", "double"), 0).cast("int")))
    return df.withColumns({s: F.when(ok, score(s)) for s in SCORES}).drop("_v")


def error_class(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(c.rlike(AUTH_MARK), "auth").when(c.rlike(NETWORK_MARK), "network").otherwise("protocol")


def classify_rounds(turns: DataFrame) -> DataFrame:
    """(round_id, verdict, args_ok): one verdict per round of at most a few turns.

    ``turns``: round_id, turn, expected (tool name, '' for none), follow_up, name, raw_arguments, error.
    """
    calls = F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("turn", "name", "raw_arguments"))))
    g = turns.groupBy("round_id").agg(F.max("expected").alias("expected"), F.max("follow_up").alias("follow_up"), F.max(F.coalesce("error", F.lit(""))).alias("error"), calls.alias("calls"))
    hit = F.try_element_at(F.filter("calls", lambda c: c["name"] == F.col("expected")), F.lit(1))
    g = g.withColumn("hit", hit).withColumn("second", F.try_element_at(F.filter("calls", lambda c: c["turn"] == 2), F.lit(1)))
    unknown = F.exists("calls", lambda c: ~c["name"].isin(*TOOLS))
    args = F.try_parse_json(F.col("hit.raw_arguments"))
    is_object = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))
    valid = F.lit(False)
    for tool, field in TOOLS.items():
        value = F.try_variant_get(args, f"$.{field}", "variant")
        text = F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)) & (F.coalesce(F.try_variant_get(args, f"$.{field}", "string"), F.lit("")) != "")
        valid = valid | ((F.col("hit.name") == tool) & text)
    args_ok = is_object & valid
    repeated = F.col("follow_up") & (F.col("second.name") == F.col("hit.name")) & (F.col("second.raw_arguments") == F.col("hit.raw_arguments")) & (F.col("hit.turn") == 1)
    verdict = (
        F.when(F.col("error") != "", "provider_error")
        .when(F.col("expected") == "", F.when(F.size("calls") > 0, "unwanted_call").otherwise("ok"))
        .when(F.size("calls") == 0, "no_call").when(unknown, "name_hallucinated").when(F.col("hit").isNull(), "wrong_tool")
        .when(~args_ok, "bad_arguments").when(F.coalesce(repeated, F.lit(False)), "repeated_call").otherwise("ok")
    )
    return g.select("round_id", "expected", verdict.alias("verdict"), verdict.isin("ok", "repeated_call").alias("args_ok"))


def request_hash(messages: DataFrame, model: str, key: str = "conv_id", tools: str | None = None) -> DataFrame:
    """One hash per request: model, messages in their turns, and tools.

    A message counts with its role and content and, where it has them, its name, call id and calls (columns ``name``,
    ``tool_call_id``, ``tool_calls``; null and empty are not set). Each message is hashed with its turn, and the
    sums of the hashes are hashed, so a request of any length is folded by map-side partial sums.
    """
    more = [F.coalesce(F.concat(F.lit(f"{c}="), F.nullif(F.col(c), F.lit(""))), F.lit("")) for c in ("name", "tool_call_id", "tool_calls") if c in messages.columns]
    h = F.md5(F.concat_ws("\x1f", F.col("turn").cast("string"), "role", "content", *more))

    def part(start: int) -> Column:
        return F.conv(F.substring(h, start, 15), 16, 10).cast("decimal(38,0)")

    g = messages.groupBy(key).agg(F.count("*").alias("n"), F.sum(part(1)).alias("s1"), F.sum(part(16)).alias("s2"))
    text = F.concat_ws("|", F.lit(model), F.lit(tools or ""), F.col("n").cast("string"), F.col("s1").cast("string"), F.col("s2").cast("string"))
    return g.select(key, F.sha2(text, 256).alias("request_hash"))


def replay_index(requests: DataFrame) -> DataFrame:
    """(request_hash, seq, response, n): the first stored response of each request and how often it was asked."""
    return requests.groupBy("request_hash").agg(F.min_by(F.struct("seq", "response"), "seq").alias("r"), F.count("*").alias("n")).select("request_hash", "r.seq", "r.response", "n")
