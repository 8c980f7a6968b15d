"""Fact extraction and the comparison of a stored note with new evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import merge

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kledger.functions import temporal as T
from kledger.functions import text as X
from kledger.functions import vectors as V
from kledger.session import cut_lineage, written

# What a date, chapter, version, percentage and number look like, in order of priority; the
# characters that end the word before a token; verdicts and the action each one suggests.
DATE = r"\d{4}-\d{2}(?:-\d{2})?|\d{4}\s*年\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?"
CHAPTER = r"第\s*\d+\s*[章节条款]|(?:[Cc]hapter|CH)\s*\d+"
VERSION = r"[vV]?\d+(?:\.\d+)+(?:[-.][A-Za-z][\w.]*)?"
PERCENT = r"\d+(?:\.\d+)?\s*%"
NUMBER = r"\d+(?:\.\d+)?"
UNIT = r"[A-Za-z%]{1,4}|[年月日天周次个条块倍位万亿人]"
BREAKS = frozenset("，。；、：:,.!?！？()（）「」【】[]\"'`*#>_+/=~|&")
KINDS = {"date": DATE, "chapter": CHAPTER, "version": VERSION, "percent": PERCENT, "number": rf"({NUMBER})\s*({UNIT})?"}
ACTIONS = {"consistent": "refresh_reviewed_at", "newer": "supersede", "more_specific": "merge", "conflicting": "open_conflict", "uncertain": "none"}
CONSERVATIVE = ("conflicting", "uncertain")
GUARD = "entities_disjoint"
CONTEXT_CHARS = 6


@dataclass(frozen=True)
class VerificationSettings:
    """Thresholds. The consistency bound is at least the floor; the replacement gate lies between the two."""

    floor: float = 0.3
    consistent: float = 0.8
    supersede: float = 0.6

    def normalized(self) -> VerificationSettings:
        f = min(1.0, max(0.0, self.floor))
        c = max(f, min(1.0, max(0.0, self.consistent)))
        return VerificationSettings(f, c, min(c, max(f, self.supersede)))


def normalized_columns(floor: Column, consistent: Column, supersede: Column) -> list[Column]:
    """The same clamping over a settings table."""
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), floor))
    c = F.greatest(f, F.least(F.lit(1.0), F.greatest(F.lit(0.0), consistent)))
    return [f.alias("floor"), c.alias("consistent"), F.least(c, F.greatest(f, supersede)).alias("supersede")]


SCANS = [(kind, re.compile(pattern)) for kind, pattern in KINDS.items()]
CJK_DATE = re.compile(r"(\d{4})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?")
TOKENS = "array<struct<pos: int, kind: string, value: string, raw: string, unit: string, context: string, slot: string>>"


def _value(kind: str, raw: str) -> str:
    """What is compared: ISO dates, numbered parts, versions without prefix, numbers with six significant digits."""
    if kind == "date":
        cjk = CJK_DATE.search(raw)
        return "-".join(f"{int(x):0{4 if i == 0 else 2}d}" for i, x in enumerate(cjk.groups()) if x) if cjk else raw
    if kind == "chapter":
        part = "章" if "章" in raw or "ch" in raw.lower() else next((c for c in "节条" if c in raw), "款")
        return f"{int(re.search(r'\d+', raw).group())}{part}"
    if kind == "version":
        return raw.lstrip("vV").rstrip(".-").lower()
    return raw.replace(" ", "") if kind == "percent" else f"{float(raw):g}"


def _context(text: str, start: int) -> str:
    """The word that ends before ``start``: back to white space, a digit or a break (a hyphen is none), its last characters."""
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin and not (text[begin - 1] in BREAKS or text[begin - 1].isspace() or text[begin - 1].isdecimal()):
        begin -= 1
    return text[begin:end].strip("-")[-CONTEXT_CHARS:]


def _spans(rank: int, text: str) -> Iterator[tuple[int, int, re.Match]]:
    return ((m.start(), rank, m) for m in SCANS[rank][1].finditer(text))


def sweep(text: str | None) -> list[dict]:
    """The fact tokens of one text. Every kind is searched on its own; where spans overlap, the one that starts first stays,
    of those with one start the kind named first. ``pos`` counts what stays; a (kind, value, slot) is kept once."""
    out: dict[tuple, dict] = {}
    free = pos = 0
    for start, rank, m in merge(*(_spans(rank, text or "") for rank in range(len(SCANS))), key=lambda s: s[:2]):
        if start < free:
            continue
        free, kind = m.end(), SCANS[rank][0]
        raw, unit = (m.group(1), (m.group(2) or "").lower()) if kind == "number" else (m.group(), "")
        context, value = _context(text, start), _value(kind, raw)
        slot = f"{kind}:{unit}:{context}" if kind == "number" else f"{kind}:{context}"
        out.setdefault((kind, value, slot), {"pos": pos, "kind": kind, "value": value, "raw": raw, "unit": unit, "context": context, "slot": slot})
        pos += 1
    return list(out.values())


def tokens(text: str | Column) -> Column:
    """The fact tokens of each text. The sweep depends on what the last token covered, which column expressions cannot carry."""

    @F.pandas_udf(TOKENS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sweep(t) for t in texts])

    return found(text)


def fact_tokens(texts: DataFrame, owner: str = "owner_id", column: str = "text") -> DataFrame:
    """(owner, pos, kind, value, raw, unit, context, slot), each (kind, value, slot) of an owner once, at its first position."""
    return texts.select(owner, F.inline(tokens(F.col(column))))


def comparable() -> Column:
    """A bare number, with neither unit nor context, is not compared."""
    return (F.col("kind") != "number") | (F.col("unit") != "") | (F.col("context") != "")


def slot_values(tokens: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, slot, n_values, values in order of appearance) over comparable tokens."""
    g = tokens.filter(comparable()).groupBy(owner, "slot").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return g.select(owner, "slot", F.size("v").alias("n_values"), F.array_join("v.value", "|").alias("values"))


def slot_scan(pairs: DataFrame, prior_tokens: DataFrame, evidence_tokens: DataFrame) -> DataFrame:
    """Per pair: conflicts, skipped slots, agreement, new tokens and token counts.

    ``pairs``: (pair_id, prior_id, evidence_id); token tables are keyed by owner_id. Both sides are stacked and
    folded per (pair, slot), then per pair; no side is joined to the other token by token.
    """
    cols = ["kind", "value", "slot", "unit", "context"]
    p = pairs.select("pair_id", F.col("prior_id").alias("owner_id")).join(prior_tokens.select("owner_id", *cols), "owner_id").withColumn("side", F.lit(0))
    e = pairs.select("pair_id", F.col("evidence_id").alias("owner_id")).join(evidence_tokens.select("owner_id", *cols), "owner_id").withColumn("side", F.lit(1))
    both = cut_lineage(p.unionByName(e))  # read by the slot fold and by the label fold
    left, right = F.col("side") == 0, F.col("side") == 1
    slots = both.filter(comparable()).groupBy("pair_id", "slot").agg(
        F.count_if(left).alias("np"), F.count_if(right).alias("ne"), F.min(F.when(left, F.col("value"))).alias("vp"), F.min(F.when(right, F.col("value"))).alias("ve")
    )
    met = (F.col("np") > 0) & (F.col("ne") > 0)
    single = (F.col("np") == 1) & (F.col("ne") == 1)
    slot_part = slots.groupBy("pair_id").agg(
        F.count_if(single & (F.col("vp") != F.col("ve"))).alias("n_conflicts"),
        F.count_if(met & ~single).alias("n_skipped"),
        F.count_if(~(single & (F.col("vp") == F.col("ve")))).alias("n_unequal"),
        F.min(F.when(single & (F.col("vp") != F.col("ve")), F.struct("slot", "vp", "ve"))).alias("first_conflict"),
    )
    labels = both.groupBy("pair_id", "kind", "value").agg(F.count_if(left).alias("np"), F.count_if(right).alias("ne"))
    token_part = labels.groupBy("pair_id").agg(
        F.sum("np").alias("n_prior_tokens"), F.sum("ne").alias("n_evidence_tokens"), F.coalesce(F.sum(F.when(F.col("np") == 0, F.col("ne"))), F.lit(0)).alias("n_new_tokens")
    )
    out = pairs.join(slot_part, "pair_id", "left").join(token_part, "pair_id", "left")
    counts = ["n_conflicts", "n_skipped", "n_unequal", "n_prior_tokens", "n_evidence_tokens", "n_new_tokens"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts}).withColumn("slots_agree", F.col("n_unequal") == 0).drop("n_unequal")


def entities_disjoint(a: Column, b: Column) -> Column:
    """Both sides name entities and none is shared. Keys are slugs."""
    ka, kb = F.transform(a, lambda x: X.slugify(x)), F.transform(b, lambda x: X.slugify(x))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(ka, kb), F.lit(False))


def matched_source(sources: Column, url: Column) -> Column:
    """The first source of the note with exactly this URL, or NULL."""
    return F.when(url != "", F.try_element_at(F.filter(sources, lambda s: s["url"] == url), F.lit(1)))


def compare(pairs: DataFrame, settings: VerificationSettings | None = None) -> DataFrame:
    """Verdict, suggested action and guard of every pair.

    ``pairs``: pair_id, prior_id, evidence_id, prior_text, evidence_text, prior_entities, evidence_entities,
    sources, source_url, content_hash, source_changed_at, observed_at, created, evidence_observed_at. Pair
    ids are unique; a note is encoded and scanned once, and its text is not carried through the comparison.
    """
    cfg = (settings or VerificationSettings()).normalized()
    prior = pairs.select(F.lit(0).alias("side"), F.col("prior_id").alias("owner_id"), F.col("prior_text").alias("text"))
    evidence = pairs.select(F.lit(1).alias("side"), F.col("evidence_id").alias("owner_id"), F.col("evidence_text").alias("text"))
    notes = prior.unionByName(evidence).dropDuplicates(["side", "owner_id"])
    read = written(notes.select("side", "owner_id", V.encoder()("text").alias("v"), tokens("text").alias("t")), "compare-notes")  # a note is read once, however many pairs it is in
    meta = pairs.drop("prior_text", "evidence_text")
    if "similarity" not in pairs.columns:
        a, b = (read.filter(f"side = {i}").select(F.col("owner_id").alias(n), F.col("v").alias(f"_{n}")) for i, n in ((0, "prior_id"), (1, "evidence_id")))
        sim = V.similarity_from(V.dot(F.col("_prior_id"), F.col("_evidence_id")), V.norm2(F.col("_prior_id")), V.norm2(F.col("_evidence_id")))
        meta = meta.join(a, "prior_id").join(b, "evidence_id").withColumn("similarity", sim).drop("_prior_id", "_evidence_id")
    sims = meta.withColumn("disjoint", entities_disjoint(F.col("prior_entities"), F.col("evidence_entities"))).withColumn("ref", matched_source(F.col("sources"), F.col("source_url")))
    sims = cut_lineage(sims)  # read by the floor, the token scan and the ladder; it holds no text
    above = sims.filter(F.col("similarity") >= cfg.floor)
    p_tok, e_tok = (read.filter(f"side = {i}").select("owner_id", F.inline("t")) for i in (0, 1))
    scan = slot_scan(above.select("pair_id", "prior_id", "evidence_id"), p_tok, e_tok).drop("prior_id", "evidence_id")
    df = sims.join(scan, "pair_id", "left")
    changed = T.parse_ts(F.col("source_changed_at"))
    swapped = F.col("ref").isNotNull() & (F.col("content_hash") != "") & (F.col("content_hash") != F.col("ref.content_hash")) & changed.isNotNull()
    later = T.parse_ts(F.col("evidence_observed_at")) > T.base_time(F.col("observed_at"), F.col("created"))
    sim, gate = F.col("similarity"), F.col("similarity") >= cfg.supersede
    verdict = (
        F.when(sim < cfg.floor, "uncertain").when(F.col("disjoint"), "uncertain").when(F.col("n_conflicts") > 0, "conflicting")
        .when(swapped & gate, "newer")
        .when((sim >= cfg.consistent) & (F.col("n_new_tokens") == 0) & (F.col("n_skipped") == 0) & F.col("slots_agree"), "consistent")
        .when(later & gate, "newer").when(F.col("n_evidence_tokens") > F.col("n_prior_tokens"), "more_specific").otherwise("uncertain")
    )
    guard = F.when((sim >= cfg.floor) & F.col("disjoint"), GUARD)
    out = df.withColumn("verdict", verdict).withColumn("guard", guard)
    out = out.withColumn("suggested_action", action_of(F.col("verdict"))).withColumn("below_floor", sim < cfg.floor).drop("disjoint", "ref")
    return out.join(pairs.select("pair_id", "prior_text", "evidence_text"), "pair_id")


def action_of(verdict: Column) -> Column:
    out = F.lit("none")
    for v, a in ACTIONS.items():
        out = F.when(verdict == v, a).otherwise(out)
    return out


def apply_judgements(compared: DataFrame, judgements: DataFrame) -> DataFrame:
    """Outside verdicts, from a table (pair_id, judged): used only where the ladder ended uncertain above the
    floor, and under a guard only if conservative. The raw word is kept."""
    j = judgements.select("pair_id", F.lower(F.trim("judged")).alias("judge_verdict"))
    df = compared.join(j, "pair_id", "left")
    open_row = (F.col("verdict") == "uncertain") & ~F.col("below_floor")
    known = F.col("judge_verdict").isin(*ACTIONS)
    allowed = known & (F.col("guard").isNull() | F.col("judge_verdict").isin(*CONSERVATIVE))
    final = F.when(open_row & F.coalesce(allowed, F.lit(False)), F.col("judge_verdict")).otherwise(F.col("verdict"))
    return df.withColumn("final_verdict", final).withColumn("final_action", action_of(final)).withColumn("judge_verdict", F.when(open_row & known, F.col("judge_verdict")))
