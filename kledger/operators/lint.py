"""Integrity checks over links, citations and evidence, and the two repairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.session import written


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, line, in_fence): every line of every page, numbered from 1.

    Cutting the body at its fence lines leaves pieces that alternate between outside and inside, so a page
    is read within its own row and nothing is shuffled.
    """

    def breaks(s):
        return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def pieces(p):
        def piece(s, i):
            before = F.aggregate(F.slice(p["breaks"], 1, i), F.lit(0), lambda acc, n: acc + n)  # once a piece, not once a line
            return X.once(before, lambda b: F.transform(F.split(s, "\n", -1), lambda line, m: F.struct((b + m + 1).alias("line_no"), line.alias("line"), (i % 2 == 1).alias("in_fence"))))

        return F.flatten(F.transform(p["parts"], piece))

    cut = X.once(F.split(F.col("body"), X.FENCE_LINE, -1), lambda parts: F.struct(parts.alias("parts"), F.transform(parts, breaks).alias("breaks")))
    return pages.select("page_id", F.explode(X.once(cut, pieces)).alias("l")).select("page_id", "l.line_no", "l.line", "l.in_fence")


def assertion_lines(pages: DataFrame) -> DataFrame:
    lines = page_lines(pages).filter(~F.col("in_fence") & X.is_assertion(F.col("line")))
    return lines.select("page_id", "line_no", F.trim("line").alias("line"), F.col("line").rlike(X.NOTE_REF).alias("cited"))


def uncited_lines(pages: DataFrame) -> DataFrame:
    return assertion_lines(pages).filter("NOT cited").select("page_id", "line_no", "line")


def citation_coverage(pages: DataFrame) -> DataFrame:
    a = assertion_lines(pages).agg(F.count("*").alias("assertion_lines"), F.count_if("cited").alias("cited_lines"))
    return a.withColumn("coverage", F.coalesce(F.try_divide(F.col("cited_lines").cast("double"), F.col("assertion_lines").cast("double")), F.lit(1.0)))


def references(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """(source, ref): note ids named in pages and in note bodies, a note naming itself left out."""
    p = pages.select(F.concat(F.lit("page:"), "page_id").alias("source"), F.explode(X.note_refs(F.col("body"))).alias("ref"))
    n = notes.select("note_id", F.explode(X.note_refs(F.col("body"))).alias("ref")).filter("ref <> note_id")
    return p.unionByName(n.select(F.concat(F.lit("note:"), "note_id").alias("source"), "ref"))


def resolved_references(refs: DataFrame, chains: DataFrame) -> DataFrame:
    """Adds canonical_id and outcome (``missing`` when the id is not stored).

    One id may be named by a third of all sources, so names are folded to distinct ids before the chains
    are joined, and the hot id meets its sources in a join that adaptive execution can split.
    """
    state = refs.select("ref").distinct().join(chains.select(F.col("note_id").alias("ref"), "canonical_id", "outcome"), "ref", "left")
    state = state.withColumn("outcome", F.coalesce("outcome", F.lit("missing")))
    return refs.join(state, "ref")


def entity_references(pages: DataFrame, notes: DataFrame) -> DataFrame:
    both = pages.select(F.concat(F.lit("page:"), "page_id").alias("source"), "body").unionByName(notes.select(F.concat(F.lit("note:"), "note_id").alias("source"), "body"))
    return both.select("source", F.explode(X.entity_links(F.col("body"))).alias("slug")).filter("slug <> ''")


def broken_links(pages: DataFrame, notes: DataFrame, chains: DataFrame, aliases: DataFrame) -> DataFrame:
    note_part = resolved_references(references(pages, notes), chains).filter("outcome <> 'active'")
    ent = entity_references(pages, notes).withColumn("alias_key", X.alias_key(F.col("slug"))).join(aliases, "alias_key", "left_anti")
    return note_part.select(F.lit("note").alias("kind"), "source", F.col("ref").alias("target"), F.col("outcome").alias("reason")).unionByName(
        ent.select(F.lit("entity").alias("kind"), "source", F.col("slug").alias("target"), F.lit("unregistered").alias("reason"))
    )


def merged_references(pages: DataFrame, notes: DataFrame, chains: DataFrame) -> DataFrame:
    r = resolved_references(references(pages, notes), chains)
    return r.filter("outcome = 'active' AND ref <> canonical_id").select("source", F.col("ref").alias("referenced"), "canonical_id")


def orphans(pages: DataFrame, notes: DataFrame, chains: DataFrame) -> DataFrame:
    p = pages.select(F.explode(X.note_refs(F.col("body"))).alias("ref")).distinct()
    cited = p.join(chains.filter("outcome = 'active'").select(F.col("note_id").alias("ref"), "canonical_id"), "ref").select(F.col("canonical_id").alias("note_id"))
    return notes.filter("status = 'active'").select("note_id").join(cited, "note_id", "left_anti")


def dangling_evidence(notes: DataFrame, snapshots: DataFrame, status: str | None = "active") -> DataFrame:
    """(note_id, url, content_hash) without a stored snapshot; an empty hash never has one."""
    rows = notes if status is None else notes.filter(F.col("status") == status)
    src = rows.select("note_id", F.explode("sources").alias("s")).select("note_id", "s.url", "s.content_hash").distinct()
    return src.join(snapshots.select("url", "content_hash").distinct(), ["url", "content_hash"], "left_anti").select("note_id", "url", "content_hash")


def index_drift(store: DataFrame, index: DataFrame) -> DataFrame:
    """Reason per drifted id. Both sides: (note_id, status, fingerprint); an empty indexed fingerprint is legacy."""
    s = store.select("note_id", F.col("status").alias("s_status"), F.col("fingerprint").alias("s_fp"))
    i = index.select("note_id", F.col("status").alias("i_status"), F.coalesce("fingerprint", F.lit("")).alias("i_fp"))
    reason = F.concat_ws(
        ",",
        F.when(F.col("i_status").isNull(), "missing"), F.when(F.col("s_status").isNull(), "extra"),
        F.when(F.col("i_status") != F.col("s_status"), "status"), F.when((F.col("i_fp") == "") & F.col("s_fp").isNotNull(), "legacy"),
        F.when((F.col("i_fp") != "") & (F.col("i_fp") != F.col("s_fp")), "changed"),
    )
    return s.join(i, "note_id", "full_outer").select("note_id", reason.alias("reason")).filter("reason <> ''")


LINES, NOTES = 1024, 8192
BEST = "page_id string, line_no int, note_id string, score double"


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code): the distinct pairs of neighbouring characters of each text, sorted; a single character is its own."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    owner, last = np.repeat(np.arange(len(texts)), size), np.cumsum(size) - 1
    code = (cp + 1) << 21
    code[:-1] |= cp[1:]
    keep = np.ones(len(cp), bool)
    keep[last[size > 1]] = False
    code[last[size == 1]] = cp[last[size == 1]]
    owner, code = owner[keep], code[keep]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return owner[new], code[new]


def _best_of_page(notes: list[tuple[str, np.ndarray]], lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(score, place of the note) of each line by overlap coefficient; ``notes`` are in id order, so ties keep the first."""
    owner, code = gram_codes(lines)
    n = np.bincount(owner, minlength=len(lines))
    best, at = np.zeros(len(lines)), np.zeros(len(lines), np.int64)
    for j, (_, grams) in enumerate(notes):
        if not len(grams):
            continue
        hit = grams[np.minimum(np.searchsorted(grams, code), len(grams) - 1)] == code
        low = np.minimum(n, len(grams))
        score = np.divide(np.bincount(owner[hit], minlength=len(lines)), low, out=np.zeros(len(lines)), where=low > 0)
        better = score > best
        best[better], at[better] = score[better], j
    return best, at


def _best_in_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by page and slices, the notes of a slice in id order before its lines; many pages are read in one call."""
    key, notes, lines, out, made = None, [], [], [], 0

    def close() -> int:
        if notes and lines:
            best, at = _best_of_page(notes, [t for _, t in lines])
            out.extend((key[0], lines[i][0], notes[at[i]][0], float(best[i])) for i in np.flatnonzero(best > 0))
        lines.clear()
        return len(out)

    for f in frames:
        for page, n, q, line_no, note, text in zip(f["page_id"], f["_n"], f["_q"], f["line_no"], f["note_id"], f["text"], strict=True):
            if key != (page, n, q):
                made = close()
                key, notes = (page, n, q), []
            if note is not None:
                notes.append((note, gram_codes([text])[1]))
                continue
            lines.append((line_no, text))
            if len(lines) >= LINES:
                made = close()
            if made >= 8 * LINES:
                yield pd.DataFrame(out, columns=["page_id", "line_no", "note_id", "score"])
                out.clear()
                made = 0
    close()
    if out:
        yield pd.DataFrame(out, columns=["page_id", "line_no", "note_id", "score"])


def best_notes(lines: DataFrame, texts: DataFrame, line_block: int = LINES, note_block: int = NOTES) -> DataFrame:
    """Best matching note per line within its page: (page_id, line_no, note_id, score). No overlap, no row.

    Pages are read one after the other inside a task, from one shuffle of lines and texts. A page with many lines
    or notes is cut into slices, and every slice of lines meets every slice of notes.
    """
    compact = lambda c: F.coalesce(F.regexp_replace(c, r"\s+", ""), F.lit(""))
    asked = written(lines.filter("page_id IS NOT NULL").select("page_id", F.col("line_no").cast("int").alias("line_no"), compact("line").alias("text")), "cited-lines")
    given = texts.filter("page_id IS NOT NULL").select("page_id", F.coalesce("note_id", F.lit("None")).alias("note_id"), compact("text").alias("text"))

    def large(df, size, name):
        return df.groupBy("page_id").agg(F.ceil(F.count("*") / size).cast("bigint").alias(name)).filter(f"{name} > 1")

    sizes = written(large(given, note_block, "_ns").join(large(asked, line_block, "_qs"), "page_id", "full_outer"), "large-pages")

    def sliced(df, own, mine, row, other, theirs):
        cut = df.join(sizes, "page_id", "left").withColumns({mine: F.coalesce(mine, F.lit(1)), theirs: F.coalesce(theirs, F.lit(1))})
        return cut.withColumn(own, F.pmod(F.xxhash64(row), F.col(mine))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(theirs) - 1)))

    columns = ["page_id", "_n", "_q", "line_no", "note_id", "text"]
    left = sliced(given, "_n", "_ns", "note_id", "_q", "_qs").withColumn("line_no", F.lit(None).cast("int")).select(*columns)
    right = sliced(asked, "_q", "_qs", "line_no", "_n", "_ns").withColumn("note_id", F.lit(None).cast("string")).select(*columns)
    keys = ["page_id", "_n", "_q"]
    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, F.col("note_id").asc_nulls_last())
    part = both.withColumn("line_no", F.coalesce("line_no", F.lit(-1))).mapInPandas(_best_in_pages, BEST)
    best = part.groupBy("page_id", "line_no").agg(F.min(F.struct((-F.col("score")).alias("s"), "note_id")).alias("b"))
    return best.select("page_id", "line_no", "b.note_id", (-F.col("b.s")).alias("score"))


def annotate_citations(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, line_no, line) of the repaired pages: an uncited assertion ends with the id of the note most
    like it, or of the first note of the page. Lines stay rows; a page is joined to text only when written."""
    lines = page_lines(pages)
    open_lines = uncited_lines(pages)
    first = texts.groupBy("page_id").agg(F.min("note_id").alias("first_id"))
    pick = open_lines.select("page_id", "line_no").join(best_notes(open_lines, texts).drop("score"), ["page_id", "line_no"], "left").join(first, "page_id", "left")
    pick = pick.select("page_id", "line_no", F.coalesce("note_id", "first_id").alias("cite"))
    # the two halves of a fence line share its number; the longer half carries its text
    whole = lines.groupBy("page_id", "line_no").agg(F.max_by("line", F.length("line")).alias("line"))
    return whole.join(pick, ["page_id", "line_no"], "left").select(
        "page_id", "line_no", F.when(F.col("cite").isNotNull(), F.concat(F.rtrim("line"), F.lit("（"), F.col("cite"), F.lit("）"))).otherwise(F.col("line")).alias("line")
    )


LINK_WITH_NAME = r"\[\[entity:([^\]|]+?)(?:\|([^\]]*))?\]\]"


def repair_links(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, body) with links to unregistered entities turned into plain text. Only texts with such a link are rewritten."""
    links = texts.select("id", F.explode(X.entity_links(F.col("body"))).alias("slug"))
    bad = links.withColumn("alias_key", X.alias_key(F.col("slug"))).join(aliases, "alias_key", "left_anti").groupBy("id").agg(F.collect_set("slug").alias("bad"))
    def unlink(acc, slug):
        return F.regexp_replace(acc, F.concat(F.lit(r"\[\[entity:\Q"), slug, F.lit(r"\E(?:\|([^\]]*))?\]\]")), F.lit("$1"))
    fixed = F.aggregate(F.coalesce("bad", F.array().cast("array<string>")), F.col("body"), unlink)
    return texts.join(bad, "id", "left").select("id", fixed.alias("body"))


def ensure_links(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Appends the missing related links, sorted by id. ``wanted``: (id, entity_id, name)."""
    have = texts.select("id", F.explode(X.entity_links(F.col("body"))).alias("s")).select("id", F.lower(F.trim("s")).alias("entity_id")).distinct()
    missing = wanted.join(have, ["id", "entity_id"], "left_anti").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("entity_id", "name"))).alias("add"))
    tail = F.concat(F.lit("\n## Related entities\n\n"), F.array_join(F.transform("add", lambda e: F.concat(F.lit("- [[entity:"), e["entity_id"], F.lit("|"), e["name"], F.lit("]]"))), "\n"), F.lit("\n"))
    return texts.join(missing, "id", "left").select("id", F.when(F.col("add").isNull(), F.col("body")).otherwise(F.concat("body", tail)).alias("body"))
