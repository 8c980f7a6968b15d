"""Text, hash and coercion expressions. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of identifiers, links and decoration this data model uses.
NOTE_REF = r"\bN-\d+\b"
ENTITY_LINK = r"\[\[entity:([^\]|]+?)(?:\|[^\]]*)?\]\]"
CITATION = r"\[(\d+)\]"
FENCE_LINE = r"(?m)^[ \t]*(?:```|~~~)[^\n]*$"
HEADING = r"^#{1,6}\s"
DECORATION = r"[\s\-*+>·、,，;；:：.。!！?？|/\\()（）\[\]【】{}<>《》“”\"'`#~=_]+"
ANY_LINK = r"\[\[[^\]]*\]\]"
ENTITY_SEPARATORS = r"[，,、;；/|]+"
SAFE_ID = r"^[A-Za-z][A-Za-z0-9_-]{0,63}$"
FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
ASCII_FOLD = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

SNIPPET_CHARS = 120


def slugify(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\x{4E00}-\x{9FFF}]+", "-"), "^-+|-+$", "")
    return F.when(base != "", base).otherwise(F.concat(F.lit("e-"), F.substring(F.sha1(c), 1, 8)))


def alias_key(c: Column) -> Column:
    """Lower-cased and trimmed; differs from full case folding only for letters such as the German sharp s."""
    return F.lower(F.trim(c))


def coerce_enum(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def dedupe_by(arr: Column, key) -> Column:
    """First occurrence of each key, order kept. ``arr`` is a short list (entities, sources of one row)."""
    keys = F.transform(arr, key)
    return F.filter(arr, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def split_entities(c: Column, limit: int = 6) -> Column:
    """The first ``limit`` names that differ in lower case. One walk: a part is compared with the names kept so far."""
    parts = F.filter(F.transform(F.split(c, ENTITY_SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")

    def keep(kept, x):
        full = (F.size(kept) >= limit) | F.exists(kept, lambda y: F.lower(y) == F.lower(x))
        return F.when(full, kept).otherwise(F.array_append(kept, x))

    return F.aggregate(parts, F.array().cast("array<string>"), keep)


def nfkc(c: Column) -> Column:
    """Compatibility composition (NFKC), batch by batch; composition is no built-in expression."""

    @F.pandas_udf("string")
    def fold(xs: pd.Series) -> pd.Series:
        return xs.str.normalize("NFKC")

    return fold(c)


def nfkc_each(c: Column) -> Column:
    """NFKC of every string of an array."""

    @F.pandas_udf("array<string>")
    def fold(xs: pd.Series) -> pd.Series:
        return xs.map(lambda a: None if a is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in a])

    return fold(c)


def normalize_folded(c: Column) -> Column:
    """Lower, keep word characters, percent signs and dots between digits, of a text that is composed already."""
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\w%.]+", "")
    return F.regexp_replace(kept, r"(?<![0-9])\.|\.(?![0-9])", "")


def normalize_answer(c: Column) -> Column:
    return normalize_folded(nfkc(c))


def once(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once: what a lambda names is a value, what an expression names twice may run twice."""
    return F.transform(F.array(c), f)[0]


def chars(c: Column) -> Column:
    """The code points of a text as an array. ``split(x, '')`` walks the text once; ``substr`` per index would not."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def ngrams(c: Column, n: int) -> Column:
    """All n-grams in order. Shifted copies are zipped, so the text is split once, not once per position."""

    def zipped(cs):
        out = cs
        for k in range(1, n):
            out = F.zip_with(out, F.slice(cs, k + 1, F.greatest(F.size(cs), F.lit(1))), lambda x, y: F.concat(x, y))
        return F.filter(out, lambda x: x.isNotNull())

    return once(chars(c), zipped)


def bigram_set(c: Column) -> Column:
    return F.array_distinct(ngrams(F.regexp_replace(c, r"\s+", ""), 2))


def _bigram_codes(text: str) -> np.ndarray:
    """The elements of ``bigram_set`` as sorted numbers."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cp = cp[(cp > 32) | (cp < 9) | ((cp > 13) & (cp < 32))]
    return np.unique((cp[:-1] << 21) | cp[1:])


def bigram_sizes(a: Column, b: Column) -> Column:
    """struct(a, b, both): sizes of the ``bigram_set`` of two texts and of what they share, batch by batch.

    As column expressions every bigram is a string of its own, several times over; here a text is one array of numbers.
    """

    @F.pandas_udf("a long, b long, both long")
    def count(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys, strict=True):
            p, q = (None if t is None else _bigram_codes(t) for t in (x, y))
            both = None if p is None or q is None else len(np.intersect1d(p, q, assume_unique=True))
            rows.append((None if p is None else len(p), None if q is None else len(q), both))
        return pd.DataFrame(rows, columns=["a", "b", "both"], dtype=object)

    return count(a, b)


def jaccard(sizes: Column) -> Column:
    a, b, both = sizes["a"], sizes["b"], sizes["both"]
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both / (a + b - both).cast("double"))


def overlap_coefficient(sizes: Column) -> Column:
    low = F.least(sizes["a"], sizes["b"])
    return F.when(low == 0, F.lit(0.0)).otherwise(sizes["both"] / low.cast("double"))


def record_fingerprint(title, body, confidence, volatility, kind, redirect_to, superseded_by, observed_at, created, tombstone, importance) -> Column:
    """One hash over everything retrieval reads. An unknown importance is not the same as 0.0."""
    blank = F.lit("")
    parts = [F.coalesce(x, blank) for x in (title, body, confidence, volatility, kind, redirect_to, superseded_by, observed_at, created)]
    parts += [F.when(tombstone, "1").otherwise("0"), F.coalesce(importance.cast("string"), blank)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def evidence_key(text: Column) -> Column:
    return F.substring(F.sha1(F.trim(text)), 1, 16)


def idempotency_key(action: Column, ids: Column, hashes: Column, params: Column) -> Column:
    ids = F.array_join(F.sort_array(ids), ",")
    return F.sha2(F.concat_ws("\n", action, ids, F.array_join(hashes, ","), params), 256)


def derive_title(body: Column, n: int = 60) -> Column:
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[#>*\- ]+", "")))
    return F.substring(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), 1, n)


def normalize_note_id(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), r"\\", "/")
    t = F.regexp_replace(t, r"\.md$", "")
    t = F.regexp_replace(t, r"^(wiki-data/)?(\./)?(notes/)?", "")
    return F.when(t.rlike(SAFE_ID), t)


def estimated_tokens(c: Column) -> Column:
    """East Asian characters count one each, the rest one per four, rounded up. An estimate, never a bill."""
    text = F.coalesce(c, F.lit(""))
    wide = F.length(F.regexp_replace(text, r"[^\x{2E80}-\x{10FFFF}]", ""))
    return (wide + F.ceil((F.length(text) - wide) / 4.0)).cast("bigint")


def snippet(c: Column, n: int = SNIPPET_CHARS) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "…").otherwise(""))


def highlight(body: Column, phrase: Column, before: int = 30, after: int = 30) -> Column:
    """A window around the first case-insensitive hit, the hit in brackets."""
    at = F.position(F.lower(phrase), F.lower(body))
    start = F.greatest(at - before, F.lit(1))
    return F.when(
        at > 0,
        F.concat(
            F.substr(body, start, at - start), F.lit("["), F.substr(body, at, F.length(phrase)), F.lit("]"),
            F.substr(body, at + F.length(phrase), F.lit(after)),
        ),
    )


def note_refs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NOTE_REF), 0))


def entity_links(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ENTITY_LINK), 1))


def citation_numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CITATION), 1), lambda x: x.try_cast("int")))


def is_assertion(line: Column) -> Column:
    t = F.trim(line)
    core = F.regexp_replace(F.regexp_replace(t, ANY_LINK, ""), DECORATION, "")
    return (t != "") & ~t.rlike(r"^\s*(```|~~~)") & ~t.rlike(HEADING) & (core != "")


def has_specifics(c: Column) -> Column:
    return c.rlike(r"[0-9]") | c.rlike(r"[A-Za-z]") | c.rlike("[「『“\"'][^」』”\"']+[」』”\"']")


def open_tasks(plan: Column) -> Column:
    lines = F.transform(F.split(plan, "\n"), lambda x: F.trim(x))
    boxes = F.filter(lines, lambda x: x.rlike(r"^- \[ \]\s+\S"))
    items = F.filter(lines, lambda x: x.rlike(r"^-\s+\S"))
    return F.when(F.size(boxes) > 0, boxes).otherwise(items)


def source_docs(c: Column) -> Column:
    block = F.regexp_extract(c, "来源：([^。]*)。", 1)
    return F.filter(F.transform(F.split(block, "、"), lambda x: F.trim(x)), lambda x: x != "")


def version_base(c: Column) -> Column:
    return F.regexp_replace(c, "@v2$", "")


def ratio(c: Column, default: float) -> Column:
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def count_floor(c: Column, default: int) -> Column:
    v = F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("bigint"))
    return F.greatest(F.lit(0), F.coalesce(v, F.lit(default))).cast("bigint")


def flag(c: Column, default: bool) -> Column:
    v = F.lower(F.trim(c))
    return (
        F.when(v.isin("1", "true", "yes", "on", "y", "t"), F.lit(True))
        .when(v.isin("0", "false", "no", "off", "n", "f"), F.lit(False))
        .otherwise(F.lit(default))
    )
