import math
import re
from collections import Counter

from kledger.llm import likelihood
from kledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def trigrams(text):
    b = (text or "").encode()
    return Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 2))


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1 and r.toxic != 1}
    raw, target = Counter(), Counter()
    for d, t in docs.items():
        raw.update(trigrams(t))
        target.update(trigrams(t) if d in good else {})
    n, m = sum(raw.values()) + 65536, sum(target.values()) + 65536
    rows = QUERIES["op9_likelihood_rules"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        own = trigrams(docs[r.doc_id])
        score = sum(c * (math.log((target[k] + 1) / m) - math.log((raw[k] + 1) / n)) for k, c in own.items()) / max(1, sum(own.values()))
        assert abs(score - r.score) < 1e-6
    passed = sorted(math.floor(r.score * 1000) for r in rows if r.doc_id in good and not r.base_failed)
    cut = next(c for i, c in enumerate(passed) if sum(p <= c for p in passed) > len(passed) * likelihood.LOST) / 1000
    assert all(r.kept == (not r.base_failed and r.score >= cut) for r in rows)


def test_edges(docs, no_docs, labels):
    rows = likelihood.quality_rules(docs, labels).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(r.doc_id) for r in docs.collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
    assert likelihood.quality_rules(no_docs, labels).count() == 0
    assert likelihood.quality_rules(docs, labels.limit(0)).count() == len(rows)


def test_every_trusted_id_counts(docs, labels, monkeypatch):
    """Beyond the number of ids that travel nothing is left out: both joins mark the same documents."""
    def verdicts():
        return sorted(map(str, likelihood.quality_rules(docs, labels).select("doc_id", "trusted", "score", "kept").collect()))

    whole = verdicts()
    assert sum("trusted=True" in r for r in whole) == 2
    monkeypatch.setattr(likelihood, "TRUSTED", 0)
    assert verdicts() == whole
    many = docs.sparkSession.range(100_001).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert likelihood.trusted_ids(many).count() == 100_001
