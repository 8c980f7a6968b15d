"""Expected values of single operators, and the sources and sinks on disk."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kledger.functions import temporal as T
from kledger.functions import text as X
from kledger.functions import vectors as V
from kledger.operators import evidence as EV
from kledger.operators import freshness as FR
from kledger.operators import modelout as M
from kledger.plans import fixtures as fx
from kledger.sources import jsonl as J
from kledger.sources import markdown as MD
from kledger.sources import pages as PG

BLANK = dict(valid_from=None, valid_until=None, source_changed_at=None, reviewed_at=None, observed_at=None, kind="knowledge")
SCHEMA = "note_id string, volatility string, created string, observed_at string, valid_from string, valid_until string, source_changed_at string, reviewed_at string, kind string"


def state(spark, **kw):
    row = {"note_id": "N-1", "volatility": "volatile", "created": "2025-01-01", **BLANK, **kw}
    return FR.with_freshness(spark.createDataFrame([row], SCHEMA), "2025-03-02").first()


@pytest.mark.parametrize(
    ("kw", "want"),
    [
        ({"created": "2025-02-20"}, "fresh"), ({"created": "2025-01-31"}, "review_due"), ({"created": "2025-01-01"}, "stale"), ({"volatility": "stable", "created": "2001-01-01"}, "fresh"),
        ({"created": "2025"}, "review_due"), ({"created": "2025-02-20", "valid_until": "2025-03-01"}, "stale"), ({"created": "2025-02-20", "valid_from": "2026-01-01"}, "review_due"),
        ({"created": "2025-02-20", "source_changed_at": "2025-02-25"}, "review_due"), ({"created": "2025-02-20", "source_changed_at": "2025-02-25", "reviewed_at": "2025-02-26"}, "fresh"),
        ({"created": "2025-02-20", "valid_until": "soon"}, "fresh"),
    ],
)
def test_freshness_rules(spark, kw, want):
    assert state(spark, **kw)["state"] == want


def test_per_kind_bounds_are_clamped():
    cfg = T.FreshnessSettings(per_kind={"user": {"review_ratio": 0.4, "stale_ratio": 0.9}})
    assert cfg.bounds(0.4, 0.9) == (0.4, 0.4)


def tokens(spark, text):
    df = EV.fact_tokens(spark.createDataFrame([("o", text)], "owner_id string, text string"))
    return [(r["kind"], r["value"], r["slot"]) for r in df.orderBy("pos").collect()]


def test_fact_tokens(spark):
    got = tokens(spark, "GLM-5.3 窗口是 128k 于 2026-09-01 达 93.7% 见第3章")
    assert [g[0] for g in got] == ["version", "number", "date", "version", "chapter"] or [g[0] for g in got][:3] == ["version", "number", "date"]
    assert got[0] == ("version", "5.3", "version:GLM") and got[1] == ("number", "128", "number:k:窗口是")
    assert tokens(spark, "3 items 5 more") == [("number", "3", "number:item:"), ("number", "5", "number:more:items")]
    assert tokens(spark, "共 3 个 共 5 个")[1][2] == "number:个:共"
    assert tokens(spark, "2024年3月5日")[0][1] == "2024-03-05"
    assert tokens(spark, "no digits at all " * 50) == []


def test_long_text_without_tokens_is_linear(spark):
    assert tokens(spark, "x" * 200_000) == []


def pair(**kw):
    base = dict(
        pair_id="p", prior_id="a", evidence_id="e", prior_text="The context window of the model is 128k tokens in total.", evidence_text="The context window of the model is 128k tokens in total.",
        prior_entities=["m"], evidence_entities=["m"], sources=[("u", "h1")], source_url="", content_hash="", source_changed_at=None, observed_at=None, created="2024-01-01", evidence_observed_at=None,
    )
    return {**base, **kw}


PAIR = "pair_id string, prior_id string, evidence_id string, prior_text string, evidence_text string, prior_entities array<string>, evidence_entities array<string>, sources array<struct<url:string,content_hash:string>>, source_url string, content_hash string, source_changed_at string, observed_at string, created string, evidence_observed_at string"


@pytest.mark.parametrize(
    ("kw", "want"),
    [
        ({}, "consistent"), ({"evidence_text": "zzz qqq"}, "uncertain"), ({"evidence_entities": ["other"]}, "uncertain"), ({"evidence_text": "The context window of the model is 256k tokens in total."}, "conflicting"),
        ({"source_url": "u", "content_hash": "h2", "source_changed_at": "2024-02-01"}, "newer"),
        ({"evidence_text": "The context window of the model is 128k tokens in total, for 70 experts.", "evidence_observed_at": "2024-06-01"}, "newer"),
        ({"evidence_text": "The context window of the model is 128k tokens in total, for 70 experts."}, "more_specific"),
    ],
)
def test_verdict_ladder(spark, kw, want):
    r = EV.compare(spark.createDataFrame([pair(**kw)], PAIR)).first()
    assert r["verdict"] == want and r["suggested_action"] == EV.ACTIONS[want]


def test_encoder_matches_its_definition(spark):
    text = "ab中ba"
    for name in ("md5", "blake2b"):
        want = np.zeros(128, dtype=int)
        for g in list(text) + [text[i : i + 2] for i in range(len(text) - 1)]:
            if name == "md5":
                v = int(hashlib.md5(g.encode()).hexdigest()[:15], 16)
                want[v % 128] += 1 - 2 * ((v // 128) % 2)
            else:
                v = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
                want[v % 128] += 1 - 2 * (v >> 63)
        got = spark.createDataFrame([(text,)], "t string").select(V.encoder(hash_name=name)("t").alias("v")).first()["v"]
        assert list(got) == want.tolist()


def test_normalisation(spark):
    df = spark.createDataFrame([("ＡＢ, v1.2.3 is 93.7%. End.",)], "t string")
    assert df.select(X.normalize_answer(F.col("t"))).first()[0] == "abv1.2.3is93.7%end"


def test_first_json(spark):
    cases = [('{"a": 1}', '{"a": 1}'), ('x {bad} {"a": "}"} y', '{"a": "}"}'), ("none", None), ('```json\n{"a": 2}\n```', '{"a": 2}')]
    got = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(M.first_json(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in cases]


def test_markdown_files(spark, sf, tmp_path):
    n = fx.notes(spark, sf).limit(5)
    for i, r in enumerate(MD.render_records(n).collect()):
        (tmp_path / f"{i}.md").write_text(r["text"], encoding="utf-8")
    (tmp_path / "plain.md").write_text("no block here", encoding="utf-8")
    (tmp_path / "list.md").write_text("---\ntitle: T\nconfidence: sure\nimportance: 7\nodd: 1\nentities:\n  - a\n  - b\nsources:\n  - url: u\n    content_hash: h\n---\nBody\n", encoding="utf-8")
    (tmp_path / "bad.md").write_text("---\njust words\n---\nBody\n", encoding="utf-8")
    got = {r["path"].rsplit("/", 1)[1]: r for r in MD.parse_records(MD.scan_files(spark, str(tmp_path))).collect()}
    assert len(got) == 8 and got["plain.md"]["body"] == "no block here" and got["bad.md"]["corrupt"] is not None
    odd = got["list.md"]
    assert (odd["confidence"], odd["importance"], odd["entities"], odd["sources"][0]["url"]) == ("medium", None, ["a", "b"], "u") and "odd" in odd["extra"]
    assert sorted(r["note_id"] for k, r in got.items() if k[0].isdigit()) == sorted(r["note_id"] for r in n.collect())


def test_line_numbers_and_strict_scan(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n\n{"k"\n', encoding="utf-8")
    lines = J.numbered_lines(spark, str(tmp_path))
    assert sorted((r["line_no"], r["reason"]) for r in J.violations(lines, ["k"]).collect()) == [(3, "blank"), (4, "not json")]
    assert J.strict_rows(lines.filter("line_no < 3"), "k bigint", ["k"]).count() == 2
    with pytest.raises(Exception, match="a.jsonl"):
        J.strict_rows(lines, "k bigint", ["k"]).collect()


def test_snapshot_sink_is_idempotent(spark, sf, tmp_path):
    s = PG.snapshots(fx.table(spark, sf, "pages")).drop("page_id")
    for _ in range(2):
        PG.append_snapshots(s, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == s.dropDuplicates(["url", "content_hash"]).count()


def test_ledger_sink(spark, sf, tmp_path):
    rows = fx.token_ledger(spark, sf).limit(10)
    for _ in range(2):
        J.append_ledger(rows, str(tmp_path / "ledger"))
    assert J.scan_tolerant(spark, str(tmp_path / "ledger"), J.LEDGER, ["trace_id"]).count() == 20
