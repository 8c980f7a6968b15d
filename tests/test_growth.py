"""Work and memory that must not grow faster than the input."""

import time

import pytest
from pyspark.sql import functions as F

from kledger.functions import text as X
from kledger.operators import lint as L
from kledger.operators import similar as S
from kledger.operators import update as U

ROWS = "seq long, prior_id string, prior_status string, text string, suggested_action string, guard string, source_url string, content_hash string"


def test_arrow_batches_are_bounded_in_bytes(spark):
    @F.pandas_udf("long")
    def batch_bytes(xs):
        return xs.str.len() * 0 + int(xs.str.len().sum())

    most = spark.range(0, 1000, 1, 1).select(batch_bytes(F.repeat(F.lit("x"), 40_000)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 9 << 20


def test_a_lower_batch_limit_stays(spark):
    from kledger.session import bound_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("1m", "1m"), ("64m", before)):
            spark.conf.set(name, given)
            bound_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_entities_of_a_long_text(spark):
    long = ",".join(f"a{i % 5}" for i in range(20_000)) + ",B,b,c"
    df = spark.createDataFrame([(1, long), (2, " x ,X;;y|x/Z、z"), (3, None), (4, "")], "id int, t string")
    began = time.time()
    got = {r.id: r.e for r in df.select("id", X.split_entities(F.col("t")).alias("e")).collect()}
    assert got == {1: ["a0", "a1", "a2", "a3", "a4", "B"], 2: ["x", "y", "Z"], 3: None, 4: []}
    assert time.time() - began < 30


def test_bigram_sizes_are_those_of_the_sets(spark):
    texts = ["ab ab", "a b\nc\td", "", " ", "a", "😀é😀é", "aaa", None, "x y"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = X.bigram_set(F.col("a")), X.bigram_set(F.col("b"))
    rows = df.select("a", "b", X.bigram_sizes(F.col("a"), F.col("b")).alias("n"), F.size(a).alias("na"), F.size(b).alias("nb"), F.size(F.array_intersect(a, b)).alias("both")).collect()
    assert len(rows) == len(texts) ** 2
    for r in rows:
        assert (r.n.a, r.n.b, r.n.both) == (r.na, r.nb, r.both), r


def test_lines_of_a_long_page(spark):
    body = "\n".join(["# h", "```", "code", "~~~"] + [f"line {i} of a page" for i in range(8_000)] + ["```", "end"])
    began = time.time()
    got = L.page_lines(spark.createDataFrame([("p", body)], "page_id string, body string")).collect()
    assert time.time() - began < 30
    assert {(r.line_no, r.line, r.in_fence) for r in got if r.line} == {(i + 1, x, i == 2 or x == "end") for i, x in enumerate(body.split("\n")) if x not in ("```", "~~~")}


@pytest.mark.parametrize("blocks", [(1024, 8192), (2, 2)])
def test_best_notes_against_all_pairs(spark, blocks):
    lines = [("p", 1, "alpha beta"), ("p", 2, "x"), ("p", 3, "zzzz"), ("p", 4, "gamma  ray"), ("p", 5, "beta"), ("q#1", 1, "one two"), ("p", 5, "gamma"), ("r", 1, "alone"), (None, 1, "alpha")]
    notes = [("p", "n2", "alphabet a beta"), ("p", "n1", "beta"), ("p", "n3", "gammaray"), ("p", "n4", None), ("p", "n5", "x"), ("p", "n2", "beta"), ("q#1", "n1", "onetwo"), (None, "n1", "alpha")]

    def grams(t):
        t = "".join((t or "").split())
        return {t[i : i + 2] for i in range(len(t) - 1)} or ({t} if t else set())

    want = {}
    for p, n, t in lines:
        for q, note, u in notes:
            x, y = grams(t), grams(u)
            if p is not None and p == q and x & y:
                want[p, n] = min(want.get((p, n), (0.0, "")), (-len(x & y) / min(len(x), len(y)), note))
    got = L.best_notes(spark.createDataFrame(lines, "page_id string, line_no int, line string"), spark.createDataFrame(notes, "page_id string, note_id string, text string"), *blocks)
    assert sorted((r.page_id, r.line_no, r.note_id, r.score) for r in got.collect()) == sorted((p, n, note, -s) for (p, n), (s, note) in want.items())


def test_keys_and_outcomes_are_read_without_texts(spark):
    rows = [(1, "a", "active", "t", "merge", None, "", ""), (2, "a", "active", "t ", "merge", None, "", ""), (3, "b", "active", None, "merge", None, "", ""), (3, "b", None, "u", "merge", None, "", "")]
    out = U.decide(spark.createDataFrame(rows, ROWS), spark.createDataFrame([("none",)], "key string"))
    plan = out.select("seq", "key", "applied", "skip")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "Scan" in x]
    assert scans and not any("text#" in x for x in scans)
    assert sorted((r.seq, r.text, r.skip) for r in out.collect() if r.text) == [(1, "t", None), (2, "t ", "duplicate"), (3, "u", "missing_prior")]
    assert out.filter("skip = 'bad_index'").count() == 1


def test_visits_are_given_out_in_bounded_frames(spark, monkeypatch):
    rows = [(i, [1 + i % 3, i % 5, i % 7], ["k"]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<int>, keys array<string>")
    whole = sorted(map(tuple, S.linked_groups(df, 0.97, 4, 2, 3).collect()))
    monkeypatch.setattr(S, "HELD_BYTES", 1)
    assert sorted(map(tuple, S.linked_groups(df, 0.97, 4, 2, 3).collect())) == whole
