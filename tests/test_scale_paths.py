"""The skew-safe and beyond-the-bound paths give what the plain formulation gives."""

import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kledger.operators import analytics as A
from kledger.operators import blocks as B
from kledger.operators import chunks as C
from kledger.operators import graph as G
from kledger.operators import pairs as P
from kledger.operators import retrieval as R
from kledger.operators import skew as K
from kledger.plans import fixtures as fx


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_phrase_join_equals_scan(spark, sf):
    n, q = fx.notes(spark, sf, False), fx.phrase_queries(spark, sf)
    assert rows(R.phrase_hits(n, q)) == rows(R.phrase_hits(n, q, force_join=True))


def test_overlapping_phrases_are_counted_alike(spark):
    n = spark.createDataFrame([("a", "hahahaha", "Ha.ha (x) \\E ha")], "note_id string, title string, body string")
    q = spark.createDataFrame([("1", "haha"), ("2", "(x)"), ("3", "\\E ha"), ("4", "a.h")], "qid string, q string")
    scan = rows(R.phrase_hits(n, q))
    assert [r[2] for r in scan] == [3, 1, 1, 1]
    assert scan == rows(R.phrase_hits(n, q, force_join=True))


def test_short_patterns_join_too(spark):
    n = spark.createDataFrame([("a", "", "xyx"), ("b", "", "yy")], "note_id string, title string, body string")
    q = spark.createDataFrame([("1", "x"), ("2", "yx")], "qid string, q string")
    assert rows(R.phrase_hits(n, q, min_chars=1)) == rows(R.phrase_hits(n, q, force_join=True, min_chars=1))


def test_vector_grid_equals_scan(spark, sf, monkeypatch):
    n, q = R.note_vectors(fx.notes(spark, sf, False)), R.vectorize(fx.bench_queries(spark, sf), "qid", F.col("q"))
    plain = rows(R.vector_channel(n, q, 7))
    monkeypatch.setattr(B, "ITEM_BLOCK", 30)
    monkeypatch.setattr(B, "QUERY_BLOCK", 11)
    assert plain == rows(R.vector_channel(n, q, 7, force_grid=True))


def test_vector_grid_keeps_ties_and_copies(spark, monkeypatch):
    """Copies, ties, blank vectors, a repeated query id and a floor: the grid gives what the scan gives, and shuffles no item per query block."""
    rnd = random.Random(8)
    vec = lambda: [rnd.randint(-1, 2) for _ in range(4)]
    vs = [vec() for _ in range(40)] + [[0, 0, 0, 0]]
    items = spark.createDataFrame([(f"i{k:04}", rnd.choice(vs)) for k in range(500)], "item_id string, v array<int>")
    qs = spark.createDataFrame([(f"q{k % 90:03}", rnd.choice(vs)) for k in range(100)], "qid string, v array<int>")
    for n, floor in ((1, -0.5), (7, 1e-6), (300, -2.0)):
        want = rows(B.top_matches(items, qs, B.score_cosine, n, floor).select("qid", "item_id", "score"))
        with monkeypatch.context() as m:
            m.setattr(B, "QUERY_BLOCK", 3)
            m.setattr(B, "ITEM_BLOCK", 20)
            m.setattr(B, "SLICE", 301)
            plan = B.top_matches(items, qs, B.score_cosine, n, floor, force_grid=True)
            assert want == rows(plan.select("qid", "item_id", "score"))
            assert "Generate" not in plan._jdf.queryExecution().toString()


def test_passages_over_windows_and_passes(spark, monkeypatch):
    """Texts longer than a window and phrases of more than one pass: as with one automaton."""
    from kledger.operators import phrases as PH

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abAé語") for _ in range(n))
    texts = [(f"n{i}", word(5) if i % 3 else None, word(rnd.choice([0, 3, 400, 900]))) for i in range(30)]
    n = spark.createDataFrame(texts, "note_id string, title string, body string")
    ask = [t[2][a : a + k] for t in texts for a, k in ((1, 3), (7, 4), (100, 8), (200, 15), (210, 17), (300, 90)) if t[2][a : a + k]]
    q = spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(ask + ["nowhere at all"])], "qid string, q string")
    want = rows(R.phrase_hits(n, q, min_chars=1))
    monkeypatch.setattr(PH, "WINDOW", 128)
    monkeypatch.setattr(PH, "PER_PASS", 40)
    assert len(want) > 100 and rows(R.phrase_hits(n, q, force_join=True, min_chars=1)) == want


def test_chunk_grid_equals_scan(spark, sf, monkeypatch):
    c, q = C.chunks(fx.corpus_docs(spark, sf).limit(40)), fx.bench_queries(spark, sf)
    plain = rows(C.chunk_search(c, q, 3))
    monkeypatch.setattr(B, "ITEM_BLOCK", 50)
    assert plain == rows(C.chunk_search(c, q, 3, force_grid=True))


def test_grouped_matches_split_a_hot_group(spark):
    rnd = random.Random(3)
    vec = lambda: [rnd.randint(-3, 3) for _ in range(8)]
    items = spark.createDataFrame([(f"i{k:03}", "hot" if k % 3 else "cold", vec()) for k in range(60)], "item_id string, group string, v array<int>")
    qs = spark.createDataFrame([(f"q{k}", "hot" if k % 2 else "cold", vec()) for k in range(9)], "qid string, group string, v array<int>")
    whole = rows(B.top_matches_grouped(items, qs, B.score_cosine, 2))
    assert whole == rows(B.top_matches_grouped(items, qs, B.score_cosine, 2, item_block=7, query_block=2))


def test_bucketed_windows_equal_plain_windows(spark):
    rnd = random.Random(5)
    data = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.randint(-5, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "k bigint, s bigint, v bigint")
    w = Window.partitionBy("k").orderBy("s")
    want = df.select("k", "s", F.sum("v").over(w).alias("a"), F.max(F.when(F.col("v") > 0, F.col("v"))).over(w).alias("b"), F.lag("v").over(w).alias("c"))
    got = K.running(df, ["k"], ["s"], sums={"a": F.col("v")}, maxes={"b": F.when(F.col("v") > 0, F.col("v"))}, width=16)
    got = K.previous(got, ["k"], ["s"], {"c": F.col("v")}, width=16).select("k", "s", "a", "b", "c")
    key = lambda r: (r[1],)
    assert sorted(map(tuple, want.collect()), key=key) == sorted(map(tuple, got.collect()), key=key)


def test_global_position_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = rows(K.global_position(df, ["x"], partitions=7).select("pos", "x"))
    assert got == [(i + 1, i) for i in range(1000)]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), ("b", None)], "k string, x double")
    assert rows(A.exact_percentiles(df, ["k"], "x", {"p": 0.95, "m": 0.5})) == [("a", 9.2, 2.0), ("b", 5.0, 5.0)]


def test_pairs_are_counted_and_numbered_without_listing_them(spark):
    rnd = random.Random(11)
    notes = [(f"N-{i:04}", rnd.sample(["a", "b", "c", "d", "e"], rnd.randint(1, 4)) + (["hot"] if i % 3 else [])) for i in range(60)]
    truth = [(x, y) for (x, ex), (y, ey) in itertools.combinations(notes, 2) if set(ex) & set(ey)]
    df = spark.createDataFrame(notes, "note_id string, entities array<string>")
    cum = P.cumulated(P.partner_counts(P.keyed(df)))
    assert P.total_pairs(cum) == len(truth)
    for lo, hi in ((0, 10), (35, 90), (len(truth) - 5, len(truth) + 5)):
        got = sorted((r["pair_no"], r["a_id"], r["b_id"]) for r in P.pair_window(cum, lo, hi).collect())
        assert got == [(i, *truth[i]) for i in range(lo, min(hi, len(truth)))]
    found = P.first_matching(cum, lambda p: p.filter("pair_no % 97 = 5"), 4, window=50)
    assert sorted(r["pair_no"] for r in found.collect()) == [5, 102, 199, 296]


def test_redirect_classes(spark):
    chain = [(f"c{i:02}", "merged", f"c{i + 1:02}", None) for i in range(20)] + [("c20", "active", None, None)]
    odd = [("x", "merged", "y", None), ("y", "superseded", None, "x"), ("t", "merged", "x", None), ("b", "merged", "gone", None), ("n", "merged", None, None)]
    out = {r["note_id"]: (r["canonical_id"], r["outcome"], r["hops"]) for r in G.redirects(spark.createDataFrame(chain + odd, "note_id string, status string, redirect_to string, superseded_by string")).collect()}
    assert out["c00"] == ("c20", "active", 20) and out["c19"] == ("c20", "active", 1)
    assert {out[k][1] for k in "xyt"} == {"cycle"} and {out[k][1] for k in "bn"} == {"broken"}


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(a, b) for a, b in ((rnd.randrange(80), rnd.randrange(80)) for _ in range(60)) if a != b]
    parent = list(range(80))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = rows(G.components(spark.createDataFrame(edges, "a bigint, b bigint"), spark.range(80)))
    assert got == [(i, find(i)) for i in range(80)]


def test_late_rows_stay_in_totals_and_old_keys_stay_known(spark, tmp_path):
    from kledger.streaming import jobs as S

    path = str(tmp_path / "ledger")
    for month in ("2024-09", "2024-01", "2024-09"):  # the second file is late, the third repeats the first
        spark.sql(f"SELECT timestamp '{month}-05 10:00:00' ts, 'm' model, 2L input_tokens, 1L output_tokens, '{month}' idempotency_key UNION ALL SELECT timestamp '{month}-20 10:00:00', 'm', 3L, 1L, NULL").coalesce(1).write.mode("append").parquet(path)
    totals = S.token_totals(spark, S.read_stream(spark, path)).selectExpr("cast(day as date) day", "input_tokens", "calls")
    assert [(str(d), n, c) for d, n, c in rows(totals)] == [("2024-01-05", 2, 1), ("2024-01-20", 3, 1), ("2024-09-05", 4, 2), ("2024-09-20", 6, 2)]
    assert sorted(str(r[0]) for r in S.job_intake(spark, S.read_stream(spark, path)).collect()) == ["2024-01", "2024-09", "None"]


def test_a_delivery_of_several_files_is_one_batch(spark):
    from kledger.plans import stream
    from kledger.streaming import jobs as S

    df = spark.range(1000).selectExpr("1L worker", "id seq", "'failed' status").repartition(5)
    out = S.streaks(spark, *stream.staged(spark, df, "outcomes", "seq"))
    assert [r.streak for r in out.orderBy("seq").collect()] == list(range(1, 1001))


def test_notes_with_many_entities(spark):
    """Notes of up to thirty entities beside small ones: every pair is counted once, numbered and found."""
    rnd = random.Random(6)
    notes = [(f"N-{i:03d}", sorted({f"e{rnd.randrange(40)}" for _ in range(rnd.choice([1, 2, 3, 6, 7, 30]))})) for i in range(60)]
    want = [(a, b) for (a, x), (b, y) in itertools.combinations(notes, 2) if set(x) & set(y)]
    counts = P.partner_counts(P.keyed(spark.createDataFrame(notes, "note_id string, entities array<string>")))
    got = {r.note_id: r.partners for r in counts.collect()}
    assert got == {n: sum(a == n for a, _ in want) for n, _ in notes}
    window = P.pair_window(P.cumulated(counts), 100, 400).orderBy("pair_no").collect()
    assert [(r.a_id, r.b_id) for r in window] == want[100:400]


def test_notes_join_labels_without_shuffling_texts(spark, sf, monkeypatch):
    """Few labels travel to the documents; beyond the bound a shuffle gives the same notes."""
    n = fx.notes(spark, sf, False)
    assert "BroadcastHashJoin" in n._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fx, "MAX_BROADCAST_LABELS", 0)
    assert rows(n.select("note_id", "body", "confidence")) == rows(fx.notes(spark, sf, False).select("note_id", "body", "confidence"))


def test_hybrid_search_equals_channel_by_channel(spark, sf, monkeypatch):
    """Equal texts are searched once; a note id that occurs twice, tombstones and redirects come out as when every channel is resolved and scored by itself."""
    from kledger.functions import temporal as T

    base = fx.notes(spark, sf, False)
    n = base.unionByName(base.filter("d % 5 = 0"))
    chains = G.redirects(base.select("note_id", "status", "redirect_to", "superseded_by"))
    q = fx.bench_queries(spark, sf).unionByName(fx.phrase_queries(spark, sf).filter("qid rlike '^D-1?[0-9]$'"))
    q = q.unionByName(q.selectExpr("concat(qid, '-again') AS qid", "concat(' ', q, ' ') AS q")).unionByName(spark.createDataFrame([("none", " "), ("null", None)], "qid string, q string"))
    parts = {"fts": R.keyword_channel(n, q, 20), "vector": R.vector_channel(R.note_vectors(n), R.vectorize(q, "qid", F.trim("q")), 20)}
    fused = R.rrf({k: R.resolve_ranks(c.select("qid", "note_id", "rank"), chains) for k, c in parts.items()})
    age = T.age_days(T.now_lit(fx.NOW), T.base_time(F.col("observed_at"), F.col("created")))
    score = F.col("fused") * T.confidence_factor(F.col("confidence")) * T.decay(age, T.half_life(F.col("volatility"))) * T.importance_factor(F.col("importance"))
    hits = fused.join(n.withColumnRenamed("note_id", "canonical_id"), "canonical_id").filter("NOT tombstone").withColumn("score", F.round(score, 9))
    top = R.top_rows(hits, ["qid"], [F.desc("score"), "canonical_id"], 5)
    want = rows(top.select("qid", "rank", "canonical_id", "title", "score", "match_type", F.coalesce(F.when(~F.col("direct"), F.col("alias")), F.lit("-"))))
    asked, channel = [], R.keyword_channel
    monkeypatch.setattr(R, "keyword_channel", lambda a, b, *c: asked.append(b.count()) or channel(a, b, *c))
    got = R.hybrid_search(q, n, chains, fx.NOW).withColumn("redirected_from", F.coalesce("redirected_from", F.lit("-")))
    assert rows(got) == want
    assert asked == [q.select(F.trim("q").alias("q")).filter("q <> ''").distinct().count()]


def test_grid_shuffles_the_rows_of_a_query_once(spark):
    """The best rows are ranked before equal queries take them."""
    items = spark.createDataFrame([(f"i{k}", [k, 1, 2]) for k in range(9)], "item_id string, v array<int>")
    qs = spark.createDataFrame([(f"q{k}", [k % 2, 1, 1]) for k in range(6)], "qid string, v array<int>")
    plan = B.top_matches(items, qs, B.score_cosine, 3, force_grid=True)
    assert "windowspecdefinition(_rep" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert rows(plan) == rows(B.top_matches(items, qs, B.score_cosine, 3))


def test_candidates_are_read_once_and_their_texts_stay(spark, sf):
    """Signals and vectors are taken where the texts lie: no text is shuffled to its similarity."""
    from kledger.operators import ingest as I
    from kledger.plans import know

    plan = know.with_signals(spark, sf)
    assert " text#" not in plan._jdf.queryExecution().optimizedPlan().toString()
    c, n = know.candidates(spark, sf), fx.notes(spark, sf, False)
    cols = ["cand_id", "body_chars", "entity_count", "has_source", "has_specifics", "similarity_max", "importance", "confidence", "decision"]
    assert rows(plan.select(*cols)) == rows(I.formation(c.join(I.max_similarity(c, n), "cand_id")).select(*cols))
