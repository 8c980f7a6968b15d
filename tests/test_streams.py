"""Named jobs go on where they stopped, take deliveries in any order, and read bounded state."""

import random
import uuid
from collections import Counter
from pathlib import Path

import pytest

from kledger.operators.analytics import failure_streaks
from kledger.plans import stream
from kledger.streaming import jobs as S


@pytest.fixture
def job():
    """A name no earlier run has used: the checkpoint folder may outlive a test session."""
    return f"test-{uuid.uuid4().hex}"


def send(df, path):
    return lambda: df.write.mode("append").parquet(path)


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def slices(spark, rows, schema, order):
    """``rows`` dealt into the slices that ``order`` lists row numbers of."""
    return [spark.createDataFrame([rows[i] for i in part], schema) for part in order]


def outcome_rows():
    rng = random.Random(5)
    return [(rng.randrange(4) if i % 3 else 7, i, rng.choice(["failed", "failed", "done"])) for i in range(120)]


def orders(n, parts):
    whole = list(range(n))
    step = -(-n // parts)
    forward = [whole[i : i + step] for i in range(0, n, step)]
    mixed = whole[:]
    random.Random(9).shuffle(mixed)
    return {"in order": forward, "backwards": forward[::-1], "mixed": [mixed[i : i + step] for i in range(0, n, step)]}


@pytest.mark.parametrize("order", ["in order", "backwards", "mixed"])
def test_streaks_in_any_order(spark, order, job):
    rows, schema = outcome_rows(), "worker bigint, seq bigint, status string"
    want = table(failure_streaks(spark.createDataFrame(rows, schema)), "worker", "seq", "streak", "pause")
    parts = slices(spark, rows, schema, orders(len(rows), 4)[order])
    source, deliver = stream.delivered(spark, parts, "outcomes")
    got = S.streaks(spark, source, deliver, name=job)
    assert table(got, "worker", "seq", "streak", "pause") == want
    late = S.late_rows(spark, job, schema).count()
    assert late == 0 if order == "in order" else late > 0


@pytest.mark.parametrize("order", ["in order", "backwards", "mixed"])
def test_corpus_versions_in_any_order(spark, order):
    rows, schema = [(i, f"b{i % 4}{'@v2' if i % 3 == 0 else ''}") for i in range(40)], "seq bigint, doc_id string"
    first = {}
    want = []
    for i, doc in rows:
        base = doc.removesuffix("@v2")
        want.append((i, doc, "added" if first.setdefault(base, i) == i else "replaced" if doc.endswith("@v2") else "error"))
    source, deliver = stream.delivered(spark, slices(spark, rows, schema, orders(len(rows), 4)[order]), "arrivals")
    assert table(S.corpus_versions(spark, source, deliver), "seq", "doc_id", "action") == sorted(want)


def test_a_stopped_job_goes_on_under_its_name(spark, tmp_path, job):
    """Each call is a new stream query over what has arrived since; together they give the batch result."""
    rows, schema = outcome_rows(), "worker bigint, seq bigint, status string"
    parts = slices(spark, rows, schema, orders(len(rows), 3)["in order"])
    path = str(tmp_path / "outcomes")
    spark.createDataFrame([], schema).write.parquet(path)
    read = lambda: S.read_stream(spark, path, None, schema=parts[0].schema)
    for part in parts:
        send(part, path)()
        got = S.streaks(spark, read(), name=job)
    again = S.streaks(spark, read(), name=job)  # nothing new: nothing counts twice
    want = table(failure_streaks(spark.createDataFrame(rows, schema)), "worker", "seq", "streak")
    assert table(got, "worker", "seq", "streak") == want == table(again, "worker", "seq", "streak")


def test_a_failing_step_is_replayed_once(spark, tmp_path, job):
    """A job that dies between writing its state and committing its batch counts that batch once."""
    path = str(tmp_path / "ledger")
    spark.sql("SELECT timestamp '2024-01-05 10:00:00' ts, 'm' model, 2L input_tokens, 1L output_tokens").write.parquet(path)
    save, fail = S.KeyedState.save, [True]

    def dies(self, *a):
        save(self, *a)
        if fail.pop() if fail else False:
            raise RuntimeError("stopped here")

    S.KeyedState.save = dies
    try:
        with pytest.raises(Exception, match="stopped here"):
            S.token_totals(spark, S.read_stream(spark, path), name=job)
        got = S.token_totals(spark, S.read_stream(spark, path), name=job)
    finally:
        S.KeyedState.save = save
    assert table(got, "input_tokens", "calls") == [(2, 1)]


def test_a_feed_has_a_lasting_cursor(spark, tmp_path, job):
    path, schema = str(tmp_path / "history"), "note_id string, status string, created string, reviewed_at string"
    spark.createDataFrame([], schema).write.parquet(path)
    read = lambda after: S.change_feed(spark, S.read_stream(spark, path, None, schema=spark.read.parquet(path).schema), name=job, after=after)
    spark.createDataFrame([("a", "active", "2024-01-01", None), ("b", "merged", "2024-01-02", None)], schema).write.mode("append").parquet(path)
    first = table(read(-1), "note_id", "batch")
    assert [n for n, _ in first] == ["a", "b"]
    spark.createDataFrame([("c", "active", "2024-01-03", None)], schema).write.mode("append").parquet(path)
    cursor = max(b for _, b in first)
    assert [n for n, _ in table(read(cursor), "note_id", "batch")] == ["c"]
    assert [n for n, _ in table(read(-1), "note_id", "batch")] == ["a", "b", "c"]


def test_intake_knows_old_keys_after_a_restart(spark, tmp_path, job):
    path = str(tmp_path / "jobs")
    seen = Counter()
    for keys in (["a", "b", None], ["b", "c"], ["a", None, "d", "d"]):
        spark.createDataFrame([(k,) for k in keys], "idempotency_key string").coalesce(1).write.mode("append").parquet(path)
        seen.update(keys)
        out = S.job_intake(spark, S.read_stream(spark, path), name=job)
        assert sorted(str(r[0]) for r in out.collect()) == sorted(map(str, seen))


def test_view_ignores_older_images(spark, job):
    schema = "note_id string, fingerprint string, version int"
    parts = [[("a", "x", 2), ("b", "p", 1)], [("a", "w", 1), ("b", "p", 2)], [("b", "q", 3), ("c", "r", 1)]]
    source, deliver = stream.delivered(spark, [spark.createDataFrame(p, schema) for p in parts], "images")
    got = S.search_view(spark, source, deliver, name=job)
    assert table(got, "note_id", "fingerprint", "writes") == [("a", "x", 1), ("b", "q", 2), ("c", "r", 1)]
    assert table(S.late_rows(spark, job, schema), "note_id", "fingerprint") == [("a", "w")]


def test_state_does_not_grow_with_batches(spark, tmp_path, job):
    """Twelve batches over the same keys: what a batch reads stays as large as after the second."""
    path = str(tmp_path / "outcomes")
    sizes = []
    for b in range(12):
        spark.createDataFrame([(w, b * 10 + w, "failed") for w in range(8)], "worker bigint, seq bigint, status string").coalesce(1).write.mode("append").parquet(path)
        S.streaks(spark, S.read_stream(spark, path), name=job)
        folder = Path(S.Job(spark, job).folder.removeprefix("file:"))
        sizes.append((sum(f.stat().st_size for f in (folder / "state/rows").rglob("part-*")), len(list((folder / "state/manifest").iterdir()))))
    assert max(s for s, _ in sizes[2:]) <= 1.5 * sizes[2][0] and max(n for _, n in sizes) <= 3
    out = S.streaks(spark, S.read_stream(spark, path), name=job)
    assert {r.streak for r in out.filter("seq >= 110").collect()} == {12}
