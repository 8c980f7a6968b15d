import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kledger.llm import chosen_path, components
from kledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent=80):
    """(doc_id, set size, component) with the union over ids."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if a is not None and b is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op4_chosen_path_dedup"](spark, sf)) == brute(rows, 4)


def near_rows(n, seed=3):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(5000))
    base = [word() for _ in range(80)]
    rows, i = [], 0
    for _ in range(n):  # one large group of near copies, some further away
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            t[r.randrange(80)] = word()
        rows.append((i, " ".join(t)))
        i += 1
    for _ in range(20):
        t = [word() for _ in range(60)]
        rows += [(i, " ".join(t)), (i + 1, " ".join([*t[:-1], word()]))]
        i += 2
    return rows


def test_large_groups_are_cut_and_lose_nothing(spark):
    rows = near_rows(60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = result(chosen_path.near_duplicates(df, shingle=3, leaf=7, depth=2))
    assert got == brute(rows, 3)


def test_no_task_holds_a_large_group(spark, monkeypatch):
    """400 sets of one loose group, nearly all of them far from each other: no cell holds more than a few times the leaf, and a chain through them is found."""
    import numpy as np

    from kledger.session import ship_code

    ship_code(spark)
    r = np.random.default_rng(5)
    sets = [np.sort(r.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(380)]
    for _ in range(20):  # each like the last one, not like the one before it
        sets.append(np.sort(np.append(sets[-1][:-5], r.integers(0, 1 << 62, 5).astype(np.uint64))))
    rows = spark.createDataFrame([(1, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "grp bigint, id bigint, data binary")
    cells, compare = [], chosen_path._compare
    monkeypatch.setattr(chosen_path, "_compare", lambda rows, *a: (cells.append(rows.groupBy("grp", "cell").count().agg({"count": "max"}).first()[0] or 0), compare(rows, *a))[1])
    got = {x.id: x.component for x in chosen_path.link_sets(rows, 80, 10).collect()}
    assert got == dict.fromkeys(range(379, 400), 379)
    assert len(cells) > 1 and max(cells) <= 40


def test_edges(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = chosen_path.near_duplicates(docs)
    assert result(out) == brute(rows, 5)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out.collect())
    assert chosen_path.near_duplicates(no_docs).count() == 0


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b + " more")]
    assert result(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows, 5)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(200, 250)], 100)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB c\n\té"), max_size=40), max_size=6))
def test_sets(texts):
    import numpy as np

    data = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, data)])
    key, bounds = chosen_path.shingle_sets(np.frombuffer(b"".join(data), np.uint8), offs, 3)
    want = [shingles(t, 3) for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(set(key[bounds[i] : bounds[i + 1]]) & set(key[bounds[j] : bounds[j + 1]])) == len(a & b)


def test_small_tables_run_in_few_tasks(spark, monkeypatch):
    from kledger.llm import common, components

    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks, write = [], common.written
        monkeypatch.setattr(components, "written", lambda df, name: (tasks.append(df.rdd.getNumPartitions()), write(df, name))[1])
        chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
        assert {(r.id, r.component) for r in components.components(chain).collect()} == {(i, 0) for i in range(61)}
        assert len(tasks) > 2 and max(tasks[1:]) <= 3  # union of two tables at most
        assert common.few_tasks(chain.repartition(40), 40 * common.ROWS_A_TASK).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
