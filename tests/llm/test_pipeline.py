import corpus_pipeline as P
from kledger.llm import chosen_path, likelihood, mixing, packing, repeats
from kledger.llm.common import written
from kledger.llm.queries import table, tokenizer_path


def test_stages_on_whole_tables(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mixing", "packing"]
    a = written(P.quality(spark, docs, sf), "t")
    kept = {r.doc_id for r in likelihood.quality_rules(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in a.collect()} == kept and a.columns == docs.columns
    b = written(P.near_duplicates(spark, a, sf), "t")
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in chosen_path.near_duplicates(a).filter("kept").collect()}
    c = written(P.repeated_passages(spark, b, sf), "t")
    cut = {r.doc_id: r for r in repeats.remove_repeats(b).collect()}
    before = {r.doc_id: r.text for r in b.collect()}
    rows = c.collect()
    assert len(rows) == len(before) and any(r.n_removed for r in cut.values())
    for r in rows:
        lost = len(before[r.doc_id].encode()) - len(r.text.encode())
        assert 0 <= cut[r.doc_id].n_removed - lost <= 6 * cut[r.doc_id].n_spans and r.n_chars == len(r.text)
    d = written(P.mixed(spark, c, sf), "t")
    rated = {r.record.doc_id: r for r in mixing.mix(c, labels).collect()}
    assert {r.doc_id for r in d.collect()} == {i for i, r in rated.items() if r.domain == "plain" or r.copies}
    assert d.columns == docs.columns
    got = P.packed(spark, d, sf).collect()
    assert sorted(map(tuple, packing.pack(d, tokenizer_path()).select("doc_id", "piece", "length").collect())) == sorted((r.doc_id, r.piece, r.length) for r in got)
    assert len({(r.doc_id, r.piece) for r in P.run(spark, sf).collect()}) == len(got)


def test_edges(spark, docs, no_docs, sf, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for table_ in (stored, no_docs):
        d = table_
        for _, stage in P.STAGES[:-1]:
            d = written(stage(spark, d, sf), "t")
            assert d.columns == docs.columns
        P.packed(spark, d, sf).count()
    for _, stage in P.STAGES[:-1]:
        assert {c for c in stage(spark, stored, sf).columns} == set(docs.columns)
