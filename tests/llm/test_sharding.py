import zlib
from collections import Counter

from kledger.llm import sharding
from kledger.llm.queries import QUERIES


def test_query_places_every_row_once(spark, sf):
    rows = QUERIES["op1_shard_two_pass"](spark, sf).collect()
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        data = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_edges_and_seed(docs, no_docs):
    a = sharding.shuffle_into_shards(docs, 3, bucket_rows=4)
    rows = a.collect()
    assert sorted(str(r.record.asDict()) for r in rows) == sorted(str(r.asDict()) for r in docs.collect())
    assert sorted(r.position for r in rows) == list(range(docs.count()))
    assert sharding.shuffle_into_shards(no_docs, 3).count() == 0


def test_permutation_equals_a_plain_fisher_yates(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.lit(7).cast("bigint").alias("b")).select(sharding.fisher_yates(F.lit(40), F.col("b"), 3).alias("p")).first().p
    draws = {r.i: r.j for r in spark.range(1, 40).selectExpr("cast(id as int) i", "cast(pmod(xxhash64(3, 7L, cast(id as int)), cast(id as int) + 1) as int) j").collect()}
    want = list(range(40))
    for i in range(39, 0, -1):
        want[i], want[draws[i]] = want[draws[i]], want[i]
    assert got == want


def test_repeated_rows_spread(spark):
    same = spark.range(4000).selectExpr("1L doc_id", "'same' text")
    out = sharding.shuffle_into_shards(same, 4, bucket_rows=64)
    assert Counter(r.shard for r in out.select("shard").collect()) == {s: 1000 for s in range(4)}


def test_written_shards(docs, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(docs, 3), str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


def test_query_writes_whole_documents(spark, sf, monkeypatch):
    paths = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda sharded, path: (paths.append(path), write(sharded, path)))
    rows = QUERIES["op1_shard_two_pass"](spark, sf).collect()
    assert len(paths) == 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = spark.read.parquet(paths[0])
    assert back.select("record.*").exceptAll(docs).count() == 0 and docs.exceptAll(back.select("record.*")).count() == 0
    assert sorted((r.shard, r.slot, r.doc_id) for r in rows) == sorted((r.shard, r.slot, r.doc_id) for r in back.select("shard", "slot", "record.doc_id").collect())


def test_empty_table_is_written_and_read(no_docs, tmp_path):
    dealt = sharding.shuffle_into_shards(no_docs, 3)
    sharding.write_shards(dealt, str(tmp_path / "none"))
    assert sharding.read_shards(dealt, str(tmp_path / "none")).count() == 0
