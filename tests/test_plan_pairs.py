"""The maintenance plan looks at every pair of notes, however many come before the ones it wants."""

from kledger.operators import consolidate as CO

NOTE = ("note_id string, body string, entities array<string>, kind string, status string, tombstone boolean, created string, observed_at string, source_changed_at string, reviewed_at string, "
        "valid_from string, valid_until string, volatility string, confidence string, confirmed boolean, sources array<struct<url:string,content_hash:string>>")


def note(i, body, key):
    return (f"N-{i:06d}", body, [key], "knowledge", "active", False, "2024-12-31", None, None, None, None, None, "stable", "high", True, [])


def test_conflicts_and_merges_beyond_the_first_pairs(spark):
    odd = [note(i, " ".join(chr(97 + i) * (k + 2) for k in range(8)), "first") for i in range(11)]  # 55 pairs without any likeness
    same = "the tariff of the northern line was fixed by the council in rate"
    more = "while young zebras jump over quick brown foxes and lazy dogs at night"
    late = [note(100, f"{same} 12 kg", "late"), note(101, f"{same} 13 kg {more}", "late"), note(102, f"{same} {more}", "late")]
    n = spark.createDataFrame(odd + late, NOTE)
    got = {(r.action, r.note_ids) for r in CO.plan(n, "2025-01-01 00:00:00").collect()}
    assert ("conflict", "N-000100,N-000101") in got  # pair 55
    assert {ids for action, ids in got if action == "merge"} == {"N-000100,N-000102"}  # a conflict in the band is no merge


def test_no_pairs(spark):
    assert CO.plan(spark.createDataFrame([note(1, "alone", "x")], NOTE), "2025-01-01 00:00:00").count() == 0
