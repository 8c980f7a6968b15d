import base64
import gzip
import hashlib
from pathlib import Path

from kledger.llm import warc
from kledger.llm.queries import QUERIES
from kledger.session import ship_code


def expected(rows):
    lead = {}
    for p, h in rows:
        lead[h or ""] = max(lead.get(h or "", -1), -1 if p is None else p)
    out = []
    for p, h in rows:
        data = (h or "").encode()
        own = lead[h or ""] == (-1 if p is None else p)
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else lead[h or ""]))
    return sorted(out, key=str)


def test_query(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_warc_archive"](spark, sf).collect()), key=str) == expected(rows)


def test_edges_rolls_and_same_bytes(spark, tmp_path):
    ship_code(spark)
    rows = [(i, f"http://e.x/{i} b", "é" * (i % 7) + "<p>" * (50 * (i % 5))) for i in range(60)] + [(None, None, None), (70, None, ""), (71, "", None), (72, "u\r\nX: y", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, leader int").repartition(5)
    files = []
    for k in ("a", "b"):
        root = str(tmp_path / k)
        manifest = warc.write_warc(pages.repartition(3 + len(files)), root, shard_bytes=2000, roll_bytes=1500)
        assert manifest.count() > 3
        got = warc.read_warc(spark, root)
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected([(r[0], r[2]) for r in rows])
        back = {r.page_id: bytes(r.payload) for r in got.collect() if r.record_type == "response"}
        assert all(back[p] == (h or "").encode() for p, _, h in rows if p in back)
        files.append({p.name: p.read_bytes() for p in Path(root).glob("part-*")})
    assert files[0] == files[1]
    assert all(gzip.decompress(b).startswith(b"WARC/1.1\r\n") for b in files[0].values())


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
