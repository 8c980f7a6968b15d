"""A deterministic, sharded WARC writer and its reader.

Records are sorted by page id; shard boundaries are exact quantiles of the ids. A task streams its shards to
gzip members, one per record, and starts a new file once the compressed size passes the limit. Headers and
digests are made anew, with a fixed date, so the same pages always give the same bytes. A file is written
under a temporary name of its task attempt and moved to its final name when complete; the manifest of all
files is written last, and a reader opens only what a manifest names. Of equal payloads the record with the
largest page id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kledger.llm.common import arrow_uri, written
from kledger.operators.skew import global_position

SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, shard int, part int, records bigint, bytes bigint, first_page bigint, last_page bigint, sha256 string"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex SHA-1, in column functions: five hex digits are four letters."""
    letters = F.split(F.lit(ALPHABET), "")
    out = []
    for i in range(0, 40, 5):
        five = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        out += [F.element_at(letters, F.shiftright(five, s).bitwiseAND(31) + 1) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, digest)`` of every page."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_of_hex(F.sha1("payload")))


def leaders(rows: DataFrame) -> DataFrame:
    """``(page_id, digest, leader)``: the largest page id with the same payload. No payload is moved for it."""
    meta = rows.select("page_id", "digest", "payload_bytes")
    lead = meta.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("leader"))
    return meta.join(lead, ["digest", "payload_bytes"]).select("page_id", "digest", "leader")


def _shard_starts(pages: DataFrame, n_shards: int) -> np.ndarray:
    """The ids at which shards 1, 2, ... begin: exact quantiles of all ids, one number per shard on the driver."""
    ids = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(-(1 << 63))).alias("page_id"))
    n = ids.count()
    step = max(1, -(-n // n_shards))
    at = global_position(ids, ["page_id"]).filter((F.col("pos") > 1) & ((F.col("pos") - 1) % step == 0)).select("page_id").collect()
    return np.unique(np.array(sorted(r[0] for r in at), dtype=np.int64))


def _head(kind: str, fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\nWARC-Type: " + kind + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "replace")


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, leader: int | None) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'none' if page is None else page}"
    own = page == leader
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if own else http
    fields = [("WARC-Record-ID", _name(page)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if not own:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(leader))]
    return _head("response" if own else "revisit", [*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


class _Roll:
    """One output file at a time; ``close`` moves it to its final name and returns its manifest row."""

    def __init__(self, root: str, shard: int, part: int):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(root)
        self.shard, self.part = shard, part
        self.final, self.temp = f"{base}/part-{shard:06d}-{part:04d}.warc.gz", f"{base}/_temporary/{uuid.uuid4().hex}.warc.gz"
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.out, self.sha = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256()
        self.n, self.bytes, self.pages = 0, 0, []

    def add(self, page: int | None, data: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = z.compress(data) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.n, self.bytes = self.n + 1, self.bytes + len(data)
        self.pages = [self.pages[0] if self.pages else page, page]

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temp, self.final)  # a second attempt moves the same bytes to the same name
        return self.final.rsplit("/", 1)[1], self.shard, self.part, self.n, self.bytes, *self.pages, self.sha.hexdigest()


def write_warc(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives under ``root`` and return the manifest (file, shard, records, bytes, ids, sha256).

    Null ids come first and refer to ``none``; a null html is an empty payload; rows that repeat a page are
    each written; an empty table writes a manifest without files. Further columns are not read.
    """
    rows = records(pages)
    weight = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    n_shards = max(1, -(-weight // shard_bytes))
    starts = _shard_starts(pages, n_shards)
    uri = arrow_uri(root)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, ids.to_numpy(np.int64), side="right").astype(np.int32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, done, known, lead = None, [], None, None
        for f in frames:
            for shard, page, digest, url, payload, leader in zip(f["shard"], f["page_id"], f["digest"], f["url"], f["payload"], f["leader"], strict=True):
                page = None if page is None else int(page)
                if payload is None:
                    known, lead = (page, digest), None if leader is None else int(leader)
                    continue
                if known != (page, digest):
                    raise ValueError(f"page {page} came without its leader")
                if roll and (roll.shard != shard or roll.bytes >= roll_bytes):
                    done.append(roll.close())
                    roll = _Roll(uri, int(shard), roll.part + 1 if roll.shard == shard else 0)
                roll = roll or _Roll(uri, int(shard), 0)
                roll.add(page, record_bytes(page, url, bytes(payload), digest, lead))
        if roll:
            done.append(roll.close())
        yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")]).astype({"first_page": "Int64", "last_page": "Int64"})

    # a page's leader travels just before its payload, so payloads are shuffled once
    # pandas turns a null long into a float, so ids cross as text
    tell = leaders(rows).withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    bear = rows.withColumn("leader", F.lit(None).cast("bigint"))
    both = tell.select("page_id", "digest", "url", "payload", "leader").unionByName(bear.select("page_id", "digest", "url", "payload", "leader"))
    shard = shard_of(F.coalesce("page_id", F.lit(-(1 << 63))))
    dealt = both.withColumn("shard", shard).withColumn("bears", F.col("payload").isNotNull()).repartition(int(n_shards), "shard").sortWithinPartitions("shard", "page_id", "digest", "bears", "url")
    manifest = written(dealt.select("shard", F.col("page_id").cast("string").alias("page_id"), "digest", "url", "payload", F.col("leader").cast("string").alias("leader")).mapInPandas(run, MANIFEST), "warc-manifest")
    manifest.write.mode("overwrite").json(f"{root}/_manifest")
    return manifest


def _parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            break
        out.append(z.decompress(rest))
        rest = b""
        if z.eof:
            yield b"".join(out)
            rest, z, out = z.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends inside a record")


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of the files in the manifest.

    Every block digest and, for responses, every payload digest is checked; a wrong one fails the read.
    """
    uri = arrow_uri(root)
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    columns = [c.split()[0] for c in schema.split(", ")]

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "none" else int(text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for f in frames:
            for name in f["file"]:
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        for head, block in _parse(member):
                            http, _, body = block.partition(b"\r\n\r\n")
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if _sha1(block) != head["WARC-Block-Digest"].removeprefix("sha1:") or kind == "response" and _sha1(body) != digest:
                                raise ValueError(f"{name}: digest of {head['WARC-Record-ID']}")
                            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                            refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
                            rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind, refers, body if kind == "response" else None))
                            held += len(body)
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    names = spark.read.schema("file string").json(f"{root}/_manifest").select("file")
    return names.repartition(max(1, min(names.count(), 100_000))).mapInPandas(run, schema)
