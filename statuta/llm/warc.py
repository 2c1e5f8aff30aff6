"""Deterministic sharded WARC archives.

Records are put in order of page_id, dealt to shards of neighbouring ids by cut points that are the same on every run, and
written as one gzip member each; a file is closed when its compressed size passes ``roll_bytes``. Headers, record ids and
digests are made anew from the page alone, so equal tables give equal files. A file is written under a
temporary name and renamed, and the shard's list of files (records, bytes, SHA-1) is committed as a manifest table, so a
task that runs twice leaves one archive. Of equal payloads of ``min_bytes`` or more the page with the smallest id is a
response, the others are revisit records without a payload that name it.

Nulls and odd rows: a null html is an empty payload; a null url becomes urn:page:<id>; null ids stand last; of rows with equal
id and payload that with the smallest url is the response and exact repeats of it are responses too; an empty table gives no
file. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashed, materialize, range_bounds, range_shard, read_committed, shuffle_partitions, text_bytes


@dataclass(frozen=True)
class WarcParams:
    """date: of all records, part of the deterministic output; shard_bytes: payload in a shard."""

    date: str = "2024-01-01T00:00:00Z"
    roll_bytes: int = 32 << 20
    shard_bytes: int = 64 << 20
    min_bytes: int = 0


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A record as one gzip member; without a payload a revisit of page ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if payload is None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


class _Shard:
    def __init__(self, root: str, shard: int, p: WarcParams):
        self.root, self.shard, self.p, self.files, self.out = root, shard, p, [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.out, self.records = Hashed(self.root, f"part-{self.shard:07d}-{len(self.files):05d}.warc.gz"), 0
        self.out.write(data)
        self.records += 1
        if self.out.size >= self.p.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if self.out is not None:
            self.files.append((self.shard, self.out.file, self.records, self.out.size, self.out.commit()))
            self.out = None


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, payload (null for revisits), digest (hex), size, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("nourl"), "url")
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    # a table of its own, so that the join may split the rows of a very common payload
    firsts = materialize(firsts.where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"))
    joined = rows.join(firsts, (rows.digest == firsts.d) & (rows["size"] == firsts.s), "left")
    again = F.col("first").isNotNull() & ~rank.eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "size", F.when(again, F.col("first.page_id")).alias("refers_to"))


def write_warc(pages: DataFrame, root: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``pages`` below ``root``; returns the manifest (shard, file, records, bytes, sha1), a row a file."""
    spark = pages.sparkSession
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(math.ceil(size / params.shard_bytes), shuffle_partitions(spark))
    # null ids are the highest; pages of one id stand by their digests
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(2**63 - 1))
    tie = lambda digest: F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    bounds = range_bounds(pages, key, tie(F.sha1(text_bytes("html"))), shards)
    rows = mark_revisits(pages, params.min_bytes)
    placed = rows.withColumn("shard", range_shard(spark, key, tie(F.col("digest")), bounds))
    placed = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "url")
    placed = placed.select("shard", "page_id", "url", "payload", "digest", "size", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, files = None, []
        for batch in batches:
            columns = [batch.column(i) if i == 3 else batch.column(i).to_pylist() for i in range(7)]
            for shard, page_id, url, payload, digest, size, refers_to in zip(*columns):
                if out is None or out.shard != shard:
                    if out:
                        out.roll()
                        files += out.files
                    out = _Shard(root, shard, params)
                out.add(record(page_id, url, payload.as_py(), base64.b32encode(bytes.fromhex(digest)).decode(), size, refers_to, params.date))
        if out:
            out.roll()
            files += out.files
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files) if files else ([],) * 5, kinds)], names=["shard", "file", "records", "bytes", "sha1"])

    placed.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


MANIFEST = "shard int, file string, records long, bytes long, sha1 string"


def members(data: memoryview) -> Iterator[bytes]:
    """The gzip members of an archive, one after the other."""
    step, at, out, inflate = 1 << 16, 0, [], zlib.decompressobj(31)
    pending = b""
    while at < len(data) or pending:
        if not pending:
            pending = bytes(data[at : at + step])
            at += step
        out.append(inflate.decompress(pending))
        pending = b""
        if inflate.eof:
            pending = inflate.unused_data
            yield b"".join(out)
            out, inflate = [], zlib.decompressobj(31)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and its payload, both digests checked where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["X-Payload-Length"] = http.decode().rpartition("Content-Length: ")[2]
    if f"sha1:{_sha1(block)}" != fields["WARC-Block-Digest"] or fields["WARC-Type"] == "response" and f"sha1:{_sha1(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, payload


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """All records of the files that the manifest below ``root`` names: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None or x == "None" else int(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [c.split()[0] for c in out.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name, sha1 in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for member in members(memoryview(read_committed(root, name, sha1))):
                    f, payload = parse_record(member)
                    rows.append((number(f.get("X-Page")), int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][5:], f["WARC-Type"], number(f.get("X-Refers-To-Page")), f["WARC-Target-URI"], payload if f["WARC-Type"] == "response" else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("file", "sha1").repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(parse, out)
