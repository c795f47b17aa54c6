"""A deterministic sharded WARC writer, and the reader of what it wrote.

Records are range-sorted by page id; each range's task rolls its files by compressed size, writes each
record as a gzip member of its own with headers and digests made anew, and renames a file when it is
whole. The manifest, written last, names the files with their sizes and digests. Record ids and dates
follow from the rows, so equal input gives equal bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, as_name, file_system, from_name, written

ROLL = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, url) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def _safe(value) -> str:
    """A header's value on one line."""
    return " ".join(str("" if value is None else value).split())


def record(page_id, url, payload: bytes, refers_to=None, refers_url=None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit has no payload of its own but names its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if revisit else b"Content-Length: %d\r\n" % len(payload)) + b"\r\n"
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _safe(url)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-Id", json.dumps(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url)), ("X-Refers-To-Page", json.dumps(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 4, mtime=0)


def records(data: bytes):
    """(headers, block) of each gzip member; ValueError where lengths or digests don't hold."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data)
        if not member.eof:
            raise ValueError("the file ends within a record")
        data = member.unused_data
        yield parsed(raw)


def plan_revisits(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """pages (page_id of any type, url, html) -> page_id, url, sha, html, refers_to, refers_url, kind: a row of kind 1 per page and, for each that is
    a revisit, a row of kind 0 without html but with what it refers to. So the payloads are shuffled once, by the writer's order.

    Of equal payloads of at least `least` bytes the rows with the smallest page_id are responses, whatever their url (a
    revisit names the smallest of these urls); null ids come last. Null html is an empty payload.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    narrow = rows.filter(F.octet_length("html") >= least).select("page_id", "url", "sha")
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("u"), F.col("url").alias("url"))
    first = narrow.groupBy("sha").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    # written, so that the join is one of two scans, in which a payload that very many pages have can be split
    first = scratch.stage(first, "first")
    again = narrow.join(first, "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "url", "sha", F.lit(None).cast("string").alias("html"), "refers_to", "refers_url", F.lit(0).alias("kind"))
    none = [F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"), F.lit(None).cast("string").alias("refers_url")]
    return rows.select("page_id", "url", "sha", "html", *none, F.lit(1).alias("kind")).unionByName(again)


class _Rolling:
    """Files of a part, each at most `roll` bytes but for a record over that."""

    def __init__(self, fs, root: str, part: int, roll: int):
        self.fs, self.root, self.part, self.roll = fs, root, part, roll
        self.count, self.out, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out and self.size + len(member) > self.roll:
            self.close()
        if not self.out:
            self.temp = f"{self.root}/.tmp-{self.part:08d}-{self.count:06d}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out:
            self.out.close()
            name = f"pages-{self.part:08d}-{self.count:06d}.warc.gz"
            self.fs.move(self.temp, f"{self.root}/{name}")
            self.done.append((name, self.size, self.records, self.sha.hexdigest()))
            self.count, self.out = self.count + 1, None


def write_warc(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL) -> list[dict]:
    """Writes a record per row, repeated rows each; the manifest's rows: name, bytes, records, sha256. A payload of any length is one
    record; null urls are empty, line ends in them spaces. No rows, no files."""
    scratch = Scratch(pages.sparkSession)
    planned = plan_revisits(pages, scratch, least)

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        files = _Rolling(fs, root, TaskContext.get().partitionId(), roll)
        told = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if r["kind"] == 0:
                        told = r
                    else:
                        revisit = told is not None and all(told[c] == r[c] for c in ("page_id", "url", "sha"))
                        files.add(record(r["page_id"], r["url"], r["html"].encode(), *((told["refers_to"], told["refers_url"], True) if revisit else ())))
        files.close()
        if files.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files.done, strict=True)], ["name", "bytes", "records", "sha256"])

    spark = pages.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first()]
    kind = pages.schema["page_id"].dataType
    rows = planned.repartitionByRange(n, *order).sortWithinPartitions(*order, "sha", "kind").withColumns({c: as_name(F.col(c), kind) for c in ("page_id", "refers_to")})
    done = rows.mapInArrow(run, "name string, bytes long, records long, sha256 string")
    manifest = sorted((r.asDict() for r in done.collect()), key=lambda r: r["name"])  # a row per file
    written(f"{folder}/manifest.json", json.dumps({"files": manifest}).encode())
    scratch.drop()
    return manifest


def read_warc(spark, manifest: list[dict], folder: str, id_type=T.LongType()) -> DataFrame:
    """A row per record of the manifest's files: page_id, record_type, payload_bytes, payload_digest, refers_to, payload (null in a revisit)."""

    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
                    rows = []
                    for fields, block in _stream(file, size):
                        revisit = fields["WARC-Type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and (digest(payload) != told or len(payload) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is broken")
                        rows.append((json.loads(fields["X-Page-Id"]), fields["WARC-Type"], int(fields["X-Payload-Length"]), told, json.loads(fields.get("X-Refers-To-Page", "null")), payload))
                        if len(rows) >= 200:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    files = spark.createDataFrame([(m["name"], m["bytes"]) for m in manifest], "name string, bytes long").repartition(max(1, len(manifest)))
    out = files.mapInArrow(run, "page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
    return out.withColumns({c: from_name(F.col(c), id_type) for c in ("page_id", "refers_to")})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def _stream(file, size: int, portion: int = 1 << 15):
    """The records of an open file, of which a portion and one record are held at a time."""
    member, raw, left = zlib.decompressobj(31), [], b""
    seen = 0
    while seen < size or left:
        data = left or file.read(portion)
        if not left:
            if not data:
                raise ValueError("the file is shorter than the manifest says")
            seen += len(data)
        raw.append(member.decompress(data))
        left = b""
        if member.eof:
            left = member.unused_data
            yield parsed(b"".join(raw))
            member, raw = zlib.decompressobj(31), []
    if raw and any(raw):
        raise ValueError("the file ends within a record")


def parsed(raw: bytes) -> tuple[dict, bytes]:
    """A decompressed member's headers and block, with its lengths and digests tested."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"record {fields['WARC-Record-ID']} is broken")
    return fields, block


def archive(pages: DataFrame, least: int = 0, roll: int = ROLL) -> DataFrame:
    """pages (page_id, url, html; more columns are left out) written by write_warc and read back by read_warc."""
    scratch = Scratch(pages.sparkSession)
    folder = scratch.path("warc")
    manifest = write_warc(pages, folder, least, roll)
    scratch.drop(folder)
    return read_warc(pages.sparkSession, manifest, folder, pages.schema["page_id"].dataType)
