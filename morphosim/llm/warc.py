"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent zstd frames, each holding a run of whole WARC
records, followed by the seek table of the zstd seekable format (a skippable
frame with each frame's sizes). An index maps a record's id to its bundle, frame
and offset inside the uncompressed frame, so one record is read by fetching and
decompressing one frame.

Tasks write bundles straight to the shared folder under names that no other
attempt uses; the index, committed by Spark, names the bundles of the attempts
that won. Files of lost attempts are named nowhere and are never read.

Record ids are unique: a row that repeats page_id and payload has its row number in its
id, but for one, which is the one that revisits refer to.

Defined cases: null payload is empty; null url leaves out the target URI; a null
page_id is kept as null and never chosen as the response of others; rows that
repeat page_id and payload are all responses if theirs is the largest page_id;
a very long payload is a frame of its own; an empty table gives no bundles and no rows;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, new_path, small_batches, table

#: Fixed values of the zstd seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "record_id string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def open_fs(uri: str):
    """A file system for the scheme of ``uri``, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(kind: str, page_id, digest: str, copy=None) -> str:
    """``copy`` is the row number of a row that repeats another's page_id and payload."""
    seed = f"{kind} {page_id} {digest}" + (f" {copy}" if copy is not None else "")
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, seed)}>"


def encode_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str, copy=None) -> tuple[str, bytes]:
    """A WARC/1.1 record; a revisit carries the HTTP header alone and the length of the payload it stands for."""
    rid = record_id(kind, page_id, digest, copy)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id('response', refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        block += payload
    return rid, ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the place after it. A response's payload is digested anew and must match its header."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[end + 4 : (stop := end + 4 + int(head["Content-Length"]))]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has no end")
    kind = head["WARC-Type"]
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = None if kind == "revisit" else block[block.index(b"\r\n\r\n") + 4 :]
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't match its digest")
    number = lambda k: int(head[k]) if k in head else None
    size = len(payload) if payload is not None else number("X-Payload-Length")
    return {
        "record_id": head["WARC-Record-ID"], "page_id": number("X-Page-Id"), "record_type": kind, "refers_to": number("X-Refers-To-Page"),
        "url": head.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }, stop + 4


class BundleWriter:
    """Collects records into frames, frames into one bundle file, and ends it with the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int = 3):
        import zstandard

        system, path = open_fs(uri)
        self.uri, self.frame_bytes = uri, frame_bytes
        self.out, self.zstd = system.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames, self.place, self.held, self.size, self.entries, self.pending = [], 0, [], 0, [], []

    def add(self, rid: str, page_id, kind: str, data: bytes) -> None:
        if self.held and self.size + len(data) > self.frame_bytes:
            self.flush()
        self.pending.append((rid, page_id, kind, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if not self.held:
            return
        packed = self.zstd.compress(b"".join(self.held))
        self.entries += [(rid, page, kind, self.uri, len(self.frames), self.place, len(packed), at, n) for rid, page, kind, at, n in self.pending]
        self.frames.append((len(packed), self.size))
        self.out.write(packed)
        self.place += len(packed)
        self.held, self.pending, self.size = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.entries


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the end of an open bundle."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    each = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * each)
    raw, out, at = file.read(n * each), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, i * each)
        out.append((at, packed, plain))
        at += packed
    return out


def read_bundle(uri: str) -> Iterator[dict]:
    """Every record of a bundle, frame by frame."""
    import zstandard

    system, path = open_fs(uri)
    plain = zstandard.ZstdDecompressor()
    with system.open_input_file(path) as file:
        for at, packed, size in seek_table(file, file.size()):
            file.seek(at)
            data, place = plain.decompress(file.read(packed), max_output_size=size), 0
            while place < len(data):
                record, place = decode_record(data, place)
                yield record


def read_record(bundle: str, frame_start: int, frame_bytes: int, offset: int) -> dict:
    """One record by its index entry: a single frame is fetched and decompressed."""
    import zstandard

    system, path = open_fs(bundle)
    with system.open_input_file(path) as file:
        file.seek(frame_start)
        return decode_record(zstandard.ZstdDecompressor().decompress(file.read(frame_bytes)), offset)[0]


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Give each page its digest, record type, what it refers to, and a number if it repeats another row.

    Digests and ids that repeat are counted before anything is joined, and what becomes of them is
    known of each digest and id before payloads are: these travel once, in a join whose other
    side is unique, so that hot ones can be split.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.sha1("payload"))
    # not written in between: row numbers hold for one and the same dealing of the files into tasks
    alike = pages.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("one"), F.min(F.octet_length("payload")).alias("bytes"))
    first = alike.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    marked = alike.join(first, "digest", "left").where(F.col("first").isNotNull() | (F.col("n") > 1)).select(F.col("digest").alias("d"), F.col("page_id").alias("p"), "first", F.when(F.col("n") > 1, F.col("one")).alias("one"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    planned = pages.join(marked, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    return planned.select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"),
        F.when(F.col("row") != F.col("one"), F.col("row")).alias("copy"),
    )


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write planned records as bundles in ``folder``; the result is the index, already committed."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches):
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        start = lambda: BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
        bundle = None
        index = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            columns = [batch.column(c) for c in range(7)]
            for i in range(batch.num_rows):
                page, url, payload, digest, kind, refers, copy = (c[i].as_py() for c in columns)
                bundle = bundle or start()
                rid, data = encode_record(page, url, payload, digest, kind, refers, date, copy)
                bundle.add(rid, page, kind, data)
                if bundle.place >= bundle_bytes:
                    yield index(bundle.close())
                    bundle = None
        if bundle:
            yield index(bundle.close())

    small_batches(records.sparkSession)
    return cut(records.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, payloads: bool = False, task_bytes: int = 128 << 20) -> DataFrame:
    """All records of the bundles that ``index`` names; they are dealt out over tasks, and a task reads its bundles frame by frame."""
    columns = [x.split() for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in columns if payloads or n != "payload"])

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held: list[dict] = []
                size = 0
                for record in read_bundle(uri):
                    held.append(record)
                    size += 200 + len(record["payload"] or b"") * payloads
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    bundles = cut(index.groupBy("bundle").agg(F.max(F.col("frame_start") + F.col("frame_bytes")).alias("bytes")), "warc-bundles")
    n, size = bundles.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(8 * index.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))))
    return bundles.select("bundle").repartition(tasks).mapInArrow(read, ", ".join(f"{n} {k}" for n, k in columns if payloads or n != "payload"))


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``ids``, each by one frame read at its offset."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            found = [read_record(*(x.as_py() for x in row)) for row in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in found], schema)

    return index.join(ids.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame_start", "frame_bytes", "offset").mapInArrow(read, "record_id string, page_id long, record_type string, payload binary")


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 1000) -> DataFrame:
    """Write ``pages`` to bundles; the index."""
    return write_bundles(plan_records(pages, least), folder or new_path(spark, "warc"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(spark, table(spark, sf_dir, "pages"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
d AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN d USING (digest)
"""
