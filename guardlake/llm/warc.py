"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; a bundle ends with the public seek
table (a skippable frame that lists the compressed and decompressed size of every frame). The index
maps a record to (bundle, frame, offset within the decompressed frame, length), so one record costs one
seek and one frame.

Equal payloads are found by their SHA-1 before anything is written: of each group the record with the
smallest id is a `response`, the others `revisit` it without a body.

A bundle's name has the attempt of the task that wrote it, and the index, which Spark commits once for each task, names
the bundles that count: a repeated or speculative attempt never touches another's bundle, whatever order its rows come
in. What no index names is swept away afterwards. Archives are read by frames, so one bundle serves many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import map_arrow, new_folder, rekeyed, shuffle_partitions, stored

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 0
LEVEL = 3
#: Frames that a task reads, unless there are fewer tasks than shuffle partitions.
TASK_FRAMES = 64
# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX_SCHEMA = "page_id long, record_id string, bundle string, frame long, frame_at long, offset long, length long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BundleWriter:
    """Writes records into frames of one bundle; `places` has (frame, frame_at, offset, length) of each."""

    def __init__(self, sink) -> None:
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=LEVEL)
        self.sizes: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int, int]:
        if self.held and self.held + len(record) > FRAME_BYTES:
            self.flush()
        place = (len(self.sizes), self.written, self.held, len(record))
        self.parts.append(record)
        self.held += len(record)
        return place

    def flush(self) -> None:
        if self.parts:
            packed = self.packer.compress(b"".join(self.parts))
            self.sink.write(packed)
            self.sizes.append((len(packed), self.held))
            self.written += len(packed)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.sink.close()


def seek_table(source) -> list[tuple[int, int]]:
    """(place, compressed size) of each frame, from the footer of an open bundle."""
    source.seek(0, 2)
    size = source.tell()
    source.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    source.seek(size - 9 - frames * each)
    table, out, at = source.read(frames * each), [], 0
    for i in range(frames):
        n = struct.unpack_from("<I", table, i * each)[0]
        out.append((at, n))
        at += n
    return out


def read_frame(source, place: int, size: int) -> bytes:
    source.seek(place)
    return zstandard.ZstdDecompressor().decompress(source.read(size))


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(bundle: str, number: int) -> str:
    """The id of a bundle's record: its own, also where ids of pages are null or repeat."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{bundle}:{number}')}>"


def warc_record(record: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no body; its digest and page name the response that has it."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
        payload = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of every record in a decompressed frame."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no record at {at}")
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at + 10 : end].decode().split("\r\n"))
        n = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


@lru_cache(8)
def _filesystem(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _writer(folder: str, run: str):
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()), ("frame_at", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        task, number, records, out, name = TaskContext.get(), 0, 0, None, ""
        for b in batches:
            rows = []
            for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name = f"bundle-{run}-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    fs.create_dir(root, recursive=True)
                    out, records = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None)), 0
                payload, record = html or b"", record_id(name, records)
                place = out.add(warc_record(record, page, url, payload, base32_digest(payload), refers))
                rows.append((page, record, f"{folder}/{name}", *place))
                records += 1
                if out.written > BUNDLE_BYTES:
                    out.close()
                    out, number = None, number + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if out is not None:
            out.close()

    return write


def sweep(folder: str, index: DataFrame) -> None:
    """Delete bundles in the folder that the index does not name (attempts that did not count). The names that do come
    to the driver: one for each GB of records and task."""
    fs, root = _filesystem(folder)
    counted = {r["bundle"].rpartition("/")[2] for r in index.select("bundle").distinct().collect()}
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith("bundle-") and f.base_name not in counted:
            fs.delete_file(f.path)


def with_first_copy(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The pages with `refers_to`: the smallest page_id of the same payload, null for that page itself.

    Digests are counted before they are joined, and only repeated ones are: pages with a payload of
    their own never wait for a join partner. Both join sides have an exchange of their own, so adaptive
    execution splits a payload that many pages share.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"), F.sha1(payload).alias("sha"))
    big = F.octet_length("html") >= min_bytes
    first = keyed.where(big).groupBy("sha").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select(F.concat("sha", F.lit("")).alias("sha_of"), "first_page")
    joined = keyed.join(first, (F.col("sha") == F.col("sha_of")) & big, "left")
    return joined.select("page_id", "url", "html", F.when(F.col("first_page") != F.col("page_id"), F.col("first_page")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for each page below `folder` (a URI all executors share); gives the record index.

    Takes page_id, url, html. Null html is an empty payload; null url leaves out the target. Extra columns
    are ignored; rows with equal page_id are each written (equal payloads too: both are responses), and a null page_id
    is always a response. An empty table writes nothing. The index is stored beside the bundles, so they are written
    once however often it is read.
    """
    written = map_arrow(with_first_copy(pages, min_bytes), _writer(folder, uuid.uuid4().hex[:8]), INDEX_SCHEMA)
    written.write.parquet(f"{folder}/index")
    index = pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    sweep(folder, index)
    return index


RECORD_SCHEMA = "page_id long, bundle string, frame long, offset long, record_type string, refers_to long, header_digest string, payload binary"


@lru_cache(64)
def _frames(bundle: str) -> tuple[tuple[int, int], ...]:
    folder, _, name = bundle.rpartition("/")
    fs, root = _filesystem(folder)
    with fs.open_input_file(f"{root}/{name}") as source:
        return tuple(seek_table(source))


def _frame(bundle: str, number: int) -> bytes:
    """One decompressed frame of a bundle."""
    folder, _, name = bundle.rpartition("/")
    fs, root = _filesystem(folder)
    with fs.open_input_file(f"{root}/{name}") as source:
        return read_frame(source, *_frames(bundle)[number])


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header_digest", pa.string()), ("payload", pa.binary())])
    for b in batches:
        for bundle, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = [
                (int(h["X-Page-ID"]) if "X-Page-ID" in h else None, bundle, k, at, h["WARC-Type"], int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None, h["WARC-Payload-Digest"].removeprefix("sha1:"), body)
                for at, h, body in parse_records(_frame(bundle, k))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the frames that the index names, through the seek tables; frames are dealt over tasks."""
    spark = index.sparkSession
    frames = stored(index.select("bundle", "frame").distinct(), "frames")
    tasks = max(shuffle_partitions(spark), -(-frames.count() // TASK_FRAMES))
    return map_arrow(frames.repartition(tasks), _read_rows, RECORD_SCHEMA)


def _fetch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page, bundle, frame, offset, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            rows.append((page, _frame(bundle, frame)[offset : offset + length]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["page_id", "record"])


def fetch_records(wanted: DataFrame) -> DataFrame:
    """The raw records at given index rows, each by one seek."""
    return map_arrow(wanted.select("page_id", "bundle", "frame", "offset", "length"), _fetch_rows, "page_id long, record binary")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, headers, bodies = (b.column(c).to_pylist() for c in ("record_type", "header_digest", "payload"))
        own = [k == "response" for k in kinds]
        sizes = [len(x) if o else None for x, o in zip(bodies, own, strict=True)]
        digests = [base32_digest(x) if o else h for x, h, o in zip(bodies, headers, own, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), b.column("record_type"), b.column("refers_to")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that were read.

    A response's size and digest are computed from its payload. A revisit's digest is that of its header; its size is that
    of the response with that page and that digest, so pages whose id occurs with several payloads are kept apart.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    wanted = records.select("page_id", "record_type", "refers_to", "header_digest", "payload")
    read = stored(map_arrow(wanted, _digest_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "warc-read")
    whole, again = read.where("record_type = 'response'"), read.where("record_type = 'revisit'")
    used = again.select(F.col("refers_to").alias("used"), F.col("payload_digest").alias("digest")).distinct()
    bodies = whole.join(used, (F.col("page_id") == F.col("used")) & (F.col("payload_digest") == F.col("digest")), "left_semi")
    bodies = bodies.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("size"))
    bodies = bodies.select(rekeyed("of").alias("of"), F.concat("digest", F.lit("")).alias("digest"), "size")
    found = again.join(bodies, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left")
    return whole.select(names).unionByName(found.withColumn("payload_bytes", F.col("size")).select(names))


def page_digests(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages, read the archives back, and give each page's digest row."""
    return resolved(read_bundles(write_bundles(pages, folder or new_folder(pages.sparkSession, "warc"))))


def oracle_sql() -> str:
    """DuckDB: the digest rows straight from the pages. Base32 is spelled out from the digest's bits."""
    bits = "list_aggregate(list_transform(string_split(h, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1)::int + 1, 4)), 'string_agg', '')"
    five = "list_sum(list_transform(range(5), lambda j: substr(b, (5 * i + j + 1)::int, 1)::int * (16 // (1 << j))))"
    return f"""
    with p as (select page_id, encode(coalesce(html, '')) as body from pages),
    h as (select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as h, min(page_id) over (partition by sha1(body)) as first_page from p),
    b as (select *, {bits} as b from h)
    select page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({five})::int + 1, 1)), 'string_agg', '') as payload_digest,
           case when page_id = first_page then 'response' else 'revisit' end as record_type, case when page_id <> first_page then first_page end as refers_to
    from b"""
