"""WARC archives with an index: written one gzip member a record, read back by coalesced byte ranges.

Each task writes files of its own (a name that no other attempt has) into a folder of the shared store,
and returns an index row for each record: file, offset, length, URL, payload digest and type. The index is
written as a table before anything reads it, so files of failed attempts are never looked at. Reading
starts from any selection of index rows, sorted by file and offset: ranges that lie close are fetched
in one request, and each record is parsed out of the bytes.

Of records with equal payloads of at least MIN_REVISIT bytes, that of the least page_id is a response and
the others are revisits, which name it and carry no payload; smaller payloads are always responses. Which digests occur twice is
found on a table of digests and ids alone; where those are few enough to be broadcast (BROADCAST_DIGESTS), no payload is shuffled.

Nulls: a null html is an empty payload, a null URL leaves out the target, a null page_id its header (and
never is the least while another id is there). Rows that repeat the least page_id with its payload are
responses as well. The empty table writes no file and gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise, qualified, scratch_path
from ._text import lean

MIN_REVISIT = 100
#: A file is closed once it has so many bytes.
FILE_BYTES = 128 << 20
#: Ranges of one file that lie at most GAP bytes apart are one request of at most REQUEST bytes.
GAP, REQUEST = 64 << 10, 8 << 20
#: Bytes of one file that one reading task takes.
TASK_BYTES = 8 << 20
#: So many repeated digests (about 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page {page_id}'.encode()).digest()[:16])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines))
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])), "payload": payload}


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row and return the index (materialised). A folder without a scheme lies on Spark's own file system."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    light = rows.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "digest")
    shared = materialise(light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "digests")
    few = shared.count() <= BROADCAST_DIGESTS
    typed = rows.join(F.broadcast(shared) if few else shared.hint("merge"), "digest", "left").select("page_id", "url", "payload", "digest", "first", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                index: dict[str, list] = {c.split()[0]: [] for c in INDEX.split(", ")}
                page, link, digests, first, again = (b.column(c).to_pylist() for c in ("page_id", "url", "digest", "first", "revisit"))
                payloads = b.column("payload")  # one at a time: the batch is not copied
                for i in range(b.num_rows):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        fs.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page[i], link[i], payloads[i].as_py(), digests[i], first[i], again[i])) + packer.flush()
                    out.write(member)
                    for c, v in zip(index, (name, at, len(member), link[i], digests[i], "revisit" if again[i] else "response", page[i]), strict=True):
                        index[c].append(v)
                    at += len(member)
                if out is not None:
                    out.flush()
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(index.values(), types, strict=True)], names=list(index))
        finally:
            if out is not None:
                out.close()

    index = materialise(typed.mapInArrow(lean(run), INDEX), "warc-index")
    drop_scratch(spark, shared)
    return index


def _requests(offsets: list[int], lengths: list[int], gap: int, most: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of the sorted ranges that one request fetches."""
    first = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > gap or offsets[i] + lengths[i] - offsets[first] > most:
            yield first, i
            first = i


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of any selection of index rows. Each response's payload is held against its digest."""
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        opened: tuple[str, object] | None = None
        for b in batches:
            files, offsets, lengths = (b.column(c).to_pylist() for c in ("file", "offset", "length"))
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                if opened is None or opened[0] != files[lo]:
                    if opened is not None:
                        opened[1].close()
                    opened = files[lo], fs.open_input_file(f"{base}/{files[lo]}")
                for s, e in _requests(offsets[lo:hi], lengths[lo:hi], GAP, REQUEST):
                    start = offsets[lo + s]
                    data = opened[1].read_at(offsets[lo + e - 1] + lengths[lo + e - 1] - start, start)
                    # What one request fetched goes on before the next is made.
                    yield from _parsed(data, [(offsets[i] - start, lengths[i]) for i in range(lo + s, lo + e)], payloads)
                lo = hi
        if opened is not None:
            opened[1].close()

    # Tasks by bytes of archives, not by those of the index, which adaptive execution would go by.
    total = index.agg(F.sum("length")).first()[0] or 0
    block = F.floor(F.col("offset") / TASK_BYTES)
    placed = index.select("file", "offset", "length").withColumn("block", block).repartition(max(1, -(-total // TASK_BYTES)), "file", "block").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(lean(run), READ)


#: Payload bytes of one batch of records that are read back.
PART_BYTES = 8 << 20


def _parsed(data: bytes, ranges: list[tuple[int, int]], payloads: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    rows, held = [], 0
    for k, (at, n) in enumerate(ranges):
        rows.append(_row(data[at : at + n], payloads))
        held += len(rows[-1][-1] or b"")
        if held >= PART_BYTES or k + 1 == len(ranges):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in READ.split(", ")])
            rows, held = [], 0


def _row(member: bytes, payloads: bool) -> tuple:
    r = parse(zlib.decompress(member, 31))
    h = r["headers"]
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    kind = h["warc-type"]
    if kind == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
        raise ValueError(f"record {h['warc-record-id']}: its payload doesn't have the digest that it names")
    number = lambda k: int(h[k]) if k in h else None
    url = h.get("warc-target-uri")
    url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None
    return number("x-page-id"), url, int(r["http"]["content-length"]), digest, kind, number("x-refers-to-page-id"), r["payload"] if payloads and kind == "response" else None


def round_trip(pages: DataFrame, spark: SparkSession | None = None, folder: str | None = None) -> DataFrame:
    """Write all pages and read all records back."""
    folder = folder or scratch_path(spark or pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder, payloads=False)
