"""WARC archives of pages: written with an index, read back by byte ranges.

Each task writes gzip members, one per record, into files of about ``FILE_BYTES`` and lists
offset, length, URL and digest of every record as it goes. Reading starts from that index:
selected records are sorted by file and offset, neighbouring ranges become one read, and
the records are parsed from it.

Of records with equal payloads of at least ``LEAST_BYTES`` the one with the smallest page id
is a ``response``; the others are ``revisit`` records that name it and carry no payload.
Pages whose digest may repeat are found with a bit map of fixed size; only they are shuffled.

Defined results: null html is an empty payload, a null URL an empty one; a null page id
sorts after all others; rows that repeat an id are records of their own, and among equal
ids with equal payloads one is the response; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.marks import marks, with_mark
from recordlens.llm.store import fresh_path, open_store, stored
from recordlens.llm.token_ids import utf8

LEAST_BYTES = 100
FILE_BYTES = 64 << 20
#: Archive bytes one task reads back.
TASK_BYTES = 32 << 20
READ_BYTES = 4 << 20
#: Bytes between two wanted records that are read along rather than skipped.
GAP_BYTES = 64 << 10

_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6d6e1a4e-3f5b-5c66-9a2b-0d1f6c1c7a55")

INDEX = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
     ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())]
)
_INDEX_SQL = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id} {digest}')}>"


def _header_text(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_bytes(page_id, url: str, payload: bytes, digest: str, first_id, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest) if not revisit else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_header_text(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first_id, digest)}"]
        if first_id is not None:
            head.append(f"Refers-To-Page-ID: {first_id}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _with_types(pages: DataFrame, id_col: str, url: str, source: str) -> DataFrame:
    """``id, url, html, digest, first_id, revisit`` per page."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(source), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    long_enough = F.octet_length("html") >= LEAST_BYTES
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.xxhash64("url").alias("url"))
    repeated = (
        rows.where(long_enough).groupBy(F.col("digest").alias("key"))
        .agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    )
    repeated = stored(repeated, "repeated-payloads")
    rows = with_mark(rows, marks(repeated, F.xxhash64("key")), F.xxhash64("digest"), "suspect")
    rows = rows.withColumn("suspect", F.col("suspect") & long_enough)
    none = [F.lit(None).cast("long").alias("first_id"), F.lit(False).alias("revisit")]
    alone = rows.where("NOT suspect").select("id", "url", "html", "digest", *none)
    first = F.col("first.none").eqNullSafe(F.col("id").isNull()) & F.col("first.id").eqNullSafe(F.col("id"))
    copies = (
        rows.where("suspect").join(repeated.hint("shuffle_hash"), F.col("digest") == F.col("key"), "left")
        .select("id", "url", "html", "digest", F.col("first.id").alias("first_id"),
                (F.col("key").isNotNull() & ~(first & (F.col("first.url") == F.xxhash64("url")))).alias("revisit"))
    )
    return alone.unionByName(copies)


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html",
    folder: str | None = None,
) -> DataFrame:
    """Write one record per page; the index, one row per record, of the files that count."""
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        part, name, out, offset = TaskContext.get().partitionId(), "", None, 0
        try:
            for batch in batches:
                ids, firsts = batch.column(0).to_pylist(), batch.column(4).to_pylist()
                urls, digests, revisits = (batch.column(k).to_pylist() for k in (1, 3, 5))
                rows = []
                for k, payload in enumerate(utf8(batch.column(2))):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = record_bytes(ids[k], urls[k], payload, digests[k], firsts[k], revisits[k])
                    out.write(data)
                    kind = "revisit" if revisits[k] else "response"
                    rows.append((f"{folder}/{name}", offset, len(data), ids[k], urls[k], digests[k], kind))
                    offset += len(data)
                if rows:
                    yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(INDEX.names, zip(*rows))}, INDEX)
        finally:
            if out is not None:
                out.close()

    return stored(_with_types(pages, id_col, url, source).mapInArrow(write, _INDEX_SQL), "warc-index")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records an index (or a selection of its rows) points to, from the archives:
    page id, URL, payload length and digest, type, and the page a revisit refers to."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())]
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if with_payload:
        fields.append(("payload", pa.binary()))
        kind += ", payload binary"
    schema = pa.schema(fields)

    def parsed(member: bytes) -> tuple:
        warc, http, payload = parse_record(member)
        digest, revisit = warc["WARC-Payload-Digest"].partition(":")[2], warc["WARC-Type"] == "revisit"
        size = int(http["Content-Length"])
        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
        page, first = warc.get("Page-ID"), warc.get("Refers-To-Page-ID")
        row = (int(page) if page else None, warc["WARC-Target-URI"], size, digest, warc["WARC-Type"], int(first) if first else None)
        return row + (payload,) if with_payload else row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (None, None)
        for batch in batches:
            for run in _coalesced(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                file, start, end = run[0][0], run[0][1], run[-1][1] + run[-1][2]
                if opened[0] != file:
                    if opened[1] is not None:
                        opened[1].close()
                    store, path = open_store(file)
                    opened = file, store.open_input_file(path)
                data = opened[1].read_at(end - start, start)
                rows = [parsed(data[at - start : at - start + size]) for _, at, size in run]
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(schema.names, zip(*rows))}, schema)
        if opened[1] is not None:
            opened[1].close()

    # As many tasks as the archives have parts of ``TASK_BYTES``, however small the index is.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    return wanted.sortWithinPartitions("file", "offset").mapInArrow(read, kind)


def _coalesced(ranges) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted ranges in runs that one read fetches."""
    run: list[tuple[str, int, int]] = []
    for file, at, size in ranges:
        if run and (
            run[0][0] != file or at - run[-1][1] - run[-1][2] > GAP_BYTES or at + size - run[0][1] > READ_BYTES
        ):
            yield run
            run = []
        run.append((file, at, size))
    if run:
        yield run
