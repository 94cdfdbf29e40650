"""WARC archives: writing pages as records, and reading them with segment reassembly.

Writer: one gzip member per record, in files of their own per task, each opening with a warcinfo record; a Parquet manifest
that Spark commits names the files that count, so lost or repeated tasks leave nothing that is read. Of equal payloads of at
least ``revisit_bytes`` the one with the largest page_id is a response and the others are revisits of it. Payloads of
``chunk_bytes`` and more use chunked transfer framing; blocks above ``segment_bytes`` are cut into continuation records.
A record's id is made of the page_id and the payload's digest, so a revisit names its response without having seen it.

Reader: archives are dealt over many tasks; records are grouped by origin identifier, ordered by segment number and joined;
the total length, the payload digest and the framing are verified. Whole records pass through the same grouping with their
digest columns only.

Defined cases: null html is an empty payload; rows that repeat a page_id are records each, those with equal payloads too are
told apart by a number, and a tie for the largest page_id makes each a response, the first of them the one that revisits name;
a null page_id is kept as null and never a response to others; null url is written as an empty field; an empty table gives
an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch
from .token_ids import _store

MANIFEST = "file string, n long"
RECORD = (
    "origin string, segment int, total long, page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, block binary"
)
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of repeated payloads (under 100 bytes each) that are broadcast; beyond it pages are joined by a shuffle.
BROADCAST_DIGESTS = 500_000


def frame(payload: bytes, chunk: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + chunk]), payload[k : k + chunk]) for k in range(0, len(payload), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
        if len(out[-1]) != size or body[at - 2 : at] != CRLF:
            raise ValueError("a chunk is cut short")


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(CRLF + CRLF)
    return unframe(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(page_id: int | None, digest: str, copy: int = 1) -> str:
    """The id of a page's record; ``copy`` numbers rows that are equal in both."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{f':{copy}' * (copy > 1)}>"


def info_record(name: str, date: str) -> bytes:
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": name}
    return record(fields | {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")


def records_of(page_id, url, payload: bytes, digest: str, target, copy: int, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The record of a page, and its continuations."""
    name = record_id(page_id, digest, copy)
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    first = {"WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": uri}
    first["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    first["Content-Type"] = "application/http; msgtype=response"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    length = b"Content-Length: %d\r\n\r\n" % len(payload)
    if target is not None:
        about = {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(target, digest)}
        yield record({"WARC-Type": "revisit", **first, **about}, plain + length)
        return
    if len(payload) >= chunk_bytes:
        block = plain + b"Transfer-Encoding: chunked\r\n\r\n" + frame(payload, chunk_bytes)
    else:
        block = plain + length + payload
    if len(block) <= segment_bytes:
        yield record({"WARC-Type": "response", **first}, block)
        return
    for n, k in enumerate(range(0, len(block), segment_bytes), 1):
        some = block[k : k + segment_bytes]
        if n == 1:
            yield record({"WARC-Type": "response", **first, "WARC-Segment-Number": 1}, some)
            continue
        fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}:segment:{n}>", "WARC-Date": date, "WARC-Target-URI": uri}
        fields |= {"WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n}
        last = {"WARC-Segment-Total-Length": len(block)} if k + segment_bytes >= len(block) else {}
        yield record(fields | last, some)


def decide(pages: DataFrame, revisit_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest, target (of revisits) and copy of every page.

    The digests of repeated payloads are broadcast if they are few, and then no payload is shuffled; else they are written
    before the join, so Spark can split the pages of one very common payload.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest")
    first = large.agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialise(first, "digests")
    few = first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(first) if few else first, "digest", "left")
    other = F.coalesce(F.col("page_id") != F.col("target"), F.col("target").isNotNull())
    rows = rows.withColumn("target", F.when(other, F.col("target")))
    if pages.groupBy(F.col(id_col).alias("page_id")).count().where("count > 1").isEmpty():
        return rows.withColumn("copy", F.lit(1))
    same = Window.partitionBy("page_id", "digest").orderBy("url")
    return rows.withColumn("copy", F.row_number().over(same))


def write_archives(
    pages: DataFrame, folder: str, revisit_bytes: int = 1000, segment_bytes: int = 16384, chunk_bytes: int = 4096,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None,
) -> DataFrame:
    """Write ``pages`` below ``folder``; returns the committed manifest. ``date`` (now if not given) dates all records."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    columns = ("page_id", "url", "payload", "digest", "target", "copy")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            for page_id, url, payload, digest, target, copy in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if out is None:
                    store, base = _store(f"{folder}/archives")
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(info_record(name, date))
                for raw in records_of(page_id, url, payload, digest, target, copy, date, segment_bytes, chunk_bytes):
                    out.write(raw)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    decided = decide(pages, revisit_bytes, id_col, url_col, html_col).select(*columns)
    decided.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-cased names) and block of every record of a file of gzip members, read a piece at a time."""
    z, held = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        held.append(z.decompress(data))
        if not z.eof:
            data = stream.read(1 << 20)
            continue
        raw, data = b"".join(held), z.unused_data or stream.read(1 << 20)
        z, held = zlib.decompressobj(31), []
        head, _, rest = raw.partition(CRLF + CRLF)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        block = rest[: int(fields["content-length"])]
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block
    if any(held):
        raise ValueError("the last record is cut short")


def _page(name: str) -> int | None:
    ident = name.split(":")[2].rstrip(">")
    return int(ident) if ident else None


def _checked(block: bytes, digest: str) -> tuple[int, str]:
    payload = payload_of(block)
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    return len(payload), digest


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, segments of every page in the archives."""
    schema = spark.createDataFrame([], RECORD).schema
    names = schema.names
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    # with the number of tasks given, small as the file names are, Spark leaves them apart
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").repartition(parts, "file").select("file")
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, name = fields["warc-type"], fields["warc-record-id"]
        segment = int(fields.get("warc-segment-number", 0))
        if kind == "continuation":
            total = fields.get("warc-segment-total-length")
            return fields["warc-segment-origin-id"], segment, total and int(total), None, None, None, None, None, block
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        if segment:
            return name, segment, None, _page(name), kind, None, None, digest, block
        if kind == "revisit":
            length = next(int(x.split(b":")[1]) for x in block.split(CRLF) if x.lower().startswith(b"content-length"))
            return name, 0, None, _page(name), kind, _page(fields["warc-refers-to"]), length, digest, None
        length, digest = _checked(block, digest)
        return name, 0, None, _page(name), kind, None, length, digest, None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, base = _store(f"{folder}/archives")
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    rows = []
                    for fields, block in parse_archive(stream):
                        if fields["warc-type"] != "warcinfo":
                            rows.append(row(fields, block))
                        if len(rows) >= 500:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, digests = batch.column("payload_bytes").to_pylist(), batch.column("payload_digest").to_pylist()
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                if parts:
                    block = b"".join(p["block"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                        raise ValueError("segments are missing or their total length differs")
                    lengths[i], digests[i] = _checked(block, digests[i])
            checked = {"payload_bytes": pa.array(lengths, pa.int64()), "payload_digest": pa.array(digests, pa.string())}
            fields = [x.split()[0] for x in out.split(", ")]
            yield pa.RecordBatch.from_arrays([checked.get(x, batch.column(x)) for x in fields], names=fields)

    parsed = files.mapInArrow(read, RECORD)
    # a group is one record: as large as that page, not as the table
    whole = parsed.groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")],
        F.array_sort(F.collect_list(F.when(F.col("segment") > 0, F.struct("segment", "total", "block")))).alias("parts"),
    ).withColumn("segments", F.greatest(F.size("parts"), F.lit(1)))
    return whole.drop("origin").mapInArrow(join, out)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder)
