"""Reading WARC archives of any writer: plain files or gzip (a member a record, or one for all), ids of any form, digests or none.

Files are dealt over tasks and read as streams, a record at a time. Records that are cut in segments are put together again: grouped by
the id of their origin, ordered by segment number, checked for gaps and against the total length that the last one states. The
payload is what follows the head of an HTTP message, with chunked transfer framing undone, or the block itself for other content.

Defined cases: a record without a payload digest, or with one of another algorithm than SHA-1, has ``digest_ok`` null; a wrong one has
false and the payload is kept as it is; fields that a record lacks are null; header lines may be folded and their names are in any case;
an HTTP message without an end of its head is a head with an empty payload; a record that is cut short, a gap among segments or a wrong
total length raise an error that names the file or the record; a continuation whose first segment is in no file is returned with the type
``continuation`` and what there is of it; an empty file has no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_ids import _store
from .warc import CRLF, payload_of

PIECE = 1 << 20
PART = (
    "record_id string, segment int, total long, record_type string, target_uri string, date string, refers_to string, digest string, "
    "http boolean, block binary"
)
OUT = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, segments int, payload_bytes long, "
    "payload_sha1 string, digest_ok boolean, payload binary"
)


def unpacked(stream) -> Iterator[bytes]:
    """What a file holds, in pieces, whether it is packed or not."""
    data = stream.read(PIECE)
    if not data.startswith(b"\x1f\x8b"):
        while data:
            yield data
            data = stream.read(PIECE)
        return
    unpack = zlib.decompressobj(31)
    while data:
        yield unpack.decompress(data)
        data = unpack.unused_data if unpack.eof else stream.read(PIECE)
        if unpack.eof:
            data = data.lstrip(b"\0") or stream.read(PIECE)
            unpack = zlib.decompressobj(31)


class Bytes:
    """A stream of pieces, read by lines and by numbers of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def line(self) -> bytes | None:
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            more = next(self.pieces, None)
            if more is None:
                break
            self.held += more
        out = self.take(end + 1 if end >= 0 else len(self.held))
        return out or None

    def take(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, None)) is not None:
            self.held += more
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-cased names) and block of every record of a file."""
    data = Bytes(unpacked(stream))
    while True:
        while (line := data.line()) is not None and not line.strip():
            pass
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields, name = {}, None
        while (line := data.line()) is not None and line.strip():
            if line[:1] in b" \t" and name:
                fields[name] += " " + line.strip().decode("utf-8", "replace")
                continue
            key, _, value = line.decode("utf-8", "replace").partition(":")
            name = key.strip().lower()
            fields[name] = value.strip()
        n = int(fields.get("content-length", -1))
        block = data.take(max(n, 0))
        if n < 0 or len(block) != n:
            raise ValueError(f"a record is cut short: {fields.get('warc-record-id')}")
        yield fields, block


def _agrees(payload: bytes, digest: str | None) -> bool | None:
    """Whether a digest, in base 32 or hexadecimal, is that of the payload; None if there is none of SHA-1."""
    kind, _, text = (digest or "").partition(":")
    if kind.lower() not in ("sha1", "sha-1") or not text:
        return None
    own = hashlib.sha1(payload).digest()
    return text.lower() == own.hex() or text.upper() == base64.b32encode(own).decode()


def _finished(block: bytes, http: bool, digest: str | None) -> tuple[int, str, bool | None, bytes]:
    payload = payload_of(block) if http and CRLF + CRLF in block else b"" if http else block
    return len(payload), hashlib.sha1(payload).hexdigest(), _agrees(payload, digest), payload


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def read_warc(spark: SparkSession, files: list[str], kinds: tuple[str, ...] = ("response", "revisit", "resource"), batch: int = 200) -> DataFrame:
    """OUT: the records of ``kinds`` of some archives, with the payload; ``kinds`` may name any type but ``continuation``, which joins its origin."""
    tasks = max(1, min(len(files), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    paths = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks, "file")

    def row(fields: dict[str, str], block: bytes) -> tuple:
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        name = fields.get("warc-segment-origin-id" if fields["warc-type"] == "continuation" else "warc-record-id")
        http = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        about = [fields.get(c) for c in ("warc-type", "warc-target-uri", "warc-date", "warc-refers-to", "warc-payload-digest")]
        return name, int(number or 0), total and int(total), *about, http, block

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for file in some.column(0).to_pylist():
                store, path = _store(file)
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    try:
                        for fields, block in records(stream):
                            if fields.get("warc-type") in (*kinds, "continuation"):
                                rows.append(row(fields, block))
                            if len(rows) >= batch or sum(len(r[-1]) for r in rows[-1:]) > PIECE * 16:
                                yield _batch(rows, PART)
                                rows = []
                    except ValueError as e:
                        raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield _batch(rows, PART)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            rows = []
            for r in some.to_pylist():
                size, sha1, ok, payload = _finished(r["block"], r["http"], r["digest"])
                rows.append((r["record_id"], r["record_type"], r["target_uri"], r["date"], r["refers_to"], 1, size, sha1, ok, payload))
            yield _batch(rows, OUT)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            rows = []
            for parts in some.column("parts").to_pylist():
                first, block = parts[0], b"".join(p["block"] for p in parts)
                if first["segment"] == 1:
                    total = parts[-1]["total"]
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total is not None and total != len(block):
                        raise ValueError(f"segments of {first['record_id']} are missing or their total length differs")
                size, sha1, ok, payload = _finished(block, first["http"], first["digest"])
                about = (first[c] for c in ("record_id", "record_type", "target_uri", "date", "refers_to"))
                rows.append((*about, len(parts), size, sha1, ok, payload))
            yield _batch(rows, OUT)

    parts = paths.mapInArrow(read, PART)
    # only records in segments meet in groups: one is as large as that record; the others are finished where they were read
    columns = [x.split()[0] for x in PART.split(", ")]
    own = F.struct("segment", *[c for c in columns if c != "segment"])
    groups = parts.where("segment > 0").groupBy("record_id").agg(F.array_sort(F.collect_list(own)).alias("parts"))
    return parts.where("segment = 0").mapInArrow(whole, OUT).union(groups.mapInArrow(joined, OUT))
