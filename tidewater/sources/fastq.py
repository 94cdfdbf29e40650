"""FASTQ files as a data source: a file is cut into splits, and each split's reader finds its own first record.

A record belongs to the split in which its header line begins. A reader looks for the first header after its split's beginning, parses
on from there and stops at the first header beyond its end; so only the lines around a border are read twice, and no line is
shuffled. Plain files are cut anywhere; block gzip (BGZF) files at block borders, found by the blocks' headers; other gzip files
can't be entered in their middle and are one split, read as a stream.

A header can't be told from a quality line that begins with ``@`` by itself. A reader therefore starts LOOK bytes before its split, at the
first line after which a whole record follows: letters up to a ``+`` line, then quality lines of exactly the same length, then another
``@`` line or the end. From there it parses record after record up to its border; a start inside a record's quality comes right
with the next record. Each reader also asks in the same way where the next split begins, and raises an error if its own records, which it
parsed one after the other, end elsewhere; so a file that deceives the rule is refused (read it with ``split=0``, in one task), never
misread.

Files are opened by their URI through Arrow's file systems (local, HDFS, S3, GCS and the like).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_id string, seq string, qual string, path string, at long"
MAGIC = b"\x1f\x8b"
CHUNK = 1 << 20
LOOK = 1 << 22  # bytes before a border from which a reader starts: some records, or it can't come right
SEQUENCE = re.compile(rb"[A-Za-z.*\-]*")


@dataclass
class Split(InputPartition):
    """From ``start``, exclusive unless it is 0, to ``stop``, inclusive; None is the end of the file. ``kind``: plain, blocks or gzip."""

    path: str
    kind: str
    start: int
    stop: int | None


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_below(path: str) -> list[pafs.FileInfo]:
    """The file, or the files below a folder but hidden ones, by name."""
    fs, where = opened(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(where, recursive=True))
    kept = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted(kept, key=lambda f: f.path)


def block_size(data: bytes, at: int) -> int | None:
    """The bytes of the gzip block at ``at`` if it says how many it has."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 12:
        return None
    end = at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    at += 12
    while at + 4 <= min(end, len(data)):
        size = int.from_bytes(data[at + 2 : at + 4], "little")
        if data[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(data):
            return int.from_bytes(data[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def kind_of(file: pa.NativeFile) -> str:
    head = file.read(64)
    file.seek(0)
    return "plain" if head[:2] != MAGIC else "blocks" if block_size(head, 0) else "gzip"


def _plain(file: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """Positions and pieces of the file from ``start``."""
    file.seek(start)
    while piece := file.read(CHUNK):
        yield start, piece
        start += len(piece)


def _gzip(file: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """The same of what a gzip file of any number of members holds."""
    unpack, at, rest = zlib.decompressobj(31), 0, b""
    while rest := rest or file.read(CHUNK):
        piece = unpack.decompress(rest, CHUNK)
        rest = unpack.unconsumed_tail
        if unpack.eof:
            rest = unpack.unused_data.lstrip(b"\0") or file.read(CHUNK)
            unpack = zlib.decompressobj(31)
        if piece:
            yield at, piece
            at += len(piece)


def _blocks(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """The same of a file in blocks, from the first block at ``start`` or after it; a position is block << 16 | place in it."""
    file.seek(start)
    data = file.read(1 << 18)
    at = 0
    while start and at < len(data):  # a block's header is followed by a block's header, or the file's end
        found = data.find(MAGIC, at)
        n = block_size(data, found) if found >= 0 else None
        if found < 0:
            return
        if n and (start + found + n == size or found + n < len(data) and block_size(data, found + n)):
            at = found
            break
        at = found + 1
    where, data = start + at, data[at:]
    while data:
        n = block_size(data, 0)
        if n is None or len(data) < n:
            more = file.read(CHUNK)
            if not more:
                if data.strip(b"\0"):
                    raise ValueError(f"a damaged block at {where}")
                return
            data += more
            continue
        piece = zlib.decompress(data[:n], 31)
        if piece:
            yield where << 16, piece
        where, data = where + n, data[n:]


def _lines(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Position of each line's first byte, and the line without its end."""
    rest, at = b"", None
    for where, piece in pieces:
        begin = 0
        while (end := piece.find(b"\n", begin)) >= 0:
            yield (where + begin if at is None else at), rest + piece[begin:end]
            rest, at, begin = b"", None, end + 1
        if begin < len(piece):
            at = where + begin if at is None else at
            rest += piece[begin:]
    if rest:
        yield at, rest


class Records:
    """Records of a stream of lines, one after the other."""

    def __init__(self, lines: Iterator[tuple[int, bytes]]):
        self.lines, self.ahead = lines, []

    def line(self) -> tuple[int, bytes] | None:
        return self.ahead.pop(0) if self.ahead else next(self.lines, None)

    def header(self) -> tuple[int, bytes] | None:
        """The next line that may begin a record; those before it are skipped."""
        while (line := self.line()) is not None:
            if line[1].startswith(b"@") and line[1][1:].split():
                return line
        return None

    def record(self, head: bytes) -> tuple[bytes, bytes, bytes]:
        """Name, sequence and quality of the record of a header line: the quality is cut to the sequence's length."""
        seq, qual = [], b""
        while (line := self.line()) is not None and not line[1].startswith(b"+"):
            seq.append(line[1].strip())
        seq = b"".join(seq)
        while len(qual) < len(seq) and (line := self.line()) is not None:
            qual += line[1].strip()
        return head[1:].split()[0], seq, qual[: len(seq)]

    def first(self) -> tuple[int, bytes] | None:
        """The first header of the stream by the rule for borders, which stays the next line to be read."""
        held = []  # the lines from the candidate on

        def line(k: int) -> tuple[int, bytes] | None:
            while len(held) <= k:
                more = self.line()
                if more is None:
                    return None
                held.append(more)
            return held[k]

        while (head := line(0)) is not None:
            if head[1].startswith(b"@") and head[1][1:].split() and self._whole(line):
                self.ahead = held + self.ahead
                return head
            held.pop(0)
        return None

    @staticmethod
    def _whole(line) -> bool:
        k, seq, qual = 1, 0, 0
        while (part := line(k)) is not None and not part[1].startswith(b"+"):
            if not SEQUENCE.fullmatch(part[1].strip()):
                return False
            seq, k = seq + len(part[1].strip()), k + 1
        if part is None:
            return False
        k += 1
        while qual < seq and (part := line(k)) is not None:
            qual, k = qual + len(part[1].strip()), k + 1
        while (part := line(k)) is not None and not part[1].strip():
            k += 1
        return qual == seq > 0 and (part is None or part[1].startswith(b"@"))


def parse_fastq(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """id, seq, qual of lines of text: multi-line records, lines before a header skipped, qual cut to the sequence's length."""
    records = Records((k, line.encode()) for k, line in enumerate(lines))
    while (head := records.header()) is not None:
        yield tuple(x.decode() for x in records.record(head[1]))


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split("\n")
        self.split = int(options.get("split", 64 << 20))

    def partitions(self) -> list[Split]:
        found = []
        for path in self.paths:
            fs, top = opened(path)
            for info in files_below(path):
                with fs.open_input_file(info.path) as file:
                    kind = kind_of(file)
                name = path.rstrip("/") + info.path[len(top.rstrip("/")) :]  # the file as it was asked for, with its scheme
                step = self.split if self.split and kind != "gzip" else info.size
                starts = list(range(0, info.size, max(step, 1)))
                found += [Split(name, kind, at, to) for at, to in zip(starts, [*starts[1:], None], strict=True)]
        return found or [Split("", "none", 0, None)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if part.kind == "none":
            return
        fs, where = opened(part.path)
        with fs.open_input_file(where) as file:
            yield from _batches(part, file, file.size())


def _batches(part: Split, file: pa.NativeFile, size: int, rows: int = 1000, most: int = 8 << 20, look: int = LOOK) -> Iterator[pa.RecordBatch]:
    """Batches of the split's records, closed at ``rows`` records or ``most`` bytes of sequence."""

    def pieces(at: int) -> Iterator[tuple[int, bytes]]:
        return _gzip(file) if part.kind == "gzip" else _blocks(file, at, size) if part.kind == "blocks" else _plain(file, at)

    def place(at: int | None) -> int | None:
        """The position of a border: of the first block that begins behind it, where there are blocks."""
        return at if at is None or part.kind != "blocks" else next((where for where, _ in pieces(at)), None)

    def after(border: int | None, at: int) -> Records:
        """Records whose header lies beyond a border: read from ``look`` bytes before it, so that a wrong start has come right."""
        begin = max(0, at - look)
        lines = _lines(pieces(begin))
        if begin:
            next(lines, None)  # what is left of a line
        records = Records(lines)
        if begin and records.first() is None:
            return records
        while border is not None and (head := records.header()) is not None:
            if head[0] > border:
                records.ahead.insert(0, head)
                return records
            records.record(head[1])
        return records

    stop = place(part.stop)
    records = after(place(part.start), part.start) if part.start else Records(_lines(pieces(0)))
    held, volume = [], 0
    while (head := records.header()) is not None and (stop is None or head[0] <= stop):
        name, seq, qual = records.record(head[1])
        held.append((name.decode(), seq.decode(), qual.decode("latin-1"), part.path, head[0]))
        volume += len(seq)
        if len(held) == rows or volume >= most:
            yield _batch(held)
            held, volume = [], 0
    if held:
        yield _batch(held)
    if stop is not None:
        own, said = head and head[0], after(stop, part.stop).header()
        if (said and said[0]) != own:
            raise ValueError(f"{part.path}: records end at {own}, but the next split begins at {said and said[0]}; read it with split=0")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class FastqSource(DataSource):
    """``spark.read.format("fastq")``, with ``split`` (bytes, 0: whole files) and one path, or several as lines."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))
