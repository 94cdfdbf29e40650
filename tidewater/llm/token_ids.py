"""Token-id output: whole texts to token ids, packed by Simple-8b into word-aligned binary shards.

A 64-bit little-endian word holds a 4-bit selector (top bits) and 60 bits of payload:

=========  =========================================================================
selector   payload
=========  =========================================================================
0          escape: no id; its low 4 bits are bits 60-63 of the id in the next word
1          120 ids that are all zero
2 ... 15   60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1 ids of 60 // count bits each
=========  =========================================================================

A shard is ``MAGIC``, the words, then the index: int64 word offset of every block of ``BLOCK`` ids, int64
doc ids, one validity byte per document, int64 ids per document, the three counts (ids, blocks, documents) as
int64, and ``MAGIC`` again. Blocks start on a word, so any of them can be decoded alone, and all words of
a range are decoded together with one gather per selector.

Shards are written once each under a name of their own; a Parquet manifest that Spark commits names the shards
that count. A task that is lost or run twice leaves a shard that no manifest row names.

Defined cases: null or empty text has only the end id; a null doc_id sorts first and is kept as null; rows that
repeat are encoded each; extra columns are ignored; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

MAGIC = b"SIMPLE8B"
BLOCK = 1024
#: Ids per word and bits per id of each selector (fixed values of the format).
COUNT = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_SMALL = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)
MANIFEST = "shard string, part int, n_docs long, n_ids long"


def _widths(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits above 60 of each id, and the payload bits that it needs."""
    if int(ids.max()) < 1 << 16:
        return np.zeros(len(ids), np.uint8), _SMALL[ids]
    width = np.searchsorted(np.uint64(1) << np.arange(60, dtype=np.uint64), ids & np.uint64((1 << 60) - 1), side="right")
    high = ids >> np.uint64(60)
    return high, np.where(high > 0, 60, width).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` (uint64) as words, and the word offset of every block of BLOCK ids."""
    n = len(ids)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, "<i8")
    blocks = -(-n // BLOCK)
    end = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    high, need = _widths(ids)
    # widest[i]: bits that the next `reach` ids need; grown from one selector to the next, narrower one
    choice = np.full(n, 15, np.uint8)
    widest, reach = need, 1
    for s in range(14, 0, -1):
        while reach < COUNT[s]:
            step = min(reach, COUNT[s] - reach)
            grown = widest.copy()
            np.maximum(widest[:-step], widest[step:], out=grown[:-step])
            widest = grown
            reach += step
        np.putmask(choice, widest <= BITS[s], s)
    choice[high > 0] = 0
    # one step of every block at a time: where its words start
    at = np.arange(blocks) * BLOCK
    owner, starts = [], []
    live = np.arange(blocks)
    taken = np.where(COUNT[choice] > 0, COUNT[choice], 1)
    while len(live):
        owner.append(live)
        starts.append(at[live].copy())
        at[live] += taken[at[live]]
        live = live[at[live] < end[live]]
    owner, starts = np.concatenate(owner), np.concatenate(starts)
    order = np.lexsort((starts, owner))
    owner, starts = owner[order], starts[order]
    size = np.where(choice[starts] == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), "<u8")
    limit = end[owner]
    for s in np.unique(choice[starts]):
        mine = np.flatnonzero(choice[starts] == s)
        if s == 0:
            words[place[mine]] = high[starts[mine]]
            words[place[mine] + 1] = np.uint64(15 << 60) | (ids[starts[mine]] & np.uint64((1 << 60) - 1))
            continue
        word = np.full(len(mine), int(s) << 60, np.uint64)
        for k in range(COUNT[s] if BITS[s] else 0):
            i = starts[mine] + k
            word |= np.where(i < limit[mine], ids[np.minimum(i, n - 1)], np.uint64(0)) << np.uint64(k * BITS[s])
        words[place[mine]] = word
    first = np.searchsorted(owner, np.arange(blocks))
    return words, place[first].astype("<i8")


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks whose first words are at ``offsets`` in ``words``."""
    selector = (words >> np.uint64(60)).astype(np.intp)
    if not n:
        return np.empty(0, np.uint64)
    first = np.arange(len(offsets)) * BLOCK
    count = COUNT[selector]
    run = np.cumsum(count) - count
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    start = run - run[offsets][block] + first[block]  # a block's last word may be partly filled
    limit = np.minimum(first + BLOCK, n)[block]
    ids = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNT[s] if BITS[s] else 0):
            i = start[mine] + k
            ok = i < limit[mine]
            ids[i[ok]] = (words[mine[ok]] >> np.uint64(k * int(BITS[s]))) & mask
    mine = np.flatnonzero(selector == 0)
    if len(mine):
        ids[start[mine + 1]] |= (words[mine] & np.uint64(15)) << np.uint64(60)
    return ids


#: Letters, digits and spaces up to U+024F, and how a byte-level vocabulary splits text made of these.
LETTERS, DIGITS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \n\t\r"
SPLIT = re.compile(
    f" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEYOND = re.compile("[^\n\t\r\x20-\x7e\xa1-\u024f]")
#: UTF-8 bytes of which no other character is made: printable ASCII, the later bytes of a character, first ones of U+00C0 to U+023F.
COMMON = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xC9)])


def byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is visible, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Parts(dict):
    """Ids of text parts, each worked out by ``learn`` when it is first asked for; keeps at most ``most`` of them."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        super().__init__()
        self.learn, self.most, self.missed = learn, most, 0

    def __missing__(self, part: str) -> bytes:
        self.missed += 1
        ids = self.learn(part)
        if len(self) < self.most:
            self[part] = ids
        return ids

    def renew(self, asked: int) -> None:
        """Start anew if the table is full and gave less than half of the ``asked`` parts since the last call."""
        if len(self) >= self.most and 2 * self.missed > asked:
            self.clear()
        self.missed = 0


class TextEncoder:
    """Token ids of texts by a `tokenizers` vocabulary, with the ids of known parts kept in bounded tables.

    The library splits a text before a space that follows a character other than white space, before a line end that does, and
    before the last one of two such in a row. So a text without three in a row, or two at its end, is cut at every
    space and line end, and each distinct piece goes to the library's split and model once. Other texts of characters up to
    U+024F are split as a whole. A text with any other character or a special token in it goes to the library, and so does
    every text if the vocabulary isn't plain byte-level BPE.
    """

    PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}

    def __init__(self, path: str, most_parts: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Parts(self._model_ids, most_parts // 4)
        self.pieces = Parts(self._piece_ids, most_parts)
        made = json.loads(Path(path).read_text())
        split = {k: v for k, v in (made["pre_tokenizer"] or {}).items() if k in self.PLAIN_SPLIT}
        model = {k: made["model"].get(k) for k in self.PLAIN_MODEL}
        self.plain = split == self.PLAIN_SPLIT and model == self.PLAIN_MODEL and not made["normalizer"] and not made["post_processor"]
        self.special = [t["content"] for t in made["added_tokens"]]
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()

    def _model_ids(self, part: str) -> bytes:
        written = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(written)]).tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        """Ids of a piece with the space before it, or of one that begins with a line end."""
        parts = SPLIT.findall(piece if piece[:1] == "\n" else " " + piece)
        if len(parts) == 1:
            return self._model_ids(parts[0])
        return b"".join([self.pieces[x[1:]] if x[0] == " " else self.bare[x] for x in parts])

    def _is_plain(self, text: str) -> bool:
        # most texts hold no byte outside COMMON; only the others are searched character by character
        if not self.plain or any(t in text for t in self.special):
            return False
        return not (text.encode("utf-8", "surrogatepass").translate(None, COMMON) and BEYOND.search(text))

    def _split_ids(self, text: str) -> bytes:
        if "\t" in text or "\r" in text:
            return b"".join(map(self.bare.__getitem__, SPLIT.findall(text)))
        spaced = text.replace("\n", " ")
        if "   " in spaced or spaced.endswith("  "):
            return b"".join(map(self.bare.__getitem__, SPLIT.findall(text)))
        first, *pieces = text.replace("\n", " \n").split(" ")
        return b"".join(map(self.bare.__getitem__, SPLIT.findall(first))) + b"".join(map(self.pieces.__getitem__, pieces))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native unsigned 32-bit integers."""
        out = [self._split_ids(t) if self._is_plain(t) else None for t in texts]
        rest = [t for t, ids in zip(texts, out, strict=True) if ids is None]
        encoded = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        out = [array("I", next(encoded).ids).tobytes() if ids is None else ids for ids in out]
        asked = sum(map(len, texts)) // 8  # about as many parts as the texts hold
        self.pieces.renew(asked)
        self.bare.renew(asked)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> TextEncoder:
    """One encoder per Python worker, which keeps its pieces from task to task."""
    return TextEncoder(path)


def _store(uri: str):
    """A file system and path for a folder that executors share."""
    from pyarrow import fs

    uri = re.sub("^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    def __init__(self, folder: str, part: int):
        self.store, base = _store(folder)
        self.store.create_dir(base, recursive=True)
        self.name = f"{part:06d}-{uuid.uuid4().hex}.s8b"
        self.out = self.store.open_output_stream(f"{base}/{self.name}")
        self.out.write(MAGIC)
        self.wait, self.words, self.n = [], 0, 0
        self.offsets, self.docs, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.wait.append(np.frombuffer(ids, np.uint32))
        self.n += self.counts[-1]
        if self.n >= BLOCK * 1024:
            self._flush(self.n // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.empty(0, np.uint32)
        words, offsets = pack(ids[:n].astype(np.uint64))
        self.out.write(words.tobytes())
        self.offsets.append(offsets + self.words)
        self.words += len(words)
        self.wait, self.n = [ids[n:]], len(ids) - n

    def close(self) -> tuple[str, int, int]:
        self._flush(self.n)
        offsets = np.concatenate(self.offsets)
        ids, valid = np.array([d or 0 for d in self.docs], "<i8"), np.array([d is not None for d in self.docs], np.uint8)
        totals = np.array([sum(self.counts), len(offsets), len(self.docs)], "<i8")
        for x in (offsets, ids, valid, np.array(self.counts, "<i8"), totals):
            self.out.write(x.tobytes())
        self.out.write(MAGIC)
        self.out.close()
        return self.name, len(self.docs), sum(self.counts)


def read_shard(folder: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of each document of a shard, in order; holds about a thousand blocks at a time."""
    store, base = _store(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        size = f.size()
        f.seek(size - 32)
        tail = f.read(32)
        n, blocks, docs = np.frombuffer(tail[:24], "<i8").tolist()
        index = size - 32 - 8 * blocks - 17 * docs
        if tail[24:] != MAGIC or (index - len(MAGIC)) % 8:
            raise ValueError(f"{name} is not a whole shard")
        f.seek(index)
        offsets = np.frombuffer(f.read(8 * blocks), "<i8")
        ids_of = np.frombuffer(f.read(8 * docs), "<i8")
        valid = np.frombuffer(f.read(docs), np.uint8)
        counts = np.frombuffer(f.read(8 * docs), "<i8")
        bounds = np.append(offsets, (index - len(MAGIC)) // 8)
        have, got, at = np.empty(0, np.uint64), 0, 0
        for doc, ok, count in zip(ids_of.tolist(), valid.tolist(), counts.tolist(), strict=True):
            parts, left = [], count
            while left:
                if got == len(have):
                    b = min(at + 1024, blocks)
                    f.seek(len(MAGIC) + 8 * bounds[at])
                    words = np.frombuffer(f.read(8 * int(bounds[b] - bounds[at])), "<u8")
                    have = unpack(words, offsets[at:b] - bounds[at], min(n, b * BLOCK) - at * BLOCK)
                    got, at = 0, b
                parts.append(have[got : got + left])
                left -= len(parts[-1])
                got += len(parts[-1])
            yield doc if ok else None, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def write_token_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` in ascending id order into shards below ``folder``; returns the committed manifest.

    One range exchange on the id, and on the text and the row where ids repeat, so that an id of very many rows is split.
    ``vocabulary`` is a path that every executor has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    shards, end = f"{folder}/shards", np.uint32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, encoder = TaskContext.get().partitionId(), None, None
        for batch in batches:
            writer = writer or ShardWriter(shards, part)
            encoder = encoder or _encoder(vocabulary)
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                for doc, ids in zip(some.column(0).to_pylist(), encoder(some.column(1).to_pylist()), strict=True):
                    writer.add(doc, ids + end)
        if writer:
            name, n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [name], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    rows.mapInArrow(encode, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_shards(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Documents of the committed shards: doc_id, start, n_tokens, ids_crc32, and the ids themselves on request."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per shard, so one task can number them
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("start", before).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").select("shard", "start")
    shards = f"{folder}/shards"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]

        def out(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if len(columns) == 5 and k == 4 else pa.int64()) for k, c in enumerate(columns)], names=names)

        for batch in batches:
            for shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for doc, x in read_shard(shards, shard):
                    crc = zlib.crc32(x.astype("<u4").tobytes())
                    rows.append((doc, start, len(x), crc) + ((x.astype(np.int64),) if ids else ()))
                    start += len(x)
                    held += 1 + len(x) * ids
                    if held >= 200_000 or len(rows) >= 10_000:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return placed.mapInArrow(decode, schema)


def token_output(docs: DataFrame, vocabulary: str, end_id: int = 2, **columns: str) -> DataFrame:
    """Write the shards of ``docs`` to a new shared folder and read them back."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_token_shards(docs, folder, vocabulary, end_id, **columns)
    return read_token_shards(spark, folder)
