"""Ranked lexical search by K2-treaps over the grid of terms and documents.

Documents are taken in blocks of bounded size where they are read. A block is a grid with a row per term, those in most
documents first, and a column per document; a cell that holds a posting has its *impact*, what one unit of weight of the
term gives the document. The grid is a quadtree: a node is a square, its four children are its quarters, and only those that hold a
posting exist. Each level is one bit vector (four bits a node; the k-th bit that is set is the k-th node of the next level,
found by rank) and the nodes' largest impacts, stored as what they fall short of their parent's.

A query walks down the rows of all its terms at once. A state is a range of documents with the node of each term at it; the sum
of weights times the nodes' maxima bounds every document's score in the range, and at a single document is the score. States are
opened best first, in batches, until no bound reaches the k-th best score, so ties are whole. Blocks answer on their own and
the best k of all are the answer; scores are whole numbers, so the order of sums does not matter.

The index is a table in the shared folder, built in two narrow passes (terms and frequencies of a block; then, with the two
numbers of the corpus that impacts depend on, the trees); no text is shuffled. Frequencies of asked terms are sums over blocks.
Queries are sent to the blocks in pages of about ``page`` terms each, so their number is not bounded by any memory.

Defined cases: null and empty texts have no terms and count as no documents; rows with a null id take no part, neither documents nor
items; rows that repeat a doc_id are documents each; rows that repeat an item_id are one item with the terms of all; an item
without terms, or none of whose terms has weight, gives no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import letter_words, materialise

#: Bytes to what they are read as: A-Z in lower case, what separates words as a space, anything beyond ASCII as it is.
READ = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
#: terms are lines, as no term holds a line end; what is long and only read in Python is bytes: ids and sizes, columns and frequencies.
FORWARD = "documents long, total long, terms string, counts array<int>, ids binary, sizes binary, docs binary, tf binary"
KINDS = pa.schema([
    ("documents", pa.int64()), ("total", pa.int64()), ("terms", pa.string()), ("counts", pa.list_(pa.int32())), ("ids", pa.binary()), ("sizes", pa.binary()),
    ("docs", pa.binary()), ("tf", pa.binary()),
])
PIECE = 1 << 22
INDEX = "terms string, ids binary, height int, bits array<binary>, falls array<binary>, top long"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of an array of texts, in order, and the number of each text's."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(offsets[0])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low : int(offsets[-1])]
    read = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - low), pa.py_buffer(READ[data])])
    split = pc.ascii_split_whitespace(read)
    words, ends = split.flatten(), split.offsets.to_numpy()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # before a leading and behind a trailing space
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), np.diff(before[ends - ends[0]])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norm(size: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 10 + (90 * size * documents) // total


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class K2Treap:
    """``bits[l]`` are the words of level l's bit vector, ``falls[l]`` what the maxima of level l's nodes lack of their parents'."""

    def __init__(self, height: int, bits: list[np.ndarray], falls: list[np.ndarray], top: int):
        self.height, self.bits, self.falls, self.top = height, bits, falls, top
        # all levels behind each other, and where each begins
        self.words, self.fall = np.concatenate(bits), np.concatenate([f.astype(np.int64) for f in falls])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        self.word_at = np.cumsum([0, *(len(b) for b in bits)])
        self.node_at = self.before[self.word_at]

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> K2Treap:
        """From the cells that are not empty."""
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code)
        code, most = code[order], values[order]
        bits, falls = [], []
        for _ in range(height):
            parent = code >> np.uint64(2)
            new = np.concatenate([[True], parent[1:] != parent[:-1]])
            first, number = np.flatnonzero(new), np.cumsum(new) - 1
            flags = np.zeros(-(-4 * len(first) // 64) * 64, np.uint8)
            flags[4 * number + (code & np.uint64(3)).astype(np.int64)] = 1
            bits.append(np.packbits(flags, bitorder="little").view(np.uint64))
            above = np.maximum.reduceat(most, first)
            fall = above[number] - most
            falls.append(fall.astype(np.min_scalar_type(int(fall.max(initial=0)))))
            code, most = parent[first], above
        return cls(height, bits[::-1], falls[::-1], int(most[0]))

    def packed(self) -> tuple[list[bytes], list[bytes]]:
        """Words, and falls behind a byte that gives their width."""
        return [b.tobytes() for b in self.bits], [bytes([f.itemsize]) + f.tobytes() for f in self.falls]

    @classmethod
    def unpacked(cls, height: int, bits: list[bytes], falls: list[bytes], top: int) -> K2Treap:
        return cls(height, [np.frombuffer(b, np.uint64) for b in bits], [np.frombuffer(f, f"u{f[0]}", offset=1) for f in falls], top)

    def child(self, level: np.ndarray, node: np.ndarray, quarter: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of the nodes of a level (a row of states each) in a quarter, with their maxima; -1 and 0 where there is none."""
        at = 4 * np.maximum(node, 0) + quarter
        place, at = (at & 63).astype(np.uint64), (at >> 6) + self.word_at[level][:, None]
        word = self.words[at]
        there = (node >= 0) & ((word >> place) & np.uint64(1)).astype(bool)
        rank = self.before[at] + np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1)))
        most = np.where(there, value - self.fall[np.where(there, rank, 0)], 0)
        return np.where(there, rank - self.node_at[level][:, None], -1), most

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, opened: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Scores and columns of the best k columns and all that tie with the last of them, scores above 0.

        States are opened ``opened`` at a time, the best first; after each time twice as many, up to 1024.
        """
        score, column, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        if not len(rows):
            return score, column
        start = np.full((1, len(rows)), self.top, np.int64)
        bound, level, at, node, value = weights @ start.T, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros_like(start), start
        while len(bound):
            order = np.argpartition(-bound, opened)[:opened] if len(bound) > opened else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[order] = False
            held = bound[rest], level[rest], at[rest], node[rest], value[rest]
            down = self.height - level[order] - 1
            row = 2 * ((rows >> down[:, None]) & 1)
            parts = [self.child(level[order], node[order], row + half, value[order]) for half in (0, 1)]
            node, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            bound, level = value @ weights, np.concatenate([level[order] + 1] * 2)
            at = np.concatenate([2 * at[order] + half for half in (0, 1)])
            done = (level == self.height) & (bound >= kth)
            score, column = np.append(score, bound[done]), np.append(column, at[done])
            if len(score) >= k:
                kth = max(1, int(np.partition(score, -k)[-k]))
                column, score = column[score >= kth], score[score >= kth]
            on = (level < self.height) & (bound >= kth)
            was = held[0] >= kth
            bound, level, at, node, value = (np.concatenate([h[was], x[on]]) for h, x in zip(held, (bound, level, at, node, value), strict=True))
            opened = min(2 * opened, 1024)
        return score, column


def forward(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 16_384, tokens: int = 1 << 20) -> DataFrame:
    """Blocks of about ``documents`` documents, closed when they hold ``tokens`` terms with repeats: their terms and frequencies.

    A block exceeds either by a batch of texts (PIECE bytes) or by one long text at most.
    """

    def close(ids: list, words: list, sizes: list) -> pa.RecordBatch:
        ids, size = np.concatenate(ids), np.concatenate(sizes)
        coded = pa.chunked_array(words).dictionary_encode().combine_chunks()
        words.clear()
        names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.argsort(-size, kind="stable")[: np.count_nonzero(size)]  # long ones first; those without terms are none
        column = np.empty_like(size)
        column[some] = np.arange(len(some))
        cell, tf = np.unique(code * len(some) + np.repeat(column, size), return_counts=True)
        term, doc = np.divmod(cell, max(len(some), 1))
        n = np.bincount(term, minlength=len(names))
        rank = np.argsort(-n, kind="stable")  # terms in most documents first
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        order = np.argsort(place[term], kind="stable")
        out = {
            "documents": len(some), "total": int(size.sum()), "terms": "\n".join(names.take(pa.array(rank)).to_pylist()), "counts": n[rank].astype(np.int32),
            "ids": ids[some].tobytes(), "sizes": size[some].tobytes(), "docs": doc[order].astype(np.int32).tobytes(), "tf": tf[order].astype(np.int32).tobytes(),
        }
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_pylist([out], schema=KINDS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, held, n = [], [], [], 0, 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):  # as many texts at once as a piece may have bytes, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
                terms, size = terms_of(texts.slice(at, to - at))
                ids.append(batch.column(0).slice(at, to - at).to_numpy())
                words.append(terms)
                sizes.append(size)
                held, n, at = held + len(terms), n + to - at, to
                if n >= documents or held >= tokens:
                    yield close(ids, words, sizes)
                    ids, words, sizes, held, n = [], [], [], 0, 0
        if held:
            yield close(ids, words, sizes)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return materialise(rows.mapInArrow(blocks, FORWARD), "forward", 1)  # a reader holds the rows of a file at once


def corpus(blocks: DataFrame) -> tuple[int, int]:
    """How many documents hold a term, and all their terms with repeats."""
    row = blocks.agg(F.sum("documents").alias("n"), F.sum("total").alias("l")).first()
    return row["n"] or 0, row["l"] or 0


def build(blocks: DataFrame, documents: int, total: int) -> DataFrame:
    """The index: a K2-treap for each of the ``blocks`` of `forward`, written in the shared folder."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, docs, tf = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("sizes", np.int64), ("docs", np.int32), ("tf", np.int32)))
                counts = batch.column("counts")[k].values.to_numpy()
                height = max(1, int(max(len(sizes), len(counts)) - 1).bit_length())
                rows = np.repeat(np.arange(len(counts)), counts)
                tree = K2Treap.build(rows, docs, impact(tf.astype(np.int64), norm(sizes, documents, total)[docs]), height)
                bits, falls = tree.packed()
                one = [pa.array([height], pa.int32()), pa.array([bits], pa.list_(pa.binary())), pa.array([falls], pa.list_(pa.binary())), pa.array([tree.top])]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("terms").slice(k, 1), batch.column("ids").slice(k, 1), *one], names=names)

    return materialise(blocks.mapInArrow(trees, INDEX), "treaps", 1)


def weighted_items(items: DataFrame, blocks: DataFrame, documents: int, item_col: str, text_col: str) -> DataFrame:
    """item, terms, weights of every item that has any, terms that no document holds left out."""
    terms = items.select(F.col(item_col).alias("item"), F.explode(letter_words(F.col(text_col))).alias("term")).where("item is not null").distinct()
    terms = materialise(terms, "asked")
    held = blocks.select(F.explode(F.arrays_zip(F.split("terms", "\n").alias("term"), F.col("counts").alias("n"))).alias("t")).select("t.term", "t.n")
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    own = terms.join(df.select("term", weight.alias("weight")), "term").where("weight > 0")
    rows = own.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("own"))
    return materialise(rows.select("item", "own.term", "own.weight"), "items")


def search(index: DataFrame, items: DataFrame, k: int = 10, page: int = 1_000_000) -> DataFrame:
    """item, rank, doc_id, score of the best ``k`` documents of every row of ``items(item, term, weight)``."""
    kind = items.schema["item"].dataType
    total = items.agg(F.sum(F.size("term"))).first()[0] or 0
    pages = -(-total // page)
    shown = f"item {kind.simpleString()}, doc_id long, score long"
    found = items.sparkSession.createDataFrame([], shown)
    for p in range(pages):
        asked = items.where(F.pmod(F.xxhash64("item"), F.lit(pages)) == p).collect()  # about `page` terms

        def answer(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    tree = K2Treap.unpacked(*(batch.column(c)[r].as_py() for c in ("height", "bits", "falls", "top")))
                    place = {t: i for i, t in enumerate(batch.column("terms")[r].as_py().split("\n"))}
                    ids, out = np.frombuffer(batch.column("ids")[r].as_buffer(), np.int64), []
                    for q in asked:
                        own = [(place[t], w) for t, w in zip(q.term, q.weight, strict=True) if t in place]
                        rows, weights = (np.array([x[j] for x in own], np.int64) for j in (0, 1))
                        score, column = tree.best(rows, weights, k)
                        found_ids = ids[column]
                        first = np.lexsort((found_ids, -score))[:k]
                        out += [(q["item"], d, s) for d, s in zip(found_ids[first].tolist(), score[first].tolist(), strict=True)]
                    columns = zip(*out, strict=True) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["item", "doc_id", "score"])

        types = [pa.string() if kind.simpleString() == "string" else pa.int64(), pa.int64(), pa.int64()]
        found = found.union(index.mapInArrow(answer, shown))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", **block) -> DataFrame:
    """item_id, rank, doc_id, score: the index of ``docs`` built, written and asked for every row of ``items``."""
    kind = items.schema[item_col].dataType.simpleString()
    items = items.select(F.col(item_col).cast("string" if kind == "string" else "long").alias(item_col), text_col)
    blocks = forward(docs, **block)
    documents, total = corpus(blocks)
    index = build(blocks, documents, total)
    return search(index, weighted_items(items, blocks, documents, item_col, text_col), k).withColumnRenamed("item", item_col)
