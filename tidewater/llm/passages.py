"""Substring dedup: paragraph MinHash banding.

The paragraphs compared are the shortest units that stay whole when a passage is spliced into another text: sentences,
cut at line ends and after ``.``, ``!`` or ``?``. A paragraph's set is its distinct five-word shingles. Each of ``bands``
minima of the set is a band of one row: unrelated sentences share no five-word shingle at all, so one row
suffices to keep them apart, and a pair of similarity 0.8 misses all four bands with probability 0.2 ** 4 = 0.0016.

Colliding paragraphs are joined to the first of their bucket, verified by exact Jaccard on their words, and clustered by
connected components; equal paragraphs are one node. Where this leaves a bucket in several components, all members outside
its largest one are held against the whole bucket, as blocks against blocks of bounded bytes. A paragraph
is a repeat if its component has an earlier occurrence (smaller doc_id, then place). Neighbouring repeats of at least
``least_words`` words together are a passage that is removed; neighbouring paragraphs of what stays, a passage that is
kept. A paragraph of five words or more that occurs once ends a passage.

With ``exact_words``, passages are also followed beyond their whole sentences, as a splice may cut a sentence at either end. Pieces of
sentences of LONG words or more, and of neighbouring sentences too short to be paragraphs, are then banded like paragraphs (for equality only, in one
band), cut where the words say so. Where a paragraph or piece that repeats is not yet in a passage, the words about it are compared: it and
half of what it lacks of ``exact_words``, on its left and on its right (any stretch of that length holds one of the two), then
every stretch of ``exact_words`` words about those that agree with another document. A stretch that another document holds
word for word is a passage, or widens those that it overlaps; it is removed if a smaller doc_id holds it. Kept passages that lie within
removed ones are left out. Rows that repeat an id are compared by whole paragraphs only.

Defined cases: null or empty text has no paragraphs; paragraphs of fewer than five words only join runs, they never
start one; rows that repeat an id are taken as further copies; a null doc_id takes no part; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, components, keep_ids, materialise
from .near_dup import multipliers
from .sentences import SHINGLE, Texts, bytes_in, chunks, paragraphs, ranges, shared, shingle_sets, slices

POSTED = "bucket long, content long, doc_id long, copies long"
BLOCK_BYTES = 1 << 16  # about what one block of paragraphs holds
PART = 8  # blocks of one join key
FEW = 1024  # pairs of paragraphs up to which those of two blocks are looked at one by one, not as a product of matrices
__all__ = ["clusters", "paragraphs", "repeated_passages"]


def _content(words: list[bytes]) -> int:
    t = Texts(pa.array([b" ".join(words).decode()]))
    return int(t.contents(np.array([0]), np.array([len(t.at)]))[0])


def _units(t: Texts, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """first and last word of every paragraph of five words or more, then, with ``exact``, of every piece; the number of the former."""
    long = t.last - t.first >= SHINGLE
    first, last = t.first[long], t.last[long]
    if not exact:
        return first, last, len(first)
    more = t.pieces()
    return np.concatenate([first, more[0]]), np.concatenate([last, more[1]]), len(first)


def _once(own: np.ndarray, doc: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first by ``doc`` of equal paragraphs, and of equal pieces (from ``whole`` on), in order; how many each stands for."""
    piece = np.arange(len(own)) >= whole
    order = np.lexsort((doc, own, piece))
    begin = np.flatnonzero(np.append(True, (np.diff(own[order]) != 0) | np.diff(piece[order])))
    back = np.argsort(order[begin])
    return order[begin][back], np.diff(np.append(begin, len(order)))[back]


def _posted(docs: DataFrame, bands: int, exact: bool = False) -> DataFrame:
    """bucket, content, doc_id, copies of every paragraph of five words or more; with ``exact`` of pieces too, in the first band.

    Equal ones of the texts that are looked at together are one row, with the smallest doc_id. In the first band only are, with ``exact``,
    paragraphs of so few shingles that none but an equal set is like them (at 80 percent or more).
    """
    a, b = multipliers(bands)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, t in chunks(batch):
                first, last, whole = _units(t, exact)
                if not len(first):
                    continue
                x, own, doc = t.shingles(), t.contents(first, last), some.column("doc_id").to_numpy()[t.doc[first]]
                at, copies = _once(own, doc, whole)
                first, last, own, doc, whole = first[at], last[at], own[at], doc[at], int(np.searchsorted(at, whole))
                n = (last - first)[:whole]
                more = np.flatnonzero(n >= SHINGLE + 3) if exact else np.arange(whole)
                buckets, at = [], []
                for i in range(bands):
                    y = a[i] * x + b[i]
                    for here in (np.arange(whole), np.arange(whole, len(first))) if i == 0 else (more,):
                        buckets.append(t.minima(first[here], last[here], y).astype(np.int64) + (np.int64(i) << 32))
                        at.append(here)
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (np.concatenate(buckets), own[at], doc[at], copies[at])], names=["bucket", "content", "doc_id", "copies"])

    return docs.mapInArrow(post, POSTED)


def repeated_passages(
    docs: DataFrame, bands: int = 4, percent: int = 80, least_words: int = 30, id_col: str = "doc_id", text_col: str = "text", exact_words: int = 0
) -> DataFrame:
    """doc_id, start, end, n_words, component_id, removed of every passage that occurs more than once."""
    if exact_words and (percent < 80 or exact_words < 2 * SHINGLE):
        raise ValueError("exact_words needs percent >= 80, and is 10 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    found = _found(docs, clusters(docs, bands, percent, bool(exact_words)), exact_words)
    if not exact_words:
        return _runs(found, least_words)
    found = materialise(found, "found")
    base = materialise(_runs(found.where("rank >= 0"), least_words), "passages")
    return _widened(docs, found, base, exact_words)


def clusters(docs: DataFrame, bands: int, percent: int, exact: bool = False) -> DataFrame:
    """content, component, first (smallest doc_id) of every paragraph of ``docs(doc_id, text)`` that occurs more than once; with ``exact`` pieces too."""
    # dealt once, and what is alone in its bucket goes before anything is summed up
    per = Window.partitionBy("bucket")
    posted = _posted(docs, bands, exact).repartition("bucket")
    several = posted.select("*", F.sum("copies").over(per).alias("n"), F.min("content").over(per).alias("hub")).where("n > 1")
    buckets = several.groupBy("bucket", "content", "hub").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
    buckets = materialise(buckets, "buckets")
    # what is worth a look at all: contents that occur twice or share a bucket; the docs that hold them are read again
    pairs = materialise(buckets.where("hub != content").select(F.col("hub").alias("a"), F.col("content").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    holders = buckets.join(wanted, "content", "left_semi").groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    words = materialise(_words_of(docs, holders, exact), "words")
    links = materialise(_verified(pairs, words, percent), "links")
    labels = materialise(components(links), "labels")
    outside = materialise(_outside(buckets, labels, words, percent), "outside")
    if not outside.isEmpty():
        labels = materialise(components(labels.toDF("a", "b").union(outside)), "labels")
    # every bucket of a content knows the first document that holds it
    held = buckets.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.max("copies").alias("copies"))
    nodes = held.join(labels.withColumnRenamed("id", "content"), "content", "left").where("copies > 1 or component is not null")
    nodes = materialise(nodes.select("content", F.coalesce("component", "content").alias("component"), "doc_id"), "nodes")
    first = nodes.groupBy("component").agg(F.min("doc_id").alias("first"))
    return nodes.select("content", "component").join(first, "component")


def _words_of(docs: DataFrame, holders: DataFrame, exact: bool) -> DataFrame:
    """content, words of the paragraphs in ``holders(content, doc_id)``, read from one document that holds each."""
    asked = holders.groupBy("doc_id").agg(F.collect_list("content").alias("contents"))  # of one document

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, t in chunks(batch):
                first, last, _ = _units(t, exact)
                contents, at = np.unique(t.contents(first, last), return_index=True)
                asked = np.isin(contents, some.column("contents").flatten().to_numpy())
                if asked.any():
                    words = list(map(t.words, first[at[asked]].tolist(), last[at[asked]].tolist()))
                    yield pa.RecordBatch.from_arrays([pa.array(contents[asked]), pa.array(words, pa.binary())], names=["content", "words"])

    return docs.join(asked, "doc_id").select("text", "contents").mapInArrow(find, "content long, words binary").dropDuplicates(["content"])


def _verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(bytes_in(batch.column("x")) + bytes_in(batch.column("y"))):
                some = batch.slice(i, j - i)
                sets, edge = shingle_sets(pa.concat_arrays([some.column("x"), some.column("y")]))
                size, n = np.diff(edge), some.num_rows
                both = shared(sets, edge, np.arange(n), n + np.arange(n))
                yield some.select(["a", "b"]).filter(pa.array(100 * both >= percent * (size[:n] + size[n:] - both)))

    both = pairs.join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _outside(buckets: DataFrame, labels: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """Links of the members that stand outside the largest component of a bucket; hubs have been held against all others."""
    at = buckets.where("hub != content").select("bucket", "content").join(labels.toDF("content", "component"), "content", "left")
    at = at.withColumn("component", F.coalesce("component", "content"))
    per = at.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket")
    main = per.agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("k")).where("k > 1")
    # what is known of a bucket is written before the join, so that Spark can split a hot one
    rest = (F.col("component") != F.col("main")).alias("rest")
    at = materialise(at.join(materialise(main.drop("k"), "main"), "bucket").select("bucket", "content", "component", rest), "open")
    size = at.join(words.select("content", F.length("words").alias("bytes")), "content").groupBy("bucket")
    size = size.agg(F.sum("bytes").alias("all"), F.sum(F.when(F.col("rest"), F.col("bytes"))).alias("some"))
    dealt = [F.ceil(F.col(c) / BLOCK_BYTES).alias(n) for c, n in (("all", "n_x"), ("some", "n_y"))]
    full = at.join(materialise(size.select("bucket", *dealt), "dealt"), "bucket").join(words, "content")
    unit = F.struct("content", "component", "rest", "words")
    block = lambda n: F.pmod(F.xxhash64("content"), F.col(n))
    x = full.groupBy("bucket", block("n_x").alias("block")).agg(F.collect_list(unit).alias("x"))  # bounded by BLOCK_BYTES
    x = x.withColumn("part", F.floor(F.col("block") / PART))
    y = full.where("rest").groupBy("bucket", block("n_y").alias("block"))
    y = y.agg(F.collect_list(unit).alias("y"), F.first("n_x").alias("n_x"))
    y = y.select("bucket", "y", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_x") - 1) / PART))).alias("part"))
    return _blocks(x.join(y, ["bucket", "part"]), percent).distinct()


def _blocks(pairs: DataFrame, percent: int) -> DataFrame:
    """Links between two blocks of one bucket, ``x`` and ``y``, by exact Jaccard; ``y`` are outside the main component."""

    def table(sets: np.ndarray, size: np.ndarray, common: np.ndarray) -> np.ndarray:
        """One row a paragraph, one column a shingle that both blocks hold."""
        out = np.zeros((len(size), len(common)), np.float32)
        column = np.minimum(np.searchsorted(common, sets), len(common) - 1)
        held = common[column] == sets
        out[np.repeat(np.arange(len(size)), size)[held], column[held]] = 1
        return out

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(_words_in(batch.column("x")) + _words_in(batch.column("y"))):
                content, component, rest, words, edge = _sides(batch.slice(i, j - i))
                sets, at = shingle_sets(words)
                size, found = np.diff(at), []
                # each pair once: of two that are both outside only one way round counts
                is_open = lambda a, b: (component[a] != component[b]) & ~(rest[a] & (content[a] < content[b]))  # noqa: B023, E731
                n, m = np.diff(edge)[::2], np.diff(edge)[1::2]
                few = np.where(n * m <= FEW, n * m, 0)
                own, place = np.repeat(np.arange(len(n)), few), ranges(np.zeros(len(n), np.int64), few)
                a, b = edge[::2][own] + place // m[own], edge[1::2][own] + place % m[own]
                some = is_open(a, b) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
                a, b = a[some], b[some]
                both = shared(sets, at, a, b)
                like = 100 * both >= percent * (size[a] + size[b] - both)
                found.append((content[a[like]], content[b[like]]))
                for k in np.flatnonzero(n * m > FEW).tolist():
                    lo, mid, hi = edge[2 * k : 2 * k + 3].tolist()
                    x, y = sets[at[lo] : at[mid]], sets[at[mid] : at[hi]]
                    common = np.intersect1d(x, y)
                    if len(common):
                        both = table(x, size[lo:mid], common) @ table(y, size[mid:hi], common).T
                        total = size[lo:mid, None] + size[None, mid:hi] - both
                        near = is_open(np.arange(lo, mid)[:, None], np.arange(mid, hi)[None]) & (100 * both >= percent * total)
                        a, b = np.nonzero(near)
                        found.append((content[lo + a], content[mid + b]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])

    return pairs.select("x", "y").mapInArrow(judge, "a long, b long")


def _words_in(blocks: pa.ListArray) -> np.ndarray:
    """Bytes of the words of every block."""
    total = np.append(0, np.cumsum(bytes_in(blocks.flatten().field("words"))))
    return np.diff(total[np.append(0, np.cumsum(pc.list_value_length(blocks).to_numpy()))])


def _sides(pairs: pa.RecordBatch) -> tuple:
    """content, component, rest and words of the paragraphs of all blocks: those of ``x``, then those of ``y``, of one pair after the other; where each block begins."""
    n = np.stack([pc.list_value_length(pairs.column(c)).to_numpy() for c in ("x", "y")], 1)
    edge = np.append(0, np.cumsum(n.ravel()))
    order = np.empty(edge[-1], np.int64)  # where each paragraph stands among all of x, then all of y
    order[ranges(edge[:-1:2], n[:, 0])] = np.arange(n[:, 0].sum())
    order[ranges(edge[1::2], n[:, 1])] = n[:, 0].sum() + np.arange(n[:, 1].sum())
    x, y = (pairs.column(c).flatten().flatten() for c in ("x", "y"))
    content, component, rest = (np.concatenate([u.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)])[order] for u, v in zip(x[:3], y[:3], strict=True))
    return content, component, rest, pa.concat_arrays([x[3], y[3]]).take(pa.array(order)), edge


def _batch_of(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def _found(docs: DataFrame, nodes: DataFrame, exact_words: int) -> DataFrame:
    """Every place of a paragraph in ``nodes``; with ``exact_words`` of a piece too (rank -1), and hashes of the words on either side."""
    unit = "doc_id long, place int, rank int, start int, end int, n_words int, content long"
    if exact_words:
        unit += ", at int, left int, right int"

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, t in chunks(batch):
                long = np.flatnonzero(t.last - t.first >= SHINGLE)
                begin = np.searchsorted(t.p_doc, t.p_doc[long])  # the first paragraph of the document
                place, rank = long - begin, np.arange(len(long)) - np.searchsorted(long, begin)
                first, last, s, e = t.first[long], t.last[long], t.p_start[long], t.p_end[long]
                if exact_words:
                    more = t.pieces()
                    none = np.full(len(more[0]), -1)
                    place, rank = np.append(place, none), np.append(rank, none)
                    first, last, s, e = (np.append(x, y) for x, y in zip((first, last, s, e), more, strict=True))
                doc = t.doc[first]
                columns = [some.column("doc_id").to_numpy()[doc], place, rank, s, e, last - first, t.contents(first, last)]
                lost = [None] * len(columns)
                if exact_words:
                    k = np.maximum(0, exact_words - (last - first) + 1) // 2
                    columns.append(first - t.edge[doc])
                    lost.append(None)
                    for low, high in ((first - k, last), (first, last + k)):
                        out = (low < t.edge[doc]) | (high > t.edge[doc + 1])
                        columns.append((t.stretch(np.where(out, first, low), np.where(out, last, high)) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                        lost.append(out)
                if len(first):
                    arrays = [pa.array(c, pa.int64() if "long" in x else pa.int32(), mask=m) for c, m, x in zip(columns, lost, unit.split(", "), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in unit.split(", ")])

    return docs.mapInArrow(units, unit).join(nodes, "content")


def _widened(docs: DataFrame, found: DataFrame, base: DataFrame, least: int) -> DataFrame:
    """``base`` with what stands word for word in another document over ``least`` words about the places ``found``."""
    key = F.explode(F.array(*(F.when(F.col(c).isNotNull(), F.xxhash64("content", F.lit(c), c)) for c in ("left", "right"))))
    sides = lambda df: df.select("doc_id", "at", "n_words", key.alias("key")).where("key is not null")
    spans = base.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    within = (found["doc_id"] == spans["doc_id"]) & (spans["s"] <= found["start"]) & (found["end"] <= spans["e"])
    outside = sides(found.join(spans, within, "left_anti")).select("key").distinct()
    several = lambda df, c: df.groupBy(c).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    keys = materialise(several(sides(found), "key").select("key").join(outside, "key", "left_semi"), "sides")
    once = docs.groupBy("doc_id").count().where("count = 1").select("doc_id")
    asked = sides(found).join(keys, "key").groupBy("doc_id").agg(F.collect_set(F.struct("at", "n_words")).alias("places"))
    held = base.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "n_words", "component_id", "removed")).alias("held"))  # one document's
    asked = materialise(asked.join(once, "doc_id", "left_semi").join(held, "doc_id", "left"), "asked")
    ids = asked.select("doc_id")
    n = ids.count()
    texts = keep_ids(docs, "doc_id", ids, n).join(asked, "doc_id").select("doc_id", "text", "places", "held")
    out = "hash long, doc_id long, start int, end int, at int, upto int, n_words int, component_id long, removed boolean"
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.bool_()]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, t in chunks(batch):
                ids = some.column("doc_id").to_numpy()
                doc, at, n = _lists(some.column("places"))
                low, high = np.maximum(0, np.minimum(at, at + n - least)), np.minimum(np.maximum(at, at + n - least), np.diff(t.edge)[doc] - least)
                low, high = (x[low <= high] + t.edge[doc[low <= high]] for x in (low, high))
                taken = np.bincount(low, minlength=len(t.at) + 2) - np.bincount(high + 1, minlength=len(t.at) + 2)
                at = np.flatnonzero(np.cumsum(taken) > 0)
                doc, none = t.doc[at], pa.nulls(len(at))
                place = at - t.edge[doc]
                columns = [t.contents(at, at + least), ids[doc], t.start[at], t.end[at + least - 1], place, place + least, none, none, none]
                yield _columns(columns, out, types)
                doc, start, end, n, component, removed = _lists(some.column("held"))
                if len(doc):
                    base = t.doc << 32
                    low = np.searchsorted(base + t.start, (doc << 32) + start) - t.edge[doc]
                    high = np.searchsorted(base + t.end, (doc << 32) + end, "right") - t.edge[doc]
                    yield _columns([pa.nulls(len(doc)), ids[doc], start, end, low, high, n, component, removed], out, types)

    seen = materialise(texts.mapInArrow(stretches, out), "stretches")
    known = materialise(several(seen.where("hash is not null"), "hash"), "shared")
    hits = seen.where("hash is not null").select("hash", "doc_id", "start", "end", "at").join(known, "hash")
    hits = hits.withColumns({"upto": F.col("at") + least, "n_words": F.lit(None), "component_id": F.lit(None), "removed": F.col("first") < F.col("doc_id")}).select(seen.columns)
    one = F.struct("at", "upto", "start", "end", "hash", "n_words", "component_id", "removed")
    per = hits.union(seen.where("hash is null")).groupBy("doc_id").agg(F.collect_list(one).alias("all"))  # one document's
    made = "doc_id long, start int, end int, n_words int, component_id long, removed boolean"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], batch.column("doc_id").to_pylist()
            per = defaultdict(list)
            for doc, gone, *item in _chained(batch.column("all")):
                per[doc, gone].append(item)
            for doc, name in enumerate(ids):
                removed, kept = (_joined(per[doc, gone]) for gone in (True, False))
                kept = [u for u in kept if not any(v[0] <= u[0] and u[1] <= v[1] for v in removed)]
                rows += [(name, *u[2:], True) for u in removed] + [(name, *u[2:], False) for u in kept]
            if rows:
                yield _batch_of(rows, made, [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.bool_()])

    rest = base.join(F.broadcast(ids), "doc_id", "left_anti") if n <= BROADCAST_IDS else base.join(ids, "doc_id", "left_anti")
    return rest.select(base.columns).union(per.mapInArrow(merged, made))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The row of every struct in a column of lists, then their fields."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return [np.repeat(np.arange(len(column)), n), *(x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())]


def _columns(columns: list, schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _chained(column: pa.ListArray) -> Iterator[tuple]:
    """Every passage, and every chain of stretches that overlap.

    row, removed, at, -upto of its first stretch, whether a chain, upto, -at of its last stretch, start, end, words, component.
    """
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    row, some = np.repeat(np.arange(len(column)), n), dict(zip((f.name for f in column.type.value_type), column.flatten().flatten(), strict=True))
    single = some["hash"].is_null().to_numpy(zero_copy_only=False)
    at, upto, start, end, removed = (some[c].to_numpy(zero_copy_only=False) for c in ("at", "upto", "start", "end", "removed"))
    for i, n, c in zip(np.flatnonzero(single).tolist(), some["n_words"].drop_null().to_pylist(), some["component_id"].drop_null().to_pylist(), strict=True):
        yield int(row[i]), bool(removed[i]), int(at[i]), -int(upto[i]), False, int(upto[i]), -int(at[i]), int(start[i]), int(end[i]), n, c
    many = np.flatnonzero(~single)
    many = many[np.lexsort((at[many], removed[many], row[many]))]
    a, b = many[:-1], many[1:]
    begin = np.flatnonzero(np.append(True, (row[a] != row[b]) | (removed[a] != removed[b]) | (at[b] >= upto[a]))[: len(many)])
    after = np.append(begin[1:], len(many))[: len(begin)]
    mid = some["hash"].take(pa.array(many[(begin + after) // 2])).to_pylist() if len(begin) else []
    x, y = many[begin], many[after - 1]
    yield from zip(*(v.tolist() for v in (row[x], removed[x], at[x], -upto[x], np.ones(len(x), bool), upto[y], -at[y], start[x], end[y], upto[y] - at[x])), mid, strict=True)


def _joined(some: list[list]) -> list[tuple]:
    """at, upto, start, end, words, component of what overlaps as one each; a passage that holds all of it keeps its words and component."""
    out, group, upto = [], [], -1
    for u in [*sorted(some), None]:
        if u is not None and u[0] < upto:
            group.append(u)
            upto = max(upto, u[3])
            continue
        if group:
            passages = [v for v in group if not v[2]]
            whole = next((v for v in passages if v[0] == group[0][0] and v[3] == upto), None)
            last = max(group, key=lambda v: (v[3], v[4], not v[2]))
            mid = passages[len(passages) // 2][8] if passages else group[0][8]
            out.append((whole[0], upto, *whole[5:]) if whole else (group[0][0], upto, group[0][5], last[6], upto - group[0][0], mid))
        group, upto = ([u], u[3]) if u is not None else ([], -1)
    return out


def _runs(found: DataFrame, least_words: int) -> DataFrame:
    """Passages of every document from the components of its paragraphs."""
    one = F.struct("start", "place", "rank", "end", "n_words", "component", (F.col("first") < F.col("doc_id")).alias("again"))
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("units"))  # one document's
    out = "doc_id long, start int, end int, n_words int, component_id long, removed boolean"

    def runs(some: list[dict]) -> Iterator[list[dict]]:
        """Runs of neighbours, at most one paragraph of fewer than SHINGLE words between two of them."""
        run: list[dict] = []
        for u in some:
            if run and (u["rank"] - run[-1]["rank"] > 1 or u["place"] - run[-1]["place"] > 2 or u["again"] != run[-1]["again"]):
                yield run
                run = []
            run.append(u)
        if run:
            yield run

    def passages(some: list[dict]) -> Iterator[tuple[list[dict], bool]]:
        """Runs of repeats that go, then runs of what stays: first occurrences with the repeats that are too short to go."""
        stay = []
        for run in runs(some):
            if run[0]["again"] and sum(u["n_words"] for u in run) >= least_words:
                yield run, True
            else:
                stay += [u | {"again": False} for u in run]
        for run in runs(stay):
            if sum(u["n_words"] for u in run) >= least_words:
                yield run, False

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            own, *fields = _lists(batch.column("units"))
            edge, fields = np.searchsorted(own, np.arange(batch.num_rows + 1)).tolist(), [x.tolist() for x in fields]
            names = [f.name for f in batch.schema.field("units").type.value_type]
            for doc, begin, end in zip(batch.column("doc_id").to_pylist(), edge, edge[1:], strict=False):
                some = [dict(zip(names, u, strict=True)) for u in zip(*(x[begin:end] for x in fields), strict=True)]
                # rows of one id hold several paragraphs of one place: each row is a copy of its own
                copies: dict[int, list[dict]] = defaultdict(list)
                depth = Counter()
                for u in some:
                    copies[depth[u["place"]]].append(u)
                    depth[u["place"]] += 1
                seen = set()
                for copy in copies.values():
                    for u in copy:
                        u["again"] = u["again"] or u["component"] in seen
                        seen.add(u["component"])
                    for run, removed in passages(copy):
                        rows.append((doc, run[0]["start"], run[-1]["end"], sum(u["n_words"] for u in run), run[len(run) // 2]["component"], removed))
            if rows:
                yield _batch_of(rows, out, [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.bool_()])

    return per.mapInArrow(join, out)
