"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form a class by a hash of the set. Class representatives are banded; in each
bucket one hub is held against the other members, so a bucket of n makes n pairs. A pair's signatures are compared
batch by batch and dropped once the posterior that its similarity reaches the threshold is below ``miss``;
survivors are verified on their full word sets. Where the stars leave a bucket in several components, all members
outside its largest one are held against the whole bucket, as blocks against blocks of bounded bytes: a pair is
judged in the first bucket that it shares, by signatures and then by 32-bit shingle hashes, and becomes a row only
if it is linked by both. So no candidate is skipped, and a bucket inside one component costs nothing more.

At the threshold a pair misses all ``bands`` with probability (1 - threshold ** rows) ** bands, 6e-9 by default.

Defined cases: null or empty text has an empty set, is linked with nothing and kept; fewer words than a shingle
form one shingle; rows of one id count as one node with the sets and links of all of them; a null id is returned with a
null component and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keep_ids, materialise

BLOCK_BYTES = 1 << 17  # about what one block of documents holds
PART = 8  # blocks of one join key


def word_shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """Distinct ``size``-word shingles; ASCII white space separates words, A-Z are lower-cased."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the same shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        out = np.minimum(out, (a[:, None] * x[None, k : k + 2048] + b[:, None]).min(axis=1))
    return out


def fewest_matches(batch: int, k: int, threshold: float, miss: float) -> list[int]:
    """Per batch end n: the smallest number of matches for which P(similarity >= threshold | matches) >= miss.

    With a uniform prior that posterior is P(Binomial(n + 1, threshold) <= matches).
    """
    out = []
    for n in range(batch, k + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands (bucket keys) and sig (16 bits of each minimum) of every document."""
    a, b = multipliers(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                n, keys, buckets, sigs = [], [], [], []
                for text in some.column(1).to_pylist():
                    h = shingle_hashes(text, shingle)
                    n.append(len(h))
                    keys.append(xxhash.xxh128_digest(h.tobytes()))
                    if len(h):
                        s = signature(h, a, b)
                        s = (s & 0xFFFF).astype(np.uint16)
                        buckets.append([xxhash.xxh64_intdigest(s[i : i + rows].tobytes(), seed=i) - (1 << 63) for i in range(0, len(s), rows)])
                        sigs.append(s.tobytes())
                    else:
                        buckets.append([])
                        sigs.append(b"")
                columns = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=["doc_id", "n_shingles", "set_key", "bands", "sig"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary")


def _likely(pairs: DataFrame, sigs: DataFrame, k: int, threshold: float, miss: float, batch: int = 40) -> DataFrame:
    """Pairs whose signatures don't rule out ``threshold``. Sixteen-bit minima can only add matches, never lose one."""
    least = fewest_matches(batch, k, threshold, miss)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x, y = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(-1, k) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(f)), np.zeros(len(f), np.int64)
            for i, m in enumerate(least):
                at = slice(i * batch, (i + 1) * batch)
                matches[alive] += (x[alive, at] == y[alive, at]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            yield f.iloc[alive][["a", "b"]]

    both = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInPandas(judge, "a long, b long")


def _exact(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets A, B have 100 * |A and B| >= percent * |A or B|."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[tuple[int, str], set] = OrderedDict()

        def words(*key) -> set:
            if key not in recent:  # an id alone may have several texts
                recent[key] = word_shingles(key[1], shingle)
                if len(recent) > 256:
                    recent.popitem(last=False)
            return recent[key]

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                keep = []
                for a, b, s, t in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    x, y = words(a, s), words(b, t)
                    both = len(x & y)
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield some.select(["a", "b"]).filter(pa.array(keep))

    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def profiles(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """doc_id, bytes, sig and the sorted 32-bit shingle hashes of every document."""
    a, b = multipliers(k)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                hashes = [shingle_hashes(t, shingle) for t in some.column(1).to_pylist()]
                sigs = [(signature(h, a, b) & 0xFFFF).astype(np.uint16).tobytes() for h in hashes]
                short = [np.unique(h.astype(np.uint32)).tobytes() for h in hashes]
                size = [len(x) + len(y) for x, y in zip(sigs, short, strict=True)]
                columns = [pa.array(size, pa.int64()), pa.array(sigs, pa.binary()), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=["doc_id", "bytes", "sig", "hashes"])

    return docs.mapInArrow(profile, "doc_id long, bytes long, sig binary, hashes binary")


def _shared(x: list[bytes], y: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the hash sets ``x[i]`` and ``y[j]``; ``j`` ascends."""
    hashes = np.frombuffer(b"".join(x), np.uint32)
    owner = np.repeat(np.arange(len(x)), [len(h) // 4 for h in x])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    out = np.empty(len(i), np.int64)
    for k in np.unique(j):
        mine = np.frombuffer(y[k], np.uint32)
        at = np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)
        here = slice(*np.searchsorted(j, [k, k + 1]))
        out[here] = np.bincount(owner[mine[at] == hashes], minlength=len(x))[i[here]]
    return out


def _blocks(pairs: DataFrame, k: int, rows: int, percent: int, miss: float, batch: int = 40) -> DataFrame:
    """Likely links between two blocks of one bucket, given as arrays ``x`` and ``y`` of documents; ``y`` are outside the main component."""
    least = fewest_matches(batch, k, percent / 100, miss)

    def columns(block):
        ids, component, rest, sig, hashes = (block.field(c) for c in ("doc_id", "component", "rest", "sig", "hashes"))
        return ids.to_numpy(), component.to_numpy(), rest.to_numpy(zero_copy_only=False), np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(-1, k), hashes.to_pylist()

    def keys(sig, band):
        own = np.ascontiguousarray(sig[:, band * rows : (band + 1) * rows])
        return own.view(np.dtype((np.void, own.itemsize * rows))).ravel()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                band, x, y = b.column("band")[n].as_py(), columns(b.column("x")[n].values), columns(b.column("y")[n].values)
                # each pair once: both ways round only one counts, and only in the first bucket that both are in
                open_ = (x[1][:, None] != y[1][None]) & ~(x[2][:, None] & (x[0][:, None] < y[0][None]))
                codes = np.unique(np.concatenate([c for u in range(band + 1) for c in (keys(x[3], u), keys(y[3], u))]), return_inverse=True)[1]
                parts, at = [], 0
                for _ in range(band + 1):
                    parts.append((codes[at : at + len(x[0])], codes[at + len(x[0]) : at + len(x[0]) + len(y[0])]))
                    at += len(x[0]) + len(y[0])
                open_ &= parts[-1][0][:, None] == parts[-1][1][None]
                for p, q in parts[:-1]:
                    open_ &= p[:, None] != q[None]
                j, i = np.nonzero(open_.T)
                matches = np.zeros(len(i), np.int64)
                for u, m in enumerate(least):
                    cut = slice(u * batch, (u + 1) * batch)
                    matches += (x[3][i, cut] == y[3][j, cut]).sum(axis=1)
                    alive = matches >= m
                    i, j, matches = i[alive], j[alive], matches[alive]
                if not len(i):
                    continue
                both = _shared(x[4], y[4], i, j)
                total = np.array([len(h) // 4 for h in x[4]])[i] + np.array([len(h) // 4 for h in y[4]])[j]
                slack = 2 + total * total / 2**31  # hashes of 32 bits may coincide
                alive = 100 * (both + slack) >= percent * (total - both - slack)
                u, v = x[0][i[alive]], y[0][j[alive]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return pairs.select("band", "x", "y").mapInArrow(judge, "a long, b long")


def _outside(members: DataFrame, labels: DataFrame, texts_of, shingle: int, k: int, rows: int, percent: int, miss: float) -> DataFrame:
    """Likely links of the members that stand outside the largest component of a bucket.

    What is known of a bucket is written before it is joined to the members, so that a hot bucket can be split.
    """
    at = members.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    at = at.withColumn("component", F.coalesce("component", "doc_id"))
    per = at.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket")
    main = per.agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("k"))
    main = materialise(main.where("k > 1").drop("k"), "main")
    rest = (F.col("component") != F.col("main")).alias("rest")
    # a hub has been held against all others of its bucket
    at = at.join(main, "bucket").where("not held").select("bucket", "band", "doc_id", "component", rest)
    at = materialise(at, "open")
    ids = materialise(at.select("doc_id").distinct(), "ids")
    known = materialise(profiles(texts_of(ids), shingle, k), "profiles")
    size = at.join(known.select("doc_id", "bytes"), "doc_id").groupBy("bucket")
    size = size.agg(F.sum("bytes").alias("all"), F.sum(F.when(F.col("rest"), F.col("bytes"))).alias("some")).where("some > 0")
    dealt = [F.ceil(F.col(c) / BLOCK_BYTES).alias(n) for c, n in (("all", "n_x"), ("some", "n_y"))]
    full = at.join(materialise(size.select("bucket", *dealt), "dealt"), "bucket").join(known, "doc_id")
    document = F.struct("doc_id", "component", "rest", "sig", "hashes")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    x = full.groupBy("bucket", "band", block("n_x").alias("block")).agg(F.collect_list(document).alias("x"))
    x = x.withColumn("part", F.floor(F.col("block") / PART))
    y = full.where("rest").groupBy("bucket", block("n_y").alias("block"))
    y = y.agg(F.collect_list(document).alias("y"), F.first("n_x").alias("n_x"))
    y = y.select("bucket", "y", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_x") - 1) / PART))).alias("part"))
    return _blocks(x.join(y, ["bucket", "part"]), k, rows, percent, miss).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 5, miss: float = 1e-9,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = materialise(signed(docs, shingle, bands, rows), "signed")
    some = table.where("n_shingles > 0 and doc_id is not null")
    repeats = not some.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = materialise(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = some.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    if repeats:  # a row for each set of an id
        reps = reps.dropDuplicates(["set_key", "doc_id"])
    sigs = reps.select("doc_id", "sig")
    posted = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket")).withColumn("band", F.col("band").cast("byte"))
    posted = posted.distinct() if repeats else posted
    shared = materialise(posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialise(posted.join(shared, "bucket"), "members")
    # the document that shares most buckets with most others stands nearest to the middle of its group
    degree = members.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("degree"))
    middle = members.join(degree, "doc_id").groupBy("bucket")
    middle = materialise(middle.agg(F.max(F.struct("degree", "doc_id"))["doc_id"].alias("hub")), "middle")
    star = members.join(middle, "bucket").select("bucket", "band", "doc_id", "hub", (F.col("doc_id") == F.col("hub")).alias("held"))
    texts = docs.where("doc_id is not null")

    def texts_of(ids: DataFrame) -> DataFrame:
        found = keep_ids(texts, "doc_id", ids).select("doc_id", "text")
        return found.dropDuplicates(["doc_id", "text"]) if repeats else found

    pairs = star.where("not held").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    links = None
    for step in ("star", "outside"):
        if links is None:
            likely = _likely(pairs, sigs, bands * rows, percent / 100, miss)
            likely = likely.distinct() if repeats else likely
        else:
            likely = _outside(star, labels, texts_of, shingle, bands * rows, rows, percent, miss)
        likely = materialise(likely, f"likely-{step}")
        ids = materialise(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        found = materialise(_exact(likely, texts_of(ids), shingle, percent), "links")
        labels = materialise(components(found if links is None else links.union(found)), "labels")
        links = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    rep = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
    class_of = table.join(classes, "set_key", "left").select("doc_id", "n_shingles", rep)
    if repeats:  # the rows of one id may be of several classes: its classes meet
        links = links.union(class_of.where("rep != doc_id").select("rep", "doc_id").distinct())
        labels = materialise(components(links), "labels")
        named = class_of.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    else:
        named = class_of.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return named.select("doc_id", "n_shingles", "component_id", kept)
